import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening as W


def by_hand(rows):
    """Exact sums by Python's integers; the covariance of centred values by fractions."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    centred = [[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in kept]
    v = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)])
    return n, {i: sum(a * a for a in c) for (i, _), c in zip(kept, centred, strict=True)}, v, {i: np.array([float(Fraction(a, n)) for a in c]) for (i, _), c in zip(kept, centred, strict=True)}


def held_against(spark, df, rows):
    model = W.fit(df)
    got = W.whiten(df, model, W.identity_error(df, model)).collect()
    n, deviation, v, centred = by_hand(rows)
    k = min(32, len(v))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in deviation for c in range(k))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    for c in range(k):
        some = [r for r in got if r.component == c + 1]
        assert all((r.n, r.deviation) == (n, deviation[r.vec_id] if deviation[r.vec_id] < 2**63 else None) for r in some)
        assert all(abs(r.explained - values[c] / np.trace(v)) <= 1e-9 * r.explained for r in some)
        want = np.array([centred[r.vec_id] @ vectors[:, c] / np.sqrt(values[c]) for r in some])
        have = np.array([r.whitened for r in some])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9


@pytest.mark.parametrize("size", [1.0, 1e-3, 1e12])
def test_whitening_equals_exact_arithmetic(spark, size):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(40, 40))
    rows = [(i, [float(c) for c in (rng.normal(size=40) @ mixed * size + 3 * size + (40 if size < 1 else 0)).astype(np.float32)]) for i in range(300)]
    odd = [(1000, None), (1001, [None] + [1.0] * 39), (1002, [math.nan] * 40), (1003, [math.inf] + [0.0] * 39)]
    rows += [(500, rows[0][1])]
    if size < 1:
        rows = [(i, [c * 1000 for c in v]) for i, v in rows]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS _id", "1 AS component", "2 AS n").repartition(5)
    held_against(spark, df, rows)


def test_residues_give_exact_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**62), 2**62, size=(W.ROWS + 10, 3))
    moduli = W.primes(2 * len(x) * 2**124)
    assert all(W.TOP // 2 < p < W.TOP for p in moduli) and len(set(moduli)) == len(moduli)
    got = W.rebuilt([m.ravel() for m in W.scatter(x, moduli)], moduli).reshape(4, 4)
    with_one = np.hstack([x.astype(object), np.ones((len(x), 1), object)])
    assert (got == with_one.T @ with_one).all()


def test_query_over_a_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    held_against(spark, df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    run = lambda d: (lambda m: W.whiten(d, m, W.identity_error(d, m)).collect())(W.fit(d))
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        assert run(df(rows)) == []
    same = run(df([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [5.0])]))
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(i, c, 3, 0, None, None, None) for i in (1, None, None) for c in (1, 2)]
    flat = run(df([(i, [float(i), 7.0]) for i in range(4)]))
    assert [r.whitened is None for r in flat] == [False, True] * 4 and all(abs(r.identity_error) < 1e-12 for r in flat)
    huge = run(df([(1, [3e38, 1.0]), (2, [-3e38, 2.0])]))
    assert all(r.deviation is None for r in huge) and len(huge) == 4
