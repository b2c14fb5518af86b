from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.util import groups
from tidemark.llm import minhash as M
from tidemark.llm import vectors as V
from tidemark.llm.components import connected_components
from tidemark.llm.store import Workspace


def similarity(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    return sum((sets[0] & sets[1]).values()) / sum((sets[0] | sets[1]).values())


def classes(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_signature_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 400, 300)]
    other = base[:200] + [f"v{i}" for i in range(100)]
    a, b = " ".join(base + base[:80]), " ".join(other + base[:80])
    unit, off = M.elements(pa.array([a, b]))
    s = M.signatures(unit, off, 2000)
    assert abs((s[0] == s[1]).mean() - similarity(a, b)) < 0.04


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "x", "", "long " * 3000, "a b c d e f g h"]
    alone = np.vstack([M.signatures(*M.elements(pa.array([t]))) for t in texts])
    assert (M.signatures(*M.elements(pa.array(texts))) == alone).all()


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = {}
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(6, 120))]
        for _ in range(rng.integers(1, 6)):
            copy = list(base)
            for k in rng.integers(0, len(base), rng.integers(0, 3)):
                copy[k] = f"z{rng.integers(0, 99)}"
            texts[len(texts)] = " ".join(copy)
    hot = [f"h{x}" for x in range(80)]
    for k in range(60):  # a large group around one text
        copy = list(hot)
        copy[k] = "q"
        texts[len(texts)] = " ".join(copy)
    rows = [*texts.items(), (9001, None), (9002, ""), (9003, "!!! ..."), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS n", "2 AS bucket")
    got = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    ids = list(texts)
    links = [(a, b) for a in ids for b in ids if a < b and similarity(texts[a], texts[b]) >= 0.8]
    want = classes(links, ids) | {i: i for i in (9001, 9002, 9003)}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.class_id) for i, r in got.items())


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    import corpus_pipeline as P

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(2)), (None, text(1)), (None, text(3)), (None, text(4)), (None, None), (5, text(2)), (5, text(5)), (5, text(5) + " end"), (6, text(6)), (6, text(6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.copy_of, r.kept) for r in M.near_duplicates(df).collect()}
    assert {(1, 1, 1, True), (None, 1, 1, False), (None, None, None, True), (5, 2, 2, False), (5, 5, 5, True), (5, 5, 5, False), (6, 6, 6, True)} <= got
    stays = [tuple(r) for r in dict(P.STAGES)["minhash_near_dedup"](spark, df, "").collect()]
    assert all(stays.count(r) == rows.count(r) for r in rows if r[1] not in (text(1), text(2), text(5), text(5) + " end"))
    assert sorted(str(i) for i, t in stays if t in (text(1), text(2))) == ["1", "2"] and sum(i == 5 for i, _ in stays) == 1


def test_stages_reject_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as P

    good = [f"the quick brown fox number {w} jumps over lazy dogs" for w in ("one", "two", "three", "four", "five", "six")]
    item = "a secret benchmark question about seven green bottles on the wall"
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(None, good[0], "en"), (None, "12 34", "en"), (3, "!!!", "en"), (None, item, "en"), (4, item, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame([("a", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage, left = dict(P.STAGES), lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert left(stage["language_id"](spark, df, "")) == sorted(str(r) for r in rows if r[1] not in ("12 34", "!!!"))
    assert left(stage["benchmark_decontamination"](spark, df, str(tmp_path))) == sorted(str(r) for r in rows if r[1] != item)


def test_near_duplicates_of_nothing(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parity_bitmaps_never_hide_a_pair():
    rng = np.random.default_rng(3)
    for n in (20, 140, 500):
        base = [f"w{x}" for x in range(n)]
        copy = [w if rng.random() > 0.02 else w + "x" for w in base]
        unit, off = M.elements(pa.array([" ".join(base), " ".join(copy)]))
        p = [np.array(x, np.int64).view(np.uint64) for x in M.parities(unit, off).to_pylist()]
        a, b = set(unit[: off[1]]), set(unit[off[1] :])
        assert sum(int(x ^ y).bit_count() for x, y in zip(*p, strict=True)) <= len(a ^ b)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = groups(connected_components(Workspace(spark, "t"), edges).collect(), "component", "id")
    assert got == {0: set(range(51)), 100: {100, 101}}


@pytest.mark.parametrize("block", [4, 256])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=(6, 24))
    for i in range(240):
        x = centre[i % 6] + rng.normal(size=24) * (0.02 if i % 2 else 0.15)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 3))
    rows += [(300 + k, rows[1][1], 1) for k in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] + [1.0] * 23, 1), (403, [None] + [1.0] * 23, 1), (404, rows[1][1], None), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [float("inf")] * 24, 1), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS first", "'k' AS keys")
    got = {r.vec_id: r for r in V.near_vectors(df).collect()}
    ok = {}
    for i, x, y in rows:
        v = None if x is None or y is None or any(c is None or not np.isfinite(c) for c in x) or not any(x) else np.float32(x).astype(float)
        if v is not None:
            ok[i] = (v, y)
    links = defaultdict(set)
    for i, (x, y) in ok.items():
        for j, (z, u) in ok.items():
            if i != j and y == u and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.98:
                links[i].add(j)
    ids = {r[0] for r in rows}
    want = classes([(a, b) for a, c in links.items() for b in c], sorted(ids))
    assert {i: r.n_links for i, r in got.items()} == {i: len(links[i]) for i in ids}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_vectors_of_repeated_and_null_ids(spark):
    v, w, u = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [-3.0, 1.0, 0.5]
    rows = [(5, v, 1), (5, w, 1), (5, u, 1), (5, u, 1), (None, v, 1), (None, u, 2), (None, u, 2), (None, [0.0] * 3, 2), (2, w, 1), (9, w, 2), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS place", "2 AS node", "3 AS n_links")
    got = sorted(map(tuple, V.near_vectors(df).collect()), key=str)
    want = [(5, 3, 2, False), (5, 3, 2, False), (5, 0, 5, True), (None, 3, 2, False), (None, 0, None, True), (None, 0, None, True), (2, 3, 2, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    both = spark.createDataFrame([(None, v, 1), (None, w, 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(r.kept for r in V.near_vectors(both).collect()) == [False, True]


def test_recall_of_searches(spark):
    """Links of every vector whose id is divisible by 20, against brute force over all rows; cosines lie on both sides of the bound."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(150, 32))
    x = centres[np.arange(3000) % 150] + rng.uniform(0.02, 0.3, size=(3000, 1)) * rng.normal(size=(3000, 32))
    label = np.arange(3000) % 150 % 3
    vectors = spark.createDataFrame([(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in V.near_vectors(vectors).collect()}
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = {i: int((((x @ x[i]) >= 0.98) & (label == label[i])).sum()) - 1 for i in range(0, 3000, 20)}
    assert sum(want.values()) > 300 and sum(got[i] for i in want) >= 0.99 * sum(want.values()) and all(got[i] <= n for i, n in want.items())


def test_near_vectors_of_nothing(spark):
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
