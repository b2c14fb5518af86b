import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import capped, profile, retrieval
from tidemark.operators.containment import containing
from tidemark.operators.index import VectorIndex
from tidemark.tables import table
from tidemark.workspace import listed, qualified, shared_root


def bm25_by_hand(texts, question, k):
    words = {i: norm(t).split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    total = dict.fromkeys(words, 0.0)
    for w in sorted(set(norm(question).split())):
        held = sum(w in t for t in words.values())
        idf = math.log(1 + (len(words) - held + 0.5) / (held + 0.5))
        for i, t in words.items():
            total[i] += idf * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    best = sorted((-math.floor(s * 1e6 + 0.5) / 1e6, i) for i, s in total.items() if s)[:k]
    return [(i, -s) for s, i in best]


def norm(text):
    return text.lower().translate(str.maketrans("_.-", "   "))


def test_ranking_in_blocks_equals_plain_python(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").limit(6)
    ask = lambda block: {tuple(r) for r in retrieval.ranked(docs, items, 5, id_col="doc_id", text_col="text", question_id="item_id", question_text="text", block=block).collect()}
    whole = ask(1_000_000)
    assert len(whole) == 30 and whole == ask(300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in items.collect():
        assert [(d, s) for _, d, s, _ in sorted((x for x in whole if x[0] == r.item_id), key=lambda x: x[3])] == bm25_by_hand(texts, r.text, 5)


def test_odd_questions_and_texts(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", ""), (None, "x"), ("d", "x x x"), ("a", "z")], "id string, text string").selectExpr("*", "1 AS score", "2 AS question")
    asked = spark.createDataFrame([("q1", "x"), ("q1", "z"), ("q2", ""), ("q3", None), (None, "x"), ("q4", "nowhere")], "q string, t string")
    ask = lambda d, q: retrieval.ranked(d, q, 3, id_col="id", text_col="text", question_id="q", question_text="t").collect()
    assert {(r.q, r.id) for r in ask(docs, asked)} == {("q1", "a"), ("q1", "d")}
    assert ask(docs.limit(0), asked) == [] and ask(docs, asked.limit(0)) == []


def test_cases(spark):
    cases = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "ok"), (4, "ok")], "case long, pass_criteria string")
    expected = spark.createDataFrame([(1, 10, None), (1, 11, None), (1, 11, None), (2, 12, None), (2, None, "t"), (3, None, "u")], "case long, id long, type string")
    hits = spark.createDataFrame([(1, 11, "t", 2), (1, 10, "t", 12), (2, 12, "t", 1), (3, 9, "t", 1)], "case long, id long, type string, rank int")
    got = {r.case: (r.n_expected, r.n_found, r.recall, r.mrr, r.status, r.reason) for r in retrieval.case_results(cases, expected, hits).collect()}
    assert got == {1: (2, 1, 0.5, 0.5, "failed", "missing ids: 10"), 2: (1, 1, 1.0, 1.0, "passed", "ok"), 3: (0, 0, 1.0, 0.0, "failed", "missing types: u"), 4: (0, 0, 1.0, 0.0, "passed", "ok")}


@pytest.mark.parametrize("block", [1, 20, 10_000])
def test_containment_equals_brute_force(spark, block):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab. É") for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(60)] + [(100, None), (None, "ab")]
    items = [(i, text(rng.randint(0, 4))) for i in range(15)] + [(50, None), (51, "ab"), (52, "ab")]
    want = Counter((d, i) for d, t in docs for i, p in items if t is not None and p and norm(p) in norm(t))
    got = containing(spark.createDataFrame(docs, "doc_id long, text string").withColumn("phrase", F.lit(1)), spark.createDataFrame(items, "item_id long, t string"), id_col="doc_id", text_col="text", item_id="item_id", item_text="t", block=block)
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want


def cosine_by_hand(rows, questions, k, keep=lambda r: True):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = set()
    for q, v in questions:
        scored = sorted((-np.floor(unit(w) @ unit(v) * 1e6 + 0.5) / 1e6, i) for i, (w, label) in rows.items() if keep(label))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(scored[:k])}
    return out


def test_index_is_built_updated_and_searched(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = {i: ([float(x) for x in np.float32(centres[i % 20] + 0.4 * rng.normal(size=16))], i % 4) for i in range(1500)}
    frame = lambda some: spark.createDataFrame([(i, v, lab) for i, (v, lab) in some.items()], "key long, vec array<float>, label int")
    at = str(tmp_path / "index")
    index = VectorIndex.build(frame(rows), at, id_col="key", vector_col="vec", cells=24)
    ask = lambda ix, questions, **how: {(r.question, r.id, r["rank"]) for r in ix.search(frame(questions), 5, id_col="key", vector_col="vec", **how).collect()}
    some = {i: rows[i] for i in range(0, 1500, 50)}
    vectors = [(i, v) for i, (v, _) in some.items()]
    assert ask(index, some) == cosine_by_hand(rows, vectors, 5)
    assert ask(index, some, filters={"label": [1, 2]}) == cosine_by_hand(rows, vectors, 5, lambda x: x in (1, 2))
    assert ask(index, some, block=40) == cosine_by_hand(rows, vectors, 5)
    assert index.recall(frame(some), 4, 5, id_col="key", vector_col="vec") >= 0.9
    files = index.search(frame({0: rows[0]}), 5, id_col="key", vector_col="vec", probe=2).inputFiles()
    assert 0 < len({f.split("cell=")[1].split("/")[0] for f in files if "cell=" in f}) <= 2 < len(listed(spark, f"{index.path}/lists/g=1"))
    # changes
    rows[7] = ([1.0] + [0.0] * 15, 0)
    rows[9999] = ([0.0, 1.0] + [0.0] * 14, 3)
    change = {i: rows[i] for i in (7, 8, 9999)}
    again = VectorIndex(spark, at)
    assert again.upsert(frame(change), id_col="key", vector_col="vec") == 2
    assert again.upsert(frame(change), id_col="key", vector_col="vec") == 0
    odd = spark.createDataFrame([(5, None, 1), (6, [0.0] * 16, 1), (8888, [float("nan")] * 16, 1), (None, [1.0] * 16, 1)], "key long, vec array<float>, label int")
    assert again.upsert(odd, id_col="key", vector_col="vec") == 2
    assert again.delete(spark.createDataFrame([(11,), (123456,), (11,)], "id long")) == 1
    for gone in (5, 6, 11):
        del rows[gone]
    assert {r.id for r in again.rows().collect()} == set(rows)
    assert ask(VectorIndex(spark, at), some) == cosine_by_hand(rows, vectors, 5)
    with pytest.raises(FileExistsError):
        VectorIndex.build(frame(rows), at, id_col="key", vector_col="vec")


def test_a_job_that_died_leaves_the_old_state(spark, tmp_path):
    rows = [(i, [float(i + 1), 1.0], i) for i in range(40)]
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, vector array<double>, m int"), str(tmp_path / "i"), id_col="id", vector_col="vector", cells=3)
    before = sorted(index.rows().collect())
    spark.createDataFrame([(1, 2.0)], "id long, junk double").write.parquet(f"{index.path}/lists/g=2/cell=0")
    spark.createDataFrame([(0, 2)], "cell int, g int").write.parquet(f"{index.path}/manifest/2")
    (tmp_path / "i/manifest/2/_SUCCESS").unlink()
    assert sorted(index.rows().collect()) == before
    assert index.upsert(spark.createDataFrame([(1, [9.0, 9.0], 5)], "id long, vector array<double>, m int")) == 1
    assert {r.id: r.m for r in index.rows().collect()} == {i: 5 if i == 1 else i for i in range(40)}
    index.vacuum()
    assert listed(spark, f"{index.path}/manifest") == ["2"] and len(index.rows().collect()) == 40


def test_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, vector array<double>, m int")
    index = VectorIndex.build(empty, str(tmp_path / "i"), id_col="id", vector_col="vector")
    assert index.search(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), id_col="id", vector_col="vector").collect() == []


def frequencies(rows, c):
    got = Counter(str(r[c]).strip() for r in rows if r[c] is not None and str(r[c]).strip())
    return sorted(got.items(), key=lambda x: (-x[1], x[0].encode()))


@pytest.mark.parametrize("capacity", [6, 40, 1024])
def test_frequent_values_are_exact(spark, capacity):
    """Hot, flat, unique, long, tied and missing values, with few counters."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 30 + [f"v{k}" for k in range(60)]), f"k{i}", rng.choice(["x" * 100, "y" * 100, "z"]), rng.choice(["a", "b", None, " "]), i % 7, None) for i in range(1200)]
    names = ["a", "key", "long", "few", "tied", "none"]
    df = spark.createDataFrame(rows, "a string, key string, long string, few string, tied int, none string").repartition(5)
    got = {}
    for r in capped.top_values({"t": (df, names)}, 5, capacity).collect():
        got.setdefault(r.column, []).append((r["rank"], r.value, r.n))
    for c, name in enumerate(names):
        assert [(v, n) for _, v, n in sorted(got.get(name, []))] == frequencies(rows, c)[:5], name


def test_capped_profile_equals_the_whole_one(spark, sf):
    for name in ("orders", "documents", "labels", "customer"):
        df = table(spark, sf, name)
        whole = {r.column: r.asDict(recursive=True) for r in profile.profile(df, name).collect()}
        low = {r.column: r.asDict(recursive=True) for r in capped.profiles(capped.all_columns({name: df}), capacity=32).collect()}
        for c, w in whole.items():
            assert low[c]["cardinality"] == min(w["cardinality"], 21)
            assert {k: low[c][k] for k in low[c] if k not in ("cardinality", "avg_length")} == {k: w[k] for k in low[c] if k not in ("cardinality", "avg_length")}, (name, c)


def test_capped_profile_moves_few_rows(spark):
    """A unique column: a task hands on its counters, not its values."""
    df = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    summed = capped.counters({"t": (df, ["k"])}, 64)
    assert summed.count() <= 64 * df.rdd.getNumPartitions() + 1
    assert capped.capped_counts(summed).head().cardinality == 21
    with pytest.raises(ValueError, match="threshold"):
        capped.profiles({"t": (df, ["k"])}, capacity=20)


def test_paths_have_a_scheme(spark):
    assert qualified(spark, "/tmp/x") == "file:///tmp/x" and qualified(spark, "file:///tmp/x") == "file:///tmp/x"
    assert shared_root(spark).split(":")[0] in ("file", "hdfs")
