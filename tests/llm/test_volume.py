"""Operators where one id, text or byte fills much of a table."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline
from tidemark.llm import language as L
from tidemark.llm import mixing, quality, substrings


def test_copies_of_a_labelled_row_arrive_once(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    rows = [(i, text(), "en", "s", 100) for i in range(60)] + [(7, "the same page", "en", "s", 13)] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sizes, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: sizes.append(len(got := collect(df))) or got)
    model = quality.fit(docs, labels, rounds=1)
    assert model.fitted and max(sizes) < 200


def test_rows_without_id_are_sampled_like_others(spark):
    docs = spark.createDataFrame([(None, f"aaaa bbbb {i}", "x") for i in range(600)] + [(i, f"cccc dddd {i}", "x") for i in range(1200)] + [(3, "copy copy", "x")] * 500, "doc_id long, text string, lang string")
    score = L.fit(docs, rows_per_language=100).score[:, 0]
    runs = lambda word: {int(b) for _, bucket in L._runs(L._text(pa.array([word], pa.large_string())).code) for b in bucket}
    best = lambda word: max(score[b] for b in runs(word))
    assert abs(best("aaaa") - best("cccc")) < 3 and best("copy") < min(best("aaaa"), best("cccc"))


def worth(score, offsets, labels, switch):
    total = 0.0
    for a, b in zip(offsets, offsets[1:], strict=False):
        total += score[np.arange(a, b), labels[a:b]].sum() - switch * (np.diff(labels[a:b]) != 0).sum()
    return total


def test_word_by_word_paths_are_as_good_as_those_of_blocks():
    rng = np.random.default_rng(3)
    offsets = np.concatenate([[0], np.cumsum([0, 1, 700, 64, 65, 3, 0, 129])])
    score = rng.normal(size=(offsets[-1], 5)) * 4
    both = [f(score, offsets, 6.0) for f in (L.viterbi, L._word_by_word)]
    assert abs(worth(score, offsets, both[0], 6.0) - worth(score, offsets, both[1], 6.0)) < 1e-6
    many = L.viterbi(rng.normal(size=(5000, 100)), np.array([0, 5000]))
    assert len(set(many)) < 100


def test_a_text_without_spaces_is_cut():
    text = "漢字" * (3 * L.PIECE)
    pieces, rows = L._pieces(pa.array([text]))
    assert max(len(p[0].as_py()) for p in pieces) <= 2 * L.PIECE and "".join(p[0].as_py() for p in pieces) == text and not rows.any()


def test_keys_of_rows_without_id_differ(spark):
    docs = spark.createDataFrame([(None, f"word {i}", "s") for i in range(3000)] + [(i, "a b", "s") for i in range(6000)], "doc_id long, text string, source string")
    keys = docs.select(mixing._key(F.col("doc_id"), F.col("text")).alias("k"))
    assert keys.distinct().count() == 9000
    assert mixing.mixed_documents(docs).agg(F.sum(mixing.word_count(F.col("text")))).head()[0] == 27_000


def test_runs_of_one_byte_leave_in_small_batches():
    part = b"a" * 300_000
    gram = substrings.stretches(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[1][0]
    row = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((1, pa.int64()), (b"h", pa.binary()), (1, pa.int64()), (0, pa.int32()), (1, pa.int64()), (int(gram.astype(np.int64)), pa.int64()), (0, pa.int32()), (substrings.LENGTH - substrings.GRAM + 1, pa.int32()), (part, pa.binary()))], names=list("abcdefghi"))
    sizes = [len(b) for b in substrings._halved(iter([row]), substrings.LENGTH)]
    assert sum(sizes) == len(part) - substrings.LENGTH + 1 and max(sizes) <= 4 * substrings.PIECE // 500 + 1


def test_columns_of_any_name_pass_the_pipeline(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "a"), (2, "x", "b")], "doc_id long, text string, _r1 string").withColumns({"k1": F.lit(1), "row": F.lit("r")})
    r1, r2 = corpus_pipeline.row_key(F.col("doc_id"), F.col("text"))
    left = corpus_pipeline._without(docs, docs.where("doc_id = 2").select(r1.alias("r1"), r2.alias("r2")))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "one two three four five six", "a", 1, "r")]
