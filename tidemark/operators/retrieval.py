"""Many questions ranked against all texts in one job, and the cases that judge a ranking.

A block of questions goes to all tasks as term weights. Each task scores its texts against the whole block with numpy and
hands on the best k of each question, so what is shuffled is k rows a question and task, however common a word is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..workspace import ship
from .blocks import blocks, lengths, united

K1, B = 1.2, 0.75
#: Characters of questions in a block, and scores that a task holds at once.
BLOCK, CELLS = 2_000_000, 2_000_000
SPLIT = r"[ \t\n\x0B\f\r]+"


class Questions(NamedTuple):
    """A block: its words, and for each word the questions that hold it, from begin[w] to begin[w + 1]."""

    words: list[str]
    begin: np.ndarray
    question: np.ndarray
    n: int


def questions_of(texts: list[str]) -> Questions:
    sets = [sorted({w for w in pc.split_pattern_regex(pa.scalar(t), SPLIT).as_py() if w}) for t in texts]
    words = sorted(set().union(*sets))
    place = {w: i for i, w in enumerate(words)}
    pairs = np.array([(place[w], q) for q, s in enumerate(sets) for w in s], np.int64).reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return Questions(words, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1], len(texts))


def _counted(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count) of the words that are asked for, and each row's number of words of any kind."""
    pieces = pc.split_pattern_regex(pc.fill_null(texts, ""), SPLIT)
    pieces = pieces.combine_chunks() if isinstance(pieces, pa.ChunkedArray) else pieces
    row, flat = np.asarray(pc.list_parent_indices(pieces)), pieces.flatten()
    real = np.asarray(pc.not_equal(flat, "")).astype(bool)
    size = np.bincount(row[real], minlength=len(texts))
    at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=words), -1))
    key, count = np.unique(row[at >= 0] * len(words) + at[at >= 0], return_counts=True)
    return key // max(len(words), 1), key % max(len(words), 1), count, size


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def _statistics(batches: Iterator[pa.RecordBatch], asked: Questions) -> Iterator[pa.RecordBatch]:
    """This task's texts (word -1), their words (-2), and texts that hold each word."""
    held, texts, total = np.zeros(len(asked.words), np.int64), 0, 0
    words = pa.array(asked.words, pa.string())
    for part in _parts(batches, 1024):
        _, word, _, size = _counted(part.column(1), words)
        held += np.bincount(word, minlength=len(held))
        texts, total = texts + len(part), total + int(size.sum())
    seen = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], seen])), pa.array(np.concatenate([[texts, total], held[seen]]))], names=["word", "n"])


def _best(batches: Iterator[pa.RecordBatch], asked: Questions, idf: np.ndarray, mean: float, k: int | None) -> Iterator[pa.RecordBatch]:
    """The best k texts of each question in this task, by score to six decimals, then id; or all that score."""
    words = pa.array(asked.words, pa.string())
    kept: tuple[np.ndarray, np.ndarray, pa.Array] | None = None
    for part in _parts(batches, max(1, min(1024, CELLS // max(asked.n, 1)))):
        row, word, count, size = _counted(part.column(1), words)
        weight = idf[word] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[row] / mean)) if mean else np.zeros(len(row))
        each = asked.begin[word + 1] - asked.begin[word]
        entry = np.repeat(np.arange(len(row)), each)
        question = asked.question[np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each) + asked.begin[word][entry]]
        score = np.bincount(question * len(part) + row[entry], weight[entry], asked.n * len(part))
        cell = np.flatnonzero(score)
        score = np.floor(score[cell] * 1e6 + 0.5) / 1e6
        found = (cell // len(part), score, part.column(0).take(pa.array(cell % len(part))))
        if k is None:
            yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), found[2], pa.array(score)], names=["place", "id", "score"])
            continue
        if kept is not None:
            found = (np.concatenate([kept[0], found[0]]), np.concatenate([kept[1], found[1]]), pa.concat_arrays([kept[2], found[2]]))
        order = _by_id(found[2])
        order = order[np.lexsort((-found[1][order], found[0][order]))]
        first = np.searchsorted(found[0][order], found[0][order])
        order = order[np.arange(len(order)) - first < k]
        kept = (found[0][order], found[1][order], found[2].take(pa.array(order)))
    if kept is not None:
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), kept[2], pa.array(kept[1])], names=["place", "id", "score"])


def _by_id(ids: pa.Array) -> np.ndarray:
    return np.asarray(pc.sort_indices(ids)).astype(np.int64)


def ranked(docs: DataFrame, questions: DataFrame, k: int | None = 10, *, id_col: str, text_col: str, question_id: str, question_text: str, block: int = BLOCK) -> DataFrame:
    """(question_id, id_col, score, rank): the k best texts of each question by BM25 over distinct question words, scores to six decimals, ties by id.

    With k of None all scores are returned, without ranks. Counts and mean length are over all texts (null texts are empty). Texts without id, or without a word of the question, aren't ranked; nor are
    null questions. docs are read twice a block of questions.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("id"), norm(F.col(text_col)).alias("text"))
    asked = questions.where(F.col(question_id).isNotNull() & F.col(question_text).isNotNull()).select(F.col(question_id).alias("question"), norm(F.col(question_text)).alias("text")).where("text <> ''")
    kinds = [texts.schema["id"].dataType.simpleString(), asked.schema["question"].dataType.simpleString()]
    parts = []
    for some in blocks(asked, lengths("text"), block, "question", "text"):
        q = questions_of([r["text"] for r in some])
        shared = spark.sparkContext.broadcast(q)
        counts = texts.mapInArrow(lambda it, s=shared: _statistics(it, s.value), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        got = {r["word"]: r["n"] for r in counts}
        n, held = got.get(-1, 0), np.array([got.get(w, 0) for w in range(len(q.words))], float)
        idf, mean = np.log(1 + (n - held + 0.5) / (held + 0.5)), got.get(-2, 0) / max(n, 1)
        best = texts.where("id IS NOT NULL").mapInArrow(lambda it, s=shared, i=idf, m=mean: _best(it, s.value, i, m, k), f"place int, id {kinds[0]}, score double")
        names = spark.createDataFrame([(i, r["question"]) for i, r in enumerate(some)], f"place int, question {kinds[1]}")
        parts.append(best.join(names, "place").select("question", "id", "score"))
    hits = united(parts, docs, f"question {kinds[1]}, id {kinds[0]}, score double")
    if k is None:
        return hits.select(F.col("question").alias(question_id), F.col("id").alias(id_col), "score")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("question").alias(question_id), F.col("id").alias(id_col), "score", "rank")


def six(c: Column) -> Column:
    return F.floor(c * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)


def case_results(cases: DataFrame, expected: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """One row a case: n_expected, n_found, recall, mrr, first_rank, missing (ids), missing_types, status, reason.

    cases: case, pass_criteria. expected: case, id and/or type, one row an expectation (the other null). hits: case, id, type, rank.
    Recall is the share of expected ids among the first k hits, 1 where none is expected; mrr is 1 / the first expected hit's rank. A case passes if
    no expected id and no expected type is missing. A case that more is expected of than k ids costs its expectations only, and none is collected.
    """
    top = hits.where(F.col("rank") <= k)
    want = expected.select("case", "id", "type").distinct()
    ids = want.where("id IS NOT NULL").select("case", "id").distinct().join(top.groupBy("case", "id").agg(F.min("rank").alias("rank")), ["case", "id"], "left")
    types = want.where("type IS NOT NULL").select("case", "type").distinct().join(top.select("case", "type", F.lit(True).alias("seen")).distinct(), ["case", "type"], "left")
    by_id = ids.groupBy("case").agg(
        F.count("*").alias("n_expected"), F.count("rank").alias("n_found"), F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(F.when(F.col("rank").isNull(), F.col("id").cast("string")))).alias("missing")
    )
    by_type = types.groupBy("case").agg(F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.col("type")))).alias("missing_types"))
    out = cases.select("case", "pass_criteria").join(by_id, "case", "left").join(by_type, "case", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"missing": F.coalesce("missing", none), "missing_types": F.coalesce("missing_types", none)}).fillna(0, ["n_expected", "n_found"])
    reason = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.size("missing") > 0, F.concat(F.lit("missing ids: "), F.array_join("missing", ", "))),
                F.when(F.size("missing_types") > 0, F.concat(F.lit("missing types: "), F.array_join("missing_types", ", "))),
            )
        ),
        "; ",
    )
    good = (F.size("missing") == 0) & (F.size("missing_types") == 0)
    return out.select(
        "case", "n_expected", "n_found", F.when(F.col("n_expected") == 0, 1.0).otherwise(six(F.col("n_found") / F.greatest("n_expected", F.lit(1)))).alias("recall"),
        F.coalesce(six(1 / F.col("first_rank")), F.lit(0.0)).alias("mrr"), "first_rank", "missing", "missing_types",
        F.when(good, "passed").otherwise("failed").alias("status"), F.when(good, F.col("pass_criteria")).otherwise(reason).alias("reason"),
    )


def overall(results: DataFrame) -> DataFrame:
    """One row: cases, passed, failed, mean recall and mean mrr to six decimals."""
    return results.agg(
        F.count("*").alias("cases"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"),
        six(F.avg("recall")).alias("recall"), six(F.avg("mrr")).alias("mrr"),
    )
