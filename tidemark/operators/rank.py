"""Ranking of texts: lexical, hash-embedding, vector, BM25, their fusion, re-ranking, and retrieval metrics.

A query is a literal, so scores are expressions in the scan; top-k is TakeOrderedAndProject, which
keeps k rows a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm, words

# Broad business words (Korean) that make no match on their own.
GENERIC = ("고객", "매출", "금액", "날짜", "지역", "상품", "건수", "수량")
#: Any text does; an index and its queries must share it.
SALT, DIMENSIONS = "tidemark-v1", 32
# Priority of a card by how the question matched it.
PRIORITY = {"verified_query": 1100, "direct": 1000, "alias": 950, "related": 850, "ambiguity": 650, "reverse_question": 625}


def _normal(query: str) -> str:
    return query.lower().translate(str.maketrans("_.-", "   "))


def haystack(text: Column) -> Column:
    return norm(F.coalesce(text, F.lit("")))


def lexical_score(hay: Column, query: str, generic: Sequence[str] = GENERIC) -> Column:
    """10 + length for the whole phrase, 3 + length for each term found as a substring of a haystack(); generic terms alone: 0."""
    q = _normal(query)
    terms = q.split()
    if not q.strip():
        return F.lit(0)
    phrase = hay.contains(q)
    hits = [F.when(hay.contains(t), 3 + len(t)).otherwise(0) for t in terms]
    total = sum(hits, F.when(phrase, 10 + len(q)).otherwise(0))
    real = [hay.contains(t) for t in terms if t not in generic]
    meaningful = phrase
    for r in real:
        meaningful = meaningful | r
    return F.when(meaningful, total).otherwise(0)


def top(scored: DataFrame, k: int, *ties: str, score: str = "score") -> DataFrame:
    """The k best by score, ties by the given columns; k <= 0: none."""
    return scored.orderBy(F.col(score).desc(), *ties).limit(max(k, 0))


def lexical_topk(df: DataFrame, text: str, query: str, k: int, *ties: str) -> DataFrame:
    """The k best texts that score at all. The text is normalised once, in a column of its own; rows without a score are last, so they go after the cut."""
    scored = df.withColumn("_hay", haystack(F.col(text))).withColumn("score", lexical_score(F.col("_hay"), query)).drop("_hay")
    return top(scored, k, *ties).where("score > 0")


def clamp(k: int, low: int = 1, high: int = 100) -> int:
    return min(high, max(low, k))


def overfetch(k: int) -> int:
    """How many hits to take before re-ranking to k."""
    return min(100, max(3 * k, k + 10))


def normalised(hits: DataFrame, score: str = "score") -> DataFrame:
    """Adds score_n: the score over the best one where that is above 1, to six decimals."""
    best = F.max(score).over(Window.partitionBy())
    n = F.when(best > 1, F.col(score) / best).otherwise(F.col(score).cast("double"))
    return hits.withColumn("score_n", F.floor(n * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0))


def reranked(hits: DataFrame, priorities: DataFrame, k: int, key: str) -> DataFrame:
    """Hits by the largest priority given to them (else 0), then score, then id."""
    best = priorities.groupBy(key).agg(F.max("priority").alias("priority"))
    joined = hits.join(best, key, "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    return joined.orderBy(F.col("priority").desc(), F.col("score").desc(), key).limit(k)


def hash_embedding(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS, salt: str = SALT) -> DataFrame:
    """(key, embedding): each word's SHA-256 with its place picks a slot, a sign and a weight; the sum has length 1, or is zero without words."""
    placed = df.select(key, F.posexplode_outer(words(F.coalesce(F.col(text), F.lit("")))).alias("pos", "token"))
    digest = F.sha2(F.concat_ws(":", F.lit(salt), F.col("pos").cast("string"), "token"), 256)
    part = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    value = F.when(part(9, 2) % 2 == 0, 1.0).otherwise(-1.0) * (F.lit(0.5) + part(11, 2) / F.lit(255.0))
    slots = placed.select(key, (part(1, 8) % dimensions).cast("int").alias("slot"), F.when(F.col("token").isNotNull(), value).alias("value"))
    sums = slots.groupBy(key, "slot").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "value")))).alias("m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    slot = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.coalesce("norm", F.lit(0.0)) > 0, F.col("norm")).otherwise(1.0)
    return vectors.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), slot).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(df: DataFrame, vector: str, query: Sequence[float], k: int, *ties: str, measure=cosine) -> DataFrame:
    """The k nearest vectors to a literal query, by a scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(df.withColumn("score", measure(F.col(vector), q)), k, *ties)


def bm25(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score) of texts that hold any query word, to six decimals; statistics are over all texts."""
    from .retrieval import ranked

    one = df.sparkSession.createDataFrame([(0, query)], "_question int, _text string")
    return ranked(df, one, None, id_col=key, text_col=text, question_id="_question", question_text="_text").select(key, "score")


def fused(left: DataFrame, right: DataFrame, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two short ranked lists (key, rank)."""
    both = left.select(key, F.col("rank").alias("ra")).join(right.select(key, F.col("rank").alias("rb")), key, "full")
    score = F.coalesce(1 / (constant + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("rb")), F.lit(0.0))
    return top(both.withColumn("score", score), k, key)


def with_rank(hits: DataFrame, *ties: str) -> DataFrame:
    """Ranks of a list that top() has cut to k rows."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), *ties)))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """By query: recall at k, reciprocal rank of the first relevant hit in k, its rank, and missing ids. No expected id: recall 1."""
    hits = ranked.where(F.col("rank") <= k).select("query", "id", "rank")
    joined = expected.join(hits, ["query", "id"], "left").groupBy("query").agg(
        F.count("id").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first_rank"),
        F.array_sort(F.collect_list(F.when(F.col("rank").isNull(), F.col("id")))).alias("missing"),
    )
    six = lambda c: F.floor(c * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)
    return joined.select(
        "query", six(F.when(F.col("n") == 0, 1.0).otherwise(F.col("found") / F.greatest("n", F.lit(1)))).alias("recall"),
        six(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"), "first_rank", "missing",
    )
