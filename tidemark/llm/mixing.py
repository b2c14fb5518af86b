"""Mixing sources to target weights, by DataFrame functions only.

Documents get hash-random keys. Within a source they are cut into key ranges of about `range_rows`
rows; sums of the ranges, then running sums within each, are the source's prefix sums. So no task
holds a source, however large. Each source is taken whole as often as its budget allows and then
up to the exact word that its budget ends at.

Defined results: a null text has size 0; null is a source of its own, last in order; a key is a hash of id and text, a null
one counts as empty; repeated rows count each for itself; a source of size 0 has target 0;
an empty table gives no row; other columns, whatever their names, are kept; white space of a document that is
cut short stays as it is.

Ranges of a source are summed in groups of GROUP ranges, so that a window over a source has one row for about 500,000
documents, and one within a group 1,024 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace

WEIGHTS, SHARE, EPOCHS, RANGE_ROWS, GROUP_BITS = (3, 1, 2), 1.5, 2, 512, 10
RUN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(RUN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds `target` to (source, source_size, ...): share of all sizes by weight, at most epochs times a source's size.

    The excess of capped sources goes to the others by weight until none is above; that ends
    at the level l with sum(min(cap, l * weight)) = total. Ordered by cap / weight, the capped
    sources come first, so running sums give the level that those before a row leave to it and the
    rest; l is the largest that doesn't cap its own row. One row a source is sorted.
    """
    everything, by_ratio = Window.partitionBy(), Window.orderBy("ratio", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    caps = ranked.withColumn("cap", epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight").cast("double"))
    total = F.sum("source_size").over(everything).cast("double") * F.lit(float(share))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / rest.cast("double")
    leveled = caps.withColumn("own", level)
    leveled = leveled.withColumn("level", F.max(F.when(F.col("own") <= F.col("ratio"), F.col("own"))).over(everything))
    capped = F.col("cap").cast("double")
    target = F.when(F.col("level").isNull(), capped).otherwise(F.least(capped, F.col("level") * F.col("weight").cast("double")))
    return leveled.withColumn("target", target).drop("nth", "weight", "cap", "ratio", "own", "level")


def _key(doc_id: Column, text: Column) -> Column:
    """A hash of id and text: rows without id, or of one id, are spread too."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many of its words the mix takes of each document, repeats counted."""
    return _shares(docs, id_col, text_col, source_col, weights, share, epochs, range_rows).drop("_key")


def _shares(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """mix_sources() with each row's key."""
    ws = Workspace(docs.sparkSession, "mixing")
    key = _key(F.col(id_col), F.col(text_col))
    sized = ws.keep(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), key.alias("_key")), "sized")
    sources = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    goal = ws.keep(targets(sources.withColumnRenamed("_source", "source"), weights, share, epochs), "targets")
    spread = goal.select(F.col("source").alias("_s"), F.ceil(F.col("rows") / range_rows).alias("ranges"))
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    ranged = sized.join(spread, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_range", F.shiftright(place * F.col("ranges"), 32)).drop("_s", "ranges")
    sums = ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("words"))
    sums = sums.join(goal.drop("rows"), F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    sums = ws.keep(sums.withColumn("_group", F.shiftright("_range", GROUP_BITS)), "sums")
    before = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("_source", "_group").agg(F.sum("words").alias("words")).select(F.col("_source").alias("_gs"), F.col("_group").alias("_g"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_source", "_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("words").over(within), F.lit(0))).join(groups, F.col("_source").eqNullSafe(F.col("_gs")) & (F.col("_group") == F.col("_g")))
    sums = ws.keep(sums.withColumn("_before", F.col("_first") + F.col("_before")), "ranges")
    sums = sums.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), "source_size", "target", "_before")
    running = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_to", F.sum("_size").over(running)).join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - times * F.col("source_size") - (F.col("_before") + F.col("_to") - F.col("_size"))
    taken = times * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), left))
    return placed.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), "_key")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    pieces = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1)
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.lit(0).alias("stop"))

    def step(a: Column, piece: Column) -> Column:
        seen, at = a["seen"] + F.when(piece == "", 0).otherwise(1), a["at"] + F.length(piece)
        return F.struct(seen.alias("seen"), (at + 1).alias("at"), F.when(a["seen"] < n, at).otherwise(a["stop"]).alias("stop"))

    return F.substring(text, F.lit(1), F.aggregate(pieces, start, step)["stop"])


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: documents as often as they are taken, the one at each source's cut shortened to its first words.

    A row's share is looked up by its id, size, source and hash; rows that have these in common are alike, and shares go to them in any order.
    """
    source_col = options.get("source_col", "source")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text"), word_count(F.col(text_col)).alias("size"))
    shares = _shares(rows, "id", "text", "source", **{k: v for k, v in options.items() if k != "source_col"}).where("taken > 0")
    nth = Window.partitionBy("h", "i", "s", "n").orderBy("t")
    shares = shares.select(F.col("_key").alias("h"), F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n"), F.col("taken").alias("t")).withColumn("k", F.row_number().over(nth))
    rows = rows.where("size > 0").withColumn("key", _key(F.col("id"), F.col("text")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "id", "source", "size").orderBy("size")))
    on = (F.col("key") == F.col("h")) & F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n")) & (F.col("nth") == F.col("k"))
    each = rows.join(shares, on).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("t") / F.col("size")).cast("int"))))
    each = each.withColumn("words", F.least(F.col("size"), F.col("t") - (F.col("epoch") - 1) * F.col("size")).cast("int"))
    cut = F.col("words") < F.col("size")
    text = F.when(cut, first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    changed = {text_col: text}
    if "n_chars" in docs.columns and "n_chars" not in (id_col, text_col, source_col):
        changed["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return each.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM sources
), ordered AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM ranked
), leveled AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS own
  FROM ordered WINDOW w AS (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, CASE WHEN l IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), l * CAST(weight AS DOUBLE)) END AS target
  FROM (SELECT *, max(own) FILTER (own <= ratio) OVER () AS l FROM leveled)
), placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - before)) ELSE 0 END AS taken
FROM placed
"""
