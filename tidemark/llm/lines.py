"""Removal of repeated multi-line chunks with content-defined borders, by DataFrame functions only.

A line's hash is the first 24 bits of its MD5. A line is a candidate where a rolling hash over the last two
line hashes, modulo 1,000,003, isn't a multiple of four; in a row of candidates the first, third, fifth and so on
end a chunk. So borders depend on nearby lines only and come again after lines before them were put in or
taken out, and but for a document's ends a chunk has two lines or more, two and a third on average: passages
of a few shared lines often hold a whole one, and no line of a long one stands alone. Chunks of two lines or more that occur
again anywhere are removed but for the first occurrence, by document, text and place, after their
bytes were compared with it.

Defined results: a null text is empty; chunks of blank lines only, and of one line, always stay;
rows that repeat a doc_id and text are one document and stay or go alike; a last chunk ends with its
document; a document is split within one row, so memory grows with the longest text alone; other columns are ignored;
an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace

WINDOW, PRIME, PARTS, FACTOR = 2, 1_000_003, 4, 257


def chunked(docs: DataFrame, text: Column, parts: int = PARTS) -> DataFrame:
    """Adds `chunks`: an array of (pos, n, text) in order. Joined by line feeds they are the text.

    Each step's array goes through a one-element explode(): else the optimizer would put its
    expression in place of each use, and lambdas would compute it anew for every line.
    """
    split = docs.select("*", F.explode(F.array(F.split(F.coalesce(text, F.lit("")), "\n", -1))).alias("_lines"))
    hashes = F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("long"))
    hashed = split.select("*", F.explode(F.array(hashes)).alias("_hashes"))

    def rolled(x: Column, i: Column) -> Column:
        back = [F.coalesce(F.get("_hashes", i - k), F.lit(0)) * FACTOR**k for k in range(1, WINDOW)]
        return F.when(sum(back, x) % PRIME % parts == 0, F.lit("0")).otherwise(F.lit("1"))

    flags = F.split(F.replace(F.array_join(F.transform("_hashes", rolled), ""), F.lit("11"), F.lit("10")), "")
    hashed = hashed.select("*", F.explode(F.array(flags)).alias("_flags"))
    ends = F.filter(F.transform("_hashes", lambda x, i: F.when((F.get("_flags", i) == "1") | (i == F.size("_hashes") - 1), i)), lambda i: i.isNotNull())
    cut = hashed.select("*", F.explode(F.array(ends)).alias("_ends"))

    def chunk(e: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get("_ends", k - 1) + 1)
        return F.struct(k.alias("pos"), (e - start + 1).alias("n"), F.array_join(F.slice("_lines", start + 1, e - start + 1), "\n").alias("text"))

    return cut.select(*docs.columns, F.explode(F.array(F.transform("_ends", chunk))).alias("chunks"))


def remove_repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, keep_text: bool = True) -> DataFrame:
    """Per row: id, n_chunks, n_removed (chunks), kept_chars, kept_md5 and, with keep_text, kept_text."""
    ws = Workspace(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    whole = ws.keep(chunked(rows, F.col("_text"), parts).drop("_text"), "chunks")  # read three times
    each = whole.select("_id", "_th", F.explode("chunks").alias("c")).select("_id", "_th", "c.*").where("n > 1").where(F.trim(F.col("text"), F.lit(" \t\r\n")) != "")
    keyed = each.select("_id", "_th", "pos", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    place = F.struct("_id", "_th", "pos")
    repeated = keyed.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h1", "h2", F.col("a").alias("first"))
    # sort-merge joins at every size: small inputs would broadcast these sides, large ones not
    occurring = ws.keep(keyed.join(repeated.hint("merge"), ["h1", "h2"]), "occurring")
    first = occurring.where(place.eqNullSafe(F.col("first"))).groupBy("h1", "h2").agg(F.min("text").alias("first_text"))
    gone = occurring.where(~place.eqNullSafe(F.col("first"))).join(first, ["h1", "h2"]).where("text = first_text")
    gone = ws.keep(gone.groupBy("_id", "_th").agg(F.collect_set("pos").alias("gone")), "gone").withColumnsRenamed({"_id": "_gi", "_th": "_gt"})
    joined = whole.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_gi")) & (F.col("_th") == F.col("_gt")), "left")
    stays = F.filter("chunks", lambda c: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), c["pos"]))
    kept = joined.select("_id", F.size("chunks").alias("n_chunks"), F.coalesce(F.size("gone"), F.lit(0)).alias("n"), F.array_join(F.transform(stays, lambda c: c["text"]), "\n").alias("kept_text"))
    out = kept.select(
        F.col("_id").alias(id_col), F.col("n_chunks").cast("long").alias("n_chunks"), F.greatest("n", F.lit(0)).cast("long").alias("n_removed"),
        F.length("kept_text").cast("long").alias("kept_chars"), F.md5("kept_text").alias("kept_md5"), "kept_text",
    )
    return out if keep_text else out.drop("kept_text")


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_chunks, n_removed, kept_chars, kept_md5."""
    return remove_repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), hashed AS (
  SELECT *, list_sum(list_transform(range(1, 7), lambda k: CAST((strpos('0123456789abcdef', substr(md5(line), k, 1)) - 1) * 16 ** (6 - k) AS BIGINT))) AS h FROM lines
), flagged AS (
  SELECT doc_id, replace(string_agg(CASE WHEN v % 1000003 % 4 = 0 THEN '0' ELSE '1' END, '' ORDER BY i), '11', '10') AS flags
  FROM (SELECT doc_id, i, h + coalesce(lag(h, 1) OVER (PARTITION BY doc_id ORDER BY i), 0) * 257 AS v FROM hashed) GROUP BY doc_id
), ended AS (
  SELECT h.*, CAST(f.flags[h.i] AS INT) AS is_end FROM hashed h JOIN flagged f USING (doc_id)
), numbered AS (
  SELECT *, coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended
), chunks AS (
  SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, pos
), marked AS (
  SELECT *, n > 1 AND trim(body, ' ' || chr(9) || chr(13) || chr(10)) <> ''
    AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, pos) > 1 AS gone FROM chunks
)
SELECT doc_id, count(*) AS n_chunks, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  CAST(length(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS BIGINT) AS kept_chars,
  md5(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""
