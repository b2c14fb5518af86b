"""Fixity audit of WARC replicas by Merkle trees over records and ordered offset ranges.

A replica is a folder of WARC files, one for each shard, whose records are gzip members; records are read back from the files, with
their offsets in the uncompressed stream.
Leaves are SHA-256 digests of offset and record. Above them, nodes cover ranges of offsets within a shard,
64 KB first and 16 times more at each level, then ranges of shards, until one root is left; a node's
digest is that of its children's digests in order. Two replicas with one root are equal. Otherwise
only children of mismatching nodes are compared, level by level, down to the ranges of 64 KB that differ. A lost or
resized record moves those behind it in its shard, so records of differing ranges are then aligned by their
WARC-Record-ID: equal bytes are `ok` wherever they stand, other bytes `corrupt`, and what one side lacks is
`missing` or `extra`.

Everything is grouped by ranges that hold a bounded number of children: records of 64 KB, or 16 nodes. The number
of shards is fixed when the first replica is laid out (SHARDS, or more so that a shard has SHARD_BYTES on average) and
kept in its tree's header, so that a loss doesn't deal records anew. Records go to shards by id and bytes, so that
records of one id, or of none, spread; only records equal in both share a shard.

Defined results: null url or html are empty; a null page_id comes first in its shard; records of equal
ids stand in the order of their digests, and of those one side has more of, the last ones are missing or extra; two
empty replicas are equal; records of any bytes, and files whose records are gzip members, can be read; a file that is cut
short or holds other bytes between records is an error; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace
from .warcfile import member, open_folder, scan, write_file
from .words import text_parts

SHARDS, SHARD_BYTES, RANGE_BITS, STEP_BITS = 64, 256 << 20, 16, 4
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A WARC/1.0 resource record with its body and closing empty lines."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:md5:"),
        F.md5(F.coalesce(page_id.cast("string"), F.lit(""))), F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


class Header(NamedTuple):
    """What the trees of two replicas must have in common: shards, levels within a shard, levels above."""

    shards: int
    within: int
    above: int


class Tree(NamedTuple):
    header: Header
    leaves: DataFrame  # shard, at (offset), n_bytes, rid (record id), digest
    levels: list[DataFrame]  # from 64 KB ranges to the root: shard, at (numbers of ranges), digest


def laid_out(records: DataFrame, id_col: str = "page_id", shards: int = SHARDS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """(id, record) with its digest and shard, and the number of shards."""
    total = records.agg(F.sum(F.octet_length("record").cast("long"))).head()[0] or 0
    n = max(shards, -(-total // shard_bytes))
    digest = F.sha2("record", 256)
    name = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest))
    shard = F.pmod(F.conv(F.substring(name, 1, 8), 16, 10).cast("long"), F.lit(n))
    return records.select(F.col(id_col).alias("_id"), F.col("record").cast("binary").alias("record"), digest.alias("digest"), shard.alias("shard")), n


def write_replicas(ws: Workspace, rows: DataFrame, shards: int = SHARDS, damage: Column | None = None) -> list[DataFrame]:
    """WARC files of a replica for `record` and, if given, of one for `damage` (null: lost); rows are (shard, _id, digest, record).

    Records become gzip members before they are dealt to shards, so that these are shuffled, and a record that both replicas have only once.
    Each task sorts its shards and streams every shard into one file a replica. File names are new for each attempt, and
    only files of successful attempts are in the manifests (shard, path).
    """
    folder = ws.path("warc")
    open_folder(folder, create=True)
    two = damage is not None
    both = rows.select("shard", "_id", "digest", "record", (damage if two else F.lit(None)).cast("binary").alias("second"))
    same = F.col("second").eqNullSafe(F.col("record"))
    both = both.select("shard", "_id", "digest", "record", F.when(~same, F.col("second")).alias("second"), same.alias("same"))
    members = both.mapInArrow(_packed, both.schema)
    sort = members.repartition(shards, "shard").sortWithinPartitions("shard", F.col("_id").asc_nulls_first(), "digest").select("shard", "record", "second", "same")
    made = ws.keep(sort.mapInArrow(lambda it: _written(it, folder, two), "replica int, shard long, path string"), "manifest")
    return [made.where(f"replica = {k}").select("shard", "path") for k in range(1 + two)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their records as gzip members, a few MB at a time."""
    for batch in batches:
        for a, b in text_parts(batch.column(3)):
            part = batch.slice(a, b - a)
            packed = [pa.array([None if r is None else member(r) for r in part.column(k).to_pylist()], pa.binary()) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed, part.column(5)], names=part.schema.names)


def _written(batches: Iterator[pa.RecordBatch], folder: str, second: bool) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    shard, files = None, []

    def end() -> None:
        for f in files:
            f.close()

    for batch in batches:
        for s, first, other, same in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if s != shard:
                end()
                shard, files = s, []
                for k in range(1 + second):
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    files.append(write_file(path))
                    out.append((k, s, path))
            for f, r in zip(files, (first, first if same else other), strict=False):
                if r is not None:
                    f.write(r)
    end()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["replica", "shard", "path"])


def _scanned(batches: Iterator[pa.RecordBatch], with_record: bool) -> Iterator[pa.RecordBatch]:
    """Files to their records, a few MB at a time; a file is read as a stream."""
    names = ["shard", "at", "n_bytes", "rid", "digest", "record"][: 5 + with_record]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    for batch in batches:
        for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, size = [], 0
            for at, rid, digest, raw in scan(path):
                rows.append((shard, at, len(raw), rid, digest, raw)[: len(names)])
                size += 200 + with_record * len(raw)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)


def read_records(manifest: DataFrame, with_record: bool = True) -> DataFrame:
    """(shard, path) to shard, at (offset), n_bytes, rid, digest and, if asked for, record (bytes), from the files."""
    schema = "shard long, at long, n_bytes long, rid string, digest string" + ", record binary" * with_record
    spread = manifest.repartition(max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism)), "shard")
    return spread.mapInArrow(lambda it: _scanned(it, with_record), schema)


def tree(ws: Workspace, leaves: DataFrame, shards: int = SHARDS, like: Header | None = None) -> Tree:
    """The tree of located leaves; like: the header of the replica that it will be compared with, whichever records were lost."""
    level = leaves.select("shard", "at", F.sha2(F.concat_ws(":", "at", "digest"), 256).alias("digest"))
    if like is None:
        at = leaves.agg(F.max("at")).head()[0] or 0
        like = Header(shards, 1 + -(-(at >> RANGE_BITS).bit_length() // STEP_BITS), -(-(shards - 1).bit_length() // STEP_BITS))
    levels: list[DataFrame] = []

    def up(level: DataFrame, shard: Column, at: Column) -> DataFrame:
        children = F.array_sort(F.collect_list(F.struct("shard", "at", "digest")))
        grouped = level.groupBy(shard.alias("s"), at.alias("a")).agg(F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"))
        return ws.keep(grouped.select(F.col("s").alias("shard"), F.col("a").alias("at"), "digest"), "level")

    for k in range(like.within):
        level = up(level, F.col("shard"), F.shiftright("at", STEP_BITS if k else RANGE_BITS))
        levels.append(level)
    for _ in range(like.above):
        level = up(level, F.shiftright("shard", STEP_BITS), F.col("at"))
        levels.append(level)
    return Tree(like, leaves, levels)


def replica(ws: Workspace, manifest: DataFrame, shards: int = SHARDS, like: Header | None = None) -> Tree:
    """The leaves and the tree of a replica, from its files."""
    return tree(ws, ws.keep(read_records(manifest, with_record=False), "leaves"), shards, like)


def audit(ws: Workspace, a: Tree, b: Tree) -> tuple[DataFrame, list[int]]:
    """Differing records (shard, at, rid, status as seen from a; `at` is b's for extra ones) and the numbers of mismatching nodes by level, root first."""
    if a.header != b.header:
        raise ValueError("the second replica's tree must be made like the first one's")
    bad, counts = None, []
    for k in range(len(a.levels) - 1, -1, -1):
        left, right = (t.levels[k] if bad is None else _below(t.levels[k], bad, k, a.header) for t in (a, b))
        right = right.select(F.col("shard").alias("s"), F.col("at").alias("o"), F.col("digest").alias("d"))
        both = left.join(right, (F.col("shard") == F.col("s")) & (F.col("at") == F.col("o")), "full").where(~F.col("digest").eqNullSafe(F.col("d")))
        bad = ws.keep(both.select(F.coalesce("shard", "s").alias("shard"), F.coalesce("at", "o").alias("at")), "bad")
        counts.append(bad.count())
        if not counts[-1]:
            break
    return ws.keep(_aligned(ws, *(_below(t.leaves, bad, -1, a.header) for t in (a, b))), "differing"), counts


def _below(level: DataFrame, bad: DataFrame, k: int, header: Header) -> DataFrame:
    """Nodes of level k, or leaves (-1), whose parents are in bad."""
    parent = bad.select(F.col("shard").alias("ps"), F.col("at").alias("pa"))
    if k + 1 < header.within:
        at, shard = F.shiftright("at", RANGE_BITS if k < 0 else STEP_BITS), F.col("shard")
    else:
        at, shard = F.col("at"), F.shiftright("shard", STEP_BITS)
    return level.join(parent, (shard == F.col("ps")) & (at == F.col("pa")), "left_semi")


def _aligned(ws: Workspace, a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of differing ranges, by shard and record id: equal ones drop out, the others are paired in the order of their digests."""

    def side(x: DataFrame, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("shard", "rid", "digest").orderBy("at"))
        return x.select("shard", "rid", "digest", F.col("at").alias(name), nth.alias("k"))

    both = ws.keep(side(a, "at_a").join(side(b, "at_b"), ["shard", "rid", "digest", "k"], "full").where("at_a is null or at_b is null"), "unequal")
    nth = F.row_number().over(Window.partitionBy("shard", "rid").orderBy("digest", "k"))
    left, right = (both.where(f"{x} is not null").select("shard", "rid", x, nth.alias("j")) for x in ("at_a", "at_b"))
    status = F.when(F.col("at_b").isNull(), "missing").when(F.col("at_a").isNull(), "extra").otherwise("corrupt")
    return left.join(right, ["shard", "rid", "j"], "full").select("shard", F.coalesce("at_a", "at_b").alias("at"), "rid", status.alias("status"))


def damage(record: Column, page_id: Column) -> Column:
    """The drill's second replica: of ids with remainder 5 by 997 the first body byte differs; those with remainder 7 by 1499 are lost (null)."""
    hit = F.overlay(record, F.lit("#"), (F.instr(record, "\r\n\r\n") + 4).cast("int"), F.lit(1))
    return F.when(F.coalesce(page_id % 1499 == 7, F.lit(False)), F.lit(None)).when(F.coalesce(page_id % 997 == 5, F.lit(False)), hit).otherwise(record)


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as two replicas of WARC files, the second with drilled damage, read back and audited.

    page_id, shard, record_offset, n_bytes, sha256 and status: ok, corrupt or missing (in the second).
    """
    ws = Workspace(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows, shards = laid_out(pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")))
    text = F.col("record").cast("string")
    files = write_replicas(ws, rows, shards, damage(text, F.col("_id")))
    first = replica(ws, files[0], shards)
    found, _ = audit(ws, first, replica(ws, files[1], shards, first.header))
    found = found.where("status <> 'extra'").select(F.col("shard").alias("_s"), F.col("at").alias("_a"), "status")
    out = first.leaves.join(found, (F.col("shard") == F.col("_s")) & (F.col("at") == F.col("_a")), "left")
    ids = rows.select("_id", F.concat(F.lit("<urn:md5:"), F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))), F.lit(">")).alias("_rid")).distinct()
    out = out.join(ids, F.col("rid") == F.col("_rid"))
    return out.select(F.col("_id").alias("page_id"), "shard", F.col("at").alias("record_offset"), "n_bytes", F.col("digest").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


OP2_SQL = r"""
WITH records AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:' || md5(coalesce(CAST(page_id AS VARCHAR), '')) || '>' || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS body
  FROM pages
), hashed AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS n_bytes, sha256(body) AS sha256, md5(concat(CAST(page_id AS VARCHAR), sha256(body))) AS name FROM records
), placed AS (
  SELECT page_id, n_bytes, sha256,
    CAST(list_sum(list_transform(range(1, 9), lambda k: CAST((strpos('0123456789abcdef', substr(name, k, 1)) - 1) * 16 ** (8 - k) AS BIGINT)))
      % greatest(64, CAST((sum(n_bytes) OVER () + 268435455) // 268435456 AS BIGINT)) AS BIGINT) AS shard
  FROM hashed
)
SELECT page_id, shard, CAST(coalesce(sum(n_bytes) OVER (PARTITION BY shard ORDER BY page_id NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
  n_bytes, sha256, CASE WHEN page_id % 1499 = 7 THEN 'missing' WHEN page_id % 997 = 5 THEN 'corrupt' ELSE 'ok' END AS status
FROM placed
"""
