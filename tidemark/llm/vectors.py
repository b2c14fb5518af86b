"""Near-duplicate vectors by Euclidean p-stable hashing (Datar et al. 2004) and exact cosine checks.

Vectors of one label are normalised, projected on Gaussian directions, shifted and cut into
cells; a table's bucket is the cell of `width` in each of its directions. At cosine 0.98 two unit
vectors are 0.2 apart and share a bucket of one of the 26 tables but once in 2,900 pairs; closer
pairs are missed less often. Every pair of a bucket is held against the threshold in double
precision; none below it links.

Defined results: a vector that is null, zero or holds a null or non-finite component, or whose
label is null, links with nothing; vectors of different lengths don't link; equal vectors link
with each other. A row of the result is a vector by id, label and components: rows that repeat all three
count as one vector, rows of one id, or of none, and different components are vectors of their own, each judged.
The smallest id that is reached names a component; null comes after all ids. kept is true for one vector
of a component: that of the smallest id, of several of that id the first by hashes. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .store import Workspace
from .words import U, mix

TABLES, DIRECTIONS, WIDTH, SIMILAR = 26, 16, 2.0, 0.98
#: Rows of a bucket that a task holds at once; larger buckets are cut into blocks, and pairs of blocks are dealt out.
BLOCK = 256


@lru_cache(8)
def _projection(dims: int, tables: int, directions: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dims, tables, directions])
    return rng.normal(size=(dims, tables * directions)), rng.uniform(0, width, tables * directions)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH) -> np.ndarray:
    """Bucket hashes of unit vectors, one column for each table; tables have different hashes."""
    a, b = _projection(unit.shape[1], tables, directions, width)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).view(U).reshape(len(unit), tables, directions)
    out = np.broadcast_to(mix(np.arange(1, tables + 1, dtype=U) + U(unit.shape[1] << 20)), (len(unit), tables)).copy()
    for k in range(directions):
        out = mix(out * U(3) + cells[:, :, k])
    return out


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors of a list column, by length: their row numbers and a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
    begin = np.cumsum(size) - size
    out = {}
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = values[begin[rows][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        out[int(d)] = rows[ok], x[ok]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge components lose their digits
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, place, vector) to (id, label, place, f1, f2, keys, vector) of the usable rows."""
    for batch in batches:
        for rows, x in matrix(batch.column(3)).values():
            if not len(rows):
                continue
            keys = bucket_keys(_unit(x))
            bits = (x + 0.0).view(U).reshape(x.shape)  # + 0.0: -0.0 equals 0.0
            f = [np.full(len(x), s + 4 * x.shape[1], U) for s in (1, 2)]
            for k in range(x.shape[1]):
                f = [mix(h * U(3) + bits[:, k]) for h in f]
            lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel())) for m in (keys.view(np.int64), x)]
            own = [batch.column(k).take(pa.array(rows)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(h.view(np.int64)) for h in f), *lists], names=["id", "label", "place", "f1", "f2", "keys", "vector"])


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over edges (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(ids: np.ndarray, many: np.ndarray, block: np.ndarray, keys: np.ndarray, x: np.ndarray, table: int, split: bool, similar: float):
    """Links within a block or between two: each vector's number of links and an edge to a root, for vectors with any."""
    u = _unit(x)
    hit = np.triu(u @ u.T >= similar - 1e-9, 1)
    if split:
        hit &= block[:, None] != block[None, :]
    a, b = np.nonzero(hit)
    if table:  # a pair counts in the first table that brings it together
        new = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
        a, b = a[new], b[new]
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    ok = (scaled[a] * scaled[b]).sum(axis=1) / (norm[a] * norm[b]) >= similar
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    links = np.bincount(a, many[b], len(ids)) + np.bincount(b, many[a], len(ids))
    have = np.flatnonzero(links)
    return ids[have], links[have].astype(np.int64), ids[_roots(len(ids), a, b)[have]]


def _linked(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j, label, key); a group is held at once, at most two blocks."""
    held: list[pa.RecordBatch] = []
    out: list[tuple] = []

    def work(t: pa.Table) -> None:
        group = np.stack([np.asarray(t[c]) for c in ("bucket", "i", "j", "key")], axis=1)
        label = t["label"].combine_chunks()
        other = np.asarray(pc.not_equal(label.slice(1), label.slice(0, len(label) - 1)), bool)
        cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1) | other) + 1  # two keys of one bucket number stay apart
        columns = [np.asarray(t[c]) for c in ("id", "many", "block")]
        keys = np.asarray(t["keys"].combine_chunks().flatten()).reshape(len(t), -1)
        vectors = t["vector"].combine_chunks()
        size = np.asarray(pc.list_value_length(vectors))
        values, begin = np.asarray(vectors.flatten()), np.cumsum(size) - size
        table = np.asarray(t["t"])
        for a, b in zip([0, *cut], [*cut, len(t)], strict=True):
            if b - a < 2:
                continue
            x = values[begin[a] : begin[b - 1] + size[b - 1]].reshape(b - a, -1)
            found = _block_links(columns[0][a:b], columns[1][a:b], columns[2][a:b], keys[a:b], x, int(table[a]), group[a, 1] != group[a, 2], similar)
            if found:
                out.append(found)

    def flush() -> pa.RecordBatch:
        made = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, names=["id", "links", "root"])

    for batch in batches:
        t = pa.Table.from_batches([*held, batch])
        last = [t[c][len(t) - 1].as_py() for c in ("bucket", "i", "j")]
        same = pc.and_(pc.and_(pc.equal(t["bucket"], last[0]), pc.equal(t["i"], last[1])), pc.equal(t["j"], last[2]))
        rest = int(pc.sum(pc.cast(same, pa.int64())).as_py())  # sorted: the last group is the tail
        if rest < len(t):
            work(t.slice(0, len(t) - rest))
        held = t.slice(len(t) - rest).to_batches()
        if out:
            yield flush()
    if held:
        work(pa.Table.from_batches(held))
        if out:
            yield flush()


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similar: float = SIMILAR) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Equal vectors fold into one with a multiplicity. A bucket larger than BLOCK is cut into blocks
    whose pairs are dealt out, so no task holds a bucket; a task returns a count and one edge for
    each of its vectors, never the pairs.
    """
    ws = Workspace(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    # a vector's number among the rows, its place, is that of the files from here on
    rows = ws.keep(rows.groupBy("id", "label", "vector").agg(F.lit(0).alias("_")).drop("_").withColumn("place", F.monotonically_increasing_id()), "rows")
    hashed = ws.keep(
        rows.where("label is not null").select("id", "label", "place", "vector").mapInArrow(_hashed, "id long, label string, place long, f1 long, f2 long, keys array<long>, vector array<double>"), "hashed"
    )
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("lead")
    firsts = hashed.groupBy("label", "f1", "f2").agg(lead, F.count("*").alias("many"), F.first("keys").alias("keys"), F.first("vector").alias("vector"))
    firsts = ws.keep(firsts.withColumn("node", F.monotonically_increasing_id()), "firsts")
    spots = firsts.select(F.col("node").alias("id"), "label", F.posexplode("keys").alias("t", "key")).select("id", "label", "t", "key", F.xxhash64("label", "key").alias("bucket"))
    same = ["bucket", "label", "key"]
    sizes = spots.groupBy(*same).agg(F.count("*").alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    members = spots.join(sizes, same).select(*same, "t", "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "bucket"), blocks).cast("int").alias("block"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*same, "t", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.join(firsts.select(F.col("node").alias("id"), "many", "keys", "vector"), "id")
    order = ["bucket", "i", "j", "label", "key"]
    parts = dealt.repartition("bucket", "i", "j").sortWithinPartitions(*order).select("bucket", "i", "j", "t", "id", "many", "block", "keys", "vector", "label", "key")
    links = ws.keep(parts.mapInArrow(lambda it: _linked(it, similar), "id long, links long, root long"), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    classes = connected_components(ws, links.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("c"))
    of = firsts.select("label", "f1", "f2", "node", "many", "lead").join(counts, "node", "left").join(classes, "node", "left").withColumn("c", F.coalesce("c", "node"))
    of = ws.keep(of.select("label", "f1", "f2", "lead", "c", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n")), "of")
    heads = of.groupBy("c").agg(F.min("lead").alias("head"))
    named = hashed.select("place", "label", "f1", "f2").join(of.join(heads, "c"), ["label", "f1", "f2"]).select(F.col("place").alias("p"), "n", "head")
    out = rows.select("id", "place").join(named, F.col("place") == F.col("p"), "left")
    linked = F.col("head").isNotNull()
    out = out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("head.id")).otherwise(F.col("id")).alias("component_id"), F.when(linked, F.col("head.place") == F.col("place")).otherwise(F.lit(True)).alias("kept"),
    )
    out = ws.keep(out, "out")
    ws.drop(rows, hashed, firsts, links, of)
    return out


def op7_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: vec_id, n_links, component_id, kept."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
