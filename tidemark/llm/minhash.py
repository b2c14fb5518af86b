"""Near-duplicate documents by DartMinHash signatures (Christiani 2020) and banded joining.

A document is the weighted set of its five-word runs; the weight of a run is how often it occurs.
Darts are thrown at each element's region - its weight by a rank axis - as a hashed Poisson
process: the darts of a unit of weight are the same in every document that holds the unit. Each
dart falls on one of `size` coordinates, and a coordinate keeps its earliest dart, so two
documents agree on a coordinate with the probability of their weighted Jaccard similarity.

Defined results: a null or wordless text links with nothing and stays; documents of equal runs
are one class; rows of equal doc_id (null or not) and equal text fold into one, rows of one doc_id and
different texts are judged each; null ids come after all others; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .store import Workspace, row_key
from .words import U, mix, shingles, text_parts, words

#: 20 bands of 5 coordinates miss a pair of similarity 0.8 once in 2,800, one of 0.9 never in practice.
SIZE, ROWS, SIMILAR, SHINGLE = 100, 5, 0.8, 5
_OCCURRENCE, _THROW, _PLACE, _NAME = (U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def elements(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit elements of each document - run and number of the occurrence - sorted, and n + 1 offsets."""
    s, offsets = shingles(words(column), shingle)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = mix(s ^ mix(doc.astype(U) + U(1)))  # equal only for the same run in the same document
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    nth = np.arange(len(k)) - begin[np.cumsum(new) - 1] if len(k) else np.zeros(0, np.int64)
    s[order] = np.where(nth > 0, mix(s[order] + nth.astype(U) * _OCCURRENCE), s[order])
    return s, offsets


def signatures(unit: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The names of the earliest dart on each coordinate: a row of `size` numbers for each document."""
    n = len(offsets) - 1
    weight = np.diff(offsets)
    best = np.zeros((n, size), U)
    todo = np.flatnonzero(weight)
    darts = size * (np.log(size) + 4.0)  # thrown at a document; one in fifty leaves a coordinate empty
    while len(todo):
        limit = darts / weight[todo]
        row = np.repeat(np.arange(len(todo)), weight[todo])
        inside = np.arange(len(row)) - np.repeat(np.cumsum(weight[todo]) - weight[todo], weight[todo])
        seed = mix(unit[offsets[todo][row] + inside])
        rank = np.zeros(len(row))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        throw = 0
        while len(row):
            throw += 1
            h = mix(seed + U(throw * int(_THROW) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> U(11)).astype(np.float64) + 1.0) * 2.0**-53)
            ok = rank <= limit[row]
            row, seed, rank, h = row[ok], seed[ok], rank[ok], h[ok]
            place = (mix(h + _PLACE) >> U(32)).astype(np.int64) * size >> 32
            found.append((row * size + place, rank, h))
        at, ranks, name = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-ranks, kind="stable")  # of writes to one place the last, the earliest dart, remains
        got = np.zeros(len(todo) * size, U)
        hit = np.zeros(len(todo) * size, bool)
        got[at[order]] = mix(name[order] + _NAME)
        hit[at] = True
        got, full = got.reshape(-1, size), hit.reshape(-1, size).all(axis=1)
        best[todo[full]] = got[full]
        todo, darts = todo[~full], darts * 4
    return best


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of `rows` coordinates; different bands have different hashes."""
    bands = signature.shape[1] // rows
    out = np.zeros((len(signature), bands), U)
    for j in range(bands):
        h = np.full(len(signature), j + 1, U)
        for k in range(rows):
            h = mix(h * U(3) + signature[:, j * rows + k])
        out[:, j] = h
    return out


def parities(unit: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each document a bitmap of the parity of elements by hash bin: 256, 512 or 1024 bits for under 128, 300 and more elements.

    Two bitmaps of a size differ in at most as many bits as the sets differ in elements.
    """
    count = np.diff(offsets)
    size = np.where(count < 128, 256, np.where(count < 300, 512, 1024))
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(count)), count)
    bits = np.bincount(begin[doc] + (mix(unit + U(3)) % size[doc].astype(U)).astype(np.int64), minlength=int(size.sum())) & 1
    longs = np.packbits(bits.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size // 64)]).astype(np.int32), pa.array(longs))


def _signed(batches: Iterator[pa.RecordBatch], size: int, rows: int, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_parts(batch.column(3), 1 << 20):
            *keys, text = (c.slice(a, b - a) for c in batch.columns)
            unit, offsets = elements(text, shingle)
            sums = []
            for salt in (1, 2):
                p = np.concatenate([[U(0)], np.cumsum(mix(unit + U(salt)), dtype=U)])
                sums.append(pa.array((p[offsets[1:]] - p[offsets[:-1]]).view(np.int64)))
            hashes = band_keys(signatures(unit, offsets, size), rows)
            bands = pa.ListArray.from_arrays(np.arange(len(hashes) + 1, dtype=np.int32) * hashes.shape[1], pa.array(hashes.ravel().view(np.int64)))
            columns = [*keys, pa.array(np.diff(offsets).astype(np.int64)), *sums, bands, parities(unit, offsets)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "r1", "r2", "n", "k1", "k2", "bands", "odd"])


def _listed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_parts(batch.column(1), 1 << 20):
            unit, offsets = elements(batch.column(1).slice(a, b - a), shingle)
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(unit.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "units"])


def _may_be_similar(similar: float) -> F.Column:
    """False only for pairs (n, odd) and (n0, odd0) that can't reach the similarity: by their sizes, or by the bits in which the bitmaps differ."""
    differ = F.aggregate(F.zip_with("odd", "odd0", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = differ * (1 + similar) <= (1 - similar) * (F.col("n") + F.col("n0")) + 1e-6
    return (F.least("n", "n0") >= similar * F.greatest("n", "n0") - 1e-6) & ((F.size("odd") != F.size("odd0")) | near)


def _verified(pairs: DataFrame, units: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) whose exact weighted Jaccard similarity is `similar` or more."""
    a = units.select(F.col("id").alias("a"), F.col("units").alias("ua"))
    b = units.select(F.col("id").alias("b"), F.col("units").alias("ub"))
    both = F.size(F.array_intersect("ua", "ub"))
    return pairs.join(a, "a").join(b, "b").where(both >= similar * (F.size("ua") + F.size("ub") - both)).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, rows: int = ROWS, shingle: int = SHINGLE, similar: float = SIMILAR, keyed: bool = False
) -> DataFrame:
    """One row per document, by id and text: id, class_id (smallest id that links lead to), copy_of (smallest id of equal runs), kept.

    One document of each class is kept, that of the smallest id, and of texts of that id the one of the
    smallest row_key(). With keyed, the columns r1 and r2 of row_key() are returned too.

    Equal documents fold into one first. Within a bucket, members are held against one centre a
    round, so that links grow with the bucket, not with its square. Buckets whose members aren't
    all in one class after the rounds have the members outside their largest class held against
    every member of another class, so no link between classes is missed. Pairs that sizes or parity
    bitmaps prove to be below the similarity never leave the join; the others are compared exactly.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    r1, r2 = row_key(F.col(id_col), F.col(text_col))
    one = docs.select(F.col(id_col).cast("long").alias("id"), r1.alias("r1"), r2.alias("r2"), F.col(text_col).cast("string").alias("text"))
    signed = ws.keep(
        one.mapInArrow(lambda it: _signed(it, size, rows, shingle), "id long, r1 long, r2 long, n long, k1 long, k2 long, bands array<long>, odd array<long>"), "signed"
    )
    place = F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")
    firsts = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(place).alias("m"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    firsts = ws.keep(firsts.withColumn("first", F.monotonically_increasing_id()), "firsts")  # numbers are those of the files from here on
    bands = firsts.select(F.col("first").alias("id"), F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = bands.join(shared, "bucket").join(firsts.select(F.col("first").alias("id"), F.coalesce("m.id", "first").alias("seed"), "n", "odd"), "id")
    members = ws.keep(members.select("bucket", "id", "seed", "n", "odd"), "members")
    wanted = firsts.select(F.col("first").alias("id"), "m.r1", "m.r2").join(members.select("id").distinct(), "id", "left_semi")
    texts = one.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("id", "text")
    units = ws.keep(texts.mapInArrow(lambda it: _listed(it, shingle), "id long, units array<long>"), "units")
    links = _linked(ws, members, units, similar)
    classes = ws.keep(connected_components(ws, links).select(F.col("id").alias("first"), "component"), "classes")
    kept = classes.join(firsts.select("first", "m"), "first").groupBy("component").agg(F.min("m").alias("kept"))
    named = firsts.select("k1", "k2", "n", "first", "m").join(classes.join(kept, "component").select("first", "kept"), "first", "left")
    named = ws.keep(named.select("k1", "k2", "n", "m", F.coalesce("kept", "m").alias("c")), "named")
    each = signed.select("id", "r1", "r2", "n", "k1", "k2").dropDuplicates(["r1", "r2"]).join(named, ["k1", "k2", "n"], "left")
    linked = F.col("m").isNotNull()
    out = each.select(
        F.col("id").alias(id_col), F.when(linked, F.col("c.id")).otherwise(F.col("id")).alias("class_id"), F.when(linked, F.col("m.id")).otherwise(F.col("id")).alias("copy_of"),
        F.when(linked, (F.col("c.r1") == F.col("r1")) & (F.col("c.r2") == F.col("r2"))).otherwise(F.lit(True)).alias("kept"), *(["r1", "r2"] if keyed else []),
    )
    out = ws.keep(out, "out")
    ws.drop(signed, firsts, members, units, classes, named)
    return out


def _linked(ws: Workspace, members: DataFrame, units: DataFrame, similar: float, rounds: int = 3, centres: int = 3) -> DataFrame:
    """Links that connect all that verified pairs of a common bucket connect."""
    links = None
    placed = members.withColumn("c", F.col("id"))
    for k in range(rounds):
        order = F.struct(F.xxhash64("seed", F.pmod("bucket", F.lit(centres)), F.lit(k)).alias("o"), "id", "c", "n", "odd")
        centre = placed.groupBy("bucket").agg(F.min(order).alias("m")).select("bucket", F.col("m.id").alias("b0"), F.col("m.c").alias("bc"), F.col("m.n").alias("n0"), F.col("m.odd").alias("odd0"))
        pairs = placed.join(centre, (placed["bucket"] == centre["bucket"]) & (F.col("c") != F.col("bc")) & _may_be_similar(similar)).select(F.least("id", "b0").alias("a"), F.greatest("id", "b0").alias("b")).distinct()
        new = ws.keep(_verified(pairs, units, similar), "links")
        links = new if links is None else links.unionByName(new)
        placed = _placed(ws, members, links)
    sizes = placed.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("classes")).where("classes > 1").select("bucket", F.col("m.c").alias("most"))
    mixed = ws.keep(placed.join(largest, "bucket"), "mixed")
    rest = mixed.where("c <> most").select(F.col("bucket").alias("b"), F.col("id").alias("x"), F.col("c").alias("xc"), F.col("n").alias("n0"), F.col("odd").alias("odd0"))
    pairs = mixed.join(rest, (F.col("bucket") == F.col("b")) & (F.col("c") != F.col("xc")) & _may_be_similar(similar)).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
    return links.unionByName(ws.keep(_verified(pairs, units, similar), "links"))


def _placed(ws: Workspace, members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the class c that links have put them in so far."""
    classes = connected_components(ws, links).withColumnRenamed("component", "c")
    return ws.keep(members.join(classes, "id", "left").withColumn("c", F.coalesce("c", "id")), "placed")


def op6_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id, copy_of, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
