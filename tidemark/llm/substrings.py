"""Exact removal of repeated byte strings of a length, by longest-previous-factor arrays over suffix order.

Every window of `length` bytes goes to the bucket of the smallest hash among its 32-byte strings, so
equal windows, wherever they are, meet in one bucket. Only texts' stretches whose bucket has another
stretch (or holds its 32-byte string twice) are looked at further; equal stretches fold into one.
A task sorts its buckets' suffixes by their first `length` bytes with tripled ranks; previous and next
smaller positions in suffix order then give each window's longest earlier factor, cut off at `length`,
and previous and next greater ones the later factor.

A bucket whose different stretches have more than BUCKET_BYTES is cut before it is sorted: its windows
have the 32-byte string at one of 369 places. Those with it in the later half of these places share the
bytes before it up to there, the others the bytes behind it; these bytes name two new kinds of buckets,
which are cut again while they are too large. At one place the whole window is the name, so
it ends after nine cuts. Every window, of small and of large buckets, is judged in suffix order.

Defined results: documents are rows; a null text is empty; a text shorter than `length` stays whole; rows that repeat
a document count as copies of it; where the first copy stays, null ids come first and rows of equal id and text stay alike; texts over PIECE bytes are hashed in
overlapping pieces, so working memory is bounded by a few pieces and one text; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passages import SIZE, shared_words
from .store import Workspace
from .words import U, prefix, raw, runs_of, span_hash, text_parts, window_minimum

LENGTH, GRAM, BUCKET_BYTES, BATCH, PIECE = 400, 32, 7 << 18, 1 << 18, 2 << 20


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of window starts with one smallest hash: document, hash, first start, starts, whether the run's bytes hold the string twice."""
    if len(data) < length:
        return (np.zeros(0, np.int64), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool))
    at = np.arange(len(data) - gram + 1)
    h = span_hash(prefix(data), at, at + gram)
    low = window_minimum(h, length - gram + 1)  # of windows across documents too; those are dropped
    doc, key, begin, n = runs_of(low, offsets, length)
    return doc, key, begin - offsets[:-1][doc], n, _twice(h, key, begin, n, length, gram)


def _twice(h: np.ndarray, key: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Whether a stretch's bytes hold its smallest string at two places."""
    span = n + length - gram
    out = np.zeros(len(key), bool)
    for a in range(0, len(key), 4000):
        w = span[a : a + 4000]
        first = np.cumsum(w) - w
        hit = h[np.repeat(begin[a : a + 4000] - first, w) + np.arange(w.sum())] == np.repeat(key[a : a + 4000], w)
        out[a : a + 4000] = np.add.reduceat(hit.astype(np.int64), first) > 1
    return out


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_parts(batch.column(2), PIECE):
            data, offsets = raw(batch.column(2).slice(a, b - a))
            whole = b - a > 1 or len(data) <= 2 * PIECE
            for start in [0] if whole else range(0, max(1, len(data) - length + 1), PIECE):  # pieces have all starts once
                piece, edges = (data, offsets) if whole else (data[start : start + PIECE + length - 1], np.array([0, min(PIECE + length - 1, len(data) - start)]))
                doc, key, lo, n, again = stretches(piece, edges, length)
                t = [batch.column(k).slice(a, b - a).take(pa.array(doc)) for k in (0, 1)]
                columns = [*t, pa.array(key.view(np.int64)), pa.array((lo + start).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "key", "lo", "n", "again"])


_STRETCH = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("first", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("h", pa.binary()), ("part", pa.binary())])


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(t1, t2, first, text, wanted) to stretches with their bytes."""
    for batch in batches:
        for a, b in text_parts(batch.column(3), PIECE):
            rows: list[tuple] = []
            size = 0
            for t1, t2, first, text, wanted in zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in range(5)), strict=True):
                data = (text or "").encode()
                for w in wanted:
                    part = data[w["lo"] : w["lo"] + w["n"] + length - 1]
                    rows.append((t1, t2, first, w["key"], w["lo"], _digest(part), part))
                    size += len(part)
                    if size > 4 * PIECE:
                        yield _batch(rows, _STRETCH)
                        size = 0
            if rows:
                yield _batch(rows, _STRETCH)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    rows.clear()
    return out


_SPARK_SUB = "key long, h binary, pkey long, ph binary, off int, n int, first long, lo int, many long, gram long, d0 int, d1 int, part binary"
_SUB = pa.schema([("key", pa.int64()), ("h", pa.binary()), ("pkey", pa.int64()), ("ph", pa.binary()), ("off", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("lo", pa.int32()), ("many", pa.int64()), ("gram", pa.int64()), ("d0", pa.int32()), ("d1", pa.int32()), ("part", pa.binary())])


def halves(part: bytes, key: int, gram: int, d0: int, d1: int, length: int, size: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """Windows of a stretch, whose smallest string is d0 to d1 - 1 bytes after their start, as runs of half that range: new key, first window, windows, d0, d1.

    A run's windows have the same occurrence of the string as their first one, and the same bytes before it
    (or behind it) that all windows of their half hold; those bytes name the new bucket.
    """
    data = np.frombuffer(part, np.uint8)
    at = np.arange(len(data) - size + 1)
    found = np.flatnonzero(span_hash(prefix(data), at, at + size) == U(gram & 0xFFFFFFFFFFFFFFFF))
    starts = np.arange(len(data) - length + 1)
    g = found[np.searchsorted(found, starts)]
    middle = (d0 + d1) // 2
    late = g - starts >= middle
    begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (late[1:] != late[:-1])]))
    for k in range(len(begin)):  # as many runs as windows where the string follows itself; none is kept
        a, b = int(begin[k]), int(begin[k + 1]) if k + 1 < len(begin) else len(starts)
        p, side = int(g[a]), bool(late[a])
        shared = part[p - middle : p - d0] if side else part[p + length - d1 + 1 : p + length - middle + 1]
        name = hashlib.blake2b(shared, digest_size=8, key=key.to_bytes(8, "little", signed=True), person=b"late" if side else b"early").digest()
        yield int.from_bytes(name, "little", signed=True), a, b - a, *((middle, d1) if side else (d0, middle))


def _halved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Stretches (key, h, first, lo, many, gram, d0, d1, part) of large buckets to stretches of smaller ones; a batch has the bytes of equal ones once."""
    for batch in batches:
        rows: list[tuple] = []
        seen: set[tuple] = set()
        size = 0
        for key, h, first, lo, many, gram, d0, d1, part in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
            for sub, a, n, e0, e1 in halves(part, key, gram, d0, d1, length):
                own = part[a : a + n + length - 1]
                name = (sub, _digest(own))
                rows.append((*name, key, h, a, n, first, lo + a, many, gram, e0, e1, None if name in seen else own))
                seen.add(name)
                size += 500 + (len(own) if rows[-1][-1] else 0)
                if size > 4 * PIECE:
                    yield _batch(rows, _SUB)
                    seen.clear()
                    size = 0
        if rows:
            yield _batch(rows, _SUB)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of `length` bytes at starts in byte order; equal strings have equal ranks.

    Ranks of 8 bytes, then of three times as many from three ranks in one number, while that is not over
    length; at last two overlapping ranks. data has 2^21 bytes at most, and length bytes after each start.
    """
    assert len(data) <= 1 << 21
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    word = np.zeros(len(data), U)
    for k in range(8):
        word = (word << U(8)) | padded[k : k + len(data)].astype(U)
    have, rank = 8, _ranked(word)
    while have * 3 <= length:
        far = np.concatenate([rank, np.zeros(2 * have, np.int64)])
        m = len(data)
        rank = _ranked((far[:m].astype(U) << U(42)) | (far[have : have + m].astype(U) << U(21)) | far[2 * have : 2 * have + m].astype(U))
        have *= 3
    if have < length:
        rest = length - have
        if rest <= have:
            return _ranked((rank[starts].astype(U) << U(32)) | rank[starts + rest].astype(U))
        return _ranked((rank[starts].astype(U) << U(42)) | (rank[starts + have].astype(U) << U(21)) | rank[starts + rest].astype(U))
    return rank[starts]


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) if len(k) else 0
    return rank


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place of a smaller value, or -1. All places jump together until none can."""
    to = np.arange(-1, len(x) - 1)
    move = np.flatnonzero((to >= 0) & (x[to] > x))
    while len(move):
        to[move] = to[to[move]]
        move = move[(to[move] >= 0) & (x[to[move]] > x[move])]
    return to


def factors(position: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous, and the longest next, factor of each suffix reaches the ranked length.

    In suffix order, the longest earlier match of a suffix is with its previous or next suffix of a
    smaller position (Crochemore and Ilie 2008); equal ranks are matches of the full length.
    """
    order = np.lexsort((position, rank))
    p, r = position[order], rank[order]
    out = []
    for sign in (1, -1):
        before, after = previous_smaller(sign * p), len(p) - 1 - previous_smaller((sign * p)[::-1])[::-1]
        hit = ((before >= 0) & (r[np.maximum(before, 0)] == r)) | ((after < len(p)) & (r[np.minimum(after, len(p) - 1)] == r))
        flag = np.zeros(len(p), bool)
        flag[order] = hit
        out.append(flag)
    return out[0], out[1]


def _ranges(flag: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of flagged starts of each stretch, as a list of from, to, from, to, ..."""
    begin = np.cumsum(n) - n
    part = np.repeat(np.arange(len(n)), n)
    edge = np.flatnonzero(flag & np.concatenate([[True], ~flag[:-1] | (part[1:] != part[:-1])])) if len(flag) else np.zeros(0, np.int64)
    stop = np.flatnonzero(flag & np.concatenate([~flag[1:] | (part[1:] != part[:-1]), [True]])) + 1 if len(flag) else np.zeros(0, np.int64)
    own = part[edge]
    both = np.stack([edge - begin[own], stop - begin[own]], axis=1).ravel().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(own, np.arange(len(n) + 1)), pa.int32()), pa.array(both))


def _ordered(batches: Iterator[pa.RecordBatch], length: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by key, first document and place, of at most BUCKET_BYTES a key, to the runs of their repeated starts."""
    held: list[tuple] = []
    size = 0

    def work() -> pa.RecordBatch:
        parts = [x[4] for x in held]
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = np.array([len(x) - length + 1 for x in parts])
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        earlier, later = factors(starts, suffix_ranks(data, starts, length))
        many = np.repeat(np.array([x[3] > 1 for x in held]), n)
        flag = earlier if first_stays else earlier | later | many
        out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary()), _ranges(flag, n)], names=["key", "h", "ranges"])
        held.clear()
        return out

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if size > BATCH and row[0] != held[-1][0]:
                yield work()
                size = 0
            held.append(row)
            size += len(row[4])
    if held:
        yield work()


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, text, whole, ranges, n_shared) to the removed spans and the bytes that are left; n_shared stays."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        for a, b in text_parts(batch.column(1), PIECE):
            rows = []
            for text, whole, ranges in zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in (1, 2, 3)), strict=True):
                data, spans = (text or "").encode(), []
                for x, y in [(0, len(data))] if whole else sorted((x, y + length - 1) for x, y in ranges or ()):
                    if spans and x <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], y)
                    else:
                        spans.append([x, y])
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), [{"start": x, "stop": y} for x, y in spans], kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), span, pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, batch.column(4).slice(a, b - a)], names=["_id", "n_bytes", "spans", "kept", "n_shared"])


def _judged(ws: Workspace, one: DataFrame, length: int, first_stays: bool, bucket_bytes: int) -> DataFrame:
    """(key, h, ranges) of different stretches with repeated starts: small buckets in suffix order, large ones after cuts.

    one: key, h, first, lo, many, part, gram, d0, d1, a row for each different stretch.
    """
    order = lambda rows: rows.select("key", "h", "first", "many", "part", "lo").repartition("key").sortWithinPartitions("key", "first", "lo")
    schema = "key long, h binary, ranges array<int>"
    flagged, maps = [], []
    while True:
        large = one.groupBy("key").agg(F.sum(F.octet_length("part").cast("long")).alias("size")).where(F.col("size") > bucket_bytes).select("key")
        large = ws.keep(large, "large") if len(maps) < 9 else large.where("false")
        last = large.isEmpty()
        few = one if last else one.join(large, "key", "left_anti")
        flagged.append(ws.keep(order(few).mapInArrow(lambda it: _ordered(it, length, first_stays), schema).where("size(ranges) > 0"), "flagged"))
        if last:
            break
        many = one.join(large, "key").select("key", "h", "first", "lo", "many", "gram", "d0", "d1", "part")
        subs = ws.keep(many.mapInArrow(lambda it: _halved(it, length), _SPARK_SUB), "halves")
        one = subs.groupBy("key", "h").agg(F.sum("many").alias("many"), F.min(F.struct("first", "lo")).alias("place"), *(F.first(c, ignorenulls=True).alias(c) for c in ("part", "gram", "d0", "d1")))
        one = ws.keep(one.select("key", "h", "place.first", "place.lo", "many", "part", "gram", "d0", "d1"), "one")
        maps.append((subs.drop("part", "many", "gram", "d0", "d1"), one.select("key", "h", F.col("first").alias("_pf"), F.col("lo").alias("_pl"))))
    found = flagged.pop()
    for subs, places in reversed(maps):
        found = flagged.pop().unionByName(ws.keep(_joined(found, subs, places, first_stays), "joined"))
    return found


def _joined(found: DataFrame, subs: DataFrame, places: DataFrame, first_stays: bool) -> DataFrame:
    """Ranges of stretches of smaller buckets as ranges of the stretches that they were cut from."""
    later = None
    if first_stays:
        subs = subs.join(places, ["key", "h"])
        leads = F.col("first").eqNullSafe(F.col("_pf")) & (F.col("lo") == F.col("_pl"))
        later = subs.where(~leads).select("pkey", "ph", F.array(F.col("off"), F.col("off") + F.col("n")).alias("ranges"))
        subs = subs.where(leads)
    own = subs.join(found, ["key", "h"]).select("pkey", "ph", F.transform("ranges", lambda x: x + F.col("off")).alias("ranges"))
    own = own if later is None else own.unionByName(later)
    return own.groupBy(F.col("pkey").alias("key"), F.col("ph").alias("h")).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def repeated_ranges(docs: DataFrame, ws: Workspace, text: str, length: int, first_stays: bool, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """By text (t1, t2): how many rows have it and the smallest id; and ranges of repeated starts, as a list of [from, to)."""
    keyed = docs.select(F.col("_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(text).alias("_t"))
    copies = ws.keep(keyed.groupBy("t1", "t2").agg(F.count("*").alias("many"), F.min(F.struct("_id")).alias("m")).select("t1", "t2", "many", F.col("m._id").alias("first")), "copies")
    long = keyed.where(F.octet_length("_t") >= length)
    found = ws.keep(long.select("t1", "t2", "_t").mapInArrow(lambda it: _found(it, length), "t1 long, t2 long, key long, lo int, n int, again boolean"), "stretches")
    place = F.struct("t1", "t2", "lo")
    shared = found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("again").alias("again")).where("a <> b or again").select("key")
    wanted = found.select("t1", "t2", "key", "lo", "n").join(shared, "key").groupBy("t1", "t2").agg(F.collect_set(F.struct("key", "lo", "n")).alias("wanted"))
    wanted = ws.keep(wanted.join(copies.select("t1", "t2", "first"), ["t1", "t2"]), "wanted")
    texts = long.join(wanted, ["t1", "t2"]).where("_id <=> first").select("t1", "t2", "first", "_t", "wanted")
    parts = ws.keep(texts.mapInArrow(lambda it: _cut(it, length), "t1 long, t2 long, first long, key long, lo int, h binary, part binary"), "parts")
    one = parts.groupBy("key", "h").agg(F.count("*").alias("many"), F.min(F.struct("first", "lo")).alias("place"), F.first("part").alias("part"))
    one = one.select("key", "h", "place.first", "place.lo", "many", "part", F.col("key").alias("gram"), F.lit(0).alias("d0"), F.lit(length - GRAM + 1).alias("d1"))
    one = ws.keep(one, "one")
    flagged = _judged(ws, one, length, first_stays, bucket_bytes)
    pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("ranges"), 1) - 1), lambda k: F.array(F.col("lo") + F.get("ranges", 2 * k), F.col("lo") + F.get("ranges", 2 * k + 1)))
    where = parts.select("t1", "t2", "first", "key", "h", "lo", (F.octet_length("part") - length + 1).alias("n"))
    later = None
    if first_stays:  # of equal stretches the first is judged by its windows, the others go whole
        where = where.join(one.select("key", "h", F.col("first").alias("_pf"), F.col("lo").alias("_pl")), ["key", "h"])
        leads = F.col("first").eqNullSafe(F.col("_pf")) & (F.col("lo") == F.col("_pl"))
        later = where.where(~leads).select("t1", "t2", F.array(F.array("lo", F.col("lo") + F.col("n"))).alias("r"))
        where = where.where(leads)
    back = where.join(flagged, ["key", "h"]).select("t1", "t2", pairs.alias("r"))
    back = back if later is None else back.unionByName(later)
    ranges = ws.keep(back.groupBy("t1", "t2").agg(F.flatten(F.collect_list("r")).alias("ranges")), "ranges")
    ws.drop(found, wanted, parts, one)
    return copies, ranges


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, first_stays: bool = False, bucket_bytes: int = BUCKET_BYTES, passage_words: int = 0) -> DataFrame:
    """Per row: id, n_bytes, spans (removed bytes: start, stop), kept (the other bytes). first_stays keeps the first copy by document id and place.

    With passage_words also n_shared: words in runs of that many or more that another row has as well, removed or not (see passages.py).
    """
    ws = Workspace(docs.sparkSession, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    copies, ranges = repeated_ranges(rows, ws, "_text", length, first_stays, bucket_bytes)
    known = copies.where("many > 1").join(ranges, ["t1", "t2"], "full")
    keyed = rows.withColumn("t1", F.xxhash64("_text")).withColumn("t2", F.xxhash64(F.lit(1), "_text"))
    shared = F.lit(0).cast("long")
    if passage_words:
        known, shared = known.join(shared_words(keyed, copies, ws, passage_words), ["t1", "t2"], "full"), F.coalesce("n_shared", shared)
    keyed = keyed.join(known, ["t1", "t2"], "left")
    whole = (F.coalesce("many", F.lit(1)) > 1) & (F.octet_length("_text") >= length)
    whole = whole & ~F.col("_id").eqNullSafe(F.col("first")) if first_stays else whole
    out = keyed.select("_id", "_text", whole.alias("whole"), "ranges", shared.alias("n_shared")).mapInArrow(lambda it: _removed(it, length), "_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary, n_shared long")
    return (out if passage_words else out.drop("n_shared")).withColumnRenamed("_id", id_col)


def op8_longest_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256; kept_bytes and has_repeats, whether anything was removed; n_passage_words, words in runs of over 50 that another document has."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage_words=SIZE)
    left = F.octet_length("kept").cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left.alias("kept_bytes"), (F.size("spans") > 0).alias("has_repeats"), F.col("n_shared").alias("n_passage_words"))
