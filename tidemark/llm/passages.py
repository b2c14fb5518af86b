"""Words of each text that stand in a run of `size` words or more which another document has as well, however few bytes the run has.

As in substrings.py, every window of `size` words goes to the bucket of the smallest hash among its 8-word runs, so
equal windows meet. Equal stretches of windows fold into one; those that two texts have are shared as they are. Only
where a bucket has different stretches of different texts, their windows are held against each other one by one, by
hash, as counts over all windows: no bucket has to fit a task.

Defined results: a word is a lower-cased run of letters or digits (words.py); a text shorter than `size` words has
none; all words of a text that several rows have count; runs that repeat within one document alone don't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace
from .words import U, powers, runs_of, span_hash, text_parts, window_minimum, words

SIZE, GRAM, PIECE = 51, 8, 2 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 word offsets of the rows; a long text is hashed in pieces that end at a space."""
    if len(column) != 1 or len(text := column[0].as_py() or "") <= 2 * PIECE:
        w = words(column)
        return w.hash, w.offsets
    found, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        to = space.start() if space else len(text)
        found.append(words(pa.array([text[at:to]])).hash)
        at = to
    h = np.concatenate(found)
    return h, np.array([0, len(h)])


def _sums(h: np.ndarray) -> np.ndarray:
    """As prefix() of words.py, over word hashes."""
    up, _ = powers(len(h) + 1)
    return np.concatenate([np.zeros(1, U), np.cumsum(h * up[: len(h)])])


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text) to runs of windows with one smallest hash: key, d (hash of the run's words), lo, n."""
    for batch in batches:
        for a, b in text_parts(batch.column(2), PIECE):
            h, offsets = word_hashes(batch.column(2).slice(a, b - a))
            if len(h) < size:
                continue
            p, gram = _sums(h), min(GRAM, size)
            at = np.arange(len(h) - gram + 1)
            doc, key, begin, n = runs_of(window_minimum(span_hash(p, at, at + gram), size - gram + 1), offsets, size)
            t = [batch.column(k).slice(a, b - a).take(pa.array(doc)) for k in (0, 1)]
            d = span_hash(p, begin, begin + n + size - 1)
            columns = [*t, pa.array(key.view(np.int64)), pa.array(d.view(np.int64)), pa.array((begin - offsets[:-1][doc]).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "key", "d", "lo", "n"])


_RUN = pa.struct([("w", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(t1, text, wanted) to wanted stretches with their windows: w (hash of the window's words), lo and hi (first and last start in the stretch of as many alike)."""
    for batch in batches:
        for a, b in text_parts(batch.column(1), PIECE):
            h, offsets = word_hashes(batch.column(1).slice(a, b - a))
            p, wanted = _sums(h), batch.column(2).slice(a, b - a)
            rows = np.repeat(np.arange(b - a), np.asarray(wanted.value_lengths()))
            key, d, lo, n, many = wanted.flatten().flatten()
            n = np.asarray(n).astype(np.int64)
            part = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = (offsets[:-1][rows] + np.asarray(lo))[part] + at
            w = span_hash(p, begin, begin + size)
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (part[1:] != part[:-1])]))
            last = np.append(first[1:], len(w)) - 1
            runs = pa.StructArray.from_arrays([pa.array(w[first].view(np.int64)), pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))], fields=list(_RUN))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(part[first], np.arange(len(n) + 1)).astype(np.int32)), runs)
            t1 = batch.column(0).slice(a, b - a).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([t1, key, d, many, runs], names=["t1", "key", "d", "many", "runs"])


def shared_words(keyed: DataFrame, copies: DataFrame, ws: Workspace, size: int = SIZE) -> DataFrame:
    """By text (t1, t2): n_shared, above 0. keyed: _id, t1, t2, _text; copies, by text: many (rows that have it), first (their smallest id)."""
    long = keyed.where(F.octet_length("_text") >= 2 * size - 1)  # a word and a space have two bytes at least
    runs = ws.keep(long.select("t1", "t2", "_text").mapInArrow(lambda it: _stretches(it, size), "t1 long, t2 long, key long, d long, lo int, n int"), "word_stretches")
    one = runs.groupBy("key", "d").agg(F.min(F.struct("t1", "t2", "lo", "n")).alias("place"), F.max("t1").alias("b"))
    one = ws.keep(one.select("key", "d", "place.*", "b", (F.col("place.t1") != F.col("b")).alias("many")), "word_one")
    mixed = one.groupBy("key").agg(F.count("*").alias("c"), F.min("t1").alias("a"), F.max("b").alias("b")).where("c > 1 and a <> b").select("key")
    wanted = one.join(mixed, "key").groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "d", "lo", "n", "many")).alias("wanted"))
    wanted = wanted.join(copies.select("t1", "t2", "first"), ["t1", "t2"])
    texts = long.join(wanted, ["t1", "t2"]).where("_id <=> first").select("t1", "_text", "wanted")
    windows = ws.keep(texts.mapInArrow(lambda it: _windows(it, size), "t1 long, key long, d long, many boolean, runs array<struct<w:bigint,lo:int,hi:int>>"), "word_windows")
    met = windows.select("t1", "key", "many", F.explode("runs.w").alias("w")).groupBy("key", "w").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.max("many").alias("many")).where("a <> b or many").select("key", "w")
    found = windows.where("not many").select("key", "d", F.inline("runs")).join(met, ["key", "w"]).groupBy("key", "d").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    found = found.unionByName(one.where("many").select("key", "d", F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))).alias("at")))
    moved = F.transform("at", lambda x: F.struct((x["lo"] + F.col("lo")).alias("lo"), (x["hi"] + F.col("lo")).alias("hi")))
    starts = runs.join(found, ["key", "d"]).groupBy("t1", "t2").agg(F.flatten(F.collect_set(moved)).alias("s"))
    covered = F.expr(f"aggregate(array_sort(s), named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.hi + {size} - greatest(a.to, x.lo)), 'to', greatest(a.to, x.hi + {size})), a -> a.n)")
    whole = runs.groupBy("t1", "t2").agg((F.max(F.col("lo") + F.col("n")) + size - 1).cast("long").alias("n_shared")).join(copies.where("many > 1").select("t1", "t2"), ["t1", "t2"])
    out = ws.keep(starts.select("t1", "t2", covered.alias("n_shared")).unionByName(whole).groupBy("t1", "t2").agg(F.max("n_shared").alias("n_shared")), "shared_words")
    ws.drop(runs, one, windows)
    return out
