"""Benchmark decontamination by greedy string tiling (Wise's running Karp-Rabin form).

Word runs of `least` words that a document shares with a benchmark item are the seeds. For each
document and item with a common seed, the longest match of unmarked words on both sides is marked
as a tile, again and again, until none of `least` words is left. An item whose tiles cover `cover`
of its words makes the document contaminated; tiles may come in any order, so passages that were
put together anew are caught. Runs are matched by 64-bit hashes; a tile counts once its words were compared byte by byte.

Before the tiling, an item whose words in any shared run are too few is passed over: an exact bound. A task holds the words of 2 MB
of texts (or of one longer text, about 100 bytes a word) and a row of a document's length, also for texts of one repeated word.

An item of fewer than `least` words is sought as one run of all its words. Defined results: texts
without words, null or not, neither contaminate nor are contaminated; items of equal text are
reported each; repeated documents are reported each; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ship
from .words import Words, raw, shingles, text_parts, words

LEAST, COVER, PART = 5, 0.8, 2 << 20
#: Words of the benchmark that are sent to executors at once (about 40 bytes each); a larger benchmark goes in several blocks.
BLOCK_WORDS = 1_000_000


class Seeds(NamedTuple):
    """Runs of one length of a block of items: sorted different hashes, the items of each, and each item's runs as numbers of hashes."""

    length: int
    hash: np.ndarray
    bitmap: np.ndarray
    first: np.ndarray  # n + 1 offsets into item
    item: np.ndarray
    at: np.ndarray  # n items + 1 offsets into run
    run: np.ndarray


class Block(NamedTuple):
    ids: list
    sizes: np.ndarray
    words: list[list[bytes]]
    seeds: list[Seeds]


def _word_bytes(texts: pa.Array, w: Words, k: int) -> list[bytes]:
    data, _ = raw(pc.utf8_lower(texts.cast(pa.large_string())))
    return [data[x:y].tobytes() for x, y in zip(w.start[w.offsets[k] : w.offsets[k + 1]], w.end[w.offsets[k] : w.offsets[k + 1]], strict=True)]


def index_block(ids: list, texts: list[str | None], least: int = LEAST) -> Block:
    column = pa.array(texts, pa.large_string())
    w = words(column)
    data, _ = raw(pc.utf8_lower(column))
    every = [data[x:y].tobytes() for x, y in zip(w.start, w.end, strict=True)]
    sizes = np.diff(w.offsets)
    seeds = []
    for length in range(1, least + 1):
        own = (sizes == length) if length < least else (sizes >= least)
        if not own.any():
            continue
        h, offsets = shingles(w, length)
        item = np.repeat(np.arange(len(sizes)), np.diff(offsets))
        item, h = item[own[item]], h[own[item]]
        names, run = np.unique(h, return_inverse=True)
        pairs = np.unique(run * len(sizes) + item)
        bitmap = np.zeros(1 << max(16, int(len(names) * 16).bit_length()), bool)
        bitmap[names & np.uint64(len(bitmap) - 1)] = True
        first = np.searchsorted(pairs, np.arange(len(names) + 1) * len(sizes))
        seeds.append(Seeds(length, names, bitmap, first, pairs % len(sizes), np.searchsorted(item, np.arange(len(sizes) + 1)), run))
    return Block(ids, sizes, [every[x:y] for x, y in zip(w.offsets[:-1], w.offsets[1:], strict=True)], seeds)


def possible(run: np.ndarray, have: np.ndarray, length: int, size: int) -> int:
    """How many of an item's words stand in any of its runs that the document has: no tiling covers more."""
    edge = np.zeros(size + 1, np.int64)
    j = np.flatnonzero(have[run])
    np.add.at(edge, j, 1)
    np.add.at(edge, j + length, -1)
    return int((np.cumsum(edge) > 0)[:size].sum())


def tiles(doc: np.ndarray, run: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of a document and an item, both given as numbers of their runs of `length` words (negative: none of the other's).

    Returns (document position, item position, words); of equally long matches the first in the item, then in the
    document, is marked first. For each mark, matches are extended from the item's last run to its first: a match that
    begins at a run is by one longer than the one that begins a word later on both sides. So a row of the document's
    length is held, whatever the number of matching places.
    """
    order = np.argsort(doc, kind="stable")
    spots, n_doc, n_item = doc[order], len(doc), len(run)
    lo, hi = np.searchsorted(spots, run, "left"), np.searchsorted(spots, run, "right")
    hi = np.where(run < 0, lo, hi)
    where = [order[x:y] for x, y in zip(lo, hi, strict=True)]
    free = np.ones(n_item, bool)
    longer = np.zeros(n_doc + 1, np.int32)
    out = []
    while True:
        best, last = (0, 0, 0), None
        for j in range(n_item - 1, -1, -1):
            i = where[j]
            if not free[j] or not len(i):
                now = None
            else:
                size = longer[i + 1] + 1
                k = int(size.argmax())  # the first in the document
                if size[k] >= best[0]:
                    best = int(size[k]), j, int(i[k])
                now = i, size
            if last is not None:
                longer[last] = 0
            if now is not None:
                longer[now[0]] = now[1]
            last = None if now is None else now[0]
        if last is not None:
            longer[last] = 0
        if not best[0]:
            return out
        n, b, a = best[0] + length - 1, best[1], best[2]
        out.append((a, b, n))
        free[max(0, b - length + 1) : b + n] = False
        for j in np.flatnonzero(free):
            i = where[j]
            if len(i):
                where[j] = i[(i + length <= a) | (i >= a + n)]


def covered_words(found: list[tuple[int, int, int]], doc: list[bytes], item: list[bytes]) -> list[tuple[int, int, int]]:
    """The tiles whose words are equal byte by byte."""
    return [(a, b, n) for a, b, n in found if doc[a : a + n] == item[b : b + n]]


def _tiled(batches: Iterator[pa.RecordBatch], block: Block, cover: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for a, b in text_parts(batch.column(1), PART):
            texts = batch.column(1).slice(a, b - a)
            w = words(texts)
            for s in block.seeds:
                h, offsets = shingles(w, s.length)
                hit = np.flatnonzero(s.bitmap[h & np.uint64(len(s.bitmap) - 1)])
                name = np.minimum(np.searchsorted(s.hash, h[hit]), len(s.hash) - 1)
                hit, name = (x[s.hash[name] == h[hit]] for x in (hit, name))
                edges = np.searchsorted(hit, offsets)
                some = np.zeros(len(s.hash), bool)
                for d in np.flatnonzero((np.diff(edges) > 0) & (np.diff(w.offsets) >= s.length)):
                    own = slice(edges[d], edges[d + 1])
                    have = np.unique(name[own])
                    n = s.first[have + 1] - s.first[have]
                    near = np.unique(s.item[np.repeat(s.first[have] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                    some[have] = True
                    doc_words = None
                    for item in near.tolist():
                        size = int(block.sizes[item])
                        run = s.run[s.at[item] : s.at[item + 1]]
                        if possible(run, some, s.length, size) < cover * size:
                            continue
                        doc = np.full(offsets[d + 1] - offsets[d], -1)
                        doc[hit[own] - offsets[d]] = name[own]
                        doc_words = doc_words or _word_bytes(texts, w, int(d))
                        found = covered_words(tiles(doc, run, s.length), doc_words, block.words[item])
                        covered = sum(x[2] for x in found)
                        if covered >= cover * size:
                            rows.append((a + int(d), item, len(found), covered, size))
                    some[have] = False
        if rows:
            d, item, n, covered, size = (np.array(c) for c in zip(*rows, strict=True))
            ids = pa.array([block.ids[k] for k in item], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), ids, pa.array(n), pa.array(covered), pa.array(size), pa.array(covered / size)], names=["_id", "item", "n_tiles", "covered", "n_words", "coverage"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = LEAST, cover: float = COVER, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Pairs of a document and an item it contains: id, item, n_tiles, covered, n_words, coverage.

    The benchmark goes to executors in blocks of at most block_words words (one item at least), each held against
    all documents where they lie; nothing is shuffled.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = max(1, -(-total // (5 * block_words)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, item string, n_tiles long, covered long, n_words long, coverage double"

    def one(k: int) -> DataFrame:
        got = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(index_block([r.item for r in got], [r.text for r in got], least))
        return rows.mapInArrow(lambda it: _tiled(it, shared.value, cover), schema)

    found = reduce(DataFrame.unionAll, [one(k) for k in range(blocks)])
    return found.withColumnRenamed("_id", id_col).withColumn("item", F.col("item").cast(benchmark.schema[item_col].dataType)).withColumnRenamed("item", item_col)


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items: contaminated pairs with their tiling."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
