"""Language identification: script ranges narrow a word's candidates, Viterbi labels spans.

A word is a run of letters and marks. Each language's score of a word is the sum of log shares of
its 2- to 4-letter runs, boundaries included, in that language's training texts. A word written in
a script counts only for the languages that use this script in training. The labels of a document
are the path of words with the best sum of scores less a penalty for each change of language; its
language is the one with the most letters.

Fitted on at most ROWS_PER_LANGUAGE rows of each language, the first by a hash of id and text, over their whole texts; runs are
counted on executors. A very long text is scored in pieces cut at a white space, and its words' scores (4 to 8 bytes a word and language) are solved together.

Defined results: null or a text without letters is `und` with score 0 and no span; digits and
symbols belong to no word; a word of a script that no language uses counts for all alike; ties go
to the language first by name; repeated rows get the same answer; an empty table gives no row.
Without any training row the answer is `und` throughout.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import ship
from .words import U, mix, text_parts

# First code points of script ranges and their scripts (Unicode block names).
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C00, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
#: The training sample: so many rows of each language.
ROWS_PER_LANGUAGE = 1500
BUCKETS, SWITCH, SCRIPT_SHARE, BLOCK, PIECE = 1 << 16, 8.0, 0.01, 64, 1 << 19


#: Where a very long text may be cut: white space and punctuation.
_SPACE = re.compile(r"[\s.,;:!?\u3000-\u303F\uFF00-\uFF0F]")
#: With more languages the label paths are followed word by word, as the other way keeps a flag for each pair of languages.
MANY = 16


class Model(NamedTuple):
    languages: list[str]
    score: np.ndarray  # BUCKETS x languages: log shares
    scripts: np.ndarray  # script numbers x languages: whether the language uses the script


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script number + 1 of letters and marks (0: no letter), and whether it is a letter proper."""
    names = sorted({s for _, s in SCRIPTS})
    first = np.array([c for c, _ in SCRIPTS])
    number = np.array([names.index(s) for _, s in SCRIPTS])
    kind = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x33480)], np.int8)
    script = number[np.searchsorted(first, np.arange(len(kind)), "right") - 1] + 1
    return np.where(kind > 0, script, 0).astype(np.int8), kind == 2


class _Text(NamedTuple):
    code: np.ndarray  # lower-cased code points; 0: not in a word
    word: np.ndarray  # n + 1 borders of words as positions in code
    end: np.ndarray
    offsets: np.ndarray  # n + 1 word offsets of the documents
    position: np.ndarray  # n + 1 code point offsets of the documents


def _text(column: pa.Array) -> _Text:
    """Code points of all rows, each followed by a line feed so that words end with their document."""
    low = pc.binary_join_element_wise(pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    low = low.combine_chunks() if isinstance(low, pa.ChunkedArray) else low
    _, offsets, data = low.buffers()
    off = np.frombuffer(offsets, np.int64)[low.offset : low.offset + len(low) + 1]
    raw = data[off[0] : off[-1]].to_pybytes() if data is not None else b""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    position = lead[off - off[0]]
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    script, _ = _letters()
    inside = script[np.minimum(code, len(script) - 1)] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return _Text(np.where(inside, code, 0), edge[::2], edge[1::2], np.searchsorted(edge[::2], position), position)


def _runs(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of a letter in each 2- to 4-letter run of a word with its boundaries, and hash buckets of the runs."""
    c = np.concatenate([[0], code, [0, 0, 0]]).astype(U)
    h = c * U(0x9E3779B97F4A7C15)
    power = 1
    for n in (2, 3, 4):
        power = power * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        m = len(c) - n + 1
        h = h[:m] + c[n - 1 :] * U(power * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        ok = (c[0:m] | c[n - 1 :]) != 0 if n == 2 else np.logical_and.reduce([c[k : k + m] != 0 for k in range(1, n - 1)])
        at = np.flatnonzero(ok)
        of = np.where(c[at] != 0, at - 1, at)
        yield of, (mix(h[at] + U(n)) & U(BUCKETS - 1)).astype(np.int64)


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket's runs and each script's letters occur in texts."""
    counts, used = np.zeros(BUCKETS, np.int64), np.zeros(len({s for _, s in SCRIPTS}) + 1, np.int64)
    script, _ = _letters()
    for a, b in text_parts(column, PIECE):
        for piece in _pieces(column.slice(a, b - a))[0]:
            t = _text(piece)
            for _, bucket in _runs(t.code):
                counts += np.bincount(bucket, minlength=BUCKETS)
            used += np.bincount(script[np.minimum(t.code, len(script) - 1)], minlength=len(used))
    used[0] = 0
    return counts, used


def _pieces(column: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """Columns of a bounded number of bytes, and the row of each of their texts: one column, or the pieces of one long text."""
    if len(column) > 1 or not len(column) or len(column[0].as_py() or "") <= 2 * PIECE:
        return [column], np.arange(len(column))
    text, cut = column[0].as_py(), [0]
    while cut[-1] < len(text):
        space = _SPACE.search(text, cut[-1] + PIECE, cut[-1] + 2 * PIECE)
        cut.append(space.start() if space else min(len(text), cut[-1] + 2 * PIECE))
    pieces = [pa.array([text[x:y]], pa.large_string()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return pieces, np.zeros(len(pieces), np.int64)


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Log shares of runs and scripts, from each language's counts."""
    languages = sorted(counts)
    share, used = np.zeros((len(languages), BUCKETS)), np.zeros((len({s for _, s in SCRIPTS}) + 1, len(languages)))
    for k, language in enumerate(languages):
        runs, letters = counts[language]
        share[k], used[:, k] = np.log((runs + 0.1) / (runs + 0.1).sum()), letters
    return Model(languages, np.ascontiguousarray(share.T.astype(np.float32)), used >= SCRIPT_SHARE * np.maximum(used.sum(axis=0), 1))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to (language, kind, number, count): kind 0 counts runs by bucket, 1 letters by script."""
    for batch in batches:
        for language in pc.unique(batch.column(0)):
            found = counted(batch.column(1).filter(pc.equal(batch.column(0), language)))
            for kind, c in enumerate(found):
                at = np.flatnonzero(c)
                name = pa.array([language.as_py()] * len(at), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["language", "kind", "number", "count"])


def word_scores(t: _Text, model: Model) -> np.ndarray:
    """words x languages; a script's non-candidates are far below."""
    sums = np.zeros((len(t.code) + 1, len(model.languages)))
    for of, bucket in _runs(t.code):
        part = np.zeros((len(t.code), len(model.languages)), np.float32)
        part[of] = model.score[bucket]  # of one n, a position is written twice at most, at a word's first letter
        twice = np.flatnonzero(of[1:] == of[:-1])
        part[of[twice]] += model.score[bucket[twice]]
        sums[1:] += part
    np.cumsum(sums, axis=0, out=sums)
    out = sums[t.end] - sums[t.word]
    script, _ = _letters()
    can = model.scripts[script[np.minimum(t.code[t.word], len(script) - 1)]]
    none = ~can.any(axis=1)
    out = np.where(can, out, -1e4)
    out[none] = 0.0
    return out


def viterbi(score: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word of each document.

    Documents are cut into blocks of BLOCK words. All blocks are solved together for every label
    that may come before them, then the blocks of each document are chained. With many labels all
    documents go on by a word at a time instead, which takes a flag for each word and label.
    """
    n_words, n = score.shape
    if n > MANY:
        return _word_by_word(score, offsets, switch)
    labels = np.zeros(n_words, np.int64)
    count = np.diff(offsets)
    blocks = -(-count // BLOCK)
    total = int(blocks.sum())
    if not total:
        return labels
    doc = np.repeat(np.arange(len(count)), blocks)
    first_block = np.cumsum(blocks) - blocks
    begin = offsets[:-1][doc] + (np.arange(total) - first_block[doc]) * BLOCK
    at = begin[:, None] + np.arange(BLOCK)
    real = at < offsets[1:][doc][:, None]
    s = np.where(real[:, :, None], score[np.minimum(at, n_words - 1)], 0.0)
    best = s[:, 0][:, None, :] - switch * (1 - np.eye(n))
    stay, jump = np.zeros((BLOCK, total, n, n), bool), np.zeros((BLOCK, total, n), np.int16)
    for k in range(1, BLOCK):
        jump[k] = best.argmax(axis=2)
        over = best.max(axis=2, keepdims=True) - switch
        stay[k] = best >= over
        best = np.maximum(best, over) + s[:, k][:, None, :]
    order = np.argsort(-blocks, kind="stable")
    live = int((blocks > 0).sum())
    value = np.zeros((len(count), n))
    came = np.zeros((total, n), np.int64)
    for j in range(int(blocks.max())):
        d = order[: int(np.searchsorted(-blocks[order][:live], -j, "left"))]
        step = value[d][:, :, None] + best[first_block[d] + j]
        came[first_block[d] + j] = step.argmax(axis=1)
        value[d] = step.max(axis=1)
    out, into = np.zeros(total, np.int64), np.zeros(total, np.int64)
    state = value.argmax(axis=1)
    for j in range(int(blocks.max()) - 1, -1, -1):
        d = order[: int(np.searchsorted(-blocks[order][:live], -j, "left"))]
        b = first_block[d] + j
        out[b] = state[d]
        into[b] = state[d] = came[b, state[d]]
    every = np.arange(total)
    path = np.zeros((total, BLOCK), np.int64)
    path[:, -1] = out
    for k in range(BLOCK - 1, 0, -1):
        here = path[:, k]
        path[:, k - 1] = np.where(stay[k, every, into, here], here, jump[k, every, into])
    labels[at[real]] = path[real]
    return labels


def _word_by_word(score: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """viterbi() by one step for the k-th words of all documents that have one, the longest documents first."""
    count = np.diff(offsets)
    order = np.argsort(-count, kind="stable")
    first = offsets[:-1][order]
    live = np.searchsorted(-count[order], -np.arange(int(count.max(initial=0))), "left")
    labels, stay, jump = np.zeros(len(score), np.int64), np.ones(score.shape, bool), np.zeros(len(score), np.int32)
    best = np.zeros((len(count), score.shape[1]))
    for k, m in enumerate(live):
        at = first[:m] + k
        if k:
            top = best[:m].argmax(axis=1)
            over = best[np.arange(m), top][:, None] - switch
            stay[at], jump[at] = best[:m] >= over, top
            best[:m] = np.maximum(best[:m], over)
        best[:m] += score[at]
    state = best.argmax(axis=1)
    for k in range(len(live) - 1, -1, -1):
        at = first[: live[k]] + k
        here = state[: live[k]]
        labels[at] = here
        state[: live[k]] = np.where(stay[at, here], here, jump[at])
    return labels


class _Scored(NamedTuple):
    """Words of some documents: scores by language, letters, characters' starts and ends, and n + 1 word offsets of the documents."""

    score: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def _scored(column: pa.Array, model: Model) -> _Scored:
    _, proper = _letters()
    pieces, row = _pieces(column)
    parts, words_of, at = [], np.zeros(len(column), np.int64), 0
    for k, piece in enumerate(pieces):
        t = _text(piece)
        letters = np.concatenate([[0], np.cumsum(proper[np.minimum(t.code, len(proper) - 1)] & (t.code > 0))])
        count = np.diff(t.offsets)
        own = at + np.zeros(len(t.word), np.int64) if len(pieces) > 1 else -np.repeat(t.position[:-1], count)
        words_of += count if len(pieces) == 1 else np.array([count.sum()])
        parts.append((word_scores(t, model), letters[t.end] - letters[t.word], t.word + own, t.end + own))
        at += int(t.position[-1]) - 1 if len(pieces) > 1 else 0  # less the line feed that ends a row
    score, letters, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _Scored(score, letters, start, end, np.concatenate([[0], np.cumsum(words_of)]))


def _labelled(batches: Iterator[pa.RecordBatch], model: Model, spans: bool, field: int | None = None) -> Iterator[pa.RecordBatch]:
    """(row, text), or rows whose text is a field of the struct, to (row, lang_pred, score and, if asked for, spans)."""
    n = len(model.languages)
    names = pa.array([*model.languages, "und"], pa.string())
    for batch in batches:
        texts = batch.column(1) if field is None else pc.struct_field(batch.column(0), [field]).cast(pa.string())
        for a, b in text_parts(texts, PIECE):
            rows = b - a
            if n:
                t = _scored(texts.slice(a, rows), model)
                label = viterbi(t.score, t.offsets)
                doc = np.repeat(np.arange(rows), np.diff(t.offsets))
                share = np.bincount(doc * n + label, t.letters, rows * n).reshape(rows, n)
            else:
                label, doc, share = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((rows, 1))
            whole = share.sum(axis=1)
            top = np.where(whole > 0, share.argmax(axis=1), n)
            score = np.where(whole > 0, share.max(axis=1) / np.maximum(whole, 1), 0.0)
            columns = [batch.column(0).slice(a, rows), names.take(pa.array(top)), pa.array(score)]
            if spans:
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                f = np.flatnonzero(new)
                last = np.concatenate([f[1:], [len(label)]])[: len(f)] - 1
                start, end = (t.start[f], t.end[last]) if len(f) else (np.zeros(0, np.int64),) * 2
                items = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), names.take(pa.array(label[f]))], names=["start", "end", "lang"])
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[f], np.arange(rows + 1)), pa.int32()), items))
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "lang_pred", "score", "spans"][: len(columns)])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Train on the first rows_per_language different rows of each language by a hash of their id and text.

    Rows whose crc32 of the id as text has the remainder 2 by 4 are held out. The driver gets at most BUCKETS counts a language.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null")
    rows = rows.where(~held_out(F.col("i"))).select(F.xxhash64(F.col("i").cast("string"), "t").alias("h"), F.xxhash64("t").alias("g"), "t", "l")
    # hashes below a language's share let about four times the wanted rows through, so no task orders a language
    many = [(r.l, min(1.0, 4 * rows_per_language / r.n) * 2.0**53) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()]
    if not many:
        return model_of({})
    share = F.broadcast(docs.sparkSession.createDataFrame(many, "l3 string, most double"))  # one row a language
    few = rows.select("l", "h", "g").join(share, (F.col("l") == F.col("l3")) & (F.shiftrightunsigned(F.col("h"), 11) < F.col("most"))).select("l", "h", "g").distinct()
    order = F.struct((F.shiftrightunsigned("h", 11)).alias("top"), "h", "g")
    first = F.row_number().over(Window.partitionBy("l").orderBy(order))
    low = few.withColumn("k", first).where(F.col("k") <= rows_per_language).groupBy("l").agg(F.max(order).alias("most"))
    low = {r.l: r.most for r in low.collect()}  # one row a language
    bound = docs.sparkSession.createDataFrame([(k, (m.top, m.h, m.g)) for k, m in low.items()], "l2 string, last struct<top: long, h: long, g: long>")
    sample = rows.join(F.broadcast(bound), (F.col("l") == F.col("l2")) & (order <= F.col("last"))).dropDuplicates(["l", "h", "g"])
    tally = sample.select("l", "t").mapInArrow(_tallied, "language string, kind int, number int, count long")
    counts = {k: (np.zeros(BUCKETS, np.int64), np.zeros(len({s for _, s in SCRIPTS}) + 1, np.int64)) for k in low}
    for r in tally.groupBy("language", "kind", "number").agg(F.sum("count").alias("count")).collect():
        counts[r.language][r.kind][r.number] = r["count"]
    return model_of(counts)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label_rows(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """_row (all columns of docs as a struct), lang_pred, score and, if asked for, spans (start, end, lang) by character of the lower-cased text. Nothing is shuffled."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages x 4 bytes: 1 MB for four languages
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    field = docs.columns.index(text_col)
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start:bigint,end:bigint,lang:string>>" * spans
    return rows.mapInArrow(lambda it: _labelled(it, shared.value, spans, field), schema)


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """_id, lang_pred, score and, if asked for, spans. Reads only id and text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)
    schema = f"_row {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start:bigint,end:bigint,lang:string>>" * spans
    return rows.mapInArrow(lambda it: _labelled(it, shared.value, spans), schema).withColumnRenamed("_row", "_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = label_languages(docs, fit(docs), spans=False)
    return found.select(F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score")
