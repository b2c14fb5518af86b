"""Which texts contain which phrases, by one pass of an Aho-Corasick automaton over each text.

Phrases go out in blocks of bounded size; a task builds a block's automaton once and runs it over its texts in
Arrow batches. No text is shuffled, and the time doesn't depend on the number of phrases of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from ..workspace import ship
from .blocks import blocks, lengths, united

#: Characters of phrases in a block; an automaton takes some hundred bytes a character.
BLOCK = 1_000_000
_BUILT: dict[int, object] = {}


def _automaton(key: int, phrases: list[str]) -> object:
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            a.add_word(p, i)
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def _contained(batches: Iterator[pa.RecordBatch], key: int, phrases: list[str]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(key, phrases)
    for batch in batches:
        rows, found = [], []
        for row in range(len(batch)):
            text = batch.column(1)[row].as_py()
            hits = sorted({i for _, i in automaton.iter(text)}) if text else ()
            rows += [row] * len(hits)
            found += hits
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int32())], names=["id", "phrase"])


def containing(docs: DataFrame, items: DataFrame, *, id_col: str, text_col: str, item_id: str, item_text: str, block: int = BLOCK) -> DataFrame:
    """(id_col, item_id): the pairs of a text and an item whose normalised text lies in it. Null texts contain nothing, null and empty items lie in nothing.

    Items of equal text are looked for once. docs are read once a block of items.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("id"), norm(F.col(text_col)).alias("text"))
    sought = items.select(F.col(item_id).alias("item"), norm(F.col(item_text)).alias("phrase")).where("phrase <> ''")
    schema = f"id {texts.schema['id'].dataType.simpleString()}, phrase int"
    parts = []
    for k, some in enumerate(blocks(sought.select("phrase").distinct(), lengths("phrase"), block, "phrase")):
        phrases = [r["phrase"] for r in some]
        shared = spark.sparkContext.broadcast(phrases)
        found = texts.mapInArrow(lambda it, s=shared, k=k: _contained(it, hash((k, len(s.value), s.value[0])), s.value), schema)
        named = spark.createDataFrame(list(enumerate(phrases)), "phrase int, text string")
        parts.append(found.join(named, "phrase").select("id", "text"))
    pairs = united(parts, docs, f"id {texts.schema['id'].dataType.simpleString()}, text string")
    return pairs.join(sought, pairs["text"] == sought["phrase"]).select(F.col("id").alias(id_col), F.col("item").alias(item_id))
