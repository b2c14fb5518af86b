"""The corpus pipeline: language, near duplicates, contamination, mix and token shards, one written stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contaminated
from tidemark.llm.language import fit, label_rows
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.sstable import token_shards
from tidemark.llm.store import Workspace, row_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language - null texts and such without letters - go; the others' lang is the language found.

    Where no row has a language to learn from, lang stays as it is.
    """
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = label_rows(docs, model).where("lang_pred <> 'und'")
    return found.select(*((F.col("lang_pred") if c == "lang" else F.col("_row")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; rows of equal doc_id and text are one document."""
    return _without(docs, near_duplicates(docs, keyed=True).where("not kept").select("r1", "r2"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = contaminated(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key")
    return _without(docs, found.select("_key.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at each source's cut one is shortened."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written; what they hold is returned: doc_id, start, n_tokens, ids_crc32."""
    return token_shards(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(F.struct(r1.alias("r1"), r2.alias("r2")).alias("_key"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows (r1, r2) of gone, by id and text: ids may be repeated or null."""
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), r1.alias("k1"), r2.alias("k2"))
    left = rows.join(gone.distinct(), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left_anti")
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_output", encode),
]

#: Language models, signatures and token ids aren't SQL; tests/llm holds run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
