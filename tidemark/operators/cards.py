"""Cards: the searchable projections of a pack, one row each, with personal data and unusable provenance left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import join_text
from .packs import FAMILIES, Pack

# Card types of families, and other names a filter may use.
TYPES = {
    "spaces": "space", "tables": "table", "columns": "column", "value_dictionaries": "value_dictionary", "metrics": "metric",
    "business_terms": "business_term", "join_recipes": "join_recipe", "policies": "policy", "verified_queries": "verified_query", "reverse_questions": "reverse_question",
}
ALIASES = {**TYPES, "terms": "business_term"}
BLOCKED = "raw values blocked by policy"
# Fields whose text a card is found by, and its title, by family; SQL expressions over the family.
TEXTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "spaces": ("coalesce(title, id)", ("id", "title", "description")),
    "tables": ("coalesce(title, physical_name)", ("id", "physical_name", "title", "description", "role", "grain", "array_join(columns, ' ')")),
    "columns": ("concat(table, '.', name)", ("id", "table", "name", "data_type", "semantic_type", "description")),
    "value_dictionaries": ("concat(table, '.', column)", ("id", "table", "column", "shown")),
    "metrics": ("coalesce(label, name)", ("id", "name", "label", "description", "formula_sql", "date_basis", "array_join(required_tables, ' ')")),
    "business_terms": ("term", ("id", "term", "array_join(aliases, ' ')", "definition", "sql_condition", "array_join(related_tables, ' ')")),
    "join_recipes": ("concat(left_table, ' - ', right_table)", ("id", "left_table", "right_table", "join_type", "condition", "array_join(warnings, ' ')")),
    "policies": ("id", ("id", "array_join(roles, ' ')", "array_join(allowed_tables, ' ')", "array_join(blocked_columns, ' ')", "array_join(notes, ' ')")),
    "verified_queries": ("question", ("id", "question", "array_join(related_terms, ' ')", "array_join(related_metrics, ' ')")),
    "reverse_questions": ("question", ("id", "target", "question", "reason")),
}


def shown_values(dictionaries: DataFrame, columns: DataFrame) -> DataFrame:
    """Dictionaries with `shown`: values and labels, or a notice where the column is personal or unknown."""
    safe = columns.select(F.col("table").alias("_t"), F.col("name").alias("_c"), (~F.coalesce("is_pii", F.lit(False))).alias("_safe"))
    joined = dictionaries.join(F.broadcast(safe), (F.col("table") == F.col("_t")) & (F.col("column") == F.col("_c")), "left")  # pack columns: driver-sized
    text = F.array_join(F.transform("values", lambda v: F.concat_ws(" ", v["value"], v["label"])), " ")
    return joined.withColumn("shown", F.when(F.coalesce("_safe", F.lit(False)), text).otherwise(BLOCKED)).drop("_t", "_c", "_safe")


def cards(spark: SparkSession, pack: Pack, source_path: str = "") -> DataFrame:
    """card_id, card_type, pack_id, space_id, status, title, text, metadata, source_path for every card of a pack."""
    frames = {f: pack.frame(spark, f) for f in FAMILIES}
    frames["value_dictionaries"] = shown_values(frames["value_dictionaries"], frames["columns"])
    spaces = frames["tables"].select(F.col("physical_name").alias("_t"), "space_id")
    out = []
    for family, (title, parts) in TEXTS.items():
        df = frames[family]
        if family in ("columns", "value_dictionaries"):
            df = df.join(F.broadcast(spaces), F.col("table") == F.col("_t"), "left")
        space = F.col("space_id") if "space_id" in df.columns else F.col("id") if family == "spaces" else F.lit(None).cast("string")
        status = F.col("status") if "status" in df.columns else F.lit(pack.status)
        rest = [c for c in df.columns if c not in ("id", "space_id", "status", "_t")]
        metadata = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else F.create_map()
        out.append(df.select(
            F.col("id").alias("card_id"), F.lit(TYPES[family]).alias("card_type"), F.lit(pack.id).alias("pack_id"), F.coalesce(space, F.lit("default")).alias("space_id"),
            F.coalesce(status, F.lit("unknown")).alias("status"), F.expr(title).alias("title"), join_text(*map(F.expr, parts)).alias("text"),
            F.map_filter(metadata, lambda k, v: v.isNotNull()).alias("metadata"), F.lit(source_path).alias("source_path"),
        ))
    return reduce(DataFrame.unionByName, out)


def indexable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards with an id and without personal data, and the others, which must not be indexed."""
    ok = (F.trim(F.coalesce("card_id", F.lit(""))) != "") & ~pii.has_pii(F.coalesce("text", F.lit("")))
    return documents.where(ok), documents.where(~ok)


def last_wins(documents: DataFrame, order: str) -> DataFrame:
    """Of cards of one id the last by `order`."""
    best = documents.groupBy("card_id").agg(F.max_by(F.struct(*[c for c in documents.columns if c != "card_id"]), order).alias("c"))
    return best.select("card_id", "c.*")


def of_type(card_type: Column, wanted: list[str]) -> Column:
    """Whether a card's type is among the wanted ones, in singular or plural."""
    names = [ALIASES.get(w.strip().lower(), w.strip().lower()) for w in wanted]
    return card_type.isin(*names)


def filtered(documents: DataFrame, filters: dict) -> DataFrame:
    """Every filter must hold: equality, membership in a list, or overlap where the column is an array."""
    arrays = {f.name for f in documents.schema if f.dataType.typeName() == "array"}
    for name, want in filters.items():
        values = want if isinstance(want, (list, tuple, set)) else [want]
        c = F.col(name) if name in documents.columns else F.col("metadata")[name]
        documents = documents.where(F.arrays_overlap(c, F.array(*map(F.lit, values))) if name in arrays else c.isin(*values))
    return documents


def provenance(entries: Column) -> Column:
    """Roll-up of provenance entries: usable if any is and none forbids SQL; sources sorted; warnings."""
    usable = F.exists(entries, lambda p: p["can_use_for_text2sql"]) & ~F.exists(entries, lambda p: p["is_test_only"])
    return F.struct(
        F.coalesce(usable, F.lit(False)).alias("usable"), F.array_sort(F.array_distinct(F.transform(entries, lambda p: p["metadata_source"]))).alias("sources"),
        F.exists(entries, lambda p: p["requires_human_confirmation"]).alias("needs_confirmation"),
    )
