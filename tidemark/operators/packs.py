"""Metadata packs: a small validated document of tables, columns, terms, metrics, joins and policies.

Packs live on the driver and are turned into DataFrames by family; data never is joined to them by shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Families of a pack and the fields of their cards, as Spark types.
FAMILIES: dict[str, str] = {
    "spaces": "id string, title string, description string",
    "tables": "id string, space_id string, physical_name string, title string, description string, role string, grain string, primary_key string, columns array<string>, pii_level string, status string, confidence double",
    "columns": "id string, table string, name string, data_type string, nullable boolean, semantic_type string, description string, is_pii boolean, status string, top_values array<string>",
    "value_dictionaries": "id string, table string, column string, values array<struct<value:string,label:string,count:bigint>>, status string",
    "metrics": "id string, name string, label string, description string, formula_sql string, date_basis string, required_tables array<string>, default_filters array<string>, status string, owner string",
    "business_terms": "id string, term string, aliases array<string>, definition string, sql_condition string, related_tables array<string>, related_metrics array<string>, ambiguity_rules array<struct<id:string,target:string,condition:string,question:string,required_when:string>>, status string",
    "join_recipes": "id string, left_table string, right_table string, join_type string, condition string, recommended boolean, warnings array<string>, status string",
    "policies": "id string, roles array<string>, allowed_tables array<string>, blocked_columns array<string>, max_preview_rows int, notes array<string>",
    "verified_queries": "id string, question string, sql string, related_terms array<string>, related_metrics array<string>, status string",
    "reverse_questions": "id string, target string, question string, reason string, status string, answer string",
}
SCALARS = ("id", "version", "status", "title", "description", "locale")
SECTIONS = (*SCALARS, "owners", "source_refs", *FAMILIES, "metadata")


class PackError(ValueError):
    """A pack that isn't one: unknown or missing sections, or cards with unknown fields."""


@dataclass
class Pack:
    id: str
    version: str = "0.1.0"
    status: str = "draft"
    title: str = ""
    description: str = ""
    locale: str = "en"
    owners: list[str] = field(default_factory=list)
    source_refs: list[dict[str, Any]] = field(default_factory=list)
    cards: dict[str, list[dict[str, Any]]] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def frame(self, spark: SparkSession, family: str) -> DataFrame:
        """Cards of a family, typed; an empty family is an empty frame."""
        names = _names(FAMILIES[family])
        rows = [tuple(_shaped(c.get(n)) for n in names) for c in self.cards.get(family, [])]
        return spark.createDataFrame(rows, FAMILIES[family])

    def to_dict(self) -> dict[str, Any]:
        own = {k: getattr(self, k) for k in (*SCALARS, "owners", "source_refs", "metadata")}
        return own | {f: self.cards.get(f, []) for f in FAMILIES}


def _names(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in schema + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def _shaped(v: Any) -> Any:
    return tuple(v.values()) if isinstance(v, Mapping) else [_shaped(x) for x in v] if isinstance(v, list) else v


def parse(document: Mapping[str, Any]) -> Pack:
    """A pack from a document, with or without the `semantic_pack` wrapper. Unknown sections and fields are errors."""
    doc = dict(document.get("semantic_pack", document))
    if unknown := sorted(set(doc) - set(SECTIONS)):
        raise PackError(f"unknown sections: {unknown}")
    if not doc.get("id"):
        raise PackError("a pack needs an id")
    cards = {}
    for family, schema in FAMILIES.items():
        names = set(_names(schema))
        cards[family] = [dict(c) for c in doc.get(family) or []]
        for c in cards[family]:
            if extra := sorted(set(c) - names):
                raise PackError(f"{family}: unknown fields {extra}")
            if not c.get("id"):
                raise PackError(f"{family}: a card has no id")
    return Pack(**{k: v for k, v in doc.items() if k not in FAMILIES}, cards=cards)


def load(path: str) -> Pack:
    """A pack from a JSON file, or a YAML one where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return parse(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise PackError("reading YAML packs needs PyYAML; JSON packs don't") from e
    return parse(yaml.safe_load(text))


def save(pack: Pack, path: str) -> None:
    """Write a pack, keys in order: as YAML where the path says so and a YAML writer is installed, else as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise PackError("writing YAML packs needs PyYAML; JSON packs don't") from e
            yaml.safe_dump(pack.to_dict(), f, allow_unicode=True, sort_keys=False)
            return
        json.dump(pack.to_dict(), f, ensure_ascii=False, indent=1)


# References between families: (family, expression of the ids, referred family, its field, severity).
REFERENCES = (
    ("tables", "array(space_id)", "spaces", "id", "error"),
    ("tables", "transform(columns, c -> concat(physical_name, '.', c))", "columns", "concat(table, '.', name)", "warning"),
    ("columns", "array(table)", "tables", "physical_name", "error"),
    ("value_dictionaries", "array(table)", "tables", "physical_name", "error"),
    ("value_dictionaries", "array(concat(table, '.', column))", "columns", "concat(table, '.', name)", "error"),
    ("metrics", "required_tables", "tables", "physical_name", "error"),
    ("business_terms", "related_tables", "tables", "physical_name", "error"),
    ("business_terms", "related_metrics", "metrics", "id", "error"),
    ("join_recipes", "array(left_table)", "tables", "physical_name", "error"),
    ("join_recipes", "array(right_table)", "tables", "physical_name", "error"),
    ("policies", "allowed_tables", "tables", "physical_name", "error"),
    ("policies", "blocked_columns", "columns", "concat(table, '.', name)", "error"),
    ("verified_queries", "related_terms", "business_terms", "id", "error"),
    ("verified_queries", "related_metrics", "metrics", "id", "error"),
)


def reference_findings(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(severity, family, id, kind, detail): ids that are referred to and don't exist; an anti-join a reference."""
    found = None
    for family, ids, to, key, severity in REFERENCES:
        if family not in frames or to not in frames:
            continue
        used = frames[family].select("id", F.explode(F.expr(ids)).alias("ref")).where("ref is not null")
        missing = used.join(frames[to].select(F.expr(key).alias("ref")), "ref", "left_anti")
        one = missing.select(F.lit(severity).alias("severity"), F.lit(family).alias("family"), "id", F.lit(f"unknown_{to}").alias("kind"), F.col("ref").alias("detail"))
        found = one if found is None else found.unionByName(one)
    return found


def duplicate_findings(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Ids that two cards of any families share."""
    every = None
    for family, df in frames.items():
        one = df.select("id", F.lit(family).alias("family"))
        every = one if every is None else every.unionByName(one)
    again = every.groupBy("id").agg(F.count("*").alias("n"), F.min("family").alias("family")).where("n > 1")
    return again.select(F.lit("error").alias("severity"), "family", "id", F.lit("duplicate_id").alias("kind"), F.col("n").cast("string").alias("detail"))


def pii_findings(columns: DataFrame, policies: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """PII columns that no policy blocks, and dictionaries that hold values of PII columns."""
    personal = columns.where("is_pii").select("id", F.concat_ws(".", "table", "name").alias("ref"))
    blocked = policies.select(F.explode("blocked_columns").alias("ref"))
    open_ = personal.join(blocked, "ref", "left_anti").select(F.lit("error").alias("severity"), F.lit("columns").alias("family"), "id", F.lit("pii_not_blocked").alias("kind"), F.col("ref").alias("detail"))
    held = dictionaries.select("id", F.concat_ws(".", "table", "column").alias("ref")).join(personal.select("ref"), "ref", "left_semi")
    return open_.unionByName(held.select(F.lit("error").alias("severity"), F.lit("value_dictionaries").alias("family"), "id", F.lit("pii_values_stored").alias("kind"), F.col("ref").alias("detail")))


def validate(spark: SparkSession, pack: Pack) -> DataFrame:
    """All findings of a pack; none: it is valid."""
    frames = {f: pack.frame(spark, f) for f in FAMILIES}
    return reference_findings(frames).unionByName(duplicate_findings(frames)).unionByName(pii_findings(frames["columns"], frames["policies"], frames["value_dictionaries"]))


def is_valid(spark: SparkSession, pack: Pack) -> bool:
    return validate(spark, pack).where("severity = 'error'").isEmpty()


def roles_limits(policies: DataFrame, role: str | None) -> DataFrame:
    """One row: allowed tables, blocked columns and the smallest row cap of a role's policies; None: of all; unknown: empty sets, cap 0."""
    own = policies if role is None else policies.where(F.array_contains("roles", role))
    return own.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("allowed_tables")))).alias("allowed_tables"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocked_columns")))).alias("blocked_columns"),
        F.coalesce(F.min("max_preview_rows"), F.lit(0)).alias("max_preview_rows"),
    )


def merge(packs: Iterable[Pack]) -> dict[str, list[dict[str, Any]]]:
    """Cards of several packs by family; the later card of an id wins."""
    out: dict[str, dict[str, dict[str, Any]]] = {f: {} for f in FAMILIES}
    for p in packs:
        for f, cards in p.cards.items():
            out[f].update({c["id"]: c for c in cards})
    return {f: list(c.values()) for f, c in out.items()}
