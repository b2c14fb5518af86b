"""Drafts from profiles: semantic types, join candidates, gaps, hypotheses, questions, and a pack for people to confirm.

Everything is an expression over profile rows (operators.profile), one row a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_token
from .packs import Pack

# Parts of column names that hint at what a column holds.
NUMERIC_HINTS = ("amount", "revenue", "sales", "profit", "cost", "price", "total", "quantity", "qty")
DATE_HINTS = ("date", "day", "month", "year", "created", "started", "signup", "ship")
STATUS_HINTS = ("status", "state", "segment", "category", "type", "channel", "country", "region", "market", "plan")
QUESTION_DATES = ("date", "dt", "day", "time", "created", "updated", "paid", "signup", "started")
QUESTION_METRICS = ("amount", "revenue", "sales", "price", "cost", "profit", "margin", "quantity", "qty", "count", "total", "fee")
GENERIC_NAMES = ("status", "type", "category", "code", "name", "description", "value")
VAGUE_COMMENTS = ("status", "type", "code", "value", "data")
SYNTHETIC = "TEST_ONLY_SYNTHETIC_METADATA"
LOW_CONFIDENCE = 0.6
ABSTRACT_NAMES = ("status", "state", "type", "code", "category", "segment", "channel")
GAP_METRICS = ("amount", "revenue", "sales", "profit", "cost", "price", "total", "qty", "quantity", "count")


def hinted(name: Column, hints: tuple[str, ...]) -> Column:
    return name.rlike("|".join(hints))


def inferred_type(name: Column, guess: Column, is_pii: Column) -> Column:
    """The semantic type that inference proposes."""
    n = safe_token(name)
    status = F.when(n.contains("status") | n.contains("state"), "status").otherwise("category")
    return (
        F.when(is_pii, "pii").when(hinted(n, DATE_HINTS) | (guess == "date"), "date").when(hinted(n, NUMERIC_HINTS) & (guess == "number"), "measure")
        .when(n.endswith("_id") | (n == "id"), "identifier").when(hinted(n, STATUS_HINTS), status).when(guess.isin("number", "string", "boolean"), guess).otherwise("unknown")
    )


def drafted_type(name: Column, guess: Column, categories: Column, join_key: Column) -> Column:
    """The semantic type that a draft card states, or null."""
    first = [F.when(F.array_contains(categories, k), k) for k in ("email", "phone", "person_name")]
    return F.coalesce(*first, F.when(join_key, "identifier"), F.when(guess == "date", "date"), F.when(name.endswith("_id"), "foreign_key_candidate"))


def contract_type(guess: Column) -> Column:
    return F.when(guess == "number", "numeric").when(guess.isin("date", "boolean"), guess).otherwise("string")


def table_role(table: Column) -> Column:
    return F.when(table.endswith("s") & table.rlike("payment|order|event|fact"), "fact").otherwise("dimension")


def primary_key(columns: DataFrame, key: str = "table") -> DataFrame:
    """By table, the first column by position that is named id or *_id."""
    found = columns.where((F.col("column") == "id") | F.col("column").endswith("_id"))
    return found.groupBy(key).agg(F.min_by("column", "position").alias("primary_key"))


def join_candidates(columns: DataFrame) -> DataFrame:
    """(join_key, left_table, right_table, tables): names ending in _id that two tables or more have, the first two by name."""
    keys = columns.where(F.col("column").endswith("_id")).groupBy(F.col("column").alias("join_key")).agg(F.array_sort(F.collect_set("table")).alias("tables")).where(F.size("tables") >= 2)
    return keys.select("join_key", F.get("tables", 0).alias("left_table"), F.get("tables", 1).alias("right_table"), F.size("tables").alias("tables"))


def classify_comment(comment: Column) -> Column:
    t = F.trim(F.coalesce(comment, F.lit("")))
    return F.when(t == "", "no_comment").when(t.contains(SYNTHETIC), "test_only_synthetic_comment").otherwise("real_db_comment")


def vague_comment(comment: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(comment, F.lit(""))))
    return (classify_comment(comment) == "real_db_comment") & (t.isin(*VAGUE_COMMENTS) | (F.length(t) < 8))


def conflicting_comment(comment: Column, name: Column, guess: Column) -> Column:
    t, n = F.lower(F.coalesce(comment, F.lit(""))), F.lower(name)
    clash = (t.contains("date") & (guess == "number")) | ((n.contains("amount") | n.contains("price")) & (t.contains("name") | t.contains("identifier")))
    return (classify_comment(comment) == "real_db_comment") & clash


def weak_evidence(null_ratio: Column, cardinality: Column, name: Column) -> Column:
    return (null_ratio >= 0.5) | (cardinality >= 1000) | name.isin(*GENERIC_NAMES)


def column_gaps(comment: Column, name: Column, is_pii: Column, join_key: Column) -> Column:
    """Reasons why a column's metadata needs a person."""
    none, n = classify_comment(comment) == "no_comment", F.lower(name)
    return F.array_compact(F.array(
        F.when(none, "missing_column_comment"), F.when(none & n.isin(*ABSTRACT_NAMES), "abstract_column_without_comment"),
        F.when(is_pii, "pii_policy_needs_confirmation"), F.when(join_key | (n == "id") | n.endswith("_id"), "join_key_ambiguity"),
    ))


def table_gaps(profiles: DataFrame) -> DataFrame:
    """(table, gaps): several date columns or several measures need a decision."""
    n = safe_token(F.col("column"))
    dates = F.count_if((F.col("type_guess") == "date") | hinted(n, QUESTION_DATES))
    measures = F.count_if((F.col("type_guess") == "number") & hinted(n, GAP_METRICS))
    g = profiles.groupBy("table").agg(dates.alias("d"), measures.alias("m"))
    return g.select("table", F.array_compact(F.array(F.when(F.col("d") >= 2, "multiple_candidate_date_columns"), F.when(F.col("m") >= 2, "multiple_metric_like_numeric_columns"))).alias("gaps"))


def coverage(columns: DataFrame) -> DataFrame:
    """(table, coverage, gaps): commented columns over columns + 1, to four decimals, and the number of gaps."""
    commented = F.count_if(classify_comment(F.col("comment")) != "no_comment")
    g = columns.groupBy("table").agg(commented.alias("c"), F.count("*").alias("n"))
    return g.select("table", (F.floor(F.col("c") / (F.col("n") + 1) * 10000 + F.lit(0.5)) / F.lit(10000.0)).alias("coverage"), (F.col("n") - F.col("c")).alias("gaps"))


def hypotheses(profiles: DataFrame) -> DataFrame:
    """(id, kind, target, label, confidence, uncertainties): table, column, metric and policy proposals from profiles."""
    t, c = safe_token(F.col("table")), safe_token(F.col("column"))
    semantic = inferred_type(F.col("column"), F.col("type_guess"), F.col("is_pii"))
    p = profiles.withColumns({"t": t, "c": c, "semantic": semantic})
    is_date, is_measure = F.col("semantic") == "date", (F.col("semantic") == "measure") | ((F.col("type_guess") == "number") & hinted(F.col("c"), NUMERIC_HINTS))

    def row(df: DataFrame, id_: Column, kind: str, target: Column, label: Column, confidence: Column | float, *uncertain: Column) -> DataFrame:
        conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), target.alias("target"), label.alias("label"), conf.cast("double").alias("confidence"), F.array_compact(F.array(*uncertain)).alias("uncertainties"))

    by_table = p.groupBy("table", "t").agg(F.bool_or("join_key_candidate").alias("keyed"), F.bool_or("is_pii").alias("personal"))
    tables = row(by_table, F.concat(F.lit("hyp.table."), "t"), "table", F.concat(F.lit("table."), "t"), F.initcap(F.translate("table", "_", " ")), 0.62, F.lit("confirm_business_grain"), F.when(~F.col("keyed"), "confirm_primary_or_join_key"))
    columns = row(
        p, F.concat_ws(".", F.lit("hyp.column"), "t", "c"), "column", F.concat_ws(".", F.lit("column"), "t", "c"), F.col("column"), F.when(F.col("semantic") != "unknown", 0.7).otherwise(0.45),
        F.lit("confirm_business_definition"), F.when(F.col("is_pii"), "confirm_pii_policy_and_allowed_usage"), F.when(is_measure, "confirm_metric_formula_and_aggregation"), F.when(is_date, "confirm_date_basis"),
    )
    metrics = row(p.where(is_measure & ~F.col("is_pii")), F.concat_ws(".", F.lit("hyp.metric"), "t", "c"), "metric", F.concat_ws(".", F.lit("metric"), "t", "c"), F.initcap(F.translate("column", "_", " ")), 0.52, F.lit("confirm_aggregation"), F.lit("confirm_date_basis"), F.lit("confirm_business_filters"))
    policies = row(by_table.where("personal"), F.concat(F.lit("hyp.policy."), "t", F.lit(".pii_blocklist")), "policy", F.concat(F.lit("policy."), "t", F.lit(".pii_blocklist")), F.concat(F.initcap(F.translate("table", "_", " ")), F.lit(" PII blocklist")), 0.78, F.lit("confirm_role_scope"), F.lit("confirm_allowed_aggregations"))
    keys = p.where("join_key_candidate or c like '%\\\\_id'").groupBy("c").agg(F.size(F.collect_set("table")).alias("n")).where("n >= 2")
    joins = row(keys, F.concat(F.lit("hyp.join."), "c"), "join", F.concat(F.lit("join."), "c"), F.concat(F.lit("Candidate join on "), "c"), 0.5, F.lit("confirm_join_cardinality"), F.lit("confirm_join_condition"))
    return reduce(DataFrame.unionByName, [tables, columns, metrics, policies, joins])


def uncertainty_category(label: Column) -> Column:
    t = F.lower(label)
    return (
        F.when(t.rlike("date|period"), "ambiguous_date_basis").when(t.rlike("join|relationship"), "join_relationship").when(t.rlike("pii|policy|blocked"), "pii_policy")
        .when(t.rlike("metric|aggregation|filter"), "metric_definition").otherwise("low_confidence")
    )


def uncertain(hypotheses: DataFrame) -> DataFrame:
    """(target, category, question, priority): one for each hypothesis of low confidence, and one for each uncertainty."""
    low = hypotheses.where(F.col("confidence") < LOW_CONFIDENCE).select("target", F.lit("low_confidence").alias("category"), F.concat(F.lit("What would confirm or refute "), "target", F.lit("?")).alias("question"), F.lit("high").alias("priority"))
    each = hypotheses.select("target", F.explode("uncertainties").alias("u")).withColumn("category", uncertainty_category(F.col("u")))
    priority = F.when(F.col("category").isin("pii_policy", "ambiguous_date_basis"), "high").otherwise("medium")
    return low.unionByName(each.select("target", "category", F.concat("target", F.lit(": "), F.translate("u", "_", " "), F.lit("?")).alias("question"), priority.alias("priority")))


def questions(profiles: DataFrame, hypotheses: DataFrame | None = None, tables: Sequence[str] = ()) -> DataFrame:
    """(id, category, target, question, priority) for people to answer; ids are hashes of what is asked, so they stay.

    Eight categories: metric_definition, join_relationship, pii_policy, missing_evidence, ambiguous_date_basis; from a column `comment` of the
    profiles, where they have one, comment_clarification and comment_profile_conflict; from hypotheses their uncertainties, of which low_confidence is
    a category of its own; and missing_evidence with high priority for those of `tables` that have no profiled column, or for an input without any.
    """
    if "comment" not in profiles.columns:
        profiles = profiles.withColumn("comment", F.lit(None).cast("string"))
    n, target = safe_token(F.col("column")), F.concat_ws(".", F.lit("column"), "table", "column")
    p = profiles.withColumns({"n": n, "target": target, "ref": F.concat_ws(".", "table", "column")})
    rules = F.array(
        F.when((F.col("type_guess") == "number") | hinted(F.col("n"), QUESTION_METRICS), F.struct(F.lit("metric_definition").alias("category"), F.concat(F.lit("Should "), "ref", F.lit(" become a metric, and with which filters, aggregation, unit and date basis?")).alias("question"), F.lit("medium").alias("priority"))),
        F.when(F.col("join_key_candidate") | (F.col("n") == "id") | F.col("n").endswith("_id"), F.struct(F.lit("join_relationship").alias("category"), F.concat(F.lit("Which table does "), "ref", F.lit(" join to, and with what cardinality?")).alias("question"), F.lit("medium").alias("priority"))),
        F.when(F.col("is_pii"), F.struct(F.lit("pii_policy").alias("category"), F.concat(F.lit("Which roles may use "), "ref", F.lit(", and do its raw values stay blocked?")).alias("question"), F.lit("high").alias("priority"))),
        F.when(vague_comment(F.col("comment")), F.struct(F.lit("comment_clarification").alias("category"), F.concat(F.lit("The comment on "), "ref", F.lit(" is vague: what exactly does it hold?")).alias("question"), F.lit("medium").alias("priority"))),
        F.when(conflicting_comment(F.col("comment"), F.col("n"), F.col("type_guess")), F.struct(F.lit("comment_profile_conflict").alias("category"), F.concat(F.lit("Comment and values of "), "ref", F.lit(" disagree: which is right?")).alias("question"), F.lit("high").alias("priority"))),
        F.when(weak_evidence(F.col("null_ratio"), F.col("cardinality"), F.col("n")) & ((classify_comment(F.col("comment")) != "real_db_comment") | vague_comment(F.col("comment"))), F.struct(F.lit("missing_evidence").alias("category"), F.concat(F.lit("What does "), "ref", F.lit(" mean?")).alias("question"), F.lit("medium").alias("priority"))),
    )
    asked = p.select("target", F.explode(F.array_compact(rules)).alias("q")).select("target", "q.*")
    dates = p.where((F.col("type_guess") == "date") | hinted(F.col("n"), QUESTION_DATES)).groupBy("table").agg(F.array_sort(F.collect_set("n")).alias("d")).where(F.size("d") >= 2)
    dates = dates.select(F.concat(F.lit("table."), "table").alias("target"), F.lit("ambiguous_date_basis").alias("category"), F.concat(F.lit("Which date is the default of "), "table", F.lit(": "), F.array_join("d", ", "), F.lit("?")).alias("question"), F.lit("high").alias("priority"))
    every = asked.unionByName(dates)
    if hypotheses is not None:
        every = every.unionByName(uncertain(hypotheses))
    spark = profiles.sparkSession
    if tables:
        bare = spark.createDataFrame([(t,) for t in tables], "table string").join(profiles.select("table").distinct(), "table", "left_anti")
        every = every.unionByName(bare.select(F.concat(F.lit("table."), "table").alias("target"), F.lit("missing_evidence").alias("category"), F.concat("table", F.lit(" has no profiled column: leave it out, or scan it again?")).alias("question"), F.lit("high").alias("priority")))
    nothing = profiles.agg(F.count("*").alias("n")).where("n = 0")
    every = every.unionByName(nothing.select(F.lit("profiles").alias("target"), F.lit("missing_evidence").alias("category"), F.lit("Nothing was profiled: which tables are to be included?").alias("question"), F.lit("high").alias("priority")))
    key = F.substring(F.sha1(F.concat_ws("|", "category", "target", "question")), 1, 10)
    return every.select(F.concat(F.lit("question."), "category", F.lit("."), key).alias("id"), "category", "target", "question", "priority").distinct()


def draft_pack(profiles: DataFrame, pack_id: str, space: str = "local_files") -> Pack:
    """A draft pack of profiled tables: cards, dictionaries of safe values, and a policy that blocks personal columns.

    Profiles have one row a column of the catalog; they are what the driver reads, never data.
    """
    rows = [r.asDict(recursive=True) for r in profiles.orderBy("table", "column").toLocalIterator()]
    tables = sorted({r["table"] for r in rows})
    own = {t: [r for r in rows if r["table"] == t] for t in tables}
    blocked = sorted(f"{r['table']}.{r['column']}" for r in rows if r["is_pii"])
    kinds = {"number": "numeric", "date": "date", "boolean": "boolean"}
    cards = {
        "spaces": [{"id": space, "title": space, "description": ""}],
        "tables": [{
            "id": f"table.{t}", "space_id": space, "physical_name": t, "title": t.replace("_", " ").title(), "description": "Drafted from a profile.", "role": "fact" if t.endswith("s") and any(k in t for k in ("payment", "order", "event", "fact")) else "dimension",
            "columns": [r["column"] for r in own[t]], "primary_key": next((r["column"] for r in own[t] if r["column"] == "id" or r["column"].endswith("_id")), None), "pii_level": "contains_pii" if any(r["is_pii"] for r in own[t]) else "none", "status": "draft", "confidence": 0.5,
        } for t in tables],
        "columns": [{"id": f"column.{r['table']}.{r['column']}", "table": r["table"], "name": r["column"], "data_type": kinds.get(r["type_guess"], "string"), "nullable": r["null_count"] > 0, "is_pii": r["is_pii"], "description": "Personal; raw values are blocked." if r["is_pii"] else "Drafted from a profile.", "status": "draft"} for r in rows],
        "value_dictionaries": [{"id": f"values.{r['table']}.{r['column']}", "table": r["table"], "column": r["column"], "values": [{"value": v["value"], "label": v["value"], "count": v["count"]} for v in r["top_values"]], "status": "draft"} for r in rows if r["top_values"] and not r["is_pii"]],
        "policies": [{"id": "policy.default", "roles": ["analyst"], "allowed_tables": tables, "blocked_columns": blocked, "max_preview_rows": 100, "notes": []}],
    }
    return Pack(pack_id, cards=cards)
