"""Packs, cards, drafts, provenance, coverage, evaluation summaries and lifecycle arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import norm_query
from ..operators import cards as C
from ..operators import draft as D
from ..operators import packs as K
from ..operators.rank import retrieval_metrics
from ..sources.database import ScanConfig, limit_columns, select_tables
from ..tables import table
from . import demo, derived
from .kit import Book, values, values_sql

B = Book()

_V = derived.CATALOG


@B.add(f"SELECT col AS join_key, list_sort(list(DISTINCT tab))[1] AS left_table, list_sort(list(DISTINCT tab))[2] AS right_table, CAST(count(DISTINCT tab) AS INT) AS tables FROM {_V} WHERE ends_with(col, '_id') GROUP BY col HAVING count(DISTINCT tab) >= 2")
def join_candidates(spark, sf):
    return D.join_candidates(derived.columns(spark, sf))


@B.add("SELECT 'orders' AS table_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'customer', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'part', p_brand, count(*) FROM part WHERE (SELECT count(DISTINCT p_brand) FROM part) <= 20 GROUP BY 2")
def value_dictionary(spark, sf):
    """Values of columns with at most twenty of them and no personal data by name."""
    from ..operators.profile import LOW_CARDINALITY, value_counts

    parts = []
    for t, c in (("orders", "o_orderstatus"), ("customer", "c_mktsegment"), ("part", "p_brand")):
        counts = value_counts(table(spark, sf, t), [c]).where("value is not null")
        few = counts.groupBy("column").agg(F.count("*").alias("kinds")).where((F.col("kinds") <= LOW_CARDINALITY) & (F.size(pii.name_categories(F.col("column"))) == 0))
        parts.append(counts.join(few, "column", "left_semi").select(F.lit(t).alias("table_name"), "value", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@B.add(f"SELECT r.id, r.ref AS detail, 'unknown_tables' AS kind FROM {derived.sql('refs')} r WHERE r.ref IS NOT NULL AND r.ref NOT IN (SELECT DISTINCT tab FROM {_V})")
def pack_reference_errors(spark, sf):
    metrics = derived.relation(spark, sf, "refs").select("id", F.array("ref").alias("required_tables"))
    frames = {"metrics": metrics, "tables": derived.columns(spark, sf).select(F.col("table").alias("physical_name")).distinct()}
    return K.reference_findings(frames).select("id", "detail", "kind")


@B.add(f"SELECT id, CAST(count(*) AS VARCHAR) AS detail FROM {derived.sql('ids')} GROUP BY id HAVING count(*) > 1")
def pack_duplicate_ids(spark, sf):
    every = derived.relation(spark, sf, "ids")
    return K.duplicate_findings({f: every.where(F.col("family") == f).select("id") for f in ("tables", "columns", "metrics", "policies")}).select("id", "detail")


@B.add(f"SELECT concat('column.', col) AS id, concat(tab, '.', col) AS detail FROM {_V} WHERE col IN ('customer_name') AND concat(tab, '.', col) NOT IN ('customer.none')")
def pack_pii_policy_gaps(spark, sf):
    columns = derived.columns(spark, sf).select(F.concat(F.lit("column."), "column").alias("id"), "table", F.col("column").alias("name"), (F.size(pii.name_categories(F.col("column"))) > 0).alias("is_pii"))
    policies = values(spark, "blocked", [("customer.none",)]).select(F.array("blocked").alias("blocked_columns"))
    none = columns.select("id", "table", F.col("name").alias("column")).where("false")
    return K.pii_findings(columns, policies, none).select("id", "detail")


@B.add("SELECT * FROM (VALUES ('space', CAST(1 AS BIGINT)), ('table', 3), ('column', 10), ('value_dictionary', 1), ('metric', 2), ('business_term', 1), ('join_recipe', 2), ('policy', 1), ('verified_query', 1), ('reverse_question', 1)) AS v(card_type, n)")
def cards_by_family(spark, sf):
    return C.cards(spark, demo.pack()).groupBy("card_type").agg(F.count("*").alias("n"))


@B.add("SELECT * FROM (VALUES ('metric.net_revenue', 'net revenue', 'approved'), ('metric.gross_revenue', 'gross revenue', 'draft'), ('term.new_customer', 'new customers', 'approved'), ('table.orders', 'Orders', 'approved'), ('table.lineitem', 'Lines', 'approved'), ('table.customer', 'Customers', 'approved')) AS v(card_id, title, status)")
def card_titles(spark, sf):
    return C.cards(spark, demo.pack()).where(C.of_type(F.col("card_type"), ["metrics", "terms", "table"])).select("card_id", "title", "status")


_NORM = "trim(regexp_replace(translate(lower({}), '_.-', '   '), '\\s+', ' ', 'g'))"
_KEYED = f"""(SELECT k, arg_max(id, pos) AS id FROM (SELECT pos, id, {_NORM.format('label')} AS k FROM {derived.sql('terms')} UNION ALL SELECT pos, id, {_NORM.format('id')} FROM {derived.sql('terms')}
UNION ALL SELECT pos, id, {_NORM.format("regexp_replace(id, '^term[.]', '')")} FROM {derived.sql('terms')}) GROUP BY k)"""


def _resolved(spark, sf):
    """Keys of terms, the later term winning, and what was asked for."""
    terms = derived.relation(spark, sf, "terms")
    keys = terms.select("pos", "id", F.explode(F.array("label", "id", F.regexp_replace("id", r"^term\.", ""))).alias("key")).select(norm_query(F.col("key")).alias("k"), "pos", "id")
    last = keys.groupBy("k").agg(F.max_by("id", "pos").alias("id"))
    return derived.relation(spark, sf, "asked").withColumn("k", norm_query(F.col("asked"))), last


@B.add(f"SELECT asked, id FROM {derived.sql('asked')} a JOIN {_KEYED} k ON {_NORM.format('asked')} = k.k")
def resolve_terms(spark, sf):
    asked, last = _resolved(spark, sf)
    return asked.join(last, "k").select("asked", "id")


@B.add(f"SELECT asked FROM {derived.sql('asked')} a WHERE {_NORM.format('asked')} NOT IN (SELECT k FROM {_KEYED})")
def unresolved_terms(spark, sf):
    asked, last = _resolved(spark, sf)
    return asked.join(last, "k", "left_anti").select("asked")


@B.add(f"""SELECT query, floor((CASE WHEN count(id) = 0 THEN 1.0::DOUBLE ELSE count(rank) / CAST(greatest(count(id), 1) AS DOUBLE) END) * 1000000 + 0.5) / 1000000.0 AS recall,
floor(coalesce(1 / CAST(min(rank) AS DOUBLE), 0.0) * 1000000 + 0.5) / 1000000.0 AS mrr, CAST(coalesce(min(rank), 0) AS INT) AS first_rank, array_to_string(list_sort(list(id) FILTER (rank IS NULL AND id IS NOT NULL)), ',') AS missing
FROM (SELECT e.query, e.id, r.rank FROM {derived.sql('wanted')} e LEFT JOIN (SELECT * FROM {derived.sql('ranks')} WHERE rank <= 10) r ON e.query = r.query AND e.id = r.id) GROUP BY query""".replace("array_to_string(list_sort(list(id) FILTER (rank IS NULL AND id IS NOT NULL)), ',')", "coalesce(array_to_string(list_sort(list(id) FILTER (rank IS NULL AND id IS NOT NULL)), ','), '')"))
def retrieval_metric_rows(spark, sf):
    return retrieval_metrics(derived.relation(spark, sf, "ranks"), derived.relation(spark, sf, "wanted")).withColumn("missing", F.array_join("missing", ",")).withColumn("first_rank", F.coalesce("first_rank", F.lit(0)))


@B.add(f"SELECT suite, CAST(count(*) FILTER (status = 'passed') AS BIGINT) AS passed, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skipped, count(*) AS total FROM {derived.sql('cases')} GROUP BY 1")
def eval_summary(spark, sf):
    from ..operators.evaluate import summary

    return summary(derived.relation(spark, sf, "cases"), "suite")


@B.add(f"SELECT status, CAST(count(*) FILTER (suite = 'golden') AS BIGINT) AS golden, CAST(count(*) FILTER (suite = 'red_team') AS BIGINT) AS red_team, CAST(count(*) FILTER (suite = 'retrieval') AS BIGINT) AS retrieval FROM {derived.sql('cases')} GROUP BY 1")
def eval_pivot(spark, sf):
    p = derived.relation(spark, sf, "cases").groupBy("status").pivot("suite", ["golden", "red_team", "retrieval"]).count()
    return p.na.fill(0)


_PLANNED = [("region", 5), ("nation", 25), ("customer", 1), ("ghost", 3)]


@B.add(f"SELECT coalesce(p.t, a.t) AS table_name, coalesce(p.n, -1) AS planned, coalesce(a.n, -1) AS loaded, p.n IS NOT DISTINCT FROM a.n AS equal FROM {values_sql('t, n', _PLANNED)} p FULL JOIN (SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier) a ON p.t = a.t")
def corpus_reconcile(spark, sf):
    actual = [table(spark, sf, t).agg(F.count("*").alias("loaded")).withColumn("t", F.lit(t)) for t in ("region", "nation", "supplier")]
    planned = values(spark, "t, n", _PLANNED).select("t", F.col("n").alias("planned"))
    both = planned.join(actual[0].unionByName(actual[1]).unionByName(actual[2]), "t", "full")
    return both.select(F.col("t").alias("table_name"), F.coalesce("planned", F.lit(-1)).cast("long").alias("planned"), F.coalesce("loaded", F.lit(-1)).alias("loaded"), F.col("planned").eqNullSafe(F.col("loaded")).alias("equal"))


_CV = derived.sql("comments")
_KIND = "CASE WHEN trim(coalesce(comment, '')) = '' THEN 'no_comment' WHEN contains(comment, 'TEST_ONLY_SYNTHETIC_METADATA') THEN 'test_only_synthetic_comment' ELSE 'real_db_comment' END"


def _commented(spark, sf):
    return derived.relation(spark, sf, "comments").select(F.col("tab").alias("table"), F.col("col").alias("column"), "comment", "guess")


@B.add(f"SELECT tab AS table_name, floor(CAST(count(*) FILTER ({_KIND} <> 'no_comment') AS DOUBLE) / (count(*) + 1) * 10000 + 0.5) / 10000.0 AS coverage, CAST(count(*) FILTER ({_KIND} = 'no_comment') AS BIGINT) AS gaps FROM {_CV} GROUP BY 1")
def coverage_and_gaps(spark, sf):
    return D.coverage(_commented(spark, sf)).withColumnRenamed("table", "table_name")


@B.add(f"""SELECT col AS column_name, {_KIND} AS kind, {_KIND} = 'real_db_comment' AND (lower(trim(comment)) IN ('status', 'type', 'code', 'value', 'data') OR length(trim(comment)) < 8) AS vague,
{_KIND} = 'real_db_comment' AND ((contains(lower(comment), 'date') AND guess = 'number') OR (regexp_matches(col, 'amount|price') AND regexp_matches(lower(comment), 'name|identifier'))) AS conflicting, col IN ('status', 'type', 'category', 'code', 'name', 'description', 'value') AS weak FROM {_CV}""")
def comment_rules(spark, sf):
    c = F.col("comment")
    return _commented(spark, sf).select(
        F.col("column").alias("column_name"), D.classify_comment(c).alias("kind"), D.vague_comment(c).alias("vague"), D.conflicting_comment(c, F.col("column"), F.col("guess")).alias("conflicting"),
        D.weak_evidence(F.lit(0.0), F.lit(1), F.col("column")).alias("weak"),
    )


_TOKEN = "coalesce(nullif(trim(regexp_replace(lower(name), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'table')"


@B.add(f"SELECT pos, CASE WHEN rn = 1 THEN t ELSE t || '_' || rn END AS table_name FROM (SELECT pos, t, row_number() OVER (PARTITION BY t ORDER BY pos) AS rn FROM (SELECT pos, {_TOKEN} AS t FROM {derived.sql('names')}))")
def name_suffixes(spark, sf):
    from ..functions.text import table_token

    named = derived.relation(spark, sf, "names").withColumn("t", table_token(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("t").orderBy("pos"))
    return named.withColumn("nth", nth).select("pos", F.when(F.col("nth") == 1, F.col("t")).otherwise(F.concat_ws("_", "t", F.col("nth").cast("string"))).alias("table_name"))


@B.add(f"SELECT DISTINCT table_schema, table_name, kind FROM {derived.sql('catalog')} WHERE table_schema IN ('nation_1', 'nation_7') ORDER BY 1, 2, 3 LIMIT 3")
def db_select_tables(spark, sf):
    return select_tables(derived.relation(spark, sf, "catalog"), ScanConfig(schemas=("nation_1", "nation_7"), max_tables=3))


@B.add(f"SELECT tab AS table_name, col AS column_name FROM (SELECT tab, col, row_number() OVER (PARTITION BY tab ORDER BY position, col) AS nth FROM {_V}) WHERE nth <= 2")
def db_limit_columns(spark, sf):
    c = derived.columns(spark, sf).select(F.lit("public").alias("table_schema"), F.col("table").alias("table_name"), F.col("column").alias("column_name"), F.col("position").alias("ordinal_position"))
    return limit_columns(c, ScanConfig(max_columns=2)).select("table_name", "column_name")


@B.add(f"SELECT id, string_agg(k || '=' || regexp_replace(v, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{{2,}}', '<redacted_email>', 'g'), ';' ORDER BY k) AS entries FROM {derived.sql('maps')} WHERE k NOT IN ({', '.join(repr(k) for k in pii.RAW_KEYS)}) GROUP BY id")
def sanitise_map(spark, sf):
    m = derived.relation(spark, sf, "maps").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    safe = F.transform_values(F.map_filter("m", lambda k, v: ~k.isin(*pii.RAW_KEYS)), lambda k, v: pii.redact(v))
    return m.select("id", F.array_join(F.array_sort(F.transform(F.map_entries(safe), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("entries"))


@B.add(f"SELECT tab AS table_name, col AS column_name, CAST(position AS INT) AS position FROM {_V}")
def explode_report(spark, sf):
    nested = derived.columns(spark, sf).groupBy("table").agg(F.collect_list(F.struct("column", "position")).alias("columns"))
    return nested.select(F.col("table").alias("table_name"), F.explode("columns").alias("c")).select("table_name", F.col("c.column").alias("column_name"), F.col("c.position").alias("position"))


_PV = derived.sql("provenances")


@B.add(f"SELECT id, bool_or(can_use_for_text2sql) AND NOT bool_or(is_test_only) AS usable, array_to_string(list_sort(list(DISTINCT metadata_source)), ',') AS sources, bool_or(requires_human_confirmation) AS needs_confirmation FROM {_PV} GROUP BY id")
def provenance_rollup(spark, sf):
    rows = derived.relation(spark, sf, "provenances")
    rolled = rows.groupBy("id").agg(F.collect_set(F.struct(*[c for c in rows.columns if c != "id"])).alias("p")).select("id", C.provenance(F.col("p")).alias("r"))
    return rolled.select("id", "r.usable", F.array_join("r.sources", ",").alias("sources"), "r.needs_confirmation")


@B.add(f"SELECT tab AS table_name, string_agg(col, ',' ORDER BY col) AS columns, count(*) AS n FROM {_V} GROUP BY tab")
def schema_snapshot(spark, sf):
    """Names of the columns of every table that hold a value: what may be shown to a model that sees no data."""
    snapshot = derived.columns(spark, sf).groupBy(F.col("table").alias("table_name")).agg(F.array_sort(F.collect_list("column")).alias("c"))
    return snapshot.select("table_name", F.array_join("c", ",").alias("columns"), F.size("c").cast("long").alias("n"))


@B.add(f"SELECT tab AS table_name, bool_or(col IN ('customer_name')) AS has_pii FROM {_V} GROUP BY tab")
def table_pii_level(spark, sf):
    return derived.columns(spark, sf).groupBy(F.col("table").alias("table_name")).agg(F.bool_or(F.size(pii.name_categories(F.col("column"))) > 0).alias("has_pii"))


@B.add(f"SELECT array_to_string(list_sort(list(tab || '.' || col)), ',') AS blocked FROM {_V} WHERE col IN ('customer_name')")
def blocklist_policy(spark, sf):
    blocked = derived.columns(spark, sf).where(F.size(pii.name_categories(F.col("column"))) > 0).agg(F.array_sort(F.collect_list(F.concat_ws(".", "table", "column"))).alias("b"))
    return blocked.select(F.array_join("b", ",").alias("blocked"))


@B.add(f"""SELECT tab AS table_name, col AS column_name, CASE WHEN col = 'customer_name' THEN 'person_name' WHEN regexp_matches(col, '_date$') THEN 'date' WHEN col LIKE '%\\_id' ESCAPE '\\' THEN 'foreign_key_candidate' END AS drafted,
CASE WHEN col IN ('customer_name') THEN 'pii' WHEN regexp_matches(col, 'date|day|month|year|created|started|signup|ship') THEN 'date' WHEN regexp_matches(col, 'amount|price') THEN 'measure' WHEN col LIKE '%\\_id' ESCAPE '\\' OR col = 'id' THEN 'identifier' WHEN contains(col, 'status') OR contains(col, 'state') THEN 'status' WHEN regexp_matches(col, 'segment|category|type|channel|country|region|market|plan') THEN 'category' ELSE 'string' END AS inferred,
CASE WHEN regexp_matches(tab, 's$') AND regexp_matches(tab, 'payment|order|event|fact') THEN 'fact' ELSE 'dimension' END AS role FROM {_V}""")
def draft_semantic_types(spark, sf):
    guess = F.when(F.col("column").rlike("_date$"), "date").when(F.col("column").rlike("amount|price"), "number").otherwise("string")
    c = derived.columns(spark, sf).withColumn("guess", guess).withColumn("pii", pii.name_categories(F.col("column")))
    return c.select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), D.drafted_type(F.col("column"), F.col("guess"), F.col("pii"), F.lit(False)).alias("drafted"),
        D.inferred_type(F.col("column"), F.col("guess"), F.size("pii") > 0).alias("inferred"), D.table_role(F.col("table")).alias("role"),
    )


@B.add(f"SELECT tab AS table_name, arg_min(col, position) AS primary_key FROM {_V} WHERE col = 'id' OR col LIKE '%\\_id' ESCAPE '\\' GROUP BY tab")
def draft_primary_keys(spark, sf):
    return D.primary_key(derived.columns(spark, sf)).withColumnRenamed("table", "table_name")


@B.add(f"SELECT pack, major || '.' || minor || '.' || (patch + 1) AS next_version FROM (SELECT pack, CAST(split_part(v, '.', 1) AS INT) AS major, CAST(split_part(v, '.', 2) AS INT) AS minor, CAST(split_part(v, '.', 3) AS INT) AS patch, row_number() OVER (PARTITION BY pack ORDER BY CAST(split_part(v, '.', 1) AS INT) DESC, CAST(split_part(v, '.', 2) AS INT) DESC, CAST(split_part(v, '.', 3) AS INT) DESC) AS rn FROM {derived.sql('versions')}) WHERE rn = 1")
def next_version(spark, sf):
    from ..operators.lifecycle import next_patch

    return next_patch(derived.relation(spark, sf, "versions"), "pack", "v")


_DRAFTED = {"labels": None, "events": None, "part": None, "documents": ["doc_id", "lang", "source", "n_chars"]}
_DRAFTED_SQL = f"(SELECT * FROM {_V} WHERE tab IN ({', '.join(repr(t) for t in _DRAFTED)}) AND col <> 'text')"


@B.add(f"""SELECT 'hyp.table' AS kind, count(DISTINCT tab) AS n, 0.62::DOUBLE AS confidence FROM {_DRAFTED_SQL} UNION ALL SELECT 'hyp.metric', count(*), 0.52 FROM {_DRAFTED_SQL} WHERE regexp_matches(col, '{"|".join(D.NUMERIC_HINTS)}')
UNION ALL SELECT 'hyp.join', count(*), 0.5 FROM (SELECT col FROM {_DRAFTED_SQL} WHERE ends_with(col, '_id') GROUP BY col HAVING count(DISTINCT tab) >= 2)""")
def hypotheses_by_kind(spark, sf):
    """Proposals from the profiles of four tables."""
    from ..operators.profile import profile

    parts = [profile(table(spark, sf, t), t, columns) for t, columns in _DRAFTED.items()]
    profiles = parts[0]
    for p in parts[1:]:
        profiles = profiles.unionByName(p)
    h = D.hypotheses(profiles).where("kind <> 'column'")
    return h.groupBy(F.concat(F.lit("hyp."), "kind").alias("kind")).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


QUERIES, ORACLES = B.queries, B.oracles
