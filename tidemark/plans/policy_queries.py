"""Planning, guarding, previewing and comparing SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as M
from ..operators import guard as G
from ..operators import packs as K
from ..operators import planner as Q
from ..operators import preview as V
from ..tables import register, table
from . import demo, derived
from .kit import Book, values, values_sql

B = Book()
START = "1995-01-01"
_NET = demo.NET_REVENUE_SQL.replace(":start_date", f"'{START}'").replace("date_trunc('MONTH'", "date_trunc('month'")


def _session(spark, sf, *names):
    own = spark.newSession()
    register(own, sf, names)
    return own


@B.add(_NET.replace("CAST(date_trunc('month', o.o_orderdate) AS DATE) AS order_month", "CAST(CAST(date_trunc('month', o.o_orderdate) AS DATE) AS VARCHAR) AS order_month"))
def verified_query_monthly_net_revenue(spark, sf):
    """The demo question end to end: plan, trusted SQL, guard, run."""
    plan = Q.plan([demo.pack()], demo.QUESTION, "analyst")
    own = _session(spark, sf, "orders", "lineitem", "customer")
    limits = K.roles_limits(demo.pack().frame(spark, "policies"), "analyst").head()
    report = G.check(own, plan.sql.replace(":start_date", f"'{START}'"), limits.allowed_tables, limits.blocked_columns)
    if not report.passed:
        raise PermissionError("; ".join(report.errors))
    return own.sql(plan.sql, args={"start_date": START}).withColumn("order_month", F.col("order_month").cast("string"))


@B.add("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross_revenue, count(*) AS n FROM lineitem")
def baseline_gross_revenue(spark, sf):
    return table(spark, sf, "lineitem").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("gross_revenue"), F.count("*").alias("n"))


@B.add("""SELECT c_mktsegment, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS net_revenue, count(DISTINCT o_orderkey) AS n_orders
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def metric_by_segment(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    joined = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return joined.groupBy("c_mktsegment").agg(F.sum(net).cast("double").alias("net_revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


_STATEMENTS = [
    (1, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", (1, 1, 1, 1)),
    (2, "DELETE FROM orders", (1, 0, None, None)), (3, "SELECT 1; SELECT 2", (0, 1, None, None)), (4, "SELECT * FROM supplier", (1, 1, 0, None)), (5, "SELECT c_name FROM customer", (1, 1, 1, 0)),
    (6, "SELECT * FROM customer", (1, 1, 1, 0)), (7, "SELECT COUNT(*) AS n FROM customer", (1, 1, 1, 1)), (8, "WITH a AS (SELECT c_custkey FROM customer) SELECT * FROM a", (1, 1, 1, 1)),
    (9, "SELECT c_mktsegment FROM customer UNION SELECT c_name FROM customer", (1, 1, 1, 0)), (10, "SELECT c_custkey FROM customer WHERE c_name LIKE 'A%'", (1, 1, 1, 0)),
    (11, "SELECT o.o_orderkey FROM orders o, customer c WHERE o.o_custkey = c.c_custkey", (1, 1, 1, 1)), (12, "DROP TABLE orders", (1, 0, None, None)),
    (13, "SELECT x FROM (SELECT c_name AS x FROM customer) t", (1, 1, 1, 0)), (14, "SELECT replace(o_orderstatus, 'F', 'G') AS s FROM orders", (1, 1, 1, 1)), (15, "SELECT o_orderkey FROM orders;", (1, 1, 1, 1)),
]
_SAY = {1: "pass", 0: "fail", None: "skipped"}


@B.add(f"SELECT * FROM {values_sql('sql_id, single_statement, select_only, allowed_tables, blocked_columns, passed', [(i, *(_SAY[c] for c in checks), checks == (1, 1, 1, 1)) for i, _, checks in _STATEMENTS])}")
def guard_batch(spark, sf):
    own = _session(spark, sf, "orders", "customer", "lineitem", "supplier")
    return G.check_batch(own, values(own, "sql_id, sql", [(i, s) for i, s, _ in _STATEMENTS]), ["orders", "customer", "lineitem"], ["customer.c_name"])


_PROFILED = [
    (1, "SELECT o_orderstatus, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > '1996-01-01' GROUP BY o_orderstatus", "customer,orders", 1, "sum", "o_orderdate", "o_orderstatus", False),
    (2, "SELECT count(*) AS n FROM lineitem LIMIT 5", "lineitem", 0, "count", "", "", True),
    (3, "SELECT a.x FROM (SELECT max(l_tax) AS x, l_orderkey FROM lineitem WHERE l_quantity > 3 GROUP BY l_orderkey) a", "lineitem", 0, "max", "l_quantity", "l_orderkey", False),
]


@B.add(f"SELECT * FROM {values_sql('sql_id, tables, joins, aggregates, filters, group_by, has_limit', [(i, *rest) for i, _, *rest in _PROFILED])}")
def sql_profile_batch(spark, sf):
    rows = []
    for i, sql, *_ in _PROFILED:
        p = G.profile_sql(spark, sql)
        rows.append((i, ",".join(p["tables"]), p["joins"], ",".join(p["aggregates"]), ",".join(p["filters"]), ",".join(p["group_by"]), p["limit"]))
    return spark.createDataFrame(rows, "sql_id int, tables string, joins int, aggregates string, filters string, group_by string, has_limit boolean")


@B.add("SELECT * FROM (VALUES ('wrong_date_basis', 'ask'), ('missing_filter', 'ask'), ('blocked_column', 'reject'), ('equal', 'use')) AS v(case_name, recommendation)")
def sql_differences(spark, sf):
    own = _session(spark, sf, "orders", "customer", "lineitem")
    trusted = "SELECT sum(o_totalprice) AS s FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderstatus = 'F'"
    cases = [
        ("wrong_date_basis", "SELECT sum(l_extendedprice) AS s FROM lineitem WHERE l_shipdate >= '1996-01-01'"), ("missing_filter", "SELECT sum(o_totalprice) AS s FROM orders WHERE o_orderdate >= '1996-01-01'"),
        ("blocked_column", "SELECT c_name FROM customer"), ("equal", trusted),
    ]
    rows = [(n, M.compare(own, sql, trusted, ["orders", "customer", "lineitem"], ["customer.c_name"])["recommendation"]) for n, sql in cases]
    return spark.createDataFrame(rows, "case_name string, recommendation string")


@B.add("SELECT * FROM (VALUES ('metrics', 'metric.net_revenue'), ('terms', 'term.new_customer'), ('verified', 'verified.monthly_net_revenue'), ('open_questions', 'question.returns'), ('ambiguities', 'ambiguity.refunds')) AS v(kind, card_id)")
def query_understanding(spark, sf):
    u = Q.understand([demo.pack()], "Monthly net revenue of new customers?")
    rows = [(k, m.card_id) for k in ("terms", "metrics", "verified", "open_questions", "ambiguities") for m in getattr(u, k)]
    return spark.createDataFrame(rows, "kind string, card_id string")


@B.add(f"SELECT token, card_id FROM (SELECT card_id, unnest(string_split(label, ' ')) AS token FROM {derived.sql('cards')}) JOIN (SELECT DISTINCT unnest(string_split(q, ' ')) AS token FROM {derived.sql('spoken')}) USING (token)")
def expected_semantics(spark, sf):
    """Cards that share a word with a question, unlike the planner's whole-phrase rule."""
    cards = derived.relation(spark, sf, "cards")
    tokens = derived.relation(spark, sf, "spoken").select(F.explode(F.split("q", " ")).alias("token")).distinct()
    return cards.select("card_id", F.explode(F.split("label", " ")).alias("token")).join(tokens, "token").select("token", "card_id")


_VERIFIED = [(1, "SELECT o_orderkey FROM orders WHERE o_orderdate > '1996-01-01' AND o_orderstatus = 'F'", True), (2, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", False), (3, "SELECT o_orderkey FROM orders", False)]


@B.add(f"SELECT sql_id, ok FROM {values_sql('sql_id, q, ok', _VERIFIED)}")
def semantic_verifier(spark, sf):
    """Whether every column that the trusted query filters by is filtered by."""
    need = {"o_orderdate", "o_orderstatus"}
    return spark.createDataFrame([(i, need <= set(G.profile_sql(spark, s)["filters"])) for i, s, _ in _VERIFIED], "sql_id int, ok boolean")


_SHAPES = [(1, "SELECT 1 AS x", True, False), (2, "SELECT 1 AS x LIMIT 3", True, True), (3, "INSERT INTO t VALUES (1)", False, False), (4, "WITH a AS (SELECT 1 AS x) SELECT x FROM a LIMIT 1", True, False), (5, "not sql", False, False)]


@B.add(f"SELECT sql_id, read_only, has_limit FROM {values_sql('sql_id, q, read_only, has_limit', _SHAPES)}")
def draft_sql_shape(spark, sf):
    rows = [(i, *M.shape(spark, s)) for i, s, _, _ in _SHAPES]
    return spark.createDataFrame(rows, "sql_id int, read_only boolean, has_limit boolean")


@B.add("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50")
def preview_page(spark, sf):
    return V.page(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"))[1]


@B.add("SELECT count(*) > 100 AS truncated, CAST(least(count(*), 100) AS BIGINT) AS shown FROM orders")
def preview_truncated(spark, sf):
    got = V.capped(table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey"), 100)
    return got.agg((F.count("*") > 100).alias("truncated"), F.least(F.count("*"), F.lit(100)).alias("shown"))


@B.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'none'")
def preview_empty(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").where("o_orderstatus = 'none'")


@B.add(f"SELECT id, sha256(q) AS fingerprint FROM {derived.sql('statements')}")
def sql_fingerprint(spark, sf):
    return derived.relation(spark, sf, "statements").select("id", V.fingerprint(F.col("q")).alias("fingerprint"))


_PV = derived.sql("policies")


def _policies(spark, sf):
    p = derived.relation(spark, sf, "policies")
    return p.groupBy("id").agg(F.collect_set("role").alias("roles"), F.collect_set("t").alias("allowed_tables"), F.collect_set("c").alias("blocked_columns"), F.min("cap").alias("max_preview_rows"))


@B.add(f"SELECT CAST(min(cap) AS INT) AS cap FROM {_PV} WHERE role = 'analyst'")
def policy_min_cap(spark, sf):
    return K.roles_limits(_policies(spark, sf), "analyst").select(F.col("max_preview_rows").alias("cap"))


@B.add(f"SELECT array_to_string(list_sort(list(DISTINCT t)), ',') AS tables, array_to_string(list_sort(list(DISTINCT c)), ',') AS columns FROM {_PV}")
def policy_union(spark, sf):
    return K.roles_limits(_policies(spark, sf), None).select(F.array_join("allowed_tables", ",").alias("tables"), F.array_join("blocked_columns", ",").alias("columns"))


@B.add(f"SELECT 'analyst' AS role, CAST(count(DISTINCT t) AS INT) AS tables, CAST(count(DISTINCT c) AS INT) AS blocked, CAST(min(cap) AS INT) AS cap FROM {_PV} WHERE role = 'analyst' UNION ALL SELECT 'nobody', 0, 0, 0")
def policy_envelope(spark, sf):
    parts = [K.roles_limits(_policies(spark, sf), r).select(F.lit(r).alias("role"), F.size("allowed_tables").alias("tables"), F.size("blocked_columns").alias("blocked"), F.col("max_preview_rows").alias("cap")) for r in ("analyst", "nobody")]
    return parts[0].unionByName(parts[1])


@B.add(f"SELECT r.sql_id, r.c AS blocked FROM {derived.sql('reads')} r WHERE r.c IN (SELECT c FROM {_PV})")
def blocked_column_pairs(spark, sf):
    blocked = _policies(spark, sf).select(F.explode("blocked_columns").alias("c")).distinct()
    return derived.relation(spark, sf, "reads").join(blocked, "c", "left_semi").select("sql_id", F.col("c").alias("blocked"))


@B.add(f"SELECT id FROM {derived.sql('joins')} WHERE l IN (SELECT t FROM {derived.sql('candidates')}) AND r IN (SELECT t FROM {derived.sql('candidates')})")
def plan_join_recipes(spark, sf):
    j, c = derived.relation(spark, sf, "joins"), derived.relation(spark, sf, "candidates")
    return j.join(c, j["l"] == c["t"], "left_semi").join(c, j["r"] == c["t"], "left_semi").select("id")


@B.add(f"SELECT DISTINCT c.t AS table_name FROM {derived.sql('segments')} c WHERE c.t IN (SELECT t FROM {_PV} WHERE role = 'analyst')")
def plan_candidate_tables(spark, sf):
    allowed = K.roles_limits(_policies(spark, sf), "analyst").select(F.explode("allowed_tables").alias("t"))
    return derived.relation(spark, sf, "segments").distinct().join(allowed, "t", "left_semi").select(F.col("t").alias("table_name"))


@B.add(f"SELECT id FROM {derived.sql('questions')} WHERE target IN (SELECT i FROM {derived.sql('targets')})")
def plan_reverse_questions(spark, sf):
    return derived.relation(spark, sf, "questions").join(derived.relation(spark, sf, "targets"), F.col("target") == F.col("i"), "left_semi").select("id")


@B.add(f"SELECT DISTINCT m AS metric_id FROM {derived.sql('related')} WHERE t IN ('term.Brand#2', 'term.Brand#17') AND m IS NOT NULL")
def term_related_metrics(spark, sf):
    terms = derived.relation(spark, sf, "related").groupBy("t").agg(F.collect_set("m").alias("related"))
    return terms.where(F.col("t").isin("term.Brand#2", "term.Brand#17")).select(F.explode("related").alias("metric_id")).distinct()


@B.add(f"SELECT 'join' AS kind, count(*) AS n FROM {derived.sql('joins')} WHERE id IN (SELECT u FROM {derived.sql('used')}) UNION ALL SELECT 'question', count(*) FROM {derived.sql('questions')} WHERE id IN (SELECT u FROM {derived.sql('used')})")
def plan_definitions(spark, sf):
    used = derived.relation(spark, sf, "used")
    parts = [derived.relation(spark, sf, "joins").select("id", F.lit("join").alias("kind")), derived.relation(spark, sf, "questions").select("id", F.lit("question").alias("kind"))]
    return parts[0].unionByName(parts[1]).join(used, F.col("id") == F.col("u"), "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@B.add(f"SELECT id, len(list_filter(string_split(need, ','), lambda x: x <> '' AND NOT list_contains(string_split(have, ','), x))) = 0 AS contained, len(list_filter(string_split(need, ','), lambda x: x <> '' AND list_contains(string_split(have, ','), x))) > 0 AS overlapping FROM {derived.sql('sets')}")
def verified_query_match(spark, sf):
    sets = [F.filter(F.split(c, ","), lambda x: x != "") for c in ("need", "have")]
    return derived.relation(spark, sf, "sets").select("id", (F.size(F.array_except(*sets)) == 0).alias("contained"), F.coalesce(F.arrays_overlap(*sets), F.lit(False)).alias("overlapping"))


@B.add(f"SELECT id, floor(CASE WHEN doubt THEN least(0.75::DOUBLE, s) ELSE s END * 1000 + 0.5) / 1000.0 AS score FROM (SELECT id, doubt, len(list_intersect(string_split(need, ','), string_split(have, ','))) / CAST(len(string_split(need, ',')) AS DOUBLE) AS s FROM {derived.sql('covers')})")
def coverage_score(spark, sf):
    rows = derived.relation(spark, sf, "covers")
    return rows.select("id", M.coverage(F.split("need", ","), F.split("have", ","), F.col("doubt")).alias("score"))


@B.add(f"SELECT card, label FROM (SELECT card, label, row_number() OVER (PARTITION BY card ORDER BY length(label) DESC, label) AS rn FROM {derived.sql('labels')} WHERE contains('net revenue of new customers', label)) WHERE rn = 1")
def longest_match(spark, sf):
    hits = derived.relation(spark, sf, "labels").where(F.lit("net revenue of new customers").contains(F.col("label")))
    best = hits.groupBy("card").agg(F.min(F.struct((-F.length("label")).alias("n"), "label")).alias("m"))
    return best.select("card", F.col("m.label").alias("label"))


@B.add(f"SELECT id FROM {derived.sql('duplicate_terms')} WHERE trim(regexp_replace(translate(lower(label), '_.-', '   '), '\\s+', ' ', 'g')) NOT IN (SELECT label FROM {derived.sql('metrics')})")
def drop_metric_duplicates(spark, sf):
    from ..functions.text import norm_query

    keyed = [derived.relation(spark, sf, rows).select("id", norm_query(F.col("label")).alias("k")) for rows in ("duplicate_terms", "metrics")]
    return keyed[0].join(keyed[1], "k", "left_anti").select("id")


@B.add(f"SELECT id FROM {derived.sql('packs')} WHERE space = 'n3'")
def space_packs(spark, sf):
    return derived.relation(spark, sf, "packs").where("space = 'n3'").select("id")


@B.add("SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_totalprice > 300000) ORDER BY o_orderkey LIMIT 25")
def outer_projection(spark, sf):
    own = _session(spark, sf, "orders")
    return own.sql("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000").orderBy("o_orderkey").limit(25)


QUERIES, ORACLES = B.queries, B.oracles
