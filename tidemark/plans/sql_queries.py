"""The SQL surface that previews pass through - joins, windows, grouping, subqueries, functions - on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare as M
from ..operators import guard as G
from ..streaming.tails import sessions, tumbling
from ..tables import register, table
from .kit import Book

B = Book()


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


_JOINED = "SELECT n_name, s_suppkey FROM nation {how} JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON n_nationkey = s_nationkey"


def _join(how):
    def run(spark, sf):
        n, s = _t(spark, sf, "nation", "supplier")
        j = n.join(s.where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), how)
        return j.select("n_name", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"))

    return run


for _how in ("inner", "left", "full", "right"):
    B.add(_JOINED.format(how=_how).replace("s_suppkey FROM", "coalesce(s_suppkey, -1) AS s_suppkey FROM"), name=f"join_{_how}")(_join(_how))


@B.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o.where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@B.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o.where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@B.add("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    """Two tables of a fixed, tiny size: the construct itself."""
    r, n = _t(spark, sf, "region", "nation")
    return r.crossJoin(n).select("r_name", "n_name")


@B.add("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf):
    n = table(spark, sf, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(f"r{k}")) for k in ("low", "high"))
    return a.join(b, (F.col("rlow") == F.col("rhigh")) & (F.col("low") < F.col("high"))).select("low", "high")


_O = "o_custkey, o_orderkey"


def _w():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_WSQL = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@B.add(f"SELECT {_O}, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS rk, CAST(dense_rank() OVER v AS INT) AS dr FROM orders WINDOW w AS {_WSQL}, v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank(spark, sf):
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(_w()).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"))


@B.add(f"SELECT {_O}, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders")
def win_running(spark, sf):
    s = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(_w().rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", s.cast("double").alias("running"))


@B.add(f"SELECT {_O}, coalesce(lag(o_orderkey) OVER w, -1) AS before, coalesce(lead(o_orderkey) OVER w, -1) AS after FROM orders WINDOW w AS {_WSQL}")
def win_lag_lead(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lag("o_orderkey").over(_w()), F.lit(-1)).alias("before"), F.coalesce(F.lead("o_orderkey").over(_w()), F.lit(-1)).alias("after"))


@B.add(f"SELECT {_O}, CAST(ntile(3) OVER w AS INT) AS third, floor(percent_rank() OVER w * 10000 + 0.5) / 10000.0 AS pr, floor(cume_dist() OVER w * 10000 + 0.5) / 10000.0 AS cd FROM orders WINDOW w AS {_WSQL}")
def win_ntile(spark, sf):
    four = lambda c: F.floor(c * 10_000 + F.lit(0.5)) / F.lit(10_000.0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.ntile(3).over(_w()).alias("third"), four(F.percent_rank().over(_w())).alias("pr"), four(F.cume_dist().over(_w())).alias("cd"))


@B.add(f"SELECT {_O}, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key, coalesce(nth_value(o_orderkey, 2) OVER w, -1) AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark, sf):
    w = _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.first("o_orderkey").over(w).alias("first_key"), F.last("o_orderkey").over(w).alias("last_key"), F.coalesce(F.nth_value("o_orderkey", 2).over(w), F.lit(-1)).alias("second_key"))


@B.add("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part")
def win_range(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-2, 2)
    return table(spark, sf, "part").select("p_partkey", F.count("*").over(w).alias("near"))


@B.add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def group_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@B.add("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY 1")
def distinct_agg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("numbers"))


@B.add("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def listagg(spark, sf):
    r, n = _t(spark, sf, "region", "nation")
    return r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@B.add("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS size_class, count(*) AS n FROM part WHERE p_name LIKE '%a%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND p_type IS NOT NULL GROUP BY 1")
def case_filter(spark, sf):
    p = table(spark, sf, "part").where(F.col("p_name").like("%a%") & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21") & F.col("p_type").isNotNull())
    kind = F.when(F.col("p_size") < 10, "small").when(F.col("p_size").between(10, 30), "middle").otherwise("large")
    return p.groupBy(kind.alias("size_class")).agg(F.count("*").alias("n"))


_CORRELATED = "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p2.p_retailprice) FROM part p2 WHERE p2.p_brand = p.p_brand) + 1"
_CTE = "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey) SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM big JOIN customer ON c_custkey = o_custkey GROUP BY 1"
_RECURSIVE = "WITH RECURSIVE t(k, n) AS (SELECT c_custkey, CAST(1 AS BIGINT) FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT k + 1, n + 1 FROM t WHERE n < 5) SELECT k, n, count(o_orderkey) AS orders FROM t LEFT JOIN orders ON o_custkey = k GROUP BY k, n"


def _sql(text, *names):
    def run(spark, sf):
        own = spark.newSession()
        register(own, sf, names)
        return own.sql(text)

    return run


def _guarded(text, *names):
    """The statement's rows, if the guard lets it pass."""

    def run(spark, sf):
        own = spark.newSession()
        register(own, sf, names)
        report = G.check(own, text, names, ["customer.c_name"])
        if not report.passed:
            raise PermissionError("; ".join(report.errors))
        return own.sql(text)

    return run


_READS = "SELECT c_mktsegment, count(*) AS n, max(c_nationkey) AS last FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY c_mktsegment"
B.add(_READS, name="guarded_rows")(_guarded(_READS, "customer", "orders"))

_DRAFTS = {
    "same": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", "SELECT c AS k, sum(one) AS n FROM (SELECT o_custkey AS c, 1 AS one FROM orders) x GROUP BY c"),
    "filter": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", "SELECT o_orderkey FROM orders WHERE o_totalprice > 120000"),
    "repeats": ("SELECT o_orderpriority FROM orders", "SELECT DISTINCT o_orderpriority FROM orders"),
}


def _bags(name: str, a: str, b: str) -> str:
    return f"SELECT '{name}' AS name, (SELECT count(*) FROM ({a})) AS draft_rows, (SELECT count(*) FROM ({b})) AS trusted_rows, (SELECT count(*) FROM ({a} EXCEPT ALL ({b}))) AS only_draft, (SELECT count(*) FROM (({b}) EXCEPT ALL ({a}))) AS only_trusted"


@B.add("SELECT *, only_draft + only_trusted = 0 AS equal FROM (" + " UNION ALL ".join(_bags(n, f"({a})", b) for n, (a, b) in _DRAFTS.items()) + ")")
def results_compared(spark, sf):
    """What drafts return against what trusted statements return, as bags of rows."""
    own = spark.newSession()
    register(own, sf, ("orders",))
    parts = [M.compare_results(own, a, b, ["orders"], []).withColumn("name", F.lit(n)) for n, (a, b) in _DRAFTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


B.add(_CORRELATED, name="subquery_correlated")(_sql(_CORRELATED, "part"))
B.add(_CTE, name="cte")(_sql(_CTE, "orders", "customer"))
B.add(_RECURSIVE, name="cte_recursive")(_guarded(_RECURSIVE, "customer", "orders"))


@B.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def order_limit_offset(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(5).limit(20)


@B.add("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    c, s = _t(spark, sf, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@B.add("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return o.select(F.col("o_custkey").alias("k")).intersect(c.where("c_acctbal > 0").select("c_custkey"))


@B.add("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_except(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.where("o_totalprice > 200000").select("o_custkey"))


@B.add("SELECT p_partkey, upper(p_name) AS up, substr(p_name, 2, 5) AS mid, CAST(strpos(p_name, 'a') AS INT) AS at, replace(p_name, ' ', '_') AS under, trim('  ' || p_brand || ' ') AS trimmed, CAST(length(p_type) AS INT) AS n, left(p_type, 3) AS l3, reverse(p_brand) AS rev, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, concat_ws('-', p_brand, p_type) AS joined, starts_with(p_brand, 'Brand#1') AS first, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part")
def fn_string(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("up"), F.substring("p_name", 2, 5).alias("mid"), F.instr("p_name", "a").alias("at"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("under"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.length("p_type").alias("n"), F.left("p_type", F.lit(3)).alias("l3"), F.reverse("p_brand").alias("rev"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.concat_ws("-", "p_brand", "p_type").alias("joined"), F.col("p_brand").startswith("Brand#1").alias("first"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"),
    )


@B.add("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS first_day, strftime(o_orderdate, '%Y/%m/%d') AS shown, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE)::VARCHAR AS due, CAST(quarter(o_orderdate) AS INT) AS q FROM orders")
def fn_date(spark, sf):
    o, d = table(spark, sf, "orders"), F.col("o_orderdate")
    return o.select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.date_trunc("month", d).cast("date").cast("string").alias("first_day"), F.date_format(d, "yyyy/MM/dd").alias("shown"),
        F.date_diff(d.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), F.date_add(d.cast("date"), 30).cast("string").alias("due"), F.quarter(d).alias("q"),
    )


@B.add("SELECT p_partkey, abs(p_size - 25) AS a, sign(p_size - 25)::DOUBLE AS s, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, floor(sqrt(p_size) * 10000 + 0.5) / 10000.0 AS root, CAST(p_partkey % 7 AS BIGINT) AS m, greatest(p_size, 20) AS g, least(p_size, 20) AS l, power(p_size, 2)::DOUBLE AS sq FROM part")
def fn_math(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", F.abs(s - 25).alias("a"), F.signum(s - 25).alias("s"), F.ceil("p_retailprice").alias("up"), F.floor("p_retailprice").alias("down"), (F.floor(F.sqrt(s) * 10_000 + F.lit(0.5)) / F.lit(10_000.0)).alias("root"),
        F.pmod("p_partkey", F.lit(7)).alias("m"), F.greatest(s, F.lit(20)).alias("g"), F.least(s, F.lit(20)).alias("l"), F.pow(s, 2).alias("sq"),
    )


@B.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, props IS NOT NULL AS has FROM events")
def fn_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("props").isNotNull().alias("has"))


@B.add("SELECT d.doc_id, coalesce(quality, -1) AS q, nullif(lang, 'en') IS NULL AS english, CASE WHEN quality IS NULL THEN 'none' ELSE 'some' END AS labelled FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def fn_null(spark, sf):
    d, x = _t(spark, sf, "documents", "labels")
    j = d.join(x.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("q"), F.nullif("lang", F.lit("en")).isNull().alias("english"), F.when(F.col("quality").isNull(), "none").otherwise("some").alias("labelled"))


@B.add("SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1]::DOUBLE AS first, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive, list_contains(embedding, embedding[3]) AS has, CAST(len(list_distinct(list_transform(embedding, lambda x: x > 0))) AS INT) AS signs FROM embeddings")
def fn_array(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.size(e).alias("n"), e[0].cast("double").alias("first"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.array_contains(e, e[2]).alias("has"), F.size(F.array_distinct(F.transform(e, lambda x: x > 0))).alias("signs"))


@B.add("SELECT doc_id, sha256(text) AS s256, md5(text) AS m, substr(sha1(text), 1, 10) AS s1 FROM documents")
def fn_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("s256"), F.md5("text").alias("m"), F.substring(F.sha1("text"), 1, 10).alias("s1"))


_PAIRS = "(SELECT event_type AS k, user_id AS v FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)"


@B.add(f"SELECT k, max(v) AS v FROM {_PAIRS} GROUP BY k")
def fn_map(spark, sf):
    m = table(spark, sf, "events").where("event_type IS NOT NULL AND user_id IS NOT NULL").groupBy(F.col("event_type").alias("k")).agg(F.max("user_id").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return m.select(F.explode("m").alias("k", "v"))


_KINDS = "CASE typeof({}) WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' END"


@B.add(" UNION ALL ".join(f"SELECT '{t}.{c}' AS col, {_KINDS.format(c)} AS kind, count(*) AS n FROM {t} GROUP BY 2" for t, c in (("events", "value"), ("events", "event_type"), ("events", "user_id"), ("embeddings", "embedding"))))
def fn_typeof(spark, sf):
    parts = [table(spark, sf, t).groupBy(F.typeof(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(f"{t}.{c}").alias("col"), "kind", "n") for t, c in (("events", "value"), ("events", "event_type"), ("events", "user_id"), ("embeddings", "embedding"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@B.add(r"SELECT page_id AS id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages WHERE regexp_matches(url, '^[a-z]+://')")
def fn_url(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").where(u.rlike("^[a-z]+://")).select(F.col("page_id").alias("id"), F.try_parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(u, F.lit("HOST")).alias("host"), F.try_parse_url(u, F.lit("PATH")).alias("path"))


@B.add("SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(o_orderstatus, 'all') AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def rollup_segments(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    g = c.join(o, F.col("o_custkey") == F.col("c_custkey")).rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n")


@B.add("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_tumbling(spark, sf):
    """An addition to the reference: hourly counts, the same function that runs on a stream."""
    return tumbling(table(spark, sf, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@B.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def x_session(spark, sf):
    """An addition to the reference: sessions by pauses of half an hour."""
    return sessions(table(spark, sf, "events")).select("user_id", "n")


QUERIES, ORACLES = B.queries, B.oracles
