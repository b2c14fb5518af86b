import pytest
from pyspark.sql import functions as F

from tidemark import service
from tidemark.operators import evaluate, guard, preview
from tidemark.plans import demo
from tidemark.streaming import tails
from tidemark.tables import register, table


@pytest.fixture(scope="module")
def own(spark, sf):
    s = spark.newSession()
    register(s, sf, ("orders", "lineitem", "customer"))
    return s


def test_preview_is_guarded_capped_and_audited(own):
    p = [demo.pack()]
    ok = service.preview_query(own, p, "SELECT o_orderkey FROM orders ORDER BY 1", limit=5)
    assert (ok.status, len(ok.rows), ok.truncated) == ("ok", 5, True)
    assert service.preview_query(own, p, "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 3", limit=5).rows[2] and not service.preview_query(own, p, "SELECT o_orderkey FROM orders LIMIT 3", limit=5).truncated
    none = service.preview_query(own, p, "SELECT o_orderkey FROM orders WHERE 1 = 0")
    assert none.columns == ["o_orderkey"] and none.rows == []
    no = service.preview_query(own, p, "SELECT c_name FROM customer")
    assert no.status == "blocked" and no.rows == [] and "c_name" not in str(no.audit) and len(no.audit["sql_sha256"]) == 64
    assert service.preview_query(own, p, "SELECT 1/0 AS x FROM orders").status == "failed"
    assert service.preview_query(own, p, "SELECT o_orderkey FROM orders", role="nobody").status == "blocked"


@pytest.mark.parametrize(
    "sql, passes",
    [
        ("TABLE customer", False),
        ("SELECT o_orderkey FROM orders UNION ALL TABLE keys", True),
        ("SELECT count(*) AS n FROM (TABLE customer UNION ALL TABLE customer)", False),
        ("SELECT count(*) AS n FROM customer", True),
        ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", True),
        ("SELECT o_orderkey FROM orders WHERE 'x' IN (SELECT c_name FROM customer)", False),
        ("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_name > 'a')", False),
        ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = c.c_name)", False),
        ("SELECT (SELECT max(c_name) FROM customer) AS m", False),
        ("WITH c AS (TABLE customer) SELECT c_custkey FROM c", False),
        ("WITH c AS (SELECT c_custkey FROM customer) SELECT * FROM c", True),
        ("SELECT c_custkey FROM customer NATURAL JOIN names", False),
        ("SELECT c_custkey FROM customer JOIN names USING (c_custkey)", True),
        ("SELECT to_json(struct(*)) AS j FROM customer", False),
        ("SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS h FROM orders", False),
        ("SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS h FROM orders", False),
        ("WITH c AS (SELECT reflect('java.lang.System', 'getProperty', 'x') AS h FROM orders) SELECT h FROM c", False),
        ("SELECT o_orderkey FROM orders, secret, (WITH secret AS (SELECT 1 AS a) SELECT a FROM secret)", False),
        ("SELECT name FROM people", False),
        ("SELECT id FROM people", True),
        ("TABLE people", False),
        ("SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", False),
        ("SELECT id FROM range(3)", True),
        ("SELECT * FROM sql_keywords()", False),
        ("SELECT sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders", True),
    ],
)
def test_guard_is_closed(own, tmp_path_factory, sql, passes):
    if not own.catalog.tableExists("people"):
        own.createDataFrame([(1, "n")], "id int, name string").write.mode("overwrite").option("path", str(tmp_path_factory.mktemp("people"))).saveAsTable("people")
    own.sql("CREATE OR REPLACE TEMP VIEW names AS SELECT c_custkey, c_name FROM customer")
    own.sql("CREATE OR REPLACE TEMP VIEW keys AS SELECT o_orderkey FROM orders")
    own.sql("CREATE OR REPLACE TEMP VIEW secret AS SELECT 1 AS a")
    r = guard.check(own, sql, ["orders", "customer", "names", "keys", "people"], ["customer.c_name", "names.c_name", "people.name"])
    assert r.passed == passes, (r.checks, r.errors, r.columns)


@pytest.mark.parametrize("entry", ["c_name", "C_NAME", "customer.c_name", "customer.*", "main.customer.c_name", "`customer`.`c_name`", " customer . c_name ", "*", "", ".", "customer.", "customer.nme", None])
def test_every_spelling_of_a_blocked_column_stops(own, entry):
    run = lambda sql: guard.check(own, sql, ["customer", "orders"], [entry])
    for sql in ("SELECT c_name FROM customer", "SELECT x.c_name AS n FROM customer x", "SELECT c_custkey FROM customer WHERE c_name = 'a'", "SELECT * FROM customer"):
        r = run(sql)
        assert r.checks["blocked_columns"] == "fail" and not r.passed, (sql, entry)
    if entry and "c_name" in entry.lower():
        assert run("SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1").passed
        assert run("SELECT o_orderkey FROM orders").passed
    if entry == "customer.*":
        assert run("SELECT o_orderkey FROM orders").passed and not run("SELECT c_custkey FROM customer").passed


def test_recursive_statements(own):
    chain = "WITH RECURSIVE c(k, n) AS (SELECT min(o_orderkey), 1 FROM orders UNION ALL SELECT k + 1, n + 1 FROM c WHERE n < 4) SELECT k, n FROM c"
    assert guard.check(own, chain, ["orders"], []).passed
    assert not guard.check(own, chain, ["orders"], ["o_orderkey"]).passed
    assert not guard.check(own, chain, ["customer"], []).passed
    hidden = "WITH RECURSIVE c(k, n) AS (SELECT c_name, 1 FROM customer UNION ALL SELECT k, n + 1 FROM c WHERE n < 2) SELECT count(*) AS n FROM c"
    assert not guard.check(own, hidden, ["customer"], ["customer.c_name"]).passed


def test_parameters_never_become_sql(own):
    sql = "SELECT c_custkey FROM customer WHERE c_mktsegment = :a OR c_mktsegment = :ab"
    rows = lambda **args: preview.preview(own, sql, allowed=["customer"], blocked=[], limit=5000, cap=5000, args=args)
    segment = own.table("customer").head().c_mktsegment
    assert 0 < len(rows(a=segment, ab="x").rows) == len(rows(a="x", ab=segment).rows) < own.table("customer").count()
    for value in ("\\' OR 1=1 -- ", "' OR '1'='1", '" OR 1=1', "x' UNION SELECT 1 --", "\\"):
        got = rows(a=value, ab=value)
        assert (got.status, got.rows) == ("ok", [])
    assert rows(a=segment).status != "ok"  # a parameter without a value


def test_answer_states(own):
    p = [demo.pack()]
    got = service.answer(own, p, demo.QUESTION, params={"start_date": "1995-01-01"}, run=True)
    assert got["state"] in ("ok", "truncated") and got["rows"]
    assert service.answer(own, p, "weather")["state"] == "no_match"
    assert service.answer(own, p, "gross revenue")["state"] in ("no_trusted_sql", "ambiguous")
    r = evaluate.scenarios(own, p, [{"id": "s", "question": "weather", "state": "no_match"}])
    assert r.head().status == "passed"
    red = evaluate.red_team(own, [{"id": "x", "sql": "DROP TABLE orders"}, {"id": "y", "sql": "SELECT o_orderkey FROM orders", "safe": True}], ["orders"], [])
    assert {x.status for x in red.collect()} == {"passed"}


def test_search(spark):
    p = [demo.pack()]
    hits = service.search(spark, p, "net revenue", 3)
    assert [(h["card_id"], h["priority"]) for h in hits[:2]] == [("verified.monthly_net_revenue", 1100), ("metric.net_revenue", 1000)]
    assert service.search(spark, p, "net revenue", 3, types=["terms"])[0]["card_type"] == "business_term"
    assert len(service.search(spark, p, "net revenue", 4, backend="vector")) == 4
    with pytest.raises(service.BackendError):
        service.search(spark, p, "x", backend="other")


def test_validate_and_feedback(own, tmp_path):
    p = [demo.pack()]
    assert service.validate_sql(own, p, "SELECT o_orderkey FROM orders")["execution_allowed"] is False
    assert service.validate_pack(own, p[0]) == []
    assert service.give_feedback(own, str(tmp_path), "sales", {"ok": True})


def test_streams_equal_batches(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    events.select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "user_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = tails.running_profile(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("running").collect()) == sorted(tails.running_profile(events).collect())


def test_tail_of_a_log(spark, tmp_path):
    from tidemark.sources import logs

    logs.append(spark, str(tmp_path), "s", "audit", {"a": 1})
    q = tails.deduped(tails.tail(spark, str(tmp_path), "audit")).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tail").count() == 1
