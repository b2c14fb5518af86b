from pyspark.sql import functions as F

from tidemark.operators import release


def test_scan_names_file_line_and_pattern(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("fine\ntoken = abc\r\nsee /Users/x and AKIA" + "A1B2" * 4 + "\n")
    (tmp_path / "sub" / "b.json").write_text('{"dsn": "postgresql://u@h/db"}')
    got = {(r.path.rsplit("/", 1)[1], r.line, r.pattern) for r in release.scan(spark, str(tmp_path)).collect()}
    assert got == {("a.md", 2, "named_secret_assignment"), ("a.md", 3, "local_user_path"), ("a.md", 3, "aws_access_key_id"), ("b.json", 1, "postgres_dsn")}


def test_redaction_counts_each_class(spark):
    df = spark.createDataFrame([("worker-1 worker-22 a.b@example.org",), (None,), ("nothing",)], "t string").select(release.redacted(F.col("t")).alias("r")).select("r.*")
    rows = df.collect()
    assert rows[0].text == "<redacted_worker_id> <redacted_worker_id> <redacted_email>" and (rows[0].counts.worker_id, rows[0].counts.email, rows[0].counts.aws_access_key_id) == (2, 1, 0)
    assert rows[1].text is None and sum(rows[1].counts) == 0 and rows[2].text == "nothing"


def test_nested_records_lose_raw_values_at_every_depth():
    record = {"name": "orders", "bad key!": 1, "columns": [{"name": "mail", "top_values": ["a@b.org"], "note": "ask a.b@example.org or +49 170 1234567", "inner": {"Samples": [1], "ok": [True, None, 2.5]}}]}
    assert release.sanitised(record) == {"name": "orders", "bad_key": 1, "columns": [{"name": "mail", "note": "ask <redacted_email> or <redacted_phone>", "inner": {"ok": [True, None, 2.5]}}]}


def test_stale_values_of_personal_columns_go(spark):
    df = spark.createDataFrame([("a", True, 1.0, ["x"]), ("b", False, 2.0, ["y"]), ("c", None, 3.0, ["z"])], "column string, is_pii boolean, numeric_min double, top_values array<string>")
    assert [(r.numeric_min, r.top_values) for r in release.without_stale_values(df).orderBy("column").collect()] == [(None, None), (2.0, ["y"]), (3.0, ["z"])]


def test_tables_of_sources_get_names_of_their_own():
    assert release.namespaced({"A": ["Orders", "orders", "x"], "b": ["orders"]}) == [("A", "Orders", "a__orders"), ("A", "orders", "a__orders_2"), ("A", "x", "a__x"), ("b", "orders", "b__orders")]
