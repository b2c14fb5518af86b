import json
import zipfile

import pytest

from pyspark.sql import functions as F

from tidemark.sources import files, logs, xlsx
from tidemark.sources.database import ScanConfig, UnsupportedConnector, catalog, load_table, may_load, query, sample_rows
from tidemark.sources.logs import UnsafeEntry


def workbook(path, sheets):
    """A minimal .xlsx with inline strings, numbers and one date style."""
    names = list(sheets)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            body = ""
            for r, row in enumerate(sheets[n], 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if isinstance(v, str):
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                    elif isinstance(v, tuple):
                        cells += f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
                    elif v is not None:
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_scan_reads_every_format_and_reports_the_rest(spark, tmp_path):
    (tmp_path / "users.csv").write_text('user_id,note\n1,"two\nlines"\n2,\n')
    (tmp_path / "payments.json").write_text(json.dumps([{"id": 1, "amount": 2.5}, {"id": 2, "amount": 3}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"rows": [{"a": 1}], "meta": "x"}))
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "old.xls").write_text("x")
    workbook(tmp_path / "book.xlsx", {"One": [["k", None, "d"], [None, None, None], [1, "a", (45000,)], [2.5, "b", (45000.5,)]], "Two": [["x"], ["y"]], "Empty": []})
    found, skipped = files.scan(spark, str(tmp_path))
    by = {d.table: d.frame for d in found}
    assert set(by) == {"users", "payments", "wrapped", "log", "book_one", "book_two"}
    assert [r.note for r in by["users"].orderBy("user_id").collect()] == ["two\nlines", None]
    assert by["wrapped"].collect()[0].a == 1
    assert by["log"].count() == 2 and "b" in by["log"].columns
    one = by["book_one"].collect()
    assert by["book_one"].columns == ["k", "column_2", "d"]
    assert [tuple(r) for r in one] == [("1", "a", "2023-03-15"), ("2.5", "b", "2023-03-15T12:00:00")]
    assert {p.rsplit("/", 1)[1] for p, _ in skipped} == {"notes.txt", "old.xls"}


def test_bad_files_are_errors(spark, tmp_path):
    (tmp_path / "two.json").write_text(json.dumps({"a": [{"x": 1}], "b": [{"y": 1}]}))
    (tmp_path / "list.jsonl").write_text('{"a": 1}\n[1, 2]\n')
    for name in ("two.json", "list.jsonl", "x.tsv"):
        with pytest.raises(files.UnsupportedFile):
            files.load(spark, str(tmp_path / name))
    with pytest.raises(files.MissingReader):
        files.load(spark, str(tmp_path / "a.xls"))


def test_preview_session_is_separate(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("id\n1\n")
    own, tables, _ = files.preview_session(spark, str(tmp_path))
    assert tables == ["orders"] and own.table("orders").count() == 1
    assert not spark.catalog.tableExists("orders")


def test_serial_dates():
    assert xlsx.serial_date(1) == "1899-12-31" and xlsx.serial_date(45000.25) == "2023-03-15T06:00:00"


def test_jdbc_round_trip_and_gate(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    load_table(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), url, "fixture_t")
    df = query(spark, url, "SELECT * FROM fixture_t")
    assert df.count() == 2
    assert sample_rows(df, df.columns, 5, ScanConfig(max_rows=1)).count() == 1
    with pytest.raises(PermissionError):
        load_table(df, url, "orders")
    assert not may_load("jdbc:postgresql://db.example.org/x", "fixture_t")
    with pytest.raises(UnsupportedConnector):
        catalog(spark, "jdbc:oracle:thin:@h", "tables")
    with pytest.raises(UnsupportedConnector):
        catalog(spark, "jdbc:postgresql://localhost/x", "tables")
    with pytest.raises(ValueError):
        ScanConfig(max_tables=0)


def test_database_scan_profiles_in_the_database(spark, tmp_path):
    from tidemark.operators.scan import scan_database
    from tidemark.sources.database import frequencies_sql, quoted

    url = f"jdbc:derby:{tmp_path}/scan;create=true"
    rows = [(i, "paid" if i % 3 else "open", f"p{i}@example.org", float(i), None) for i in range(40)]
    load_table(spark.createDataFrame(rows, "id int, status string, email string, amount double, note string"), url, "fixture_orders")
    load_table(spark.createDataFrame([], "a string"), url, "fixture_empty")
    found = scan_database(spark, url, ScanConfig(tables=("FIXTURE_ORDERS", "FIXTURE_EMPTY"), max_columns=5))
    assert [r.table_name for r in found["tables"].collect()] == ["FIXTURE_EMPTY", "FIXTURE_ORDERS"] and found["columns"].count() == 6
    by = {(r.table.split(".")[1], r.column.lower()): r for r in found["profiles"].collect()}
    status, email, amount, note = (by["FIXTURE_ORDERS", c] for c in ("status", "email", "amount", "note"))
    assert [(v.value, v["count"]) for v in status.top_values] == [("paid", 26), ("open", 14)] and status.row_count == 40
    assert email.is_pii and email.top_values is None and amount.type_guess == "number" and amount.cardinality == 21 and amount.top_values is None
    assert (note.null_count, note.null_ratio, note.type_guess) == (40, 1.0, "unknown") and by["FIXTURE_EMPTY", "a"].row_count == 0
    assert {(r.table_name, r.provenance, r.coverage) for r in found["gaps"].collect()} == {("FIXTURE_EMPTY", "none", 0.0), ("FIXTURE_ORDERS", "none", 0.0)}
    assert quoted("mysql", "a`b", "c") == "`a``b`.`c`" and quoted("postgresql", 'x"; DROP') == '"x""; DROP"'
    assert frequencies_sql("postgresql", "s", "t", "c", 20).endswith("LIMIT 21")


def test_a_table_is_read_in_parallel_by_ranges_of_its_key(spark, tmp_path):
    from tidemark.sources.database import predicates, ranges, read_table

    url = f"jdbc:derby:{tmp_path}/wide;create=true"
    rows = spark.range(200_000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 2 = 0 THEN id % 1000 ELSE id * 7 END AS k", "id AS v")
    load_table(rows.repartition(4), url, "fixture_wide")
    schema = query(spark, url, "SELECT CURRENT SCHEMA AS s FROM SYSIBM.SYSDUMMY1").head()[0]
    got = read_table(spark, url, schema, "FIXTURE_WIDE", "k", 8)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert got.rdd.getNumPartitions() == 8 and sum(r["count"] for r in sizes) == 200_000
    assert sorted(r["count"] for r in sizes)[-2] < 60_000  # half of all keys are in one cell; the others are even
    one = read_table(spark, url, schema, "FIXTURE_WIDE")
    assert one.rdd.getNumPartitions() == 1 and got.exceptAll(one).count() == one.exceptAll(got).count() == 0
    assert predicates(spark, url, schema, "FIXTURE_WIDE", "k", 1) == ["1 = 1"]
    assert ranges([(0, 5), (1, 1), (4, 1), (9, 3)], 2) == [(0, 1), (1, 10)] and ranges([], 3) == [] and ranges([(2, 9)], 4) == [(2, 3)]


def test_definitions_and_comments(spark, tmp_path):
    from tidemark.sources.database import definition

    df = spark.createDataFrame([(1, "a", 1.5)], "id long not null, v string, `x y` double")
    said = {"v": "it's \\ so", "none": "x"}
    assert definition("postgresql", df, "t", "T", said) == ['CREATE TABLE "t" ("id" BIGINT NOT NULL, "v" TEXT, "x y" DOUBLE PRECISION)', """COMMENT ON TABLE "t" IS 'T'""", """COMMENT ON COLUMN "t"."v" IS 'it''s \\ so'"""]
    assert definition("mysql", df, "t", "T", said) == ["CREATE TABLE `t` (`id` BIGINT NOT NULL, `v` TEXT COMMENT 'it''s \\\\ so', `x y` DOUBLE PRECISION) COMMENT 'T'"]
    url = f"jdbc:derby:{tmp_path}/defined;create=true"
    load_table(df, url, "fixture_d", comment="T", comments=said)
    assert [tuple(r) for r in query(spark, url, 'SELECT * FROM "fixture_d"').collect()] == [(1, "a", 1.5)]


def test_connection_options_reach_every_driver(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/own;create=true"
    load_table(spark.createDataFrame([(1,)], "v int"), url, "fixture_x", user="u1", password="p")
    assert query(spark, url, "SELECT CURRENT SCHEMA AS s FROM SYSIBM.SYSDUMMY1", user="u1", password="p").head()[0] == "U1"


@pytest.mark.parametrize("url", ["jdbc:postgresql://localhost:x@remote/db", "jdbc:postgresql://localhost@remote/db", "jdbc:mysql://remote/localhost", "jdbc:postgresql://localhost.evil.org/db"])
def test_only_local_hosts_are_loaded(url):
    assert not may_load(url, "fixture_t") and may_load("jdbc:postgresql://localhost:5432/db", "fixture_t") and may_load("jdbc:mysql://127.0.0.1/db?x=1", "fixture_t")


def test_logs_redact_refuse_and_read(spark, tmp_path):
    logs.append(spark, str(tmp_path), "sales", "audit", {"note": "mail a.b@example.org or +49 170 1234567"})
    row = logs.read(spark, str(tmp_path), "audit", "sales").head()
    assert "example" not in row.payload and "1234567" not in row.payload and len(row.id) == 16
    with pytest.raises(UnsafeEntry):
        logs.append(spark, str(tmp_path), "sales", "feedback", {"note": "a.b@example.org"}, redact=False)
    with pytest.raises(UnsafeEntry):
        logs.append(spark, str(tmp_path), "../x", "audit", {})
    assert logs.markdown(spark.createDataFrame([(1,)], "a int"), "T") == "# T\n\n| a |\n|---|\n| 1 |\n"
