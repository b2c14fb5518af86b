import datetime as dt
import json
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sketches as S
from tidemark.operators import corpus, frames
from tidemark.operators.checksum import table_checksum
from tidemark.operators.records import clean_records
from tidemark.sources import xlsx
from tidemark.streaming import profiles, tails
from tidemark.tables import table


def frame_by_hand(rows, start, end, exclude):
    """(id, count, sum, min, max) by looking at every pair of rows of a partition."""
    out = set()
    first = lambda o: (o is not None, o or 0)
    for i, p, o, _ in rows:
        own = [r for r in rows if r[1] == p]
        order = sorted({first(r[2]) for r in own})
        at = order.index(first(o))
        seen = []
        for j, _, oo, v in own:
            g = order.index(first(oo)) - at
            peer = g == 0
            gone = {"no others": False, "current row": j == i, "group": peer, "ties": peer and j != i}[exclude]
            if (start is None or g >= start) and (end is None or g <= end) and not gone and v is not None:
                seen.append(v)
        out.add((i, len(seen), sum(seen) if seen else None, min(seen, default=None), max(seen, default=None)))
    return out


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
@pytest.mark.parametrize(("start", "end"), [(-1, 1), (None, 0), (0, 0), (1, None), (-3, -1), (None, None)])
def test_group_frames_equal_brute_force(spark, start, end, exclude):
    rng = random.Random(f"{start}{end}{exclude}")
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 3, 3, 5, 8]), rng.choice([None, 1, 2, 2, 7, -4])) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, p string, o int, v int").withColumns({"_v": F.lit(9), "_k0": F.lit(8), "_n": F.lit(7), "_row": F.lit(6)})
    got = frames.groups_frame(df, "v", partition_by=["p"], order_by=["o"], start=start, end=end, exclude=exclude)
    assert got.columns == [*df.columns, "frame_count", "frame_sum", "frame_min", "frame_max"]
    assert {(r.id, r.frame_count, r.frame_sum, r.frame_min, r.frame_max) for r in got.collect()} == frame_by_hand(rows, start, end, exclude)


def test_frames_refuse_nonsense(spark):
    df = spark.createDataFrame([(1, 1)], "o int, v int")
    for bad in ({"start": 2, "end": 1}, {"start": 0, "end": 0, "exclude": "some"}):
        with pytest.raises(ValueError):
            frames.groups_frame(df, "v", partition_by=[], order_by=["o"], **bad)
    whole = frames.groups_frame(df, "v", partition_by=[], order_by=["o"], start=None, end=None)
    assert whole.head().frame_sum == 1 and frames.groups_frame(df.limit(0), "v", partition_by=[], order_by=["o"], start=0, end=0).collect() == []


def test_checksums_depend_on_rows_only(spark):
    rows = [(i % 50, None if i % 7 == 0 else f"t{i % 11}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t string")
    want = table_checksum(df, ["k"], fan_out=8).head()
    assert (want.n_rows, want.levels) == (500, 3)
    for n in (1, 3, 17):
        random.Random(n).shuffle(rows)
        assert table_checksum(spark.createDataFrame(rows, "k int, t string").repartition(n), ["k"], fan_out=8).head() == want
    for other in (rows[1:], [*rows, rows[0]], [(k, t if i else "x") for i, (k, t) in enumerate(rows)], [(k, "" if t is None else t) for k, t in rows]):
        assert table_checksum(spark.createDataFrame(other, "k int, t string"), ["k"], fan_out=8).head().root != want.root
    import hashlib

    assert table_checksum(df.limit(0), ["k"]).head() == (0, 0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest()[:16])
    one = hashlib.sha256(b"1:11:a").hexdigest()
    assert table_checksum(spark.createDataFrame([(1, "a")], "k int, t string"), ["k"]).head().root == hashlib.sha256(one.encode()).hexdigest()


def test_checksum_of_lineitem_follows_its_sql_above_two_levels_and_with_nulls(spark, sf, tmp_path):
    from tests.oracle import assert_same
    from tidemark.plans import registry

    line = table(spark, sf, "lineitem")
    small = line.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 9 > 0, F.col("l_orderkey"))).withColumn("l_linenumber", F.when(F.col("l_linenumber") % 5 > 0, F.col("l_linenumber")))
    ids = spark.range(0, (1 << 20) + 1500, 1, 4)  # more rows than 1024 nodes of 1024
    large = ids.select(F.col("id").alias("l_orderkey"), *(F.lit("1").cast(line.schema[c].dataType).alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")))
    for name, rows, nodes in (("nulls", small, 1), ("large", large, 2), ("none", line.limit(0), 0)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/out")
        next((tmp_path / name / "out").glob("*.parquet")).rename(tmp_path / name / "lineitem.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/{name}/lineitem.parquet'")
        found = registry.QUERIES["checksum_lineitem"](spark, f"{tmp_path}/{name}")
        assert found.count() == nodes
        assert_same(found, con, registry.ORACLES["checksum_lineitem"])


def test_sketches_are_exact_or_within_their_bounds():
    rng = np.random.default_rng(1)
    values = pd.Series(np.concatenate([rng.lognormal(3, 2, 40_000), -rng.lognormal(1, 1, 9_000), np.zeros(1_000), [np.nan] * 50]))
    items = pd.Series([f"u{i}" for i in rng.integers(0, 30_000, 45_000)] + ["hot"] * 4_000 + [None] * 1_050)
    order = rng.permutation(len(values))
    parts = [S.of(values.iloc[p], items.iloc[p]) for p in np.array_split(order, 7)]
    s = S.Sketch()
    for p in parts:
        s = S.merged(s, p)
    back = S.Sketch()
    for p in reversed(parts):
        back = S.merged(back, S.from_row(S.row(p)))
    assert s[:7] == back[:7] == S.of(values, items)[:7]
    x = np.sort(values.dropna().to_numpy())
    assert (s.rows, s.nulls, s.low, s.high) == (len(values), 50, x[0], x[-1])
    for q in (0, 0.01, 0.2, 0.5, 0.9, 0.999, 1):
        true = x[math.floor(q * (len(x) - 1))]
        assert abs(S.quantile(s, q) - true) <= 1.0001 * S.ERROR * abs(true)
    assert abs(S.distinct(s) / items.nunique() - 1) < 0.06
    assert S.frequent(s, 1)[0]["value"] == "hot" and 4_000 - s.error <= S.frequent(s, 1)[0]["count"] <= 4_000 and s.error <= len(items) / S.ITEMS
    few = S.of(pd.Series([1.0, float("inf")]), pd.Series(["a", None]))
    assert (few.rows, few.high, S.distinct(few), S.quantile(few, 0.5)) == (2, float("inf"), 1, pytest.approx(1.0, rel=0.011))
    assert S.quantile(S.Sketch(), 0.5) is None and S.distinct(S.Sketch()) == 0


@pytest.fixture(scope="module")
def streaming(spark):
    own = spark.newSession()
    own.conf.set(*profiles.ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def run(sketches, out, at):
    write = lambda batch, _: batch.write.mode("append").parquet(out)
    sketches.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def test_a_restarted_stream_profiles_like_a_table(streaming, sf, tmp_path):
    events = table(streaming, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    whole, parts = f"{tmp_path}/in", [events.where(F.col("event_id") % 3 == k) for k in range(3)]
    make = lambda: profiles.stream_sketches(streaming.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(whole), key="event_type", value="value", item="props", salts=3)
    for part in parts:  # a query that ends, and one that goes on from its checkpoint
        part.coalesce(2).write.mode("append").parquet(whole)
        run(make(), f"{tmp_path}/out", f"{tmp_path}/at")
    updates = streaming.read.schema(make().schema).parquet(f"{tmp_path}/out")
    assert updates.count() > updates.select("key", "salt").distinct().count()
    got = {r.key: r.asDict(recursive=True) for r in profiles.folded(profiles.latest(updates)).collect()}
    want = {r.key: r.asDict(recursive=True) for r in profiles.folded(profiles.batch_sketches(events, key="event_type", value="value", item="props")).collect()}
    assert got == want and sum(r["rows"] for r in got.values()) == events.count()


def test_idle_keys_are_closed_by_a_timer(streaming, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "k string, v double, i string, ts timestamp"
    out = f"{tmp_path}/out"
    make = lambda: profiles.stream_sketches(streaming.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in"), key="k", value="v", item="i", time="ts", idle="2 days", late="1 hour")
    for rows in ([("a", 1.0, "x", day(1)), ("b", 2.0, "y", day(1))], [("b", 3.0, "y", day(2))], [("b", None, None, day(3)), ("c", 1.0, "z", day(9))], [("c", 1.0, "z", day(20))], [("c", 1.0, "z", day(21))]):
        streaming.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(make(), out, f"{tmp_path}/at")
    closed = {(r.key, r["rows"]) for r in streaming.read.schema(make().schema).parquet(out).where("closed").collect()}
    assert closed == {("a", 1), ("b", 3)}  # a row of c came before the watermark had passed its time


def test_streams_need_the_state_store(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value", "'x' AS k")
    with pytest.raises(ValueError, match="RocksDB"):
        profiles.stream_sketches(stream, key="k", value="value", item="k")


def test_windows_and_sessions_of_a_stream_equal_those_of_a_table(spark, sf, tmp_path):
    """A late event drives the watermark past all windows, so that every window comes out."""
    events = table(spark, sf, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    end = spark.createDataFrame([("end", 0.0, dt.datetime(2030, 1, 1), -1)], "event_type string, value double, ts timestamp, user_id long")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, windows in (("tumbling", lambda df: tails.tumbling(df, "1 day")), ("sliding", lambda df: tails.tumbling(df, "2 days", "1 day")), ("sessions", lambda df: tails.sessions(df, "6 hours"))):
        make = lambda w=windows: w(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
        at, out = f"{tmp_path}/{name}-at", f"{tmp_path}/{name}"
        for more in (None, end, end.withColumn("ts", F.col("ts") + F.expr("interval 1 day"))):
            if more is not None:
                more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            make().writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        got = Counter(tuple(r) for r in spark.read.parquet(out).collect() if "end" not in tuple(r) and -1 not in tuple(r))
        assert got == Counter(tuple(r) for r in windows(events).collect()) and len(got) > 10


def test_a_hundred_workbooks_are_read_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    for i in range(100):
        (tmp_path / f"sub{i % 3}").mkdir(exist_ok=True)
        rows = [["k", None, "k"], [None, "", None], *[[i, f"v{j}", j / 2] for j in range(i % 5)]]
        (tmp_path / f"sub{i % 3}" / f"book{i}.xlsx").write_bytes(xlsx.workbook({"One": rows, "Two & <more>": [["x"], [f"y{i}"]], "Empty": []}))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "empty.xlsx").write_bytes(b"")
    files = xlsx.binaries(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() > 1
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    rows = xlsx.read_workbooks(files)
    assert {(r.path.rsplit("/", 1)[-1], r.error is not None) for r in rows.where("error IS NOT NULL").collect()} == {("broken.xlsx", True)}
    got = Counter((r.sheet, tuple(r.header), tuple(r.cells)) for r in rows.where("error IS NULL").collect())
    want = Counter({("Two & <more>", ("x",), (f"y{i}",)): 1 for i in range(100)})
    for i in range(100):
        want.update(("One", ("k", "column_2", "k"), (str(i), f"v{j}", str(j // 2) if j % 2 == 0 else repr(j / 2))) for j in range(i % 5))
    assert got == want
    one = xlsx.as_table(rows.where("sheet = 'One'"), ["k", "column_2", "k"])
    assert one.columns == ["k", "column_2", "k_2"]


def books(folder, names):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / f"{name}.xlsx").write_bytes(xlsx.workbook({"Sheet": [["a", "b"], *[[name, j] for j in range(len(name))]], "sheet": [["a"], [1]]}))


def test_a_corpus_is_loaded_once(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    books(folder, ["one", "three", "fifteen"])
    assert corpus.reconciled(spark, target).collect() == [] and corpus.tables(spark, target).collect() == []
    assert corpus.load(spark, str(folder), target) == 6
    (folder / "copy of one.xlsx").write_bytes((folder / "one.xlsx").read_bytes())
    (folder / "bad.xlsx").write_bytes(b"PK")
    assert corpus.load(spark, str(folder), target) == 0
    # a load that died: its tables are there, its manifest isn't
    books(folder, ["seventeen"])
    before = corpus.manifest(spark, target).collect()
    whole = spark.createDataFrame(before, corpus.MANIFEST)
    assert corpus.load(spark, str(folder), target) == 2
    import shutil

    shutil.rmtree(f"{target}/manifest")
    whole.coalesce(1).write.parquet(f"{target}/manifest")
    odd = [r for r in corpus.reconciled(spark, target).collect() if not r.equal]
    assert len(odd) == 1 and odd[0].table_name.startswith("not in the manifest") or len(odd) == 2
    assert corpus.tables(spark, target).count() == 3 + 5 + 7 + 3
    assert corpus.load(spark, str(folder), target) == 2 and corpus.load(spark, str(folder), target) == 0
    rows = corpus.reconciled(spark, target).collect()
    assert len(rows) == 8 and all(r.equal for r in rows) and corpus.tables(spark, target).count() == 3 + 5 + 7 + 9 + 4
    names = [r.table_name for r in rows if r.table_name.startswith("one_")]
    assert len(set(names)) == 2
    got = {tuple(map(tuple, corpus.table(spark, target, n).collect())) for n in names}
    assert got == {(("one", "0"), ("one", "1"), ("one", "2")), (("1",),)}
    assert corpus.table(spark, target, names[0]).columns in (["a", "b"], ["a"])
    with pytest.raises(KeyError):
        corpus.table(spark, target, "none")


def test_nested_records(spark):
    deep = {"a": {"Top_Values": [1], "b": [{"examples": ["x"], "c d!": "mail a.b@example.org"}, {"c d!": 3}]}, "e": [], "f": None, "g": True}
    rows = [(1, json.dumps(deep)), (2, "null"), (3, None), (4, "{broken"), (5, '"+1 (555) 010-9999 x"'), (6, "[" * 5000 + "]" * 5000), (7, "{}")]
    got = {r.id: r for r in clean_records(spark.createDataFrame(rows, "id int, rec string").withColumn("clean", F.lit(1)), "rec").collect()}
    assert json.loads(got[1].clean) == {"a": {"b": [{"c_d": "mail <redacted_email>"}, {"c_d": 3}]}, "e": [], "f": None, "g": True}
    assert got[1].removed == ["a.Top_Values", "a.b[].examples"] and got[1].redacted == ["a.b[].c d!"]
    assert [(x.path, x.value) for x in got[1].leaves] == [("a.b[].c_d", "mail <redacted_email>"), ("a.b[].c_d", "3"), ("e", "[]"), ("f", None), ("g", "true")]
    assert (got[2].clean, got[2].leaves[0].value) == ("null", None) and (got[3].clean, got[3].leaves, got[3].error) == (None, [], None)
    assert got[4].clean is None and got[4].error.startswith("JSONDecodeError") and got[5].clean == '"<redacted_phone> x"'
    assert got[6].clean is None and got[6].error.startswith("RecursionError") and got[7].clean == "{}"
