import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest

from tests.oracle import assert_same, connect
from tidemark.llm import conversations as C
from tidemark.llm.queries import ORACLES, QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
BEGUN = re.compile(r"(s?(ua)*u?)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_hand(rows):
    """The cheapest edits by search over all legal beginnings, whole audits compared; rows are (turn, role, text) in order."""
    fault = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, initials, kept = heapq.heappop(heap)
        if k == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
        if (k, initials, audit) in done or len(audit) > 2 * len(rows) + 2:
            continue
        done.add((k, initials, audit))
        options = [(3, "I", k, "u", ("user", "")), (3, "I", k, "a", ("assistant", ""))]
        if k < len(rows):
            role, text = rows[k][1:]
            options.append((4, "D", k + 1, "", None))
            if fault[k] not in ("blank", "duplicate"):
                more = 3 * (fault[k] == "truncated")
                options += [(more, "K", k + 1, role[:1], (role, text))] if role else []
                options += [(3 + more, "R", k + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for price, letter, at, initial, turn in options:
            if BEGUN.fullmatch(initials + initial):
                heapq.heappush(heap, (cost + price, audit + letter, at, initials + initial, (*kept, turn) if turn else kept))


def digest(rows):
    cost, audit, text = by_hand(rows)
    fault, turns = faults(rows), {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def ordered(rows):
    fill = lambda v: " " if v is None else v
    return sorted(((t, fill(r), fill(x)) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def digested(df):
    return {r.conv_id: tuple(r)[1:] for r in C.digests(C.edited(df)).collect()}


def random_rows(rng, n):
    roles = rng.choice([["user", "assistant"], ["system", "user", "assistant", "tool"], ["user", "ux", "student", "", None]])
    texts = ["a.", "b", "c!", "", " \t", None, "d? ", "e\x0b", "f. ", "é.\n"]
    return [(rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_repair_equals_search_over_all_edits(spark):
    rng = random.Random(3)
    convs = {i: random_rows(rng, rng.randint(1, 7)) for i in range(250)} | {None: random_rows(rng, 5)}
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS _n", "2 AS place", "3 AS _conv")
    got = digested(df)
    assert got == {c: digest(ordered(rows)) for c, rows in convs.items()}


def test_query_damages_as_stated(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["One. Two.", "x!", "y", None])) for c in [None, *range(40)] for t in [None, *range(rng.randint(1, 5))]]
    rows.append((99, 1, "user", "gone."))
    while zlib.crc32(f"{rows[-1][0]}:1".encode()) % 20:
        rows[-1] = (rows[-1][0] + 1, *rows[-1][1:])
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for conv, some in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        left = []
        for _, turn, role, text in some:
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text or " ") if fate == 2 else text
            left += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        want[conv] = digest(ordered(left)) if left else (0,) * 6 + ("", hashlib.sha256().hexdigest())
    out = C.op11_conversation_repair(spark, str(tmp_path))
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == want
    con = connect("/root/testdata/sf0.001")
    con.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = out.columns
    assert {r[names[0]]: tuple(r[c] for c in names) for r in out.collect()} == {r[0]: r for r in con.sql(f"SELECT {', '.join(names)} FROM ({C.OP11_SQL})").fetchall()}


@pytest.mark.parametrize("name", ["op11_conversation_repair"])
def test_query_equals_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


def test_edits_are_the_repaired_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "No"), (1, 2, "assistant", "No")]
    got = [tuple(r) for r in C.edited(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()]
    assert [g[2] for g in got] == ["Keep", "Rerole", "Keep", "Delete"]
    assert [(g[6], g[7]) for g in got if g[2] != "Delete"] == [("system", "Be kind."), ("user", "Yes."), ("assistant", "No")]
    assert [g[1] for g in got] == list(range(4))


def test_long_conversation_is_streamed(spark):
    """100,000 rows of one conversation: few of them are held, and copies are counted before."""
    rng = random.Random(6)
    rows = [C.Row(i, rng.choice(["user", "assistant", "system", "tool"]), f"{i}.", rng.choice(["", "", "truncated", "blank"])) for i in range(100_000)]
    repair, most, n = C.Repair(), 0, 0
    for row in rows:
        repair.add(row)
        n += sum(r is not None for _, _, r in repair.decided())
        most = max(most, len(repair.rows))
    n += sum(r is not None for _, _, r in repair.end())
    assert n == len(rows) and most < 200
    df = spark.range(60_000).selectExpr("id % 2 AS conv_id", "1L AS turn", "'user' AS role", "'Hello.' AS text")
    assert {c: (d[2], d[5], d[6][:3], len(d[6])) for c, d in digested(df).items()} == dict.fromkeys((0, 1), (29_999, 29_999 * 4 + 3, "KDD", 30_001))


def test_empty_table(spark):
    assert C.digests(C.edited(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
