"""Repair of a conversation's structure by the cheapest edits, by dynamic programming over the turns that are retained.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in
turn, the last an assistant's. Edits: keep a row (0), rerole it to user or assistant (3), delete it
(4; blank rows and repeats must go), insert an empty turn of user or assistant (3). A truncated row
that stays costs 3 more. Of the cheapest edits those whose initials (D, I, K, R) come first in ASCII
order are taken.

For each role that the last retained turn may have, the running minimum of (cost - 4 x rows so far) is
kept: the rows of a gap between two retained turns are deleted, which the prefix sum 4 x rows prices, and
the pair of roles at its ends says whether a turn is inserted in it. Deletions come first in a gap, as D is
before I. Equal costs are told apart by the audits' order, which is kept as ranks: no audit so far is the
beginning of another one, since all hold as many letters other than I and none ends in I. So a row takes constant time.
A state that is over MARGIN above the best one can't win any more, as the best one gets as far by two insertions and a deletion.

One task streams a conversation out of a sort that spills, and hands on the edits that all states' paths share; it
holds the rows behind them, a few, not the conversation. Rows that are equal are counted before. (A digest of a
conversation's whole text goes through it in order, so one task at least must see all its rows.)

Defined results: null in role or text is one space; null in conv_id is a conversation of its own, null turns come first; rows of
one turn are ordered by role and text; a role without any character has no initial and can't be kept. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import ship

#: Fixed values of the task: prices of edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the last retained turn is: none yet, system, user or assistant.
NONE, S, U, A = range(4)
#: (last, next): a turn to be inserted between them. Pairs that aren't listed can't be.
BETWEEN = {(NONE, S): "", (NONE, U): "", (NONE, A): "I", (S, U): "", (S, A): "I", (U, A): "", (U, U): "I", (A, U): "", (A, A): "I"}
ROLE = {U: "user", A: "assistant"}
MARGIN = 2 * INSERT + DELETE

SPACE = r"\x20\x09-\x0D"


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str | None
    fault: str


class States(NamedTuple):
    """Of each state the minimum less the least one, or None where it can't be; the audits' ranks."""

    least: tuple[int | None, ...] = (0, None, None, None)
    rank: tuple[int, ...] = (0, 0, 0, 0)


@cache
def step(at: States, initial: str, goes: bool, extra: int) -> tuple[States, int, tuple]:
    """States behind one more row, what their minima are more by, and (state before, edits) of each.

    initial is one of s, u, a, or something else; goes: the row must be deleted; extra: what retaining it costs besides.
    Minima differ by MARGIN at most, so there are few arguments and each is worked out once in a process.
    """
    found = {r: [(at.least[r], at.rank[r], "D", r)] for r in range(4) if at.least[r] is not None}
    for (last, role), between in BETWEEN.items():
        if goes or at.least[last] is None or (role == S and initial != "s"):
            continue
        kept = "nsua"[role] == initial
        price = INSERT * len(between) + (0 if kept else REROLE) + extra - DELETE
        found.setdefault(role, []).append((at.least[last] + price, at.rank[last], between + ("K" if kept else "R"), last))
    best = {r: min(options) for r, options in found.items()}
    base = min(b[0] for b in best.values())
    best = {r: b for r, b in best.items() if b[0] - base <= MARGIN}
    order = sorted(best, key=lambda r: best[r][1:3])
    states = States(tuple(best[r][0] - base if r in best else None for r in range(4)), tuple(order.index(r) if r in best else 0 for r in range(4)))
    return states, base, tuple((best[r][3], best[r][2]) if r in best else None for r in range(4))


class Repair:
    """Rows of one conversation that aren't decided yet."""

    def __init__(self):
        self.at, self.cost, self.check = States(), 0, 64
        self.rows: list[tuple[Row, tuple]] = []

    def add(self, row: Row) -> None:
        initial = row.role[:1] if row.role[:1] in ("s", "u", "a") else ""
        self.at, more, back = step(self.at, initial, row.fault in ("blank", "duplicate"), TRUNCATED if row.fault == "truncated" else 0)
        self.cost += DELETE + more
        self.rows.append((row, back))

    def decided(self) -> Iterator[tuple[str, str, Row | None]]:
        """(edit, new role, row) of the rows that all states' paths agree on; they are forgotten here."""
        if len(self.rows) < self.check:
            return
        states, n = {r for r in range(4) if self.at.least[r] is not None}, len(self.rows)
        while n and len(states) > 1:
            n -= 1
            states = {self.rows[n][1][r][0] for r in states}
        yield from self._path(states.pop(), n)
        self.check = max(64, 2 * len(self.rows))

    def end(self) -> Iterator[tuple[str, str, Row | None]]:
        """What is left, by the cheapest last state."""
        least, rank = self.at
        ends = [(least[r] + INSERT * len(tail), rank[r], tail, r) for r, tail in ((NONE, ""), (U, "I"), (A, "")) if least[r] is not None]
        more, _, tail, state = min(ends)
        self.cost += more
        yield from self._path(state, len(self.rows))
        if tail:
            yield "Insert", ROLE[A], None

    def _path(self, state: int, n: int) -> Iterator[tuple[str, str, Row | None]]:
        steps = []
        for row, back in reversed(self.rows[:n]):
            before, edits = back[state]
            steps.append((before, edits, state, row))
            state = before
        del self.rows[:n]
        for before, edits, now, row in reversed(steps):
            if edits[0] == "I":
                yield "Insert", ROLE[A if before == U else U], None
            if edits[-1] == "D":
                yield "Delete", row.role, row
            else:
                yield ("Keep", row.role, row) if edits[-1] == "K" else ("Rerole", ROLE[now], row)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[Row]]]:
    """Conversations of sorted rows one after another; the rows of each must be taken before the next."""
    flat = (r for batch in batches for part in range(0, len(batch), 1024) for r in batch.slice(part, 1024).to_pylist())
    row = next(flat, None)

    def rows() -> Iterator[Row]:
        nonlocal row
        first = row["_conv"]
        while row is not None and row["_conv"] == first:
            for copy in range(row["_n"]):
                repeated = copy or not row["_new"]
                fault = "blank" if row["_blank"] else "duplicate" if repeated else "truncated" if row["_cut"] else ""
                yield Row(row["_turn"], row["_role"], None if row["_blank"] or repeated else row["_text"], fault)
            row = next(flat, None)

    while row is not None:
        yield row["_conv"], rows()


def _edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for conv, rows in _conversations(batches):
        repair, place = Repair(), 0

        def edits(repair: Repair = repair, rows: Iterator[Row] = rows) -> Iterator[tuple[str, str, Row | None]]:
            for row in rows:
                repair.add(row)
                yield from repair.decided()
            yield from repair.end()

        for edit, role, row in edits():
            text = "" if row is None else None if edit == "Delete" else row.text
            out.append((conv, place, edit, *((row.fault, row.turn, row.role) if row else ("", None, None)), role, text))
            place += 1
            size += len(text or "") + 64
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def edited(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits of all conversations: conv_id, place, edit (Keep, Rerole, Delete or Insert), fault, turn, old_role, role, text.

    Rows of a conversation lie together and in order, from place 0 on. fault is blank, duplicate, truncated or empty, the first that applies.
    text is null in deleted rows and empty in inserted ones; these have no turn and no old_role. Rows but Delete are the repaired conversation.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), _spaced(F.col(role_col)).alias("_role"), _spaced(F.col(text_col)).alias("_text"))
    rows = rows.groupBy("_conv", "_turn", "_role", "_text").agg(F.count("*").alias("_n")).repartition("_conv")
    rows = rows.withColumns({"_k1": F.xxhash64("_role", "_text"), "_k2": F.xxhash64(F.lit(1), "_role", "_text")})
    first = F.row_number().over(Window.partitionBy("_conv", "_k1", "_k2").orderBy(F.asc_nulls_first("_turn"))) == 1
    rows = rows.withColumns(
        {
            "_new": first,
            "_blank": ~F.col("_text").rlike(f"[^{SPACE}]"),
            "_cut": F.col("_text").rlike(rf"[^.!?{SPACE}][{SPACE}]*\z"),
        }
    )
    rows = rows.select("_conv", "_turn", "_role", "_text", "_n", "_new", "_blank", "_cut").sortWithinPartitions(F.asc_nulls_first("_conv"), F.asc_nulls_first("_turn"), "_role", "_text")
    kind = rows.schema["_conv"].dataType
    fields = [("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("old_role", pa.string()), ("role", pa.string()), ("text", pa.string())]
    schema = pa.schema(fields)
    return rows.mapInArrow(lambda it: _edited(it, schema), f"conv_id {kind.simpleString()}, place long, edit string, fault string, turn long, old_role string, role string, text string")


def _digested(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    done, now = [], None
    for batch in batches:
        for part in range(0, len(batch), 1024):
            for r in batch.slice(part, 1024).to_pylist():
                if r["place"] == 0:
                    if now:
                        done.append(now.row())
                    now = _Digest(r["conv_id"])
                now.take(r)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), schema, strict=True)], schema=schema)


class _Digest:
    """Counts of one conversation's faults, its cost, audit and hash, from its edits in order."""

    def __init__(self, conv: object):
        self.conv, self.faults, self.illegal, self.cost = conv, {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0, 0
        self.audit, self.hash, self.empty = [], hashlib.sha256(), True
        self.low = self.high = self.initial = None
        self.turns = 0

    def take(self, r: dict) -> None:
        edit = r["edit"]
        self.audit.append(edit[0])
        self.cost += {"Keep": 0, "Rerole": REROLE, "Delete": DELETE, "Insert": INSERT}[edit]
        if edit != "Insert":
            self.faults[r["fault"]] += 1
            self.cost += TRUNCATED if r["fault"] == "truncated" and edit != "Delete" else 0
            initial = r["old_role"][:1]
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            if r["turn"] is not None and r["turn"] != self.high:
                self.low, self.high, self.turns = r["turn"] if self.low is None else self.low, r["turn"], self.turns + 1
        if edit != "Delete":
            self.hash.update(f"{'' if self.empty else chr(10)}{r['role']}:{r['text']}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *(self.faults[k] for k in ("blank", "duplicate", "truncated")), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """One row a conversation of edited(): gaps in its turns, faults, the cost and audit of its edits, the hash of what it is repaired to."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = edits.schema["conv_id"].dataType
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return edits.mapInArrow(lambda it: _digested(it, schema), f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with known faults, dealt by crc32(conv_id:turn) modulo 20: 0 row lost, 1 text emptied, 2 ends of sentences lost, 3 row repeated, 4 role user. Nulls of the rest are one space."""
    fate = F.crc32(F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn"))).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"), fate.alias("_fate")).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged in a known way and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = digests(edited(damaged(turns))).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").drop("_conv")
    zero = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return out.fillna(zero).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


#: The same by brute force over strings: every state carries its cost, audit and repaired text, and ties compare whole audits.
OP11_SQL = r"""
WITH RECURSIVE
bytes AS (SELECT conv_id, turn, role, text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(k) + 1), lambda i: ascii(k[i])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda j: j::BIGINT)), lambda v, j: xor(v >> 1, (v & 1) * 3988292384)) ), 4294967295) % 20 AS fate
  FROM bytes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_extract(text, '([^ \t-\r])[ \t-\r]*\z', 1) AS final
  FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS i, left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) AS i0,
    CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- states: n nothing retained, s, u, a; each a list of at most one (cost, audit, text)
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, [{'c': 0, 'd': '', 't': ''}] AS n, [{'c': 0, 'd': '', 't': ''}][:0] AS s, [{'c': 0, 'd': '', 't': ''}][:0] AS u, [{'c': 0, 'd': '', 't': ''}][:0] AS a FROM judged
  UNION ALL
  SELECT dp.conv_id, dp.k + 1,
    list_transform(n, lambda x: {'c': x.c + 4, 'd': x.d || 'D', 't': x.t}),
    list_sort(list_concat(list_transform(s, lambda x: {'c': x.c + 4, 'd': x.d || 'D', 't': x.t}),
      list_transform(CASE WHEN j.i = 's' AND fault NOT IN ('blank', 'duplicate') THEN n ELSE n[:0] END, lambda x: {'c': x.c + IF(fault = 'truncated', 3, 0), 'd': x.d || 'K', 't': x.t || chr(10) || role || ':' || text})))[:1],
    list_sort(list_concat(list_transform(u, lambda x: {'c': x.c + 4, 'd': x.d || 'D', 't': x.t}),
      list_transform(CASE WHEN fault NOT IN ('blank', 'duplicate') THEN list_concat(n, s, a) ELSE n[:0] END,
        lambda x: {'c': x.c + IF(j.i = 'u', 0, 3) + IF(fault = 'truncated', 3, 0), 'd': x.d || IF(j.i = 'u', 'K', 'R'), 't': x.t || chr(10) || IF(j.i = 'u', role, 'user') || ':' || text}),
      list_transform(CASE WHEN fault NOT IN ('blank', 'duplicate') THEN u ELSE n[:0] END,
        lambda x: {'c': x.c + 3 + IF(j.i = 'u', 0, 3) + IF(fault = 'truncated', 3, 0), 'd': x.d || 'I' || IF(j.i = 'u', 'K', 'R'), 't': x.t || chr(10) || 'assistant:' || chr(10) || IF(j.i = 'u', role, 'user') || ':' || text})))[:1],
    list_sort(list_concat(list_transform(a, lambda x: {'c': x.c + 4, 'd': x.d || 'D', 't': x.t}),
      list_transform(CASE WHEN fault NOT IN ('blank', 'duplicate') THEN u ELSE n[:0] END,
        lambda x: {'c': x.c + IF(j.i = 'a', 0, 3) + IF(fault = 'truncated', 3, 0), 'd': x.d || IF(j.i = 'a', 'K', 'R'), 't': x.t || chr(10) || IF(j.i = 'a', role, 'assistant') || ':' || text}),
      list_transform(CASE WHEN fault NOT IN ('blank', 'duplicate') THEN list_concat(n, s, a) ELSE n[:0] END,
        lambda x: {'c': x.c + 3 + IF(j.i = 'a', 0, 3) + IF(fault = 'truncated', 3, 0), 'd': x.d || 'I' || IF(j.i = 'a', 'K', 'R'), 't': x.t || chr(10) || 'user:' || chr(10) || IF(j.i = 'a', role, 'assistant') || ':' || text})))[:1]
  FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.k = dp.k + 1),
last AS (
  SELECT conv_id, list_sort(list_concat(n, a, list_transform(u, lambda x: {'c': x.c + 3, 'd': x.d || 'I', 't': x.t || chr(10) || 'assistant:'})))[1] AS best
  FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.d, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""
