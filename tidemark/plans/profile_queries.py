"""Profiling, personal data, redaction and row-level hygiene over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import day, number, present, ratio4
from ..operators import profile as P
from ..tables import TABLES, table
from . import derived
from .kit import Book, values, values_sql

B = Book()
PROFILED = {"orders": ("o_orderstatus", "o_orderpriority", "o_custkey"), "customer": ("c_mktsegment", "c_nationkey", "c_custkey"), "part": ("p_brand", "p_type", "p_size")}


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@B.add(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def scan_catalog(spark, sf):
    return _union([table(spark, sf, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES])


_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM {t}" for t, cs in PROFILED.items() for c in cs)


def _counts(spark, sf):
    return _union([P.value_counts(table(spark, sf, t), cs).withColumn("table_name", F.lit(t)) for t, cs in PROFILED.items()])


@B.add(f"SELECT tab AS table_name, col AS column_name, CAST(count(*) AS BIGINT) AS row_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count FROM ({_CELLS}) GROUP BY 1, 2")
def profile_totals(spark, sf):
    parts = [P.totals(P.value_counts(table(spark, sf, t), cs)).select(F.lit(t).alias("table_name"), F.col("column").alias("column_name"), "row_count", "null_count", "distinct_count") for t, cs in PROFILED.items()]
    return _union(parts)


@B.add("""SELECT count(*) AS row_count, count(*) - count(quality) AS null_count, floor((count(*) - count(quality)) / CAST(count(*) AS DOUBLE) * 10000 + 0.5) / 10000.0 AS null_ratio
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def profile_null_ratio(spark, sf):
    one = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = table(spark, sf, "documents").select("doc_id").join(one, "doc_id", "left")
    g = joined.agg(F.count("*").alias("row_count"), F.count_if(F.col("quality").isNull()).alias("null_count"))
    return g.withColumn("null_ratio", ratio4(F.col("null_count"), F.col("row_count")))


@B.add(f"""SELECT tab AS table_name, col AS column_name, v AS value, n, CAST(rk AS INT) AS rank FROM (SELECT tab, col, v, count(*) AS n, row_number() OVER (PARTITION BY tab, col ORDER BY count(*) DESC, v) AS rk
FROM ({_CELLS}) WHERE v IS NOT NULL GROUP BY 1, 2, 3) WHERE rk <= 5""")
def profile_value_counts(spark, sf):
    parts = [P.top_values(P.value_counts(table(spark, sf, t), cs)).select(F.lit(t).alias("table_name"), F.col("column").alias("column_name"), "value", "n", "rank") for t, cs in PROFILED.items()]
    return _union(parts)


@B.add("SELECT min(l_quantity) AS low_quantity, max(l_quantity) AS high_quantity, min(l_extendedprice) AS low_price, max(l_extendedprice) AS high_price, min(l_discount) + 0.0 AS low_discount, max(l_discount) AS high_discount FROM lineitem")
def profile_numeric_extrema(spark, sf):
    df = table(spark, sf, "lineitem")
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    return df.agg(*[(f(F.col(c)) + F.lit(0.0)).alias(f"{k}_{n}") for n, c in names.items() for k, f in (("low", F.min), ("high", F.max))])


@B.add("SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders")
def profile_date_extrema(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").agg(F.min(d).cast("string").alias("first_day"), F.max(d).cast("string").alias("last_day"), F.count_distinct(d).alias("days"))


@B.add("SELECT min(length(p_name)) AS min_length, max(length(p_name)) AS max_length, CAST(sum(length(p_name)) AS BIGINT) AS total_length, count(p_name) AS n FROM part")
def profile_lengths(spark, sf):
    n = F.length("p_name")
    return table(spark, sf, "part").agg(F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.sum(n).alias("total_length"), F.count("p_name").alias("n"))


_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_GUESSED = {"orders": ("o_orderkey", "o_orderstatus", "CAST(o_orderdate AS DATE)"), "part": ("p_size", "p_name")}


@B.add("SELECT column_name, CASE WHEN count(v) = 0 THEN 'unknown' WHEN bool_and(regexp_matches(replace(v, ',', ''), " + _NUM + ") OR v IS NULL) THEN 'number' WHEN bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') OR v IS NULL) THEN 'date' WHEN bool_and(lower(v) IN ('true','false','0','1','yes','no','y','n') OR v IS NULL) THEN 'boolean' ELSE 'string' END AS type_guess FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in _GUESSED.items() for c in cs) + ") GROUP BY 1")
def profile_type_guess(spark, sf):
    cells = _union([table(spark, sf, t).select(F.lit(c).alias("column_name"), F.expr(c).cast("string").alias("v")) for t, cs in _GUESSED.items() for c in cs])
    return cells.groupBy("column_name").agg(P.type_guess(F.col("v")).alias("type_guess"))


_KEYS = {"orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey",), "documents": ("doc_id",), "events": ("event_id", "user_id"), "embeddings": ("vec_id",)}


@B.add(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) > 0 AND count(*) = count({c}) AND count(DISTINCT {c}) = count(*) AND ('{c}' LIKE '%id') AS join_key_candidate FROM {t}" for t, cs in _KEYS.items() for c in cs))
def profile_join_keys(spark, sf):
    parts = []
    for t, cs in _KEYS.items():
        g = P.totals(P.value_counts(table(spark, sf, t), cs))
        ok = (F.col("row_count") > 0) & (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")) & pii.column_name(F.col("column")).endswith("id")
        parts.append(g.select(F.lit(t).alias("table_name"), F.col("column").alias("column_name"), ok.alias("join_key_candidate")))
    return _union(parts)


@B.add("SELECT o_orderstatus AS value, count(*) AS n, CAST(sum(length(o_orderstatus)) AS BIGINT) AS total_length FROM orders GROUP BY 1")
def profile_weighted(spark, sf):
    counts = P.value_counts(table(spark, sf, "orders"), ["o_orderstatus"]).where("value is not null")
    return counts.select("value", "n", (F.length("value") * F.col("n")).alias("total_length"))


_N = "trim(regexp_replace(lower(trim(c)), '[^a-z0-9]+', '_', 'g'), '_')"


def _hint(kind: str, hints: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{h}'" for h in hints)
    return f"CASE WHEN n IN ({listed}) OR len(list_intersect(string_split(n, '_'), [{listed}])) > 0 THEN '{kind}' END"


_PERSON = f"""CASE WHEN n IN ({', '.join(f"'{h}'" for h in pii.PERSON_NAMES)}) OR (string_split(n, '_')[-1] = 'name' AND len(list_intersect(string_split(n, '_')[:-2], [{', '.join(f"'{h}'" for h in pii.PERSON_WORDS)}])) > 0) THEN 'person_name' END"""


@B.add(f"SELECT c AS column_name, array_to_string(list_sort(list_filter([{', '.join(_hint(k, h) for k, h in pii.NAME_HINTS.items())}, {_PERSON}], lambda x: x IS NOT NULL)), ',') AS categories FROM (SELECT c, {_N} AS n FROM (SELECT DISTINCT col AS c FROM {derived.CATALOG}))")
def pii_by_name(spark, sf):
    return derived.columns(spark, sf).select(F.col("column").alias("c")).distinct().select(F.col("c").alias("column_name"), F.array_join(pii.name_categories(F.col("c")), ",").alias("categories"))


_EMAIL, _PHONE = "'(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}'", "'(^|[^0-9])(\\+?[0-9][0-9\\-\\s().]{7,}[0-9])([^0-9]|$)'"


@B.add("""SELECT 'documents' AS table_name, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 1 ELSE 0 END) AS BIGINT) AS emails FROM (SELECT trim(text) AS v FROM documents WHERE trim(text) <> '' ORDER BY doc_id LIMIT 50)
UNION ALL SELECT 'customer', count(*), CAST(sum(CASE WHEN regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT trim(c_name) AS v FROM customer WHERE trim(c_name) <> '' ORDER BY c_custkey LIMIT 50)""".replace("\\\\", "\\"))
def pii_by_value_ratio(spark, sf):
    """What the rule on value patterns looks at: the first 50 present values by key."""
    parts = []
    for t, key, c in (("documents", "doc_id", "text"), ("customer", "c_custkey", "c_name")):
        first = P.within_first(table(spark, sf, t), key, c)
        parts.append(first.agg(F.count("*").alias("n"), F.count_if(F.col("value").rlike(pii.EMAIL_WHOLE)).alias("emails")).select(F.lit(t).alias("table_name"), "n", "emails"))
    return _union(parts)


_CONTACTS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'a' || page_id || '@example.org' END AS mostly, CASE page_id % 4 WHEN 0 THEN 'b' || page_id || '@example.org' ELSE 'none given' END AS seldom, CASE page_id % 2 WHEN 0 THEN '+1 (555) 010-' || (1000 + page_id % 9000) ELSE ' n/a ' END AS call, url FROM pages"


def _share_sql(c: str, pattern: str) -> str:
    v = f"CASE WHEN lower(trim({c})) NOT IN ('', 'null', 'none', 'n/a', 'na', 'nan') THEN trim({c}) END"
    return f"coalesce(CAST(count(*) FILTER (regexp_matches({v}, '{pattern}')) AS DOUBLE) / nullif(count({v}), 0), 0) >= 0.5"


@B.add(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {_share_sql(c, '^[^@[:space:]]+@[^@[:space:]]+[.][^@[:space:]]+$')} OR {_share_sql(c, '^[+][0-9][0-9[:space:]().-]{7,}[0-9]$')} AS is_pii, count(*) AS row_count FROM ({_CONTACTS})" for c in ("mostly", "seldom", "call", "url")))
def pii_by_value_verdict(spark, sf):
    """profile()'s verdict on columns of made-up contacts: personal if half of all present values have the shape of an address or a phone."""
    contacts = derived.session(spark, sf).sql(_CONTACTS)
    return P.profile(contacts, "contacts", ["mostly", "seldom", "call", "url"]).select(F.col("column").alias("column_name"), "is_pii", "row_count")


_WHOLE = {"lineitem": "l_returnflag l_linestatus l_linenumber l_orderkey", "documents": "text lang source", "customer": "c_name c_mktsegment c_nationkey"}


@B.add(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS cardinality, coalesce(min(length(v)), 0) AS min_length, coalesce(max(length(v)), 0) AS max_length FROM (SELECT CASE WHEN lower(trim(CAST({c} AS VARCHAR))) NOT IN ('', 'null', 'none', 'n/a', 'na', 'nan') THEN trim(CAST({c} AS VARCHAR)) END AS v FROM {t})" for t, cs in _WHOLE.items() for c in cs.split()))
def profile_whole_tables(spark, sf):
    """profile() itself over whole columns of three tables."""
    parts = [P.profile(table(spark, sf, t), t, cs.split()) for t, cs in _WHOLE.items()]
    return _union(parts).select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "row_count", "null_count", "cardinality", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("min_length", "max_length")])


def _pii_flags(df, key, text):
    return df.select(F.col(key), pii.has_email(F.col(text)).alias("has_email"), pii.has_phone(F.col(text)).alias("has_phone")).where("has_email or has_phone")


@B.add(f"SELECT doc_id, regexp_matches(text, {_EMAIL}) AS has_email, regexp_matches(text, {_PHONE}) AS has_phone FROM documents WHERE regexp_matches(text, {_EMAIL}) OR regexp_matches(text, {_PHONE})")
def pii_documents(spark, sf):
    return _pii_flags(table(spark, sf, "documents"), "doc_id", "text")


@B.add(f"SELECT page_id, regexp_matches(html, {_EMAIL}) AS has_email, regexp_matches(html, {_PHONE}) AS has_phone FROM pages WHERE regexp_matches(html, {_EMAIL}) OR regexp_matches(html, {_PHONE})")
def pii_pages(spark, sf):
    return _pii_flags(table(spark, sf, "pages"), "page_id", "html")


# pii.PHONE for an engine without look-around: a run's last digit is never followed by one, and its first digit or plus
# follows one only as in 1+2, which is taken apart before.
_RUN = r"\+?[0-9][0-9\-\s().]{7,}[0-9]"
EMAIL_SQL, RUN_SQL = _EMAIL, _RUN


@B.add(rf"SELECT doc_id, length(r) AS n_chars, md5(r) AS digest FROM (SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(text, {_EMAIL}, '<redacted_email>', 'g'), '([0-9])\+', '\1' || chr(1) || '+', 'g'), '{_RUN}', '<redacted_phone>', 'g'), chr(1), '') AS r FROM documents)")
def redact_documents(spark, sf):
    t = pii.redact(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


_LITERALS = [
    (1, "key sk-" + "a1B2" * 6), (2, "AKIA" + "ABCD1234" * 2), (3, "token = abc123"), (4, "authorization: bearer xyz.123"), (5, "postgresql://u@h/db"), (6, "nothing here"),
    (7, "write to a.b@example.org"), (8, "see /Users/someone/file"), (9, "worker-12 is down"), (10, "mysql://h"), (11, None),
]


def _secret_sql(source: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT '{source}' AS source, {key} AS id, '{n}' AS pattern FROM {source} WHERE regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}')" for n, p in pii.SECRETS.items())


@B.add(" UNION ALL ".join([_secret_sql("documents", "doc_id", "text"), _secret_sql("pages", "page_id", "html"), f"SELECT 'literals' AS source, id, pattern FROM ({_secret_sql('lits', 'id', 't')})".replace("FROM lits", f"FROM {values_sql('id, t', _LITERALS)} lits")]))
def secret_scan(spark, sf):
    parts = []
    for source, df, key, text in (("documents", table(spark, sf, "documents"), "doc_id", "text"), ("pages", table(spark, sf, "pages"), "page_id", "html"), ("literals", values(spark, "id, t", _LITERALS), "id", "t")):
        hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in pii.SECRETS.items()]))
        parts.append(df.select(F.lit(source).alias("source"), F.col(key).cast("long").alias("id"), F.explode(hits).alias("pattern")))
    return _union(parts)


@B.add(f"""SELECT id, v AS value, CASE WHEN regexp_matches(replace(v, ',', ''), {_NUM}) THEN TRY_CAST(replace(v, ',', '') AS DOUBLE) END AS as_number,
CAST(CASE WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN CAST(try_strptime(v, '%Y-%m-%d') AS DATE) WHEN regexp_matches(v, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$') THEN CAST(try_strptime(v, '%Y/%m/%d') AS DATE)
WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[T ][0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}$') THEN CAST(try_strptime(replace(v, 'T', ' '), '%Y-%m-%d %H:%M:%S') AS DATE) END AS VARCHAR) AS as_date
FROM (SELECT id, CASE WHEN lower(trim(t)) IN ('', 'null', 'none', 'n/a', 'na', 'nan') THEN NULL ELSE trim(t) END AS v FROM {derived.sql('cells')})""")
def missing_normalised(spark, sf):
    v = present(F.col("t"))
    return derived.relation(spark, sf, "cells").select("id", v.alias("value"), number(v).alias("as_number"), day(v).cast("string").alias("as_date"))


@B.add("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_keep_first(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    return first.select(F.col("m.event_id").alias("event_id"), "user_id", "event_type")


@B.add("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def dedupe_keep_best(spark, sf):
    best = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("e"))).alias("m"))
    return best.select("user_id", (-F.col("m.e")).alias("event_id"), F.col("m.value").alias("value"))


@B.add("SELECT sha256(string_agg(CAST(r_regionkey AS VARCHAR) || '|' || r_name, chr(10) ORDER BY r_regionkey)) AS checksum, 'region' AS table_name FROM region UNION ALL SELECT sha256(string_agg(CAST(n_nationkey AS VARCHAR) || '|' || n_name, chr(10) ORDER BY n_nationkey)), 'nation' FROM nation")
def row_checksum(spark, sf):
    """Tables of a few rows only: the rows of one are hashed as one text."""
    parts = []
    for t, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")):
        rows = F.array_sort(F.collect_list(F.struct(F.col(k), F.concat_ws("|", F.col(k).cast("string"), n).alias("line"))))
        parts.append(table(spark, sf, t).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("checksum")).withColumn("table_name", F.lit(t)))
    return _union(parts)


QUERIES, ORACLES = B.queries, B.oracles
