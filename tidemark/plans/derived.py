"""Metadata that is derived from the driver's tables: catalogs, policies, terms, cases and the like, as relations whose size follows the tables.

Each is one SELECT that Spark and DuckDB read alike, so a query and its SQL start from the same rows. The operators
that take such metadata are the ones that packs and scans feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import TABLES, register, table

#: Columns of the driver's tables; those of texts are marked.
COLUMNS = {
    "region": "r_regionkey r_name*", "nation": "n_nationkey n_name* n_regionkey", "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*", "supplier": "s_suppkey s_name* s_nationkey s_acctbal",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate", "events": "event_id ts user_id event_type* value props*",
    "documents": "doc_id text* lang* source* n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url* html*", "benchmark": "item_id text*", "labels": "doc_id quality toxic", "conversations": "conv_id turn role* text*",
}


def business_name(table_name: str, column: str) -> str:
    """c_name of customer as customer_name: a one-letter prefix stands for the table."""
    return f"{table_name}_{column[2:]}" if column[1] == "_" else column


#: tab, col, position of all columns that hold a value.
CATALOG = "(" + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{business_name(t, c.rstrip('*'))}' AS col, {i + 1} AS position FROM {t} HAVING count({c.rstrip('*')}) > 0" for t, cs in COLUMNS.items() for i, c in enumerate(cs.split())) + ")"

RELATIONS = {
    # id, ref: metrics and the tables that they need
    "refs": "SELECT 'metric.m' || c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'orders' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN NULL ELSE 'customer' END AS ref FROM customer",
    # family, id
    "ids": "SELECT CASE user_id % 4 WHEN 0 THEN 'tables' WHEN 1 THEN 'columns' WHEN 2 THEN 'metrics' ELSE 'policies' END AS family, 'i' || event_id % 400 || '.' || user_id % 3 AS id FROM events",
    # pos, id, label; asked
    "terms": "SELECT p_partkey AS pos, 'term.' || replace(p_name, ' ', '_') || p_partkey % 40 AS id, p_name || ' ' || p_size AS label FROM part",
    "asked": "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(replace(p_name, ' ', '-')) || '_' || p_size WHEN 1 THEN 'Term.' || replace(p_name, ' ', '  ') || p_partkey % 60 ELSE p_type || ' ' || p_brand END AS asked FROM part",
    # query, id, rank; query, id
    "ranks": "SELECT 'u' || user_id AS query, 'e' || event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events",
    "wanted": "SELECT 'u' || user_id AS query, CASE WHEN event_type = 'error' THEN NULL ELSE 'e' || event_id END AS id FROM events WHERE event_id % 7 = 0",
    # id, suite, status
    "cases": "SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'golden' WHEN 1 THEN 'red_team' ELSE 'retrieval' END AS suite, CASE WHEN value IS NULL THEN 'skipped' WHEN value < 10 THEN 'failed' ELSE 'passed' END AS status FROM events",
    # tab, col, comment, guess
    "comments": "SELECT p_brand AS tab, CASE p_partkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'status' WHEN 2 THEN 'made' ELSE 'code' END AS col, CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'code' WHEN 3 THEN 'name of the ' || p_name WHEN 4 THEN p_type || ' date of entry' WHEN 5 THEN p_name || ' TEST_ONLY_SYNTHETIC_METADATA' ELSE p_type || ' goods of ' || p_brand END AS comment, CASE p_partkey % 2 WHEN 0 THEN 'number' ELSE 'string' END AS guess FROM part",
    # pos, name
    "names": "SELECT doc_id AS pos, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN coalesce(lang, '--') || ' ' || source ELSE upper(source) || '-' END AS name FROM documents",
    # table_schema, table_name, kind
    "catalog": "SELECT lower(n_name) AS table_schema, lower(c_mktsegment) AS table_name, CASE WHEN c_acctbal < 0 THEN 'VIEW' ELSE 'TABLE' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey",
    # id, k, v
    "maps": "SELECT page_id AS id, 'url' AS k, url AS v FROM pages UNION ALL SELECT page_id, 'samples', url FROM pages UNION ALL SELECT page_id, 'note', 'mail a' || page_id || '.b@example.org' FROM pages",
    # id, metadata_source, can_use_for_text2sql, is_test_only, requires_human_confirmation
    "provenances": "SELECT doc_id % 500 AS id, CASE quality WHEN 1 THEN 'real_db_comment' ELSE 'no_comment' END AS metadata_source, quality = 1 AS can_use_for_text2sql, toxic = 1 AS is_test_only, quality = 0 AS requires_human_confirmation FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    # pack, v
    "versions": "SELECT o_orderpriority AS pack, year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate) AS v FROM orders",
    # id, t: cells as texts, some of which count as missing
    "cells": "SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN ' ' || event_type || ' ' WHEN 1 THEN 'N/A' WHEN 2 THEN CAST(user_id AS STRING) WHEN 3 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 4 THEN ' None' WHEN 5 THEN replace(CAST(CAST(ts AS DATE) AS STRING), '-', '/') WHEN 6 THEN user_id || ',' || event_id % 1000 || '.5' WHEN 7 THEN CAST(CAST(ts AS DATE) AS STRING) || 'T10:11:12' ELSE '' END AS t FROM events",
    # id, role, t, c, cap: an id has one role
    "policies": "SELECT 'p' || c_nationkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'admin' ELSE 'support' END AS role, lower(c_mktsegment) AS t, 'customer.c' || c_custkey % 400 AS c, CAST(10 + c_custkey % 991 AS INT) AS cap FROM customer WHERE c_nationkey <> 6",
    # sql_id, c
    "reads": "SELECT o_orderkey AS sql_id, 'customer.c' || o_custkey % 600 AS c FROM orders",
    # id, l, r; t
    "joins": "SELECT 'j' || s_suppkey AS id, 'n' || s_nationkey AS l, 'n' || s_suppkey * 7 % 25 AS r FROM supplier",
    "candidates": "SELECT 'n' || c_nationkey AS t FROM customer WHERE c_nationkey % 2 = 0",
    "segments": "SELECT lower(c_mktsegment) AS t FROM customer WHERE c_nationkey % 4 = 1",
    # id, target; i
    "questions": "SELECT 'rq' || event_id AS id, 'u' || user_id AS target FROM events WHERE event_type = 'error'",
    "targets": "SELECT 'u' || o_custkey AS i FROM orders WHERE o_orderstatus = 'P'",
    "used": "SELECT 'j' || s_suppkey AS u FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'rq' || event_id FROM events WHERE value > 10",
    # t, m
    "related": "SELECT 'term.' || p_brand AS t, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'metric.' || lower(p_type) || p_size END AS m FROM part",
    # id, need, have, doubt
    "sets": "SELECT conv_id * 1000 + turn AS id, CASE turn % 4 WHEN 0 THEN 'user,assistant' WHEN 1 THEN role WHEN 2 THEN '' ELSE 'system,tool' END AS need, role || ',user' AS have FROM conversations",
    "covers": "SELECT doc_id AS id, coalesce(lang, 'none') || ',' || source || ',x' AS need, coalesce(lang, 'none') || CASE WHEN n_chars % 2 = 0 THEN ',' || source ELSE '' END AS have, n_chars % 3 = 0 AS doubt FROM documents WHERE source IS NOT NULL",
    # card, label
    "labels": "SELECT 'c' || o_custkey % 700 AS card, substr('net revenue of new customers by month', CAST(1 + o_orderkey % 30 AS INT), CAST(1 + o_custkey % 13 AS INT)) AS label FROM orders",
    # id, label
    "duplicate_terms": "SELECT 'term.' || p_partkey AS id, upper(replace(p_name, ' ', '_')) AS label FROM part",
    "metrics": "SELECT DISTINCT 'metric.' || p_name AS id, p_name AS label FROM part WHERE p_size < 3",
    # id, space, status
    "packs": "SELECT 'p' || s_suppkey AS id, 'n' || s_nationkey AS space, CASE WHEN s_acctbal > 0 THEN 'approved' ELSE 'draft' END AS status FROM supplier",
    # id, q
    "statements": "SELECT doc_id AS id, text AS q FROM documents WHERE text IS NOT NULL",
    # card_id, label; q
    "cards": "SELECT 'card.' || p_partkey AS card_id, p_name AS label FROM part",
    "spoken": "SELECT p_name AS q FROM part WHERE p_size = 7",
}


def sql(name: str) -> str:
    return f"({RELATIONS[name]})"


def session(spark: SparkSession, sf: str) -> SparkSession:
    """A session of its own with the tables as views."""
    own = spark.newSession()
    register(own, sf)
    return own


def relation(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return session(spark, sf).sql(RELATIONS[name])


def columns(spark: SparkSession, sf: str) -> DataFrame:
    """CATALOG by one pass over each table: table, column, position."""
    parts = []
    for t in TABLES:
        df = table(spark, sf, t)
        held = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
        rows = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(business_name(t, c)).alias("column"), F.lit(i + 1).alias("position"), F.col(c).alias("n")) for i, c in enumerate(df.columns)])
        parts.append(held.select(F.inline(rows)).where("n > 0").drop("n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
