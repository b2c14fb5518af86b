"""Many questions ranked in one job and judged by cases, the persistent vector index, and profiles of all tables in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capped, retrieval
from ..operators.containment import containing
from ..operators.index import VectorIndex
from ..tables import TABLES, table
from ..workspace import Workspace
from .derived import COLUMNS
from .kit import Book

B = Book()
_NORM = "translate(lower(coalesce({}, '')), '_.-', '   ')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

_RANKED = f"""q AS (SELECT item_id, unnest(list_distinct({_WORDS.format(_NORM.format('text'))})) AS word FROM benchmark),
d AS (SELECT doc_id, {_WORDS.format(_NORM.format('text'))} AS t FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS word FROM d) SEMI JOIN (SELECT DISTINCT word FROM q) USING (word) GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(len(t)) / CAST(count(*) AS DOUBLE) AS mean FROM d),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
parts AS (SELECT item_id, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / mean)) AS s FROM q JOIN tf USING (word) JOIN df USING (word) JOIN d USING (doc_id), st),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT item_id, doc_id, floor(sum(s) * 1000000 + 0.5) / 1000000.0 AS score FROM parts GROUP BY ALL) QUALIFY rank <= 10)"""


def _ranked(spark, sf):
    return retrieval.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10, id_col="doc_id", text_col="text", question_id="item_id", question_text="text")


@B.add(f"WITH {_RANKED} SELECT item_id, doc_id, score, rank FROM ranked")
def retrieval_ranked(spark, sf):
    """Every benchmark item as a question against all documents, in one job."""
    return _ranked(spark, sf)


_CASES = f"""{_RANKED},
expected AS (SELECT b.item_id, d.doc_id, d.source FROM benchmark b JOIN documents d ON contains({_NORM.format('d.text')}, {_NORM.format('b.text')})),
hits AS (SELECT item_id, doc_id, rank, source FROM ranked JOIN documents USING (doc_id)),
ids AS (SELECT item_id, count(*) AS n_expected, count(rank) AS n_found, min(rank) AS first_rank, string_agg(CAST(e.doc_id AS VARCHAR), ', ' ORDER BY CAST(e.doc_id AS VARCHAR)) FILTER (rank IS NULL) AS missing
  FROM expected e LEFT JOIN hits h USING (item_id, doc_id) GROUP BY 1),
types AS (SELECT item_id, type FROM (SELECT item_id, arg_min(source, doc_id) AS type FROM expected GROUP BY 1) t WHERE type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.item_id = t.item_id AND h.source = t.type)),
cases AS (SELECT item_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_found, 0) AS n_found, CASE WHEN coalesce(n_expected, 0) = 0 THEN 1.0::DOUBLE ELSE floor(n_found / CAST(n_expected AS DOUBLE) * 1000000 + 0.5) / 1000000.0 END AS recall,
  coalesce(floor(1 / CAST(first_rank AS DOUBLE) * 1000000 + 0.5) / 1000000.0, 0.0) AS mrr, coalesce(first_rank, 0) AS first_rank, coalesce(missing, '') AS missing, coalesce(type, '') AS missing_types,
  CASE WHEN missing IS NULL AND type IS NULL THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN missing IS NULL AND type IS NULL THEN 'every text that holds the item is found' ELSE concat_ws('; ', 'missing ids: ' || missing, 'missing types: ' || type) END AS reason
  FROM (SELECT item_id FROM benchmark) LEFT JOIN ids USING (item_id) LEFT JOIN types USING (item_id))"""


def _results(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    sources = docs.select("doc_id", "source")
    found = containing(docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text").join(sources, "doc_id")
    texts = found.select(F.col("item_id").alias("case"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("type"))
    kinds = found.groupBy(F.col("item_id").alias("case")).agg(F.min_by("source", "doc_id").alias("type")).select("case", F.lit(None).cast("long").alias("id"), "type")
    hits = _ranked(spark, sf).join(sources, "doc_id").select(F.col("item_id").alias("case"), F.col("doc_id").alias("id"), F.col("source").alias("type"), "rank")
    cases = items.select(F.col("item_id").alias("case"), F.lit("every text that holds the item is found").alias("pass_criteria"))
    return retrieval.case_results(cases, texts.unionByName(kinds), hits)


@B.add(f"WITH {_CASES} SELECT * FROM cases")
def retrieval_cases(spark, sf):
    """A case an item: the documents that contain it, and the source of the first one, are to be among the first ten hits."""
    return _results(spark, sf).withColumnRenamed("case", "item_id").withColumns({c: F.array_join(c, ", ") for c in ("missing", "missing_types")}).fillna(0, ["first_rank"])


@B.add(f"WITH {_CASES} SELECT count(*) AS cases, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, floor(avg(recall) * 1000000 + 0.5) / 1000000.0 AS recall, floor(avg(mrr) * 1000000 + 0.5) / 1000000.0 AS mrr FROM cases")
def retrieval_overall(spark, sf):
    return retrieval.overall(_results(spark, sf))


_COSINE = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x)))"


@B.add(f"""SELECT question, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM
(SELECT q.vec_id AS question, v.vec_id AS id, floor({_COSINE} * 1000000 + 0.5) / 1000000.0 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id % 17 <> 0 AND v.label IN (0, 1, 2, 3))) WHERE rank <= 10""")
def vector_index_search(spark, sf):
    """An index built of two thirds of the vectors, brought up to the whole table, rows deleted, and searched exactly with a metadata filter."""
    vectors = table(spark, sf, "embeddings")
    index = VectorIndex.build(vectors.where("vec_id % 3 <> 0"), Workspace(spark, "index").path("vectors"), id_col="vec_id", vector_col="embedding")
    index.upsert(vectors, id_col="vec_id", vector_col="embedding")
    index.delete(vectors.where("vec_id % 17 = 0"), "vec_id")
    return index.search(vectors.where("vec_id % 20 = 0"), 10, id_col="vec_id", vector_col="embedding", filters={"label": [0, 1, 2, 3]})


_TEXTS = [(t, c[:-1]) for t, cs in COLUMNS.items() for c in cs.split() if c[-1] == "*"]


def _cells_sql() -> str:
    out = []
    for t, cs in COLUMNS.items():
        for c in cs.split():
            name = c.rstrip("*")
            v = f"trim(CAST({name} AS VARCHAR))"
            text = f"lower({v})" if c[-1] == "*" else v
            out.append(f"SELECT '{t}' AS tab, '{name}' AS col, {'TRUE' if c[-1] == '*' else 'FALSE'} AS is_text, CASE WHEN {text} NOT IN ('', 'null', 'none', 'n/a', 'na', 'nan') THEN {v} END AS v FROM {t}")
    return " UNION ALL ".join(out)


@B.add(f"""WITH cells AS ({_cells_sql()})
SELECT tab AS table_name, col AS column_name, count(*) AS row_count, count(*) - count(v) AS null_count, floor((count(*) - count(v)) / CAST(count(*) AS DOUBLE) * 10000 + 0.5) / 10000.0 AS null_ratio,
least(count(DISTINCT v), 21) AS cardinality, coalesce(min(length(v)) FILTER (is_text), 0) AS min_length, coalesce(max(length(v)) FILTER (is_text), 0) AS max_length FROM cells GROUP BY 1, 2""")
def profile_all_tables(spark, sf):
    """All columns of all tables in one plan, cardinality capped at 21."""
    tables = capped.all_columns({t: table(spark, sf, t) for t in TABLES})
    texts = F.concat_ws(".", "table", "column").isin(*[f"{t}.{c}" for t, c in _TEXTS])
    return capped.profiles(tables).select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), "row_count", "null_count", "null_ratio", "cardinality", *[F.coalesce(F.when(texts, F.col(c)), F.lit(0)).alias(c) for c in ("min_length", "max_length")]
    )


_LOW = f"""WITH cells AS ({_cells_sql()}), counts AS (SELECT tab, col, v, count(*) AS n, count(*) OVER (PARTITION BY tab, col) AS d FROM cells WHERE is_text AND v IS NOT NULL GROUP BY 1, 2, 3)"""


@B.add(f"""{_LOW} SELECT tab AS table_name, col AS column_name, v AS value, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tab, col ORDER BY n DESC, v) AS rank FROM counts WHERE d <= 20) WHERE rank <= 5 AND col NOT IN ('c_name', 's_name')""")
def profile_shown_values(spark, sf):
    """The frequent values that profiles of all tables show: of columns of few values without personal data."""
    texts = {t: (table(spark, sf, t), [c for x, c in _TEXTS if x == t and c not in ("c_name", "s_name")]) for t in TABLES if any(x == t for x, _ in _TEXTS)}
    shown = capped.profiles({t: x for t, x in texts.items() if x[1]}).select("table", "column", F.posexplode("top_values").alias("rank", "v"))
    return shown.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "v.value", F.col("v.count").alias("n"), (F.col("rank") + 1).alias("rank"))


_TOP = {"lineitem": "l_partkey l_quantity l_returnflag* l_linenumber", "documents": "text* lang* source* n_chars", "events": "event_type* user_id props*"}


@B.add(
    "WITH cells AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c.rstrip('*')}' AS col, nullif(trim(CAST({c.rstrip('*')} AS VARCHAR)), '') AS v FROM {t}" for t, cs in _TOP.items() for c in cs.split())
    + ") SELECT tab AS table_name, col AS column_name, v AS value, n, CAST(rank AS INT) AS rank FROM (SELECT tab, col, v, count(*) AS n, row_number() OVER (PARTITION BY tab, col ORDER BY count(*) DESC, v) AS rank FROM cells WHERE v IS NOT NULL GROUP BY 1, 2, 3) WHERE rank <= 5"
)
def profile_frequent_values(spark, sf):
    """The five most frequent values of columns of any cardinality, by counters and an exact second count."""
    tables = {t: (table(spark, sf, t), [c.rstrip("*") for c in cs.split()]) for t, cs in _TOP.items()}
    return capped.top_values(tables).select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "value", "n", "rank")


QUERIES, ORACLES = B.queries, B.oracles
