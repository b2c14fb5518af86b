"""Lexical, vector, BM25 and fused ranking over documents, benchmark items and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators.cards import filtered
from ..operators.containment import containing
from ..tables import table
from .kit import Book, values, values_sql

B = Book()
QUERY = "the tion of"
_H = "translate(lower(coalesce(text, '')), '_.-', '   ')"


def _lexical_sql(query: str = QUERY, where: str = "TRUE") -> str:
    terms = query.split()
    hits = " + ".join(f"CASE WHEN contains({_H}, '{t}') THEN {3 + len(t)} ELSE 0 END" for t in terms)
    return f"SELECT doc_id, CAST(CASE WHEN contains({_H}, '{query}') THEN {10 + len(query)} ELSE 0 END + {hits} AS INT) AS score FROM documents WHERE {where}"


@B.add(f"SELECT * FROM ({_lexical_sql()}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def lexical_topk_documents(spark, sf):
    return R.lexical_topk(table(spark, sf, "documents").select("doc_id", "text"), "text", QUERY, 20, "doc_id").select("doc_id", "score")


_WHERE = "lang IN ('de', 'fr') AND source = 'src0'"


@B.add(f"SELECT * FROM ({_lexical_sql('de la', _WHERE)}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def lexical_filtered_topk(spark, sf):
    docs = filtered(table(spark, sf, "documents"), {"lang": ["de", "fr"], "source": "src0"}).select("doc_id", "text")
    return R.lexical_topk(docs, "text", "de la", 10, "doc_id").select("doc_id", "score")


_TOP = f"(SELECT * FROM ({_lexical_sql()}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)"


@B.add(f"SELECT doc_id, score, floor(CASE WHEN max(score) OVER () > 1 THEN score / CAST(max(score) OVER () AS DOUBLE) ELSE score END * 1000000 + 0.5) / 1000000.0 AS score_n FROM {_TOP}")
def search_score_normalised(spark, sf):
    top = R.lexical_topk(table(spark, sf, "documents").select("doc_id", "text"), "text", QUERY, 50, "doc_id").select("doc_id", "score")
    return R.normalised(top)


_PRIORITIES = [(3, 1000), (3, 950), (8, 1100), (1, 650), (999999, 1100)]


@B.add(f"SELECT t.doc_id, t.score, CAST(coalesce(p.priority, 0) AS INT) AS priority FROM {_TOP} t LEFT JOIN (SELECT doc_id, max(priority) AS priority FROM {values_sql('doc_id, priority', _PRIORITIES)} GROUP BY 1) p USING (doc_id) ORDER BY priority DESC, t.score DESC, t.doc_id LIMIT 10")
def semantic_rerank(spark, sf):
    top = R.lexical_topk(table(spark, sf, "documents").select("doc_id", "text"), "text", QUERY, R.overfetch(20) - 10, "doc_id").select("doc_id", "score")
    return R.reranked(top, values(spark, "doc_id, priority", _PRIORITIES), 10, "doc_id").select("doc_id", "score", "priority")


_Q = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"


@B.add(f"SELECT vec_id, score FROM (SELECT vec_id, floor(list_sum(list_transform(list_zip(embedding, {_QSQL}), lambda z: CAST(z[1] AS DOUBLE) * z[2])) * 1000000 + 0.5) / 1000000.0 AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_dot(spark, sf):
    six = lambda a, b: F.floor(R.dot(a, b) * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)
    return R.vector_topk(table(spark, sf, "embeddings"), "embedding", _Q, 10, "vec_id", measure=six).select("vec_id", "score")


@B.add(f"""SELECT vec_id, score FROM (SELECT vec_id, floor(list_sum(list_transform(list_zip(embedding, {_QSQL}), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({_QSQL}, lambda x: x * x)))) * 1000000 + 0.5) / 1000000.0 AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk_cosine(spark, sf):
    six = lambda a, b: F.floor(R.cosine(a, b) * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)
    return R.vector_topk(table(spark, sf, "embeddings"), "embedding", _Q, 10, "vec_id", measure=six).select("vec_id", "score")


_BM = "the tion que"
_BT = sorted(set(_BM.split()))


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(_BT))
    n, df = "(SELECT count(*) FROM c)", lambda i: f"(SELECT count(*) FROM c WHERE tf{i} > 0)"
    avg = "(SELECT avg(dl) FROM c)"
    parts = " + ".join(f"ln(1 + ({n} - {df(i)} + 0.5) / ({df(i)} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / {avg}))" for i in range(len(_BT)))
    return f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({_H}, '\\s+'), lambda x: x <> '') AS t FROM documents), c AS (SELECT doc_id, len(t) AS dl, {tf} FROM t)
SELECT doc_id, score FROM (SELECT doc_id, floor(({parts}) * 1000000 + 0.5) / 1000000.0 AS score FROM c WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(_BT)))}) ORDER BY score DESC, doc_id LIMIT 20"""


@B.add(_bm25_sql())
def bm25_topk(spark, sf):
    return R.top(R.bm25(table(spark, sf, "documents"), "doc_id", "text", _BM), 20, "doc_id")


@B.add(f"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM ({_lexical_sql()}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30)),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, floor(list_sum(list_transform(list_zip(embedding, {_QSQL}), lambda z: CAST(z[1] AS DOUBLE) * z[2])) * 1000000 + 0.5) / 1000000.0 AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 30))
SELECT id, floor((coalesce(1 / CAST(60 + a.r AS DOUBLE), 0.0) + coalesce(1 / CAST(60 + b.r AS DOUBLE), 0.0)) * 1000000 + 0.5) / 1000000.0 AS score FROM a FULL JOIN b USING (id) ORDER BY coalesce(1 / CAST(60 + a.r AS DOUBLE), 0.0) + coalesce(1 / CAST(60 + b.r AS DOUBLE), 0.0) DESC, id LIMIT 10""")
def hybrid_topk(spark, sf):
    a = R.with_rank(R.lexical_topk(table(spark, sf, "documents").select("doc_id", "text"), "text", QUERY, 30, "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "rank")
    six = lambda x, y: F.floor(R.dot(x, y) * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)
    b = R.with_rank(R.vector_topk(table(spark, sf, "embeddings"), "embedding", _Q, 30, "vec_id", measure=six), "vec_id").select(F.col("vec_id").alias("id"), "rank")
    return R.fused(a, b, "id", 10).select("id", (F.floor(F.col("score") * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)).alias("score"))


_HEX = "list_sum(list_transform(range(1, {n} + 1), lambda k: CAST((strpos('0123456789abcdef', substr({d}, {at} - 1 + k, 1)) - 1) * 16 ** ({n} - k) AS BIGINT)))"


def _hex(at: int, n: int) -> str:
    return _HEX.format(n=n, at=at, d="d")


@B.add(f"""WITH tok AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '') AS t FROM benchmark),
placed AS (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM tok),
dig AS (SELECT item_id, sha256('{R.SALT}:' || pos || ':' || token) AS d FROM placed),
slots AS (SELECT item_id, {_hex(1, 8)} % 32 AS slot, CASE WHEN {_hex(9, 2)} % 2 = 0 THEN 1.0 ELSE -1.0 END * (0.5 + {_hex(11, 2)} / 255.0::DOUBLE) AS v FROM dig),
sums AS (SELECT item_id, slot, sum(CAST(v AS DOUBLE)) AS v FROM slots GROUP BY 1, 2), filled AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS n FROM sums)
SELECT item_id, CAST(slot AS INT) AS slot, floor(v / n * 10000 + 0.5) / 10000.0 AS weight FROM filled WHERE abs(v) > 1e-9""")
def hash_embedding(spark, sf):
    e = R.hash_embedding(table(spark, sf, "benchmark"), "item_id", "text")
    each = e.select("item_id", F.posexplode("embedding").alias("slot", "w")).where("abs(w) > 1e-9")
    return each.select("item_id", "slot", (F.floor(F.col("w") * 10_000 + F.lit(0.5)) / F.lit(10_000.0)).alias("weight"))


@B.add("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(translate(lower(d.text), '_.-', '   '), translate(lower(b.text), '_.-', '   '))")
def containment_join(spark, sf):
    """Which texts contain which items, by one pass of an automaton over each text."""
    return containing(table(spark, sf, "documents"), table(spark, sf, "benchmark"), id_col="doc_id", text_col="text", item_id="item_id", item_text="text").select("item_id", "doc_id")


QUERIES, ORACLES = B.queries, B.oracles
