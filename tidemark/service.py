"""The service surface as functions: search, resolve, plan, validate, preview, answer, feedback. A transport can wrap them."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cards as C
from .operators import guard, planner, preview, rank
from .operators.packs import Pack, validate
from .sources import logs

# States of an answer that isn't one.
STATES = ("ok", "no_match", "ambiguous", "unknown_terms", "no_trusted_sql", "blocked", "failed", "empty", "truncated")


class BackendError(RuntimeError):
    """A search backend that was asked for by name and can't serve; nothing else is tried in its place."""


def limits(packs: Iterable[Pack], role: str | None) -> tuple[list[str], list[str], int]:
    """Tables a role may read, columns it may not, and its row cap. None: all policies; unknown: nothing."""
    own = [c for p in packs for c in p.cards.get("policies", []) if role is None or role in (c.get("roles") or [])]
    allowed = sorted({t for c in own for t in c.get("allowed_tables") or []})
    blocked = sorted({b for c in own for b in c.get("blocked_columns") or []})
    return allowed, blocked, min((c.get("max_preview_rows") or 1 for c in own), default=1)


def search(spark: SparkSession, packs: list[Pack], query: str, k: int = 10, types: list[str] | None = None, backend: str = "keyword") -> list[dict[str, Any]]:
    """Cards for a question: lexical hits, re-ranked by what the question was understood to mean."""
    if backend not in ("keyword", "vector"):
        raise BackendError(f"backend {backend!r} is not available")
    k = rank.clamp(k)
    seen = planner.understand(packs, query)
    every = C.cards(spark, packs[0])
    for p in packs[1:]:
        every = every.unionByName(C.cards(spark, p))
    safe, _ = C.indexable(every)
    safe = safe.where(C.of_type(F.col("card_type"), types)) if types else safe
    if backend == "keyword":
        hits = rank.lexical_topk(safe, "text", seen.expanded, rank.overfetch(k), "card_type", "card_id")
    else:
        q = rank.hash_embedding(spark.createDataFrame([(0, query)], "i int, t string"), "i", "t").head()["embedding"]
        vectors = rank.hash_embedding(safe, "card_id", "text")
        hits = rank.vector_topk(safe.join(vectors, "card_id"), "embedding", q, rank.overfetch(k), "card_id", measure=rank.dot)
    given = spark.createDataFrame([*seen.priorities.items()] or [("", 0)], "card_id string, priority int")
    top = rank.reranked(rank.normalised(hits), given, k, "card_id")
    return [r.asDict() | {"warning": "draft_card" if r.status == "draft" else None} for r in top.select("card_id", "card_type", "title", "status", "score", "score_n", "priority", F.substring("text", 1, 500).alias("summary")).collect()]


def resolve_business_terms(packs: list[Pack], terms: list[str]) -> dict[str, Any]:
    found, missing = planner.resolve_terms(packs, terms)
    return {"resolved": found, "unresolved": missing}


def plan_data_query(packs: list[Pack], question: str, role: str | None = None) -> dict[str, Any]:
    return planner.plan(packs, question, role, fallback=True).to_dict()


def validate_sql(spark: SparkSession, packs: list[Pack], sql: str, role: str | None = None) -> dict[str, Any]:
    allowed, blocked, _ = limits(packs, role)
    r = guard.check(spark, sql, allowed, blocked)
    return {"checks": r.checks, "tables": r.tables, "columns": r.columns, "errors": r.errors, "execution_allowed": False}


def validate_pack(spark: SparkSession, pack: Pack) -> list[dict[str, Any]]:
    return [r.asDict() for r in validate(spark, pack).orderBy("severity", "family", "id").collect()]


def preview_query(spark: SparkSession, packs: list[Pack], sql: str, role: str = "analyst", limit: int = preview.ROWS, args: dict[str, Any] | None = None) -> preview.Preview:
    allowed, blocked, cap = limits(packs, role)
    return preview.preview(spark, sql, allowed=allowed, blocked=blocked, role=role, limit=limit, cap=cap, args=args)


def answer(spark: SparkSession, packs: list[Pack], question: str, role: str = "analyst", params: dict[str, Any] | None = None, run: bool = False) -> dict[str, Any]:
    """From question to a view: its state, the plan, checks, and rows if asked for."""
    seen, plan = planner.understand(packs, question), planner.plan(packs, question, role)
    gate = planner.gate(plan, seen)
    view: dict[str, Any] = {"question": question, "plan": plan.to_dict(), "gate": gate, "rows": [], "state": "ok"}
    if not plan.terms and not plan.metrics:
        return view | {"state": "unknown_terms" if seen.unknown else "no_match"}
    if gate["state"] == "ask":
        return view | {"state": "ambiguous"}
    if not plan.sql:
        return view | {"state": "no_trusted_sql"}
    if not run:
        return view
    got = preview_query(spark, packs, plan.sql, role, args=params)
    state = "truncated" if got.truncated else "empty" if got.status == "ok" and not got.rows else got.status
    return view | {"rows": got.rows, "audit": got.audit, "state": state}


def give_feedback(spark: SparkSession, root: str, space_id: str, payload: dict[str, Any]) -> str:
    """Feedback goes to the log as it is, or not at all if it holds personal data."""
    return logs.append(spark, root, space_id, "feedback", payload, redact=False)


TOOLS = {f.__name__: f for f in (search, resolve_business_terms, plan_data_query, validate_sql, validate_pack, preview_query, answer, give_feedback)}
