"""Proposals, confirmations, promotion and versions of packs. An approved pack is never changed in place."""

from __future__ import annotations

import copy
import datetime as dt
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packs import FAMILIES, Pack, is_valid


class PromotionError(ValueError):
    """A promotion that its confirmations or the pack's checks don't allow."""


@dataclass
class Proposal:
    pack_id: str
    family: str
    card: dict[str, Any]
    evidence: list[dict[str, Any]]
    id: str = field(default_factory=lambda: f"proposal.{uuid.uuid4().hex[:12]}")
    status: str = "open"
    confirmed_by: str | None = None
    at: str = field(default_factory=lambda: dt.datetime.now(dt.UTC).isoformat(timespec="seconds"))

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise PromotionError(f"no family {self.family}")
        if not self.evidence:
            raise PromotionError("a proposal needs evidence")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def confirm(p: Proposal, person: str) -> Proposal:
    if p.status != "open" or not person.strip():
        raise PromotionError("only an open proposal can be confirmed, by a named person")
    return Proposal(**(p.to_dict() | {"status": "confirmed", "confirmed_by": person}))


def bump(version: str) -> str:
    major, minor, patch = map(int, version.split("."))
    return f"{major}.{minor}.{patch + 1}"


def promote(spark: SparkSession, pack: Pack, proposals: list[Proposal]) -> Pack:
    """A copy of the pack, one patch version on, with confirmed cards put in; it must validate."""
    if bad := [p.id for p in proposals if p.status != "confirmed" or p.pack_id != pack.id]:
        raise PromotionError(f"not confirmed for {pack.id}: {bad}")
    if test_only := [p.id for p in proposals if any(e.get("is_test_only") for e in p.evidence)]:
        raise PromotionError(f"test-only evidence is never approved: {test_only}")
    out = copy.deepcopy(pack)
    out.version, out.status = bump(pack.version), "approved"
    for p in proposals:
        cards = out.cards.setdefault(p.family, [])
        card = dict(p.card) | ({"status": "approved"} if "status string" in FAMILIES[p.family] else {})
        out.cards[p.family] = [c for c in cards if c["id"] != card["id"]] + [card]
    if not is_valid(spark, out):
        raise PromotionError("the promoted pack has findings")
    return out


def next_patch(versions: DataFrame, key: str, version: str) -> DataFrame:
    """(key, next_version): one patch after the highest version of each."""
    parts = F.split(version, r"\.")
    number = F.struct(*[parts[i].cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))])
    top = versions.groupBy(key).agg(F.max(number).alias("v"))
    return top.select(key, F.concat_ws(".", F.col("v.major").cast("string"), F.col("v.minor").cast("string"), (F.col("v.patch") + 1).cast("string")).alias("next_version"))
