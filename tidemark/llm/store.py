"""Tables written to the cluster's shared folder, and hashes that tell rows apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..workspace import Workspace, qualified, shared_root, ship

__all__ = ["Workspace", "qualified", "row_key", "shared_root", "ship"]


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits of hash of a row's id and text, never null: ids may be repeated or null."""
    parts = (doc_id.isNull(), doc_id, text.isNull(), text)
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
