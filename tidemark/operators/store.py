"""A folder of packs: found recursively, listed, and loaded by id. Packs are documents of the driver's size."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .packs import Pack, PackError, load, save

SUFFIXES = (".json", ".yaml", ".yml")
_ID = re.compile(r"""^\s*"?id"?\s*:\s*["']?([^"',\s}]+)""", re.MULTILINE)


@dataclass(frozen=True)
class Entry:
    """A pack file: its path, its id or None where it can't be read, and why."""

    path: str
    id: str | None
    version: str | None = None
    status: str | None = None
    error: str | None = None


def paths(root: str) -> Iterator[str]:
    """Pack files below a folder, in the order of their paths."""
    found = (os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.lower().endswith(SUFFIXES))
    yield from sorted(found)


def peek(path: str) -> str | None:
    """The first id that a file names, without reading it as a pack."""
    with open(path, encoding="utf-8", errors="replace") as f:
        hit = _ID.search(f.read())
    return hit[1] if hit else None


def listing(root: str) -> list[Entry]:
    """All pack files; malformed ones are entries with an error and never stop the others."""
    out = []
    for p in paths(root):
        try:
            pack = load(p)
            out.append(Entry(p, pack.id, pack.version, pack.status))
        except (PackError, json.JSONDecodeError, UnicodeDecodeError, TypeError, AttributeError) as e:
            out.append(Entry(p, None, error=f"{type(e).__name__}: {str(e)[:120]}"))
    return out


def by_id(root: str, pack_id: str) -> Pack:
    """The pack of an id; of several files that name it, the first that can be read. Others aren't parsed."""
    error = None
    for p in paths(root):
        if peek(p) != pack_id:
            continue
        try:
            pack = load(p)
        except (PackError, json.JSONDecodeError) as e:
            error = error or e
            continue
        if pack.id == pack_id:
            return pack
    raise PackError(f"no readable pack {pack_id!r} below {root}") from error


def all_packs(root: str) -> list[Pack]:
    """Every readable pack, one an id."""
    seen: dict[str, Pack] = {}
    for e in listing(root):
        if e.id is not None and e.id not in seen:
            seen[e.id] = load(e.path)
    return list(seen.values())


def put(root: str, pack: Pack) -> str:
    """Write a pack below its id and version; an existing file is never overwritten."""
    name = re.sub(r"[^0-9A-Za-z._-]+", "_", f"{pack.id}.{pack.version}.json")
    path = os.path.join(root, name)
    if os.path.exists(path):
        raise PackError(f"{path} exists")
    os.makedirs(root, exist_ok=True)
    save(pack, path)
    return path


def frame(spark: SparkSession, root: str) -> DataFrame:
    """The listing as a table: path, id, version, status, error."""
    rows = [(e.path, e.id, e.version, e.status, e.error) for e in listing(root)]
    return spark.createDataFrame(rows, "path string, id string, version string, status string, error string")
