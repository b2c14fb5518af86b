"""Mergeable sketches in numpy, small enough for a streaming state: distinct values, quantiles, frequent values.

All three take batches in any order. Distinct values (the MOST smallest hashes) and quantiles (counts of cells of 1 % width) come out
the same whatever the order and the merges; frequent values (Misra and Gries) undercount by at most `error`, which is at most rows / ITEMS.
"""

from __future__ import annotations

import math
from typing import Any, NamedTuple

import numpy as np
import pandas as pd

MOST, ITEMS = 4096, 256
#: Quantiles are right to this relative error.
ERROR = 0.01
_GAMMA = (1 + ERROR) / (1 - ERROR)
_ZERO = 1 << 20


class Sketch(NamedTuple):
    rows: int = 0
    nulls: int = 0
    low: float | None = None
    high: float | None = None
    hashes: tuple[int, ...] = ()
    cells: tuple[int, ...] = ()
    counts: tuple[int, ...] = ()
    items: tuple[str, ...] = ()
    weights: tuple[int, ...] = ()
    error: int = 0


#: A sketch as columns of a table or a state.
SCHEMA = "rows long, nulls long, low double, high double, hashes array<long>, cells array<int>, counts array<long>, items array<string>, weights array<long>, error long"


def of(values: pd.Series, items: pd.Series) -> Sketch:
    """Of a batch: numbers (null or NaN: missing) give extrema and quantiles, items distinct and frequent values."""
    numbers = pd.to_numeric(values, errors="coerce").to_numpy(float, na_value=np.nan)
    x = numbers[~np.isnan(numbers)]
    finite = x[np.isfinite(x)]
    with np.errstate(divide="ignore"):
        size = np.ceil(np.log(np.abs(finite)) / math.log(_GAMMA))
    cell = np.where(finite == 0, 0, np.sign(finite) * (_ZERO + np.where(finite == 0, 0, size))).astype(np.int64)
    cells, counts = np.unique(cell, return_counts=True)
    present = items.dropna().astype(str)
    names, weights = np.unique(present.to_numpy(object), return_counts=True) if len(present) else (np.zeros(0, object), np.zeros(0, int))
    hashes = np.unique(pd.util.hash_array(names, categorize=False).view(np.int64)) if len(names) else np.zeros(0, np.int64)
    low, high = (float(x.min()), float(x.max())) if len(x) else (None, None)
    items_, weights_, error = _cut(dict(zip(names.tolist(), weights.tolist(), strict=True)))
    return Sketch(len(numbers), int(np.isnan(numbers).sum()), low, high, _smallest(hashes), tuple(cells.tolist()), tuple(counts.tolist()), items_, weights_, error)


def _smallest(hashes: np.ndarray) -> tuple[int, ...]:
    return tuple(np.sort(hashes.view(np.uint64))[:MOST].view(np.int64).tolist())


def _cut(weights: dict[str, int]) -> tuple[tuple[str, ...], tuple[int, ...], int]:
    cut = 0
    if len(weights) > ITEMS:
        cut = sorted(weights.values(), reverse=True)[ITEMS]
        weights = {k: n - cut for k, n in weights.items() if n > cut}
    return tuple(weights), tuple(weights.values()), cut


def merged(a: Sketch, b: Sketch) -> Sketch:
    ends = [x for x in (a.low, b.low) if x is not None], [x for x in (a.high, b.high) if x is not None]
    cells = dict(zip(a.cells, a.counts, strict=True))
    for c, n in zip(b.cells, b.counts, strict=True):
        cells[c] = cells.get(c, 0) + n
    weights = dict(zip(a.items, a.weights, strict=True))
    for c, n in zip(b.items, b.weights, strict=True):
        weights[c] = weights.get(c, 0) + n
    items, counts, cut = _cut(weights)
    hashes = np.unique(np.array(a.hashes + b.hashes, np.int64))
    order = sorted(cells)
    return Sketch(
        a.rows + b.rows, a.nulls + b.nulls, min(ends[0], default=None), max(ends[1], default=None), _smallest(hashes),
        tuple(order), tuple(cells[c] for c in order), items, counts, a.error + b.error + cut,
    )


def distinct(s: Sketch) -> int:
    """Exact up to MOST values; above it within a few per cent (1 / sqrt(MOST) is the standard error)."""
    if len(s.hashes) < MOST:
        return len(s.hashes)
    largest = int(np.array(s.hashes[-1:], np.int64).view(np.uint64)[0]) + 1
    return round((MOST - 1) * 2.0**64 / largest)


def quantile(s: Sketch, q: float) -> float | None:
    """The value of rank q (n - 1), from 0, among the n finite numbers, to a relative ERROR."""
    n = sum(s.counts)
    if not n:
        return None
    cell = s.cells[int(np.searchsorted(np.cumsum(s.counts), math.floor(q * (n - 1)), "right"))]
    size = 2 * _GAMMA ** (abs(cell) - _ZERO) / (_GAMMA + 1) if cell else 0.0
    return min(max(math.copysign(size, cell), s.low), s.high)


def frequent(s: Sketch, n: int = 5) -> list[dict[str, Any]]:
    """The n items of the largest counts, ties by item; counts may be `error` too small."""
    best = sorted(zip(s.items, s.weights, strict=True), key=lambda x: (-x[1], x[0]))[:n]
    return [{"value": k, "count": w} for k, w in best]


def row(s: Sketch) -> tuple:
    return tuple(list(x) if isinstance(x, tuple) else x for x in s)


def from_row(values: Any) -> Sketch:
    """From a row of SCHEMA, of Spark or pandas."""
    clean = [None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in values]
    lists = [tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for v in clean]
    return Sketch(*[int(v) if k in (0, 1, 9) else () if k in (4, 5, 6, 7, 8) and v is None else v for k, v in enumerate(lists)])
