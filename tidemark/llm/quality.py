"""Document quality by co-training (Blum and Mitchell 1998) of two views.

The content view sees a text's three-byte runs, hashed, and how words repeat; the page-metadata view
sees source, language and stated length, and nothing of the text. Both begin with the labelled
rows. In each round both score every unlabelled document; either labels those it is surest of, in the proportion of
the classes, and hands them to the other one. Then each view's score is calibrated on labelled rows
kept apart, and a logistic combination of both, fitted on other rows kept apart, scores every document.

Bound: at most MAX_LABELLED labelled rows, the first by a hash of doc_id, are used to fit. The search for pseudo-labels
covers all documents in each of ROUNDS rounds; the driver holds the features of PER_ROUND rows a view and round
(2.4 KB a row). All documents are scored over their whole text.

Defined results: a null or empty text is scored as one without runs and words; null metadata is a value of its own; a
document with differing labels has the majority's, at a tie the lower; rows without a label or id aren't fitted
to; of labelled rows of one id the first by a hash of the text is fitted to; equally sure documents go by hashes of id and text;
repeated rows are each scored; without labels of both classes the score is the share of good labels, or
0.5 without any; a very long text is held by its task with about 60 bytes a byte; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, row_key, ship
from .words import U, mix, raw, text_parts, words

MAX_LABELLED, ROUNDS, PER_ROUND, SURE = 6000, 3, 600, 0.9
RUNS, HASHED, LENGTHS = 512, 64, 24
PART = 1 << 20
_META = ("source", "lang", "n_chars")


def content_features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed three-byte runs, and four measures of repetition."""
    data, offsets = raw(column)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros((n, RUNS + 4), np.float32)
    if len(data) > 2:
        d = data.astype(np.uint32)
        h = ((d[:-2] * 0x9E3779B1 ^ d[1:-1] * 0x85EBCA6B ^ d[2:] * 0xC2B2AE35) * np.uint32(0x27D4EB2F)) >> np.uint32(23)
        ok = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][ok] * RUNS + h[ok], minlength=n * RUNS).reshape(n, RUNS)
        out[:, :RUNS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    w = words(column)
    many = np.diff(w.offsets)
    total = np.maximum(many, 1)
    own = w.doc
    order = np.lexsort((w.hash, own))
    first = np.ones(len(order), bool)
    first[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (own[order][1:] != own[order][:-1])
    twice = np.zeros(len(own), bool)
    twice[1:] = (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])
    size = np.maximum(np.diff(offsets), 1)
    out[:, RUNS] = np.bincount(own[order][first], minlength=n) / total
    out[:, RUNS + 1] = np.bincount(own, twice, n) / total
    out[:, RUNS + 2] = np.bincount(own, w.end - w.start, n) / size
    out[:, RUNS + 3] = np.log1p(many) / 10
    return out


def metadata_features(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Hashed source, language and both together; the stated length's logarithm and its power of two."""
    n = batch.num_rows
    out = np.zeros((n, HASHED + LENGTHS + 2), np.float32)
    named = [[f"{c}={v}" for v in batch.column(c).to_pylist()] for c in columns if c != "n_chars"]
    for values in [*named, ["&".join(v) for v in zip(*named, strict=True)]] if named else []:
        d, o = raw(pa.array(values, pa.large_string()))
        h = np.zeros(n, U)
        for k in range(int(np.diff(o).max(initial=0))):
            here = o[:-1] + k < o[1:]
            h[here] = mix(h[here] * U(3) + d[(o[:-1] + k)[here]].astype(U))
        out[np.arange(n), (mix(h) % U(HASHED)).astype(np.int64)] += 1
    if "n_chars" in columns:
        v = np.asarray(batch.column("n_chars").cast(pa.float64()).fill_null(-1.0))
        size = np.log2(np.maximum(v, 0) + 1)
        out[:, HASHED] = size / 10
        out[:, HASHED + 1] = v < 0
        out[np.arange(n), HASHED + 2 + np.minimum(size.astype(np.int64), LENGTHS - 1)] = 1
    return out


class View(NamedTuple):
    weight: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


class Model(NamedTuple):
    content: View
    metadata: View
    calibrated: tuple[tuple[float, float], tuple[float, float]]  # slope and offset of each view
    combined: tuple[float, float, float]  # weights of the calibrated logits, and offset
    prior: float
    fitted: bool


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the offset isn't penalised."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(a @ w)
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((a * v[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    weight, bias = logistic((x - mean) / scale, y, ridge=5.0)
    return View(weight.astype(np.float32), bias, mean, scale)


#: For fitted views and the numbers of bad and good rows wanted, each view's surest unlabelled rows: features for both views, and labels.
Search = Callable[[list[View], int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, search: Search, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """Fit both views with exchanged pseudo-labels; of six labelled rows one is kept for calibration and one for the combination."""
    prior = float(y.mean()) if len(y) else 0.5
    k = np.arange(len(y)) % 3 == 2
    first, second = k & (np.arange(len(y)) % 6 == 2), k & (np.arange(len(y)) % 6 == 5)
    if len(np.unique(y[first])) < 2 or len(np.unique(y[second])) < 2:
        first = second = k  # too few rows to tell them apart
    if len(np.unique(y[~k])) < 2 or len(np.unique(y[first])) < 2:
        none = [View(np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1]), np.ones(x.shape[1])) for x in views]
        return Model(*none, ((1.0, 0.0), (1.0, 0.0)), (0.0, 0.0, 0.0), prior, False)
    taught = [(views[v][~k], y[~k].astype(float)) for v in (0, 1)]
    fitted = [fit_view(*t) for t in taught]
    for _ in range(rounds):
        found = search(fitted, max(1, round(per_round * (1 - prior))), max(1, round(per_round * prior)))
        if not any(len(f[2]) for f in found):
            break
        for v, (x, z, label) in enumerate(found):
            own, labels = taught[1 - v]
            taught[1 - v] = np.vstack([own, (x, z)[1 - v]]), np.concatenate([labels, label])
        fitted = [fit_view(*t) for t in taught]
    calibrated = []
    for v in (0, 1):
        w, b = logistic(fitted[v].logit(views[v][first])[:, None], y[first], ridge=1.0)
        calibrated.append((float(w[0]), b))
    both = np.stack([fitted[v].logit(views[v][second]) * s + o for v, (s, o) in enumerate(calibrated)], axis=1)
    w, b = logistic(both, y[second], ridge=1.0)
    return Model(fitted[0], fitted[1], (calibrated[0], calibrated[1]), (float(w[0]), float(w[1]), b), prior, True)


def _parts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a, b in text_parts(batch.column("_text"), PART):
            part = batch.slice(a, b - a)
            yield part, content_features(part.column("_text")), metadata_features(part, columns)


def _featured(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for part, x, z in _parts(batches, columns):
        yield pa.RecordBatch.from_arrays([part.column("r1"), part.column("r2"), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, z))], names=["r1", "r2", "x", "z"])


def _sured(batches: Iterator[pa.RecordBatch], views: list[View], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows that either view is sure of: _id, r1, r2 and both probabilities."""
    for part, x, z in _parts(batches, columns):
        p = [_sigmoid(v.logit(f)).astype(np.float64) for v, f in zip(views, (x, z), strict=True)]
        at = pa.array(np.flatnonzero(np.maximum(np.abs(p[0] - 0.5), np.abs(p[1] - 0.5)) > SURE - 0.5))
        yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("_id", "r1", "r2")), *(pa.array(q).take(at) for q in p)], names=["_id", "r1", "r2", "p0", "p1"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches if not model.fitted else ():
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(np.full(len(batch), model.prior))] * 3], names=["_id", "p_content", "p_metadata", "score"])
    for part, *features in _parts(batches, columns) if model.fitted else ():
        z = [v.logit(f) * s + o for v, f, (s, o) in zip((model.content, model.metadata), features, model.calibrated, strict=True)]
        p = [_sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(z[0] * model.combined[0] + z[1] * model.combined[1] + model.combined[2])]
        yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(q.astype(np.float64)) for q in p)], names=["_id", "p_content", "p_metadata", "score"])


def _read(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, tuple[str, ...]]:
    columns = tuple(c for c in _META if c in docs.columns)
    r1, r2 = row_key(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("_id"), r1.alias("r1"), r2.alias("r2"), F.col(text_col).cast("string").alias("_text"), *columns), columns


def _matrices(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = {"x": RUNS + 4, "z": HASHED + LENGTHS + 2}
    return tuple(np.array([np.frombuffer(r[c], np.float32) for r in rows], np.float32).reshape(len(rows), n) for c, n in sizes.items())


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND
) -> Model:
    """Co-train on the driver; each round's candidates are searched on the executors in all documents."""
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    rows, columns = _read(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col).cast("double")) > 0.5).alias("y"))
    known = ws.keep(known, "known")
    h = F.xxhash64(F.col("_id").cast("string"))
    present = rows.join(known, "_id").groupBy("_id").agg(F.min(F.struct("r1", "r2")).alias("r"), F.first("y").alias("y"))
    some = present.orderBy(h, "_id").limit(max_labelled).select("r.r1", "r.r2", "y").collect()
    y_of = {(r.r1, r.r2): bool(r.y) for r in some}

    def features(keys: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        if not keys:
            return {}
        wanted = F.broadcast(spark.createDataFrame(keys, "r1 long, r2 long"))  # max_labelled or 2 x per_round keys at most
        picked = rows.join(wanted, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])  # a row may be there a million times
        got = picked.mapInArrow(lambda it: _featured(it, columns), "r1 long, r2 long, x binary, z binary").collect()
        x, z = _matrices(got)
        return {(r.r1, r.r2): (x[i], z[i]) for i, r in enumerate(got)}

    gone = set()

    def search(fitted: list[View], bad: int, good: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast(fitted)
        sure = rows.mapInArrow(lambda it: _sured(it, shared.value, columns), f"_id {kind}, r1 long, r2 long, p0 double, p1 double")
        sure = ws.keep(sure.join(known.select("_id"), "_id", "left_anti").drop("_id"), "sure")
        left = sure
        if gone:
            left = sure.join(F.broadcast(spark.createDataFrame(sorted(gone), "r1 long, r2 long")), ["r1", "r2"], "left_anti")
        chosen = []
        for p in ("p0", "p1"):
            ends = ((0.0, left.where(F.col(p) < 1 - SURE).orderBy(p, "r1", "r2").limit(bad)), (1.0, left.where(F.col(p) > SURE).orderBy(F.desc(p), "r1", "r2").limit(good)))
            chosen.append({(r.r1, r.r2): label for label, top in ends for r in top.collect()})
        gone.update(*chosen)
        held = features(sorted(set().union(*chosen)))
        ws.drop(sure)
        out = []
        for c in chosen:
            pairs = [held[k] for k in c]
            out.append((*(np.array([q[v] for q in pairs], np.float32).reshape(len(pairs), n) for v, n in ((0, RUNS + 4), (1, HASHED + LENGTHS + 2))), np.array(list(c.values()))))
        return out

    held = features(list(y_of))
    x, z = (np.array([held[k][v] for k in y_of], np.float32).reshape(len(y_of), n) for v, n in ((0, RUNS + 4), (1, HASHED + LENGTHS + 2)))
    model = cotrain((x, z), np.array(list(y_of.values()), float), search, rounds, per_round)
    ws.close()
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_content, p_metadata, score: the calibrated views' and the combined probability of good quality, for every row."""
    ship(docs.sparkSession)
    rows, columns = _read(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 600 weights a view
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, p_content double, p_metadata double, score double"
    return rows.mapInArrow(lambda it: _scored(it, shared.value, columns), schema).withColumnRenamed("_id", id_col)


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, p_content, p_metadata, score, kept (score of 0.5 or more)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).withColumn("kept", F.col("score") >= 0.5)
