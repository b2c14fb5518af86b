"""A persistent vector index: vectors in Parquet lists by nearest centroid, with metadata columns, updates and pruned search.

Layout below a folder of any file system Spark can write:

    centroids/               (cell, centroid)
    lists/g=N/cell=C/        rows of a list as generation N wrote it
    manifest/N/              (cell, g): which generation holds each list; a manifest without _SUCCESS doesn't count

An upsert or deletion rewrites the lists that its rows are in, or go to, as a new generation and writes the manifest
last. So readers see the old state or the new one, a job that dies halfway leaves files that nobody reads, and one that is run
again does nothing where rows are unchanged (their digest is equal). Centroids are fitted by k-means on a bounded sample and stay; every row is indexed.
A search reads the lists nearest to its questions only (partition pruning), with metadata filters in the scan; `probe=None` reads all lists and is exact.

Defined results: rows without id, or whose vector is null, empty, zero or holds null or non-finite entries, aren't indexed (an upsert of
such a vector deletes the id); of several rows of one id in an upsert the one with the largest digest counts; vectors of another length than the centroids are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..workspace import listed, qualified, remove, ship
from .blocks import blocks, united
from .cards import filtered

#: Rows that k-means sees, for each cell and at most; cells at most.
SAMPLE, MOST_SAMPLE, MOST_CELLS = 64, 200_000, 4096
#: Entries of question vectors in a block.
BLOCK = 1_000_000


def _usable(vector: Column) -> Column:
    odd = lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda c: c != 0)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), dims)


def _celled(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with their nearest centroid; the vector is the last column."""
    for batch in batches:
        for a in range(0, len(batch), 4096):
            part = batch.slice(a, 4096)
            cell = (_unit(_matrix(part.column(part.num_columns - 1), centroids.shape[1])) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=[*part.schema.names, "cell"])


def _scored(batches: Iterator[pa.RecordBatch], questions: np.ndarray, wanted: np.ndarray | None, k: int) -> Iterator[pa.RecordBatch]:
    """The best k rows of each question in this task, by cosine to six decimals, then id. wanted: question x cell."""
    kept: tuple | None = None
    for batch in batches:
        for a in range(0, len(batch), 1024):
            part = batch.slice(a, 1024)
            score = np.floor(_unit(_matrix(part.column(1), questions.shape[1])) @ questions.T * 1e6 + 0.5) / 1e6
            if wanted is not None:
                score = np.where(wanted[:, np.asarray(part.column(2))].T, score, -np.inf)
            question, row = np.nonzero(score.T > -np.inf)
            found = (question, score[row, question], part.column(0).take(pa.array(row)))
            if kept is not None:
                found = (np.concatenate([kept[0], found[0]]), np.concatenate([kept[1], found[1]]), pa.concat_arrays([kept[2], found[2]]))
            order = np.asarray(pc.sort_indices(found[2])).astype(np.int64)
            order = order[np.lexsort((-found[1][order], found[0][order]))]
            place = found[0][order]
            order = order[np.arange(len(order)) - np.searchsorted(place, place) < k]
            kept = (found[0][order], found[1][order], found[2].take(pa.array(order)))
    if kept is not None:
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), kept[2], pa.array(kept[1])], names=["place", "id", "score"])


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, qualified(spark, path)

    # Writing.

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, id_col: str, vector_col: str, cells: int | None = None, seed: int = 11) -> VectorIndex:
        """A new index of all usable rows; the other columns are metadata. cells: about the root of the number of rows unless given."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self = cls(rows.sparkSession, path)
        if listed(self.spark, f"{self.path}/manifest"):
            raise FileExistsError(path)
        clash = {"id", "vector", "digest", "cell", "place"} & {c for c in rows.columns if c not in (id_col, vector_col)}
        if clash:
            raise ValueError(f"metadata columns can't be called {', '.join(sorted(clash))}")
        usable = rows.where(F.col(id_col).isNotNull()).where(_usable(F.col(vector_col)))
        n = usable.count()
        cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
        vector = F.col(vector_col).cast("array<double>")
        sample = usable.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(min(MOST_SAMPLE, SAMPLE * cells)).select(array_to_vector(vector).alias("v"))
        centres = KMeans(k=cells, featuresCol="v", distanceMeasure="cosine", seed=seed, maxIter=8).fit(sample).clusterCenters() if n else []
        table = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centroid array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        schema = rows.select(F.col(id_col).alias("id"), vector.alias("vector"), *[c for c in rows.columns if c not in (id_col, vector_col)]).schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/schema")
        self._put(self._manifest_frame({}), 0)
        self.upsert(rows, id_col=id_col, vector_col=vector_col)
        return self

    def upsert(self, rows: DataFrame, *, id_col: str = "id", vector_col: str = "vector") -> int:
        """Rows that are new or changed replace those of their id; returns how many. Run again, it changes nothing."""
        meta = [c for c in self._schema().names if c not in ("id", "vector")]
        new = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *meta, F.col(vector_col).cast("array<double>").alias("vector"))
        new = new.withColumn("digest", F.xxhash64(*meta, "vector"))
        row = F.struct(*[c for c in new.columns if c != "id"])
        new = new.groupBy("id").agg(F.max_by(row, "digest").alias("r")).select("id", "r.*")
        stored = self._stored("id", "digest").withColumnsRenamed({"digest": "_digest", "cell": "_cell"})
        changed = new.join(stored, "id", "left").where("_digest IS NULL OR digest <> _digest").where(F.col("_digest").isNotNull() | _usable(F.col("vector")))
        return self._replace(changed.drop("_digest"))

    def delete(self, ids: DataFrame, id_col: str = "id") -> int:
        """The ids go; returns how many there were."""
        gone = self._stored("id").withColumnRenamed("cell", "_cell").join(ids.select(F.col(id_col).alias("id")).distinct(), "id")
        empty = {f.name: F.lit(None).cast(f.dataType) for f in self._schema() if f.name != "id"}
        return self._replace(gone.withColumns(empty | {"digest": F.lit(0).cast("long")}))

    def _replace(self, changed: DataFrame) -> int:
        """changed: id, metadata, vector (null: delete), digest, _cell where the id is now."""
        at, manifest = self._current()
        meta = [c for c in self._schema().names if c not in ("id", "vector")]
        g = at + 1
        work = f"{self.path}/staged/g={g}"
        remove(self.spark, work)  # of a job that died
        usable = changed.where(_usable(F.col("vector"))).select("id", *meta, "digest", "vector")
        centroids = self._centroids()
        shared = self.spark.sparkContext.broadcast(centroids)  # MOST_CELLS vectors at most
        if len(centroids):
            usable = usable.mapInArrow(lambda it: _celled(it, shared.value), StructType([*usable.schema.fields, StructField("cell", IntegerType())]))
            usable.write.parquet(f"{work}/rows")
        changed.select("id", "_cell").write.parquet(f"{work}/ids")
        ids = self.spark.read.schema(changed.select("id", "_cell").schema).parquet(f"{work}/ids")
        n = ids.count()
        if not n or not len(centroids):
            remove(self.spark, work)
            return 0
        fresh = self.spark.read.schema(usable.schema).parquet(f"{work}/rows")
        cells = {r[0] for r in ids.select("_cell").union(fresh.select("cell")).where("_cell IS NOT NULL").distinct().collect()}
        touched = {c: manifest[c] for c in cells if c in manifest}
        old = self._lists(touched).join(ids.select("id"), "id", "left_anti")
        where = f"{self.path}/lists/g={g}"
        remove(self.spark, where)
        columns = ["id", *meta, "digest", "vector", "cell"]
        both = old.select(columns).unionByName(fresh.select(columns))
        both.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("cell").parquet(where)
        made = {int(name[5:]) for name in listed(self.spark, where) if name.startswith("cell=")}
        self._put(self._manifest_frame({c: x for c, x in manifest.items() if c not in cells} | dict.fromkeys(made, g)), g)
        remove(self.spark, work)
        return n

    def _manifest_frame(self, manifest: Mapping[int, int]) -> DataFrame:
        return self.spark.createDataFrame(sorted(manifest.items()), "cell int, g int")

    def _put(self, manifest: DataFrame, g: int) -> None:
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{g}")

    # Reading.

    def _schema(self):
        return self.spark.read.parquet(f"{self.path}/schema").schema

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return _unit(np.array([r["centroid"] for r in rows], float)) if rows else np.zeros((0, 0))

    def _current(self) -> tuple[int, dict[int, int]]:
        """The last whole generation and its lists; a dict of MOST_CELLS numbers at most."""
        folder = f"{self.path}/manifest"
        whole = [int(g) for g in listed(self.spark, folder) if "_SUCCESS" in listed(self.spark, f"{folder}/{g}")]
        g = max(whole)
        return g, {r["cell"]: r["g"] for r in self.spark.read.schema("cell int, g int").parquet(f"{folder}/{g}").collect()}

    def _lists(self, cells: Mapping[int, int]) -> DataFrame:
        schema = self._schema()
        fields = {f.name: f.dataType for f in schema}
        whole = ", ".join(f"`{c}` {t.simpleString()}" for c, t in fields.items()) + ", digest long"
        if not cells:
            return self.spark.createDataFrame([], f"{whole}, cell int")
        parts = []
        for g in sorted(set(cells.values())):
            some = [f"{self.path}/lists/g={g}/cell={c}" for c, x in sorted(cells.items()) if x == g]
            parts.append(self.spark.read.schema(f"{whole}, cell int").option("basePath", f"{self.path}/lists/g={g}").parquet(*some))
        return united(parts, parts[0], "")

    def _stored(self, *columns: str) -> DataFrame:
        return self._lists(self._current()[1]).select(*columns, "cell")

    def rows(self) -> DataFrame:
        """All rows of the index: id, metadata, vector, cell."""
        return self._lists(self._current()[1]).drop("digest")

    def search(self, questions: DataFrame, k: int = 10, *, id_col: str, vector_col: str, probe: int | None = None, filters: Mapping[str, object] | None = None, block: int = BLOCK) -> DataFrame:
        """(question, id, score, rank): the k nearest rows by cosine to six decimals, ties by id; of the `probe` nearest lists, or of all.

        filters: metadata as in cards.filtered. Unusable question vectors find nothing. Questions go out in blocks; lists are read once a block.
        """
        from pyspark.sql import Window

        _, manifest = self._current()
        centroids = self._centroids()
        asked = questions.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(F.col(id_col).alias("question"), F.col(vector_col).cast("array<double>").alias("vector"))
        kinds = [self._schema()["id"].dataType.simpleString(), asked.schema["question"].dataType.simpleString()]
        parts = []
        for some in blocks(asked, F.size("vector"), block, "question", "vector") if manifest else ():
            m = _unit(np.array([r["vector"] for r in some]))
            cells, wanted = manifest, None
            if probe is not None and probe < len(centroids):
                near = np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :probe]
                wanted = np.zeros((len(m), len(centroids)), bool)
                np.put_along_axis(wanted, near, True, axis=1)
                cells = {c: g for c, g in manifest.items() if wanted[:, c].any()}
            lists = self._lists(cells)
            if filters:
                lists = filtered(lists, filters)
            shared = self.spark.sparkContext.broadcast((m, wanted))
            best = lists.select("id", "vector", "cell").mapInArrow(lambda it, s=shared: _scored(it, *s.value, k), f"place int, id {kinds[0]}, score double")
            names = self.spark.createDataFrame([(i, r["question"]) for i, r in enumerate(some)], f"place int, question {kinds[1]}")
            parts.append(best.join(names, "place").select("question", "id", "score"))
        hits = united(parts, questions, f"question {kinds[1]}, id {kinds[0]}, score double")
        place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
        return hits.withColumn("rank", place).where(F.col("rank") <= k)

    def recall(self, questions: DataFrame, probe: int, k: int = 10, *, id_col: str, vector_col: str) -> float:
        """Share of the exact first k that a search of `probe` lists finds."""
        ask = lambda p: self.search(questions, k, id_col=id_col, vector_col=vector_col, probe=p).select("question", "id")
        exact = ask(None)
        found = exact.join(ask(probe), ["question", "id"], "left_semi").count()
        return found / max(exact.count(), 1)

    def vacuum(self) -> Sequence[str]:
        """Remove what the current manifest doesn't name; no search of an older state may be running."""
        g, manifest = self._current()
        gone = [f"{self.path}/manifest/{m}" for m in listed(self.spark, f"{self.path}/manifest") if int(m) != g]
        live = {(x, c) for c, x in manifest.items()}
        for name in listed(self.spark, f"{self.path}/lists"):
            gone += [f"{self.path}/lists/{name}/{c}" for c in listed(self.spark, f"{self.path}/lists/{name}") if c.startswith("cell=") and (int(name[2:]), int(c[5:])) not in live]
        for path in gone:
            remove(self.spark, path)
        return gone


