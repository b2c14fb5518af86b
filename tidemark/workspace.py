"""Folders that the driver and all executors share: intermediate tables, which cut lineage, and this package's modules for Python workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, so that Spark and Arrow's file systems mean the same place by it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset, on a local master, a folder of this machine stands in for it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(remove, spark, _LOCAL[app])
        root = f"file://{_LOCAL[app]}"
    return qualified(spark, root.rstrip("/"))


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; leftovers of a shared folder are harmless
        return


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system, sorted; none where there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so that Python workers can import them."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).parent
    where = f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(where)
    _SHIPPED.add(app)


class Workspace:
    """Intermediate tables of one run, in a folder of their own below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(remove, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back: the plan after it starts from files."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._tidemark_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by keep() that no later plan reads."""
        for t in tables:
            if where := getattr(t, "_tidemark_path", None):
                remove(self.spark, where)

    def close(self) -> None:
        remove(self.spark, self.root)
