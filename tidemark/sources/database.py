"""Databases through JDBC: catalog listings, bounded samples, frequencies counted in the database, and loads behind a safety gate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import pairwise
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class UnsupportedConnector(RuntimeError):
    """A database that can't be scanned here."""


@dataclass(frozen=True)
class ScanConfig:
    schemas: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    max_tables: int = 25
    max_columns: int = 100
    max_rows: int = 10
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if min(self.max_tables, self.max_columns) < 1 or self.max_rows < 0:
            raise ValueError("caps must be positive")


# What each database's catalog is asked, by kind.
CATALOGS = {
    "postgresql": {
        "schemas": "SELECT schema_name FROM information_schema.schemata WHERE schema_name NOT IN ('pg_catalog', 'information_schema')",
        "tables": "SELECT table_schema, table_name, table_type AS kind, obj_description((quote_ident(table_schema) || '.' || quote_ident(table_name))::regclass) AS comment FROM information_schema.tables WHERE table_schema NOT IN ('pg_catalog', 'information_schema') UNION ALL SELECT schemaname, matviewname, 'MATERIALIZED VIEW', obj_description((quote_ident(schemaname) || '.' || quote_ident(matviewname))::regclass) FROM pg_matviews",
        "columns": "SELECT table_schema, table_name, column_name, data_type, is_nullable, ordinal_position, col_description((quote_ident(table_schema) || '.' || quote_ident(table_name))::regclass, ordinal_position) AS comment FROM information_schema.columns WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
    },
    "mysql": {
        "schemas": "SELECT schema_name FROM information_schema.schemata WHERE schema_name NOT IN ('mysql', 'sys', 'performance_schema', 'information_schema')",
        "tables": "SELECT table_schema, table_name, table_type AS kind, table_comment AS comment FROM information_schema.tables WHERE table_schema NOT IN ('mysql', 'sys', 'performance_schema', 'information_schema')",
        "columns": "SELECT table_schema, table_name, column_name, column_type AS data_type, is_nullable, ordinal_position, column_comment AS comment FROM information_schema.columns WHERE table_schema NOT IN ('mysql', 'sys', 'performance_schema', 'information_schema')",
    },
    "derby": {
        "schemas": "SELECT SCHEMANAME AS schema_name FROM SYS.SYSSCHEMAS WHERE SCHEMANAME NOT LIKE 'SYS%' AND SCHEMANAME NOT IN ('NULLID', 'SQLJ')",
        "tables": "SELECT s.SCHEMANAME AS table_schema, t.TABLENAME AS table_name, t.TABLETYPE AS kind, CAST(NULL AS VARCHAR(1)) AS comment FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE t.TABLETYPE IN ('T', 'V')",
        "columns": "SELECT s.SCHEMANAME AS table_schema, t.TABLENAME AS table_name, c.COLUMNNAME AS column_name, CAST(NULL AS VARCHAR(1)) AS data_type, CAST(NULL AS VARCHAR(1)) AS is_nullable, c.COLUMNNUMBER AS ordinal_position, CAST(NULL AS VARCHAR(1)) AS comment FROM SYS.SYSCOLUMNS c JOIN SYS.SYSTABLES t ON c.REFERENCEID = t.TABLEID JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE t.TABLETYPE IN ('T', 'V')",
    },
}
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "derby": "org.apache.derby.jdbc.EmbeddedDriver"}


def kind_of(url: str) -> str:
    kind = url.removeprefix("jdbc:").split(":")[0]
    if kind == "oracle":
        raise UnsupportedConnector("Oracle is not scanned; its connector only validates")
    return kind


def query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A query that the database runs; a missing driver is an error of its own, nothing is tried instead."""
    kind = kind_of(url)
    reader = spark.read.format("jdbc").option("url", url).option("query", sql)
    for k, v in (({"driver": DRIVERS[kind]} if kind in DRIVERS else {}) | options).items():
        reader = reader.option(k, v)
    try:
        return reader.load()
    except Exception as e:
        if "ClassNotFoundException" in str(e):
            raise UnsupportedConnector(f"no JDBC driver for {kind} on the class path") from e
        raise


def catalog(spark: SparkSession, url: str, what: str, **options: str) -> DataFrame:
    """schemas, tables or columns of a database, column names in lower case."""
    kind = kind_of(url)
    if kind not in CATALOGS:
        raise UnsupportedConnector(f"no catalog query for {kind}")
    found = query(spark, url, CATALOGS[kind][what], **options)
    return found.toDF(*(c.lower() for c in found.columns))


def quoted(kind: str, *names: str) -> str:
    """A qualified identifier in a database's quotes, which are doubled inside."""
    q = "`" if kind == "mysql" else '"'
    return ".".join(q + n.replace(q, q * 2) + q for n in names)


def totals_sql(kind: str, schema: str, table: str, columns: Sequence[str]) -> str:
    """Rows, and the present values of every column, by one scan in the database."""
    return f"SELECT COUNT(*) AS n_rows{''.join(f', COUNT({quoted(kind, c)}) AS p{i}' for i, c in enumerate(columns))} FROM {quoted(kind, schema, table)}"


def totals(spark: SparkSession, url: str, schema: str, table: str, columns: Sequence[str], **options: str) -> tuple[int, list[int]]:
    n, *present = query(spark, url, totals_sql(kind_of(url), schema, table, columns), **options).head()
    return int(n), [int(p) for p in present]


def frequencies_sql(kind: str, schema: str, table: str, column: str, threshold: int, is_text: bool = True) -> str:
    """What the database is asked for a column's threshold + 1 most frequent values."""
    t, c = quoted(kind, schema, table), quoted(kind, column)
    kinds = {"mysql": "CHAR", "derby": "VARCHAR(4000)"}
    text = f"CAST({c} AS {kinds.get(kind, 'TEXT')})" if is_text or kind != "derby" else c  # Derby casts no floating point number to text
    end = f"FETCH FIRST {threshold + 1} ROWS ONLY" if kind == "derby" else f"LIMIT {threshold + 1}"
    return f"SELECT v AS value_text, COUNT(*) AS n_rows FROM (SELECT {text} AS v FROM {t} WHERE {c} IS NOT NULL) x GROUP BY v ORDER BY n_rows DESC, value_text {end}"


def frequencies(spark: SparkSession, url: str, schema: str, table: str, columns: Sequence[str], threshold: int, at_once: int = 4, **options: str) -> list[list[tuple[str, int]]]:
    """At most threshold + 1 (value, count) pairs of each column, a few columns at a time; nothing else leaves the database."""
    kind = kind_of(url)
    texts = {c for c, t in query(spark, url, f"SELECT * FROM {quoted(kind, schema, table)}", **options).dtypes if t == "string"}

    def ask(column: str) -> list[tuple[str, int]]:
        sql = frequencies_sql(kind, schema, table, column, threshold, kind != "derby" or column in texts)
        return [(str(r[0]), int(r[1])) for r in query(spark, url, sql, **options).collect()]

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(ask, columns))


def ranges(histogram: Sequence[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Neighbouring cells (cell, count), in order, as at most `parts` runs [first, end) of about equal counts; together they hold every cell."""
    total, out, held = sum(n for _, n in histogram), [], 0
    first = histogram[0][0] if histogram else 0
    for i, (cell, n) in enumerate(histogram):
        held += n
        if held * parts >= total * (len(out) + 1) and i + 1 < len(histogram):
            out.append((first, cell + 1))
            first = cell + 1
    return [*out, (first, histogram[-1][0] + 1)] if histogram else []


def predicates(spark: SparkSession, url: str, schema: str, table: str, key: str, parts: int, cells: int = 1024, **options: str) -> list[str]:
    """WHERE conditions that cut a table into about equal parts by an integer key, from a histogram that the database makes; no row is in two.

    Parts are as even as the histogram's `cells` equal ranges of keys allow. The first part has null keys, and all outer parts are open,
    so rows that come between the two readings aren't lost.
    """
    kind = kind_of(url)
    t, c = quoted(kind, schema, table), quoted(kind, key)
    low, high = query(spark, url, f"SELECT MIN({c}) AS low, MAX({c}) AS high FROM {t}", **options).head()
    if low is None or parts < 2:
        return ["1 = 1"]
    low, width = int(low), max(1, -(-(int(high) - int(low) + 1) // cells))
    divide = f"({c} - ({low})) {'DIV' if kind == 'mysql' else '/'} {width}"
    found = query(spark, url, f"SELECT cell, COUNT(*) AS n FROM (SELECT {divide} AS cell FROM {t} WHERE {c} IS NOT NULL) x GROUP BY cell ORDER BY cell", **options).collect()
    cuts = [low + end * width for _, end in ranges([(int(r[0]), int(r[1])) for r in found], parts)[:-1]]
    if not cuts:
        return ["1 = 1"]
    return [f"{c} < {cuts[0]} OR {c} IS NULL", *(f"{c} >= {a} AND {c} < {b}" for a, b in pairwise(cuts)), f"{c} >= {cuts[-1]}"]


def read_table(spark: SparkSession, url: str, schema: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A whole table, by as many connections at a time as tasks, each with a range of an integer key; without a key by one."""
    kind = kind_of(url)
    where = predicates(spark, url, schema, table, key, parts, **options) if key else ["1 = 1"]
    properties = ({"driver": DRIVERS[kind]} if kind in DRIVERS else {}) | options
    return spark.read.jdbc(url, quoted(kind, schema, table), predicates=where, properties=properties)


def select_tables(tables: DataFrame, config: ScanConfig) -> DataFrame:
    """Allowed tables, by name or schema.name, once each, in order, up to the cap."""
    out = tables
    if config.schemas:
        out = out.where(F.col("table_schema").isin(*config.schemas))
    if config.tables:
        out = out.where(F.col("table_name").isin(*config.tables) | F.concat_ws(".", "table_schema", "table_name").isin(*config.tables))
    return out.dropDuplicates(["table_schema", "table_name", "kind"]).orderBy("table_schema", "table_name", "kind").limit(config.max_tables)


def limit_columns(columns: DataFrame, config: ScanConfig) -> DataFrame:
    """Each table's first columns by position, once each, up to the cap."""
    w = Window.partitionBy("table_schema", "table_name").orderBy("ordinal_position", "column_name")
    once = columns.dropDuplicates(["table_schema", "table_name", "column_name"])
    return once.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= config.max_columns).drop("nth")


def sample_rows(df: DataFrame, columns: Iterable[str], asked: int, config: ScanConfig, key: str | None = None) -> DataFrame:
    """At most the configured number of rows of some columns."""
    chosen = df.select(*columns)
    return (chosen.orderBy(key) if key else chosen).limit(max(0, min(asked, config.max_rows)))


def may_load(url: str, table: str, allowed_hosts: tuple[str, ...] = ("localhost", "127.0.0.1"), prefix: str = "fixture_") -> bool:
    """Fixtures are only loaded to this machine and to tables named as fixtures."""
    place = urlsplit(url.removeprefix("jdbc:").split(";")[0])
    here = place.hostname in allowed_hosts and "@" not in place.netloc if "//" in url else kind_of(url) == "derby"
    return here and table.lower().startswith(prefix)


_TYPES = {"byte": "SMALLINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def definition(kind: str, df: DataFrame, table: str, comment: str | None = None, comments: Mapping[str, str] | None = None) -> list[str]:
    """CREATE TABLE for a frame, with the comments on the table and its columns in the database's own way; Derby has none."""
    text = "VARCHAR(32000)" if kind == "derby" else "TEXT"
    said = lambda t: "'" + t.replace("\\", "\\\\" if kind == "mysql" else "\\").replace("'", "''") + "'"
    columns = []
    for f in df.schema.fields:
        name = f.dataType.typeName()
        of = f"DECIMAL({f.dataType.precision}, {f.dataType.scale})" if name == "decimal" else _TYPES.get(name, text)
        note = (comments or {}).get(f.name)
        columns.append(f"{quoted(kind, f.name)} {of}{'' if f.nullable else ' NOT NULL'}{f' COMMENT {said(note)}' if note and kind == 'mysql' else ''}")
    out = [f"CREATE TABLE {quoted(kind, table)} ({', '.join(columns)}){f' COMMENT {said(comment)}' if comment and kind == 'mysql' else ''}"]
    if kind == "postgresql":
        out += [f"COMMENT ON TABLE {quoted(kind, table)} IS {said(comment)}"] if comment else []
        out += [f"COMMENT ON COLUMN {quoted(kind, table, c)} IS {said(t)}" for c, t in (comments or {}).items() if c in df.columns]
    return out


def execute(spark: SparkSession, url: str, statements: Iterable[str], **options: str) -> None:
    """Statements without a result, in one transaction, from the driver."""
    jvm, kind = spark.sparkContext._jvm, kind_of(url)
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    connection = jvm.java.lang.Class.forName(DRIVERS[kind], True, loader).getDeclaredConstructor(None).newInstance(None).connect(url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for s in statements:
            statement.execute(s)
        connection.commit()
    finally:
        connection.rollback()
        connection.close()


def load_table(df: DataFrame, url: str, table: str, mode: str = "errorifexists", comment: str | None = None, comments: Mapping[str, str] | None = None, **options: str) -> None:
    """A frame as a fixture. With comments the table is created first, under its own definition, and the rows are appended."""
    if not may_load(url, table):
        raise PermissionError(f"{table}: fixtures go to tables named fixture_* of a local database")
    kind = kind_of(url)
    if comment or comments:
        execute(spark=df.sparkSession, url=url, statements=definition(kind, df, table, comment, comments), **options)
        table, mode = quoted(kind, table), "append"
    df.write.format("jdbc").options(**({"url": url, "dbtable": table, "driver": DRIVERS[kind]} | options)).mode(mode).save()
