"""A SQLite table as a Spark data source, over the standard library, split by ranges of the row id."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = {"INT": LongType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType(), "BLOB": BinaryType()}


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: ``path`` (a file that all executors see), ``table``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with sqlite3.connect(self.options["path"]) as c:
            rows = c.execute(f'PRAGMA table_info("{self.options.get("table", "books")}")').fetchall()
        return StructType([StructField(r[1], _KINDS.get((r[2] or "").upper()[:4].strip() if not (r[2] or "").upper().startswith("INT") else "INT", StringType())) for r in rows])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.n, self.columns = options["path"], options.get("table", "books"), int(options.get("partitions", "1")), schema.fieldNames()

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(self.path) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.n)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Range):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(self.path) as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (part.low, part.high))


def read_sqlite(spark: SparkSession, path: str, table: str = "books", limit: int | None = None, partitions: int = 1) -> DataFrame:
    """A table by id; ``limit`` of None or 0 means all of it."""
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()
    return df.orderBy("id").limit(limit) if limit else df


def write_sqlite(df: DataFrame, path: str, table: str = "books") -> None:
    """A (small) catalog into a SQLite file on the driver, replaced in one transaction, rows streamed by partition."""
    names = ", ".join(f'"{c}"' for c in df.columns)
    with sqlite3.connect(path) as c:
        c.execute(f'DROP TABLE IF EXISTS "{table}"')
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        c.execute(f'CREATE TABLE "{table}" ({", ".join(f"{chr(34)}{n}{chr(34)} {kinds.get(k, chr(84) + "EXT")}" for n, k in df.dtypes)})')
        c.executemany(f'INSERT INTO "{table}" ({names}) VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))


def upsert_sqlite(df: DataFrame, path: str, key: str = "clean_title", table: str = "books", keep: tuple[str, ...] = ()) -> int:
    """Rows into a SQLite table by its unique ``key``: a known key takes all columns but ``keep``, a new one is inserted; the number of rows.

    The table must be there (``write_sqlite`` or the owner made it); other rows and columns stay. One transaction on the driver:
    a failure leaves the file as it was. Rows are streamed by partition.
    """
    names = [f'"{c}"' for c in df.columns]
    update = ", ".join(f'"{c}" = excluded."{c}"' for c in df.columns if c != key and c not in keep)
    n = 0
    with sqlite3.connect(path) as c:
        c.execute(f'CREATE UNIQUE INDEX IF NOT EXISTS "unique_{table}_{key}" ON "{table}" ("{key}")')
        rule = f"DO UPDATE SET {update}" if update else "DO NOTHING"
        for r in df.toLocalIterator():
            c.execute(f'INSERT INTO "{table}" ({", ".join(names)}) VALUES ({", ".join("?" * len(names))}) ON CONFLICT ("{key}") {rule}', tuple(r))
            n += 1
    return n
