"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.session import scratch_path

# Null ids sort behind every other id.
NULL_ID = (1 << 63) - 1


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_scope: ContextVar[str | None] = ContextVar("scope", default=None)
# Catalog tables whose files lie in a scope.
_tables: dict[str, list[str]] = {}


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Folder below the shared one for all tables written inside, so that ``remove_scratch`` can remove them together."""
    folder = scratch_path(spark, name)
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)


def in_scope() -> bool:
    """Whether tables are written in a scope, which takes them out of the catalog when it is removed."""
    return _scope.get() is not None


def remove_scratch(spark: SparkSession, folder: str) -> None:
    """Remove a scope, or a table of ``materialise``, whose rows are no longer read."""
    for table in _tables.pop(folder, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A fresh path in the present scope, or without one below the shared folder; ``table`` is the name in the catalog, if any."""
    folder = _scope.get()
    if folder is None:
        return scratch_path(spark, name)
    if table:
        _tables.setdefault(folder, []).append(table)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table below the shared folder and read it back: later plans start there, whichever executor is lost."""
    path = path or table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def known_id(column: str) -> Column:
    """The id as a whole number; null ids come last in every order."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NULL_ID))


# DuckDB's SQL has no CRC-32: the table of its 256 byte steps.
CRC32_SQL = """bits AS (SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, over ``crc_table``'s t."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
