"""Documents in blocks: bounded runs of rows, one compressed Arrow payload each, bucketed by block.

A corpus-wide question about texts ("is this seen elsewhere?") is asked in three steps: every block sends the
distinct keys it holds, the keys meet their like in a shuffle, the answers come back by block. Only keys and answers
move; the payloads are shuffled once, when the table is written, because joins on the bucket column need no exchange.
A key that a third of all documents share is sent once per block, not once per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidalframe.llm.common import in_scope, partitions, table_path

BLOCK_BYTES = 2 << 20
_SCHEMA = pa.schema([("block", pa.int64()), ("payload", pa.binary())])


def pack(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _pack_rows(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    held, size, number = [], 0, 0

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([pack(pa.Table.from_batches(held))], pa.binary())], schema=_SCHEMA)

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        ends, begin = np.cumsum(lengths), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + limit - size)) + 1)
            held.append(batch.slice(begin, stop - begin))
            size += int(ends[stop - 1] - before)
            begin = stop
            if size >= limit:
                yield emit()
                held, size, number = [], 0, number + 1
    if held:
        yield emit()


def write_blocks(df: DataFrame, text: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Table (block, payload): every row of ``df`` is in one block of about ``block_bytes`` of text.

    Its files lie below the shared folder, so the table outlives any executor. In a scope its name stays in the catalog until the
    scope is removed, else it goes at once: the files stay, and the result reads them.
    """
    spark, buckets = df.sparkSession, partitions(df.sparkSession)
    table = f"blocks_{name}_{uuid.uuid4().hex}"
    packed = df.mapInArrow(partial(_pack_rows, text=text, limit=block_bytes), "block bigint, payload binary")
    path = table_path(spark, f"blocks-{name}", table)
    packed.repartition(buckets, "block").write.format("parquet").option("compression", "uncompressed").option("path", path).bucketBy(buckets, "block").saveAsTable(table)
    blocks = spark.table(table)
    if not in_scope():
        spark.sql(f"DROP TABLE {table}")
    return blocks


def drop_blocks(spark, name: str) -> None:
    """Take the block tables of one name out of the catalog, when results built on them are no longer read."""
    for table in spark.catalog.listTables():
        if table.name.startswith(f"blocks_{name}_"):
            spark.sql(f"DROP TABLE {table.name}")
