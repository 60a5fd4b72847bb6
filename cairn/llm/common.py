"""Shared helpers: size-checked joins and batches of a bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..tables import staged

#: Rows a table may have to be broadcast; counted from the staged table, never assumed.
BROADCAST_ROWS = 50_000
#: Bytes of its files, which are compressed.
BROADCAST_BYTES = 4 << 20


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Stage `df` and mark it for broadcast only if its counted rows and stored bytes are few.

    A larger table is returned as it is: Spark then shuffles both sides and AQE splits skew.
    """
    table = staged(df, name)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if path is None:
        return table
    stored = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(table) if stored <= size and table.count() <= rows else table


def balanced(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of record batches, each of about `most` bytes of the string column, so memory is bounded.

    At the end of a task free memory goes back to the system, as the worker stays for tasks that need it elsewhere.
    """
    for batch in batches:
        at, size = 0, 0
        for row, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            size += n
            if size >= most:
                yield batch.slice(at, row + 1 - at)
                at, size = row + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)
    release()


def release() -> None:
    """Give free memory of Arrow's pool and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
