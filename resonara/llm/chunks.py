"""Tables gathered into chunks that stay where they are.

A chunk is a bounded run of rows, serialised as Arrow and written once in buckets
by its number.  Tasks look at chunks one by one; notes about a chunk (bitmaps, ids)
travel to it, and only the rows that are asked for leave it.  So texts are never
moved to be looked up, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed

#: Bytes of a chunk's texts, about; a row that is longer is a chunk by itself.
CHUNK = 8 << 20


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row, about: its strings and 16 for each column."""
    size = np.full(batch.num_rows, 16 * batch.num_columns, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_nested(column.type):
            size += column.nbytes // max(1, batch.num_rows)
    return size


def _serialised(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as out:
        for p in parts:
            out.write_batch(p)
    return pa.RecordBatch.from_arrays([pa.array([sum(p.num_rows for p in parts)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "rows"])


def _gathered(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, room = [], size
        for batch in batches:
            ends = np.cumsum(_row_bytes(batch))
            start, before = 0, 0
            while start < batch.num_rows:
                end = int(np.searchsorted(ends, before + room, side="right"))
                if end <= start and parts:  # the next row belongs to another chunk
                    yield _serialised(parts)
                    parts, room = [], size
                    continue
                end = max(end, start + 1)
                parts.append(batch.slice(start, end - start))
                room -= int(ends[end - 1]) - before
                start, before = end, int(ends[end - 1])
        if parts:
            yield _serialised(parts)

    return run


def _opened(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all()


def _none(schema: list[tuple[str, str]]) -> pa.Table:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in schema})


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a flat schema."""
    return [tuple(x.split()) for x in ddl.split(", ")]


class Chunks:
    """The rows of a table in chunks (``home``: chunk, n, rows)."""

    def __init__(self, df: DataFrame, label: str, size: int | None = None):
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        packed = df.mapInArrow(_gathered(size or CHUNK), "n long, rows binary").withColumn("chunk", F.monotonically_increasing_id())
        self.schema = df.schema
        self.home = bucketed(packed.select("chunk", "n", "rows"), label, ["chunk"], parts)

    def each(self, work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``work(chunk, rows)`` gives for each chunk."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from work(batch.column(0)[i].as_py(), _opened(batch.column(1)[i].as_py()))

        return self.home.select("chunk", "rows").mapInArrow(run, schema)

    def met(self, notes: DataFrame, work: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """What ``work(chunk, rows, notes)`` gives for each chunk and its ``notes`` (with ``chunk``), which travel to it."""
        none = None if not isinstance(schema, str) else columns_of(schema)

        def run(own: pa.Table, notes: pa.Table) -> pa.Table:
            if not own.num_rows:
                return _none(none)
            return work(own.column("chunk")[0].as_py(), _opened(own.column("rows")[0].as_py()), notes)

        return self.home.select("chunk", "rows").groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(run, schema)
