"""Running NumPy code over text columns, a few megabytes at a time, and cutting lineage."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one call of a batch function sees, unless a single row is longer.
SLICE_BYTES = 1 << 21


_libc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives freed memory back to the system; the allocator would keep it for a worker that may sit idle next to a busy one."""
    pa.default_memory_pool().release_unused()
    if _libc_trim is not None:
        _libc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most max_bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, column: str = "text", max_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow that hands fn slices bounded by bytes instead of rows.

    Columns whose names mapInArrow can't resolve (with dots or backticks, or alike but for case) go by other names on the way.
    """
    lower = [c.lower() for c in df.columns]
    plain = [c if lower.count(c.lower()) == 1 and not set(c) & set(".`") else None for c in df.columns]
    if None in plain:
        spare = unused(df, *(f"column{i}" for i in range(len(plain))))
        sent = [c or s for c, s in zip(plain, spare)]
        names = [f.name for f in schema.fields] if isinstance(schema, StructType) else None
        if names is not None:
            back = dict(zip(sent, df.columns))
            # what passes through keeps its place; what fn adds comes after
            through = [s for s, c in zip(sent, df.columns) if c != column or column in names][: len(names)]
            out = [through[i] if i < len(through) and back[through[i]] == name else name for i, name in enumerate(names)]
            schema = StructType([StructField(o, f.dataType, f.nullable) for o, f in zip(out, schema.fields)])
        found = map_text(df.toDF(*sent), fn, schema, column, max_bytes)
        return found if names is None else found.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, max_bytes):
                out = fn(part)
                if out is not None:
                    yield out
            trim()

    return df.mapInArrow(run, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's shared folder; sets one in the temporary folder only where none is named and one machine does everything, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "recallgrid-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and the lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores in front as keep them from any column of df, in any case."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any(lead + name in taken for name in names):
        lead += "_"
    return [lead + name for name in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], ..., starts[i] + lengths[i] - 1 for every i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: one more than that is never read."""
    return df.limit(rows + 1).count() <= rows
