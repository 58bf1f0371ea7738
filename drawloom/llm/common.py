"""Helpers of the text operators: tables, size-checked joins, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drawloom.session import cut_lineage

#: A list of ids is sent to every task up to so many rows (16 bytes each), and shuffled beyond.
BROADCAST_ROWS = 500_000
#: A task turns so much text at a time into Python objects (a longer text is taken alone).
SLICE_BYTES = 1 << 21
#: Rows and bytes of an Arrow batch where many Python stages share the executors.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives executors, has true statistics."""
    return cut_lineage(df)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` (a stored table of narrow rows) for broadcast only if a count proves it small."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows that are few in bytes but cost much CPU, dealt over the full shuffle width."""
    return df.repartition(shuffle_width(df.sparkSession), *df.columns[:2])


def lower_ascii(text):
    """Lower-cases A-Z only. ``lower`` also changes other letters, so it serves pure ASCII texts alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null becomes empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``limit`` bytes of one text column; a piece has at least one row."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False)))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session's later steps are small: executors keep what buffers of the largest one took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release_memory() -> None:
    """Gives back what a task's objects and Arrow batches have left free in a Python worker, which outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Applies a function from batch to batch on Arrow data, in pieces of bounded text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    if (out := one(part)) is not None:
                        yield out
        finally:
            release_memory()

    return df.mapInArrow(run, schema)
