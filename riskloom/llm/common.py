"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from riskloom.sources.store import discard, shared_dir, stored  # noqa: F401


#: Gives freed memory of numpy arrays back, where the C library can.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


materialize = stored


def shuffle_partitions(spark: SparkSession, factor: int = 1) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * factor


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows that no model may learn from: crc32 of doc_id as text leaves 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def carried(docs: DataFrame, keep: list[str] | None) -> Column:
    """The columns that an operator hands on unchanged, as one struct."""
    return F.struct(*[docs[c] for c in keep]).alias("carried") if keep else F.lit(None).cast("string").alias("carried")


def fields_of(rows: DataFrame, columns: list[str], rest: str) -> StructType:
    """The schema of some columns of rows, followed by fields in DDL."""
    return StructType([StructField(c, rows.schema[c].dataType) for c in columns] + StructType.fromDDL(rest).fields)


def unpack(out: DataFrame, keep: list[str], own: str | None = None) -> DataFrame:
    """Puts carried columns back in place of the struct; own is a kept column that stands beside it."""
    return out.select(*(F.col(c) if c == own else F.col(f"carried.{c}").alias(c) for c in keep), *[c for c in out.columns if c not in ("carried", own)])


def slices(batches: Iterator[pa.RecordBatch], rows: int, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each part has few rows and, single long rows aside, few bytes."""
    for batch in batches:
        step = rows
        if batch.num_rows:
            step = max(1, min(rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # workers live on; what this task freed goes back
    if TRIM is not None:
        TRIM(0)


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: Arrow batches of this session get fewer rows, unless the user has set their number."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(rows))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, texts one after the other, and where each begins (one offset more than texts)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
