"""Small helpers shared by the training-data operators.

* `scratch` (of the sources) writes a DataFrame to the shared checkpoint folder and reads it back: lineage is
  cut, every executor can reread it, and its size is known to the planner.
* `ship` makes this package importable on the executors.
* `slices` walks an Arrow batch in pieces of bounded text size.
* `held` keeps one large table in a Python worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship as send
from ..sources.scratch import scratch_dir as scratch_dir
from ..sources.scratch import settled as scratch

T = TypeVar("T")

#: Bytes of text and rows that a Python task works on at once; row numbers in a slice fit 16 bits.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1 << 16


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, and keeps batches of whole texts small unless the user chose their size."""
    send(spark)
    if spark.conf.get(BATCH) == "10000":  # Spark's default
        spark.conf.set(BATCH, "1000")


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], T]) -> T:
    """The one large table that a Python worker keeps between tasks; asking for another frees the last."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and Spark's memory beside them is not theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of `batch` with the UTF-8 bytes of `column` (null: empty), about `most` bytes and at most SLICE_ROWS rows each."""
    texts = [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 == len(texts) or i + 1 - start == SLICE_ROWS:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[FileSystem, str]:
    """The file system of a URI or of a plain path, and the path in it."""
    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (LocalFileSystem(), uri)


def widened(df: DataFrame, more: dict[str, str]) -> StructType:
    """The schema of `df` with the columns `more` (name: type) after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in more.items())).fields])


def bundled(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns but text) and text: stages add columns of their own beside them, whatever the documents' are named."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"), "text")


def unbundled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The documents again, with the columns in their order."""
    return df.select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in columns))
