"""Intermediate tables in the shared folder: lineage is cut, executors can reread them, and the planner knows their size."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


class _Made(threading.local):
    """The folders that this thread made: runs on threads of their own have marks of their own."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_made = _Made()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may go without: it makes one, as all its tasks share the machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-liftwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, for `discard` to find."""
    _made.folders.append(f"{scratch_dir(spark)}/liftwork-{uuid.uuid4().hex}")
    return _made.folders[-1]


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and reread."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many intermediate tables there are so far: a mark for `discard`."""
    return len(_made.folders)


def discard(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Deletes the intermediate tables that this thread wrote between the marks; what still reads them must have been written itself."""
    files = spark._jvm.org.apache.hadoop.fs.Path  # the session's own file systems: the folder may be anywhere that Spark reads
    for folder in _made.folders[since:upto]:
        path = files(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made.folders[since:upto]
