"""Derived tables that are committed once per data folder and then read."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession

from tidebook.sources.shared import shared_dir


def _state(spark: SparkSession, path: str) -> str:
    """Length and time of a file, or of all files of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return ";".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(at)))


def committed(spark: SparkSession, sf_dir: str, name: str, table: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()``, which derives them from ``table`` of ``sf_dir``: written to the shared folder at first, read
    from there after that, and made again when the table's files change. A writer that dies leaves nothing that is read;
    of two at once the later one's folder, with the same rows, is dropped."""
    source = f"{sf_dir.rstrip('/')}/{table}.parquet"
    key = blake2b(f"{source}|{_state(spark, source)}".encode(), digest_size=12).hexdigest()
    root = f"{shared_dir(spark).rstrip('/')}/committed"
    path, path_of = f"{root}/{name}-{key}", spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path_of(f"{path}/_SUCCESS")):
        draft = f"{path}.draft-{spark.sparkContext.applicationId}"
        make().write.mode("overwrite").parquet(draft)
        if not fs.rename(path_of(draft), path_of(path)):
            fs.delete(path_of(draft), True)
    return spark.read.parquet(path)
