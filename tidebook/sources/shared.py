"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it isn't set and all runs in one process, as in tests, a temporary folder
    made once; a cluster without it is refused, for its machines share no such folder."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tidebook-")
