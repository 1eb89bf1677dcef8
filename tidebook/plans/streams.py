"""Queries that run streams over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.plans.ledger import ORDERED_APPLY
from tidebook.plans.registry import query
from tidebook.sources.derive import RETRY, requests
from tidebook.sources.shared import shared_dir
from tidebook.streaming.apply import numbered, replies_stream, request_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("w11_stateful_stream", ORDERED_APPLY)
def stateful_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies of the ledger from a stream of four files: half of the originals, the rest, and the two kinds of retries."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = requests(spark, sf_dir)
    half = rows.where(F.col("arrival_ord") < RETRY).agg((F.max("arrival_ord") / 2).cast("long").alias("m")).first()["m"] or 0
    cuts = [0, half, RETRY, 2 * RETRY, 3 * RETRY]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows.where((F.col("arrival_ord") >= a) & (F.col("arrival_ord") < b)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = replies_stream(request_stream(spark, f"{root}/in", rows.schema))
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return numbered(spark.read.schema(out.schema).parquet(f"{root}/out"))
