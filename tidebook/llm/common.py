"""Helpers shared by the corpus operators: shared-folder tables, labels and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.sources.shared import shared_dir

#: A word is a run of bytes other than the space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: texts can be long, and a batch is held by the executor and by its Python worker.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by BATCH_ROWS, unless they are smaller. Plans read the setting when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Scratch:
    """Parquet tables of one run in the shared folder. They cut lineage and outlive any executor."""

    #: Those made within ``released``, if in one.
    made: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        if Scratch.made is not None:
            Scratch.made.append(self)
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        # Shuffle files go when the driver's JVM collects the frames that made them. It may be long in no need to,
        # while executors' disks fill; nothing refers to the frames of earlier tables any more.
        self.spark._jvm.System.gc()
        path = f"{self.root}/{len(self.kept):02d}-{name}"
        df.write.parquet(path)
        self.kept.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.kept[-1][0]

    def clear(self, *needed: DataFrame) -> None:
        """Delete the tables but those ``needed``, once nothing will read the others."""
        jvm = self.spark._jvm
        for df, path in self.kept:
            if not any(df is x for x in needed):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released() -> Iterator[None]:
    """Delete in the end the tables of every Scratch that was made meanwhile: what was wanted of them is written elsewhere."""
    before, Scratch.made = Scratch.made, []
    try:
        yield
    finally:
        made, Scratch.made = Scratch.made, before
        for x in made:
            x.clear()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per node, component the least id.

    Randomised contraction (Bögeholz, Brand and Todor, 2020): each round every vertex takes the neighbour or itself of
    least hash, edges move to these, and the edges within one vertex go. The count of vertices falls by a constant
    factor a round on any graph, long paths included. Hubs are aggregated map-side.
    """
    edges = scratch.keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not is_empty(edges):
        salt = F.lit(len(maps) + 1)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("v"))
        chosen = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to"))
        maps.append(chosen := scratch.keep(chosen, "map"))
        edges = (
            edges.join(chosen.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(chosen.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        edges = scratch.keep(edges, "edges")
    if not maps:
        return scratch.keep(edges.select(F.col("a").alias("node"), F.col("a").alias("component")), "components")
    label = maps[-1]
    for earlier in reversed(maps[:-1]):
        label = earlier.join(label.select(F.col("node").alias("to"), F.col("to").alias("last")), "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    label = scratch.keep(label, "labels")
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    return scratch.keep(label.join(least, "to").select("node", "component"), "components")
