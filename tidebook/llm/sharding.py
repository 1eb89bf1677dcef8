"""Sharding by vector bin packing: bytes, words and rows balanced jointly.

Documents of equal text are a group, which goes to one shard as a whole. Groups above 1/LARGE of all bytes, words or rows
are placed one by one; there are fewer than 3 * LARGE of them. Smaller groups are put together by hash into BUNDLES
bundles, which are placed like groups, so what the driver packs doesn't grow with the corpus. Only a group that holds
more of the bytes, words or rows than a shard is to hold is split, into parts of a quarter of that.

Units go, largest first, to the shard where the dot product of their vector with the residual capacity is highest; bytes
weigh most, since their sums are the law. Slots are numbered by prefix sums over buckets of each shard. Rows carry a
number of their own, written with their sizes, so parts and buckets of rows that are alike in everything are even.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import WORD, Scratch
from tidebook.sources.tables import table

SHARDS, BUNDLES, LARGE = 16, 8192, 4096
#: Parts, to a shard's worth, of a group that no shard can hold.
PARTS = 4
#: Weights of bytes, words and rows in the dot product, and for the last units, of LAST of all bytes, which even out the law.
IMPORTANCE, FINAL, LAST = (1.0, 0.25, 0.25), (1.0, 0.001, 0.001), 0.25


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit; ``units``: rows of (bytes, words, rows)."""
    demand = units / np.maximum(units.sum(0), 1.0)
    left = np.full((shards, 3), 1.0 / shards)
    out, rest = np.zeros(len(units), np.int64), 1.0
    for i in np.lexsort((np.arange(len(units)), -units[:, 2], -units[:, 0])):
        best = int(np.argmax(left @ (demand[i] * (IMPORTANCE if rest > LAST else FINAL))))
        out[i] = best
        left[best] -= demand[i]
        rest -= demand[i, 0]
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row of ``docs`` (doc_id, text, any others).

    The size is the UTF-8 bytes of the text (null: none) and 1; the shards' sums are near equal. Equal texts share a
    shard unless together they hold more than 1/shards of all bytes, words or rows; null and empty texts are equal here.
    Groups with equal sums go in the order of their hashes. Slots are gapless from 0 in each shard, in no order that means
    anything. Repeated rows are rows of their own, null ids are allowed, and very long texts are read whole. An empty
    table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(spark, "sharding")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("no_"))
    rows = scratch.keep(rows, "sizes")
    key = ["h", "size", "text_crc32"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("words").alias("words"))
    totals = rows.agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("n")).first()
    whole = [max(1, int(totals[c] or 0)) for c in ("bytes", "words", "n")]
    share = F.greatest(F.col("n") * F.col("size") / whole[0], F.col("n") * F.col("words") / whole[1], F.col("n") / whole[2])
    large = sorted(map(tuple, groups.withColumn("share", share).where(F.col("share") * LARGE > 1).select(*key, "n", "share").collect()))
    parts = [min(x[3], ceil(x[4] * PARTS * shards)) if x[4] * shards > 1 else 1 for x in large]
    known = spark.createDataFrame([(*x[:3], i, p) for i, (x, p) in enumerate(zip(large, parts, strict=True))], "h long, size long, text_crc32 long, no int, parts int")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "no_"), F.col("parts"))).otherwise(0)
    unit = F.when(F.col("no").isNotNull(), BUNDLES + F.col("no") * (PARTS * shards + 1) + part).otherwise(F.pmod(F.col("h"), F.lit(BUNDLES)))
    rows = rows.join(F.broadcast(known), key, "left").withColumn("unit", unit.cast("long")).select("doc_id", "size", "text_crc32", "no_", "words", "unit")
    sums = sorted(map(tuple, rows.groupBy("unit").agg(F.sum("size"), F.sum("words"), F.count("*")).collect()))
    to = place(np.array([x[1:] for x in sums], np.float64).reshape(-1, 3), shards)
    placed = rows.join(F.broadcast(spark.createDataFrame([(x[0], int(s)) for x, s in zip(sums, to, strict=True)], "unit long, shard int")), "unit")
    # Slots: buckets of a few ten thousand rows at most, whatever the corpus.
    buckets = max(16, int(totals["n"]) // (shards * 20_000))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("no_"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "no_")) - 1
    numbered = placed.withColumn("within", within).join(before, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, table(spark, sf_dir, "documents"))
