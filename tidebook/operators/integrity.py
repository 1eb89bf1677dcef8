"""Snapshots, recovery and integrity checks of the ledger and its balances."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.ledger import KEY
from tidebook.schemas import CHUNK_ACCOUNTS

MASK = (1 << 64) - 1


def snapshots_due(batches: DataFrame, quantity: int) -> DataFrame:
    """batches (shard_id, before, after) with how many boundaries of ``quantity`` each crosses: as many equal snapshots."""
    return batches.withColumn("snapshots", (F.floor(F.col("after") / quantity) - F.floor(F.col("before") / quantity)).cast("long")).where("snapshots > 0")


def snapshot(book: DataFrame, upto: int | None = None) -> DataFrame:
    """Balances of each shard after sequence ``upto``, or at its head, in chunks of 1,024 accounts in order, with the place in the shard.

    Places are prefix sums over hash-free account ranges, so a shard's accounts aren't sorted in one task.
    """
    from tidebook.functions.ordering import running_sum

    last = (book if upto is None else book.where(F.col("seq") <= upto)).groupBy("shard_id", "account_id").agg(F.max_by("balance", "seq").alias("balance"))
    placed = running_sum(last, ["shard_id"], "account_id", F.lit(1), "place")
    return placed.withColumn("place", F.col("place") - 1).withColumn("chunk", F.floor((F.col("place")) / CHUNK_ACCOUNTS).cast("long"))


def checksums(chunks: DataFrame) -> DataFrame:
    """FNV-1a (64 bits) of each shard's (account, balance) pairs in big-endian bytes, in account order, as hexadecimal.

    The hash is sequential; a shard's rows stream through one task in order and only the hash is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for batch in batches:
            for shard, account, balance in zip(*(batch.column(c).to_pylist() for c in ("shard_id", "account_id", "balance")), strict=True):
                h = done.get(shard, 0xCBF29CE484222325)
                for byte in int(account).to_bytes(8, "big") + int(balance).to_bytes(8, "big"):
                    h = (h ^ byte) * 0x100000001B3 & MASK
                done[shard] = h
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([f"{h:016x}" for h in done.values()])], ["shard_id", "checksum"])

    rows = chunks.select("shard_id", "account_id", "balance").repartition("shard_id").sortWithinPartitions("shard_id", "account_id")
    return rows.mapInArrow(run, "shard_id int, checksum string")


def checkpoint_findings(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """shard_id, finding of stored checkpoints: users, chunks, width or checksum that differ from the manifest, accounts out of order."""
    actual = chunks.groupBy("shard_id").agg(F.count("*").alias("_users"), F.countDistinct("chunk").alias("_chunks"))
    wide = chunks.groupBy("shard_id", "chunk").agg(F.count("*").alias("n"), F.max("place").alias("top"), F.min("place").alias("low")).where((F.col("n") > CHUNK_ACCOUNTS) | (F.col("top") - F.col("low") + 1 != F.col("n")) | (F.col("low") != F.col("chunk") * CHUNK_ACCOUNTS))
    order = chunks.withColumn("_p", F.lag("account_id").over(Window.partitionBy("shard_id", "chunk").orderBy("place"))).where("_p >= account_id")
    both = manifest.join(actual, "shard_id", "left").join(checksums(chunks).withColumnRenamed("checksum", "_checksum"), "shard_id", "left")
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("users", "chunks", "checksum"))))
    one = both.select("shard_id", F.explode(wrong).alias("finding"))
    return one.unionByName(wide.select("shard_id", F.lit("width").alias("finding")).distinct()).unionByName(order.select("shard_id", F.lit("order").alias("finding")).distinct())


def orphans(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks of generations that no manifest names."""
    return chunks.select("shard_id", "generation", "chunk").distinct().join(manifest, ["shard_id", "generation"], "left_anti")


def recovered(snapshot_: DataFrame, tail: DataFrame) -> DataFrame:
    """Balances from a snapshot (at sequence 0 of the tail) and each later result, the last one winning."""
    base = snapshot_.select("shard_id", "account_id", "balance", F.lit(0).cast("long").alias("seq"))
    return base.unionByName(tail.select("shard_id", "account_id", "balance", "seq")).groupBy("shard_id", "account_id").agg(F.max_by("balance", "seq").alias("balance"))


def metadata_findings(meta: DataFrame) -> DataFrame:
    """Metadata rows (shard_id, latest, projected, gc, boundary_at, boundary_seq, bound) with the rules that they break."""
    c = F.col
    rules = {
        "projected_beyond_latest": c("projected") > c("latest"),
        "gc_beyond_latest": c("gc") > c("latest"),
        "gc_beyond_projected": c("gc") > c("projected"),
        "gc_beyond_boundary": c("gc") > F.coalesce("boundary_seq", F.lit(0)),
        "half_boundary": c("boundary_at").isNull() != c("boundary_seq").isNull(),
        "progress_unbound": ~c("bound") & (c("projected") > 0),
    }
    return meta.select("shard_id", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in rules.items())))).alias("finding"))


def index_findings(book: DataFrame, index: DataFrame, meta: DataFrame) -> DataFrame:
    """shard_id, finding, n: rows of the index without an equal ledger row and the reverse, sequences outside
    (gc, latest], gaps after the collected prefix, and counts other than latest - gc."""
    a = book.select("shard_id", *KEY, "seq")
    b = index.select("shard_id", *KEY, F.col("seq").alias("_seq"))
    both = a.join(b, ["shard_id", *KEY], "full")
    differ = both.where(~F.col("seq").eqNullSafe(F.col("_seq"))).groupBy("shard_id").agg(F.count("*").alias("n")).select("shard_id", F.lit("mismatch").alias("finding"), "n")
    m = F.broadcast(meta.select("shard_id", "latest", "gc"))
    outside = a.join(m, "shard_id").where((F.col("seq") <= F.col("gc")) | (F.col("seq") > F.col("latest"))).groupBy("shard_id").agg(F.count("*").alias("n")).select("shard_id", F.lit("outside").alias("finding"), "n")
    after = a.select("shard_id", (F.col("seq") + 1).alias("seq")).unionByName(meta.select("shard_id", (F.col("gc") + 1).alias("seq")))
    gaps = after.join(m, "shard_id").where("seq <= latest").join(a.select("shard_id", "seq"), ["shard_id", "seq"], "left_anti").groupBy("shard_id").agg(F.count("*").alias("n")).select("shard_id", F.lit("gap").alias("finding"), "n")
    counts = a.groupBy("shard_id").agg(F.count("*").alias("c")).join(m, "shard_id").where("c <> latest - gc").select("shard_id", F.lit("count").alias("finding"), (F.col("c") - (F.col("latest") - F.col("gc"))).alias("n"))
    return differ.unionByName(outside).unionByName(gaps).unionByName(counts)


def balance_findings(book: DataFrame, balances: DataFrame) -> DataFrame:
    """Accounts whose stored balance is missing or isn't that of their last ledger row."""
    last = book.groupBy("shard_id", "account_id").agg(F.max_by("balance", "seq").alias("expected"))
    rows = last.join(balances.select("account_id", F.col("balance").alias("stored")), "account_id", "left").where(~F.col("stored").eqNullSafe(F.col("expected")))
    return rows.select("shard_id", "account_id", "expected", "stored", F.when(F.col("stored").isNull(), "missing").otherwise("differs").alias("finding"))


def repeated_accounts(balances: DataFrame) -> DataFrame:
    return balances.groupBy("account_id").agg(F.count("*").alias("n")).where("n > 1")


def stage_findings(stages: DataFrame, expected: int, limits: dict[str, int]) -> DataFrame:
    """Rows (stage, metric, value) that break a rule: a count other than ``expected``, a peak above its limit."""
    bad = (F.col("metric") == "count") & (F.col("value") != expected)
    for name, most in limits.items():
        bad = bad | ((F.col("metric") == name) & (F.col("value") > most))
    return stages.where(bad)
