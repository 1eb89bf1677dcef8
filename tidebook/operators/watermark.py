"""Time boundary: late requests are answered from history, and a prefix of the ledger behind it may be collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.history import lookup
from tidebook.operators.ledger import KEY


def route(at: Column, boundary: Column) -> Column:
    """historical strictly before the boundary, else commit."""
    return F.when(at < boundary, "historical").otherwise("commit")


def late_answers(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Replies to historical requests: the original result, a conflict, or expired for a key that isn't known. No
    sequence is used up."""
    rows = lookup(requests, history)
    kind = F.when(F.col("found") == "exact_replay", "transaction").when(F.col("found") == "conflict", "conflict").otherwise("expired")
    return rows.withColumn("reply_kind", kind).withColumn("historical_replay", F.col("found") == "exact_replay").drop("found")


def would_block(at: Column, boundary: Column, candidate: Column) -> Column:
    """True for what waits while the boundary moves up to ``candidate``."""
    return (at >= boundary) & (at < candidate)


def advanced(shards: DataFrame, now: int, retention: int) -> DataFrame:
    """shard rows (boundary_at, boundary_seq, latest_seq, projected_seq) with the boundary after one step.

    The candidate is ``now - retention`` with the head's sequence. It holds once the projection covers the head; time and
    sequence never go back.
    """
    candidate = F.lit(now - retention)
    moves = (F.col("projected_seq") >= F.col("latest_seq")) & (candidate > F.coalesce("boundary_at", F.lit(-1))) & (F.col("latest_seq") >= F.coalesce("boundary_seq", F.lit(0)))
    return shards.withColumn("moved", moves).withColumn("next_at", F.when(moves, candidate).otherwise(F.col("boundary_at"))).withColumn("next_seq", F.when(moves, F.col("latest_seq")).otherwise(F.col("boundary_seq")))


def restorable(shards: DataFrame) -> DataFrame:
    """Whether a stored boundary is a whole pair and covered by the projection, and so counts after a restart."""
    pair = F.col("boundary_at").isNotNull() & F.col("boundary_seq").isNotNull()
    return shards.withColumn("restored", pair & (F.col("boundary_seq") <= F.col("projected_seq")))


def safe_prefix(book: DataFrame, shards: DataFrame, most: int) -> DataFrame:
    """Rows that may be collected, and one row a shard of what a step comes to.

    shards: shard_id, boundary_at, boundary_seq, latest_seq, projected_seq, coverage_seq, gc_prefix_seq. The scan starts
    after the prefix, ends at the least of the four sequences (one that isn't known allows nothing) and after ``most``
    rows, and stops at the first row at or after the boundary, whatever follows, and before the first missing sequence,
    which is the least that follows a row (or the prefix) and has none; no shard is put in order.
    """
    limit = F.least(*(F.coalesce(c, F.lit(0).cast("long")) for c in ("boundary_seq", "latest_seq", "projected_seq", "coverage_seq")), F.col("gc_prefix_seq") + most)
    open_ = shards.where("boundary_at is not null and gc_prefix_seq is not null").withColumn("_limit", limit)
    rows = book.join(F.broadcast(open_), "shard_id").where("seq > gc_prefix_seq and seq <= _limit")
    after = lambda df, c: df.select("shard_id", (F.col(c) + 1).alias("seq"))
    missing = after(rows, "seq").unionByName(after(open_, "gc_prefix_seq")).join(rows.select("shard_id", "seq"), ["shard_id", "seq"], "left_anti")
    rows = rows.join(F.broadcast(missing.groupBy("shard_id").agg(F.min("seq").alias("_missing"))), "shard_id").where("seq < _missing").drop("_missing")
    blocker = rows.where("transaction_at >= boundary_at").groupBy("shard_id").agg(F.min("seq").alias("blocked_at_seq"))
    return rows.join(F.broadcast(blocker), "shard_id", "left").where(F.col("blocked_at_seq").isNull() | (F.col("seq") <= F.col("blocked_at_seq"))).withColumn("deletable", F.coalesce(F.col("seq") < F.col("blocked_at_seq"), F.lit(True)))


#: Bytes of a stored key of each kind.
LEDGER_KEY, INDEX_KEY, MARKER_KEY = 9, 25, 25


def accounting(scanned: DataFrame) -> DataFrame:
    """scanned (the blocker included), deleted, blocked_at_seq, prefix and bytes of each shard's step."""
    gone = F.col("deletable")
    marker = F.when((F.col("operation") == "refund") & (F.col("status") == "applied"), MARKER_KEY + 8).otherwise(0)
    value = F.when(F.col("refund_of").isNull(), 51).otherwise(75)
    return scanned.groupBy("shard_id").agg(
        F.count("*").alias("scanned"), F.count_if(gone).alias("deleted"), F.min("blocked_at_seq").alias("blocked_at_seq"), F.coalesce(F.max(F.when(gone, F.col("seq"))), F.min("gc_prefix_seq")).alias("prefix"),
        F.sum(F.when(gone, LEDGER_KEY + INDEX_KEY + 2 * value + marker).otherwise(0)).cast("long").alias("bytes_deleted"),
    )


def consistency(scanned: DataFrame, index: DataFrame, markers: DataFrame, balances: DataFrame) -> DataFrame:
    """What a step finds wrong in rows to delete: the index differs, a refund's marker is missing, a balance is missing."""
    rows = scanned.where("deletable")
    held = index.select(*KEY, F.col("seq").alias("_i"))
    a = rows.join(held, KEY, "left").where(~F.col("_i").eqNullSafe(F.col("seq"))).select("shard_id", "seq", F.lit("index").alias("finding"))
    refunds = rows.where("operation = 'refund' and status = 'applied'").select("shard_id", "seq", "refund_of.*")
    b = refunds.join(markers, KEY, "left_anti").select("shard_id", "seq", F.lit("marker").alias("finding"))
    c = rows.join(balances, "account_id", "left_anti").select("shard_id", "seq", F.lit("balance").alias("finding"))
    return a.unionByName(b).unionByName(c)


def coverage(shards: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """With ``coverage_seq``: the head where balances are stored with each batch, the manifest's sequence (0 without one)
    where they come from checkpoints."""
    if manifest is None:
        return shards.withColumn("coverage_seq", F.col("latest_seq"))
    return shards.join(manifest.select("shard_id", F.col("seq").alias("_m")), "shard_id", "left").withColumn("coverage_seq", F.coalesce("_m", F.lit(0).cast("long"))).drop("_m")
