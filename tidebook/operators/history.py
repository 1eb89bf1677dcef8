"""History projection: validation of a batch, lookups, contiguous progress, destination rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.ledger import KEY

BODY = ["operation", "amount", "refund_of"]


def findings(batch: DataFrame, history: DataFrame) -> DataFrame:
    """What speaks against applying ``batch`` (ledger rows) after ``history``: shard_id, seq, finding. Empty if nothing does.

    starts_late: a shard's batch begins beyond the row after its history; gap: a sequence is missing inside; changed: a
    known sequence has another body, or a known key another sequence; repeated_key: a key occurs twice in the batch;
    bad_refund: an applied refund has no applied debit of its account and amount before it, or isn't the first of it.
    """
    row = F.struct(*KEY, *BODY, "status", "balance")
    heads = history.groupBy("shard_id").agg(F.max("seq").alias("head"))
    firsts = batch.groupBy("shard_id").agg(F.min("seq").alias("first"))
    late = firsts.join(heads, "shard_id", "left").where(F.col("first") > F.coalesce("head", F.lit(0)) + 1).select("shard_id", F.col("first").alias("seq"), F.lit("starts_late").alias("finding"))
    # A row whose predecessor is missing, but for each shard's first: no shard is put in order.
    after = batch.select("shard_id", (F.col("seq") + 1).alias("seq"))
    gap = batch.select("shard_id", "seq").join(after, ["shard_id", "seq"], "left_anti").join(F.broadcast(firsts), "shard_id").where(F.col("seq") > F.col("first")).select("shard_id", "seq", F.lit("gap").alias("finding"))
    held = history.select("shard_id", "seq", row.alias("_old"))
    changed = batch.select("shard_id", "seq", row.alias("_new")).join(held, ["shard_id", "seq"]).where(~F.col("_new").eqNullSafe(F.col("_old"))).select("shard_id", "seq", F.lit("changed").alias("finding"))
    moved = batch.join(history.select(*KEY, F.col("seq").alias("_seq")), KEY).where("seq <> _seq").select("shard_id", "seq", F.lit("changed").alias("finding"))
    repeated = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))).where("_n > 1").select("shard_id", "seq", F.lit("repeated_key").alias("finding"))
    columns = ["shard_id", "seq", *KEY, *BODY, "status"]
    whole = batch.select(*columns, F.lit(True).alias("_own")).unionByName(history.select(*columns, F.lit(False).alias("_own")).join(batch.select("shard_id", "seq"), ["shard_id", "seq"], "left_anti"))
    debits = whole.where("operation = 'debit' and status = 'applied'").select("shard_id", *(F.col(k).alias(f"d_{k}") for k in KEY), F.col("amount").alias("d_amount"), F.col("seq").alias("d_seq"))
    refunds = whole.where("operation = 'refund' and status = 'applied'").withColumn("_first", F.min("seq").over(Window.partitionBy("shard_id", "refund_of")))
    on = [F.col("shard_id") == F.col("d_shard"), *(F.col(f"refund_of.{k}").eqNullSafe(F.col(f"d_{k}")) for k in KEY)]
    good = (F.col("d_amount") == F.col("amount")) & (F.col("d_seq") < F.col("seq")) & (F.col("_first") == F.col("seq"))
    bad = refunds.join(debits.withColumnRenamed("shard_id", "d_shard"), on, "left").where(F.col("_own") & ~F.coalesce(good, F.lit(False))).select("shard_id", "seq", F.lit("bad_refund").alias("finding"))
    return late.unionByName(gap).unionByName(changed).unionByName(moved).unionByName(repeated).unionByName(bad).distinct()


def applied_batch(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of ``batch`` beyond the history's progress, once ``findings`` is empty; replayed prefixes add nothing."""
    heads = history.groupBy("shard_id").agg(F.max("seq").alias("_head"))
    return batch.join(F.broadcast(heads), "shard_id", "left").where(F.col("seq") > F.coalesce("_head", F.lit(0))).drop("_head")


def lookup(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Each request with ``found``: exact_replay with the original result, conflict for another body, not_found."""
    held = history.select(*KEY, F.struct(*BODY).alias("_body"), F.col("status").alias("h_status"), F.col("balance").alias("h_balance"), F.col("seq").alias("h_seq"))
    rows = requests.join(held, KEY, "left")
    found = F.when(F.col("_body").isNull(), "not_found").when(F.struct(*BODY).eqNullSafe(F.col("_body")), "exact_replay").otherwise("conflict")
    rows = rows.withColumn("found", found)
    exact = lambda c: F.when(F.col("found") == "exact_replay", F.col(f"h_{c}")).alias(c)
    return rows.select(*requests.columns, "found", exact("status"), exact("balance"), exact("seq"))


def refunded_targets(history: DataFrame) -> DataFrame:
    return history.where("operation = 'refund' and status = 'applied'").select("refund_of.*").distinct()


def lookup_debit(keys: DataFrame, history: DataFrame) -> DataFrame:
    """Amount and ``already_refunded`` of wanted keys that are applied debits; null for others."""
    debits = history.where("operation = 'debit' and status = 'applied'").select(*KEY, "amount")
    used = refunded_targets(history).withColumn("_used", F.lit(True))
    return keys.join(debits, KEY, "left").join(used, KEY, "left").withColumn("already_refunded", F.when(F.col("amount").isNotNull(), F.coalesce("_used", F.lit(False)))).drop("_used")


def progress(history: DataFrame) -> DataFrame:
    """The highest sequence of each shard up to which none is missing; 0 if the first one is.

    With unique sequences, all of 1 to n are there just where the nth one is n, so no global order is needed: a row
    is beyond the first gap if a smaller sequence lacks its successor.
    """
    rows = history.select("shard_id", "seq").distinct()
    after = rows.select("shard_id", (F.col("seq") + 1).alias("seq"))
    heads = rows.select("shard_id").distinct().withColumn("seq", F.lit(1).cast("long"))
    missing = after.unionByName(heads).join(rows, ["shard_id", "seq"], "left_anti")
    return missing.groupBy("shard_id").agg((F.min("seq") - 1).alias("progress"))


def persisted(current: Column, head: Column, wanted: Column) -> Column:
    """The stored progress after asking for ``wanted``: never backwards, never beyond the head (null: refused)."""
    return F.when((wanted > head) | (wanted < current), F.lit(None)).otherwise(wanted)


def binding(identity: Column, bound: Column, progress_: Column) -> Column:
    """What binding a destination comes to: bound, same, or why not."""
    size = F.octet_length(identity)
    bad = identity.isNull() | ~size.between(1, 1024) | identity.rlike(r"[\x00-\x1f\x7f]")
    return F.when(bad, "invalid").when(bound.isNotNull(), F.when(bound == identity, "same").otherwise("already_bound")).when(progress_ > 0, "progress_exists").otherwise("bound")


def verified(shards: DataFrame) -> DataFrame:
    """shard rows (source_progress, destination_progress, bound) with ``outcome`` of checking the destination."""
    outcome = F.when(~F.col("bound") & (F.col("source_progress") > 0), "unbound").when(F.col("destination_progress").isNull(), "missing").when(F.col("destination_progress") < F.col("source_progress"), "behind").otherwise("ok")
    return shards.withColumn("outcome", outcome)
