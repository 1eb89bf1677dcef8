"""Ledger requests derived from the events table, and window transactions from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.sources.tables import table

#: Retries arrive after all originals: verbatim ones at this distance, changed ones at twice it.
RETRY = 1_000_000_000_000


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event, in order of event_id. An error refunds the account's latest earlier purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cents"))
    amount = F.when(F.col("event_id") % 29 == 0, 0).otherwise(F.col("cents"))
    debit = F.when(F.col("event_type") == "purchase", F.struct(F.col("user_id").alias("account_id"), F.col("event_id").alias("tx_id"), F.col("at").alias("transaction_at"), amount.alias("amount")))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("target", F.last(debit, ignorenulls=True).over(before))
    refund = F.when(F.col("event_id") % 29 == 0, 0).when(F.col("target").isNull(), F.col("cents")).otherwise(F.col("target.amount") + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0))
    is_refund = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("arrival_ord"),
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("tx_id"),
        F.col("at").alias("transaction_at"),
        F.when(F.col("event_type") == "purchase", "debit").when(is_refund, "refund").otherwise("credit").alias("operation"),
        F.when(is_refund, refund).otherwise(amount).cast("long").alias("amount"),
        F.when(is_refund & F.col("target").isNotNull(), F.struct("target.account_id", "target.tx_id", "target.transaction_at")).alias("refund_of"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The originals, then verbatim retries of every 17th and changed retries of every 19th."""
    more = [F.lit(0).cast("long"), F.when(F.col("arrival_ord") % 17 == 0, F.lit(RETRY)), F.when(F.col("arrival_ord") % 19 == 0, F.lit(2 * RETRY))]
    rows = originals(spark, sf_dir).withColumn("_later", F.explode(F.array_compact(F.array(*more))))
    changed = F.col("amount") + F.when(F.col("_later") == 2 * RETRY, 1).otherwise(0)
    return rows.withColumn("arrival_ord", F.col("arrival_ord") + F.col("_later")).withColumn("amount", changed).drop("_later")
