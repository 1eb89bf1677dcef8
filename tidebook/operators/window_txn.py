"""Set-based window transactions: classify a window against accounts and a ledger, chain balances, verify and reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN, INVALID = "rejected:unknown_account", "rejected:invalid_amount"


def scanned(arrays: DataFrame) -> DataFrame:
    """Rows (ord, account_id, transaction_id, amount) of three parallel arrays of one row."""
    zipped = arrays.select(F.posexplode(F.arrays_zip("account_ids", "transaction_ids", "amounts")).alias("pos", "x"))
    return zipped.select((F.col("pos") + 1).cast("long").alias("ord"), F.col("x.account_ids").alias("account_id"), F.col("x.transaction_ids").alias("transaction_id"), F.col("x.amounts").alias("amount"))


def outcomes(window: DataFrame, accounts: DataFrame, book: DataFrame) -> DataFrame:
    """ord, status, account_id, transaction_id, amount, before_balance, after_balance of each input row.

    An existing transaction comes first and shows what the ledger holds, then an amount of 0 or less is rejected, then
    an unknown account; the rest is applied in input order from the account's balance. Amounts are credits, so a running
    sum chains them. Keys of a window are unique; ``repeated_keys`` finds those that aren't.
    """
    held = book.select("account_id", "transaction_id", F.col("amount").alias("held_amount"), "before_balance", "after_balance")
    known = accounts.select("account_id", "balance")
    rows = window.join(held, ["account_id", "transaction_id"], "left").join(known, "account_id", "left")
    status = F.when(F.col("held_amount").isNotNull(), "existing").when(F.col("amount") <= 0, INVALID).when(F.col("balance").isNull(), UNKNOWN).otherwise("applied")
    rows = rows.withColumn("status", status)
    applied = F.when(F.col("status") == "applied", F.col("amount")).otherwise(0)
    after = F.col("balance") + F.sum(applied).over(Window.partitionBy("account_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_after", after)
    of = lambda held, own: F.when(F.col("status") == "existing", F.col(held)).when(F.col("status") == "applied", own)
    return rows.select(
        "ord", "status", "account_id", "transaction_id", F.coalesce(F.when(F.col("status") == "existing", F.col("held_amount")), "amount").alias("amount"), of("before_balance", F.col("_after") - F.col("amount")).alias("before_balance"), of("after_balance", F.col("_after")).alias("after_balance")
    )


def repeated_keys(window: DataFrame) -> DataFrame:
    """Keys that a window holds more than once: such a window fails as a whole."""
    return window.groupBy("account_id", "transaction_id").agg(F.count("*").alias("n")).where("n > 1")


def new_rows(found: DataFrame) -> DataFrame:
    return found.where("status = 'applied'").select("account_id", "transaction_id", "amount", "before_balance", "after_balance")


def posted(accounts: DataFrame, found: DataFrame) -> DataFrame:
    """Accounts after a window: (account_id, start_balance, balance, delta)."""
    delta = found.where("status = 'applied'").groupBy("account_id").agg(F.sum("amount").alias("delta"))
    return accounts.join(delta, "account_id", "left").select("account_id", F.col("balance").alias("start_balance"), (F.col("balance") + F.coalesce("delta", F.lit(0))).alias("balance"), F.coalesce("delta", F.lit(0)).alias("delta"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """With ``canonical_ord``: the first row of the key, whose outcome all rows of the key share."""
    return rows.withColumn("canonical_ord", F.min("ord").over(Window.partitionBy("account_id", "transaction_id")))


def chain(book: DataFrame) -> DataFrame:
    """Per account: rows, start, end, sum and whether each row starts where the one before ended."""
    w = Window.partitionBy("account_id").orderBy("before_balance", "transaction_id")
    rows = book.withColumn("rn", F.row_number().over(w)).withColumn("prev", F.lag("after_balance").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("account_id")))
    linked = F.coalesce(F.col("prev") == F.col("before_balance"), F.lit(True)) & (F.col("after_balance") == F.col("before_balance") + F.col("amount"))
    return rows.groupBy("account_id").agg(
        F.count("*").alias("rows"), F.min(F.when(F.col("rn") == 1, F.col("before_balance"))).alias("start"), F.max(F.when(F.col("rn") == F.col("n"), F.col("after_balance"))).alias("end"), F.sum("amount").alias("amount"), F.bool_and(linked).alias("linked")
    )


def verified(accounts: DataFrame, book: DataFrame) -> DataFrame:
    """One row over all ``accounts`` (account_id, opening, balance, expected: how many rows) and their rows of ``book``:
    accounts, bad ones, the sum of balances and the number of rows. An account is bad if its balance, count, first or
    last link differ, if a row's amount doesn't make its balances, or if a row doesn't start where the one before ended."""
    c = F.col
    per = accounts.join(chain(book), "account_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    differs = (c("rows") != c("expected")) | (c("start") != c("opening")) | (c("end") != c("balance"))
    bad = F.coalesce(differs, F.lit(False)) | ~F.coalesce("linked", F.lit(False))
    return per.agg(F.count("*").alias("accounts"), F.count_if(bad).alias("bad"), F.coalesce(F.sum("balance"), F.lit(0)).alias("balance"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def share(column: str) -> Column:
    """Part of the whole column's sum, for a handful of rows."""
    return F.col(column) / F.sum(column).over(Window.partitionBy())
