"""Requests and questions as lines of words: credit, debit, refund, balance."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.schemas import MAX_U64

#: Words of each command, its name included.
WORDS = {"credit": 5, "debit": 5, "refund": 7, "balance": 2, "status": 1, "help": 1, "shutdown": 1}


def parsed(lines: DataFrame, line: str = "value", order: str = "arrival_ord") -> DataFrame:
    """``lines`` (order, line) with command, request fields as decimal(20,0), and ``error`` for what can't be read.

    credit and debit take account, transaction, time in microseconds and amount; refund two more, the debit's
    transaction and time; balance takes an account. Empty lines go.
    """
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    rows = lines.select(order, line, words.alias("w")).where(F.trim(F.regexp_replace(line, r"\s+", " ")) != "")
    name = F.col("w")[0]
    known = F.coalesce(*(F.when((name == k) & (F.size("w") == n), F.lit(True)) for k, n in WORDS.items()), F.lit(False))
    numbers = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    fit = F.forall(numbers, lambda x: x.rlike(r"^\+?\d{1,20}$"))
    number = lambda i: F.try_to_number(F.regexp_replace(F.get(F.col("w"), F.lit(i)), r"^\+", ""), F.lit("9" * 20)).cast("decimal(20,0)")
    rows = rows.withColumn("command", F.when(known, name)).withColumns({f"_{i}": F.when(known & fit & (F.size("w") > i), number(i)) for i in range(1, 7)})
    large = F.coalesce(F.greatest(*(F.col(f"_{i}") for i in range(1, 7))) > F.lit(Decimal(MAX_U64)), F.lit(False))
    error = F.when(~known, "unknown command or wrong argument count").when(~fit | large, "not an unsigned 64-bit number")
    target = F.when(F.col("command") == "refund", F.struct(F.col("_1").alias("account_id"), F.col("_5").alias("tx_id"), F.col("_6").alias("transaction_at")))
    return rows.select(
        order, "command", F.col("_1").alias("account_id"), F.col("_2").alias("tx_id"), F.col("_3").alias("transaction_at"),
        F.when(F.col("command").isin("credit", "debit", "refund"), F.col("command")).alias("operation"), F.col("_4").alias("amount"), target.alias("refund_of"), error.alias("error"),
    )
