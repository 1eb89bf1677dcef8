"""Explicit schemas. Amounts, ids and times are decimal(20,0) for the full unsigned 64-bit range, or long where they fit."""

from __future__ import annotations

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)
MAX_U64 = 2**64 - 1
APPLIED, INVALID_AMOUNT, INSUFFICIENT, OVERFLOW, INVALID_REFUND, ALREADY_USED = "applied", "invalid_amount", "insufficient_funds", "credit_overflow", "invalid_refund", "refund_already_used"
#: Codes of operations and statuses at a binary edge.
OPERATION_CODES = {"credit": 0, "debit": 1, "refund": 2}
STATUS_CODES = {APPLIED: 0, INSUFFICIENT: 1, OVERFLOW: 2, INVALID_AMOUNT: 3, INVALID_REFUND: 4, ALREADY_USED: 5}
#: Bounds of a service's settings.
MAX_SHARDS, MAX_BATCH, CHUNK_ACCOUNTS = 64, 2048, 1024


def key_type(number: T.DataType = U64) -> T.StructType:
    return T.StructType([T.StructField(c, number) for c in ("account_id", "tx_id", "transaction_at")])


def requests_type(number: T.DataType = U64) -> T.StructType:
    return T.StructType([T.StructField("arrival_ord", T.LongType()), *key_type(number).fields, T.StructField("operation", T.StringType()), T.StructField("amount", number), T.StructField("refund_of", key_type(number))])


def ledger_type(number: T.DataType = U64) -> T.StructType:
    return T.StructType([T.StructField("shard_id", T.IntegerType()), T.StructField("seq", T.LongType()), *requests_type(number).fields, T.StructField("status", T.StringType()), T.StructField("balance", number)])
