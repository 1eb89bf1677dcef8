"""Ordered, idempotent application of requests to account balances.

Requests need a total order, ``arrival_ord``. What a request does depends only on earlier requests of its account, so
one shuffle by account suffices for everything but the sequence: windows over a key find first arrivals, replays and
conflicts, and one pass over each partition in (account, order) evaluates statuses. That pass holds one account's
balance and applied debits, not its rows. Sequences are prefix sums per shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.ordering import running_sum
from tidebook.schemas import ALREADY_USED, APPLIED, INSUFFICIENT, INVALID_AMOUNT, INVALID_REFUND, MAX_U64, OVERFLOW

KEY = ["account_id", "tx_id", "transaction_at"]
SHARDS = 4


def routed(requests: DataFrame, shards: int = SHARDS) -> DataFrame:
    """With ``shard_id``: the account modulo the number of shards."""
    return requests.withColumn("shard_id", F.pmod("account_id", F.lit(shards)).cast("int"))


def classified(requests: DataFrame) -> DataFrame:
    """With ``first_ord``, ``kind`` (new for the first arrival of a key, replay for the same body again, else conflict) and
    ``repeated`` (the key comes more than once). No shuffle where rows are already dealt by account."""
    body = F.struct("operation", "amount", "refund_of")
    key = Window.partitionBy(*KEY)
    arrivals = key.orderBy("arrival_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = requests.withColumn("first_ord", F.first("arrival_ord").over(arrivals)).withColumn("_body", F.first(body).over(arrivals)).withColumn("repeated", F.count("*").over(key) > 1)
    kind = F.when(F.col("first_ord") == F.col("arrival_ord"), "new").when(body.eqNullSafe(F.col("_body")), "replay").otherwise("conflict")
    return rows.withColumn("kind", kind).drop("_body")


class Account:
    """State of one account: its balance, and its applied debits with whether each was refunded."""

    __slots__ = ("balance", "debits", "limit")

    def __init__(self, zero: object, limit: object):
        self.balance, self.limit, self.debits = zero, limit, {}

    def apply(self, account: object, tx: object, at: object, operation: str, amount: object, target: dict | None) -> str:
        """The status of one new request; rejections leave the balance."""
        if not amount:
            return INVALID_AMOUNT
        if operation == "debit":
            if self.balance < amount:
                return INSUFFICIENT
            self.balance -= amount
            self.debits[tx, at] = [amount, False]
            return APPLIED
        if operation == "refund":
            found = self.debits.get((target["tx_id"], target["transaction_at"])) if target and target["account_id"] == account else None
            if found is None or found[0] != amount:
                return INVALID_REFUND
            if found[1]:
                return ALREADY_USED
            if self.balance + amount > self.limit:
                return OVERFLOW
            found[1] = True
            self.balance += amount
            return APPLIED
        if self.balance + amount > self.limit:
            return OVERFLOW
        self.balance += amount
        return APPLIED

    def restore(self, tx: object, at: object, operation: str, amount: object, target: dict | None, status: str, balance: object) -> None:
        """Take over a request that was stored with its result."""
        self.balance = balance
        if status == APPLIED and operation == "debit":
            self.debits[tx, at] = [amount, False]
        if status == APPLIED and operation == "refund" and target and (found := self.debits.get((target["tx_id"], target["transaction_at"]))):
            found[1] = True


def evaluated(rows: DataFrame, limit: int = MAX_U64) -> DataFrame:
    """With ``status`` and ``balance`` of new rows; stored rows keep theirs, replays take those (and seq) of the first
    arrival, conflicts have none.

    ``rows`` (classified requests; for stored ones status, balance and seq) are brought together by account. Beside an
    account's state a task holds the results of those of its keys that come again.
    """
    number = rows.schema["amount"].dataType
    most = min(limit, 2**63 - 1) if isinstance(number, T.LongType) else Decimal(limit)
    zero = 0 if isinstance(number, T.LongType) else Decimal(0)
    given = rows if "status" in rows.columns else rows.withColumn("status", F.lit(None).cast("string")).withColumn("balance", F.lit(None).cast(number))
    numbered = "seq" in given.columns
    given = given if numbered else given.withColumn("seq", F.lit(None).cast("long"))
    given = given.select(*(c for c in given.columns if c not in ("status", "balance", "seq")), "status", "balance", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, results = object(), None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("account_id", "tx_id", "transaction_at", "operation", "amount", "refund_of", "kind", "repeated", "status", "balance", "seq")]
            statuses, balances, seqs = columns[8:]
            for i, (account, tx, at, operation, amount, target, kind, repeated, status, balance, seq) in enumerate(zip(*columns, strict=True)):
                if account != current:
                    current, state, results = account, Account(zero, most), {}
                if kind == "new":
                    status = statuses[i] = state.apply(account, tx, at, operation, amount, target)
                    balance = balances[i] = state.balance
                elif kind == "stored":
                    state.restore(tx, at, operation, amount, target, status, balance)
                elif kind == "replay":
                    statuses[i], balances[i], seqs[i] = results[tx, at]
                if repeated and kind in ("new", "stored"):
                    results[tx, at] = (status, balance, seq)
            filled = [pa.array(x, batch.schema.field(c).type) for c, x in (("status", statuses), ("balance", balances), ("seq", seqs))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *filled], schema=batch.schema)

    out = given.repartition("account_id").sortWithinPartitions("account_id", "arrival_ord").mapInArrow(run, given.schema)
    return out if numbered else out.drop("seq")


def sequenced(rows: DataFrame, starts: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """With ``seq``: the place of each row of kind new among those of its shard, rejections included; none for others.

    ``starts`` (shard_id, latest_seq), a row a shard, is where stored sequences end; ``dense`` says that orders lie close.
    """
    rows = running_sum(rows, ["shard_id"], "arrival_ord", F.when(F.col("kind") == "new", 1).otherwise(0), "seq", dense=dense)
    if starts is not None:
        rows = rows.join(F.broadcast(starts.select("shard_id", "latest_seq")), "shard_id", "left").withColumn("seq", F.col("seq") + F.coalesce("latest_seq", F.lit(0))).drop("latest_seq")
    return rows.withColumn("seq", F.when(F.col("kind") == "new", F.col("seq")))


def applied(requests: DataFrame, stored: DataFrame | None = None, shards: int = SHARDS, limit: int = MAX_U64, starts: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """All requests with kind, status, balance and seq; new rows are the ledger's next ones.

    ``stored`` is the ledger so far, whose rows come before: it gives balances, applied debits, used refunds, keys and
    the last sequence of each shard. With ``starts`` (shard_id, latest_seq) it may hold the accounts of the requests alone.
    """
    rows = requests
    if stored is not None:
        past = stored.select(*requests.columns, "status", "balance", "seq", F.lit(True).alias("_stored")).withColumn("arrival_ord", F.col("seq") - F.lit(2**62))
        rows = requests.withColumns({"status": F.lit(None).cast("string"), "balance": F.lit(None).cast(requests.schema["amount"].dataType), "seq": F.lit(None).cast("long"), "_stored": F.lit(False)}).unionByName(past)
    rows = routed(classified(rows.repartition("account_id")), shards)
    if stored is None:
        return evaluated(sequenced(rows, dense=dense), limit)
    rows = rows.withColumn("kind", F.when(F.col("_stored"), "stored").otherwise(F.col("kind"))).drop("_stored").withColumnRenamed("seq", "_seq")
    if starts is None:
        starts = routed(stored, shards).groupBy("shard_id").agg(F.max("seq").alias("latest_seq"))
    return evaluated(sequenced(rows, starts, dense).withColumn("seq", F.coalesce("seq", "_seq")).drop("_seq"), limit)


def replies(requests: DataFrame, stored: DataFrame | None = None, shards: int = SHARDS, limit: int = MAX_U64, dense: bool = False) -> DataFrame:
    """One reply per request: reply_kind, status, balance, seq, replayed, shard_id. A replay repeats the first result."""
    return replies_of(applied(requests, stored, shards, limit, dense=dense))


def replies_of(rows: DataFrame) -> DataFrame:
    """The replies in applied rows."""
    out = rows.where("kind <> 'stored'")
    shown = lambda c: F.when(F.col("kind") != "conflict", F.col(c)).alias(c)
    return out.select("arrival_ord", *KEY, "shard_id", F.when(F.col("kind") == "conflict", "conflict").otherwise("transaction").alias("reply_kind"), shown("status"), shown("balance"), shown("seq"), (F.col("kind") == "replay").alias("replayed"))


def ledger(requests: DataFrame, stored: DataFrame | None = None, shards: int = SHARDS, limit: int = MAX_U64, dense: bool = False) -> DataFrame:
    """The new rows: requests with shard_id, seq, status and balance."""
    return ledger_of(applied(requests, stored, shards, limit, dense=dense))


def ledger_of(rows: DataFrame) -> DataFrame:
    """The ledger's next rows in applied rows."""
    return rows.where("kind = 'new'").drop("kind", "first_ord", "repeated")


def touched(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """The stored rows of the requests' accounts, which are all that decide about them."""
    return stored.join(requests.select("account_id").distinct(), "account_id", "left_semi").select(*stored.columns)


def balances(book: DataFrame, order: str = "seq") -> DataFrame:
    """Last balance of each account that the ledger touches, rejected first requests included. Any order of an account's
    rows will do, sequence or arrival."""
    return book.groupBy("shard_id", "account_id").agg(F.max_by("balance", order).alias("balance"))


def balances_after(requests: DataFrame, shards: int = SHARDS, limit: int = MAX_U64) -> DataFrame:
    """Balances that requests lead to, without sequences: one shuffle less than by way of the ledger."""
    rows = evaluated(routed(classified(requests.repartition("account_id")), shards), limit)
    return balances(rows.where("kind = 'new'"), "arrival_ord")


def balance_of(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Balances of the wanted accounts, 0 for unknown ones; nothing is created."""
    return wanted.select("account_id").join(known.select("account_id", "balance"), "account_id", "left").select("account_id", F.coalesce("balance", F.lit(0)).alias("balance"))


def ledger_range(book: DataFrame, shard: int, first_seq: int, most: int, strict: bool = False) -> DataFrame:
    """Rows [first_seq, first_seq + most) of a shard in order, with ``expected_seq``; ``intact`` is false after a gap, and
    an error with ``strict``. Beyond the head there are no rows."""
    if first_seq < 1:
        raise ValueError("sequences start at 1")
    rows = book.where((F.col("shard_id") == shard) & F.col("seq").between(first_seq, first_seq + most - 1)).orderBy("seq").limit(most)
    place = F.row_number().over(Window.partitionBy("shard_id").orderBy("seq"))
    rows = rows.withColumn("expected_seq", place + F.lit(first_seq - 1)).withColumn("intact", F.col("seq") == F.col("expected_seq"))
    if strict:
        problem = F.raise_error(F.concat(F.lit("the ledger lacks sequence "), F.col("expected_seq").cast("string")))
        rows = rows.withColumn("seq", F.when(F.col("intact"), F.col("seq")).otherwise(problem.cast("long")))
    return rows


def index_get(book: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored results of wanted keys (position and key), in the positions asked for; null where nothing is stored."""
    found = book.select(*KEY, "seq", "status", "balance")
    return wanted.select("position", *KEY).join(found, KEY, "left")


def multi_get(book: DataFrame, wanted: DataFrame, chunk: int, in_flight: int = 1) -> DataFrame:
    """As ``index_get``, with the chunk that each position falls in and the slot of the chunk among those in flight.

    Chunks of 1 to 2,048 keys and 1 to 8 in flight; one join answers them all, since chunks don't change results.
    """
    if not 1 <= chunk <= 2048 or not 1 <= in_flight <= 8:
        raise ValueError("chunks hold 1 to 2048 keys, 1 to 8 in flight")
    part = F.floor(F.col("position") / chunk).cast("long")
    return index_get(book, wanted).withColumn("chunk", part).withColumn("slot", F.pmod(part, F.lit(in_flight)).cast("int"))


def position_findings(positions: DataFrame, n: int) -> DataFrame:
    """position, finding of the answers to ``n`` lookups: outside of 0 to n - 1, repeated, or omitted. Empty if all is well."""
    counts = positions.groupBy("position").agg(F.count("*").alias("c"))
    outside = counts.where(~F.col("position").between(0, n - 1) | F.col("position").isNull()).select("position", F.lit("outside").alias("finding"))
    repeated = counts.where("c > 1").select("position", F.lit("repeated").alias("finding"))
    omitted = positions.sparkSession.range(n).select(F.col("id").alias("position")).join(counts, "position", "left_anti").select("position", F.lit("omitted").alias("finding"))
    return outside.unionByName(repeated).unionByName(omitted)


def wallet(requests: DataFrame) -> DataFrame:
    """Credit and debit only: new rows with status, balance, version and write_clock (places among the account's new rows)."""
    rows = evaluated(classified(requests.where("operation <> 'refund'").repartition("account_id"))).where("kind = 'new'")
    place = F.row_number().over(Window.partitionBy("account_id").orderBy("arrival_ord")).cast("long")
    return rows.withColumn("version", place).withColumn("write_clock", place)


def micro_batches(rows: DataFrame, key: str, order: str, clock: str, size: int, wait: int) -> DataFrame:
    """Batches (key, batch_no, first_ord, rows, reason) of each key's rows in order.

    A batch ends with ``size`` rows (size), before the first row whose ``clock`` is ``wait`` or more after the batch's
    first row (timeout), or with the last row (close). Rows are folded in order with one batch held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, no, first, began, n = None, 0, None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for k, o, t in zip(*(batch.column(c).to_pylist() for c in (key, order, clock)), strict=True):
                if n and k != current:
                    out.append((current, no, first, n, "close"))
                elif n and t - began >= wait:
                    out.append((current, no, first, n, "timeout"))
                if not n or k != current or t - began >= wait:
                    no, first, began, n = no + 1 if k == current else 1, o, t, 0
                    current = k
                n += 1
                if n == size:
                    out.append((current, no, first, n, "size"))
                    n = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["k", "batch_no", "first_ord", "rows", "reason"])
                out = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((current, no, first, n, "close"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["k", "batch_no", "first_ord", "rows", "reason"])

    sorted_ = rows.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(clock).cast("long").alias(clock)).repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInArrow(run, "k long, batch_no long, first_ord long, rows long, reason string").withColumnRenamed("k", key)
