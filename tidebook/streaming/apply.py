"""The ledger as a stream: a stateful operator by account, or micro-batches against committed tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidebook.operators import history as H
from tidebook.operators import ledger as L
from tidebook.operators import watermark as W
from tidebook.schemas import ledger_type
from tidebook.sources.commits import Store

REPLIES = "arrival_ord long, account_id long, tx_id long, transaction_at long, shard_id int, reply_kind string, status string, balance long, replayed boolean, first_ord long"


class AccountLedger(StatefulProcessor):
    """The balance, applied debits and results by key of one account, in the state store. Accounts don't depend on each
    other, so there are as many keys as accounts; sequences, which are a shard's, are given afterwards (``numbered``)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "balance long")
        self.debits = handle.getMapState("debits", "tx_id long, transaction_at long", "amount long, used boolean")
        self.results = handle.getMapState("results", "tx_id long, transaction_at long", "body string, status string, balance long, first_ord long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("arrival_ord")
        account = int(key[0])
        state = L.Account(self.balance.get()[0] if self.balance.exists() else 0, 2**63 - 1)
        out = []
        names = ["arrival_ord", "tx_id", "transaction_at", "shard_id", "operation", "amount", "ra", "rt", "rs"]
        for o, t, s, shard, operation, amount, ra, rt, rs in pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False, name=None):
            k, body = (t, s), f"{operation}|{amount}|{ra}|{rt}|{rs}"
            if self.results.containsKey(k):
                held = self.results.getValue(k)
                same = held[0] == body
                out.append((o, account, t, s, shard, "transaction" if same else "conflict", *(held[1:3] if same else (None, None)), same, held[3] if same else None))
                continue
            target = None if rt is None else {"account_id": int(ra), "tx_id": int(rt), "transaction_at": int(rs)}
            debit = (int(rt), int(rs)) if target and int(ra) == account else None
            if debit and self.debits.containsKey(debit):
                state.debits[debit] = list(self.debits.getValue(debit))
            status = state.apply(account, t, s, operation, amount, target)
            if status == "applied" and operation == "debit":
                self.debits.updateValue(k, (amount, False))
            if status == "applied" and operation == "refund":
                self.debits.updateValue(debit, (amount, True))
            self.results.updateValue(k, (body, status, state.balance, o))
            out.append((o, account, t, s, shard, "transaction", status, state.balance, False, o))
        self.balance.update((state.balance,))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in REPLIES.split(", ")]).astype({"balance": "Int64", "first_ord": "Int64"})

    def close(self) -> None:
        pass


def replies_stream(requests: DataFrame, shards: int = L.SHARDS) -> DataFrame:
    """Replies to a stream of requests (long amounts), without sequences; ``first_ord`` is the order of the request whose
    result it is. Needs the RocksDB state store; rows of a batch are put in order by account, batches must follow each
    other in order."""
    flat = L.routed(requests, shards).select("*", F.col("refund_of.account_id").alias("ra"), F.col("refund_of.tx_id").alias("rt"), F.col("refund_of.transaction_at").alias("rs")).drop("refund_of")
    return flat.groupBy("account_id").transformWithStateInPandas(AccountLedger(), REPLIES, "Append", "None")


def numbered(replies: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Replies of whole batches with ``seq``: the place of each new one among its shard's, after ``starts`` (shard_id,
    latest_seq); a replay has that of its first request, a conflict none."""
    rows = replies.withColumn("kind", F.when(F.col("first_ord") == F.col("arrival_ord"), "new").otherwise("again"))
    placed = L.sequenced(rows, starts)
    firsts = placed.where("kind = 'new'").select(F.col("arrival_ord").alias("first_ord"), F.col("seq").alias("_seq"))
    return placed.drop("seq").join(firsts, "first_ord", "left").withColumnRenamed("_seq", "seq").drop("kind", "first_ord")


def apply_batch(store: Store, batch: DataFrame, batch_id: int, boundary: int | None = None) -> None:
    """One micro-batch against the committed ledger: fresh rows are applied, once, beside the stored rows of their accounts;
    late ones are answered; all is committed at once."""
    schema = ledger_type(T.LongType())
    stored = store.read("ledger", schema)
    replies = None
    if boundary is not None:
        at = W.route(F.col("transaction_at"), F.lit(boundary))
        late = W.late_answers(batch.where(at == "historical"), stored)
        replies = late.select("arrival_ord", "reply_kind", "status", "balance", "seq", F.col("historical_replay").alias("replayed"))
        batch = batch.where(at == "commit")
    heads = stored.groupBy("shard_id").agg(F.max("seq").alias("latest_seq"))
    done = L.applied(batch, L.touched(stored, batch), starts=heads).where("kind <> 'stored'").persist()
    rows = L.replies_of(done).select("arrival_ord", "reply_kind", "status", "balance", "seq", "replayed")
    fresh = L.ledger_of(done).select(*schema.names)
    store.commit(f"batch-{batch_id}", {"ledger": fresh, "replies": rows if replies is None else rows.unionByName(replies)})
    done.unpersist()


def apply_stream(requests: DataFrame, root: str, checkpoint: str, boundary: int | None = None) -> StreamingQuery:
    """Start ``apply_batch`` on every micro-batch of what is there; a batch that is retried is committed once."""
    spark = requests.sparkSession
    return requests.writeStream.foreachBatch(lambda df, n: apply_batch(Store(spark, root), df, n, boundary)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def project_batch(source: Store, destination: Store) -> int:
    """Bring the history up to the ledger: validated, all or nothing, idempotent by sequence. Returns the rows added."""
    schema = ledger_type(T.LongType())
    history, book = destination.read("history", schema), source.read("ledger", schema)
    rows = H.applied_batch(book, history)
    if H.findings(rows, history).take(1):
        raise ValueError("the ledger doesn't continue the history")
    n = rows.count()
    if n:
        destination.commit(f"generation-{source.manifest()['generation']}", {"history": rows})
    return n


def request_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Requests from Parquet files, one file a batch, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
