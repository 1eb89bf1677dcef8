"""Golden and differential cases of the ledger core."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators import ledger as L
from tidebook.schemas import MAX_U64, requests_type
from tidebook.streaming.apply import numbered, replies_stream, request_stream


def requests(spark, rows):
    """rows: (account, tx, at, operation, amount, target tx or None, target account, target time); order is arrival."""
    schema = requests_type(T.LongType())
    out = []
    for i, (a, tx, at, op, amount, *target) in enumerate(rows):
        t = target[0] if target else None
        out.append((i, a, tx, at, op, None, t and (t[0], t[1], t[2])))
    df = spark.createDataFrame(out, schema)
    amounts = spark.createDataFrame([(i, str(r[4])) for i, r in enumerate(rows)], "arrival_ord long, big string")
    u64 = "decimal(20,0)"
    key = lambda c: F.col(c).cast(u64).alias(c)
    target = F.when(F.col("refund_of").isNotNull(), F.struct(*(F.col(f"refund_of.{c}").cast(u64).alias(c) for c in L.KEY)))
    return df.drop("amount").join(amounts, "arrival_ord").select("arrival_ord", *(key(c) for c in L.KEY), "operation", F.col("big").cast(u64).alias("amount"), target.alias("refund_of"))


def outcome(df):
    return [(r["reply_kind"], r["status"], None if r["balance"] is None else int(r["balance"]), r["seq"], r["replayed"]) for r in df.orderBy("arrival_ord").collect()]


def test_dedup_replay_and_conflict(spark):
    got = outcome(L.replies(requests(spark, [(0, 77, 700, "credit", 3), (0, 77, 700, "credit", 3), (0, 77, 700, "credit", 4), (0, 77, 701, "credit", 4)]), shards=1))
    assert got == [("transaction", "applied", 3, 1, False), ("transaction", "applied", 3, 1, True), ("conflict", None, None, None, False), ("transaction", "applied", 7, 2, False)]


def test_refund_once(spark):
    rows = [(0, 1, 1, "credit", 10), (0, 2, 2, "debit", 4), (0, 3, 3, "refund", 4, (0, 2, 2)), (0, 4, 4, "refund", 4, (0, 2, 2))]
    got = outcome(L.replies(requests(spark, rows), shards=1))
    assert [x[1:4] for x in got] == [("applied", 10, 1), ("applied", 6, 2), ("applied", 10, 3), ("refund_already_used", 10, 4)]


def test_rejections_take_sequences_and_full_range(spark):
    rows = [
        (0, 1, 1, "debit", 1), (0, 2, 2, "credit", MAX_U64), (0, 3, 3, "credit", 1), (0, 4, 4, "refund", 1), (0, 5, 5, "refund", 1, (1, 7, 7)),
        (0, 6, 6, "credit", 0), (1, 7, 7, "credit", 1), (1, 8, 8, "refund", 1, (1, 7, 7)),
    ]
    got = outcome(L.replies(requests(spark, rows), shards=1))
    assert [x[1] for x in got] == ["insufficient_funds", "applied", "credit_overflow", "invalid_refund", "invalid_refund", "invalid_amount", "applied", "invalid_refund"]
    assert [x[3] for x in got] == list(range(1, 9))
    assert [int(r["balance"]) for r in L.balances(L.ledger(requests(spark, rows), shards=1)).orderBy("account_id").collect()] == [MAX_U64, 1]


def test_rejected_accounts_have_balance_zero_and_unknown_reads(spark):
    book = L.ledger(requests(spark, [(9001, 1, 1, "debit", 5), (9002, 2, 2, "credit", 0), (9003, 3, 3, "refund", 4)]), shards=1)
    known = L.balances(book)
    assert sorted((int(r["account_id"]), int(r["balance"])) for r in known.collect()) == [(9001, 0), (9002, 0), (9003, 0)]
    wanted = spark.createDataFrame([(4444,)], "account_id long").select(F.col("account_id").cast("decimal(20,0)").alias("account_id"))
    assert int(L.balance_of(known, wanted).first()["balance"]) == 0


def test_later_batch_gives_historical_balances(spark):
    seed = L.ledger(requests(spark, [(0, 1, 1, "credit", 100), (0, 2, 2, "debit", 3)]), shards=1)
    body = [(0, 3, 3, "credit", 2)] + [(1, 10 + i, 9, "credit", 1) for i in range(255)] + [(0, 3, 3, "credit", 2), (0, 3, 3, "credit", 3), (0, 2, 2, "debit", 3), (0, 2, 2, "debit", 4), (0, 4, 4, "debit", 5)]
    got = outcome(L.replies(requests(spark, body), seed, shards=1))
    assert got[0] == ("transaction", "applied", 99, 3, False) and got[255] == ("transaction", "applied", 255, 258, False)
    assert got[256] == ("transaction", "applied", 99, 3, True) and got[257][0] == "conflict"
    assert got[258] == ("transaction", "applied", 97, 2, True) and got[259][0] == "conflict" and got[260] == ("transaction", "applied", 94, 259, False)
    after = seed.unionByName(L.ledger(requests(spark, body), seed, shards=1))
    last = outcome(L.replies(requests(spark, [(0, 20, 5, "refund", 3, (0, 2, 2)), (0, 21, 6, "refund", 3, (0, 2, 2)), (0, 3, 3, "credit", 2)]), after, shards=1))
    assert [x[1:5] for x in last] == [("applied", 97, 260, False), ("refund_already_used", 97, 261, False), ("applied", 99, 3, True)]


def model(rows, shards):
    """The same in plain Python, for random input."""
    seen, seqs, accounts, out = {}, {}, {}, []
    for a, tx, at, op, amount, *target in rows:
        key, body = (a, tx, at), (op, amount, tuple(target))
        if key in seen:
            out.append(("transaction", *seen[key][1], True) if seen[key][0] == body else ("conflict", None, None, None, False))
            continue
        state = accounts.setdefault(a, [0, {}])
        status, t = "applied", target[0] if target else None
        if not amount:
            status = "invalid_amount"
        elif op == "credit":
            state[0] += amount
        elif op == "debit":
            if state[0] >= amount:
                state[0] -= amount
                state[1][tx, at] = [amount, False]
            else:
                status = "insufficient_funds"
        else:
            held = state[1].get((t[1], t[2])) if t and t[0] == a else None
            if not held or held[0] != amount:
                status = "invalid_refund"
            elif held[1]:
                status = "refund_already_used"
            else:
                held[1] = True
                state[0] += amount
        seqs[a % shards] = seqs.get(a % shards, 0) + 1
        seen[key] = (body, (status, state[0], seqs[a % shards]))
        out.append(("transaction", status, state[0], seqs[a % shards], False))
    return out


def random_rows(seed, n=400):
    r, rows = random.Random(seed), []
    for i in range(n):
        if rows and r.random() < 0.15:
            a, tx, at, op, amount, *t = r.choice(rows)
            rows.append((a, tx, at, op, amount + (r.random() < 0.3), *t))
            continue
        a, op = r.randrange(6), r.choice(["credit", "debit", "refund"])
        debits = [x for x in rows if x[3] == "debit"]
        if op == "refund" and debits:
            d = r.choice(debits)
            rows.append((r.choice([a, d[0]]), 1000 + i, i, op, d[4], d[:3]))
        else:
            rows.append((a, 1000 + i, i, op, r.randrange(0, 9)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_requests_against_model(spark, seed):
    rows = random_rows(seed)
    assert outcome(L.replies(requests(spark, rows), shards=3)) == model(rows, 3)


def test_stream_gives_the_same_replies(spark, tmp_path):
    rows = random_rows(3, 200)
    long = requests(spark, rows).select("arrival_ord", *(F.col(c).cast("long").alias(c) for c in L.KEY), "operation", F.col("amount").cast("long").alias("amount"), F.col("refund_of").cast("struct<account_id:long,tx_id:long,transaction_at:long>").alias("refund_of"))
    for a in (0, 100):
        long.where((F.col("arrival_ord") >= a) & (F.col("arrival_ord") < a + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = replies_stream(request_stream(spark, str(tmp_path / "in"), long.schema), 3)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert outcome(numbered(spark.read.schema(out.schema).parquet(str(tmp_path / "out")))) == model(rows, 3)


def test_range_reads_and_bounds(spark):
    book = L.ledger(requests(spark, [(0, i, i, "credit", 1) for i in range(1, 9)]), shards=1)
    assert [r["seq"] for r in L.ledger_range(book, 0, 3, 4).collect()] == [3, 4, 5, 6]
    assert not L.ledger_range(book, 0, 30, 4).collect()
    assert not all(r["intact"] for r in L.ledger_range(book.where("seq <> 4"), 0, 3, 4).collect())
    with pytest.raises(ValueError):
        L.ledger_range(book, 0, 0, 1)
    with pytest.raises(ValueError):
        L.multi_get(book, book, 4096)


def test_empty_requests(spark):
    assert L.replies(requests(spark, [(0, 1, 1, "credit", 1)]).limit(0)).count() == 0


def test_micro_batches_by_size_time_and_close(spark):
    rows = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 50), (0, 5, 60), (1, 1, 0)], "k long, o long, t long")
    got = sorted(map(tuple, L.micro_batches(rows, "k", "o", "t", 2, 10).collect()))
    assert got == [(0, 1, 1, 2, "size"), (0, 2, 3, 1, "timeout"), (0, 3, 4, 1, "timeout"), (0, 4, 5, 1, "close"), (1, 1, 1, 1, "close")]
