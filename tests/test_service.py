"""The service end to end: replies, projection, boundary, collection, refunds across it, reopening."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook import service
from tidebook.config import Settings
from tidebook.operators import ledger as L
from tidebook.schemas import requests_type
from tidebook.service import Ledger
from tidebook.sources import commands, files


def rows(spark, *of):
    return spark.createDataFrame(list(of), requests_type(T.LongType()))


def got(df):
    return [(r["reply_kind"], r["status"], r["balance"], r["seq"], r["replayed"], r["historical_replay"]) for r in df.orderBy("arrival_ord").collect()]


def test_life_of_a_ledger(spark, tmp_path):
    def reopened():
        return Ledger(spark, str(tmp_path / "l"), str(tmp_path / "h"), Settings(shards=1, retention=10))

    book = reopened()
    first = rows(spark, (0, 1, 1, 5, "credit", 5, None), (1, 1, 2, 6, "debit", 3, None), (2, 1, 3, 50, "credit", 1, None))
    want = [("transaction", "applied", 5, 1, False, False), ("transaction", "applied", 2, 2, False, False), ("transaction", "applied", 3, 3, False, False)]
    assert got(book.submit(first, "a")) == want and got(book.submit(first, "a")) == want
    assert book.advance(30) == {}  # nothing is projected yet
    assert book.project() == 3 and book.project() == 0
    assert book.advance(30) == {0: 20} and book.advance(25) == {0: 20}
    step = book.collect()[0]
    assert (step["scanned"], step["deleted"], step["blocked_at_seq"], step["prefix"]) == (3, 2, 3, 2)
    book = reopened()
    assert book.ledger().count() == 1 and not book.verify().collect()
    assert [tuple(r) for r in book.balances().collect()] == [(1, 3)]
    late = rows(spark, (0, 1, 2, 6, "debit", 3, None), (1, 1, 2, 6, "debit", 4, None), (2, 1, 9, 7, "credit", 1, None), (3, 1, 4, 60, "refund", 3, (1, 2, 6)), (4, 1, 5, 61, "refund", 3, (1, 2, 6)), (5, 1, 3, 50, "credit", 1, None))
    assert got(book.submit(late, "b")) == [
        ("transaction", "applied", 2, 2, True, True), ("conflict", None, None, None, False, False), ("expired", None, None, None, False, False),
        ("transaction", "applied", 6, 4, False, False), ("transaction", "refund_already_used", 6, 5, False, False), ("transaction", "applied", 3, 3, True, False),
    ]
    asked = spark.createDataFrame([(1,), (77,)], "account_id long")
    assert sorted(tuple(r) for r in book.balances(asked).collect()) == [(1, 6), (77, 0)]
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path / "l"), str(tmp_path / "h"), Settings(shards=2))


def test_an_earlier_identity_gives_its_first_replies(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), str(tmp_path / "h"), Settings(shards=2, retention=10, projection_batch=2))
    one = rows(spark, *((i, i % 4, i, 5, "credit", 1, None) for i in range(12)))
    two = rows(spark, *((i, i % 4, 100 + i, 50, "debit", 1, None) for i in range(8)))
    first = got(book.submit(one, "one"))
    second = got(book.submit(two, "two"))
    assert len(first) == 12 and len(second) == 8 and not any(x[4] for x in first + second)
    assert got(book.submit(one, "one")) == first
    assert book.project() == 20 and book.advance(20) == {0: 10, 1: 10} and sum(x["deleted"] for x in book.collect()) == 12
    assert got(book.submit(one, "one")) == first and got(book.submit(two, "two")) == second
    assert book.status().agg(F.sum("latest_seq")).first()[0] == 20 and not book.verify().collect()
    plan = L.applied(one, L.touched(book.known(), one), 2, starts=spark.createDataFrame([(0, 0)], "shard_id int, latest_seq long"))
    assert "LeftSemi" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_checkpoints_bound_collection(spark, tmp_path):
    def opened():
        return Ledger(spark, str(tmp_path / "l"), str(tmp_path / "h"), Settings(shards=1, retention=10, checkpoint=2))

    book = opened()
    book.submit(rows(spark, (0, 0, 1, 10, "credit", 2, None)), "a")
    assert book.project() == 1 and book.advance(110) == {0: 100}
    assert sum(x["deleted"] for x in book.collect()) == 0  # no checkpoint covers the row
    book.submit(rows(spark, (0, 0, 2, 200, "credit", 3, None)), "b")
    assert [x["deleted"] for x in book.collect()] == [1]
    again = opened()
    assert [tuple(r) for r in again.balances().collect()] == [(0, 5)] and again.ledger().count() == 1
    again.submit(rows(spark, (0, 7, 1, 300, "credit", 4, None)), "c")
    assert [tuple(r) for r in again.balances().collect()] == [(0, 5), (7, 4)]


def test_a_missing_or_lagging_history_is_refused(spark, tmp_path):
    at = str(tmp_path / "l"), str(tmp_path / "h"), Settings(shards=1, retention=10)
    book = Ledger(spark, *at)
    book.submit(rows(spark, (0, 0, 1, 10, "credit", 2, None), (1, 0, 2, 11, "credit", 2, None)), "a")
    book.project()
    Ledger(spark, *at)
    (tmp_path / "h").rename(tmp_path / "gone")
    with pytest.raises(ValueError, match="missing"):
        Ledger(spark, *at)
    behind = Ledger(spark, str(tmp_path / "l2"), str(tmp_path / "h2"), at[2])
    behind.submit(rows(spark, (0, 0, 1, 10, "credit", 2, None)), "a")
    behind.project()
    (tmp_path / "h2").rename(tmp_path / "h")
    with pytest.raises(ValueError, match="behind"):
        Ledger(spark, *at)


def test_projection_tries_again_and_stops(spark, tmp_path, monkeypatch):
    book = Ledger(spark, str(tmp_path / "l"), str(tmp_path / "h"), Settings(shards=1))
    book.submit(rows(spark, (0, 0, 1, 10, "credit", 2, None)), "a")
    waits, calls, commit = [], [], book.history.commit
    monkeypatch.setattr(service, "sleep", waits.append)

    def failing(*a, **k):
        calls.append(1)
        if len(calls) <= fails:
            raise RuntimeError("away")
        return commit(*a, **k)

    monkeypatch.setattr(book.history, "commit", failing)
    fails = 5
    with pytest.raises(RuntimeError):
        book.project()
    assert waits == [0.1, 0.2, 0.4, 0.8] and len(calls) == 5
    fails = 7
    assert book.project() == 1 and len(calls) == 8


def test_ranges_and_lookups_are_checked(spark):
    book = spark.createDataFrame([(0, s) for s in (1, 2, 4)], "shard_id int, seq long")
    assert [r["intact"] for r in L.ledger_range(book, 0, 1, 9).collect()] == [True, True, False]
    assert L.ledger_range(book, 0, 9, 9, strict=True).collect() == [] and len(L.ledger_range(book, 0, 1, 2, strict=True).collect()) == 2
    with pytest.raises(Exception, match="lacks sequence 3"):
        L.ledger_range(book, 0, 1, 9, strict=True).collect()
    asked = spark.createDataFrame([(0,), (2,), (2,), (7,)], "position long")
    assert sorted(tuple(r) for r in L.position_findings(asked, 4).collect()) == [(1, "omitted"), (2, "repeated"), (3, "omitted"), (7, "outside")]


def test_settings():
    assert [Settings(shards=3, queue=50_000).queue_of(i) for i in range(3)] == [16_667, 16_667, 16_666]
    for bad in ({"shards": 65}, {"batch": 0}, {"queue": 1, "shards": 2}, {"lookups_in_flight": 9}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_commands(spark):
    lines = ["credit 1 2 3 4", "  refund 1 9 9 4   2 3 ", "", "debit 1 2 3", "balance 18446744073709551615", "balance 18446744073709551616", "credit a 2 3 4", "status", "fly"]
    found = commands.parsed(spark.createDataFrame(list(enumerate(lines)), "arrival_ord long, value string")).orderBy("arrival_ord").collect()
    assert [(r["command"], r["error"] is None) for r in found] == [("credit", True), ("refund", True), (None, False), ("balance", True), ("balance", False), ("credit", False), ("status", True), (None, False)]
    assert int(found[0]["amount"]) == 4 and int(found[1]["refund_of"]["tx_id"]) == 2 and int(found[3]["account_id"]) == 2**64 - 1


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b,c")], "x long, y string")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_json_lines(df, str(tmp_path / "j"))
    (tmp_path / "t.gz").write_bytes(gzip.compress(b"up 1\nup 2\n"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(map(tuple, files.read_json_lines(spark, str(tmp_path / "j"), df.schema).collect())) == [(1, "a"), (2, "b,c")]
    assert files.read_text(spark, str(tmp_path / "t.gz")).agg(F.count("*")).first()[0] == 2
