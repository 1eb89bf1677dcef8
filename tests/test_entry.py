"""The driver's contract."""

import __spark_entry__ as e


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    ids = {n.split("_")[0] for n in e.queries()}
    for letter, last in (("l", 18), ("h", 9), ("v", 13), ("q", 27), ("m", 13), ("a", 29)):
        assert {f"{letter}{i:02d}" for i in range(1, last + 1)} <= ids
    assert {f"w{i:02d}" for i in range(1, 12)} <= ids


def test_flagship_query(spark):
    df = e.entry(spark)
    assert df.columns == ["arrival_ord", "account_id", "tx_id", "transaction_at", "shard_id", "reply_kind", "status", "balance", "seq", "replayed"]
    assert df.count() > 1000
