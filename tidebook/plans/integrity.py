"""Queries of snapshots, recovery and integrity, over the derived ledger."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import integrity as V
from tidebook.operators import ledger as L
from tidebook.operators.metrics import request_mix
from tidebook.plans.ledger import book, upto
from tidebook.plans.registry import query
from tidebook.plans.sql import LEDGER, over
from tidebook.sources import wal
from tidebook.sources.tables import table

CHECKPOINT = (
    LEDGER
    + """, last_ AS (SELECT shard_id, account_id, arg_max(balance, seq) AS balance FROM ledger GROUP BY 1, 2),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY account_id) - 1 AS BIGINT) AS place FROM last_)"""
)


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot at each shard's head."""
    return V.snapshot(book(spark, sf_dir))


@query(
    "v01_checkpoint_due",
    over(LEDGER + ", b AS (SELECT shard_id, (seq - 1) // 64 AS batch, min(seq) - 1 AS before, max(seq) AS after FROM ledger GROUP BY 1, 2)", "SELECT shard_id, before, after, after // 50 - before // 50 AS snapshots FROM b WHERE after // 50 > before // 50"),
)
def checkpoint_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 rows, checkpoints every 50: some batches cross two boundaries."""
    b = book(spark, sf_dir).groupBy("shard_id", F.floor((F.col("seq") - 1) / 64).alias("batch")).agg((F.min("seq") - 1).alias("before"), F.max("seq").alias("after"))
    return V.snapshots_due(b.select("shard_id", "before", "after"), 50)


@query("v02_snapshot_chunks", over(CHECKPOINT, "SELECT shard_id, account_id, balance, place, place // 1024 AS chunk FROM chunks"))
def snapshot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head(spark, sf_dir).select("shard_id", "account_id", "balance", "place", "chunk")


_BYTES = " || ".join(f"list_transform(range(56, -1, -8), lambda s: CAST(({x} >> s) & 255 AS UHUGEINT))" for x in ("account_id", "balance"))
_FNV = "lambda h, b: CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT"


@query(
    "v03_checksum",
    over(
        CHECKPOINT + f", bytes AS (SELECT shard_id, flatten(list({_BYTES} ORDER BY account_id)) AS b FROM last_ GROUP BY 1)",
        f"SELECT shard_id, lpad(lower(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, b), {_FNV}) AS UBIGINT))), 16, '0') AS checksum FROM bytes",
    ),
)
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.checksums(head(spark, sf_dir))


@query(
    "v04_checkpoint_validation",
    over(CHECKPOINT, "SELECT 0 AS shard_id, 'users' AS finding UNION ALL SELECT 0, 'checksum' UNION ALL SELECT 1, 'checksum' UNION ALL SELECT 1, 'order'"),
)
def checkpoint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks against their manifest, with a row lost in shard 0 and an account out of order in shard 1."""
    good = head(spark, sf_dir)
    manifest = good.groupBy("shard_id").agg(F.count("*").alias("users"), F.countDistinct("chunk").alias("chunks")).join(V.checksums(good), "shard_id")
    top = good.groupBy("shard_id").agg(F.max("place").alias("top"))
    lost = good.join(F.broadcast(top), "shard_id").where("not (shard_id = 0 and place = top)").drop("top")
    bad = lost.withColumn("account_id", F.when((F.col("shard_id") == 1) & (F.col("place") == 3), 0).otherwise(F.col("account_id")))
    return V.checkpoint_findings(manifest, bad)


@query("v05_orphan_chunks", over(CHECKPOINT + ", g AS (SELECT DISTINCT shard_id, place // 1024 AS chunk, unnest([1, 2, 3]) AS generation FROM chunks)", "SELECT shard_id, generation, chunk FROM g WHERE generation <> 2 OR shard_id = 3"))
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of chunks, of which the manifests name the second; shard 3 has no manifest."""
    all_ = head(spark, sf_dir).select("shard_id", "chunk").distinct().withColumn("generation", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    manifest = all_.where("generation = 2 and shard_id <> 3").select("shard_id", "generation").distinct()
    return V.orphans(all_, manifest)


@query("v06_recovery_replay", over(LEDGER, "SELECT shard_id, account_id, arg_max(balance, seq) AS balance FROM ledger GROUP BY 1, 2"))
def recovery_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot at three fifths of each shard and the tail after it give the balances of the whole ledger."""
    rows = book(spark, sf_dir)
    early = upto(rows)
    return V.recovered(V.snapshot(early), rows.join(early.select("shard_id", "seq"), ["shard_id", "seq"], "left_anti"))


@query(
    "v07_metadata_invariants",
    """WITH m AS (SELECT c_custkey AS shard_id, c_custkey % 13 AS latest, c_custkey % 11 AS projected, c_custkey % 7 AS gc, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS boundary_at, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 9 END AS boundary_seq, c_custkey % 4 <> 0 AS bound FROM customer)
SELECT shard_id, 'projected_beyond_latest' AS finding FROM m WHERE projected > latest UNION ALL SELECT shard_id, 'gc_beyond_latest' FROM m WHERE gc > latest UNION ALL SELECT shard_id, 'gc_beyond_projected' FROM m WHERE gc > projected
UNION ALL SELECT shard_id, 'gc_beyond_boundary' FROM m WHERE gc > coalesce(boundary_seq, 0) UNION ALL SELECT shard_id, 'half_boundary' FROM m WHERE (boundary_at IS NULL) <> (boundary_seq IS NULL) UNION ALL SELECT shard_id, 'progress_unbound' FROM m WHERE NOT bound AND projected > 0""",
)
def metadata_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(k.alias("shard_id"), (k % 13).alias("latest"), (k % 11).alias("projected"), (k % 7).alias("gc"), F.when(k % 5 != 0, 1).alias("boundary_at"), F.when(k % 3 != 0, k % 9).alias("boundary_seq"), (k % 4 != 0).alias("bound"))
    return V.metadata_findings(m)


@query(
    "v08_index_vs_ledger",
    over(
        LEDGER
        + """, kept AS (SELECT * FROM ledger WHERE seq > 100 AND NOT (shard_id = 2 AND seq = 120)), idx AS (SELECT shard_id, account_id, tx_id, transaction_at, CASE WHEN seq % 500 = 0 THEN seq + 1 ELSE seq END AS seq FROM ledger WHERE seq > 100 AND seq % 777 <> 0),
m AS (SELECT shard_id, max(seq) - 1 AS latest, 100 AS gc FROM ledger GROUP BY 1)""",
        """SELECT coalesce(k.shard_id, i.shard_id) AS shard_id, 'mismatch' AS finding, count(*) AS n FROM kept k FULL JOIN idx i USING (shard_id, account_id, tx_id, transaction_at) WHERE k.seq IS DISTINCT FROM i.seq GROUP BY 1
UNION ALL SELECT shard_id, 'outside', count(*) FROM kept JOIN m USING (shard_id) WHERE seq <= gc OR seq > latest GROUP BY 1
UNION ALL SELECT 2, 'gap', 1 UNION ALL SELECT shard_id, 'count', count(*) - any_value(latest - gc) FROM kept JOIN m USING (shard_id) GROUP BY 1 HAVING count(*) <> any_value(latest - gc)""",
    ),
)
def index_vs_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger collected up to 100 with one row lost, an index with rows changed and lost, and a head that is one short."""
    rows = book(spark, sf_dir)
    kept = rows.where("seq > 100 and not (shard_id = 2 and seq = 120)")
    index = rows.where("seq > 100 and seq % 777 <> 0").withColumn("seq", F.when(F.col("seq") % 500 == 0, F.col("seq") + 1).otherwise(F.col("seq")))
    meta = rows.groupBy("shard_id").agg((F.max("seq") - 1).alias("latest")).withColumn("gc", F.lit(100).cast("long"))
    return V.index_findings(kept, index, meta)


@query(
    "v09_balance_vs_ledger",
    over(
        LEDGER + ", b AS (SELECT shard_id, account_id, arg_max(balance, seq) AS expected FROM ledger GROUP BY 1, 2), s AS (SELECT *, CASE WHEN account_id % 10 = 0 THEN NULL WHEN account_id % 7 = 0 THEN expected + 1 ELSE expected END AS stored FROM b)",
        "SELECT shard_id, account_id, expected, stored, CASE WHEN stored IS NULL THEN 'missing' ELSE 'differs' END AS finding FROM s WHERE stored IS DISTINCT FROM expected",
    ),
)
def balance_vs_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book(spark, sf_dir)
    held = L.balances(rows).where("account_id % 10 <> 0").withColumn("balance", F.when(F.col("account_id") % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")))
    return V.balance_findings(rows, held)


@query("v10_repeated_accounts", "SELECT o_custkey AS account_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.repeated_accounts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id")))


@query(
    "v11_workload_verification",
    "SELECT 'fresh' AS class, CAST(38000 AS BIGINT) AS expected, CAST(38000 AS BIGINT) AS found, true AS holds UNION ALL SELECT 'late_hit', 1000, 1000, true UNION ALL SELECT 'late_miss', 1000, 1000, true UNION ALL SELECT 'accounts', 100, 100, true UNION ALL SELECT 'balanced', 100, 100, true",
)
def workload_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated workload of 100 accounts with 400 requests each, 5 % late: its mix, accounts and net balances."""
    mix = request_mix(spark, 100, 400, 5)
    found = mix.groupBy("class").agg(F.count("*").alias("found"))
    expected = F.when(F.col("class") == "fresh", 38_000).otherwise(1_000).cast("long")
    net = mix.groupBy("account_id").agg(F.sum(F.when(F.col("operation") == "credit", 1).otherwise(-1)).alias("net"))
    sums = net.agg(F.count("*").alias("accounts"), F.count_if(F.col("net") == 0).alias("balanced")).unpivot([], ["accounts", "balanced"], "class", "found")
    rows = found.withColumn("expected", expected).unionByName(sums.withColumn("expected", F.lit(100).cast("long")))
    return rows.select("class", "expected", "found", (F.col("expected") == F.col("found")).alias("holds"))


@query(
    "v12_stage_invariants",
    "WITH s AS (SELECT event_type AS stage, count(*) AS count, max(user_id) AS peak FROM events GROUP BY 1), l AS (UNPIVOT s ON count, peak INTO NAME metric VALUE value) SELECT stage, metric, value FROM l WHERE (metric = 'count' AND value <> 2000) OR (metric = 'peak' AND value > 100)",
)
def stage_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("count"), F.max("user_id").alias("peak"))
    return V.stage_findings(s.unpivot(["stage"], ["count", "peak"], "metric", "value"), 2000, {"peak": 100})


@query(
    "v13_wal_recovery",
    """WITH n AS (SELECT count(*) AS total, (count(*) - 1) // 1000 AS last_ FROM events), s AS (SELECT range AS segment, total, last_, least(1000, total - range * 1000) AS held FROM n, range(100000) WHERE range <= last_),
f AS (SELECT segment, CASE WHEN segment = last_ THEN (held - 1) // 100 ELSE (held + 99) // 100 END AS frames, CASE WHEN segment = last_ THEN (held - 1) // 100 * 100 ELSE held END AS records, segment = last_ AS torn FROM s)
SELECT segment, frames, CAST(records AS BIGINT) AS records, CASE WHEN frames > 0 THEN segment * 1000 + 1 END AS first_lsn, torn, CAST(NULL AS VARCHAR) AS problem FROM f""",
)
def wal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as log segments of ten frames of 100 records, the last frame torn, and read again."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).cast("long").alias("segment"))
    last = e.agg(F.max("segment").alias("last"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["event_id"].tolist())
        content = b"".join(wal.encode_frame([wal.record(i + 1) for i in ids[a : a + 100]]) for a in range(0, len(ids), 100))
        torn = bool(pdf["segment"].iloc[0] == pdf["last"].iloc[0])
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "content": [content[:-30] if torn else content]})

    segments = e.crossJoin(F.broadcast(last)).groupBy("segment").applyInPandas(write, "segment long, content binary")
    return wal.recovery(wal.parsed(segments))
