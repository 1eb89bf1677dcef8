"""Queries of the history projection, the time boundary and garbage collection, over the derived ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import history as H
from tidebook.operators import ledger as L
from tidebook.operators import watermark as W
from tidebook.plans.ledger import WANTED, book, upto, wanted
from tidebook.plans.registry import query
from tidebook.plans.sql import LEDGER, REQUESTS, over
from tidebook.sources.derive import requests
from tidebook.sources.tables import table

BOUNDARY = 1_704_700_000_000_000

# History holds the first three fifths of each shard; the batch goes on from a little before with faults put in.
HISTORY = LEDGER + ", heads AS (SELECT shard_id, max(seq) AS head FROM ledger GROUP BY 1), history AS (SELECT l.* FROM ledger l JOIN heads h USING (shard_id) WHERE seq <= head * 3 // 5)"
BATCH = (
    HISTORY
    + """, batch AS (SELECT * EXCLUDE (head) REPLACE (CASE WHEN seq = head * 11 // 20 + 5 THEN balance + 1 ELSE balance END AS balance, CASE WHEN operation = 'refund' AND status = 'applied' AND seq % 50 = 7 THEN amount + 1 ELSE amount END AS amount)
  FROM ledger JOIN heads USING (shard_id) WHERE seq >= head * 11 // 20 AND NOT (shard_id = 2 AND seq = head * 13 // 20))"""
)


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upto(book(spark, sf_dir))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = book(spark, sf_dir)
    rows = all_.join(F.broadcast(all_.groupBy("shard_id").agg(F.max("seq").alias("head"))), "shard_id").where("seq >= head * 11 div 20 and not (shard_id = 2 and seq = head * 13 div 20)")
    wrong = (F.col("operation") == "refund") & (F.col("status") == "applied") & (F.col("seq") % 50 == 7)
    return rows.withColumn("balance", F.when(F.expr("seq = head * 11 div 20 + 5"), F.col("balance") + 1).otherwise(F.col("balance"))).withColumn("amount", F.when(wrong, F.col("amount") + 1).otherwise(F.col("amount"))).drop("head")


@query(
    "h01_apply_batch",
    over(
        BATCH
        + """, placed AS (SELECT b.*, lag(seq) OVER (PARTITION BY shard_id ORDER BY seq) AS prev, h.head FROM batch b LEFT JOIN (SELECT shard_id AS s, max(seq) AS head FROM history GROUP BY 1) h ON h.s = b.shard_id),
whole AS (SELECT shard_id, seq, account_id, tx_id, transaction_at, operation, amount, refund_tx, refund_at, status, true AS own FROM batch
  UNION ALL SELECT shard_id, seq, account_id, tx_id, transaction_at, operation, amount, refund_tx, refund_at, status, false FROM history h WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.shard_id = h.shard_id AND b.seq = h.seq)),
refunds AS (SELECT *, min(seq) OVER (PARTITION BY shard_id, account_id, refund_tx, refund_at) AS first FROM whole WHERE operation = 'refund' AND status = 'applied'),
debits AS (SELECT * FROM whole WHERE operation = 'debit' AND status = 'applied')""",
        """SELECT shard_id, seq, 'starts_late' AS finding FROM placed WHERE prev IS NULL AND seq > coalesce(head, 0) + 1
UNION SELECT shard_id, seq, 'gap' FROM placed WHERE seq > prev + 1
UNION SELECT b.shard_id, b.seq, 'changed' FROM batch b JOIN history h ON h.shard_id = b.shard_id AND h.seq = b.seq WHERE (b.operation, b.amount, b.status, b.balance) IS DISTINCT FROM (h.operation, h.amount, h.status, h.balance)
UNION SELECT b.shard_id, b.seq, 'changed' FROM batch b JOIN history h USING (account_id, tx_id, transaction_at) WHERE b.seq <> h.seq
UNION SELECT r.shard_id, r.seq, 'bad_refund' FROM refunds r LEFT JOIN debits d ON d.shard_id = r.shard_id AND d.account_id = r.account_id AND d.tx_id = r.refund_tx AND d.transaction_at = r.refund_at
  WHERE r.own AND NOT coalesce(d.amount = r.amount AND d.seq < r.seq AND r.first = r.seq, false)""",
    ),
)
def apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.findings(batch(spark, sf_dir), known(spark, sf_dir))


FOUND = """, found AS (SELECT r.*, CASE WHEN h.seq IS NULL THEN 'not_found'
  WHEN (r.operation, r.amount, r.refund_account, r.refund_tx, r.refund_at) IS NOT DISTINCT FROM (h.operation, h.amount, h.refund_account, h.refund_tx, h.refund_at) THEN 'exact_replay' ELSE 'conflict' END AS found,
  h.status AS hs, h.balance AS hb, h.seq AS hq FROM requests r LEFT JOIN history h USING (account_id, tx_id, transaction_at))"""


@query("h02_lookup_transaction", over(HISTORY + FOUND, "SELECT arrival_ord, found, CASE WHEN found = 'exact_replay' THEN hs END AS status, CASE WHEN found = 'exact_replay' THEN hb END AS balance, CASE WHEN found = 'exact_replay' THEN hq END AS seq FROM found"))
def lookup_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.lookup(requests(spark, sf_dir), known(spark, sf_dir)).select("arrival_ord", "found", "status", "balance", "seq")


@query(
    "h03_lookup_debit",
    over(
        HISTORY + f", wanted AS ({WANTED})",
        """SELECT w.position, w.account_id, w.tx_id, w.transaction_at, d.amount, CASE WHEN d.amount IS NOT NULL THEN EXISTS (SELECT 1 FROM history r WHERE r.operation = 'refund' AND r.status = 'applied' AND r.refund_account = w.account_id AND r.refund_tx = w.tx_id AND r.refund_at = w.transaction_at) END AS already_refunded
FROM wanted w LEFT JOIN (SELECT * FROM history WHERE operation = 'debit' AND status = 'applied') d USING (account_id, tx_id, transaction_at)""",
    ),
)
def lookup_debit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.lookup_debit(wanted(spark, sf_dir), known(spark, sf_dir))


@query("h04_progress", over(LEDGER + ", held AS (SELECT shard_id, seq FROM ledger WHERE NOT (shard_id = 1 AND seq = 700) AND NOT (shard_id = 3 AND seq = 1)), nth AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS place FROM held)", "SELECT shard_id, coalesce(max(seq) FILTER (WHERE seq = place), 0) AS progress FROM nth GROUP BY 1"))
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.progress(book(spark, sf_dir).where("not (shard_id = 1 and seq = 700) and not (shard_id = 3 and seq = 1)"))


@query("h05_projector", over(HISTORY, "SELECT shard_id, seq, account_id, tx_id, status, balance FROM ledger JOIN heads USING (shard_id) WHERE seq > head * 3 // 5"))
def projector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a projection step appends to the history: the rows beyond its progress."""
    return H.applied_batch(book(spark, sf_dir), known(spark, sf_dir)).select("shard_id", "seq", "account_id", "tx_id", "status", "balance")


@query("h06_monotone_progress", "SELECT range AS wanted, CASE WHEN range > 120 OR range < 40 THEN NULL ELSE range END AS stored FROM range(200)")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asking for 0 to 199 where 40 is stored and 120 is the head."""
    return spark.range(200).select(F.col("id").alias("wanted"), H.persisted(F.lit(40), F.lit(120), F.col("id")).alias("stored"))


@query(
    "h07_destination_binding",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'invalid' WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'same' ELSE 'already_bound' END WHEN c_custkey % 3 = 0 THEN 'progress_exists' ELSE 'bound' END AS outcome FROM customer""",
)
def destination_binding(spark: SparkSession, sf_dir: str) -> DataFrame:

    k = F.col("c_custkey")
    identity = F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.concat("c_name", F.lit("\n"))).otherwise(F.col("c_name"))
    bound = F.when(k % 5 == 0, F.when(k % 2 == 0, identity).otherwise(F.lit("other")))
    return table(spark, sf_dir, "customer").select("c_custkey", H.binding(identity, bound, F.when(k % 3 == 0, 1).otherwise(0)).alias("outcome"))


@query(
    "h08_destination_verification",
    over(HISTORY, "SELECT l.shard_id, l.n AS source_progress, h.n AS destination_progress, l.shard_id <> 2 AS bound, CASE WHEN l.shard_id = 2 THEN 'unbound' WHEN h.n IS NULL THEN 'missing' WHEN h.n < l.n THEN 'behind' ELSE 'ok' END AS outcome FROM (SELECT shard_id, max(seq) - max(seq) * 9 // 20 * (shard_id % 2) AS n FROM ledger GROUP BY shard_id) l LEFT JOIN (SELECT shard_id, max(seq) AS n FROM history WHERE shard_id <> 0 GROUP BY 1) h USING (shard_id)"),
)
def destination_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book(spark, sf_dir)
    source = rows.groupBy("shard_id").agg(F.max("seq").alias("m")).select("shard_id", F.expr("m - m * 9 div 20 * (shard_id % 2)").alias("source_progress"))
    there = upto(rows).where("shard_id <> 0").groupBy("shard_id").agg(F.max("seq").alias("destination_progress"))
    return H.verified(source.join(there, "shard_id", "left").withColumn("bound", F.col("shard_id") != 2))


@query("h09_projection_twin", over(HISTORY, "SELECT shard_id, max(seq) AS progress, count(*) AS rows, count(*) FILTER (WHERE operation = 'refund' AND status = 'applied') AS refunded FROM history GROUP BY 1"))
def projection_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a projection after its batches: progress, rows and refunded targets."""
    rows = known(spark, sf_dir)
    targets = H.refunded_targets(rows).select(F.pmod("account_id", F.lit(L.SHARDS)).cast("int").alias("shard_id")).groupBy("shard_id").agg(F.count("*").alias("refunded"))
    return H.progress(rows).join(rows.groupBy("shard_id").agg(F.count("*").alias("rows")), "shard_id").join(targets, "shard_id", "left").select("shard_id", "progress", "rows", F.coalesce("refunded", F.lit(0)).alias("refunded"))


@query("w01_boundary_routing", over(REQUESTS, f"SELECT arrival_ord, CASE WHEN transaction_at < {BOUNDARY} THEN 'historical' ELSE 'commit' END AS route FROM requests"))
def boundary_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("arrival_ord", W.route(F.col("transaction_at"), F.lit(BOUNDARY)).alias("route"))


@query(
    "w02_late_answers",
    over(
        HISTORY + FOUND,
        f"SELECT arrival_ord, CASE found WHEN 'exact_replay' THEN 'transaction' WHEN 'conflict' THEN 'conflict' ELSE 'expired' END AS reply_kind, CASE WHEN found = 'exact_replay' THEN hs END AS status, CASE WHEN found = 'exact_replay' THEN hb END AS balance, CASE WHEN found = 'exact_replay' THEN hq END AS seq, found = 'exact_replay' AS historical_replay FROM found WHERE transaction_at < {BOUNDARY + 2_000_000_000_000}",
    ),
)
def late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = requests(spark, sf_dir).where(F.col("transaction_at") < BOUNDARY + 2_000_000_000_000)
    return W.late_answers(late, known(spark, sf_dir)).select("arrival_ord", "reply_kind", "status", "balance", "seq", "historical_replay")


@query("w03_fence", over(REQUESTS, f"SELECT arrival_ord, transaction_at >= {BOUNDARY} AND transaction_at < {BOUNDARY + 3_600_000_000} AS would_block FROM requests"))
def fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("arrival_ord", W.would_block(F.col("transaction_at"), F.lit(BOUNDARY), F.lit(BOUNDARY + 3_600_000_000)).alias("would_block"))


# Shards 0 to 3: all projected; one behind; a boundary already later; checkpoints that lag.
SHARDS = LEDGER + f""", shards AS (SELECT shard_id, max(seq) AS latest_seq, max(seq) - CASE WHEN shard_id = 1 THEN 40 ELSE 0 END AS projected_seq,
  CASE WHEN shard_id = 2 THEN {BOUNDARY + 10**15} WHEN shard_id = 3 THEN NULL ELSE {BOUNDARY} END AS boundary_at, CASE WHEN shard_id = 2 THEN max(seq) - 1 WHEN shard_id = 3 THEN NULL ELSE max(seq) - 10 END AS boundary_seq FROM ledger GROUP BY 1)"""
NOW, RETENTION = BOUNDARY + 900_000_000_000, 600_000_000_000


def shards(rows: DataFrame) -> DataFrame:
    s = F.col("shard_id")
    base = rows.groupBy("shard_id").agg(F.max("seq").alias("latest_seq"))
    return base.select(
        "shard_id", "latest_seq", (F.col("latest_seq") - F.when(s == 1, 40).otherwise(0)).alias("projected_seq"),
        F.when(s == 2, F.lit(BOUNDARY + 10**15)).when(s != 3, F.lit(BOUNDARY)).alias("boundary_at"), F.when(s == 2, F.col("latest_seq") - 1).when(s != 3, F.col("latest_seq") - 10).alias("boundary_seq"),
    )


@query(
    "w04_watermark_advance",
    over(
        SHARDS + f", m AS (SELECT *, projected_seq >= latest_seq AND {NOW - RETENTION} > coalesce(boundary_at, -1) AND latest_seq >= coalesce(boundary_seq, 0) AS moved FROM shards)",
        f"SELECT shard_id, moved, CASE WHEN moved THEN {NOW - RETENTION} ELSE boundary_at END AS next_at, CASE WHEN moved THEN latest_seq ELSE boundary_seq END AS next_seq FROM m",
    ),
)
def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.advanced(shards(book(spark, sf_dir)), NOW, RETENTION).select("shard_id", "moved", "next_at", "next_seq")


@query("w05_restore_boundary", over(SHARDS, "SELECT shard_id, boundary_at IS NOT NULL AND boundary_seq IS NOT NULL AND boundary_seq <= projected_seq AS restored FROM shards"))
def restore_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.restorable(shards(book(spark, sf_dir))).select("shard_id", F.coalesce("restored", F.lit(False)).alias("restored"))


# Coverage of shard 2 isn't known, and shard 1 lacks a row: nothing of the one and nothing beyond the gap of the other goes.
SCAN = SHARDS + """, g AS (SELECT *, 100 AS prefix0, CASE WHEN shard_id = 0 THEN latest_seq WHEN shard_id <> 2 THEN latest_seq - 200 END AS coverage_seq FROM shards WHERE boundary_at IS NOT NULL),
r0 AS (SELECT l.*, g.boundary_at, g.prefix0 FROM ledger l JOIN g USING (shard_id) WHERE l.seq > prefix0 AND l.seq <= least(boundary_seq, latest_seq, projected_seq, coalesce(coverage_seq, 0)) AND NOT (l.shard_id = 1 AND l.seq = latest_seq * 4 // 5)),
u AS (SELECT shard_id, seq + 1 AS x FROM r0 UNION ALL SELECT shard_id, 101 FROM g), miss AS (SELECT shard_id, min(x) AS x FROM u WHERE NOT EXISTS (SELECT 1 FROM r0 WHERE r0.shard_id = u.shard_id AND r0.seq = u.x) GROUP BY 1),
r AS (SELECT r0.* FROM r0 JOIN miss USING (shard_id) WHERE seq < x),
k AS (SELECT shard_id, min(seq) AS blocked FROM r WHERE transaction_at >= boundary_at GROUP BY 1),
scanned AS (SELECT r.*, k.blocked, coalesce(r.seq < k.blocked, true) AS deletable FROM r LEFT JOIN k USING (shard_id) WHERE k.blocked IS NULL OR r.seq <= k.blocked)"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book(spark, sf_dir)
    at = shards(rows).withColumn("gc_prefix_seq", F.lit(100).cast("long")).withColumn("coverage_seq", F.when(F.col("shard_id") == 0, F.col("latest_seq")).when(F.col("shard_id") != 2, F.col("latest_seq") - 200))
    short = rows.join(F.broadcast(at.select("shard_id", "latest_seq")), "shard_id").where("not (shard_id = 1 and seq = latest_seq * 4 div 5)").select(*rows.columns)
    return W.safe_prefix(short, at, 1 << 40)


@query("w06_safe_gc_prefix", over(SCAN, "SELECT shard_id, seq, account_id, blocked AS blocked_at_seq, deletable FROM scanned"))
def safe_gc_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("shard_id", "seq", "account_id", "blocked_at_seq", "deletable")


@query(
    "w07_gc_consistency",
    over(
        SCAN,
        """SELECT shard_id, seq, 'index' AS finding FROM scanned WHERE deletable AND seq % 41 = 0
UNION ALL SELECT shard_id, seq, 'marker' FROM scanned WHERE deletable AND operation = 'refund' AND status = 'applied' AND refund_tx % 5 = 0
UNION ALL SELECT shard_id, seq, 'balance' FROM scanned WHERE deletable AND account_id % 30 = 0""",
    ),
)
def gc_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every 41st index row, every fifth marker and every 30th balance taken away."""
    rows = book(spark, sf_dir)
    return W.consistency(scanned(spark, sf_dir), rows.where("seq % 41 <> 0"), H.refunded_targets(rows).where("tx_id % 5 <> 0"), L.balances(rows).where("account_id % 30 <> 0").select("account_id"))


@query(
    "w08_gc_accounting",
    over(
        SCAN,
        """SELECT shard_id, count(*) AS scanned, count(*) FILTER (WHERE deletable) AS deleted, min(blocked) AS blocked_at_seq, coalesce(max(seq) FILTER (WHERE deletable), CAST(min(prefix0) AS BIGINT)) AS prefix,
  CAST(coalesce(sum(34 + 2 * CASE WHEN refund_tx IS NULL THEN 51 ELSE 75 END + CASE WHEN operation = 'refund' AND status = 'applied' THEN 33 ELSE 0 END) FILTER (WHERE deletable), 0) AS BIGINT) AS bytes_deleted FROM scanned GROUP BY 1""",
    ),
)
def gc_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.accounting(scanned(spark, sf_dir))


@query("w09_balance_coverage", over(SHARDS, "SELECT shard_id, CASE WHEN shard_id = 3 THEN 0 ELSE latest_seq // 500 * 500 END AS coverage_seq FROM shards"))
def balance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints every 500 rows; shard 3 has none yet."""
    at = shards(book(spark, sf_dir))
    manifest = at.where("shard_id <> 3").select("shard_id", (F.floor(F.col("latest_seq") / 500) * 500).cast("long").alias("seq"))
    return W.coverage(at, manifest).select("shard_id", "coverage_seq")


@query("w10_tumbling_rates", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of events; the ledger itself has no windows, only its rates do."""

    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n")


@query(
    "w12_late_and_fresh_together",
    over(REQUESTS, f"SELECT account_id % 4 AS shard_id, count(*) FILTER (WHERE transaction_at < {BOUNDARY}) AS historical, count(*) FILTER (WHERE transaction_at >= {BOUNDARY}) AS fresh FROM requests GROUP BY 1"),
)
def late_and_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.routed(requests(spark, sf_dir)).withColumn("route", W.route(F.col("transaction_at"), F.lit(BOUNDARY)))
    return r.groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(F.count_if(F.col("route") == "historical").alias("historical"), F.count_if(F.col("route") == "commit").alias("fresh"))


