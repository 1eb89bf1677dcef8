"""Queries of the ledger core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators import ledger as L
from tidebook.plans.registry import query
from tidebook.plans.sql import CLASSIFIED, LEDGER, ORIGINALS, REQUESTS, WALLET, over
from tidebook.sources.committed import committed
from tidebook.sources.derive import originals, requests
from tidebook.sources.tables import table


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all derived requests, committed once per data folder in order of account and key."""
    return committed(spark, sf_dir, "ledger", "events", lambda: L.ledger(requests(spark, sf_dir), dense=True).repartition("account_id").sortWithinPartitions("account_id", "tx_id"))


def upto(rows: DataFrame, share: str = "head * 3 div 5") -> DataFrame:
    """The rows of each shard up to a share of its head, which is one row a shard."""
    heads = rows.groupBy("shard_id").agg(F.max("seq").alias("head"))
    return rows.join(F.broadcast(heads), "shard_id").where(f"seq <= {share}").select(*rows.columns)


def flat(df: DataFrame) -> DataFrame:
    """The refund's target as three columns."""
    return df.select(*(c for c in df.columns if c != "refund_of"), F.col("refund_of.account_id").alias("refund_account"), F.col("refund_of.tx_id").alias("refund_tx"), F.col("refund_of.transaction_at").alias("refund_at"))


@query("l01_shard_routing", over(REQUESTS, "SELECT CAST(account_id % 4 AS INTEGER) AS shard_id, count(*) AS requests, count(DISTINCT account_id) AS accounts FROM requests GROUP BY 1"))
def shard_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = L.routed(requests(spark, sf_dir)).groupBy("shard_id", "account_id").agg(F.count("*").alias("n"))
    return per.groupBy("shard_id").agg(F.sum("n").alias("requests"), F.count("*").alias("accounts"))


@query(
    "l02_micro_batches",
    over(
        ORIGINALS
        + """, q AS (SELECT account_id % 4 AS shard_id, arrival_ord, transaction_at AS t, row_number() OVER (PARTITION BY account_id % 4 ORDER BY arrival_ord) AS rn,
  count(*) OVER (PARTITION BY account_id % 4) AS total FROM originals
), b AS (
  SELECT shard_id, CAST(1 AS BIGINT) AS rn, CAST(1 AS BIGINT) AS batch_no, t AS began, CAST(1 AS BIGINT) AS held, 'start' AS why, total FROM q WHERE rn = 1
  UNION ALL
  SELECT q.shard_id, q.rn, CASE WHEN b.held = 256 OR q.t - b.began >= 36000000000 THEN b.batch_no + 1 ELSE b.batch_no END,
    CASE WHEN b.held = 256 OR q.t - b.began >= 36000000000 THEN q.t ELSE b.began END,
    CASE WHEN b.held = 256 OR q.t - b.began >= 36000000000 THEN 1 ELSE b.held + 1 END,
    CASE WHEN b.held = 256 THEN 'size' WHEN q.t - b.began >= 36000000000 THEN 'timeout' ELSE '' END, q.total
  FROM b JOIN q ON q.shard_id = b.shard_id AND q.rn = b.rn + 1
), m AS (SELECT shard_id, batch_no, min(rn) AS a, max(rn) AS z, max(total) AS total FROM b GROUP BY ALL)""",
        """SELECT m.shard_id, m.batch_no, f.arrival_ord AS first_ord, m.z - m.a + 1 AS rows,
  CASE WHEN m.z - m.a + 1 = 256 THEN 'size' WHEN m.z = m.total THEN 'close' ELSE 'timeout' END AS reason
FROM m JOIN q f ON f.shard_id = m.shard_id AND f.rn = m.a""",
    ),
)
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 256 requests, or of ten hours from the first one's time."""
    return L.micro_batches(L.routed(originals(spark, sf_dir)), "shard_id", "arrival_ord", "transaction_at", 256, 36_000_000_000)


ORDERED_APPLY = over(
        LEDGER,
        """SELECT c.arrival_ord, c.account_id, c.tx_id, c.transaction_at, CAST(c.shard_id AS INTEGER) AS shard_id,
  CASE c.kind WHEN 'conflict' THEN 'conflict' ELSE 'transaction' END AS reply_kind,
  CASE WHEN c.kind <> 'conflict' THEN l.status END AS status, CASE WHEN c.kind <> 'conflict' THEN l.balance END AS balance,
  CASE WHEN c.kind <> 'conflict' THEN l.seq END AS seq, c.kind = 'replay' AS replayed
FROM classified c JOIN ledger l ON l.arrival_ord = c.first_ord""",
    )


@query("l03_ordered_apply", ORDERED_APPLY)
def ordered_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.replies(requests(spark, sf_dir), dense=True)


@query("l04_dedup_classify", over(CLASSIFIED, "SELECT arrival_ord, first_ord, kind FROM classified"))
def dedup_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classified(requests(spark, sf_dir)).select("arrival_ord", "first_ord", "kind")


@query("l05_shard_sequence", over(LEDGER, "SELECT arrival_ord, CAST(shard_id AS INTEGER) AS shard_id, CASE WHEN kind = 'new' THEN sq END AS seq FROM seqs"))
def shard_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sequenced(L.routed(L.classified(requests(spark, sf_dir))), dense=True).select("arrival_ord", "shard_id", "seq")


@query("l06_status_evaluation", over(LEDGER, "SELECT operation, status, count(*) AS requests, CAST(sum(amount) AS BIGINT) AS amount FROM ledger GROUP BY 1, 2"))
def status_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.evaluated(L.classified(requests(spark, sf_dir).repartition("account_id"))).where("kind = 'new'")
    return rows.groupBy("operation", "status").agg(F.count("*").alias("requests"), F.sum("amount").alias("amount"))


@query("l07_refund_resolution", over(LEDGER, "SELECT arrival_ord, account_id, refund_tx, amount, status, balance FROM ledger WHERE operation = 'refund'"))
def refund_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.evaluated(L.classified(requests(spark, sf_dir).repartition("account_id"))).where("kind = 'new' and operation = 'refund'")
    return rows.select("arrival_ord", "account_id", F.col("refund_of.tx_id").alias("refund_tx"), "amount", "status", "balance")


@query("l08_balances", over(LEDGER, "SELECT shard_id, account_id, arg_max(balance, seq) AS balance FROM ledger GROUP BY 1, 2"))
def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.balances_after(requests(spark, sf_dir))


@query("l09_balance_read", over(LEDGER + ", b AS (SELECT account_id, arg_max(balance, seq) AS balance FROM ledger GROUP BY 1)", "SELECT c_custkey AS account_id, coalesce(balance, 0) AS balance FROM customer LEFT JOIN b ON b.account_id = c_custkey"))
def balance_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"))
    return L.balance_of(L.balances_after(requests(spark, sf_dir)), wanted)


@query("l10_all_balances", over(LEDGER, "SELECT account_id, arg_max(balance, seq) AS balance FROM ledger GROUP BY 1 ORDER BY 1"))
def all_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.balances_after(requests(spark, sf_dir)).select("account_id", "balance").orderBy("account_id")


@query("l11_ledger_range", over(LEDGER, "SELECT shard_id, seq, account_id, tx_id, status, balance, row_number() OVER (ORDER BY seq) + 100 AS expected_seq, true AS intact FROM ledger WHERE shard_id = 1 AND seq BETWEEN 101 AND 350"))
def ledger_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_range(book(spark, sf_dir), 1, 101, 250).select("shard_id", "seq", "account_id", "tx_id", "status", "balance", F.col("expected_seq").cast("long").alias("expected_seq"), "intact")


WANTED = "SELECT arrival_ord AS position, account_id, tx_id, transaction_at + CASE WHEN arrival_ord % 3 = 0 THEN 1 ELSE 0 END AS transaction_at FROM originals"


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: every request's, each third of them moved in time so that it isn't stored."""
    at = F.col("transaction_at") + F.when(F.col("arrival_ord") % 3 == 0, 1).otherwise(0)
    return originals(spark, sf_dir).select(F.col("arrival_ord").alias("position"), "account_id", "tx_id", at.alias("transaction_at"))


@query("l12_index_get", over(LEDGER + f", wanted AS ({WANTED})", "SELECT w.*, l.seq, l.status, l.balance FROM wanted w LEFT JOIN ledger l USING (account_id, tx_id, transaction_at)"))
def index_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.index_get(book(spark, sf_dir), wanted(spark, sf_dir))


@query("l13_multi_get", over(LEDGER + f", wanted AS ({WANTED})", "SELECT w.*, l.seq, l.status, l.balance, w.position // 256 AS chunk, CAST(w.position // 256 % 4 AS INTEGER) AS slot FROM wanted w LEFT JOIN ledger l USING (account_id, tx_id, transaction_at)"))
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.multi_get(book(spark, sf_dir), wanted(spark, sf_dir), 256, 4)


@query(
    "l14_existence_probes",
    over(
        LEDGER + f", wanted AS ({WANTED})",
        """SELECT w.position, EXISTS (SELECT 1 FROM ledger l WHERE l.account_id = w.account_id AND l.tx_id = w.tx_id AND l.transaction_at = w.transaction_at) AS has_index,
  EXISTS (SELECT 1 FROM ledger l WHERE l.shard_id = w.account_id % 4 AND l.seq = w.position) AS has_sequence,
  EXISTS (SELECT 1 FROM ledger l WHERE l.operation = 'refund' AND l.status = 'applied' AND l.refund_tx = w.tx_id AND l.refund_at = w.transaction_at AND l.refund_account = w.account_id) AS has_marker
FROM wanted w""",
    ),
)
def existence_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ask = book(spark, sf_dir), wanted(spark, sf_dir)
    index = rows.select(*L.KEY, F.lit(True).alias("i"))
    heads = rows.select("shard_id", F.col("seq").alias("position"), F.lit(True).alias("s"))
    markers = rows.where("operation = 'refund' and status = 'applied'").select("refund_of.*", F.lit(True).alias("m"))
    found = L.routed(ask).join(index, L.KEY, "left").join(heads, ["shard_id", "position"], "left").join(markers, L.KEY, "left")
    return found.select("position", *(F.coalesce(c, F.lit(False)).alias(n) for c, n in (("i", "has_index"), ("s", "has_sequence"), ("m", "has_marker"))))


@query("l15_latest_seq", over(LEDGER, "SELECT shard_id, max(seq) AS latest_seq FROM ledger GROUP BY 1"))
def latest_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sequenced(L.routed(L.classified(requests(spark, sf_dir))), dense=True).groupBy("shard_id").agg(F.max("seq").alias("latest_seq"))


@query(
    "l16_wallet_apply",
    over(WALLET, "SELECT n.arrival_ord, n.account_id, n.tx_id, n.operation, n.amount, f.status, f.balance, n.rn AS version, n.rn AS write_clock FROM n JOIN fold f ON f.arrival_ord = n.arrival_ord"),
)
def wallet_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.wallet(requests(spark, sf_dir)).select("arrival_ord", "account_id", "tx_id", "operation", "amount", "status", "balance", "version", "write_clock")


@query(
    "l17_seeded_store",
    over(
        ORIGINALS
        + """, s AS (SELECT account_id, arrival_ord, CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY arrival_ord) AS BIGINT) AS post FROM originals WHERE operation = 'credit')""",
        "SELECT account_id, arg_max(post, arrival_ord) AS balance, count(*) AS records, count(*) FILTER (WHERE post < 0) AS negative FROM s GROUP BY 1",
    ),
)
def seeded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with given post-balances: the last one of each user, and how many would be refused as negative."""
    post = F.sum("amount").over(Window.partitionBy("account_id").orderBy("arrival_ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = originals(spark, sf_dir).where("operation = 'credit'").withColumn("post", post)
    return rows.groupBy("account_id").agg(F.max_by("post", "arrival_ord").alias("balance"), F.count("*").alias("records"), F.count_if(F.col("post") < 0).alias("negative"))


@query("l18_counter_map", "SELECT l_orderkey * 7 % 100000 AS key, count(*) AS count FROM lineitem GROUP BY 1")
def counter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.pmod(F.col("l_orderkey") * 7, F.lit(100_000)).alias("key")).agg(F.count("*").alias("count"))


@query("l00_requests", over(REQUESTS, "SELECT * FROM requests"))
def all_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(requests(spark, sf_dir))
