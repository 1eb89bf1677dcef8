"""Queries of the window transactions, over customers as accounts and orders as transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators import window_txn as X
from tidebook.plans.registry import query
from tidebook.sources.committed import committed
from tidebook.sources.tables import table

WINDOW = 500

# Accounts are customers but every 50th, with cents of the balance, 0 at least. The ledger holds orders divisible by 7.
# The input is every order, those divisible by 11 with amount 0, in order of the key.
BASE = """
accounts AS (SELECT c_custkey AS account_id, CAST(greatest(round(c_acctbal * 100), 0) AS BIGINT) AS balance FROM customer WHERE c_custkey % 50 <> 0),
o AS (SELECT o_orderkey AS ord, o_custkey AS account_id, o_orderkey AS transaction_id, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount FROM orders),
book AS (SELECT account_id, transaction_id, amount, before_balance, before_balance + amount AS after_balance FROM (
  SELECT o.*, balance + CAST(coalesce(sum(amount) OVER (PARTITION BY o.account_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_balance
  FROM o JOIN accounts USING (account_id) WHERE ord % 7 = 0 AND amount > 0))
"""
OUT = (
    BASE
    + """, now AS (SELECT a.account_id, a.balance + CAST(coalesce(sum(b.amount), 0) AS BIGINT) AS balance FROM accounts a LEFT JOIN book b USING (account_id) GROUP BY a.account_id, a.balance),
marked AS (SELECT o.ord, o.account_id, o.transaction_id, o.amount, n.balance, b.amount AS held, b.before_balance AS hb, b.after_balance AS ha,
  CASE WHEN b.amount IS NOT NULL THEN 'existing' WHEN o.amount <= 0 THEN 'rejected:invalid_amount' WHEN n.balance IS NULL THEN 'rejected:unknown_account' ELSE 'applied' END AS status
  FROM o LEFT JOIN book b USING (account_id, transaction_id) LEFT JOIN now n ON n.account_id = o.account_id),
run AS (SELECT *, balance + CAST(sum(CASE WHEN status = 'applied' THEN amount ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ord) AS BIGINT) AS after_ FROM marked),
found AS (SELECT ord, status, account_id, transaction_id, CASE WHEN status = 'existing' THEN held ELSE amount END AS amount,
  CASE status WHEN 'existing' THEN hb WHEN 'applied' THEN after_ - amount END AS before_balance,
  CASE status WHEN 'existing' THEN ha WHEN 'applied' THEN after_ END AS after_balance FROM run)
"""
)


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 0")
    return c.select(F.col("c_custkey").alias("account_id"), F.greatest(F.round(F.col("c_acctbal") * 100), F.lit(0)).cast("long").alias("balance"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.round(F.col("o_totalprice") * 100).cast("long"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("transaction_id"), amount.cast("long").alias("amount"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger before: orders divisible by 7, chained from the accounts' balances, committed once per data folder."""
    return committed(spark, sf_dir, "window-ledger", "orders", lambda: _chained(spark, sf_dir))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir).where("ord % 7 = 0 and amount > 0").join(accounts(spark, sf_dir), "account_id")
    before = F.sum("amount").over(Window.partitionBy("account_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before_balance", F.col("balance") + F.coalesce(before, F.lit(0)))
    return rows.select("account_id", "transaction_id", "amount", "before_balance", (F.col("before_balance") + F.col("amount")).alias("after_balance"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as the stored ledger left them."""
    sums = stored(spark, sf_dir).groupBy("account_id").agg(F.sum("amount").alias("s"))
    return accounts(spark, sf_dir).join(sums, "account_id", "left").select("account_id", (F.col("balance") + F.coalesce("s", F.lit(0))).alias("balance"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.outcomes(inputs(spark, sf_dir), current(spark, sf_dir), stored(spark, sf_dir))


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the window."""
    return stored(spark, sf_dir).unionByName(X.new_rows(found(spark, sf_dir)))


AFTER = OUT + ", entries AS (SELECT * FROM book UNION ALL SELECT account_id, transaction_id, amount, before_balance, after_balance FROM found WHERE status = 'applied')"


@query("q01_array_scan", over(BASE, "SELECT ord // 500 AS window_id, CAST(row_number() OVER (PARTITION BY ord // 500 ORDER BY ord) AS BIGINT) AS pos, account_id, transaction_id, amount FROM o"))
def array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as parallel arrays, and their rows again with ordinality."""
    rows = inputs(spark, sf_dir).withColumn("window_id", F.floor(F.col("ord") / WINDOW).cast("long"))
    arrays = rows.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("ord", "account_id", "transaction_id", "amount"))).alias("x"))
    arrays = arrays.select("window_id", *(F.col(f"x.{c}").alias(f"{c}s") for c in ("account_id", "transaction_id", "amount")))
    zipped = arrays.select("window_id", F.posexplode(F.arrays_zip("account_ids", "transaction_ids", "amounts")).alias("p", "x"))
    return zipped.select("window_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("x.account_ids").alias("account_id"), F.col("x.transaction_ids").alias("transaction_id"), F.col("x.amounts").alias("amount"))


@query("q02_existence_left_join", over(BASE, "SELECT o.ord, o.account_id, o.transaction_id, b.amount AS held_amount, b.before_balance, b.after_balance FROM o LEFT JOIN book b USING (account_id, transaction_id)"))
def existence_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = stored(spark, sf_dir).withColumnRenamed("amount", "held_amount")
    return inputs(spark, sf_dir).drop("amount").join(held, ["account_id", "transaction_id"], "left")


@query("q03_semi_join", over(BASE, "SELECT ord, account_id, amount FROM o WHERE EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = o.account_id)"))
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs(spark, sf_dir).join(accounts(spark, sf_dir), "account_id", "left_semi").select("ord", "account_id", "amount")


@query("q04_anti_join", over(BASE, "SELECT ord, account_id, amount FROM o WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = o.account_id)"))
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs(spark, sf_dir).join(accounts(spark, sf_dir), "account_id", "left_anti").select("ord", "account_id", "amount")


@query("q05_sum_by_account", over(OUT, "SELECT account_id, CAST(sum(amount) AS BIGINT) AS delta, count(*) AS rows FROM found WHERE status = 'applied' GROUP BY 1"))
def sum_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where("status = 'applied'").groupBy("account_id").agg(F.sum("amount").alias("delta"), F.count("*").alias("rows"))


@query("q06_update_returning", over(OUT, "SELECT n.account_id, n.balance AS start_balance, n.balance + CAST(coalesce(sum(f.amount), 0) AS BIGINT) AS balance, CAST(coalesce(sum(f.amount), 0) AS BIGINT) AS delta FROM now n LEFT JOIN found f ON f.account_id = n.account_id AND f.status = 'applied' GROUP BY 1, 2"))
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.posted(current(spark, sf_dir), found(spark, sf_dir))


@query("q07_before_after_chain", over(OUT, "SELECT ord, account_id, amount, before_balance, after_balance FROM found WHERE status = 'applied'"))
def before_after_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where("status = 'applied'").select("ord", "account_id", "amount", "before_balance", "after_balance")


@query("q08_insert_returning", over(OUT, "SELECT account_id, transaction_id, amount, before_balance, after_balance FROM found WHERE status = 'applied'"))
def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.new_rows(found(spark, sf_dir))


@query("q09_outcome_union", over(OUT, "SELECT * FROM found"))
def outcome_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four outcomes, each a branch of its own, together."""
    rows = found(spark, sf_dir)
    parts = [rows.where(F.col("status") == s) for s in ("applied", "existing", X.INVALID, X.UNKNOWN)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("q10_outcome_precedence", over(OUT, "SELECT status, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM found GROUP BY 1"))
def outcome_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(
    "q11_insert_ignore_update",
    over(BASE, "SELECT a.account_id, CAST(coalesce(sum(o.amount), 0) AS BIGINT) AS added, count(o.ord) AS inserted FROM accounts a LEFT JOIN o ON o.account_id = a.account_id AND NOT EXISTS (SELECT 1 FROM book b WHERE b.account_id = o.account_id AND b.transaction_id = o.transaction_id) GROUP BY 1"),
)
def insert_ignore_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = inputs(spark, sf_dir).join(stored(spark, sf_dir), ["account_id", "transaction_id"], "left_anti")
    sums = fresh.groupBy("account_id").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    return accounts(spark, sf_dir).join(sums, "account_id", "left").select("account_id", F.coalesce("s", F.lit(0)).alias("added"), F.coalesce("n", F.lit(0)).alias("inserted"))


# Every 97th account's balance, and every 89th one's expected count, is off by one.
CLAIMED = (
    AFTER
    + """, claimed AS (SELECT a.account_id, a.balance AS opening, a.balance + CAST(coalesce(sum(e.amount), 0) AS BIGINT) + CASE WHEN a.account_id % 97 = 0 THEN 1 ELSE 0 END AS balance,
  count(e.amount) + CASE WHEN a.account_id % 89 = 0 THEN 1 ELSE 0 END AS expected FROM accounts a LEFT JOIN entries e USING (account_id) GROUP BY a.account_id, a.balance),
ordered AS (SELECT account_id, amount, before_balance, after_balance, lag(after_balance) OVER w AS prev_after, row_number() OVER w AS rn, count(*) OVER (PARTITION BY account_id) AS n FROM entries WINDOW w AS (PARTITION BY account_id ORDER BY before_balance, transaction_id)),
checks AS (SELECT account_id, count(*) AS ledger_count, min(before_balance) FILTER (WHERE rn = 1) AS first_before, max(after_balance) FILTER (WHERE rn = n) AS last_after, bool_and(after_balance = before_balance + amount) AS amount_ok,
  bool_and(prev_after IS NULL OR before_balance = prev_after) AS chain_ok FROM ordered GROUP BY 1),
per AS (SELECT a.*, coalesce(c.ledger_count, 0) AS ledger_count, c.first_before, c.last_after, c.amount_ok, c.chain_ok FROM claimed a LEFT JOIN checks c USING (account_id))"""
)


@query(
    "q12_chain_verification",
    over(
        CLAIMED,
        """SELECT count(*) AS accounts, count(*) FILTER (WHERE ledger_count <> expected OR first_before <> opening OR last_after <> balance OR NOT coalesce(amount_ok, false) OR NOT coalesce(chain_ok, false)) AS bad,
  CAST(coalesce(sum(balance), 0) AS BIGINT) AS balance, CAST(coalesce(sum(ledger_count), 0) AS BIGINT) AS rows FROM per""",
    ),
)
def chain_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, entries = F.col("account_id"), everything(spark, sf_dir)
    sums = entries.groupBy("account_id").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    off = lambda m: F.when(k % m == 0, 1).otherwise(0)
    claimed = accounts(spark, sf_dir).join(sums, "account_id", "left").select(k, F.col("balance").alias("opening"), (F.col("balance") + F.coalesce("s", F.lit(0)) + off(97)).alias("balance"), (F.coalesce("n", F.lit(0)) + off(89)).alias("expected"))
    return X.verified(claimed, entries)


@query(
    "q13_distinct_verification",
    over(AFTER, "SELECT count(DISTINCT account_id) AS accounts, count(DISTINCT transaction_id) AS transactions, count(*) AS rows, min(before_balance) AS least, max(after_balance) AS most, CAST(sum(CASE WHEN after_balance <> before_balance + amount THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM entries"),
)
def distinct_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("after_balance") != F.col("before_balance") + F.col("amount"), 1).otherwise(0)
    return everything(spark, sf_dir).agg(F.countDistinct("account_id").alias("accounts"), F.countDistinct("transaction_id").alias("transactions"), F.count("*").alias("rows"), F.min("before_balance").alias("least"), F.max("after_balance").alias("most"), F.sum(bad).cast("long").alias("bad"))


@query(
    "q14_reconciliation",
    over(AFTER, "SELECT a.account_id, count(e.transaction_id) AS rows, CAST(coalesce(sum(e.amount), 0) AS BIGINT) AS amount, a.balance + CAST(coalesce(sum(e.amount), 0) AS BIGINT) AS expected FROM accounts a LEFT JOIN entries e ON e.account_id = a.account_id GROUP BY a.account_id, a.balance ORDER BY 1"),
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = everything(spark, sf_dir).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    rows = accounts(spark, sf_dir).join(sums, "account_id", "left")
    return rows.select("account_id", F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("s", F.lit(0)).alias("amount"), (F.col("balance") + F.coalesce("s", F.lit(0))).alias("expected")).orderBy("account_id")


@query("q15_having_count", over(BASE, "SELECT count(*) AS groups FROM (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) >= 50)"))
def having_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "nation").join(per, "n_nationkey", "left").where(F.coalesce("n", F.lit(0)) >= 50)
    return rows.agg(F.count("*").alias("groups"))


@query("q16_composite_in_list", over(BASE, "SELECT account_id, transaction_id, amount, before_balance, after_balance FROM book WHERE (account_id, transaction_id) IN (SELECT account_id, transaction_id FROM o)"))
def composite_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).join(inputs(spark, sf_dir), ["account_id", "transaction_id"], "left_semi")


@query("q17_upsert", over(OUT, "SELECT coalesce(n.account_id, f.account_id) AS account_id, coalesce(f.balance, n.balance) AS balance FROM now n FULL JOIN (SELECT account_id, arg_max(after_balance, ord) AS balance FROM found WHERE status = 'applied' GROUP BY 1) f USING (account_id)"))
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later version of each account wins."""
    old = current(spark, sf_dir).withColumn("version", F.lit(-1).cast("long"))
    new = found(spark, sf_dir).where("status = 'applied'").select("account_id", F.col("after_balance").alias("balance"), F.col("ord").alias("version"))
    return old.unionByName(new).groupBy("account_id").agg(F.max_by("balance", "version").alias("balance"))


@query("q18_insert_if_not_exists", over(BASE, "SELECT o.account_id, o.transaction_id, o.amount, b.transaction_id IS NULL AS inserted, max(o.ord) OVER (PARTITION BY o.account_id) AS head FROM o LEFT JOIN book b USING (account_id, transaction_id)"))
def insert_if_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-set by key, with the partition's shared head beside each row."""
    marks = stored(spark, sf_dir).select("account_id", "transaction_id", F.lit(False).alias("fresh"))
    rows = inputs(spark, sf_dir)
    heads = rows.groupBy("account_id").agg(F.max("ord").alias("head"))
    return rows.join(marks, ["account_id", "transaction_id"], "left").join(heads, "account_id").select("account_id", "transaction_id", "amount", F.coalesce("fresh", F.lit(True)).alias("inserted"), "head")


@query("q19_insert_or_return", over(OUT, "SELECT n.account_id, n.balance, b.transaction_id, coalesce(b.amount, o.amount) AS amount, CASE WHEN b.transaction_id IS NULL THEN 'applied' ELSE 'existing' END AS outcome FROM o JOIN now n ON n.account_id = o.account_id LEFT JOIN book b ON b.account_id = o.account_id AND b.transaction_id = o.transaction_id"))
def insert_or_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account's state beside the stored row, or the new one."""
    held = stored(spark, sf_dir).select("account_id", "transaction_id", F.col("amount").alias("held"), F.col("transaction_id").alias("t"))
    rows = inputs(spark, sf_dir).join(current(spark, sf_dir), "account_id").join(held, ["account_id", "transaction_id"], "left")
    return rows.select("account_id", "balance", F.col("t").alias("transaction_id"), F.coalesce("held", "amount").alias("amount"), F.when(F.col("t").isNull(), "applied").otherwise("existing").alias("outcome"))


@query("q20_over_limit_scan", over(BASE, "SELECT transaction_id, amount FROM o ORDER BY transaction_id LIMIT 1001"))
def over_limit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row more than the limit tells that there are more."""
    return inputs(spark, sf_dir).select("transaction_id", "amount").orderBy("transaction_id").limit(1001)


@query("q21_distinct_and_range", over(BASE, "SELECT count(DISTINCT account_id) AS accounts, count(*) FILTER (WHERE transaction_id BETWEEN 100 AND 5000) AS in_range, CAST(coalesce(sum(amount) FILTER (WHERE transaction_id BETWEEN 100 AND 5000), 0) AS BIGINT) AS amount FROM book"))
def distinct_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("transaction_id").between(100, 5000)
    per = stored(spark, sf_dir).groupBy("account_id").agg(F.count_if(inside).alias("n"), F.sum(F.when(inside, F.col("amount")).otherwise(0)).alias("s"))
    return per.agg(F.count("*").alias("accounts"), F.sum("n").alias("in_range"), F.sum("s").alias("amount"))


RETRIED = BASE + ", r AS (SELECT ord, account_id, transaction_id, amount FROM o UNION ALL SELECT ord + 1000000000, account_id, transaction_id, amount FROM o WHERE ord % 20 = 0)"


def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir)
    return rows.unionByName(rows.where("ord % 20 = 0").withColumn("ord", F.col("ord") + 1_000_000_000))


@query("q22_dedup_first", over(RETRIED, "SELECT ord, account_id, transaction_id, min(ord) OVER (PARTITION BY account_id, transaction_id) AS canonical_ord FROM r"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deduplicated(retried(spark, sf_dir)).select("ord", "account_id", "transaction_id", "canonical_ord")


@query("q23_stable_account_sort", over(BASE, "SELECT ord // 500 AS window_id, CAST(row_number() OVER (PARTITION BY ord // 500 ORDER BY account_id, ord) AS BIGINT) AS place, ord, account_id FROM o"))
def stable_account_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir).withColumn("window_id", F.floor(F.col("ord") / WINDOW).cast("long"))
    return rows.select("window_id", F.row_number().over(Window.partitionBy("window_id").orderBy("account_id", "ord")).cast("long").alias("place"), "ord", "account_id")


@query(
    "q24_outcome_bijection",
    over(
        BASE + ", answers AS (SELECT ord FROM o WHERE ord % 97 <> 0 UNION ALL SELECT ord FROM o WHERE ord % 89 = 0 UNION ALL SELECT -ord - 1 FROM o WHERE ord % 101 = 0), a AS (SELECT ord, count(*) AS n FROM answers GROUP BY 1)",
        "SELECT count(*) FILTER (WHERE a.ord IS NULL) AS missing, count(*) FILTER (WHERE o.ord IS NULL) AS unexpected, count(*) FILTER (WHERE a.n > 1) AS repeated FROM o FULL JOIN a ON a.ord = o.ord",
    ),
)
def outcome_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to rows, some of them lost, doubled or made up on purpose."""
    o = inputs(spark, sf_dir).select("ord")
    answers = o.where("ord % 97 <> 0").unionByName(o.where("ord % 89 = 0")).unionByName(o.where("ord % 101 = 0").select((-F.col("ord") - 1).alias("ord")))
    a = answers.groupBy(F.col("ord").alias("answer")).agg(F.count("*").alias("n"))
    both = o.join(a, F.col("ord") == F.col("answer"), "full")
    return both.agg(F.count_if(F.col("answer").isNull()).alias("missing"), F.count_if(F.col("ord").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"))


@query(
    "q25_replay_mismatch",
    over(
        OUT + ", source AS (SELECT * FROM found WHERE status IN ('applied', 'existing')), retry AS (SELECT ord, account_id, transaction_id, CASE WHEN ord % 40 = 0 THEN 'applied' ELSE 'existing' END AS status, amount + CASE WHEN ord % 60 = 0 THEN 1 ELSE 0 END AS amount, before_balance, after_balance FROM source WHERE ord % 20 = 0)",
        "SELECT s.ord, r.status = 'existing' AS is_existing, r.amount = s.amount AND r.before_balance = s.before_balance AND r.after_balance = s.after_balance AS is_equal FROM retry r JOIN source s USING (account_id, transaction_id)",
    ),
)
def replay_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries against their sources; some retries are spoilt on purpose."""
    source = found(spark, sf_dir).where("status in ('applied', 'existing')")
    retry = source.where("ord % 20 = 0").select(
        "account_id", "transaction_id", F.when(F.col("ord") % 40 == 0, "applied").otherwise("existing").alias("rs"), (F.col("amount") + F.when(F.col("ord") % 60 == 0, 1).otherwise(0)).alias("ra"), F.col("before_balance").alias("rb"), F.col("after_balance").alias("re")
    )
    same = (F.col("ra") == F.col("amount")) & (F.col("rb") == F.col("before_balance")) & (F.col("re") == F.col("after_balance"))
    return retry.join(source, ["account_id", "transaction_id"]).select("ord", (F.col("rs") == "existing").alias("is_existing"), same.alias("is_equal"))


@query(
    "q26_workload_windows",
    """WITH r AS (SELECT range AS id FROM range(20000)), q AS (SELECT id, id % 8 AS queue, id // 8 AS place FROM r)
SELECT queue, place // 250 AS window_id, queue % 4 AS connection, count(*) AS rows, count(*) FILTER (WHERE (place * 5) % 100 < 5) AS retries, count(*) FILTER (WHERE id % 1000 = 17) AS rejects FROM q GROUP BY 1, 2, 3""",
)
def workload_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests dealt round robin to queues, cut into windows, with retries spread evenly and a few rejects."""
    q = spark.range(20_000).select("id", F.pmod("id", F.lit(8)).alias("queue"), F.floor(F.col("id") / 8).cast("long").alias("place"))
    return q.groupBy("queue", F.floor(F.col("place") / 250).cast("long").alias("window_id"), F.pmod("queue", F.lit(4)).alias("connection")).agg(
        F.count("*").alias("rows"), F.count_if(F.pmod(F.col("place") * 5, F.lit(100)) < 5).alias("retries"), F.count_if(F.col("id") % 1000 == 17).alias("rejects")
    )


@query("q27_balance_gate", "WITH s AS (SELECT s_suppkey % 2 AS store, count(*) AS regions, CAST(sum(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaders FROM supplier GROUP BY 1) SELECT store, regions, leaders, regions / sum(regions) OVER () BETWEEN 0.4 AND 0.6 AND leaders / sum(leaders) OVER () BETWEEN 0.4 AND 0.6 AS balanced FROM s")
def balance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy(F.pmod("s_suppkey", F.lit(2)).alias("store")).agg(F.count("*").alias("regions"), F.count_if(F.col("s_suppkey") % 3 == 0).alias("leaders"))
    return s.select("store", "regions", "leaders", (X.share("regions").between(0.4, 0.6) & X.share("leaders").between(0.4, 0.6)).alias("balanced"))
