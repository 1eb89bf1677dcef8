"""Queries of the measurement operators: event types are stages, days are trials, values are durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators import metrics as M
from tidebook.plans.registry import query
from tidebook.sources.tables import table

SAMPLES = "WITH samples AS (SELECT event_id AS logical_id, event_type AS stage, strftime(ts, '%Y-%m-%d') AS trial, epoch_us(ts) AS tm, user_id, CAST(round(coalesce(value, 0) * 1000) AS BIGINT) AS duration_ns FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("logical_id"),
        F.col("event_type").alias("stage"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("trial"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("tm"),
        "user_id",
        F.round(F.coalesce("value", F.lit(0.0)) * 1000).cast("long").alias("duration_ns"),
    )


def q(n: float) -> str:
    return f"quantile_disc(duration_ns, {n})"


@query("m01_nearest_rank", SAMPLES + f" SELECT trial, stage, {q(0.5)} AS p50, {q(0.95)} AS p95, {q(0.99)} AS p99 FROM samples GROUP BY 1, 2")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quantiles(samples(spark, sf_dir), ["trial", "stage"], "duration_ns", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


_MUL = "CAST(CAST({} AS UHUGEINT) * {}::UHUGEINT % 18446744073709551616 AS UBIGINT)"
_M1, _M2 = (lambda x: _MUL.format(x, 13787848793156543929)), (lambda x: _MUL.format(x, 10723151780598845931))
_GOLD = "11400714819323198485::UHUGEINT"


def _splitmix(ctes: str, rows: str, seed: str, name: str) -> str:
    """``ctes`` and a table ``name``: ``rows`` with z, the mixed hash of the unsigned expression ``seed``."""
    first = f"{name}0 AS (SELECT *, CAST((CAST({seed} AS UHUGEINT) + {_GOLD}) % 18446744073709551616 AS UBIGINT) AS z FROM {rows})"
    steps = [f"{name}{i} AS (SELECT * REPLACE ({x} AS z) FROM {name}{i - 1})" for i, x in ((1, _M1("xor(z, z >> 30)")), (2, _M2("xor(z, z >> 27)")))]
    return ", ".join([ctes, first, *steps, f"{name} AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM {name}2)"])


STAGES = ["click", "error", "purchase", "signup", "view"]
_NUMBERED = SAMPLES + f", n AS (SELECT stage, duration_ns, row_number() OVER (PARTITION BY stage ORDER BY logical_id) AS n, list_position({STAGES!r}, stage) AS number FROM samples)"


@query(
    "m02_reservoir",
    _splitmix(_NUMBERED, "n", f"xor(CAST(n AS UBIGINT), CAST(CAST(number AS UHUGEINT) * {_GOLD} % 18446744073709551616 AS UBIGINT))", "h")
    + """, p AS (SELECT stage, duration_ns, n, CASE WHEN n <= 256 THEN n - 1 ELSE CAST(z % CAST(n AS UBIGINT) AS BIGINT) END AS place FROM h),
k AS (SELECT stage, place, arg_max(duration_ns, n) AS value FROM p WHERE place < 256 GROUP BY 1, 2), e AS (SELECT stage, count(*) AS count, avg(duration_ns) AS mean, max(duration_ns) AS max FROM samples GROUP BY 1)
SELECT * FROM k JOIN e USING (stage)""",
)
def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reservoir of 256 a stage with the exact count, mean and maximum beside it."""
    rows = samples(spark, sf_dir)
    exact = rows.groupBy("stage").agg(F.count("*").alias("count"), F.avg("duration_ns").alias("mean"), F.max("duration_ns").alias("max"))
    return M.reservoir(rows, "stage", "logical_id", "duration_ns", STAGES, 256).join(exact, "stage")


@query(
    "m03_trailing_rps",
    SAMPLES
    + ", s AS (SELECT stage, tm // 1000000 AS second, count(*) AS n FROM samples GROUP BY 1, 2) SELECT stage, second, n, "
    + ", ".join(f"CAST(sum(n) OVER (PARTITION BY stage ORDER BY second RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) / {w} AS rps_{w}" for w in (1, 10, 60))
    + " FROM s",
)
def trailing_rps(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = samples(spark, sf_dir).groupBy("stage", F.floor(F.col("tm") / 1_000_000).cast("long").alias("second")).agg(F.count("*").alias("n"))
    return M.trailing_rates(per, "second", "n", keys=["stage"])


@query("m04_stage_snapshot", SAMPLES + f" SELECT stage, count(*) AS count, avg(duration_ns) AS mean, max(duration_ns) AS max, CAST(sum(duration_ns) AS BIGINT) AS total, {q(0.5)} AS p50, {q(0.99)} AS p99 FROM samples GROUP BY 1")
def stage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    plain = rows.groupBy("stage").agg(F.count("*").alias("count"), F.avg("duration_ns").alias("mean"), F.max("duration_ns").alias("max"), M.u128_sum("duration_ns").cast("long").alias("total"))
    return M.beside(plain, M.quantiles(rows, ["stage"], "duration_ns", {"p50": 0.5, "p99": 0.99}), ["stage"])


@query(
    "m05_histogram_summary",
    SAMPLES + f" SELECT stage, count(duration_ns) AS count, min(duration_ns) AS min, max(duration_ns) AS max, avg(duration_ns) AS mean, {q(0.5)} AS p50, {q(0.95)} AS p95, {q(0.99)} AS p99, {q(0.999)} AS p999, count(*) FILTER (WHERE duration_ns > 100000) AS overflow FROM samples GROUP BY 1",
)
def histogram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(samples(spark, sf_dir), ["stage"], "duration_ns", 100_000)


@query(
    "m06_interval_sampler",
    SAMPLES + ", h AS (SELECT tm // 3600000000 AS hour, count(*) AS n, max(tm) AS tm FROM samples GROUP BY 1), c AS (SELECT hour, tm, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) AS total FROM h) SELECT hour, total, total - lag(total) OVER (ORDER BY hour) AS delta, (total - lag(total) OVER (ORDER BY hour)) * 1000000.0 / (tm - lag(tm) OVER (ORDER BY hour)) AS rate FROM c",
)
def interval_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter sampled each hour; windows run over hours, which are few."""
    h = samples(spark, sf_dir).groupBy(F.floor(F.col("tm") / 3_600_000_000).cast("long").alias("hour")).agg(F.count("*").alias("n"), F.max("tm").alias("tm"))
    w = Window.orderBy("hour")
    c = h.withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    delta = F.col("total") - F.lag("total").over(w)
    return c.select("hour", "total", delta.alias("delta"), (delta * 1_000_000.0 / (F.col("tm") - F.lag("tm").over(w))).alias("rate"))


_MIXED = (
    SAMPLES
    + """, h0 AS (SELECT user_id, logical_id, xor(CAST(user_id * 131072 AS UBIGINT), CAST(logical_id AS UBIGINT)) AS x, CAST((CAST(logical_id AS UHUGEINT) + 11400714819323198485::UHUGEINT) % 18446744073709551616 AS UBIGINT) AS y FROM samples),
h1 AS (SELECT user_id, logical_id, """
    + f"{_M1('xor(x, x >> 30)')} AS x, {_M1('xor(y, y >> 30)')} AS y FROM h0), h2 AS (SELECT user_id, logical_id, {_M2('xor(x, x >> 27)')} AS x, {_M2('xor(y, y >> 27)')} AS y FROM h1), "
    + "h3 AS (SELECT user_id, logical_id, xor(x, x >> 31) AS x, xor(y, y >> 31) AS y FROM h2) "
    + "SELECT user_id, logical_id, 'mixed' AS sample FROM h3 WHERE x % 1024 = 0 UNION ALL SELECT user_id, logical_id, 'stride' FROM h3 WHERE y % 64 = 0"
)


@query("m07_hash_sample", _MIXED)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both samples: by the hash of account and request, and with stride 64."""
    rows = samples(spark, sf_dir).select("user_id", "logical_id")
    one = M.hash_sample(rows, "user_id", "logical_id").withColumn("sample", F.lit("mixed"))
    return one.unionByName(M.hash_sample(rows, "user_id", "logical_id", 64).withColumn("sample", F.lit("stride")))


@query(
    "m08_latency_decomposition",
    "SELECT l_orderkey, l_linenumber, epoch_us(o_orderdate) AS a, epoch_us(l_shipdate) AS b, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS queued, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) - epoch_us(l_shipdate) AS handled, epoch_us(l_shipdate) < epoch_us(o_orderdate) AS backwards FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def latency_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("a"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("b"), F.col("l_quantity").cast("long").alias("n")).join(o, "l_orderkey")
    rows = rows.withColumn("c", F.col("b") + F.col("n"))
    return M.decomposed(rows, ["a", "b", "c"], ["queued", "handled"]).drop("n", "c")


@query(
    "m09_request_mix",
    _splitmix("WITH r AS (SELECT range % 100 AS account_id, range // 100 AS idx FROM range(40000))", "r", "account_id", "h")
    + """, s AS (SELECT account_id, (idx % 200 * 37 + CAST(z % 200 AS BIGINT)) % 200 AS slot FROM h)
SELECT account_id, CASE WHEN slot % 2 = 0 THEN 'credit' ELSE 'debit' END AS operation,
  CASE WHEN slot >= 10 THEN 'fresh' WHEN account_id % 2 = 0 AND slot < 5 OR account_id % 2 = 1 AND slot IN (1, 2, 3, 8, 9) THEN 'late_hit' ELSE 'late_miss' END AS class, count(*) AS n FROM s GROUP BY 1, 2, 3""",
)
def request_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.request_mix(spark, 100, 400, 5).groupBy("account_id", "operation", "class").agg(F.count("*").alias("n"))


@query("m10_pattern_workload")
def pattern_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both workloads, of 200 accounts each."""
    both = [M.pattern_workload(spark, 200, kind).withColumn("workload", F.lit(kind)) for kind in M.PATTERNS]
    return both[0].unionByName(both[1])


@query(
    "m11_distributions",
    SAMPLES + f", long AS (SELECT trial, 'duration_ns' AS metric, duration_ns FROM samples UNION ALL SELECT trial, 'user_id', user_id FROM samples) SELECT trial, metric, count(*) AS count, avg(duration_ns) AS mean, {q(0.5)} AS p50, {q(0.95)} AS p95, {q(0.99)} AS p99 FROM long GROUP BY 1, 2",
)
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = samples(spark, sf_dir).unpivot(["trial"], ["duration_ns", "user_id"], "metric", "value")
    plain = long.groupBy("trial", "metric").agg(F.count("*").alias("count"), F.avg("value").alias("mean"))
    return M.beside(plain, M.quantiles(long, ["trial", "metric"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), ["trial", "metric"])


@query("m12_shard_peaks", SAMPLES + ", h AS (SELECT user_id % 4 AS shard_id, tm // 3600000000 AS hour, count(*) AS n, max(duration_ns) AS top FROM samples GROUP BY 1, 2) SELECT shard_id, max(n) AS peak_requests, max(top) AS peak_duration FROM h GROUP BY 1")
def shard_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = samples(spark, sf_dir).groupBy(F.pmod("user_id", F.lit(4)).alias("shard_id"), F.floor(F.col("tm") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n"), F.max("duration_ns").alias("top"))
    return h.groupBy("shard_id").agg(F.max("n").alias("peak_requests"), F.max("top").alias("peak_duration"))


@query(
    "m13_artifact_reconciliation",
    SAMPLES
    + f""", claimed AS (SELECT stage, count(*) + CASE WHEN stage = 'view' THEN 1 ELSE 0 END AS sample_count, {q(0.95)} AS p95 FROM samples GROUP BY 1),
actual AS (SELECT stage, count(*) AS n, {q(0.95)} AS p95 FROM samples GROUP BY 1),
kept AS (SELECT logical_id FROM samples WHERE logical_id % 64 = 0), listed AS (SELECT logical_id FROM samples WHERE logical_id % 64 = 0 AND logical_id % 1000 <> 0 UNION ALL SELECT -1)
SELECT 'stage:' || c.stage AS item, c.sample_count = a.n AND c.p95 = a.p95 AS holds FROM claimed c JOIN actual a USING (stage)
UNION ALL SELECT 'missing', (SELECT count(*) FROM (SELECT * FROM kept EXCEPT SELECT * FROM listed)) = 0
UNION ALL SELECT 'unexpected', (SELECT count(*) FROM (SELECT * FROM listed EXCEPT SELECT * FROM kept)) = 0
UNION ALL SELECT 'routing', (SELECT bool_and(user_id % 4 BETWEEN 0 AND 3) FROM samples)""",
)
def artifact_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed figures against claimed ones, one of them wrong on purpose, and two lists of sample ids."""
    rows = samples(spark, sf_dir)
    actual = M.beside(rows.groupBy("stage").agg(F.count("*").alias("n")), M.quantiles(rows, ["stage"], "duration_ns", {"p95": 0.95}), ["stage"])
    claimed = actual.select("stage", (F.col("n") + F.when(F.col("stage") == "view", 1).otherwise(0)).alias("cn"), F.col("p95").alias("cp"))
    held = claimed.join(actual, "stage").select(F.concat(F.lit("stage:"), F.col("stage")).alias("item"), ((F.col("cn") == F.col("n")) & (F.col("cp") == F.col("p95"))).alias("holds"))
    kept = rows.where("logical_id % 64 = 0").select("logical_id")
    listed = kept.where("logical_id % 1000 <> 0").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("logical_id")))
    none = lambda df, name: df.agg((F.count("*") == 0).alias("holds")).select(F.lit(name).alias("item"), "holds")
    routing = rows.agg(F.bool_and(F.pmod("user_id", F.lit(4)).between(0, 3)).alias("holds")).select(F.lit("routing").alias("item"), "holds")
    return held.unionByName(none(kept.exceptAll(listed), "missing")).unionByName(none(listed.exceptAll(kept), "unexpected")).unionByName(routing)
