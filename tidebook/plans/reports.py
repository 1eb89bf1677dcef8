"""Queries of the offline analytics, over events as samples, and orders and line items as trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators import reports as R
from tidebook.plans.metrics import SAMPLES, samples
from tidebook.plans.registry import query
from tidebook.sources.tables import table

START, END = 1_705_000_000_000_000, 1_706_000_000_000_000

# A cumulative counter per event type, sampled at each event; series fall back to 0 with every 100th sample of 'view'.
COUNTERS = SAMPLES + """, n AS (SELECT stage, tm, logical_id, row_number() OVER (PARTITION BY stage ORDER BY logical_id) AS k FROM samples),
counters AS (SELECT stage AS series, tm, CASE WHEN stage = 'view' THEN k % 500 ELSE k END AS value FROM n)"""

# A throughput curve per nation: x is the rank of a customer's segment, y grows and flattens.
CURVE = """WITH t AS (SELECT c_nationkey AS nation, c_custkey % 8 + 1 AS x, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1, 2),
curve AS (SELECT nation, x, CAST(round(sqrt(x) * 1000) AS BIGINT) + CAST(n AS BIGINT) * 10 AS y FROM t)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("stage").orderBy("logical_id")).cast("long")
    rows = samples(spark, sf_dir).withColumn("k", k)
    return rows.select(F.col("stage").alias("series"), "tm", F.when(F.col("stage") == "view", F.col("k") % 500).otherwise(F.col("k")).alias("value"))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 8 + 1).alias("x")).agg(F.count("*").alias("n"))
    return t.select("nation", "x", (F.round(F.sqrt("x") * 1000).cast("long") + F.col("n") * 10).alias("y"))


@query("a01_repeat_medians", SAMPLES + " SELECT stage, CAST(median(duration_ns) AS DOUBLE) AS median, min(duration_ns) AS min, max(duration_ns) AS max FROM samples GROUP BY 1")
def repeat_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeats(samples(spark, sf_dir), ["stage"], "duration_ns")


@query(
    "a02_percent_difference",
    SAMPLES + ", m AS (SELECT trial, stage, CAST(median(duration_ns) AS DOUBLE) AS v FROM samples GROUP BY 1, 2) SELECT a.trial, a.v AS base, b.v AS other, (b.v - a.v) * 100.0 / nullif(a.v, 0) AS percent FROM m a JOIN m b ON a.trial = b.trial AND a.stage = 'view' AND b.stage = 'click'",
)
def percent_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.repeats(samples(spark, sf_dir), ["trial", "stage"], "duration_ns")
    return R.percent_change(m, "trial", "stage", "median", "view", "click")


@query("a03_regex_explode", """WITH t AS (SELECT event_id, 'cpu' || event_id % 4 || '=' || user_id || ' cpu' || (event_id % 4 + 1) || '=' || event_id % 100 AS line FROM events), x AS (SELECT event_id, unnest(regexp_extract_all(line, 'cpu\\d+=\\d+')) AS p FROM t) SELECT event_id, CAST(regexp_extract(p, 'cpu(\\d+)', 1) AS INTEGER) AS core, CAST(regexp_extract(p, '=(\\d+)', 1) AS BIGINT) AS busy FROM x""")
def regex_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("cpu"), F.col("event_id") % 4, F.lit("="), "user_id", F.lit(" cpu"), F.col("event_id") % 4 + 1, F.lit("="), F.col("event_id") % 100)
    parts = table(spark, sf_dir, "events").select("event_id", F.explode(F.regexp_extract_all(line, F.lit(r"cpu\d+=\d+"), 0)).alias("p"))
    return parts.select("event_id", F.regexp_extract("p", r"cpu(\d+)", 1).cast("int").alias("core"), F.regexp_extract("p", r"=(\d+)", 1).cast("long").alias("busy"))


@query("a04_hottest", SAMPLES + ", u AS (SELECT trial, user_id, count(*) AS n FROM samples GROUP BY 1, 2) SELECT trial, arg_max(user_id, {'n': n, 'u': -user_id}) AS hottest, max(n) AS n FROM u GROUP BY 1")
def hottest(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = samples(spark, sf_dir).groupBy("trial", "user_id").agg(F.count("*").alias("n"))
    return u.groupBy("trial").agg(F.max_by("user_id", F.struct("n", F.negative("user_id"))).alias("hottest"), F.max("n").alias("n"))


@query("a05_first_last_delta", COUNTERS + f" SELECT series, arg_min(value, tm) AS first, arg_max(value, tm) AS last, greatest(arg_max(value, tm) - arg_min(value, tm), 0) AS delta, greatest(arg_max(value, tm) - arg_min(value, tm), 0) * 100.0 / {END - START} AS percent FROM counters WHERE tm BETWEEN {START} AND {END} GROUP BY 1")
def first_last_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counters(spark, sf_dir).where(F.col("tm").between(START, END)).groupBy("series").agg(F.min_by("value", "tm").alias("first"), F.max_by("value", "tm").alias("last"))
    delta = F.greatest(F.col("last") - F.col("first"), F.lit(0))
    return rows.select("series", "first", "last", delta.alias("delta"), (delta * 100.0 / F.lit(END - START)).alias("percent"))


@query("a06_nonzero_occupancy", SAMPLES + " SELECT stage, avg(CASE WHEN duration_ns % 5 <> 0 THEN 100.0 ELSE 0.0 END) AS occupied FROM samples GROUP BY 1")
def nonzero_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("stage").agg(F.avg(F.when(F.col("duration_ns") % 5 != 0, F.lit(100.0)).otherwise(0.0)).alias("occupied"))


@query("a07_max_then_median", SAMPLES + ", x AS (SELECT stage, trial, max(duration_ns) AS v FROM samples GROUP BY 1, 2) SELECT stage, CAST(median(v) AS DOUBLE) AS median, count(*) AS trials FROM x GROUP BY 1")
def max_then_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_trial(samples(spark, sf_dir), "stage", "trial", F.max("duration_ns"))


@query("a08_sum_then_median", SAMPLES + ", x AS (SELECT stage, trial, sum(duration_ns) AS v FROM samples GROUP BY 1, 2) SELECT stage, CAST(median(v) AS DOUBLE) AS median, count(*) AS trials FROM x GROUP BY 1")
def sum_then_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_trial(samples(spark, sf_dir), "stage", "trial", F.sum("duration_ns"))


@query("a09_pivot_ratio", SAMPLES + " SELECT trial, count(*) FILTER (WHERE stage = 'click') AS click, count(*) FILTER (WHERE stage = 'error') AS error, count(*) FILTER (WHERE stage = 'error') / nullif(count(*) FILTER (WHERE stage = 'click'), 0) AS ratio FROM samples GROUP BY 1")
def pivot_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = samples(spark, sf_dir).groupBy("trial").pivot("stage", ["click", "error"]).agg(F.count(F.lit(1))).fillna(0, ["click", "error"])
    return p.withColumn("ratio", F.col("error") / F.nullif(F.col("click"), F.lit(0)))


GAP = 4 * 3_600_000_000
_WINDOW = COUNTERS + f""", w AS (SELECT *, tm // 7 AS spent, lag(value) OVER (PARTITION BY series ORDER BY tm) AS p, lag(tm) OVER (PARTITION BY series ORDER BY tm) AS q FROM counters WHERE tm BETWEEN {START} AND {END}),
g AS (SELECT series, count(*) AS samples, arg_min(value, tm) AS first, arg_max(value, tm) AS last, min(tm) AS t0, max(tm) AS t1, count(*) FILTER (WHERE value < p) AS resets, count(*) FILTER (WHERE tm - q > {GAP}) AS gaps, arg_max(spent, tm) - arg_min(spent, tm) AS spent FROM w GROUP BY 1),
p AS (SELECT *, CASE WHEN samples < 2 THEN 'samples' WHEN t1 <= t0 THEN 'time' WHEN gaps > 0 THEN 'gap' WHEN resets > 0 THEN 'reset' END AS problem FROM g), d AS (SELECT *, CASE WHEN problem IS NULL THEN last - first END AS delta FROM p)"""


@query("a10_counter_window", _WINDOW + ' SELECT * EXCLUDE (spent), delta / nullif(t1 - t0, 0) AS rate, CASE WHEN delta IS NOT NULL THEN spent END / nullif(delta, 0) AS "await" FROM d')
def counter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counters(spark, sf_dir).withColumn("spent", F.floor(F.col("tm") / 7))
    return R.counter_window(rows, ["series"], "tm", "value", START, END, GAP, "spent")


@query(
    "a11_labelled_series",
    SAMPLES
    + f""", s AS (SELECT stage, user_id % 3 AS label, tm, duration_ns, row_number() OVER (PARTITION BY stage, user_id % 3 ORDER BY logical_id) AS ops, CAST(sum(duration_ns) OVER (PARTITION BY stage, user_id % 3 ORDER BY logical_id) AS BIGINT) AS spent FROM samples),
g AS (SELECT stage, label, arg_max(ops, tm) - arg_min(ops, tm) AS ops, arg_max(spent, tm) - arg_min(spent, tm) AS spent FROM s WHERE tm BETWEEN {START} AND {END} GROUP BY 1, 2)
SELECT stage, count(*) AS labels, CAST(sum(ops) AS BIGINT) AS ops, sum(spent) / nullif(sum(ops), 0) AS mean_delay FROM g GROUP BY 1""",
)
def labelled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stage", "label").orderBy("logical_id").rowsBetween(Window.unboundedPreceding, 0)
    s = samples(spark, sf_dir).withColumn("label", F.pmod("user_id", F.lit(3))).withColumn("ops", F.count("*").over(w)).withColumn("spent", F.sum("duration_ns").over(w))
    d = lambda c: (F.max_by(c, "tm") - F.min_by(c, "tm")).alias(c)
    g = s.where(F.col("tm").between(START, END)).groupBy("stage", "label").agg(d("ops"), d("spent"))
    return g.groupBy("stage").agg(F.count("*").alias("labels"), F.sum("ops").alias("ops"), (F.sum("spent") / F.nullif(F.sum("ops"), F.lit(0))).alias("mean_delay"))


# Hourly samples of each series; an hour that lacks a series is incomplete.
HOURLY = COUNTERS + ", hourly AS (SELECT series, tm // 3600000000 AS hour, max(value) AS value FROM counters WHERE series <> 'view' GROUP BY 1, 2)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(spark, sf_dir).where("series <> 'view'").groupBy("series", F.floor(F.col("tm") / 3_600_000_000).cast("long").alias("hour")).agg(F.max("value").alias("value"))


H0, H1 = START // 3_600_000_000, END // 3_600_000_000


@query(
    "a12_as_of_boundaries",
    HOURLY
    + f""", f AS (SELECT hour FROM hourly GROUP BY 1 HAVING count(*) = 4), h AS (SELECT * FROM hourly SEMI JOIN f USING (hour)),
g AS (SELECT series, arg_max(value, hour) FILTER (WHERE hour <= {H0}) AS at_start, arg_max(value, hour) FILTER (WHERE hour <= {H1}) AS at_end FROM h GROUP BY 1) SELECT *, CASE WHEN at_end >= at_start THEN at_end - at_start END AS delta FROM g""",
)
def as_of_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_of(hourly(spark, sf_dir), ["series"], "hour", "value", H0, H1, complete=4)


@query(
    "a13_bracketing",
    COUNTERS
    + f""", g AS (SELECT series, max(tm) FILTER (WHERE tm <= {START}) AS t0, arg_max(value, tm) FILTER (WHERE tm <= {START}) AS v0, min(tm) FILTER (WHERE tm >= {END}) AS t1, arg_min(value, tm) FILTER (WHERE tm >= {END}) AS v1 FROM counters GROUP BY 1)
SELECT *, CASE WHEN {START} - t0 <= 1800000000 AND t1 - {END} <= 1800000000 THEN v1 - v0 END AS delta FROM g""",
)
def bracketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bracketed(counters(spark, sf_dir), ["series"], "tm", "value", START, END, 1_800_000_000)


SNAPSHOTS = SAMPLES + ", a AS (SELECT stage, user_id % 7 AS object, count(*) AS v FROM samples WHERE logical_id % 3 <> 0 AND user_id % 7 <> 3 GROUP BY 1, 2), b AS (SELECT stage, user_id % 7 AS object, count(*) AS v FROM samples WHERE user_id % 7 <> 5 OR logical_id % 9 = 0 GROUP BY 1, 2)"


@query(
    "a14_snapshot_delta",
    SNAPSHOTS
    + """ SELECT stage, object, a.v AS before, b.v AS after, CASE WHEN a.v IS NOT NULL AND b.v >= a.v THEN b.v - a.v END AS delta,
  CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'not_available' WHEN b.v >= a.v THEN 'valid' ELSE 'reset_or_counter_decrease' END AS status FROM a FULL JOIN b USING (stage, object)""",
)
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("object", F.pmod("user_id", F.lit(7)))
    a = s.where("logical_id % 3 <> 0 and object <> 3").groupBy("stage", "object").agg(F.count("*").alias("v"))
    b = s.where("object <> 5 or logical_id % 9 = 0").groupBy("stage", "object").agg(F.count("*").alias("v"))
    return R.snapshot_delta(a, b, ["stage", "object"], "v")


@query(
    "a15_socket_difference",
    SAMPLES + ", a AS (SELECT DISTINCT user_id, stage FROM samples WHERE logical_id % 2 = 0), b AS (SELECT DISTINCT user_id, stage FROM samples WHERE logical_id % 3 = 0) SELECT 'gone' AS side, user_id, stage FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', user_id, stage FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
)
def socket_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    a, b = s.where("logical_id % 2 = 0").select("user_id", "stage"), s.where("logical_id % 3 = 0").select("user_id", "stage")
    return a.subtract(b).select(F.lit("gone").alias("side"), "*").unionByName(b.subtract(a).select(F.lit("new").alias("side"), "*"))


@query(
    "a16_exposition_parse",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '# HELP requests_total' WHEN event_id % 10 = 1 THEN 'up 1' ELSE 'requests_total{stage="' || event_type || '",user="' || user_id || '"} ' || event_id END AS line FROM events)
SELECT event_id, regexp_extract(line, '^([a-zA-Z_:][a-zA-Z0-9_:]*)', 1) AS name, CASE WHEN line LIKE '%{%' THEN regexp_extract(line, 'stage="([^"]*)"', 1) END AS stage, CAST(regexp_extract(line, '(\\S+)$', 1) AS DOUBLE) AS sample FROM t WHERE line NOT LIKE '#%'""",
)
def exposition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 10 == 0, "# HELP requests_total").when(F.col("event_id") % 10 == 1, "up 1").otherwise(F.concat(F.lit('requests_total{stage="'), "event_type", F.lit('",user="'), "user_id", F.lit('"} '), "event_id"))
    parsed = R.labelled_samples(table(spark, sf_dir, "events").select("event_id", line.alias("value")))
    return parsed.select("event_id", "name", F.col("labels")["stage"].alias("stage"), "sample")


@query("a17_key_value_parse", "SELECT event_id, CAST(event_id % 512 AS BIGINT) AS rbytes, CAST(user_id AS BIGINT) AS wbytes FROM events")
def key_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter lines of the form ``rbytes=.. wbytes=..`` written and read again."""
    line = F.concat(F.lit("rbytes="), F.col("event_id") % 512, F.lit(" wbytes="), "user_id")
    parsed = R.key_values(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line")
    return parsed.select("event_id", F.col("fields")["rbytes"].cast("long").alias("rbytes"), F.col("fields")["wbytes"].cast("long").alias("wbytes"))


@query("a18_time_weighted_mean", SAMPLES + ", d AS (SELECT stage, duration_ns, tm - lag(tm) OVER (PARTITION BY stage ORDER BY logical_id) AS dt FROM samples) SELECT stage, sum(duration_ns * dt) / nullif(sum(dt), 0) AS mean, count(*) AS intervals FROM d WHERE dt BETWEEN 1 AND 7200000000 GROUP BY 1")
def time_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that run backwards or over two hours are skewed clocks and go."""
    d = samples(spark, sf_dir).withColumn("dt", F.col("tm") - F.lag("tm").over(Window.partitionBy("stage").orderBy("logical_id"))).where(F.col("dt").between(1, 7_200_000_000))
    return d.groupBy("stage").agg(R.weighted_mean("duration_ns", "dt").alias("mean"), F.count("*").alias("intervals"))


_ENDED = "CASE nation % 3 WHEN 0 THEN 'cap' WHEN 1 THEN 'stop-rule' ELSE 'failure-limit' END"


@query(
    "a19_saturation_point",
    CURVE
    + f""", m AS (SELECT nation, max(y) AS top, max(x) AS largest FROM curve GROUP BY 1), s AS (SELECT c.nation, m.top, m.largest, min(c.x) AS x FROM curve c JOIN m USING (nation) WHERE c.y >= 0.95 * m.top GROUP BY ALL)
SELECT nation, x, top, CASE WHEN x = largest THEN 'observed-grid saturation' ELSE 'saturation point' END AS label, CASE WHEN {_ENDED} IN ('failure-limit', 'cap') THEN 'observed-range' ELSE 'saturation point' END AS range_label FROM s""",
)
def saturation_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labels: by the grid, and by why the series ended (made up from the nation's number)."""
    rows = curve(spark, sf_dir).withColumn("ended", F.expr(_ENDED))
    ranges = R.saturation(rows, ["nation"], "x", "y", ended="ended").select("nation", F.col("label").alias("range_label"))
    return R.saturation(rows, ["nation"], "x", "y").join(ranges, "nation")


ATTEMPTS = "WITH a AS (SELECT o_custkey % 200 AS point, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'flush_rerun' ELSE 'primary' END AS role, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status FROM orders)"


@query(
    "a20_effective_row",
    ATTEMPTS
    + """, g AS (SELECT point, max(ord) FILTER (WHERE role = 'primary' AND status = 'ok') AS p, max(ord) FILTER (WHERE role = 'flush_rerun') AS r, arg_max(status, ord) FILTER (WHERE role = 'flush_rerun') AS s FROM a GROUP BY 1)
SELECT point, CASE WHEN s = 'ok' THEN 'flush_rerun' ELSE 'primary' END AS role, CASE WHEN s = 'ok' THEN r ELSE p END AS ord, CASE WHEN s <> 'ok' THEN 'flush>2ms, rerun failed' END AS note FROM g WHERE p IS NOT NULL""",
)
def effective_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("point"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, "flush_rerun").otherwise("primary").alias("role"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"))
    return R.effective(a, ["point"], "role", "status", "ord").select("point", "role", "ord", "note")


@query(
    "a21_stop_rule",
    CURVE + ", f AS (SELECT *, coalesce(y < 1.2 * max(y) OVER (PARTITION BY nation ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS flat FROM curve), g AS (SELECT *, flat AND coalesce(lag(flat) OVER (PARTITION BY nation ORDER BY x), false) AS both_ FROM f) SELECT nation, min(x) AS stop_x FROM g WHERE both_ GROUP BY 1",
)
def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stop_points(curve(spark, sf_dir), ["nation"], "x", "y", 1.2)


@query("a22_plateau_onset", CURVE + ", f AS (SELECT a.nation, a.x FROM curve a JOIN curve b ON b.nation = a.nation AND b.x = 2 * a.x JOIN curve c ON c.nation = a.nation AND c.x = 4 * a.x WHERE a.x IN (1, 2) AND b.y < a.y * 1.42 AND c.y < b.y * 1.42) SELECT nation, min(x) AS onset_x FROM f GROUP BY 1")
def plateau_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the settings 1, 2, 4 and 8."""
    return R.onset(curve(spark, sf_dir).where(F.col("x").isin(1, 2, 4, 8)), ["nation"], "x", "y", 0.42)


@query("a23_smallest_within", CURVE + ", b AS (SELECT nation, max(y) AS best FROM curve GROUP BY 1) SELECT nation, min(x) AS x, any_value(best) AS top FROM curve JOIN b USING (nation) WHERE y >= best * 0.9 GROUP BY 1")
def smallest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.saturation(curve(spark, sf_dir), ["nation"], "x", "y", 0.9).drop("label")


@query("a24_ratio_and_dips", CURVE + ", z AS (SELECT x, y AS base FROM curve WHERE nation = 0) SELECT nation, min(y / base) AS least, max(y / base) AS most, count(*) FILTER (WHERE y < 0.97 * prev) AS dips FROM (SELECT *, lag(y) OVER (PARTITION BY nation ORDER BY x) AS prev FROM curve) JOIN z USING (x) GROUP BY 1")
def ratio_and_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curve(spark, sf_dir)
    base = c.where("nation = 0").select("x", F.col("y").alias("base"))
    rows = c.withColumn("prev", F.lag("y").over(Window.partitionBy("nation").orderBy("x"))).join(base, "x")
    return rows.groupBy("nation").agg(F.min(F.col("y") / F.col("base")).alias("least"), F.max(F.col("y") / F.col("base")).alias("most"), F.count_if(F.col("y") < 0.97 * F.col("prev")).alias("dips"))


@query("a25_replicate_delta", CURVE + " SELECT a.x, a.y AS first, b.y AS second, abs(b.y - a.y) * 100.0 / a.y AS percent, abs(b.y - a.y) * 100.0 / a.y > 10 AS flagged FROM curve a JOIN curve b ON a.x = b.x AND a.nation = 1 AND b.nation = 2")
def replicate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curve(spark, sf_dir)
    a, b = c.where("nation = 1").select("x", F.col("y").alias("first")), c.where("nation = 2").select("x", F.col("y").alias("second"))
    percent = F.abs(F.col("second") - F.col("first")) * 100.0 / F.col("first")
    return a.join(b, "x").select("x", "first", "second", percent.alias("percent"), (percent > 10).alias("flagged"))


_FAILURE = "CASE p_partkey % 5 WHEN 0 THEN 'OOM killed' WHEN 1 THEN 'Request Timeout' WHEN 2 THEN concat(p_name, ' sampler lost') WHEN 3 THEN p_name END"
_INVALID = "CASE p_partkey % 7 WHEN 0 THEN 'exit 8176' WHEN 1 THEN 'sampler and timeout' ELSE '' END"
_CLEANUP = "CASE p_partkey % 11 WHEN 0 THEN 'partial' WHEN 1 THEN '' ELSE 'success' END"


@query(
    "a26_cause_classification",
    f"""WITH t AS (SELECT p_partkey, lower(concat_ws(' ', {_FAILURE}, {_INVALID})) AS x, {_CLEANUP} AS c FROM part)
SELECT p_partkey, CASE WHEN c NOT IN ('', 'success') THEN 'cleanup residue' WHEN regexp_matches(x, '8176|memory|oom') THEN 'memory (8176)' WHEN x LIKE '%timeout%' THEN 'timeout' WHEN x LIKE '%sampler%' THEN 'sampler' ELSE 'other' END AS cause FROM t""",
)
def cause_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", R.cause(F.expr(_FAILURE), F.expr(_INVALID), F.expr(_CLEANUP)).alias("cause"))


_PIECES = [(c, p) for c, pieces in R.CATEGORIES.items() for p in pieces]
_NAMES = ["scylla_reactor_utilization", "Coordinator_Write_Latency_sum", "cache_hit_pending_tasks", "memtable_flushes", "compaction_backlog", "scylla_commitlog_flush", "storage_write_errors", "read_timeouts_total", "transport_server_bytes", "uptime"]


@query(
    "a27_name_categories",
    f"WITH n AS (SELECT p_partkey, concat(p_name, '_', {_NAMES!r}[p_partkey % 10 + 1]) AS name FROM part), c(category, piece) AS (VALUES {', '.join(map(str, _PIECES))}) SELECT DISTINCT p_partkey, category FROM n JOIN c ON contains(lower(name), piece)",
)
def name_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("_"), F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("p_partkey") % 10 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(R.categories(name)).alias("category"))


@query("a28_durability", "SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS writes, CAST(sum(l_quantity) AS BIGINT) + count(*) FILTER (WHERE l_linenumber = 7) AS syncs, abs(count(*) FILTER (WHERE l_linenumber = 7)) <= 0.01 * CAST(sum(l_quantity) AS BIGINT) AS agree FROM lineitem GROUP BY 1")
def durability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write and sync deltas; they must agree within one per cent."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").cast("long").alias("writes"), F.count_if(F.col("l_linenumber") == 7).alias("more"))
    syncs = F.col("writes") + F.col("more")
    return g.select("l_returnflag", "writes", syncs.alias("syncs"), (F.abs(syncs - F.col("writes")) <= 0.01 * F.col("writes")).alias("agree"))


@query("a29_expected_windows", "SELECT range AS batch, CAST(80 * ceil(7840 / range) + 176 * ceil(7800 / range) AS BIGINT) AS windows FROM range(1, 8001)")
def expected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("id")
    return spark.range(1, 8001).select(b.alias("batch"), (80 * F.ceil(7840 / b) + 176 * F.ceil(7800 / b)).cast("long").alias("windows"))

