"""Offline analytics: repeats, comparisons, counter windows, as-of boundaries, saturation and campaign rules, text parsers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.metrics import beside, medians


def repeats(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median (the middle two averaged), least and greatest over repeats."""
    plain = rows.groupBy(*keys).agg(F.min(column).alias("min"), F.max(column).alias("max"))
    return beside(plain, medians(rows, keys, column), keys).select(*keys, "median", "min", "max")


def per_trial(rows: DataFrame, case: str, trial: str, inner: Column) -> DataFrame:
    """An aggregate of each trial, then its median across the trials of a case."""
    each = rows.groupBy(case, trial).agg(inner.alias("_x"))
    return beside(each.groupBy(case).agg(F.count("*").alias("trials")), medians(each, [case], "_x"), [case])


def percent_change(rows: DataFrame, key: str, case: str, value: str, base: str, other: str) -> DataFrame:
    """Per cent by which ``other`` differs from ``base`` on the same key; null if the base is 0."""
    a = rows.where(F.col(case) == base).select(key, F.col(value).alias("base"))
    b = rows.where(F.col(case) == other).select(key, F.col(value).alias("other"))
    return a.join(b, key).withColumn("percent", (F.col("other") - F.col("base")) * 100.0 / F.nullif(F.col("base"), F.lit(0)))


def counter_window(rows: DataFrame, keys: list[str], time: str, value: str, start: int, end: int, gap: int, spent: str | None = None) -> DataFrame:
    """Delta and rate of a cumulative counter in [start, end], and ``problem``, why there are none: too few samples, time
    that stands still, samples more than ``gap`` apart, or a counter that fell. With ``spent``, a cumulative time beside
    the counter, ``await`` is the time an operation took, null where there was none.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    counters = [value, *([spent] if spent else [])]
    inside = rows.where(F.col(time).between(start, end)).withColumn("_t", F.lag(time).over(w)).withColumns({f"_p_{c}": F.lag(c).over(w) for c in counters})
    fell = reduce(lambda a, b: a | b, (F.coalesce(F.col(c) < F.col(f"_p_{c}"), F.lit(False)) for c in counters))
    found = inside.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.min(time).alias("t0"), F.max(time).alias("t1"),
        F.count_if(fell).alias("resets"), F.count_if(F.col(time) - F.col("_t") > gap).alias("gaps"), *([(F.max_by(spent, time) - F.min_by(spent, time)).alias("_spent")] if spent else []),
    )
    problem = F.when(F.col("samples") < 2, "samples").when(F.col("t1") <= F.col("t0"), "time").when(F.col("gaps") > 0, "gap").when(F.col("resets") > 0, "reset")
    found = found.withColumn("problem", problem).withColumn("delta", F.when(F.col("problem").isNull(), F.col("last") - F.col("first")))
    found = found.withColumn("rate", F.col("delta") / F.nullif(F.col("t1") - F.col("t0"), F.lit(0)))
    return found.withColumn("await", F.when(F.col("delta").isNotNull(), F.col("_spent")) / F.nullif(F.col("delta"), F.lit(0))).drop("_spent") if spent else found


def snapshot_delta(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """before, after, delta and status by key of two snapshots of counters: a row that one of them lacks isn't available, a
    counter that fell has no delta."""
    rows = before.withColumnRenamed(value, "before").join(after.withColumnRenamed(value, "after"), keys, "full")
    status = F.when(F.col("before").isNull() | F.col("after").isNull(), "not_available").when(F.col("after") < F.col("before"), "reset_or_counter_decrease").otherwise("valid")
    return rows.withColumn("status", status).withColumn("delta", F.when(F.col("status") == "valid", F.col("after") - F.col("before")))


def as_of(rows: DataFrame, keys: list[str], time: str, value: str, start: int, end: int, complete: int | None = None) -> DataFrame:
    """Counter values at or before both ends, over times that hold all ``complete`` series; null after a reset or without a sample."""
    if complete:
        full = rows.groupBy(time).agg(F.count("*").alias("_n")).where(F.col("_n") == complete).select(time)
        rows = rows.join(full, time, "left_semi")
    at = lambda t: F.max_by(F.when(F.col(time) <= t, F.col(value)), F.when(F.col(time) <= t, F.col(time)))
    found = rows.groupBy(*keys).agg(at(start).alias("at_start"), at(end).alias("at_end"))
    return found.withColumn("delta", F.when(F.col("at_end") >= F.col("at_start"), F.col("at_end") - F.col("at_start")))


def bracketed(rows: DataFrame, keys: list[str], time: str, value: str, start: int, end: int, within: int) -> DataFrame:
    """The last sample at or before the start and the first at or after the end, if both lie ``within`` of them."""
    before, after = F.col(time) <= start, F.col(time) >= end
    found = rows.groupBy(*keys).agg(
        F.max(F.when(before, F.col(time))).alias("t0"), F.max_by(F.when(before, F.col(value)), F.when(before, F.col(time))).alias("v0"),
        F.min(F.when(after, F.col(time))).alias("t1"), F.min_by(F.when(after, F.col(value)), F.when(after, F.col(time))).alias("v1"),
    )
    near = (F.lit(start) - F.col("t0") <= within) & (F.col("t1") - F.lit(end) <= within)
    return found.withColumn("delta", F.when(near, F.col("v1") - F.col("v0")))


def saturation(curve: DataFrame, keys: list[str], x: str, y: str, share: float = 0.95, ended: str | None = None) -> DataFrame:
    """The least x whose y reaches ``share`` of the curve's maximum, with ``label``: whether that is the last x of the grid,
    or, with ``ended`` (why the curve's series ended, one value a curve), whether the range was cut short."""
    top = curve.groupBy(*keys).agg(F.max(y).alias("top"), F.max(x).alias("last_x"), *([F.first(ended).alias("_ended")] if ended else [F.lit(None).cast("string").alias("_ended")]))
    near = curve.join(top, keys).where(F.col(y) >= F.col("top") * share)
    found = near.groupBy(*keys, "top", "last_x", "_ended").agg(F.min(x).alias("x"))
    if ended:
        label = F.when(F.col("_ended").isin("failure-limit", "cap"), "observed-range").otherwise("saturation point")
    else:
        label = F.when(F.col("x") == F.col("last_x"), "observed-grid saturation").otherwise("saturation point")
    return found.select(*keys, "x", "top", label.alias("label"))


def effective(attempts: DataFrame, keys: list[str], role: str, status: str, order: str) -> DataFrame:
    """The latest ok primary of each key. Its latest rerun replaces it if that is ok, whenever it ran; if not, ``note`` says so."""
    row = F.struct(*(c for c in attempts.columns if c not in keys))
    latest = lambda x: F.max_by(F.when(x, row), F.when(x, F.col(order)))
    found = attempts.groupBy(*keys).agg(latest((F.col(role) == "primary") & (F.col(status) == "ok")).alias("_p"), latest(F.col(role) != "primary").alias("_r")).where(F.col("_p").isNotNull())
    good = F.coalesce(F.col(f"_r.{status}") == "ok", F.lit(False))
    note = F.when(F.col("_r").isNotNull() & ~good, "flush>2ms, rerun failed")
    return found.select(*keys, F.when(good, F.col("_r")).otherwise(F.col("_p")).alias("_x"), note.alias("note")).select(*keys, "_x.*", "note")


def stop_points(curve: DataFrame, keys: list[str], x: str, y: str, gain: float = 1.05) -> DataFrame:
    """The first point that ends two in a row below ``gain`` times the best before them."""
    w = Window.partitionBy(*keys).orderBy(x)
    best = F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flat = curve.withColumn("_flat", F.coalesce(F.col(y) < best * gain, F.lit(False)))
    twice = flat.withColumn("_both", F.col("_flat") & F.coalesce(F.lag("_flat").over(w), F.lit(False)))
    return twice.where("_both").groupBy(*keys).agg(F.min(x).alias("stop_x"))


def onset(curve: DataFrame, keys: list[str], x: str, y: str, gain: float = 0.05) -> DataFrame:
    """The first point after which two steps, each of which doubles x, gain less than ``gain`` each."""
    w = Window.partitionBy(*keys).orderBy(x)
    at = lambda c, n: F.lead(c, n).over(w)
    flat = (at(y, 1) < F.col(y) * (1 + gain)) & (at(y, 2) < at(y, 1) * (1 + gain))
    doubled = (at(x, 1) == 2 * F.col(x)) & (at(x, 2) == 4 * F.col(x))
    return curve.withColumn("_f", flat & doubled).where("_f").groupBy(*keys).agg(F.min(x).alias("onset_x"))


def cause(failure: Column, invalid: Column, cleanup: Column) -> Column:
    """Why an attempt failed, by its texts."""
    text = F.lower(F.concat_ws(" ", failure, invalid))
    memory = text.contains("8176") | text.contains("memory") | text.contains("oom")
    residue = F.coalesce((cleanup != "") & (cleanup != "success"), F.lit(False))
    return F.when(residue, "cleanup residue").when(memory, "memory (8176)").when(text.contains("timeout"), "timeout").when(text.contains("sampler"), "sampler").otherwise("other")


# Pieces of metric names by what they are evidence of.
CATEGORIES = {
    "reactor_cpu": ("reactor_utilization", "reactor_cpu"),
    "latency": ("coordinator_write_latency", "write_latency", "request_latency"),
    "cache": ("cache_memory", "cache_hit", "cache_requests"),
    "flush": ("memtable_flush", "flushes"),
    "compaction": ("compaction",),
    "commitlog_sync": ("commitlog_sync", "scylla_commitlog_flush"),
    "backlog": ("queue_length", "backlog", "pending_tasks", "pending_flushes"),
    "errors": ("write_errors", "read_errors", "request_errors", "dropped_mutations"),
    "timeouts": ("write_timeouts", "read_timeouts", "request_timeouts"),
    "network": ("transport_server", "network_bytes", "network_packets"),
}


def categories(name: Column) -> Column:
    """The categories of a metric's name, an array; pieces are matched by containment, so no join is needed."""
    has = lambda pieces: reduce(lambda a, b: a | b, (F.lower(name).contains(p) for p in pieces))
    return F.array_compact(F.array(*(F.when(has(pieces), F.lit(c)) for c, pieces in CATEGORIES.items())))


def labelled_samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Exposition text lines as name, labels (a map) and value; comments and other lines go."""
    shape = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)$"
    rows = lines.where(F.col(column).rlike(shape))
    part = lambda i: F.regexp_extract(column, shape, i)
    inner = F.regexp_replace(part(2), '"', "")
    return rows.select("*", part(1).alias("name"), F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(inner, F.lit(","), F.lit("="))).alias("labels"), part(3).cast("double").alias("sample"))


def key_values(lines: DataFrame, column: str, pair: str = " ", by: str = "=") -> DataFrame:
    """Lines of ``key=value`` words as a map."""
    return lines.withColumn("fields", F.str_to_map(column, F.lit(pair), F.lit(by)))


def weighted_mean(x: str, w: str) -> Column:
    return F.sum(F.col(x) * F.col(w)) / F.nullif(F.sum(w), F.lit(0))
