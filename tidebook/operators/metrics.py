"""Measurement operators: exact quantiles, reservoirs, rates, samplers, latency parts and workload patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.ordering import running_sum

RESERVOIR, RANGE = 4096, 1_000_000


def nearest_rank(column: str, q: float) -> Column:
    """The value of rank ceil(q * n); null for no values. Exact: no interpolation."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def at_ranks(rows: DataFrame, keys: list[str], column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Of each group the values of whole-number ``column`` at the ranks that functions of the group's count n name.

    Equal values are counted first and ranked by prefix sums over ranges of values, so no task holds or sorts a group,
    whatever its size: a task sees at most RANGE values, or as many ranges as a group's values occupy. Groups without a
    value have no row.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_n")
    placed = running_sum(counts, keys, column, F.col("_c"), "_upto", RANGE, dense=True).join(totals, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= rank(F.col("_n")), F.col(column))).alias(name) for name, rank in ranks.items()))


def quantiles(rows: DataFrame, keys: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles of each group: the value of rank ceil(q * n)."""
    return at_ranks(rows, keys, column, {name: (lambda n, q=q: F.greatest(F.ceil(F.lit(q) * n), F.lit(1))) for name, q in wanted.items()})


def medians(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The median of each group, the middle two averaged."""
    two = at_ranks(rows, keys, column, {"_a": lambda n: F.floor((n + 1) / 2), "_b": lambda n: F.floor(n / 2) + 1})
    return two.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``right`` beside those of ``left`` with the same keys, null ones included."""
    renamed = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*(f"_k_{k}" for k in keys))


def summary(rows: DataFrame, keys: list[str], column: str, overflow: int = 600_000_000_000) -> DataFrame:
    """count, min, max, mean, p50, p95, p99, p999 and how many exceed ``overflow``."""
    plain = rows.groupBy(*keys).agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.count_if(F.col(column) > overflow).alias("overflow"))
    return beside(plain, quantiles(rows, keys, column, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}), keys)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with wrap-around."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(x + np.uint64(0x9E3779B97F4A7C15))


def hash_sample(rows: DataFrame, account: str, request: str, stride: int | None = None) -> DataFrame:
    """About one row in 1,024 by the mixed hash of account and request, or one in ``stride`` by the request alone.

    The hashes wrap at 64 bits, which SQL arithmetic refuses to do; they are computed on whole Arrow batches.
    """

    @F.pandas_udf("boolean")
    def picked(a: pd.Series, r: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.int64).view(np.uint64), r.to_numpy(np.int64).view(np.uint64)
        if stride:
            return pd.Series(splitmix64(y) % np.uint64(stride) == 0)
        turned = (x << np.uint64(17)) | (x >> np.uint64(47))
        return pd.Series((mix64(turned ^ y) & np.uint64(0x3FF)) == 0)

    return rows.where(picked(F.col(account).cast("long"), F.col(request).cast("long")))


def reservoir(rows: DataFrame, stage: str, order: str, value: str, stages: list[str], size: int = RESERVOIR) -> DataFrame:
    """A deterministic reservoir of each stage: stage, place, value. The first ``size`` values fill it; the nth after them
    takes the place that the mixed hash of n and the stage's number (its place in ``stages``) chooses among n, if there is one.

    A place holds the last value that took it, so values are numbered by prefix sums and no fold is needed.
    """

    @F.pandas_udf("long")
    def chosen(n: pd.Series, number: pd.Series) -> pd.Series:
        counts = n.to_numpy(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return pd.Series((splitmix64(counts ^ (number.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % counts).astype(np.int64))

    number = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col(stage)).cast("long")
    counted = running_sum(rows.where(F.col(stage).isin(stages)).select(stage, order, value), [stage], order, F.lit(1), "_n")
    placed = counted.withColumn("place", F.when(F.col("_n") <= size, F.col("_n") - 1).otherwise(chosen("_n", number)))
    return placed.where(F.col("place") < size).groupBy(stage, "place").agg(F.max_by(value, "_n").alias("value"))


def trailing_rates(per_second: DataFrame, second: str, count: str, widths: tuple[int, ...] = (1, 10, 60), keys: list[str] | None = None) -> DataFrame:
    """Rates over trailing windows of seconds; the divisor is always the width."""
    w = lambda n: Window.partitionBy(*(keys or [])).orderBy(second).rangeBetween(-(n - 1), 0)
    return per_second.select("*", *((F.sum(count).over(w(n)) / n).alias(f"rps_{n}") for n in widths))


def decomposed(rows: DataFrame, points: list[str], parts: list[str]) -> DataFrame:
    """Differences of consecutive time points, and ``backwards``: some point lies before the one it follows."""
    steps = [F.col(b) - F.col(a) for a, b in zip(points, points[1:], strict=False)]
    return rows.select("*", *(x.alias(p) for x, p in zip(steps, parts, strict=True)), F.exists(F.array(*steps), lambda x: x < 0).alias("backwards"))


#: Slots of a block of the request mix, and the step that spreads them.
BLOCK, STEP = 200, 37
#: Late slots, at 5 %, that are hits for accounts with even and with odd numbers.
EVEN_HITS, ODD_HITS = (0, 1, 2, 3, 4), (1, 2, 3, 8, 9)


def request_mix(spark: SparkSession, accounts: int, per_account: int, late_percent: int) -> DataFrame:
    """account_id, idx, operation, class of a generated workload. A request's slot in its block of 200 is spread by a step
    and an offset hashed from the account. Even slots credit, odd ones debit; at 5 % the first ten slots are late, half
    of them hits; at any other share none is."""

    @F.pandas_udf("long")
    def offset(account: pd.Series) -> pd.Series:
        return pd.Series((splitmix64(account.to_numpy(np.int64).view(np.uint64)) % np.uint64(BLOCK)).astype(np.int64))

    r = spark.range(accounts * per_account).select((F.col("id") % accounts).alias("account_id"), F.floor(F.col("id") / accounts).cast("long").alias("idx"))
    slot = F.pmod(F.col("idx") % BLOCK * STEP + offset("account_id"), F.lit(BLOCK))
    r = r.withColumn("slot", slot)
    hit = F.when(F.col("account_id") % 2 == 0, F.col("slot").isin(*EVEN_HITS)).otherwise(F.col("slot").isin(*ODD_HITS))
    late = F.lit(late_percent == 5) & (F.col("slot") < 10)
    kind = F.when(late & hit, "late_hit").when(late, "late_miss").otherwise("fresh")
    return r.select("account_id", "idx", F.when(F.col("slot") % 2 == 0, "credit").otherwise("debit").alias("operation"), kind.alias("class"))


# What an account's ten requests are made of, and the text that seeds its shuffles.
PATTERNS = {"baseline": (["credit"] * 4 + ["debit"] * 4 + ["refund", "balance"], 0x4C4544474552), "credit_debit": (["credit"] * 5 + ["debit"] * 5, 0x434445424954)}
# The patterns of the first two accounts of the second workload, which complement each other.
PAIR = ("credit debit credit debit credit debit credit debit credit debit".split(), "credit credit debit credit debit credit debit credit debit debit".split())


def patterns(accounts: np.ndarray, kind: str) -> np.ndarray:
    """The operations of each account, one row of ten: shuffled, with a credit first, until no balance falls below 0 and
    no refund comes before a debit. All accounts that still lack a valid order are drawn at once."""
    names, salt = PATTERNS[kind]
    out = np.empty((len(accounts), len(names)), object)
    seed, open_ = mix64(accounts.astype(np.uint64) ^ np.uint64(salt)), np.arange(len(accounts))
    if kind == "credit_debit":
        for account, fixed in enumerate(PAIR):
            out[accounts == account] = fixed
        open_ = np.flatnonzero(accounts >= len(PAIR))
    while len(open_):
        drawn, x, rows = np.array([names] * len(open_), object), seed[open_], np.arange(len(open_))
        for i in range(len(names) - 1, 0, -1):
            with np.errstate(over="ignore"):
                x ^= x << np.uint64(13)
                x ^= x >> np.uint64(7)
                x ^= x << np.uint64(17)
            j = (x % np.uint64(i + 1)).astype(np.int64)
            drawn[rows, i], drawn[rows, j] = drawn[rows, j], drawn[rows, i].copy()
        seed[open_] = x
        first = (drawn == "credit").argmax(1)
        drawn[rows, first], drawn[rows, 0] = drawn[rows, 0], drawn[rows, first].copy()
        change = np.select([drawn == "debit", drawn == "balance"], [-1, 0], 1)
        valid = (change.cumsum(1) >= 0).all(1)
        if "refund" in names:
            valid &= (drawn == "debit").argmax(1) < (drawn == "refund").argmax(1)
        out[open_[valid]] = drawn[valid]
        open_ = open_[~valid]
    return out


def pattern_workload(spark: SparkSession, users: int, kind: str = "baseline") -> DataFrame:
    """account_id, wave, operation, tx_offset, refund_offset: what each account does in each of ten waves; transactions
    are numbered without balance reads, and a refund is of the account's last debit before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids = pdf["id"].to_numpy(np.int64)
            found = patterns(ids, kind)
            moves = found != "balance"
            offset = moves.cumsum(1) - moves
            last = np.maximum.accumulate(np.where(found == "debit", offset, -1), 1)
            n = found.shape[1]
            yield pd.DataFrame({"account_id": np.repeat(ids, n), "wave": np.tile(np.arange(n), len(ids)), "operation": found.ravel(), "tx_offset": offset.ravel(), "refund_offset": np.where(found == "refund", last, 0).ravel()})

    return spark.range(users).mapInPandas(run, "account_id long, wave long, operation string, tx_offset long, refund_offset long")


def u128_sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,0)"))

