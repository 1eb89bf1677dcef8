"""Numbering rows in a total order without one task per partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, SPAN = 100_000, 100_000


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = WIDTH, dense: bool = False) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same keys up to this one in ``order`` (a whole number).

    The order is cut into buckets of ``width`` and these into spans of SPAN; sums of buckets and of spans come first and
    their prefix sums are joined back. No task sorts more than a bucket's rows, a span's buckets or a key's spans, however
    far apart the numbers lie. Where they are known to lie close (``dense``), so that a key has few buckets, spans are
    passed over.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)).cast("long")).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = lambda c, over: F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(a) == F.col(b)]
    if dense:
        sums = sums.withColumn("_inner", earlier("_sum", Window.partitionBy(*keys).orderBy("_bucket"))).withColumn("_base", F.lit(0).cast("long"))
    else:
        sums = sums.withColumn("_span", F.floor(F.col("_bucket") / F.lit(SPAN)).cast("long"))
        spans = sums.groupBy(*keys, "_span").agg(F.sum("_sum").alias("_all"))
        spans = spans.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_span").alias("_s"), earlier("_all", Window.partitionBy(*keys).orderBy("_span")).alias("_base"))
        sums = sums.withColumn("_inner", earlier("_sum", Window.partitionBy(*keys, "_span").orderBy("_bucket"))).join(spans, same("_span", "_s")).drop(*(f"_{k}" for k in keys))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_b"), (F.col("_base") + F.col("_inner")).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_within", within).join(sums, same("_bucket", "_b"))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).select(*df.columns, name)
