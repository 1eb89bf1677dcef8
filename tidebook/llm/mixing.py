"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target over source size; its whole part is
taken and the fraction is rounded. Two documents at a time exchange mass at random, by words, so that what one gains the
other loses and every expected number stays as it was, until one of the two has no fraction left. The other goes on to
the next pair. What is taken of a source thus differs from its target by less than one document.

A document of more than 1/GIANTS of its source's words is paired first, with all the smaller ones of the source as one
partner, whose expected numbers move together; fewer than GIANTS documents of a source are such, and a task sees those
of one source. Then pairs are formed in groups of about GROUP documents, the largest first, so that neighbours are alike
in size and the last one is small. The one document that each group leaves goes up a tree of such groups, level by
level, until a source is one group; a source may hold any share of the rows.

Rows alike in id, source and size are counted before anything else and numbered among themselves, so rows without an id
or with a common one fall into groups like any others. Sources are a table: their ranks, sums and targets never come to
the driver, and only sources with more than 1/HOT of all rows are broadcast. Random numbers are hashes of ids, so reruns
agree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import WORD, Scratch
from tidebook.sources.tables import table

GROUP = 1024
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
GIANTS, HOT, RUN = 64, 1000, 100_000


def ranked(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """``sources`` with ``source_no``, the place of ``source`` in code-point order, null last; sorted by ranges, not in one task."""
    parts = scratch.spark.conf.get("spark.sql.shuffle.partitions")
    spread = scratch.keep(sources.repartitionByRange(int(parts), F.col("source").isNull(), "source").withColumn("part_", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("part_").agg(F.count("*").alias("c_")).withColumn("before_", F.coalesce(F.sum("c_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c_")
    within = F.row_number().over(Window.partitionBy("part_").orderBy(F.col("source").isNull(), "source")) - 1
    return spread.withColumn("within_", within).join(F.broadcast(counts), "part_").withColumn("source_no", F.col("before_") + F.col("within_")).drop("part_", "before_", "within_")


def targeted(scratch: Scratch, sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources`` (source, words, ...) with source_no and ``target``: shares of the sum of words by weight, none above
    ``most`` times its words; what is cut is shared by weight.

    A source is full where its words times ``most`` are below its share. Filling some raises the shares of others, so the
    price of a unit of weight is found by rounds, each one sum over the sources.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.pmod("source_no", F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = scratch.keep(ranked(scratch, sources).withColumn("weight", weight), "ranked")
    total, price = float(rows.agg(F.sum("words")).first()[0] or 0), 0.0
    full = lambda p: F.col("words") * F.lit(float(most)) < F.col("weight") * F.lit(p)
    while True:
        got = rows.agg(F.sum(F.when(full(price), F.col("words"))).alias("kept"), F.sum(F.when(~full(price), F.col("weight"))).alias("by")).first()
        new = (total - most * float(got["kept"] or 0)) / got["by"] if got["by"] else price
        if new <= price * (1 + 1e-12):
            break
        price = new
    return rows.withColumn("target", F.when(full(price), F.col("words") * F.lit(float(most))).otherwise(F.col("weight") * F.lit(price))).drop("weight")


def _uniform(seed: int, a: object, b: object) -> float:
    return (xxhash.xxh64_intdigest(f"{a}|{b}", seed=seed) >> 11) / (1 << 53)


def _settled(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The giants of one source, largest first, against the pool of its smaller documents: ``extra`` is 0 or 1, or -1
        for one that the pool can't balance either way, which stays for the tree; ``pool_p``: what the pool is left with."""
        pdf = pdf.sort_values(["size", "doc_id", "copy_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        own, words = float(pdf["p"].iloc[0]), float(pdf["source_size"].iloc[0])
        pool, p, extra = words - float(pdf["size"].sum()), own, []
        for key, no, size in zip(pdf["doc_id"].tolist(), pdf["copy_no"].tolist(), pdf["size"].tolist(), strict=True):
            if not 0 < own < 1 or pool <= 0 or (1 - own) * size > p * pool or own * size > (1 - p) * pool:
                extra.append(-1)
                continue
            up = _uniform(seed, (key, no), "giant") < own
            p += (own * size if not up else -(1 - own) * size) / pool
            extra.append(int(up))
        return pdf.assign(extra=extra, pool_p=min(1.0, max(0.0, p)))

    return run


def _rounded(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One group: ``extra`` is set to 0 or 1 for all but one row, and for that too where the source ends here."""
        pdf = pdf.sort_values(["size", "doc_id", "copy_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size, p, ids = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64).copy(), list(zip(pdf["doc_id"].tolist(), pdf["copy_no"].tolist(), strict=True))
        extra = np.full(len(pdf), -1, np.int64)
        held = -1
        for j in range(len(pdf)):
            if p[j] <= 0 or p[j] >= 1 or size[j] <= 0:
                extra[j] = int(p[j] >= 1)
                continue
            if held < 0:
                held = j
                continue
            i = held
            up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
            if _uniform(seed, ids[i], ids[j]) * (up + down) < down:
                full, gone = (1 - p[i]) * size[i] <= p[j] * size[j], (1 - p[i]) * size[i] >= p[j] * size[j]
                p[i], p[j] = 1.0 if full else p[i] + up / size[i], 0.0 if gone else p[j] - up / size[j]
            else:
                gone, full = p[i] * size[i] <= (1 - p[j]) * size[j], p[i] * size[i] >= (1 - p[j]) * size[j]
                p[i], p[j] = 0.0 if gone else p[i] - down / size[i], 1.0 if full else p[j] + down / size[j]
            held = -1
            for x in (i, j):
                if p[x] <= 0 or p[x] >= 1:
                    extra[x] = int(p[x] >= 1)
                else:
                    held = x
        if held >= 0 and bool(pdf["ends"].iloc[0]):
            extra[held] = int(_uniform(seed, ids[held], "last") < p[held])
        pdf["p"], pdf["extra"] = p, extra
        return pdf

    return run


def _with_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """``rows`` with the columns of their source. Sources with more than 1/HOT of the n rows, fewer than HOT of them, are
    broadcast; so none in the shuffled join has more."""
    named = sources.withColumnRenamed("source", "name_")
    some, others = F.broadcast(named.where(F.col("n") * HOT > n)), named.where(F.col("n") * HOT <= n)
    on = F.col("source").eqNullSafe(F.col("name_"))
    return rows.join(some, on).unionByName(rows.join(some.select("name_"), on, "left_anti").join(others, on)).drop("name_", "n")


def _dealt(sizes: DataFrame) -> DataFrame:
    """Rows of their own with ``copy_no``, from rows alike with their number. In runs, so a hot one is neither one task nor one group."""
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / RUN)))
    many = sizes.where(F.col("alike") > RUN).withColumn("run_", run).repartition("doc_id", "size", "run_")
    many = many.withColumn("copy_no", F.explode(F.sequence(F.col("run_") * RUN, F.least((F.col("run_") + 1) * RUN, F.col("alike")) - 1))).drop("run_")
    few = sizes.where(F.col("alike") <= RUN).withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)))
    return few.unionByName(many).drop("alike")


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def decide(spark: SparkSession, sizes: DataFrame, seed: int = 1, group: int = GROUP) -> DataFrame:
    """``mix`` from rows (doc_id, source, size, no_); no_ tells rows that are alike apart where there are such."""
    scratch = Scratch(spark, "mixing")
    # In pandas a null id would make the others of its group floating-point numbers.
    rows = sizes.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "source", "size", "no_")
    rows = scratch.keep(rows.groupBy(*rows.columns).agg(F.count("*").alias("alike")), "sizes")
    n = int(rows.agg(F.sum("alike")).first()[0] or 0)
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("words"), F.sum("alike").alias("n"), F.max("size").alias("largest"))
    sources = targeted(scratch, sources)
    share = F.when(F.col("words") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("words"))).otherwise(0.0)
    sources = sources.withColumn("base", F.floor(share)).withColumn("p", share - F.col("base")).withColumn("groups", F.ceil(F.col("n") / group)).withColumnRenamed("words", "source_size")
    sources = scratch.keep(sources, "sources")
    rows = _dealt(rows)
    giant = F.col("size") * GIANTS > F.col("source_size")
    schema = "doc_id long, named boolean, source string, size long, no_ long, copy_no long, source_no long, source_size long, target double, base long, p double, groups long"
    columns = [x.split()[0] for x in schema.split(", ")]
    large = _with_sources(rows, sources.where(F.col("largest") * GIANTS > F.col("source_size")).drop("largest"), n).where(giant).select(*columns)
    large = scratch.keep(large.groupBy("source_no").applyInPandas(_settled(seed), f"{schema}, extra long, pool_p double"), "giants")
    pools = large.groupBy("source_no").agg(F.first("pool_p").alias("pool_p"))
    pooled = scratch.keep(sources.join(pools, "source_no", "left").withColumn("p", F.coalesce("pool_p", "p")).drop("pool_p", "largest"), "pools")
    small = _with_sources(rows, pooled, n).where(~giant).select(*columns).withColumn("extra", F.lit(-1).cast("long"))
    hashed = F.pmod(F.xxhash64("doc_id", "size", F.col("no_") + F.col("copy_no"), F.lit(seed)), F.col("groups"))
    rows = small.unionByName(large.where("extra < 0").drop("pool_p")).withColumn("bucket", hashed).withColumn("ends", F.col("groups") == 1)
    done, level, groups = [large.where("extra >= 0").drop("pool_p")], 0, int(sources.agg(F.max("groups")).first()[0] or 1)
    while True:
        out = scratch.keep(rows.groupBy("source_no", "bucket").applyInPandas(_rounded(seed + level), f"{schema}, extra long, bucket long, ends boolean"), f"level-{level}")
        done.append(out.where("extra >= 0").drop("bucket", "ends"))
        if groups == 1:
            break
        level, groups = level + 1, -(-groups // group)
        rows = out.where("extra < 0").withColumn("groups", F.ceil(F.col("groups") / group)).withColumn("bucket", F.floor(F.col("bucket") / group)).withColumn("ends", F.col("groups") == 1)
    copies = F.col("base") + F.col("extra")
    found = reduce(DataFrame.unionByName, done).select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "size", "source", "no_", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
    found = scratch.keep(found, "decisions")
    scratch.clear(found)
    return found


def mix(spark: SparkSession, docs: DataFrame, seed: int = 1, group: int = GROUP) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row of ``docs`` (doc_id, text, source, any others).

    A size is the number of words of the whole text (null text: 0). Sources in code-point order, null last, weigh 5, 2,
    1, repeating, and share the sum of all sizes, none above three times its size. ``copies`` is a whole number from 0 to
    3 and ``taken`` that many times the size. Rows of size 0 take no part in rounding and nothing of them is taken.
    Repeated rows are rows of their own, each with its own copies; null ids are allowed; documents of equal size go by
    their ids. Without rows, or without words, nothing is taken. Other columns are ignored.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), F.lit(0).cast("long").alias("no_"))
    return decide(spark, sizes, seed, group).drop("no_")


def repeated(spark: SparkSession, docs: DataFrame, seed: int = 1, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes each of them; columns as they are.

    Rows without an id get a number of their own. Of rows that share an id, a source and a size, as many are taken once
    more as the mix says, in the order of their texts.
    """
    scratch = Scratch(spark, "mixed")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("no_"))
    keyed = scratch.keep(keyed, "rows")
    key = ["doc_id", "source", "size", "no_"]
    times = decide(spark, keyed.select(*key), seed, group).groupBy(*key).agg(F.min("copies").alias("low"), F.sum("copies").alias("all"), F.count("*").alias("alike"))
    times = times.where(F.col("all") > 0).select(*(F.col(c).alias(f"{c}_") for c in key), "low", "all", "alike")
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]
    found = keyed.join(times, on).select(*key, "row", "low", "all", "alike")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row.text")))
    more = found.where("alike > 1").withColumn("place", place).withColumn("copies", F.col("low") + (F.col("place") <= F.col("all") - F.col("alike") * F.col("low")).cast("long"))
    taken = found.where("alike = 1").select("row", F.col("low").alias("copies")).unionByName(more.select("row", "copies"))
    return taken.where("copies > 0").withColumn("no_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
