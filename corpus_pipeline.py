"""The corpus pipeline: quality, toxicity, near-duplicates, mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next one's docs. All but the last return the columns of documents. The labels are those of
``sf_dir``; a stage learns from the labelled documents that its predecessors kept. Other columns of the documents go
along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import mixing, near_dedup, packing, quality, toxicity
from tidebook.llm.common import Scratch, released
from tidebook.sources.tables import table

#: Words of a shingle, similarity of near-duplicates, and the scores from which documents are good and toxic.
SHINGLE, SIMILARITY, GOOD, TOXIC = 5, 0.8, 0.3, 0.5
_SCORE = "score"


def _scored(score: Callable, spark: SparkSession, docs: DataFrame, model: quality.Model | toxicity.Model, keep: Callable) -> DataFrame:
    """The rows of ``docs`` whose score ``keep`` accepts; all, if the model was made without labels of both classes. The
    columns travel as one struct, so none can clash."""
    if not model.slope:
        return docs
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return score(spark, rows, model).where(keep(F.col(_SCORE))).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null, empty and very long texts, repeated rows and null ids are
    scored like any others; without labels of both classes all rows stay."""
    return _scored(quality.score, spark, docs, quality.train(docs, table(spark, sf_dir, "labels")), lambda s: s >= GOOD)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity search doesn't reject. Null, empty and very long texts, repeated rows and null ids are
    scored like any others; a score of TOXIC is a rejection; without labels of both classes all rows stay."""
    return _scored(toxicity.score, spark, docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")), lambda s: s < TOXIC)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the least id, ids before none.

    Rows are numbered for the stage, so rows without an id, or with a common one, are documents of their own: copies go,
    others stay. Rows without words are linked with nothing and stay.
    """
    scratch = Scratch(spark, "one-of-each")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("no_"))
    rows = scratch.keep(rows, "rows")
    texts = rows.select(F.col("no_").alias("doc_id"), F.col("row.text").alias("text"))
    of = near_dedup.near_duplicates(spark, texts, SHINGLE, SIMILARITY).select(F.col("doc_id").alias("no_"), "component_id")
    ids = rows.select("no_", F.col("row.doc_id").cast("long").alias("id_"))
    first = F.min(F.struct(F.col("id_").isNull().alias("none"), "id_", "no_"))
    kept = of.join(ids, "no_").groupBy("component_id").agg(first.alias("first")).select(F.col("first.no_").alias("no_"))
    return rows.join(kept, "no_", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, each row by its own copies."""
    return mixing.repeated(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens. Null and empty texts are one token, repeated rows documents of their own."""
    return packing.pack(spark, docs, ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]
#: Trained models and random rounding aren't SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for the documents of ``sf_dir``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.clear(docs)
    return docs
