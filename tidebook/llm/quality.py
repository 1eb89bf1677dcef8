"""Quality by Naive Bayes support vectors.

Features are indicators of n-grams: words, and runs of one to three word shapes (case, length, marks around the word,
and whether it repeats the word before), hashed to BUCKETS. Each indicator is scaled by the log-count ratio of the two
classes and each document to length 1; a linear hinge-loss model is fitted by dual coordinate descent. Margins from two
folds fit a logistic curve, which makes the score.

The model is fitted on the driver on at most ``per_class`` labelled documents of each class, whatever the size of the
corpus; it takes 2 MB. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import held_out, small_batches
from tidebook.llm.labelled import calibrated, probability, sample
from tidebook.sources.tables import table

BUCKETS = 1 << 18
PER_CLASS = 2000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = {ord(c): "p" for c in ".,;:?'\""}


def _shape(word: str) -> str:
    core = word.strip("".join({c for c in word if not c.isalnum()}))
    at = word.find(core) if core else len(word)
    marks = [m[:3].translate(_PLAIN) for m in (word[:at], word[at + len(core) :])]
    case = "n" if not core else "u" if core.isupper() and len(core) > 1 else "l" if core.islower() else "t" if core[:1].isupper() else "d" if core.isdigit() else "m"
    return f"{marks[0]}<{case}{min(len(core), 15) // 4}>{marks[1]}"


class Words(dict):
    """Word -> its place in the lists of shape and word hashes; emptied at 250,000 words."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes: list[int] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.shapes)
        text = word.decode("utf-8", "replace")
        self.shapes.append(xxhash.xxh64_intdigest(_shape(text)))
        self.hashes.append(xxhash.xxh64_intdigest(text.lower(), seed=1))
        return place

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.shapes) > 250_000:
            self.clear()
            self.shapes.clear()
            self.hashes.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def ngrams(text: bytes | None, words: Words) -> np.ndarray:
    """The sorted distinct features of a whole text."""
    split = (text or b"").split()
    if not split:
        return np.empty(0, np.int64)
    place = words.places(split)
    kinds, back = np.unique(place, return_inverse=True)
    shape = np.fromiter((words.shapes[i] for i in kinds.tolist()), np.uint64, len(kinds))[back]
    word = np.fromiter((words.hashes[i] for i in kinds.tolist()), np.uint64, len(kinds))
    with np.errstate(over="ignore"):
        shape[1:] += (place[1:] == place[:-1]) * np.uint64(0x1234567)
        grams, acc = [word], shape
        for n in range(1, 4):
            grams.append(acc * _GOLD + np.uint64(n))
            acc = acc[:-1] * _GOLD + shape[n:]
        all_ = np.concatenate(grams)
        all_ = (all_ ^ (all_ >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((all_ >> np.uint64(64 - 18)).astype(np.int64))


@dataclass
class Model:
    """Weights by feature with the ratios multiplied in; ratios, for the length; the logistic curve."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[features].astype(np.float64) ** 2).sum()))
        return (float(self.weights[features].sum(dtype=np.float64)) / length if length else 0.0) + self.bias


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(BUCKETS, alpha), np.full(BUCKETS, alpha)
    for x, c in zip(rows, y.tolist(), strict=True):
        (p if c else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float = 1.0, epochs: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear machine with rows scaled by ``ratios`` to length 1, and a constant 1."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, c * len(y) / 2 / max(1, (y == 1).sum()), c * len(y) / 2 / max(1, (y == 0).sum()))
    scaled = []
    for x in rows:
        v = ratios[x]
        n = np.sqrt((v * v).sum())
        scaled.append(v / n if n else v)
    w, bias, alpha, random = np.zeros(BUCKETS), 0.0, np.zeros(len(y)), np.random.default_rng(7)
    square = np.array([float((v * v).sum()) + 1.0 for v in scaled])
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(y)).tolist():
            x, v = rows[i], scaled[i]
            g = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                worst = max(worst, abs(step))
                w[x] += step * v
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, counts: dict[int, int]) -> Model:
    """A model; with one class or none among the rows it scores all documents by the labels' share."""
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if len(set(y.tolist())) < 2:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))

    def machine(take: np.ndarray) -> Model:
        part, labels = [rows[i] for i in take], y[take]
        ratios = log_count_ratios(part, labels)
        w, bias = dual_coordinate_descent(part, labels, ratios)
        return Model((w * ratios).astype(np.float32), ratios.astype(np.float32), bias, 1.0, 0.0)

    margins, fold = np.zeros(len(y)), np.arange(len(y)) % 2
    for c in (0, 1):
        mine = np.flatnonzero(y == c)
        fold[mine] = np.arange(len(mine)) % 2
    for f in (0, 1):
        take = np.flatnonzero(fold != f)
        if len(set(y[take].tolist())) < 2:
            take = np.arange(len(y))
        m = machine(take)
        for i in np.flatnonzero(fold == f).tolist():
            margins[i] = m.margin(rows[i])
    whole = machine(np.arange(len(y)))
    whole.slope, whole.offset = calibrated(margins, y, counts)
    return whole


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    small_batches(docs.sparkSession)
    picked, counts = sample(docs, labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [ngrams(t.as_py(), words).astype(np.int32) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "x"])

    rows = picked.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    x = [np.asarray(v, np.int64) for v in rows.column("x").to_pylist()]
    return fit(x, np.asarray(rows.column("y").to_pylist(), np.int64), counts)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and ``score``; rows keep their number. Null and empty texts have the score of no features."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                margins = np.array([m.margin(ngrams(t.as_py(), words)) for t in part.column("text").cast(pa.large_binary())])
                scores = pa.array(probability(margins, m.slope, m.offset), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3 on) of every row of ``docs`` (doc_id, text, any others).

    Learns from ``labels`` (doc_id, quality) outside the held-out fold, at most ``per_class`` documents of each class;
    labels without a document change nothing. Null,
    empty and blank texts have no features and one common score; very long texts are read whole; repeated rows are
    scored alike; without labels of both classes all rows get the labels' share (0.5 without labels). Null ids aren't
    held out. Ties don't occur: each row has its own result.
    """
    model = train(docs, labels, per_class=per_class)
    scored = score(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
