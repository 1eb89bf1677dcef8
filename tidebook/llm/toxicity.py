"""Toxic passages by maximum-scoring segments.

Each word scores its log-odds between toxic and clean documents under Dirichlet priors: a word's prior is centred on
what is known of its first letters (five, then four), so unseen forms of a known stem score too. One and a half standard errors
and a constant drift are taken off, so words that say nothing score a little below 0. One linear scan over a document
finds every maximal segment; a segment counts if its score is beyond what the extreme-value law of the clean documents'
word scores lets expect in a text of that length. The evidence of a document is the sum over such segments, and a
logistic curve, fitted out of fold, makes the score.

Word counts come from at most ``per_class`` labelled documents of each class outside the held-out fold; they are added
up by Spark, and only entries that differ from the rest reach the driver. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import Scratch, held_out, small_batches
from tidebook.llm.labelled import calibrated, probability, sample
from tidebook.sources.tables import table

PER_CLASS = 3000
#: Pseudo-documents of a prior, standard errors taken off, drift of each word, and the law's constant K.
PRIOR, ERRORS, DRIFT, K = 3.0, 1.5, 0.1, 0.1
#: Expected number of chance segments in a text from which a segment counts.
CHANCE = 0.2
STEMS = (4, 5)
_EDGES = "".join(chr(i) for i in range(128) if not chr(i).isalnum()) + "«»„“”‘’¡¿…–—"


def core(word: str) -> str:
    return word.lower().strip(_EDGES)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one scan with a stack of candidates (Ruzzo and Tompa, 1999)."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    before = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    for i in up.tolist():
        start, end, low, high = i, i + 1, float(before[i]), float(before[i + 1])
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, end, low, high))
    return [(s, e, high - low) for s, e, low, high in stack]


@dataclass
class Lexicon:
    """Scores of words and of stems; ``rate``: the decay of the extreme-value law."""

    words: dict[str, float]
    stems: dict[str, float]
    rate: float

    def of(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        for n in sorted(STEMS, reverse=True):
            if len(word) > n and (s := self.stems.get(f"{n}:{word[:n]}")) is not None:
                return s
        return -DRIFT


class Scorer(dict):
    """Word of a text -> score; emptied at 300,000 words."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = self.lexicon.of(core(word.decode("utf-8", "replace")))
        return value

    def passages(self, text: bytes | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The evidence of a whole text and its significant segments: first word, end, expected number by chance."""
        words = (text or b"").split()
        if not words:
            return 0.0, []
        scores = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        again: dict[bytes, int] = {}
        for i in np.flatnonzero(scores > 0).tolist():  # counts are of documents, so a word's next occurrence is worth half
            w = words[i]
            if (n := again.get(w, 0)) < 64:
                again[w] = n + 1
            scores[i] = (scores[i] + DRIFT) / (1 << n) - DRIFT
        found = [(s, e, K * len(words) * math.exp(-self.lexicon.rate * x)) for s, e, x in segments(scores)]
        found = [x for x in found if x[2] < CHANCE]
        return math.log1p(sum(-math.log(max(x[2], 1e-300) / CHANCE) for x in found)), found


def _score(t: float, c: float, nt: float, nc: float, parent: float) -> tuple[float, float]:
    """Log-odds of t of nt toxic and c of nc clean documents, the prior centred on ``parent``; and its standard error."""
    odds = math.exp(parent) * nt / nc
    pt, pc = PRIOR * odds / (1 + odds), PRIOR / (1 + odds)
    return math.log((t + pt) / nt) - math.log((c + pc) / nc), math.sqrt(1 / (t + pt) + 1 / (c + pc))


def lexicon(counts: dict[str, tuple[float, float]], forms: dict[str, tuple[float, float]], nt: float, nc: float, clean_words: float) -> Lexicon:
    """Scores from document counts (toxic, clean) by word and counts of word forms by stem. Without both classes no word scores."""
    if not nt or not nc:
        return Lexicon({}, {}, 1.0)

    def shrunk(delta: float, error: float) -> float:
        return math.copysign(max(0.0, abs(delta) - ERRORS * error), delta)

    odds: dict[str, float] = {}
    stems: dict[str, float] = {}
    for n in STEMS:
        for k, (t, c) in forms.items():
            if k.startswith(f"{n}:"):
                up = f"{STEMS[0]}:{k[2 : 2 + STEMS[0]]}"
                odds[k] = shrunk(*_score(t, c, nt, nc, odds.get(up, 0.0) if n > STEMS[0] else 0.0))
                stems[k] = odds[k] - DRIFT
    words = {}
    for k, (t, c) in counts.items():
        parent = next((odds[x] for n in sorted(STEMS, reverse=True) if len(k) > n and (x := f"{n}:{k[:n]}") in odds), 0.0)
        words[k] = shrunk(*_score(t, c, nt, nc, parent)) - DRIFT
    # What occurs in clean documents, with a grain for the rest, gives the law: the rate at which high sums grow rare.
    masses: dict[float, float] = {}
    for k, s in words.items():
        if s > -DRIFT:
            masses[s] = masses.get(s, 0.0) + counts[k][1] + 0.1
    top = max([1.0, *masses])
    masses[top] = masses.get(top, 0.0) + 0.5
    total = max(clean_words, sum(masses.values()) + 1)
    rest = 1 - sum(masses.values()) / total
    grow = lambda x: rest * math.exp(-DRIFT * x) + sum(m / total * math.exp(min(700.0, s * x)) for s, m in masses.items())
    lo, hi = 1e-6, 1.0
    while grow(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if grow(mid) < 1 else (lo, mid)
    return Lexicon(words, stems, lo)


@dataclass
class Model:
    lexicon: Lexicon
    slope: float
    offset: float


def _counted(picked: DataFrame) -> DataFrame:
    """word, t0, c0, t1, c1: documents of each half, toxic and clean, that hold a word; '' counts the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for y, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                for word in {core(w.decode("utf-8", "replace")) for w in set((text.as_py() or b"").split())} | {""}:
                    found.setdefault(word, [0, 0, 0, 0])[2 * half + 1 - y] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array(c, pa.int64()) for c in zip(*found.values(), strict=True))], ["word", "t0", "c0", "t1", "c1"])

    counts = picked.select("y", "half", "text").mapInArrow(run, "word string, t0 long, c0 long, t1 long, c1 long")
    return counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")))


def _stems(counted: DataFrame, halves: tuple[int, ...]) -> DataFrame:
    """stem, t, c: word forms of each stem, a form counting once in all, shared by the classes that hold it."""
    t, c = (sum((F.col(f"{k}{i}") for i in halves), F.lit(0)) for k in "tc")
    seen = counted.where("word <> ''").select("word", t.alias("t"), c.alias("c")).where("t + c > 0")
    stem = F.explode(F.array(*(F.when(F.length("word") > n, F.concat(F.lit(f"{n}:"), F.substring("word", 1, n))) for n in STEMS)))
    split = seen.select(stem.alias("stem"), (F.col("t") / (F.col("t") + F.col("c"))).alias("t"), (F.col("c") / (F.col("t") + F.col("c"))).alias("c"))
    return split.where("stem is not null").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 2")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    picked, known = sample(docs, labels, label, per_class)
    picked = scratch.keep(picked.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")), "sample")
    counted = scratch.keep(_counted(picked), "counts")
    clean_words = counted.where("word <> ''").agg(F.sum("c0"), F.sum("c1")).first()
    documents = counted.where("word = ''").first()
    if documents is None:
        return Model(Lexicon({}, {}, 1.0), 0.0, 0.0)
    # A word of one toxic document, or of clean ones alone, can't score above the drift but by its stem; seen clean it is kept.
    kept = [r.asDict() for r in counted.where("word <> '' and t0 + t1 >= 2").toLocalIterator()]
    lexicons = []
    for halves in ((1,), (0,), (0, 1)):
        of = lambda k, r, h=halves: sum(r[f"{k}{i}"] for i in h)
        stems = {r["stem"]: (r["t"], r["c"]) for r in _stems(counted, halves).toLocalIterator()}
        lexicons.append(lexicon({r["word"]: (of("t", r), of("c", r)) for r in kept}, stems, of("t", documents), of("c", documents), float(sum(clean_words[i] or 0 for i in halves))))
    sent = spark.sparkContext.broadcast(lexicons[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(x) for x in sent.value]
        for batch in batches:
            found = [scorers[h].passages(t.as_py())[0] for h, t in zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "y", "m"])

    rows = picked.select("doc_id", "y", "half", "text").mapInArrow(run, "doc_id long, y int, m double").toArrow().sort_by([("doc_id", "ascending")])
    scratch.clear()
    y, margins = np.asarray(rows.column("y").to_pylist(), np.int64), np.asarray(rows.column("m").to_pylist(), np.float64)
    if len(set(y.tolist())) < 2:
        n1, n0 = known.get(1, 0), known.get(0, 0)
        return Model(lexicons[2], 0.0, math.log((n1 + 0.5) / (n0 + 0.5)))
    return Model(lexicons[2], *calibrated(margins, y, known))


def score(spark: SparkSession, docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """The columns of ``docs`` and ``score``, and on request the significant passages: first word, end, and the number
    of such segments that chance makes in a text of that length."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    spans = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("by_chance", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), *[T.StructField("passages", spans)] * passages])
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("by_chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m.lexicon)
        for batch in batches:
            found = [scorer.passages(t.as_py()) for t in batch.column("text").cast(pa.large_binary())]
            more = [pa.array(probability(np.array([x for x, _ in found]), m.slope, m.offset), pa.float64())]
            if passages:
                more.append(pa.array([[dict(zip(("first_word", "end_word", "by_chance"), x, strict=True)) for x in y] for _, y in found], span))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "score", *["passages"] * passages])

    return docs.mapInArrow(run, schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, passages: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every row of ``docs`` (doc_id, text, any others).

    Learns from ``labels`` (doc_id, toxic) outside the held-out fold, at most ``per_class`` documents of each class;
    labels without a document change nothing. Null,
    empty and blank texts have no evidence and one common score; very long texts are read whole; repeated rows are
    scored alike; without labels of both classes all rows get the labels' share (0.5 without labels). Null ids aren't
    held out. Ties don't occur: each row has its own result. With ``passages`` the significant segments of each text come along.
    """
    model = train(spark, docs, labels, per_class=per_class)
    scored = score(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, passages)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["passages"] * passages)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
