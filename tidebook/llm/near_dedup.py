"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles. The k least hashes are its sketch; the whole set is
its sketch where it has k at most. Inverted lists of retained values generate pairs, the sketch of the union estimates
their Jaccard similarity and drops what lies far below the threshold, and full sets decide.

Plan, for any size of input:

1. One pass over the texts gives each document's set size, a 128-bit key of its set, and its sketch. Equal keys are one
   class; one row a class goes on, so a group of copies costs one row.
2. Retained values are ordered by how many classes hold them, rarest first. Two linked sketches share a least number of
   values, so each list needs only a prefix of every sketch (prefix filter): values of passages that many documents
   share are passed over, and values of one class alone are never listed.
3. Each list is paired with one hub, the class whose sketch is best connected, and the verified links are contracted.
4. What lists with one hub hold is the hub's ball; any two linked classes lie in one ball. Where a ball has several
   components, each of its sets is split exactly into what it shares with the hub and the rest. Two sets share at most
   the lesser of their parts in the hub and what their rests share, so rests say which pairs may still be linked. They
   are compared in blocks, the largest component of a ball against the few outside it. No list and no ball is emitted
   as all its pairs, and none is capped.

With k = 64 and similarity 0.8 a linked pair shares 32 retained values or more but for about one pair in 10^7; sets of
at most 51 shingles are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, components, is_empty, small_batches
from tidebook.sources.tables import table

SKETCH = 64
BLOCK = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; the last bit goes, so that signed and unsigned order agree."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(1)


class WordHashes(dict):
    """xxh64 of each word, kept while it is met often enough to pay; emptied when it holds 300,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (int64) of the shingles of a whole text; a shorter text is one shingle, no words is none."""
    words = (text or b"").lower().split()  # bytes: A-Z and the ASCII white space alone
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n = max(1, len(words) - width + 1)
        acc = np.zeros(n, np.uint64)
        for i in range(min(width, len(words))):
            acc = acc * _MIX + h[i : i + n]
        if len(words) < width:
            acc += np.uint64(len(words)) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(_mixed(acc).view(np.int64))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for the empty set) and sketch of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for at in range(0, len(ids), 1024):
                sets = [shingle_set(t.as_py(), width, known) for t in texts.slice(at, 1024)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 1024),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def _prefixes(reps: DataFrame, similarity: float) -> DataFrame:
    """rep, value, weight: the listed values of each class. weight: how well its sketch is connected."""
    held = reps.select("rep", F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    least = F.when(F.col("n") / F.lit(similarity) <= SKETCH, F.ceil(F.col("n") * similarity - 1e-9)).otherwise(F.least(F.ceil(F.col("n") * similarity - 1e-9), F.lit(SKETCH // 2)))
    listed = held.join(shared, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("weight"))
    m = F.least(F.col("n"), F.lit(SKETCH))
    take = m - least + 1 - (m - F.size("v"))  # values of this class alone come first
    return (
        listed.join(reps.select("rep", "n"), "rep")
        .withColumn("take", take.cast("int"))
        .where("take > 0")
        .select("rep", "n", "weight", F.explode(F.slice("v", F.lit(1), F.col("take"))).alias("x"))
        .select("rep", "n", "weight", F.col("x.value").alias("value"))
    )


def _estimated(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those that the union sketch leaves: a, b, sure (decided: whole sets were compared)."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - 1e-9)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    whole = F.greatest("na", "nb") <= SKETCH
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.withColumn("sure", whole).withColumn("common", F.when(whole, common).otherwise(F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))))
    decided = 100 * F.col("common") >= F.lit(round(100 * similarity)) * (F.col("na") + F.col("nb") - F.col("common"))
    likely = F.col("common") >= F.least(F.lit(SKETCH // 2), F.ceil(F.least("na", "nb") * F.lit(similarity / 2)))
    return both.where(F.when(F.col("sure"), decided).otherwise(likely)).select("a", "b", "sure")


def _beside(rows: DataFrame, docs: DataFrame, key: str, other: str) -> DataFrame:
    """``rows`` (key, other, ...) with ``text``, that of the other, after rows without an other that hold the key's text.

    A key's rows are dealt into chunks of about BLOCK by their other: its text travels once a chunk, not once a row, and
    no task takes all rows of a hot key.
    """
    text = docs.select(F.col("doc_id").alias("id_"), "text")
    dealt = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    first = dealt.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).join(text, F.col(key) == F.col("id_"))
    others = rows.join(dealt, key).withColumn("chunk", F.pmod(F.xxhash64(other), "chunks")).drop("chunks").join(text, F.col(other) == F.col("id_"))
    every = others.unionByName(first, allowMissingColumns=True).drop("id_").repartition(key, "chunk")
    return every.sortWithinPartitions(key, "chunk", F.col(other).asc_nulls_first()).drop("chunk")


class _Sets:
    """Sets of the rows of ``_beside``, batch after batch; of a key it holds the distinct sets of its texts, one as a rule."""

    def __init__(self, key: str, other: str, width: int):
        self.key, self.other, self.width, self.known = key, other, width, WordHashes()
        self.at: int | None = None
        self.of: dict[bytes, np.ndarray] = {}

    def of_rows(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Row number, set and the key's sets of each row that has an other."""
        columns = (batch.column(self.key), batch.column(self.other), batch.column("text").cast(pa.large_binary()))
        for i, (key, other, text) in enumerate(zip(*columns, strict=True)):
            found = shingle_set(text.as_py(), self.width, self.known)
            if other.is_valid:
                self.at = None
                yield i, found, list(self.of.values())
            else:
                if self.at != key.as_py():
                    self.at, self.of = key.as_py(), {}
                self.of[found.tobytes()] = found


def _verified(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose full sets are as similar as asked."""
    percent = round(100 * similarity)

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common) and common > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets("a", "b", width)
        for batch in batches:
            keep = [i for i, x, of in sets.of_rows(batch) if any(alike(x, y) for y in of)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return _beside(pairs.select("a", "b"), docs, "a", "b").mapInArrow(run, "a long, b long")


def _links(scratch: Scratch, pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, similarity: float, name: str) -> DataFrame:
    likely = scratch.keep(_estimated(pairs, reps, similarity), f"{name}-likely")
    unsure = likely.where("not sure")
    sure = likely.where("sure").select("a", "b")
    return scratch.keep(sure.unionByName(_verified(unsure, texts, width, similarity)), f"{name}-links")


def _rests(ball: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Rows (hub, rep, comp, main, ...) of ``ball`` with n, the set's size, ``part``, what of it the hub holds, and ``rest``."""
    columns = ["hub", "rep", "comp", "m", "outside", "out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets("hub", "rep", width)
        for batch in batches:
            rows = [(i, len(x), np.setdiff1d(x, y, assume_unique=True)) for i, x, of in sets.of_rows(batch) for y in of]
            kept = batch.select(columns).take(pa.array([i for i, _, _ in rows], pa.int64()))
            n, part = pa.array([n for _, n, _ in rows], pa.int64()), pa.array([n - len(rest) for _, n, rest in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept.columns, n, part, pa.array([rest for _, _, rest in rows], pa.list_(pa.int64()))], [*columns, "n", "part", "rest"])

    return _beside(ball.select(*columns), docs, "hub", "rep").mapInArrow(run, "hub long, rep long, comp long, m long, outside long, out boolean, n long, part long, rest array<long>")


def _compare_block(similarity: float):
    """Pairs of the rows of one block marked ``asked`` and all its rows, of different components, that may be linked."""
    share = similarity / (1 + similarity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "asked"]).reset_index(drop=True)
        rep, comp, n, part = (pdf[c].to_numpy(np.int64) for c in ("rep", "comp", "n", "part"))
        asked = pdf["asked"].to_numpy(bool)
        lists = [np.asarray(x, np.int64) for x in pdf["rest"]]
        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        values, who = flat[order], owner[order]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(asked):
            lo, hi = np.searchsorted(values, lists[i], "left"), np.searchsorted(values, lists[i], "right")
            common = np.bincount(np.concatenate([np.empty(0, np.int64), *(who[x:y] for x, y in zip(lo, hi, strict=True))]), minlength=len(rep))
            need = np.ceil(share * (n + n[i]) - 1e-9)
            found = np.flatnonzero((comp != comp[i]) & (np.minimum(part, part[i]) + common >= need) & (np.minimum(n, n[i]) >= need))
            a.append(np.minimum(rep[found], rep[i]))
            b.append(np.maximum(rep[found], rep[i]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _rest(scratch: Scratch, ball: DataFrame, labels: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of one ball but of different components that may be linked, from blocks of BLOCK rows."""
    named = ball.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", F.coalesce("component", "rep").alias("comp"))
    named = scratch.keep(named, "balls")
    sizes = named.groupBy("hub", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("hub").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1")
    main = main.select("hub", "m", F.col("top.comp").alias("main"), (F.col("m") - F.col("top.c")).alias("outside"))
    mixed = named.join(main, "hub").withColumn("out", F.col("comp") != F.col("main"))
    rows = scratch.keep(_rests(mixed, docs, width), "rests")
    blocks, outs = F.ceil(F.col("m") / BLOCK), F.ceil(F.col("outside") / BLOCK)
    mine = F.pmod(F.xxhash64("rep"), blocks)
    upto = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), x - 1))
    data = ["rep", "comp", "n", "part", "rest"]
    sent = rows.select("hub", *data, F.lit(False).alias("asked"), mine.alias("i"), upto(outs).alias("j"))
    asking = rows.where("out").select("hub", *data, F.lit(True).alias("asked"), F.pmod(F.xxhash64("rep"), outs).alias("j"), upto(blocks).alias("i"))
    return sent.unionByName(asking).groupBy("hub", "i", "j").applyInPandas(_compare_block(similarity), "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components of ``docs`` (doc_id, text and any others).

    Links join documents whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more. Words
    are runs other than ASCII white space, A-Z in lower case. A text with fewer words is one shingle; an empty, null or
    blank text has none and is linked with nothing. component_id: the least doc_id reachable; kept: the row holds that
    id. Rows are returned as they come: repeated rows each once, and a row without an id takes its class's component
    (null if it has none) and isn't kept. Other columns are ignored. An empty table gives no rows.
    """
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select("doc_id", "text")
    one = scratch.keep(sketches(docs, width), "sketches")
    # the sketch of a class can be read from any of its rows
    reps = one.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    reps = scratch.keep(reps, "classes")
    sketch = one.where("set_key is not null").select(F.col("doc_id").alias("rep"), F.col("set_key").alias("k"), "sketch")
    full = reps.join(sketch, "rep").where("k = set_key").select("rep", "n", "sketch").dropDuplicates(["rep"])
    full = scratch.keep(full, "class-sketches")
    listed = scratch.keep(_prefixes(full, similarity), "lists")
    hubs = listed.groupBy("value").agg(F.max_by("rep", F.struct("weight", F.negative("rep"))).alias("hub"))
    ball = scratch.keep(listed.join(hubs, "value").select("hub", "rep").distinct(), "hubs")
    # of two classes only the better connected can be the other's hub, so no pair comes twice
    star = ball.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    # whole texts are dealt at most once; what follows takes those of balls alone. Ids are a table, whose size is known
    # when the join is planned
    held = scratch.keep(star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct(), "held")
    texts = scratch.keep(docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(held, "doc_id"), "texts")
    links = _links(scratch, star, full, texts, width, similarity, "star")
    labels = components(spark, scratch, links)
    more = _rest(scratch, ball, labels, texts, width, similarity)
    more = _links(scratch, more, full, texts, width, similarity, "rest")
    if not is_empty(more):
        labels = components(spark, scratch, links.unionByName(more))
    scratch.clear(one, reps, labels)
    classes = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    return (
        one.select("doc_id", "n_shingles", "set_key")
        .join(classes, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), width=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS shingle FROM w
), n AS (
  SELECT w.doc_id, count(g.shingle) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY 1
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b
)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
