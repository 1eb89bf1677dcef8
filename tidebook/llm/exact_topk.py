"""Exact top-k by inner product with a KD-tree per shard.

The top of the tree is fitted on a bounded sample: median splits cut space into at most CELLS cells. Every vector is
dealt to its cell, and cells of more than SHARD_ROWS rows into shards of that size. A task reads the vectors of a shard,
builds its tree once (splits at the median of the widest dimension, tight bounding boxes, leaves of LEAF vectors) and
then answers the queries that come to the shard, one batch after another: a queue yields the box with the highest
possible inner product next, and the search ends when that can't reach the query's kth score.

A query first searches the cell whose box, tight over all its vectors, allows the highest score. The kth score found
there goes along to the others, and only to cells whose box can still reach it. Vectors are shuffled once a phase,
whatever the number of queries; a query is copied to the shards of the cells that it must see. Boxes, at most CELLS for
each of the DIMS commonest lengths, are broadcast; vectors of other lengths have one cell without a box. Integers make
scores and bounds exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, small_batches
from tidebook.sources.tables import table

K, LEAF, SHARD_ROWS, SAMPLE = 10, 64, 32_768, 4096
CELLS, DIMS = 512, 8
#: So many cells at least, for all cores to work, but none under LEAST_ROWS rows on average.
SPREAD, LEAST_ROWS = 32, 256
SCHEMA = "query_id long, vec_id long, score long"


class Tree:
    """Nodes in arrays: a box (low, high) each, and children or a range of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        rows = np.arange(len(ids))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.child: list[tuple[int, int]] = []
        self.span: list[tuple[int, int]] = []
        out: list[np.ndarray] = []
        used, todo = 0, [(rows, -1, 0)]
        while todo:
            mine, parent, side = todo.pop()
            v = vectors[mine]
            node = len(self.low)
            self.low.append(v.min(0))
            self.high.append(v.max(0))
            self.child.append((-1, -1))
            self.span.append((0, 0))
            if parent >= 0:
                c = self.child[parent]
                self.child[parent] = (node, c[1]) if side == 0 else (c[0], node)
            width = self.high[node] - self.low[node]
            if len(mine) <= leaf or not width.any():
                self.span[node] = (used, used + len(mine))
                used += len(mine)
                out.append(np.sort(mine))
                continue
            by = np.argsort(v[:, int(np.argmax(width))], kind="stable")
            half = len(by) // 2
            todo += [(mine[by[half:]], node, 1), (mine[by[:half]], node, 0)]
        placed = np.concatenate(out)
        self.ids, self.vectors = ids[placed], vectors[placed]
        self.low_, self.high_ = np.array(self.low), np.array(self.high)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The highest inner product with ``query`` that a vector in each box can have."""
        return self.high_ @ np.maximum(query, 0) + self.low_ @ np.minimum(query, 0)

    def search(self, own: int, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, id) of the best k rows but ``own``, higher scores and then lower ids first, of score ``least`` or more."""
        bound = self.bounds(query)
        queue = [(-int(bound[0]), 0)]
        best: list[tuple[int, int]] = []  # a heap: the worst kept row is first
        while queue:
            reach, node = heapq.heappop(queue)
            if least is not None and -reach < least:
                break
            a, b = self.child[node]
            if a >= 0:
                heapq.heappush(queue, (-int(bound[a]), a))
                heapq.heappush(queue, (-int(bound[b]), b))
                continue
            lo, hi = self.span[node]
            scores = self.vectors[lo:hi] @ query
            fit = np.flatnonzero((self.ids[lo:hi] != own) & ((scores >= least) if least is not None else True))
            if len(fit) > k:  # rows of a leaf stand by id, so a stable sort keeps ties right
                fit = fit[np.argsort(-scores[fit], kind="stable")[:k]]
            for i in fit.tolist():
                row = (int(scores[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
                if len(best) == k:
                    least = best[0][0] if least is None else max(least, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


class Cells:
    """Median splits of a sample into at most ``most`` cells, by the widest dimension each."""

    def __init__(self, sample: np.ndarray, most: int):
        self.split: list[tuple[int, int, int, int]] = []  # dimension, last value of the lower side, children (a cell n as -1 - n)
        self.count = 0
        self.root = self._made(sample, most)

    def _made(self, rows: np.ndarray, most: int) -> int:
        width = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
        if most > 1 and len(rows) > 1 and width.any():
            axis = int(np.argmax(width))
            value = int(np.sort(rows[:, axis])[(len(rows) - 1) // 2])
            low = rows[:, axis] <= value
            if low.all():  # more than half share the highest value
                value = int(rows[rows[:, axis] < value, axis].max())
                low = rows[:, axis] <= value
            node = len(self.split)
            self.split.append((axis, value, 0, 0))
            self.split[node] = (axis, value, self._made(rows[low], most // 2), self._made(rows[~low], most - most // 2))
            return node
        self.count += 1
        return -self.count

    def of(self, rows: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(rows), np.int64), [(self.root, np.arange(len(rows)))]
        while todo:
            node, mine = todo.pop()
            if node < 0:
                out[mine] = -1 - node
                continue
            axis, value, a, b = self.split[node]
            low = rows[mine, axis] <= value
            todo += [(a, mine[low]), (b, mine[~low])]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


def _celled(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dim(batch):
                cell = cells[d].of(_matrix(part.column("v"), d)) if d in cells else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], [*part.schema.names, "cell"])

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows and the tight box of each cell of a partition."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for d, part in _by_dim(batch):
            rows, cells = _matrix(part.column("v"), d), part.column("cell").to_numpy()
            for c in np.unique(cells).tolist():
                mine = rows[cells == c]
                x = found.setdefault((d, c), [0, mine.min(0), mine.max(0)])
                x[0], x[1], x[2] = x[0] + len(mine), np.minimum(x[1], mine.min(0)), np.maximum(x[2], mine.max(0))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), *(pa.array([x[i] for x in found.values()], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))))], ["dim", "cell", "n", "low", "high"])


def _whole_box(pdf: pd.DataFrame) -> pd.DataFrame:
    low, high = np.min(np.stack(pdf["low"]), 0), np.max(np.stack(pdf["high"]), 0)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "n": [pdf["n"].sum()], "low": [low], "high": [high]})


class Boxes:
    """The cells of one length: their boxes and in how many shards they lie."""

    def __init__(self, cells: list[int], shards: list[int], low: np.ndarray | None, high: np.ndarray | None):
        self.cells, self.shards, self.low, self.high = np.array(cells), shards, low, high

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _sent(boxes: dict[int, Boxes], first: bool):
    """Queries with the (cell, shard) of each place that they must see: their best cell at first, then all others that may hold more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dim(batch):
                of = boxes[d]
                if of.low is None:
                    reach, home = np.zeros((part.num_rows, 1), np.int64), np.zeros(part.num_rows, np.int64)
                else:
                    reach = of.bounds(_matrix(part.column("v"), d))
                    home = reach.argmax(1)
                least = part.column("least").to_pylist()
                row, cell, shard = [], [], []
                for i, x in enumerate(least):
                    picked = [home[i]] if first else [c for c in (range(len(of.cells)) if x is None or of.low is None else np.flatnonzero(reach[i] >= x)) if c != home[i]]
                    for c in picked:
                        row += [i] * of.shards[c]
                        cell += [int(of.cells[c])] * of.shards[c]
                        shard += range(of.shards[c])
                        if len(row) > 4096:
                            yield placed(part, row, cell, shard)
                            row, cell, shard = [], [], []
                if row:
                    yield placed(part, row, cell, shard)

    def placed(part: pa.RecordBatch, row: list[int], cell: list[int], shard: list[int]) -> pa.RecordBatch:
        some = part.take(pa.array(row))
        return pa.RecordBatch.from_arrays([some.column("dim"), pa.array(cell, pa.int64()), pa.array(shard, pa.int64()), pa.array([True] * len(row)), some.column("vec_id"), some.column("least"), some.column("v")], ["dim", "cell", "shard", "asks", "vec_id", "least", "v"])

    return run


def _answered(k: int):
    """Rows by shard, its vectors before the queries: one tree a shard, one batch of queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, ids, rows = None, None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "cell", "shard")] + [batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part, at = batch.slice(lo, hi - lo), tuple(keys[lo, :3].tolist())
                if at != key:
                    key, tree, ids, rows = at, None, [], []
                own, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("v"), at[0])
                if not keys[lo, 3]:
                    ids.append(own)
                    rows.append(vectors)
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids), np.concatenate(rows)) if ids else False
                if tree:
                    found = [(q, i, s) for q, v, least in zip(own.tolist(), vectors, part.column("least").to_pylist(), strict=True) for s, i in tree.search(q, v, k, least)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def as_integers(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v: floor(1024 * x) of each component; rows without an id, or with null or non-finite components, go."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias(column)).where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(~bad & (F.size(column) > 0))
    return kept.select("vec_id", F.transform(column, lambda x: F.floor(x * 1024).cast("long")).alias("v"))


def top_k(spark: SparkSession, embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose id is divisible by ``every``.

    The score is the inner product of the vectors in units of 1/1024, ties go to the smaller id, and a query doesn't meet
    its own id. Fewer rows than ``k`` are all returned; vectors of another length than the query's aren't compared, and
    vectors of any length are read whole. Vectors that are null, empty or hold a null, NaN or infinite component take no
    part. Rows that repeat an id are candidates each; of queries that share an id the one with the shortest, then least
    vector asks. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(spark)
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(as_integers(embeddings).withColumn("dim", F.size("v").cast("long")), "integers")
    dims = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    common = sorted(dims, key=lambda d: (-dims[d], d))[:DIMS]
    cells = {}
    for d in common:
        picked = rows.where(F.col("dim") == d).select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v")
        most = min(CELLS, max(-(-dims[d] // SHARD_ROWS), min(SPREAD, dims[d] // LEAST_ROWS)))
        cells[d] = Cells(np.array([r["v"] for r in picked.collect()], np.int64).reshape(-1, d), max(1, most))
    rows = scratch.keep(rows.mapInArrow(_celled(cells), "vec_id long, v array<long>, dim long, cell long").withColumn("no_", F.monotonically_increasing_id()), "cells")
    boxed = rows.where(F.col("dim").isin(common)).select("dim", "cell", "v").mapInArrow(_boxes, "dim long, cell long, n long, low array<long>, high array<long>")
    boxes: dict[int, Boxes] = {d: Boxes([0], [-(-n // SHARD_ROWS)], None, None) for d, n in dims.items()}
    found = boxed.groupBy("dim", "cell").applyInPandas(_whole_box, "dim long, cell long, n long, low array<long>, high array<long>").collect()
    for d in common:
        of = sorted((r["cell"], -(-r["n"] // SHARD_ROWS), r["low"], r["high"]) for r in found if r["dim"] == d)
        boxes[d] = Boxes([x[0] for x in of], [x[1] for x in of], *(np.array([x[i] for x in of], np.int64) for i in (2, 3)))
    shards = spark.createDataFrame([(d, int(c), n) for d, b in boxes.items() for c, n in zip(b.cells, b.shards, strict=True)], "dim long, cell long, shards long")
    candidates = rows.join(F.broadcast(shards), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("vec_id", "no_"), F.col("shards")).alias("shard"), F.lit(False).alias("asks"), "vec_id", F.lit(None).cast("long").alias("least"), "v")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v", F.lit(None).cast("long").alias("least"))
    queries = scratch.keep(queries, "queries")
    tasks = min(4096, max(1, sum(n for b in boxes.values() for n in b.shards)))
    schema = "dim long, cell long, shard long, asks boolean, vec_id long, least long, v array<long>"
    keys = ["dim", "cell", "shard"]

    def answered(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(_sent(boxes, first), schema)
        return candidates.unionByName(sent).repartition(tasks, *keys).sortWithinPartitions(*keys, "asks").mapInArrow(_answered(k), SCHEMA)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = scratch.keep(answered(queries, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    more = queries.join(kth, "vec_id", "left").select("vec_id", "dim", "v", F.col("kth").alias("least"))
    return first.drop("rank").unionByName(answered(more, False)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
