"""Packing documents into sequences of fixed length: concatenate and cut.

First pass: each task tokenizes its texts, and writes the ids with the number of ids before each document in the task.
The tasks' totals, one number each, are summed up on the driver, which gives every task its place in the whole. Second
pass: a document's place in the whole says which windows it crosses and where it is cut; no row is shuffled. Only the
last window can need padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebook.llm.common import Scratch, small_batches
from tidebook.sources.tables import table

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
END = 0
SPECIAL = "<|endoftext|>"


@cache
def _own(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


@cache
def _ranks(vocabulary: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids that ``tokenizers`` gives without added special tokens.

    The same vocabulary as ranks gives the same ids, four times as fast; a text that holds the name of a special token
    goes to ``tokenizers`` itself.
    """
    if SPECIAL in text:
        return _own(vocabulary).encode(text, add_special_tokens=False).ids
    return _ranks(vocabulary).encode_ordinary(text)


def _tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                ids = [np.array([*token_ids(t.as_py() or "", vocabulary), END], "<u2") for t in texts.slice(at, 512)]
                sizes = [len(x) for x in ids]
                starts = [before, *accumulate(sizes, initial=before)][1:-1]
                before += sum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column(0).slice(at, 512), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["task", "before", "doc_id", "n", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "task int, before long, doc_id long, n long, ids binary")


def _cut(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for doc, first, n, raw in zip(*(part.column(c).to_pylist() for c in ("doc_id", "first", "n", "ids")), strict=True):
                    ids = np.frombuffer(raw, "<u2").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(first + start, length)
                        size = min(n - start, length - offset)
                        piece = ids[start : start + size]
                        rows.append((doc, start, size, zlib.crc32(piece.tobytes()), n, sequence, offset, *[piece.astype(np.int32)] * with_ids))
                        start += size
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def pack(spark: SparkSession, docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """Pieces doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and on request ids, in windows of ``length``.

    A document (doc_id, text, any others) is the ids of its whole text and one id 0 after it, so a null or empty text is
    one id. Every id lies in one piece; sequences are full but for the last. A document longer than a window makes
    several pieces. Documents stand in the order of the input's partitions, repeated rows each for itself; null ids are
    allowed. An empty table gives no pieces.
    """
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    tokens = scratch.keep(_tokenized(docs, vocabulary), "tokens")
    totals = sorted((r["task"], r["n"]) for r in tokens.groupBy("task").agg(F.sum("n").alias("n")).collect())
    starts = spark.createDataFrame([(t, b) for (t, _), b in zip(totals, accumulate((n for _, n in totals), initial=0), strict=False)], "task int, base long")
    placed = tokens.join(F.broadcast(starts) if len(totals) < 1_000_000 else starts, "task").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    return placed.mapInArrow(_cut(length, ids), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), ids=False)
