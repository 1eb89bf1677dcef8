"""Write-ahead log segments: frames of fixed records, read as binary files and checked."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the file format.
MAGIC, TRAILER_MAGIC, VERSION = b"LWALSYNC", b"SYNCEND!", 1
HEADER, TRAILER = struct.Struct("<8sHHIIQQ"), struct.Struct("<IQ8s")
RECORD_SIZE, MAX_PAYLOAD = 128, 64 * 1024 * 1024
FRAMES = "segment long, frame long, offset long, first_lsn long, count long, state string"


def record(lsn: int, body: bytes = b"") -> bytes:
    """A record: its log sequence number and up to 120 bytes."""
    return struct.pack("<Q", lsn) + body[:120].ljust(RECORD_SIZE - 8, b"\0")


def encode_frame(records: list[bytes]) -> bytes:
    """One frame of whole records that follow each other."""
    payload = b"".join(records)
    if not records or len(payload) != RECORD_SIZE * len(records) or len(payload) > MAX_PAYLOAD:
        raise ValueError("a frame holds one record or more of fixed size, 64 MiB at most")
    front = HEADER.pack(MAGIC, VERSION, HEADER.size, RECORD_SIZE, len(records), len(payload), struct.unpack_from("<Q", payload)[0]) + payload
    return front + TRAILER.pack(zlib.crc32(front), len(front) + TRAILER.size, TRAILER_MAGIC)


def frames(data: bytes) -> list[tuple[int, int, int, str]]:
    """(offset, first_lsn, count, state) of each frame; reading ends with the first that isn't ok: torn, or what is wrong."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            out.append((at, 0, 0, "torn"))
            break
        magic, version, header, size, count, length, first = HEADER.unpack_from(data, at)
        if magic != MAGIC or version != VERSION or header != HEADER.size or size != RECORD_SIZE or not count or length != count * RECORD_SIZE or length > MAX_PAYLOAD:
            out.append((at, 0, 0, "invalid header"))
            break
        end = at + HEADER.size + length
        if end + TRAILER.size > len(data):
            out.append((at, first, 0, "torn"))
            break
        checksum, whole, closing = TRAILER.unpack_from(data, end)
        state = "ok"
        if closing != TRAILER_MAGIC or whole != HEADER.size + length + TRAILER.size:
            state = "invalid trailer"
        elif zlib.crc32(data[at:end]) != checksum:
            state = "checksum"
        elif any(struct.unpack_from("<Q", data, at + HEADER.size + i * RECORD_SIZE)[0] != first + i for i in range(count)):
            state = "record gap"
        out.append((at, first, count if state == "ok" else 0, state))
        if state != "ok":
            break
        at = end + TRAILER.size
    return out


def read_segments(spark: SparkSession, directory: str) -> DataFrame:
    """segment, content of the files named segment-NNNNNN.wal in a folder of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "segment-*.wal").load(directory)
    return files.select(F.regexp_extract("path", r"segment-(\d{6,})\.wal$", 1).cast("long").alias("segment"), "content").where("segment is not null")


def parsed(segments: DataFrame) -> DataFrame:
    """The frames of (segment, content) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(n, i, *x) for i, x in enumerate(frames(content.as_py()))] or [(n, 0, 0, 0, 0, "empty")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), [pa.int64()] * 5 + [pa.string()], strict=True)], ["segment", "frame", "offset", "first_lsn", "count", "state"])

    return segments.select(F.col("segment").cast("long").alias("segment"), "content").mapInArrow(run, FRAMES)


def recovery(found: DataFrame) -> DataFrame:
    """One row a segment: frames, records, torn, and ``problem``: a gap among segments or sequence numbers, a torn tail
    before the last segment, or what is wrong with a frame; null if it is fit to replay.

    Windows run over segments, of which there is one per file.
    """
    ok = F.col("state") == "ok"
    per = found.groupBy("segment").agg(
        F.count_if(ok).alias("frames"), F.sum("count").alias("records"), F.min(F.when(ok, F.col("first_lsn"))).alias("first_lsn"), F.max(F.when(ok, F.col("first_lsn") + F.col("count"))).alias("next_lsn"),
        F.bool_or(F.col("state") == "torn").alias("torn"), F.max(F.when(~F.col("state").isin("ok", "torn", "empty"), F.col("state"))).alias("wrong"),
    )
    w = Window.orderBy("segment")
    before = F.last("next_lsn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inner = F.col("records") != F.col("next_lsn") - F.col("first_lsn")
    last = F.lead("segment").over(w).isNull()
    problem = F.when(F.col("segment") != F.row_number().over(w) - 1, "segment gap").when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("torn") & ~last, "torn before the last segment").when(inner | (F.col("first_lsn") != F.coalesce(before, F.lit(1))), "sequence gap")
    return per.withColumn("problem", problem).drop("wrong", "next_lsn")
