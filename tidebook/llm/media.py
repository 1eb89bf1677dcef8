"""Media columns: texts as lossless pictures, stored, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import small_batches
from tidebook.llm.webp import WIDTH, decode_bytes, encode_bytes
from tidebook.sources.tables import table

FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(pixels: np.ndarray) -> str:
    """Rows, distinct samples, mean, entropy (bits a sample) and a 64-bit average hash of eight by eight areas."""
    rows = pixels.reshape(-1, WIDTH)
    counts = np.bincount(rows.ravel(), minlength=256)
    share = counts[counts > 0] / rows.size
    band = np.minimum(np.arange(len(rows)) * 8 // len(rows), 7)
    area = np.add.reduceat(rows, np.searchsorted(band, np.unique(band)), axis=0, dtype=np.int64)
    area = area.reshape(len(area), 8, -1).sum(2) / np.bincount(band)[np.unique(band)][:, None]
    area = np.resize(area, (8, 8))
    hashed = int("".join("1" if x else "0" for x in (area > area.mean()).ravel()), 2)
    mean = float(np.dot(counts, np.arange(256))) / rows.size
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return f"rows={len(rows)};distinct={len(share)};mean={mean:.3f};entropy={entropy:.3f};hash={hashed:016x}"


def as_payload(text: bytes) -> bytes:
    """``text`` and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def media_columns(docs: DataFrame, files: bool = True) -> DataFrame:
    """The whole text of each row as a lossless WebP picture, decoded again and described.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the bytes decoded from the file),
    media_bytes, media_sha256, feature, and with ``files`` the file itself (media) and its samples (pixels). Null texts
    count as empty, which store 64 zeros. A long text makes several files in one value. Equal texts give equal values;
    rows keep their number, repeated ones and null ids included. Other columns are ignored.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 256):
                rows: list[list] = [[] for _ in range(9)]
                for t in texts.slice(at, 256):
                    text = t.as_py() or b""
                    media = encode_bytes(as_payload(text))
                    pixels = decode_bytes(media)
                    back = pixels.tobytes()
                    if back[: len(text)] != text:
                        raise ValueError("a picture doesn't hold its text")
                    row = [len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels), media, back]
                    for into, x in zip(rows, row, strict=True):
                        into.append(x if files or into is not rows[7] and into is not rows[8] else None)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()][: 9 if files else 7]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "pixels"]
                arrays = [batch.column(0).slice(at, 256), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=False))]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FIELDS + ", media binary, pixels binary" * files)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), files=False)
