"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from textloom.operators.graph import shared_dir as checkpoint_dir  # noqa: F401
from textloom.operators.graph import written as cut  # noqa: F401

#: Bytes of one text that are split into words at a time.
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: with Spark's 10,000, batches of long texts take hundreds of MB in the JVM and again in Python.
BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session with batches of ``BATCH_ROWS``, unless it states a number of its own."""
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return spark


def byte_table(keep) -> bytes:
    """A table for ``bytes.translate``: A-Z lower-cased, bytes for which ``keep`` is false turned into blanks. UTF-8 continuation and lead bytes go through ``keep`` like the rest."""
    out = bytearray(256)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        out[b] = c if keep(c) else 32
    return bytes(out)


#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM_WORDS = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Words are what ASCII white space separates.
BLANK_WORDS = byte_table(lambda b: b not in (9, 10, 11, 12, 13))


class Memo(dict):
    """A dictionary that fills itself by ``make``. Memory is bounded: at half of ``limit`` entries it starts anew, with what it still meets of the former half, and keys of more than ``longest`` are not kept."""

    def __init__(self, make, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.former = make, max(1, limit // 2), longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.former = dict(self)
            self.clear()
        value = self.former.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The disjoint ranges that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def text_parts(column, most: int = 1 << 22) -> Iterator[list]:
    """The values of a column of texts in lists of about ``most`` bytes, so that a batch of long texts isn't held twice."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, end - at).to_pylist()
        at = end


def word_chunks(data: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size, cut at blanks only."""
    data = data.translate(table)
    if len(data) <= CHUNK_BYTES:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + CHUNK_BYTES
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def word_values(data: bytes, table: bytes, value, dtype) -> np.ndarray:
    """``value(word)`` for each word of a text."""
    parts = [np.fromiter(map(value, w), dtype, len(w)) for w in word_chunks(data, table)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, dtype)
