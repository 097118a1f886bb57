"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document is the ids of its text and an end id. A longer one than a sequence is cut:
all pieces but the first are full. Each other piece goes to the open sequence, or a new
one, for which the sum of squares of the numbers of open sequences per residual gap
becomes smallest; largest pieces come first, and of equal sums the tightest gap is taken.
The waste of this rule falls with the number of pieces, so blocks are large.

Tokenising is a map over the documents where they lie. Only (id, piece, length, crc) of
the pieces is shuffled: to blocks of about ``BLOCK`` pieces by a hash of the
piece's row number, so blocks are even whatever the rows are, and packed independently of each other.
Sequence numbers are the block times 2 ** 32 plus the number within it.

Defined results: a null text counts as empty, and its document is the end id alone;
repeated rows are separate documents; an empty table gives an empty table; other columns
play no part. ``CAPACITY`` bounds a group's memory: a block holds numbers only.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut
from .token_counts import tokenizer

VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
BLOCK = 1 << 16
#: Units that a worker remembers; the pipeline's workers, which hold other stages' tables too, remember fewer.
MEMO, SMALL_MEMO = 800_000, 300_000
CHUNK = 1 << 20

#: White space whose split isn't plain (three or more, or two at the end), and characters on which classes may differ.
_IRREGULAR = re.compile(r"\s\s\s|\s\s\Z")
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x85 ᠎  ﻿]|<\\|")
#: The pre-tokenizer's pattern, as the library states it.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_POINTS = re.compile(r"( ?[^\W\d_]+)([.,!?;:]+)")


def merger(path: str):
    """bytes of one pre-token -> its ids, by the file's own merges without the cost of a whole call; None where the file's ids don't follow its merges, so that ids and ranks differ."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}  # how byte-level vocabularies write bytes
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in byte)}
    vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or any(vocabulary.get(c, 256) >= 256 for c in byte):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """Ids as little-endian bytes, remembered per unit: a word with the blank before it and what clings to it."""

    def __init__(self, path: str, memo: int = MEMO):
        self.tokenizer, self.merge = tokenizer(path), merger(path)
        self.units = Memo(self._make, memo)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _make(self, unit: str) -> bytes:
        if (m := _WORD_POINTS.fullmatch(unit)) and m[1].lstrip(" ").isalpha():
            return self.units[m[1]] + self.units[m[2]]
        if self.merge and unit.lstrip(" ").isalpha() and unit[1:2] != " ":  # a single pre-token
            return array.array("I", self.merge(unit.encode())).tobytes()
        return self.whole(unit)

    def encode(self, text: str) -> bytes:
        """As the tokenizer encodes the text whole. A unit's pre-tokens are its own wherever one or two white space characters stand alone, so units are looked up one by one."""
        if _ODD.search(text):
            return self.whole(text)
        if len(text) <= CHUNK:
            return self._plain(text)
        out, at = [], 0
        while at < len(text):
            end = at + CHUNK
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and not text[end + 1 : end + 2].isspace() and end + 1 < len(text)):
                end += 1
            out.append(self._plain(text[at:end]))
            at = end
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        get = self.units.__getitem__
        if _IRREGULAR.search(text):
            return b"".join(map(get, _PRETOKEN.findall(text)))
        units = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
        return b"".join(map(get, units))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    if (path, memo) not in _encoders:
        own = _encoders[path, memo] = Encoder(path, memo)
        own.units[""] = b""
    return _encoders[path, memo]


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    n = max(1, -(-length // capacity))
    first = length - (n - 1) * capacity
    return [(0, first)] + [(first + i * capacity, capacity) for i in range(n - 1)]


_TYPES = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_DDL = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and with ``with_ids`` the ids (32-bit little-endian)."""
    end = struct.pack("<I", end_id)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))

    def run(batches):
        own = encoder(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary), memo)
        for batch in batches:
            rows, cols, ids = [], [[] for _ in _TYPES], []
            for r, x in enumerate(batch.column(1)):
                data = own.encode(x.as_py() or "") + end
                for p, (start, n) in enumerate(cuts(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + n)]
                    rows.append(r)
                    for c, v in zip(cols, (p, start, n, zlib.crc32(part)), strict=True):
                        c.append(v)
                    if with_ids:
                        ids.append(part)
            out = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols, _TYPES, strict=True)]]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names=["id", *[n for n, _ in _TYPES]] + ["ids"] * with_ids)

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, {_DDL}" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``, filled in the order given."""
    return _place(lengths, range(len(lengths)), capacity)


def _place(lengths, order, capacity) -> list[list[int]]:
    count = np.zeros(capacity + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by gap
    bins: list[list[int]] = []
    for i in order:
        s = int(lengths[i])
        if s < capacity:
            gaps = np.flatnonzero(count[s:]) + s
            if len(gaps):
                rest = gaps - s
                change = 1 - 2 * count[gaps] + np.where(rest > 0, 2 * count[rest] + 1, 0)
                k = int(change.argmin())
                if change[k] <= 2 * count[capacity - s] + 1:
                    gap = int(gaps[k])
                    b = held[gap].pop()
                    count[gap] -= 1
                    bins[b].append(int(i))
                    if gap > s:
                        held[gap - s].append(b)
                        count[gap - s] += 1
                    continue
            held[capacity - s].append(len(bins))
            count[capacity - s] += 1
        bins.append([int(i)])
    return bins


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Largest first by the sum-of-squares rule."""
    return _place(lengths, np.argsort(-lengths, kind="stable"), capacity)


def packed(docs: DataFrame, *, id_col: str = "doc_id", block: int = BLOCK, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, id_col=id_col, capacity=capacity, **options).withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, -(-rows.count() // block))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).drop("row")

    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = int(group["block"][0].as_py()) << 32
        for n, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + n, at
                at += int(lengths[i])
        return group.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kind = rows.schema["id"].dataType.simpleString()
    out = keyed.groupBy("block").applyInArrow(run, f"id {kind}, {_DDL}, sequence_id bigint, offset bigint")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
