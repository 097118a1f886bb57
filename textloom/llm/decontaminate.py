"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Each test item's text is lower-cased (A-Z) and cut into words; every ``window``
consecutive words are one n-gram, and an item of fewer words, but not none, is one
shorter n-gram. The n-grams are broadcast as a hash set; documents are scanned by
word windows, hash hits are verified word by word, and the words inside verified
windows are hit. No shuffle takes place: a document is read once, where it lies.

Defined results: a null or wordless text has no words and no hits; an item without
words never occurs; a null ``item_id`` counts as the empty string; repeated items
count once per distinct id; repeated documents each get their own row; other columns
of either table play no part. An empty benchmark leaves every document clean.

The hash set is broadcast only in pieces of at most ``max_broadcast_bytes`` of test
text (a matcher takes some ten times that). A larger benchmark makes as many pieces as
that takes, a very large item is cut into parts that share all but one word of a window,
and each piece is scanned in a pass of its own whose hits are merged into those of the
passes before. Texts are cut once, after the last pass, so the outcome is the same in
any number of passes.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, cut, word_values

WINDOW = 10
MAX_BROADCAST_BYTES = 8 << 20
#: Multiplier of the polynomial hash of a window.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Matcher:
    """The hash set of n-grams, by length, over the ids of the words that occur in them. Word id 0 is any other word. Arrays only: sorted hashes, each with its n-gram's words and the items that hold it."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items: list[str] = []
        rows, owners = defaultdict(list), defaultdict(list)
        for item, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in text.translate(ALNUM_WORDS).split()], np.int32)
            if n := min(window, len(words)):
                made = np.lib.stride_tricks.sliding_window_view(words, n)
                rows[n].append(made)
                owners[n].append(np.full(len(made), len(self.items), np.int32))
                self.items.append(item)
        self.tables = {n: self._table(np.concatenate(rows[n]), np.concatenate(owners[n])) for n in rows}

    def _table(self, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hashes of the distinct n-grams, ascending; their words; where each one's items start; items)."""
        h = self.hash(rows)
        order = np.lexsort((owner, *rows.T, h))
        h, rows, owner = h[order], rows[order], owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(1)))
        once = new | np.concatenate(([True], owner[1:] != owner[:-1]))
        first = np.flatnonzero(new[once])
        return h[new], rows[new], np.append(first, once.sum()), owner[once]

    @staticmethod
    def hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = h * BASE + rows[:, k].astype(np.uint64)
        return h

    def find(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """Verified windows: (start, length, items) over an array of word ids."""
        found = []
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, (hashes, grams, first, owner) in self.tables.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(n)]
            h = self.hash(rows)
            low = np.searchsorted(hashes, h)
            hit = hashes[np.minimum(low, len(hashes) - 1)] == h
            for i, row, want, g in zip(at[hit].tolist(), rows[hit], h[hit].tolist(), low[hit].tolist(), strict=True):
                while g < len(hashes) and hashes[g] == want:
                    if np.array_equal(grams[g], row):
                        found.append((i, n, [self.items[k] for k in owner[first[g] : first[g + 1]].tolist()]))
                        break
                    g += 1
        return found


def matchers(items: Iterable[tuple[str, bytes]], window: int, most: int) -> Iterator[Matcher]:
    """Matchers of at most about ``most`` bytes of text each, one at least."""
    held, size = [], 0

    def parts(item, text):
        while len(text) > most:
            words = list(re.finditer(rb"\S+", text[: most + (most >> 2)].translate(ALNUM_WORDS)))
            last = next((k for k in range(len(words) - 1, -1, -1) if words[k].end() < most), -1)
            if last < window or last + 1 == len(words):
                break  # a word of that size, or no word behind the cut
            yield item, text[: words[last].end()]
            text = text[words[last - window + 2].start() :]
        yield item, text

    for item, text in items:
        for part in parts(item, text) if len(text) > most else ((item, text),):
            if held and size + len(part[1]) > most:
                yield Matcher(held, window)
                held, size = [], 0
            held.append(part)
            size += len(part[1]) + len(part[0])
    yield Matcher(held, window)


class _Ids(dict):
    def __missing__(self, word):
        return 0


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ADDED = [("n_words", pa.int64()), ("hit_spans", SPANS), ("hit_items", pa.list_(pa.string()))]
ADDED_DDL = "n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<string>"


def _scan(shared, merge: bool):
    """For mapInArrow over (key, body[, the columns of ADDED])."""

    def run(batches):
        matcher = shared.value
        value = _Ids(matcher.ids).__getitem__
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = ([], [], [])
            rows, ids, starts = [], [], []

            def flush():
                if not rows:
                    return
                flat = np.concatenate([x for a in ids for x in (a, np.zeros(1, np.int32))])
                first = np.array(starts)
                hits = defaultdict(list)
                for at, n, items in matcher.find(flat):
                    hits[int(np.searchsorted(first, at, "right")) - 1].append((at, n, items))
                for k, a in enumerate(ids):
                    mask, items = np.zeros(len(a), bool), set()
                    if merge:
                        for s in batch.column(3)[rows[k]].as_py():
                            mask[s["start"] : s["end"]] = True
                        items.update(batch.column(4)[rows[k]].as_py())
                    for at, n, found in hits.get(k, ()):
                        mask[at - starts[k] : at - starts[k] + n] = True
                        items.update(found)
                    out[0].append(len(a))
                    out[1].append(_spans(mask) if items else [])
                    out[2].append(sorted(items))
                rows.clear(), ids.clear(), starts.clear()

            total = 0
            for r in range(len(batch)):
                data = texts[r].as_py() or b""
                a = word_values(data, ALNUM_WORDS, value, np.int32)
                rows.append(r), ids.append(a), starts.append(total)
                total += len(a) + 1
                if total > 1 << 20:
                    flush()
                    total = 0
            flush()
            added = [pa.array(x, t) for x, (_, t) in zip(out, ADDED, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added] if shared.keep_text else [batch.column(0), *added], names=(["key", "body"] if shared.keep_text else ["key"]) + [n for n, _ in ADDED])

    return run


class _Shared:
    """A broadcast and whether the scan keeps the text for a next pass."""

    def __init__(self, broadcast, keep_text):
        self.broadcast, self.keep_text = broadcast, keep_text

    @property
    def value(self):
        return self.broadcast.value


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``key`` (a struct of the id and the columns in ``keep``), n_words, hit_spans (word positions, end exclusive) and hit_items (sorted)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("body")).where("body is not null")
    out = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep or [])]).alias("key"), F.col(text_col).cast("string").alias("body"))
    kind = out.schema["key"].dataType.simpleString()
    passes = matchers(((r["item"], r["body"].encode()) for r in items.toLocalIterator()), window, max_broadcast_bytes)
    matcher, merge = next(passes), False
    while matcher is not None:
        following = next(passes, None)
        shared = _Shared(spark.sparkContext.broadcast(matcher), keep_text=following is not None)
        out = out.mapInArrow(_scan(shared, merge=merge), f"key {kind}, " + ("body string, " if following else "") + ADDED_DDL)
        if following is not None:
            out = cut(out)
        matcher, merge = following, True
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The report: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    id_col = options.get("id_col", "doc_id")
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return scan(docs, benchmark, **options).select(
        F.col("key.id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def word_offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text start and end."""
    word = np.frombuffer(data.translate(ALNUM_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "documents", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all their columns: without contaminated documents (``action="documents"``), or with the hit words and what stands between them cut out of the texts (``"spans"``). Clean rows come back as they were."""
    if action not in ("documents", "spans"):
        raise ValueError(f"action: {action!r}")
    names, id_col = docs.columns, docs.columns[0]
    found = scan(docs, benchmark, id_col=id_col, text_col=text_col, window=window, max_broadcast_bytes=MAX_BROADCAST_BYTES, keep=names)
    clean = F.size("hit_spans") == 0
    if action == "documents":
        return found.where(clean).select(*[F.col(f"key.c{i}").alias(c) for i, c in enumerate(names)])
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(at), batch.column(len(names))
            new = []
            for text, held in zip(texts, spans, strict=True):
                if not len(held):
                    new.append(text.as_py())
                    continue
                data = text.as_py().encode()
                first, last = word_offsets(data)
                mask = np.ones(len(data), bool)
                for s in held.as_py():
                    mask[first[s["start"]] : last[s["end"] - 1]] = False
                new.append(np.frombuffer(data, np.uint8)[mask].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(new, texts.type) if k == at else batch.column(k) for k in range(len(names))], names=names)

    rows = found.select(*[F.col(f"key.c{i}").alias(f"c{i}") for i in range(len(names))], "hit_spans")
    return rows.mapInArrow(run, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
