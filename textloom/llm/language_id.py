"""Language identification by bit-sliced Bloom filters over byte n-grams.

Training keeps, for each language, the n-grams (four bytes of lower-cased text whose
ASCII non-letters are blanks) that are at least ``MIN_RATIO`` as frequent there as in
the language where they are most frequent. Each slot of one table is a bit mask of
languages; an n-gram sets its languages' bits at ``HASHES`` slots, so one look-up (the
AND of those slots) returns all languages that contain it. A document's votes for a
language are the popcount of that bit over its n-grams, less the share that the
filter's fill lets through by chance. Most votes win; ties go to the smaller name.

Training reads a bounded sample: of each language about ``SAMPLE_DOCS`` documents
drawn by a hash (the classifier's documented bound), whole texts. Of n-grams, those
rarer than ``MIN_SHARE`` of a language's are left out, which bounds the table. All
documents are predicted from their whole texts, without a shuffle.

Defined results: ``und`` with score 0 for a null text, one without letters, or when no
language was learned; a text with letters whose n-grams are all unknown gets the most
frequent language with score 0. Score is the winner's share of all votes. A null id
counts as the empty string for the fold; repeated rows each get a row; other columns
play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_parts

SAMPLE_DOCS = 2_000
MIN_RATIO, MIN_SHARE, MIN_COUNT = 0.5, 5e-6, 2
HASHES = 3
SLICE = 1 << 20
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile("[A-Za-z]")


def letters(text: str | None) -> bool:
    return text is not None and (bool(_LETTER.search(text)) or any(c.isalpha() for c in text))


def folded(text: str) -> bytes:
    return b"  " + text.lower().encode().translate(_BLANK) + b" "


def codes(data: bytes) -> np.ndarray:
    """The n-grams as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


class Filters:
    """Bit-sliced Bloom filters: ``table[slot]`` has bit l set if language l's filter has that slot set."""

    def __init__(self, languages: list[str], prior: int, grams: list[np.ndarray]):
        self.languages, self.prior = languages, prior
        most = max([len(g) for g in grams], default=1)
        self.bits = max(12, int(np.ceil(np.log2(12 * max(1, most)))))
        self.planes = [np.zeros(1 << self.bits, np.uint8) for _ in range((len(languages) + 7) // 8)]
        for l, g in enumerate(grams):
            for slots in self.slots(g):
                self.planes[l // 8][slots] |= np.uint8(1 << (l % 8))
        self.chance = np.array([np.mean((self.planes[l // 8] >> (l % 8)) & 1) ** HASHES for l in range(len(languages))])

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        g = grams.astype(np.uint64)
        return [((g * m) >> np.uint64(64 - self.bits)).astype(np.int64) for m in MIX[:HASHES]]

    def votes(self, data: bytes, cuts: np.ndarray) -> np.ndarray:
        """Per text and language the popcounts; ``cuts`` has where each text starts in ``data``, and its length at the end. N-grams across two texts don't count."""
        n, grams = len(cuts) - 1, codes(data)
        owner = np.repeat(np.arange(n), np.diff(cuts))[: len(grams)]
        inside = np.arange(len(grams)) + 3 < cuts[owner + 1]
        grams, owner = grams[inside], owner[inside]
        slots = self.slots(grams)
        out = np.zeros((n, 1 + len(self.languages)))
        out[:, 0] = np.bincount(owner, minlength=n)
        for p, plane in enumerate(self.planes):
            mask = plane[slots[0]]
            for s in slots[1:]:
                mask = mask & plane[s]
            held = np.bincount(owner * 256 + mask, minlength=n * 256).reshape(n, 256)
            for l in range(8 * p, min(8 * p + 8, len(self.languages))):
                out[:, 1 + l] = held @ ((np.arange(256) >> (l - 8 * p)) & 1)
        return out

    def decide(self, votes: np.ndarray) -> tuple[list[str], np.ndarray]:
        true = np.maximum(0, (votes[:, 1:] - votes[:, :1] * self.chance) / np.maximum(1e-9, 1 - self.chance))
        total = true.sum(1)
        best = np.where(total > 0, true.argmax(1), self.prior)
        score = np.where(total > 0, true.max(1) / np.maximum(total, 1e-300), 0.0)
        return [self.languages[b] for b in best], np.clip(score, 0, 1)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _count(batches):
    """(lang, text) -> (lang, gram, n), summed over each batch."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(folded(text))
        for lang, texts in by.items():
            grams, n = np.unique(codes(b"".join(texts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Learns from the rows that have a text and a language and are not held out."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"), F.col(id_col).alias("id")).where(F.col("body").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return Filters([], 0, [])
    languages = sorted(counts)
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in counts.items()], "lang string, share double")
    drawn = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    held = drawn.select("lang", "body").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    held = cut(held.where(F.col("n") >= MIN_COUNT))
    totals = held.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = held.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= MIN_SHARE)
    found = frequent.toArrow()  # at most 1 / MIN_SHARE rows a language
    lang = np.array([languages.index(x) for x in found["lang"].to_pylist()], int)
    gram, rate = found["gram"].to_numpy().astype(np.uint32), found["rate"].to_numpy()
    distinct, of = np.unique(gram, return_inverse=True)
    top = np.zeros(len(distinct))
    np.maximum.at(top, of, rate)
    keep = rate >= MIN_RATIO * top[of]
    prior = languages.index(min(counts, key=lambda k: (-counts[k], k)))
    return Filters(languages, prior, [gram[keep & (lang == l)] for l in range(len(languages))])


def texts_decided(model: Filters, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text; works on slices of bounded size."""
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return pred, score
    votes = np.zeros((len(texts), 1 + len(model.languages)))
    buffer, cuts, rows = [], [0], []

    def flush():
        if rows:
            np.add.at(votes, rows, model.votes(b"".join(buffer), np.array(cuts)))
        buffer.clear(), rows.clear()
        cuts[:] = [0]

    valid = [r for r, t in enumerate(texts) if letters(t)]
    for r in valid:
        data = folded(texts[r])
        for at in range(0, len(data) - 3, SLICE):
            part = data[at : at + SLICE + 3]
            buffer.append(part), rows.append(r), cuts.append(cuts[-1] + len(part))
            if cuts[-1] >= SLICE:
                flush()
    flush()
    if valid:
        names, scores = model.decide(votes[valid])
        for r, name, s in zip(valid, names, scores.tolist(), strict=True):
            pred[r], score[r] = name, s
    return pred, score


def _decided(model: Filters, column) -> tuple[list[str], list[float]]:
    pred, score = [], []
    for texts in text_parts(column):
        names, scores = texts_decided(model, texts)
        pred += names
        score += scores
    return pred, score


def predict(docs: DataFrame, model: Filters, *, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 12 slots for each of at most 1 / MIN_SHARE n-grams
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(c) for c in names if c != text_col]).alias("row") if len(names) > 1 else F.struct(F.lit(0).alias("none")).alias("row"), F.col(text_col).alias("body"))

    def run(batches):
        for batch in batches:
            pred, score = _decided(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_docs=sample_docs)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return predict(slim, model).select(F.col("row.id").alias(id_col), held_out(F.col("row.id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with all their columns, without those whose language can't be told: no text, no letters, or no known n-gram at all."""
    model = train(docs, text_col=text_col, sample_docs=sample_docs)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            pred, score = _decided(shared.value, batch.column(at))
            yield batch.filter(pa.array([p != "und" and s > 0 for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
