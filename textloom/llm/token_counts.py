"""Token counts without token ids: pieces are counted once per distinct pre-token.

The tokenizer lower-cases, composes (NFC) and drops white space, so its pre-tokens never
cross white space.

1. Each task collects the distinct pre-tokens of its texts with how often it saw them;
   the cluster reduces them to one table, and each distinct pre-token is given to the
   tokenizer once: (pretoken, seen, pieces).
2. Each document is turned into its pre-token frequencies, which are joined to that
   table. Its most frequent part (``COMMON`` rows and ``COMMON_BYTES`` at most, whatever
   the input) is broadcast, and joined where the texts lie. What is left, the rare
   pre-tokens of each document, is joined by a shuffle. A document's count is the sum
   of frequency times pieces. No text is given to the tokenizer whole.

A blank-separated unit with characters whose folding is not plain (combining marks, rare
scripts, controls) or with ``<|`` (special tokens inside texts) is a pre-token of its
own: the tokenizer counts it as it stands.

Frequent pre-tokens are never shuffled but in counts of whole tasks, so no key is hot:
the rare ones are rare by their count. A text's frequencies take memory in proportion to
its distinct words.

Defined results: a null text has 0 bytes and 0 tokens; repeated rows each get a row; an
empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MEMO = 400_000
CHUNK = 1 << 20
#: Pre-tokens that are broadcast, at most, and their bytes.
COMMON, COMMON_BYTES = 300_000, 8 << 20
#: Pre-tokens that a task holds before it passes them on.
HELD = 400_000

#: Characters beyond these are left to the tokenizer itself.
_UNSAFE = re.compile("[^\t\n\r -~¡-įı-ɏ‐-‧‰-⁞₠-₿Ѐ-џぁ-ゖゝ-ヿ一-鿿]")
#: White space at which texts are cut into units; any other is left to the tokenizer.
_BLANK = re.compile("[\t\n\r ]+")
#: The pre-tokenizer's pattern, as the vocabulary file states it.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Units whose pre-tokens are plain: ASCII letters, and what punctuation clings to them. "<|" goes to the tokenizer.
_PLAIN = re.compile("([A-Za-z]+)([!-/:;=>?@\\[\\\\\\]^_`{}~]*)")

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """One instance a worker process."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class Counts:
    """Units of texts, their pre-tokens, and pieces of a pre-token."""

    def __init__(self, path: str, memo: int = MEMO):
        self.tokenizer = tokenizer(path)
        self.pretokens = Memo(self._split, memo)

    def pieces(self, pretoken: str) -> int:
        return len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)

    @staticmethod
    def _split(unit: str) -> tuple[str, ...]:
        if m := _PLAIN.fullmatch(unit):
            return (m[1].lower(), m[2]) if m[2] else (m[1].lower(),)
        return (unit,) if _UNSAFE.search(unit) or "<|" in unit else tuple(_PRETOKEN.findall(unit.lower()))

    @staticmethod
    def units(text: str):
        """Frequencies of the units of a text, a part of it at a time."""
        at = 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                end = gap.start() if (gap := _BLANK.search(text, end)) else len(text)
            part = text[at:end]
            yield Counter(_BLANK.split(part) if _UNSAFE.search(part) or "<|" in part else part.lower().split())
            at = end

    def count(self, text: str) -> int:
        return sum(n * sum(map(self.pieces, self.pretokens[u])) for part in self.units(text) for u, n in part.items())


_counts: dict[str, Counts] = {}


def counts(path: str) -> Counts:
    if path not in _counts:
        _counts[path] = Counts(path)
    return _counts[path]


def _path(vocabulary: str) -> str:
    return vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)


def pretoken_table(texts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pretoken, seen, pieces) of a column of texts: every distinct pre-token once."""

    def collect(batches):
        own, held = counts(_path(vocabulary)), Counter()

        def lines():
            out = Counter()
            for unit, n in held.items():
                for p in own.pretokens[unit]:
                    out[p] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], names=["pretoken", "seen"])

        for batch in batches:
            for x in batch.column(0):
                for part in own.units(x.as_py() or ""):
                    held.update(part.keys())
                    if len(held) >= HELD:
                        yield lines()
        yield lines()

    def count(batches):
        own = counts(_path(vocabulary))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.pieces(p.as_py()) for p in batch.column(0)], pa.int32())], names=["pretoken", "seen", "pieces"])

    distinct = texts.mapInArrow(collect, "pretoken string, seen bigint").groupBy("pretoken").agg(F.sum("seen").alias("seen"))
    return cut(distinct.mapInArrow(count, "pretoken string, seen bigint, pieces int"))


def _least(table: DataFrame) -> int:
    """From which count on pre-tokens are broadcast: a power of two, so that the bounds hold."""
    level = F.floor(F.log2("seen")).cast("int")
    rows = size = 0
    least = 62
    for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("pretoken")).alias("bytes")).orderBy(F.col("level").desc()).collect():
        rows, size = rows + r["n"], size + r["bytes"]
        if rows > COMMON or size > COMMON_BYTES:
            break
        least = r["level"]
    return 1 << least


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``vocabulary``: a name for ``public_tokenizers.path``, or a path on the executors."""
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    slim = docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), F.col(text_col).cast("string").alias("body"))
    table = pretoken_table(slim.select("body"), vocabulary)
    least = _least(table)
    common = table.where(F.col("seen") >= least).select("pretoken", "pieces").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(common["pretoken"].to_pylist(), common["pieces"].to_pylist(), strict=True)))

    def run(batches):
        own, known = counts(_path(vocabulary)), shared.value

        def of(unit):
            """Pieces of a unit's common pre-tokens, and its rare ones."""
            total, rare = 0, []
            for p in own._split(unit):
                if (n := known.get(p)) is None:
                    rare.append(p)
                else:
                    total += n
            return total, rare

        memo = Memo(of, MEMO)
        for batch in batches:
            sums, keys, often, ends = [], [], [], [0]
            for x in batch.column(3):
                total, rest = 0, Counter()
                for part in own.units(x.as_py() or ""):
                    for unit, n in part.items():
                        pieces, rare = memo[unit]
                        total += n * pieces
                        for p in rare:
                            rest[p] += n
                sums.append(total)
                keys += rest.keys()
                often += rest.values()
                ends.append(len(keys))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(at, pa.array(keys, pa.string())), pa.ListArray.from_arrays(at, pa.array(often, pa.int64()))],
                names=["row", "id", "n_bytes", "common", "rare", "often"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    counted = cut(slim.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(run, f"row bigint, id {kind}, n_bytes bigint, common bigint, rare array<string>, often array<bigint>"))
    rare = counted.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("pretoken"), F.col("x.often").alias("often"))
    added = rare.join(table.where(F.col("seen") < least), "pretoken").groupBy("row").agg(F.sum(F.col("often") * F.col("pieces")).alias("rare"))
    n_tokens = (F.col("common") + F.coalesce(F.col("rare"), F.lit(0))).alias("n_tokens")
    out = counted.drop("rare").join(added, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n_tokens)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
