"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

Candidates are runs of 20 or more characters of ``[A-Za-z0-9+/_=-]``. For each, the
encoding is inferred (decimal, hex, base32, lower, upper, alphanumeric, base64) and
three tests run over its symbols:

* chi-squared uniformity: the statistic's place under the null "symbols as unequal as
  in words" (non-central chi-squared, normal approximation), low where they are even;
* runs of character classes (lower, upper, digit, other): binomial tail under the null
  "classes change as rarely as in words";
* lag-one serial correlation of the symbol values: a candidate whose correlation is
  significant (sequences, repeats) is not random.

The first two p-values are combined by Fisher's method. Both nulls' power grows with
the length, so a short string needs more evidence. Over the whole table a
Benjamini-Hochberg procedure within each class of encoding and length holds the share
of false discoveries at ``FDR``. It needs only a histogram of the p-values per class,
which has a fixed size.

The fixed patterns (kinds assign, access, hex) are found leftmost and without overlap
per kind; a match that fails its extra test is dropped and not tried again elsewhere.

Defined results: a null text counts as empty; repeated rows each get a row; an empty
table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, union

FDR = 0.01
MIN_RUN = 20
#: Chance that two symbols agree in words, as a multiple of the even chance, and that the class changes from one character to the next.
WORD_REPEAT, WORD_CHANGE = 1.9, 0.12
SERIAL_Z = 3.3
#: Cells of the p-value histogram are these steps of -log10(p).
STEP, STEPS = 0.25, 80

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_WORDS = re.compile("password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # a run of fewer fails as a whole
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS.items()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kind as an index into KINDS; code points, end exclusive."""
    out = []
    if ("=" in text or ":" in text) and _WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def encoding(s: str) -> tuple[str, list[int]]:
    """The smallest alphabet that holds the string, and its symbols there. Padding at the end doesn't count."""
    s = s.rstrip("=")
    have = set(s)
    for name, alphabet, index in _SETS:
        if have <= alphabet:
            return name, [index[c] for c in s]
    index = _SETS[-1][2]
    return "base64", [index.get(c, 63) for c in s]


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(symbols: list[int], k: int) -> float:
    """How likely words' uneven symbols would look this even."""
    n = len(symbols)
    x = sum(c * c for c in Counter(symbols).values()) * k / n - n
    mean, var = (k - 1) + (n - 1) * (WORD_REPEAT - 1), 2 * (k - 1) + 4 * (n - 1) * (WORD_REPEAT - 1)
    return _normal_sf((mean - x) / math.sqrt(var))


def runs_p(s: str) -> float:
    """How likely words would change their character class this often (binomial tail)."""
    kind = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in s]
    n = len(s) - 1
    changes = sum(a != b for a, b in zip(kind, kind[1:], strict=False))
    if changes == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(WORD_CHANGE) + (n - i) * math.log(1 - WORD_CHANGE) for i in range(changes, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def serial_z(symbols: list[int]) -> float:
    """Lag-one serial correlation over its standard error."""
    x = np.array(symbols, float)
    if len(x) < 4 or not (v := x.var()):
        return math.inf
    return float(((x[:-1] - x.mean()) * (x[1:] - x.mean())).mean() / v * math.sqrt(len(x) - 1))


def random_p(s: str) -> tuple[str, float]:
    """The inferred encoding and the combined p-value of "this is like words"."""
    name, symbols = encoding(s)
    if len(symbols) < MIN_RUN or abs(serial_z(symbols)) > SERIAL_Z:
        return name, 1.0
    a, b = chi_squared_p(symbols, len(ALPHABETS[name])), runs_p(s)
    x = -2 * (math.log(max(a, 1e-300)) + math.log(max(b, 1e-300)))
    return name, min(1.0, math.exp(-x / 2) * (1 + x / 2))  # chi-squared with four degrees


def candidates(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, class, -log10 p) of each run that the battery looks at."""
    if max(map(len, text.split()), default=0) < MIN_RUN:
        return []
    out = []
    for m in _RUN.finditer(text):
        name, p = random_p(m[0])
        out.append((m.start(), m.end(), f"{name}:{min(12, int(math.log2(m.end() - m.start()) * 2))}", -math.log10(max(p, 1e-20))))
    return out


TYPE = "array<struct<s:int,k:int,e:int>>"
CAND = "array<struct<s:int,e:int,c:string,w:double,f:boolean>>"
_BASE_PA = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
_CAND_PA = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("c", pa.string()), ("w", pa.float64()), ("f", pa.bool_())]))


def _find(batches):
    for batch in batches:
        base, cand = [], []
        for x in batch.column(1):
            text = x.as_py() or ""
            own = base_spans(text)
            held = union([(s, e) for s, _, e in own])
            starts = [s for s, _ in held]
            # A run is free if the last base range that starts before its end ends before its start.
            free = lambda s, e, held=held, starts=starts: (k := bisect.bisect_left(starts, e)) == 0 or held[k - 1][1] <= s
            base.append([{"s": s, "k": k, "e": e} for s, k, e in own])
            cand.append([{"s": s, "e": e, "c": c, "w": w, "f": free(s, e)} for s, e, c, w in candidates(text)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE_PA), pa.array(cand, _CAND_PA)], names=["key", "base", "cand"])


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """Per class the least -log10(p) that Benjamini-Hochberg accepts, from a histogram of fixed size."""
    rows = found.select(F.explode("cand").alias("x")).groupBy(F.col("x.c").alias("c"), F.least(F.floor(F.col("x.w") / STEP), F.lit(STEPS)).cast("int").alias("cell")).agg(F.count("*").alias("n")).collect()  # at most classes x (STEPS + 1) rows
    out: dict[str, float] = {}
    for c in {r["c"] for r in rows}:
        cells = sorted(((r["cell"], r["n"]) for r in rows if r["c"] == c), reverse=True)
        m, above = sum(n for _, n in cells), 0
        for cell, n in cells:
            above += n
            if 10 ** (-cell * STEP) <= fdr * above / m:  # the largest p in the cell, so never too bold
                out[c] = cell * STEP
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """key (struct of id and the columns in ``keep``), base and all: arrays of (start, kind, end) in the order of starts and kinds. ``all`` adds runs that the battery finds and no base span touches."""
    found = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(c) for c in keep or []]).alias("key"), F.col(text_col).alias("body"))
    found = cut(found.mapInArrow(_find, f"key {found.schema['key'].dataType.simpleString()}, base {TYPE}, cand {CAND}"))
    least = thresholds(found, fdr)
    limits = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.lit(None).cast("map<string,double>")
    new = F.filter("cand", lambda x: (x["w"] >= F.coalesce(F.try_element_at(limits, x["c"]), F.lit(math.inf))) & x["f"])
    new = F.transform(new, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    return found.select("key", "base", F.array_sort(F.concat("base", new)).alias("all"))


def _joined(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return scan(docs, id_col=id_col, **options).select(F.col("key.id").alias(id_col), count(0), count(1), count(2), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("all").alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with all their columns; each found span is replaced by ``mask``. Rows without one come back as they were."""
    names = docs.columns
    least = thresholds(docs.select(F.lit(0).alias("key"), F.col(text_col).alias("body")).mapInArrow(_find, f"key int, base {TYPE}, cand {CAND}"), fdr)
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in batches:
            texts, changed = batch.column(at), {}
            for r, x in enumerate(texts):
                text = x.as_py()
                if text and (spans := found_spans(text, least)):
                    parts, last = [], 0
                    for s, e in spans:
                        parts += [text[last:s], mask]
                        last = e
                    changed[r] = "".join(parts) + text[last:]
            if changed:
                cols = list(batch.columns)
                cols[at] = pa.array([changed[r] if r in changed else t.as_py() for r, t in enumerate(texts)], batch.schema.field(at).type)
                if length_at is not None:
                    old = cols[length_at].to_pylist()
                    cols[length_at] = pa.array([len(changed[r]) if r in changed else x for r, x in enumerate(old)], batch.schema.field(length_at).type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def found_spans(text: str, least: dict[str, float]) -> list[tuple[int, int]]:
    """Disjoint spans of all kinds, in order."""
    return union([(s, e) for s, _, e in base_spans(text)] + [(s, e) for s, e, c, w in candidates(text) if w >= least.get(c, math.inf)])


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
