"""Text functions as Column expressions; only what Catalyst cannot say is a pandas UDF."""

from __future__ import annotations

import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- Fixed values: word lists, labels and patterns that results depend on. ---

STOP_WORDS = [
    "about", "after", "again", "against", "also", "among", "because", "before", "being", "between", "could", "during", "every", "from", "have", "into", "more",
    "only", "other", "over", "said", "should", "some", "than", "that", "their", "there", "these", "they", "this", "through", "under", "were", "when", "where",
    "which", "while", "with", "would",
]
OPINION_TIERS = ["Entirely factual", "Somewhat factual but also opinionated", "Expresses writer's opinion"]
STYLES = ["objective_style", "opinionated_style"]
BIAS_ALIASES = {"0": "Non-biased", "0.0": "Non-biased", "nonbiased": "Non-biased", "non-biased": "Non-biased", "1": "Biased", "1.0": "Biased", "biased": "Biased"}
CURLY_APOSTROPHES = "‘’‛′＇"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"
LINK_SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
SIGNIFICANT_WORD = r"[A-Za-z][A-Za-z0-9'-]{2,}"
WORD = r"[A-Za-z0-9'-]+"
BOILERPLATE = [
    r"\bsign\s*up\b", r"\bsubscribe\b", r"\bnewsletter\b", r"\bclick here\b", r"\bread (?:more|next)\b", r"\brelated (?:articles?|stories|posts)\b",
    r"\brecommended for you\b", r"\btrending\b", r"\bmost (?:read|popular)\b", r"\badvertisement\b", r"\bsponsored\b", r"\bpromoted\b", r"\baccept (?:all )?cookies\b",
    r"\bcookie (?:policy|settings|preferences)\b", r"\bprivacy policy\b", r"\bterms of (?:service|use)\b", r"\ball rights reserved\b", r"\bfollow us\b", r"\bshare this\b",
    r"\bshare on\b", r"\blog ?in\b", r"\bsign ?in\b", r"\bcreate (?:an )?account\b", r"\bskip to (?:main )?content\b", r"\bdownload (?:the|our) app\b", r"\bwatch live\b",
    r"\bleave a comment\b", r"\bview all comments\b", r"\bloading\b", r"\bcontinue reading\b", r"\bback to top\b", r"\benable javascript\b", r"\bad[- ]?blocker\b",
    r"\bgetty images\b", r"^©", r"\bcopyright \d{4}\b",
]
STRONG_BOILERPLATE = [r"\baccept (?:all )?cookies\b", r"\ball rights reserved\b", r"^©", r"\bcopyright \d{4}\b", r"\bskip to (?:main )?content\b", r"\benable javascript\b"]
#: What the extractor reads instead of an apostrophe in wrongly decoded text.
MOJIBAKE_APOSTROPHE = "â€™"

# --- Normal forms ---


def collapse(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Catalyst lacks."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _beyond_ascii(c: Column) -> Column:
    """``c`` where it holds more than ASCII, else null: what has to be sent to Python."""
    return F.when(c.rlike("[^\\x00-\\x7F]"), c)


def nfkc_plain(c: Column) -> Column:
    """``nfkc``; ASCII text stays in the JVM."""
    return F.coalesce(nfkc(_beyond_ascii(c)), c)


def normalize_text(c: Column) -> Column:
    """NFKC, white space collapsed, trimmed; null becomes empty."""
    return collapse(nfkc_plain(F.coalesce(c, F.lit(""))))


@F.pandas_udf(StringType())
def casefold_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def casefold(c: Column) -> Column:
    """Full case folding; ASCII text stays in the JVM."""
    return F.coalesce(casefold_exact(_beyond_ascii(c)), F.lower(c))


def text_hash(c: Column) -> Column:
    """Identity of annotated text: sha256 of the normal form, folded."""
    return F.sha2(casefold(normalize_text(c)), 256)


def content_hash(c: Column) -> Column:
    """Identity of corpus text: sha256 of collapsed text, case kept. Not the same identity as ``text_hash``."""
    return F.sha2(collapse(F.coalesce(c, F.lit(""))), 256)


def first_existing(columns: list[str], requested: str | None, aliases: list[str] = (), *, required: bool = False) -> str | None:
    """The first of the requested name and its aliases that exists."""
    found = next((x for x in [requested, *aliases] if x and x in columns), None)
    if found is None and required:
        raise ValueError(f"none of {[requested, *aliases]} among {columns}")
    return found


# --- Labels ---


def _lookup(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def bias_label(c: Column) -> Column:
    label = normalize_text(c)
    return F.coalesce(_lookup(casefold(label), BIAS_ALIASES), label)


def bias_id(label: Column) -> Column:
    return F.when(label == "Biased", 1).when(label == "Non-biased", 0)


def opinion_label(c: Column) -> Column:
    label = F.translate(normalize_text(c), CURLY_APOSTROPHES, "'" * len(CURLY_APOSTROPHES))
    return F.coalesce(_lookup(casefold(label), {x.casefold(): x for x in OPINION_TIERS}), label)


def opinion_id(label: Column) -> Column:
    return _lookup(label, {x: i for i, x in enumerate(OPINION_TIERS)})


def style_label(label: Column) -> Column:
    return _lookup(label, {OPINION_TIERS[0]: STYLES[0], OPINION_TIERS[1]: STYLES[1], OPINION_TIERS[2]: STYLES[1]})


def style_id(label: Column) -> Column:
    return _lookup(style_label(label), {x: i for i, x in enumerate(STYLES)})


def ordered_labels(found: list[str], preferred: list[str]) -> list[str]:
    """Preferred order first, then the others by name."""
    return [x for x in preferred if x in found] + sorted(set(found) - set(preferred))


def source_dataset(file: Column) -> Column:
    name = F.lower(F.element_at(F.split(file, "/"), -1))
    return F.when(name.contains("mbic"), "MBIC").when(name.contains("basil"), "BASIL").otherwise("BABE")


def classifier_input(c: Column) -> Column:
    """The marked input; an empty text is an error."""
    text = normalize_text(c)
    return F.when(text == "", F.raise_error(F.lit("classifier target text must not be empty"))).otherwise(F.concat(F.lit("[TARGET]\n"), text))


def mask_label(c: Column) -> Column:
    return F.coalesce(c, F.lit(-100))


# --- Sentences and words ---


def sentences(c: Column, pattern: str = SENTENCE_BREAK) -> Column:
    """Array of sentences: collapsed text cut before a capital or digit after an end mark; the whole text if nothing else."""
    text = collapse(c)
    found = F.filter(F.split(text, pattern), lambda s: F.trim(s) != "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(found)


def paragraph_sentences(c: Column) -> Column:
    """Sentences that don't cross line ends."""
    blocks = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n+"), lambda b: F.trim(b)), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: sentences(b)))


def count_sentences(c: Column) -> Column:
    return F.size(sentences(c, LINK_SENTENCE_BREAK))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def is_prose(c: Column) -> Column:
    words = word_count(c)
    ends = F.rtrim(c).rlike(r"[.!?\"”]$")
    return ((words >= 12) & (F.char_length(c) >= 80)) | ((words >= 6) & ends & F.substring(c, F.lit(2), F.char_length(c)).rlike(r"\p{Ll}"))


def let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once: inlined into a lambda, it would be computed again for each element."""
    return F.transform(F.array(value), of)[0]


def compact_query(c: Column, terms: int = 14) -> Column:
    """The first distinct significant words, stop words left out."""
    words = F.regexp_extract_all(F.replace(c, F.lit(MOJIBAKE_APOSTROPHE), F.lit("'")), F.lit(SIGNIFICANT_WORD), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("seen"), none.alias("kept"))

    def step(state, word):
        low = F.lower(word)
        skip = (F.size(state["kept"]) >= terms) | F.array_contains(state["seen"], low) | F.array_contains(stop, low)
        return F.when(skip, state).otherwise(F.struct(F.array_append(state["seen"], low).alias("seen"), F.array_append(state["kept"], word).alias("kept")))

    return F.array_join(F.aggregate(words, start, step)["kept"], " ")


def boilerplate_reason(text: Column) -> Column:
    """``boilerplate_keyword``, ``too_short`` or null; a strong pattern counts at any length, the wide lexicon only in short text."""
    strong, wide = "(?i)" + "|".join(STRONG_BOILERPLATE), "(?i)" + "|".join(BOILERPLATE)
    words, length = word_count(text), F.char_length(text)
    return F.when(text.rlike(strong) | ((length < 120) & (words <= 20) & text.rlike(wide)), "boilerplate_keyword").when((words <= 3) & (length < 30), "too_short")


def chunk_words(c: Column, size: int = 350, overlap: int = 50) -> Column:
    """Array of (chunk_index, start_word, end_word, chunk): windows of words with a fixed stride, the last one ending with the text."""
    stride = size - overlap
    if stride <= 0 or overlap < 0:
        raise ValueError("overlap must be smaller than size")
    empty = F.array().cast("array<struct<chunk_index:int,start_word:int,end_word:int,chunk:string>>")

    def windows(words):
        n = F.size(words)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / stride).cast("int"))

        def window(i):
            start = i * stride
            return F.struct(i.alias("chunk_index"), start.alias("start_word"), F.least(start + size, n).alias("end_word"), F.array_join(F.slice(words, start + 1, size), " ").alias("chunk"))

        return F.when(n == 0, empty).otherwise(F.transform(F.sequence(F.lit(0), last), window))

    return let(F.filter(F.split(collapse(c), " "), lambda w: w != ""), windows)


# --- Ids ---


def document_id(url: Column) -> Column:
    return F.concat(F.lit("doc_"), F.sha2(url, 256))


def chunk_id(doc: Column, index: Column, text: Column, version: str) -> Column:
    return F.concat(F.lit("chunk_"), F.sha2(F.concat_ws(chr(0), doc, index.cast("string"), text, F.lit(version)), 256))


def point_id(namespace: uuid.UUID):
    """Name-based (version 5) UUID of a column in a namespace, from SHA-1 with the version bits set."""

    def of(c: Column) -> Column:
        digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(c, "UTF-8")))
        variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
        return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))

    return of


def seeded_hash(seed: int, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), c), 256)


def merge_ids(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def same_minor(a: Column, b: Column) -> Column:
    """Same major and minor version."""
    return (F.split_part(a, F.lit("."), F.lit(1)) == F.split_part(b, F.lit("."), F.lit(1))) & (F.split_part(a, F.lit("."), F.lit(2)) == F.split_part(b, F.lit("."), F.lit(2)))


def redact_map(m: Column) -> Column:
    """Values under key-like names masked."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("key|token|secret|password"), F.lit("[redacted]")).otherwise(v))


def iso_utc(c: Column) -> Column:
    """``YYYY-MM-DD`` or an ISO time as UTC text with a Z; no zone means UTC; null if unreadable. Needs a session in UTC."""
    return F.date_format(F.try_to_timestamp(F.trim(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def mime_type(c: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))


def charset(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)charset\s*=\s*[\"']?([^;\"'\s]+)", 1), F.lit("")))


def decode_bytes(data: bytes, declared: str | None) -> str:
    """Declared charset, then UTF-8 with or without a mark, then Latin-1, which always succeeds."""
    for name in (declared, "utf-8", "utf-8-sig"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("latin-1")


def json_list(text: str) -> list:
    """The list in a model's answer: code fences stripped, else the widest bracketed part; anything else is no list."""
    import json

    text = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
    for part in (text, m[0] if (m := re.search(r"\[.*\]", text, re.S)) else ""):
        try:
            if isinstance(found := json.loads(part), list):
                return found
        except ValueError:
            pass
    return []
