"""Personal data: fixed patterns, and a linear-chain conditional random field.

The CRF works on word shapes: a token (letters, digits, or one other character) has one
of some forty shapes, and the features are combinations of the shapes around it. It is
trained on the driver from a small labelled table (``labelled_sentences``: a fixed
number of sentences made from forms of addresses and numbers, and of things that look
alike), by penalised likelihood with exact forward-backward gradients. Documents are
decoded by Viterbi over padded numpy batches, where they lie, without a shuffle.

Every kind that the CRF knows has a digit or an ``@``, or the words ``at`` and ``dot``
in it, so only segments (lines, long ones in pieces, cut at ``SEGMENT`` tokens with an overlap) with
such a character or pair of words are decoded; in all others no label but O is allowed. A decoded span counts
if it passes its kind's check and overlaps no span of the fixed patterns; those stay.

The fixed patterns are leftmost and without overlap per kind (email, ip, card, phone);
a match that fails its check is dropped and not tried again elsewhere.

Defined results: a null text counts as empty; repeated rows each get a row; an empty
table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, text_parts, union

KINDS = ("email", "ip", "card", "phone", "national_id")
BASE_KINDS = 4
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: Sentences of the labelled table, bits of the feature hash, tokens of a segment, tokens that two segments share.
SENTENCES, HASH_BITS, SEGMENT, OVERLAP = 700, 14, 160, 32
SEED = 7

# --- fixed patterns ---------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run of digits fails from each of its places or from none
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LINE_END = re.compile(r"\r\n|[\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029]")  # as splitlines
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, in linear time: from each @ to both sides."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done if done > at else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))] if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- shapes and features ----------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_WORD_CLASSES = [{"at"}, {"dot"}, {"com", "org", "net", "edu", "example"}, {"phone", "tel", "telephone", "call", "mobile", "fax", "cell"}, {"email", "mail", "contact", "write"}, {"card", "visa", "credit", "debit", "mastercard"}, {"ip", "host", "server", "address"}, {"ssn", "social", "security", "tax", "insurance"}, {"version", "v", "page", "chapter", "section", "license"}]
_PUNCT = "@.-+():/,_#$%*|=!&"
PAD = 0


def shape(token: str) -> int:
    """A small number for a token's shape; 0 is the padding between segments."""
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return 1 + (n - 1 if n <= 4 else 4 if n <= 6 else 5 if n <= 9 else 6 if n <= 12 else 7 if n <= 19 else 8)
    if c.isalpha():
        low = token.lower()
        for i, words in enumerate(_WORD_CLASSES):
            if low in words:
                return 10 + i
        return 20 + (0 if len(token) == 1 else 1 if token.isupper() else 2 if token.istitle() else 3 if token.islower() and len(token) <= 3 else 4 if token.islower() else 5)
    return 30 + (_PUNCT.index(c) if c in _PUNCT else len(_PUNCT))


SHAPES = 64
#: Offsets that each feature combines; -9 stands for whether white space precedes the token.
TEMPLATES = [(0,), (-1, 0), (0, 1), (-1, 1), (-2, -1, 0), (0, 1, 2), (-1, 0, 1), (-3, -2, -1, 0), (0, 1, 2, 3), (-2, -1, 0, 1, 2), (0, -9), (-4, -3, -2, -1, 0), (0, 1, 2, 3, 4), (-2, 0, 2), (-4, -2, 0)]
REACH = 4


def features(shapes: np.ndarray, spaced: np.ndarray) -> np.ndarray:
    """Hashed feature numbers of each token; segments must be ``REACH`` paddings apart."""
    n = len(shapes)
    wide = np.concatenate((np.zeros(REACH, np.int64), shapes, np.zeros(REACH, np.int64))).astype(np.uint64)
    out = np.empty((n, len(TEMPLATES)), np.int64)
    for t, offsets in enumerate(TEMPLATES):
        h = np.full(n, t + 1, np.uint64)
        for o in offsets:
            h = h * np.uint64(SHAPES + 3) + (spaced.astype(np.uint64) if o == -9 else wide[REACH + o : REACH + o + n])
        out[:, t] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)
    return out


# --- the labelled table -----------------------------------------------------------


def _filler(r: random.Random) -> str:
    word = "".join(r.choice(["th", "er", "on", "an", "re", "le", "ung", "ción", "eau", "is", "mo", "ka", "be", "ti"]) for _ in range(r.randint(1, 4)))
    return word.capitalize() if r.random() < 0.15 else word


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    n = r.choice([13, 15, 16, 16, 16, 16, 19])
    body = r.choice("3456") + _digits(r, n - 2)
    return body + next(c for c in "0123456789" if luhn(body + c))


def _example(r: random.Random) -> tuple[int, str]:
    """A kind (-1: none) and a text of that kind."""
    kind = r.choice([0, 0, 1, 2, 2, 3, 3, 3, 4, -1, -1, -1, -1])
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8)))
    if kind == 0:
        end = r.choice(["com", "org", "net", "de", "io"])
        forms = [f"{name()}.{_digits(r, 2)}@{name()}.{end}", f"{name()}@{name()}.example.{end}", f"{name()} at {name()} dot {end}", f"{name()} dot {name()} at {name()} dot {end}", f"{name()} (at) {name()} (dot) {end}", f"{name()}@ {name()} . {end}", f"{name()} @ {name()}.{end}"]
        return kind, r.choice(forms)
    if kind == 1:
        p = [str(r.randint(0, 255)) for _ in range(4)]
        return kind, r.choice([".", ".", ".", " . ", "-dot-"][:4]).join(p)
    if kind == 2:
        d = _card(r)
        return kind, d if r.random() < 0.4 else r.choice([" ", "-", ".", " - "]).join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == 3:
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return kind, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{_digits(r, 2)} {_digits(r, 2)} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"00{_digits(r, 2)} {a} {b} {c}"])
    if kind == 4:
        return kind, f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
    return kind, r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", f"{r.randint(1, 999)},{_digits(r, 3)},{_digits(r, 3)}", f"${r.randint(1, 9999)}.{_digits(r, 2)}", f"{r.randint(0, 23)}:{_digits(r, 2)}:{_digits(r, 2)}", f"{r.randint(1, 99)}%", f"page {r.randint(1, 999)}", f"{r.randint(1800, 2030)}", f"{r.randint(1, 99)}-{r.randint(1, 99)}", _digits(r, r.randint(1, 12)), f"met at {_filler(r)} dot", f"at {_filler(r)}", f"0x{_digits(r, 6)}", f"password={_digits(r, 3)}ab{_digits(r, 2)}", f"{_digits(r, 4)}ab{_digits(r, 3)}c{_digits(r, 4)}", f"({r.randint(1, 20)})", f"{r.randint(1, 50)} x {r.randint(1, 50)}", f"#{_digits(r, 5)}"])


def labelled_sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table: sentences and their (kind, start, end) spans."""
    r, out = random.Random(seed), []
    cues = ["call", "phone", "tel", "email", "contact", "card", "ip", "ssn", "server"]
    for _ in range(n):
        text, spans = " ".join(_filler(r) for _ in range(r.randint(0, 8))), []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.25:
                text += " " + r.choice(cues) + r.choice(["", ":"])
            kind, value = _example(r)
            text += " " if text else ""
            if kind >= 0:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice(["", "", ".", ","]) + " " + " ".join(_filler(r) for _ in range(r.randint(0, 6)))
        out.append((text, spans))
    return out


def tokens(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, and where each starts and ends."""
    found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    at = np.array([x[1:] for x in found], np.int64).reshape(-1, 2)
    return [x[0] for x in found], at[:, 0], at[:, 1]


def _encode(toks: list[str], starts: np.ndarray, ends: np.ndarray, memo) -> tuple[np.ndarray, np.ndarray]:
    shapes = np.fromiter(map(memo, toks), np.int64, len(toks))
    spaced = np.ones(len(toks), bool)
    spaced[1:] = starts[1:] > ends[:-1]
    return shapes, spaced


# --- the field --------------------------------------------------------------------


def allowed() -> np.ndarray:
    """0 where label j may follow label i, else a large negative number: I only after B or I of its kind."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[[i for i in range(LABELS) if i not in (inside, inside - 1)], inside] = -1e4
    return out


class Field:
    """Weights by hashed feature and label, and of label pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi over a batch (segments x tokens x labels), padded at the end."""
        n, t, _ = scores.shape
        first = scores[:, 0].copy()
        first[:, 2::2] -= 1e4
        best, back = first, np.zeros((n, t, LABELS), np.int8)
        for i in range(1, t):
            via = best[:, :, None] + self.move
            back[:, i] = via.argmax(1)
            new = via.max(1) + scores[:, i]
            live = (i < lengths)[:, None]
            best = np.where(live, new, best)
            back[:, i] = np.where(live, back[:, i], np.arange(LABELS))
        path = np.zeros((n, t), np.int8)
        path[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            path[:, i - 1] = back[np.arange(n), i, path[:, i]]
        return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@functools.lru_cache(maxsize=4)
def train(sentences: int = SENTENCES, seed: int = SEED, epochs: int = 40, penalty: float = 1e-4, rate: float = 0.1) -> Field:
    """Penalised likelihood of the labelled table, by Adam with gradients from forward-backward over the whole padded batch."""
    feats, golds = [], []
    for text, spans in labelled_sentences(sentences, seed):
        toks, starts, ends = tokens(text)
        feats.append(features(*_encode(toks, starts, ends, shape)))
        gold = np.zeros(len(toks), np.int64)
        for kind, s, e in spans:
            inside = np.flatnonzero((starts >= s) & (ends <= e))
            gold[inside] = 2 + 2 * kind
            gold[inside[0]] = 1 + 2 * kind
        golds.append(gold)
    n, t = len(feats), max(map(len, golds))
    x = np.zeros((n, t, len(TEMPLATES)), np.int64)
    y, mask = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (f, g) in enumerate(zip(feats, golds, strict=True)):
        x[i, : len(g)], y[i, : len(g)], mask[i, : len(g)] = f, g, True
    bar, lengths = allowed(), mask.sum(1)
    used, where = np.unique(x[mask], return_inverse=True)
    where = where.reshape(-1, len(TEMPLATES))
    emit, move = np.zeros((len(used), LABELS)), np.zeros((LABELS, LABELS))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    flat_gold = np.zeros((len(where), LABELS))
    flat_gold[np.arange(len(where)), y[mask]] = 1
    pairs = mask[:, 1:]
    gold_move = np.zeros((LABELS, LABELS))
    np.add.at(gold_move, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    start = np.zeros(LABELS)
    start[2::2] = -1e4
    for epoch in range(1, epochs + 1):
        score = np.zeros((n, t, LABELS))
        score[mask] = emit[where].sum(1)
        m = move + bar
        fwd, bwd = np.zeros_like(score), np.zeros_like(score)
        fwd[:, 0] = score[:, 0] + start
        for i in range(1, t):
            fwd[:, i] = np.where(mask[:, i, None], _lse(fwd[:, i - 1, :, None] + m, 1) + score[:, i], fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.where(mask[:, i + 1, None], _lse(m + (score[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0)
        z = _lse(fwd[np.arange(n), lengths - 1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        expect = np.zeros_like(move)
        for i in range(t - 1):
            live = mask[:, i + 1]
            expect += np.exp(fwd[live, i, :, None] + m + (score[live, i + 1] + bwd[live, i + 1])[:, None, :] - z[live, None, None]).sum(0)
        diff = flat_gold - p[mask]
        g_emit = np.zeros_like(emit)
        for k in range(len(TEMPLATES)):
            for l in range(LABELS):
                g_emit[:, l] += np.bincount(where[:, k], diff[:, l], len(used))
        for w, g, a, b in ((emit, g_emit, 0, 1), (move, gold_move - expect, 2, 3)):
            g = g / n - penalty * w
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.999 * moments[b] + 0.001 * g * g
            w += rate * (moments[a] / (1 - 0.9**epoch)) / (np.sqrt(moments[b] / (1 - 0.999**epoch)) + 1e-8)
    full = np.zeros((1 << HASH_BITS, LABELS), np.float32)
    full[used] = emit
    return Field(full, (move + bar).astype(np.float32))


# --- decoding documents -----------------------------------------------------------

#: What ``valid`` asks of any kind of span, ignoring case as it does: a digit, an @, or both words of a written-out address.
_TRIGGER = re.compile(r"[0-9@]|\bat\b[\s)\]]*[^\s]+[\s(\[]*dot\b", re.I)
_QUICK = re.compile(r"[0-9@]|[\s(\[]dot", re.I)
_BLANK = re.compile(r"\s")
#: Characters of a line that are decoded at a time, and that two such pieces share.
PIECE, SHARED = 1 << 15, 1 << 11


def segments(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, whether the line goes on before, and after) of the lines, or pieces of long lines, that may hold a span."""
    at = 0
    while at < len(text):
        end = m.end() if (m := _LINE_END.search(text, at)) else len(text)
        start = at
        while start < end:
            stop = min(end, start + PIECE)
            if stop < end:
                stop = gap.start() if (gap := _BLANK.search(text, stop, min(end, stop + SHARED // 2))) else stop
            line = text[start:stop]
            if _QUICK.search(line) and _TRIGGER.search(line):
                yield start, stop, start > at, stop < end
            if stop == end:
                break
            start = gap.start() if (gap := _BLANK.search(text, stop - SHARED, stop)) else stop - SHARED
        at = end


def valid(kind: int, text: str) -> bool:
    """A decoded span's check: enough digits, or the parts of an address."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", text, re.I)) and bool(re.search(r"\.|\bdot\b", text, re.I)) and text[:1].isalnum() and text[-1:].isalnum()
    if kind == 1:
        return len(p := re.findall("[0-9]+", text)) == 4 and all(map(_byte, p))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15
    return bool(re.fullmatch(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", text))


class Decoder:
    """Holds a field and the shapes seen; decodes many segments at a time."""

    BATCH = 64

    def __init__(self, field: Field):
        self.field, self.shapes = field, Memo(shape, 200_000)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) in each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        jobs = []
        for r, text in enumerate(texts):
            for s, e, before, after in segments(text) if _QUICK.search(text) else ():
                toks, starts, ends = tokens(text[s:e])
                shapes, spaced = _encode(toks, starts, ends, self.shapes.__getitem__)
                for a in range(0, max(1, len(toks) - OVERLAP), SEGMENT - OVERLAP):
                    b = min(len(toks), a + SEGMENT)
                    if ((shapes[a:b] <= 9) | (shapes[a:b] == 30) | (shapes[a:b] == 11)).any():
                        jobs.append((b - a, r, s + starts[a:b], s + ends[a:b], shapes[a:b], spaced[a:b], before or a > 0, after or b < len(toks)))
                if len(jobs) >= 512:
                    self._run(jobs, texts, out)
                    jobs = []
        self._run(jobs, texts, out)
        return [sorted(set(x)) for x in out]

    def _run(self, jobs, texts, out):
        jobs.sort(key=lambda j: j[0])
        for i in range(0, len(jobs), self.BATCH):
            part = jobs[i : i + self.BATCH]
            lengths = np.array([j[0] for j in part])
            gap = np.zeros(REACH, np.int64)
            feats = features(np.concatenate([x for j in part for x in (j[4], gap)]), np.concatenate([x for j in part for x in (j[5], gap.astype(bool))]))
            scores = np.zeros((len(part), int(lengths.max()), LABELS), np.float32)
            at = 0
            for k, j in enumerate(part):
                scores[k, : j[0]] = self.field.emit[feats[at : at + j[0]]].sum(1)
                at += j[0] + REACH
            path = self.field.decode(scores, lengths)
            for k, (n, r, starts, ends, _, _, more_before, more_after) in enumerate(part):
                labels = path[k, :n]
                for b in np.flatnonzero(labels % 2 == 1):
                    e = b + 1
                    while e < n and labels[e] == labels[b] + 1:
                        e += 1
                    if (more_before and b == 0) or (more_after and e == n):
                        continue  # the neighbouring segment sees it whole
                    kind, s, t = int(labels[b] - 1) // 2, int(starts[b]), int(ends[e - 1])
                    if valid(kind, texts[r][s:t]):
                        out[r].append((kind, s, t))


def found(texts: list[str], decoder: Decoder) -> list[tuple[list, list]]:
    """Per text the fixed spans, and those with the decoded ones that overlap none of them."""
    out = []
    for text, more in zip(texts, decoder.spans(texts), strict=True):
        base = base_spans(text)
        taken = union([(s, e) for _, s, e in base])
        starts, new, last = [s for s, _ in taken], [], 0
        for kind, s, e in sorted(more, key=lambda x: (x[1], -x[2])):
            near = bisect.bisect_left(starts, e) - 1  # the last fixed span that starts before this one ends
            if s >= last and (near < 0 or taken[near][1] <= s):
                new.append((kind, s, e))
                last = e
        out.append((base, sorted(base + new)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all of them, those of the method too)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())  # 2 ** HASH_BITS x LABELS numbers
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            base_text, all_text, all_count, counts = [], [], [], [[] for _ in range(BASE_KINDS)]
            texts = batch.column(1)
            for part in text_parts(texts, 1 << 19):
                for base, every in found([x or "" for x in part], decoder):
                    for k in range(BASE_KINDS):
                        counts[k].append(sum(1 for x in base if x[0] == k))
                    base_text.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    all_text.append(joined(every))
                    all_count.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), pa.array(all_count, pa.int64())], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, *, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with all their columns; each span is replaced by its kind in brackets."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field or train()), docs.columns.index(text_col)

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            new = []
            for part in text_parts(batch.column(at), 1 << 19):
                for text, (_, spans) in zip(part, found([x or "" for x in part], decoder), strict=True):
                    last, parts = 0, []
                    for k, s, e in sorted(spans, key=lambda x: x[1:]):
                        if s >= last:
                            parts += [text[last:s], f"[{KINDS[k].upper()}]"]
                            last = e
                    new.append("".join(parts) + text[last:] if parts else text)
            cols = [pa.array(new, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
