"""Each operator against a plain version, and on odd tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import decontaminate, language_id, license_scan, nearest, ngram_join, packing, pii, registry, secret_scan, sharding, token_counts
from textloom.operators.graph import written

EXTRA = "id long, body string, key string, row int, n long, node long, keys string, size long, found string, base string, score double"
LONG = "Lorem ipsum dolor " * 60_000
ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "one two", "en"), (5, "one two", "fr"), (6, "One TWO", None), (7, LONG, "en"), (7, LONG, "en"),
    (8, "12345 67890 !!!", "en"), (None, "one two three four five six", "en"), (9, "one two three four five six", "en"), (10, "naïve Straße Ĳ ﬁ é 日本 😀", "de"),
]


def odd(spark, rows=ODD):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = [f.split() for f in EXTRA.split(", ")]
    return docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in clash], F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))


@pytest.fixture(scope="module")
def texts(data):
    t = pq.read_table(f"{data}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


OPERATORS = {
    "pii": lambda d: pii.report(d),
    "join": lambda d: ngram_join.classes(d),
    "packing": lambda d: packing.packed(d),
    "tokens": lambda d: token_counts.report(d),
    "sharding": lambda d: sharding.assign(d, ranges=16),
    "licenses": lambda d: license_scan.report(d),
    "language": lambda d: language_id.identify(d),
    "secrets": lambda d: secret_scan.report(d),
    "contamination": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, "dolor lorem ipsum"), (None, None), (2, "")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = OPERATORS[name](odd(spark)).collect()
    ids = sorted((r["doc_id"] for r in rows if name != "packing" or r["piece"] == 0), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, None]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    out = OPERATORS[name](odd(spark).where("doc_id = -1"))
    assert out.count() == 0 and "doc_id" in out.columns


# --- personal data ---

KINDS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_pii(text):
    out = []
    for k, rx in enumerate(KINDS):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, k != 1 or all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base(spark, docs, texts):
    rows = pii.report(docs).collect()
    for r in rows:
        want = plain_pii(texts[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(pii.joined(want).split(",")) <= set(r["spans"].split(","))


def test_pii_random_strings():
    r = random.Random(5)
    for _ in range(5000):
        t = "".join(r.choice("ab.@1 5-+(24%_") for _ in range(40))
        assert pii.base_spans(t) == plain_pii(t)


def test_pii_hostile_strings_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a." * 100_000 + "@", "+1" * 100_000, "1-" * 100_000):
        pii.base_spans(t)


def test_field_held_out():
    decoder, hit, got, want = pii.Decoder(pii.train()), 0, 0, 0
    sentences = pii.labelled_sentences(300, seed=123)
    for (_, spans), found in zip(sentences, decoder.spans([t for t, _ in sentences]), strict=True):
        hit, got, want = hit + len(set(spans) & set(found)), got + len(found), want + len(spans)
    assert hit / got > 0.95 and hit / want > 0.9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    field = pii.Field(np.zeros((1, pii.LABELS)), pii.allowed() + rng.normal(size=(pii.LABELS, pii.LABELS)))
    scores = rng.normal(size=(1, 3, pii.LABELS))
    path = field.decode(scores, np.array([3]))[0]

    def value(p):
        return (-1e4 if p[0] and p[0] % 2 == 0 else 0) + sum(scores[0, i, x] for i, x in enumerate(p)) + field.move[p[0], p[1]] + field.move[p[1], p[2]]

    labels = range(pii.LABELS)
    assert np.isclose(value(path), max(value((a, b, c)) for a in labels for b in labels for c in labels))


# --- join ---


def plain_classes(texts):
    sets, parent = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({x: x + 32 for x in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * min(len(x), len(y)) >= 90 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 90 * (len(x) + len(y) - both):
                    p, q = sorted((root(ids[a]), root(ids[b])))
                    parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n=260):
    """Groups of copies at all distances around the limit, chains, subsets, and short texts."""
    r, out = random.Random(seed), {}
    words = [f"w{i}" for i in range(400)]
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 9, 11, 12, 13, 20, 40, 80, 150, 400]))]
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 40)):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1, 1])] = [r.choice(words)] * r.choice([0, 1, 1])
                copy = copy or ["x"]
            out[len(out)] = " ".join(copy) if r.random() < 0.9 else " ".join(copy).upper()
            if r.random() < 0.3:
                base = copy
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_near_copies(spark, seed):
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(docs).collect()} == plain_classes(texts)


def test_join_keys_meet_all_links():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.integers(9, 300))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        gone, new = rng.integers(0, 1 + n // 12), rng.integers(0, 1 + n // 12)
        other = np.unique(np.concatenate((rng.permutation(base)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64))))
        same = len(np.intersect1d(base, other))
        link = 100 * same >= 90 * (len(base) + len(other) - same)
        assert bool(ngram_join.linked([base], [other])[0, 0]) == link
        if link and not np.array_equal(base, other):
            assert len(np.intersect1d(ngram_join.keys(base)[0], ngram_join.keys(other)[0]))


def test_join_hot_group_makes_few_products(spark):
    """A thousand near copies of one text are one class, without a million pairs."""
    base, r = [f"w{i}" for i in range(200)], random.Random(1)
    rows = []
    for i in range(1000):
        copy = list(base)
        copy[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    out = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}


def test_packing_remembers_as_much_as_it_is_told(spark):
    """op3 and the pipeline, whose workers hold other tables too, had one bound."""
    path = public_tokenizers.path(packing.VOCABULARY)
    assert packing.encoder(path).units.limit == packing.MEMO // 2 > packing.encoder(path, packing.SMALL_MEMO).units.limit
    docs = odd(spark)
    crcs = lambda df: sorted((r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert crcs(packing.packed(docs, memo=4)) == crcs(packing.packed(docs))


def test_plain_units_split_as_by_the_pattern():
    """op5: a unit of ASCII letters with punctuation behind it skips the general pattern."""
    units = ["Word", "word.", "it's", "dogs'", "don't!", "a<|", "<|x", "a|", "x<", "a1.", "a.b", "Kelvin\u212a", "...", "", "a\\]", "a[^_`", "\u00e9t\u00e9,"]
    for u in units:
        want = (u,) if token_counts._UNSAFE.search(u) or "<|" in u else tuple(token_counts._PRETOKEN.findall(u.lower()))
        assert token_counts.Counts._split(u) == want
    assert token_counts._PLAIN.fullmatch("word.") and not token_counts._PLAIN.fullmatch("a<|")


@pytest.fixture
def many_ids(spark, monkeypatch):
    """As on tables with more ids than are broadcast."""
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _shuffles(df) -> bool:
    return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_join_shuffles_no_texts_beyond_a_broadcast(spark, data, many_ids):
    """texts of more than MAX_BROADCAST_ROWS grouped documents went through a shuffle and its sort."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    join = ngram_join._Join(docs, "doc_id", "text", 3, 90, 100)
    assert not _shuffles(join.grams(join.classes.select("node")))


def test_a_part_of_keys_and_n_grams_is_shuffled_at_a_time(spark, monkeypatch):
    """all keys of all rows lay in one shuffle, and beyond a broadcast all n-grams in two."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(60)) + " end" * (i % 2)) for i in range(80)], "doc_id long, text string")
    want = sorted(ngram_join.classes(docs).collect())
    join = ngram_join._Join(docs, "doc_id", "text", 3, 90, 100)
    rows = [ngram_join.keys(r[:n])[0].tolist() for r, n in ((r, len(r)) for part, size in ngram_join.Rows(3, join.levels.value.astype(np.uint64)).rows(pa.array([r.text for r in docs.collect()])) for r in np.split(part, np.cumsum(size)[:-1]))]
    seen = Counter(k for row in rows for k in set(row))
    parts = [sum(len(k) for k in r) for r in zip(*([r[p] for p in join.parts] for r in join.scanned.collect()), strict=True)]
    assert sum(parts) == sum(map(len, rows)) and max(parts) < sum(parts) / 2
    made, real = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, *name: made.append(df) or real(df, *name))
    assert {r.key: r.rows for r in join.shared_keys().collect()} == {k: n for k, n in seen.items() if n > 1}
    assert [[p for p in join.parts if p in df.columns or f"{p}:array" in df._jdf.queryExecution().executedPlan().toString()] for df in made[:-1]] == [[p] for p in join.parts]
    passes, grams = [], ngram_join._Join.grams
    monkeypatch.setattr(ngram_join, "LEAST_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", 20)
    monkeypatch.setattr(ngram_join._Join, "grams", lambda self, nodes: passes.append(nodes.count()) or grams(self, nodes))
    assert sorted(ngram_join.classes(docs).collect()) == want
    assert len(passes) == 4 and sum(passes) == 80 and max(passes) < 60


def test_join_is_the_same_beyond_a_broadcast(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(ngram_join.classes(docs).collect()), sorted(r.doc_id for r in ngram_join.keep_first(docs).collect())
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", 1)
    for bits in (1 << 24, 256):  # the smaller filter lets many others through
        monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
        monkeypatch.setattr(ngram_join, "MOST_FILTER_BITS", bits)
        assert (sorted(ngram_join.classes(docs).collect()), sorted(r.doc_id for r in ngram_join.keep_first(docs).collect())) == want


def test_written_tables_leave_no_shuffle_files(spark):
    """shuffle files stayed until the driver's garbage was collected, so the disk held those of all steps."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(disk.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(disk.getAllFiles().size()))
    before = count()
    written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while count() > before and time.time() < until:
        time.sleep(0.2)
    assert count() <= before


def test_pipeline_drops_near_copies_without_shuffling_texts(spark, many_ids):
    """with more dropped ids than are broadcast, all texts went through a shuffle."""
    docs = spark.createDataFrame([(None if i == 30 else i, f"text {i}", "en") for i in range(40)], "doc_id int, text string, lang string")
    gone = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "id bigint")
    kept = ngram_join._without(docs, gone, "doc_id")
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted(f"text {i}" for i in range(40) if i % 3 or i == 30)
    assert not _shuffles(kept)


def test_keep_first(spark):
    docs = odd(spark)
    kept = ngram_join.keep_first(docs)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == [(False, i) for i in (1, 2, 3, 4, 7, 7, 8, 9, 10)]


def plain_links(texts):
    sets, out = {}, dict.fromkeys(texts, 0)
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            out[a], out[b] = out[a] + 1, out[b] + 1
    return out


@pytest.mark.parametrize("block", [768, 3])
def test_join_counts_all_links(spark, monkeypatch, block):
    """Numbers of links by brute force, with whole components and with many blocks."""
    monkeypatch.setattr(ngram_join, "LEAST_BLOCK", block)
    monkeypatch.setattr(ngram_join, "MOST_BLOCK", block)
    r, base = random.Random(7), [f"w{i}" for i in range(120)]
    texts = near_copies(4, 150) | {10**6: "", 10**6 + 1: ""}
    for i in range(60):  # one group, most of whose rows link, with exact copies
        copy = list(base[: 100 + i % 20])
        copy[r.randrange(100)] = f"x{i % 45}"
        texts[2 * 10**6 + i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["n_links"] for x in ngram_join.classes(docs).collect()} == plain_links(texts)


def plain_components(texts, n, num, den):
    """id -> smallest id of its group, by brute force."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({x: x + 32 for x in range(65, 91)}))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("n, num, den", [(5, 80, 100), (1, 1, 2)])
def test_join_other_shingles(spark, n, num, den):
    texts = near_copies(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs, n=n, num=num, den=den).collect()} == plain_components(texts, n, num, den)


def edited(words, edits, seed):
    """Scattered edits: no two in one shingle of five words."""
    out = list(words)
    for k, at in enumerate(range(8, len(words) - 8, (len(words) - 16) // edits)):
        if k < edits:
            out[at] = f"edit{seed}x{k}"
    return out


def test_pipeline_is_the_plain_stages(spark, data, tmp_path):
    """All stages of the pipeline; near copies that three words and 0.9 would keep must go."""
    own = spark.read.parquet(f"{data}/documents.parquet")
    long = [(r["doc_id"], r["text"].split(), r["lang"]) for r in own.collect() if r["text"] and len(r["text"].split()) >= 150][:12]
    copies = spark.createDataFrame([(10**6 + k, " ".join(edited(w, len(w) // 50, k)), x) for k, (_, w, x) in enumerate(long)], "doc_id long, text string, lang string")
    own.unionByName(copies, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"] for r in language_id.identify(docs).collect() if r["lang_pred"] != "und"}
    left = {i: texts[i] for i in known}
    near, narrow = plain_components(left, 5, 80, 100), plain_components(left, 3, 90, 100)
    assert any(near[i] != i and narrow[i] == i for i in left)
    left = {i: t for i, t in left.items() if near[i] == i}
    hits = plain_hits(left, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i for i in left if not hits[i][4]}


# --- packing and tokens ---

ALIKE = ["ab", " ", "  ", "\n", "\n\n", "é", "É", "²", ".", ",", "'s", "'S", "'", "1", "23", "\t", " ", "ß", "İ", "Σ", "é", "<|endoftext|>", "日本", "!", "\r\n", "_", "x²y", "​", "😀", "don't", "\x1c", "\x85", "ﬁ"]


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ALIKE) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_encoder_is_the_tokenizer(texts, monkeypatch):
    own, whole = packing.encoder(public_tokenizers.path(packing.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert own.merge is not None
    for t in [*texts.values(), *odd_texts(1, 3000)]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "CHUNK", 100)
    for t in list(texts.values())[:50]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_counts_are_the_tokenizer(texts, monkeypatch):
    own, whole = token_counts.counts(public_tokenizers.path(token_counts.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    for t in [*texts.values(), *odd_texts(2, 3000)]:
        assert own.count(t) == len(whole.encode(t, add_special_tokens=False).ids)
    monkeypatch.setattr(token_counts, "CHUNK", 100)
    for t in list(texts.values())[:50]:
        assert own.count(t) == len(whole.encode(t, add_special_tokens=False).ids)


SCRIPTS = ["한국어 문장 그리고 단어 123", "مرحبا بالعالم، هذا نص", "ภาษาไทยไม่มีช่องว่าง", "हिन्दी में एक वाक्य", "שלום עולם", "ΟΔΥΣΣΕΥΣ Σ ς", "e\u0301 E\u0301 İstanbul I\u0307", "😀👩‍👩‍👧 emoji😀text", "a<|endoftext|>b <|startoftext|> <|no|>", "a\u00a0b\u3000c\u2028d\x85e\x1cf\x0bg", "x" * 3000, ""]


@pytest.mark.parametrize("common", [300_000, 40, 0])
def test_token_report(spark, texts, monkeypatch, common):
    """The whole query, with all pre-tokens broadcast, some, and none: bytes, tokens and limit of every script, of repeated rows and ids, and of nulls."""
    monkeypatch.setattr(token_counts, "COMMON", common)
    whole = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    own = [*SCRIPTS, "".join(SCRIPTS), " ".join(SCRIPTS * 40), *list(texts.values())[:60], *odd_texts(5, 200)]
    rows = [(i // 2, t) for i, t in enumerate(own)] + [(None, "one two"), (None, None), (3, own[6])]
    got = token_counts.report(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rare", F.lit("x"))).collect()
    want = [(i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got], key=key) == sorted([(*w, w[2] > 2048) for w in want], key=key)
    assert any(w[2] > 2048 for w in want)


def test_pretokens_are_counted_once(spark):
    docs = spark.createDataFrame([("A b'll b x1",), ("a B. ..",), (None,), ("한국 a",)], "text string").repartition(3)
    rows = {r["pretoken"]: (r["seen"], r["pieces"]) for r in token_counts.pretoken_table(docs).collect()}
    assert set(rows) == {"a", "b", "'ll", "x", "1", ".", "..", "한국"} and rows["a"][0] == 3 and rows["b"][1] == 1


def test_packed_sequences(docs, texts):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.packed(docs).collect()
    places, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append(r)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    for i, own in parts.items():
        ids = np.array(whole.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and own[0]["start"] == 0
        assert all(r["length"] == 1024 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    total = sum(r["length"] for r in rows)
    assert len(places) <= 1.03 * -(-total // 1024) + 1


def test_sum_of_squares_by_hand():
    # 6 opens a gap of 4; 4 fits it exactly; 3 opens 7; 3 goes where the squares stay smallest.
    assert packing.sum_of_squares(np.array([6, 4, 3]), 10) == [[0, 1], [2]]


# --- nearest neighbours ---


def test_nearest_is_exact_enough(spark, data):
    t = pq.read_table(f"{data}/embeddings.parquet").to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], float)
    norm = nearest.norms(x)
    got = defaultdict(list)
    for r in nearest.neighbours(spark.read.parquet(f"{data}/embeddings.parquet"), max_query_bytes=4000).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits, total = 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        c = (x * x[q]).sum(1) / (norm * norm[q])
        c[q] = -9
        best = np.lexsort((ids, -c))[:5]
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(s == c[np.flatnonzero(ids == v)[0]] for _, v, s in own)
        hits, total = hits + len({v for _, v, _ in own} & set(ids[best].tolist())), total + 5
    assert hits / total >= 0.9


def test_nearest_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (100, None)] + [(1000 + i, [1.0, 0.0]) for i in range(1, 20)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1))
    got = defaultdict(list)
    for r in nearest.neighbours(docs).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(1, 1.0), (2, 1.0), (1001, 1.0), (1002, 1.0), (1003, 1.0)]
    assert [v for v, _ in got[50]] == [0, 1, 2, 1001, 1002] and set(got) == {0, 50}
    assert nearest.neighbours(docs.where("vec_id < 0")).count() == 0


# --- sharding ---


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, docs, texts, hot):
    if hot:  # a third of all rows are one text
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("same text " * 300)).otherwise(F.col("text")))
        texts = {i: "same text " * 300 if i % 3 == 0 else t for i, t in texts.items()}
    rows = sharding.assign(docs, ranges=64).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(sizes) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_range_of_many_bounds(spark):
    bounds = sorted(random.Random(1).sample(range(10_000), 777))
    keys = spark.range(0, 10_000, 7)
    for r in keys.select("id", sharding.range_of(F.col("id"), bounds).alias("r")).collect():
        assert r["r"] == sum(b <= r["id"] for b in bounds)


# --- licenses ---


def test_license_base_places(docs, texts):
    for r in license_scan.report(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r["doc_id"]] or "").translate({x: x + 32 for x in range(65, 91)}))
        found = [(i, label) for label, phrase in license_scan.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        at = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_license_rules(spark):
    assert len(license_scan.rules()) > 200
    cases = [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"), ("see the summit licenses", ""), ("mit\n--license MIT. LICENSE", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-2-clause"), ("This work is licensed under CC BY-SA 4.0", "cc-by-sa-4.0"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("a license to print money", ""), ("licensed under the GNU Affero General Public License v3", "agpl-3.0,gpl,gpl-3.0"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.report(docs).collect()}
    want = {i: x for i, (_, x) in enumerate(cases)}
    want[8] = got[8]  # which of the nested names stays is the order's matter
    assert got == want and "agpl-3.0" in got[8]


def sample(tokens, r):
    """A random text that the parsed expression matches; runs of white space are of all kinds and lengths."""
    out = ""
    for op, arg in tokens:
        op = str(op)
        if op == "LITERAL":
            out += r.choice([str.lower, str.upper])(chr(arg))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op == "SUBPATTERN":
            out += sample(arg[3], r)
        elif op == "BRANCH":
            out += sample(r.choice(arg[1]), r)
        elif op == "ANY":
            out += "z"
        elif op == "IN":
            what, value = r.choice(arg)
            pick = {"CATEGORY": lambda v: r.choice(" \n\t\r"), "LITERAL": chr, "RANGE": lambda v: chr(r.randint(*v))}
            out += pick[str(what)](value)
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
    return out


def test_license_rules_pass_gate_and_key():
    """What a rule matches holds its keyword and a gate word, once white space and hyphens are folded."""
    r = random.Random(6)
    fold = lambda t: re.sub(r"[ \t\n\x0b\f\r+-]+", " ", t.lower())
    for rule in license_scan.rules():
        spdx = rule["re"].startswith("(?i)(?<=spdx")
        parsed = None if spdx else re._parser.parse(rule["re"])
        for _ in range(40):
            text = "SPDX-License-Identifier: " + rule["re"].split("(:])")[1].split("(?!")[0].replace("\\", "") if spdx else sample(parsed, r)
            if not spdx and not re.search(rule["re"], text):
                continue  # what must not stand there
            assert rule["key"] in fold(text) and any(g in fold(text) for g in license_scan.GATES), (rule, text)


def test_license_wrapped_and_hyphened(spark):
    cases = [
        ("licensed under CC-BY-SA-4.0", "cc-by-sa-4.0"), ("licensed under CC-BY-4.0", "cc-by-4.0"), ("see creativecommons.org/publicdomain/zero/1.0/", "cc0-1.0"), ("released to you under the MIT", "mit"),
        ("Redistribution and\nuse in source and\n  binary forms, with or without modification, are permitted", "bsd-2-clause"), ("It is in the public\ndomain", "public-domain"),
        ("under the GNU General\nPublic License v3 license", "gpl,gpl-3.0"), ("provided\tunder the PSF", "python-2.0"), ("Licensed  under ODbL", "odbl-1.0"), ("a public-domain work", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.report(docs).collect()} == {i: x for i, (_, x) in enumerate(cases)}


# --- languages ---


def test_language_held_out(docs, data):
    t = pq.read_table(f"{data}/documents.parquet").to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"], strict=True))
    rows = language_id.identify(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_und(spark):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd(spark)).collect()}
    assert [got[i] for i in (1, 2, 3, 8)] == ["und"] * 4 and got[7] == "en"


def test_filters_return_all_languages():
    a, b = language_id.codes(b"  abcdefgh "), language_id.codes(b"  abcdxyzw ")
    f = language_id.Filters([f"l{i:02}" for i in range(20)], 0, [a if i % 2 else b for i in range(20)])
    data = b"  abcd "
    votes = f.votes(data, np.array([0, len(data)]))
    assert votes[0, 0] == 4 and all(v >= 3 for v in votes[0, 1:])


# --- secrets ---


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base(docs, texts):
    for r in secret_scan.report(docs).collect():
        want = plain_secrets(texts[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert r["base_sha256"] == secret_scan.digest(want)


def test_secret_base_random_strings():
    r = random.Random(4)
    parts = ["token", "SECRET", "api_key", "Passwd", "=", ":", " ", '"', "abc", "AKIA", "0f" * 13, "ABCDEFGH12345678", ".", "ſecret", "toKen", "é"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert secret_scan.base_spans(t) == plain_secrets(t)


def test_battery_tells_random_from_words(spark):
    r = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secrets = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(30)]
    words = ["internationalizationhandling", "Thsttiontiontheesatationer", "abcdefghijklmnopqrstuvwxyz0123456789", "A" * 40, "1234" * 5, "donaudampfschifffahrtsgesellschaft"] * 20
    docs = spark.createDataFrame([(i, f"see {s} here") for i, s in enumerate(secrets + words)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(docs).collect()}
    assert sum("random:" in got[i] for i in range(30)) >= 28
    assert not any(got[i] for i in range(30, 30 + len(words)))


def test_secret_redaction(spark):
    docs = odd(spark, ODD + [(99, "password=hunter2hunter2 stays", "en")])
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[99]["text"] == "[SECRET] stays" and rows[99]["n_chars"] == 14 and rows[4]["text"] == "one two"


# --- contamination ---


def plain_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate({x: x + 32 for x in range(65, 91)}))
    grams = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(str(i))
    lengths = {len(g) for g in grams}
    out = {}
    for i, t in texts.items():
        w, hit, found = cut(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), decontaminate.items_digest(sorted(found)), bool(hit))
    return out


@pytest.mark.parametrize("limit", [1 << 25, 3000])
def test_contamination(spark, docs, texts, data, limit):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    short = spark.createDataFrame([(1001, "of the"), (1002, "THE"), (1003, "?!"), (1004, None), (0, "of the")], "item_id long, text string")
    items = items.select("item_id", "text").union(short)
    want = plain_hits(texts, [(r["item_id"], r["text"]) for r in items.collect()])
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, items, max_broadcast_bytes=limit).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_decontaminate(spark):
    passage = "a b c d e f g h i j k"
    docs = odd(spark, [(1, f"Start here. {passage.upper()}! The end.", "en"), (2, "clean text", "en"), (3, None, None)])
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, action="spans").collect()}
    assert spans == {1: "Start here. ! The end.", 2: "clean text", 3: None}


def test_spans_are_cut_alike_in_any_number_of_passes(spark, monkeypatch):
    """Two overlapping items in different pieces; an item that is larger than a piece; a tail behind the last cut."""
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l m y"), (2, "x " + " ".join(f"w{i}" for i in range(15, 60)) + " y"), (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "d e f g h i j k l m"), (3, " ".join(f"w{i}" for i in range(100)) + " " * 50)], "item_id long, text string")
    for limit in (1 << 20, 70, 25, 5):
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", limit)
        out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, action="spans").collect()}
        assert out == {1: "x  y", 2: "x  y", 3: "w0 w1 w2 w3 w4 w5 w6 w7 w8"}
        report = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items, max_broadcast_bytes=limit).collect()}
        assert report == {1: (13, 2), 2: (45, 1), 3: (0, 0)}
    pieces = list(decontaminate.matchers([("i", b" ".join(b"w%d" % i for i in range(100)))], 10, 70))
    assert len(pieces) > 3 and sum(len(m.tables[10][0]) for m in pieces) == 91 and all(set(m.tables) == {10} for m in pieces)


def test_private_data_in_long_lines():
    """One line without ends, longer than a piece: the fixed spans as they are, the decoded ones as in short lines; time in proportion to length."""
    decoder = pii.Decoder(pii.train())
    unit = "please write to anna at example dot com or call 555 123 4567 about it, and then read on for a while. "
    (short,) = decoder.spans([unit])
    (long,) = decoder.spans([unit * 2000])
    assert short and long == sorted((k, s + i * len(unit), e + i * len(unit)) for i in range(2000) for k, s, e in short)
    took = []
    for n in (1000, 4000):
        began = time.time()
        (base, every), = pii.found([f"call +1 (555) 123-4567 or mail a{7}@x.org\n" * n], decoder)
        took.append(time.time() - began)
        assert len(base) == 2 * n <= len(every)
    assert took[1] < 8 * took[0] + 1


def test_private_data_counts_all_spans(docs):
    for r in pii.report(docs).collect():
        assert r["n_spans"] == (r["spans"].count(",") + 1 if r["spans"] else 0) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]


def test_runs_beside_base_spans_count_once(spark):
    """A run that a base span touches is no span of its own; one between two base spans is."""
    r = random.Random(5)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [(i, f"token={key(40)} and {key(40)} and secret: {key(30)}") for i in range(40)]
    for row in secret_scan.report(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in row["spans"].split(",")]
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans)) and row["n_assign"] == 2 and len(spans) == 3


def test_language_by_brute_force(docs, texts):
    """Votes, correction and decision of every text, one n-gram and one language at a time, on the learned filters."""
    model = language_id.train(docs)
    bits = [{h for h in range(1 << model.bits) if model.planes[k // 8][h] >> (k % 8) & 1} for k in range(len(model.languages))]
    chance = [(len(b) / (1 << model.bits)) ** language_id.HASHES for b in bits]
    for r in language_id.identify(docs).collect():
        text = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = b"  " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()) + b" "
        held, n = [0] * len(bits), len(data) - 3
        for i in range(n):
            gram = int.from_bytes(data[i : i + 4], "big")
            slots = [(gram * int(m) & (1 << 64) - 1) >> (64 - model.bits) for m in language_id.MIX[: language_id.HASHES]]
            for k, b in enumerate(bits):
                held[k] += all(x in b for x in slots)
        true = [max(0.0, (v - n * c) / (1 - c)) for v, c in zip(held, chance, strict=True)]
        best = max(range(len(true)), key=lambda k: (true[k], -k)) if sum(true) else model.prior
        assert r["lang_pred"] == model.languages[best] and abs(r["score"] - (true[best] / sum(true) if sum(true) else 0)) < 1e-9


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_is_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    want = con.sql(registry.ORACLES[name])
    rows = registry.QUERIES[name](spark, data)
    assert sorted(rows.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in rows.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Odd rows go through all stages, each by its own rule; stages keep the columns; empty tables stay empty."""
    items = spark.createDataFrame([(1, "this passage of exactly ten words is in the benchmark")], "item_id long, text string")
    more = [(20, "Now: THIS passage of exactly ten words is in the benchmark!", "en"), (21, "token = aZ3kQ9xW7bT1mN5 and then some", "en"), (22, None, None)]
    for name, docs, tests in (("odd", odd(spark, ODD + more), items), ("none", odd(spark).limit(0), items), ("untested", odd(spark, more), items.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        tests.write.parquet(f"{folder}/benchmark.parquet")
        table = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, table, folder)
            assert after.columns == table.columns and [f.dataType for f in after.schema] == [f.dataType for f in table.schema]
        ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
        assert not ids & {1, 2, 3, 22}  # without letters
        assert name != "none" or not ids
        assert name != "odd" or (7 in ids and 20 not in ids and len(ids & {4, 5, 6}) <= 1)
        assert name != "untested" or ids <= {20, 21}
