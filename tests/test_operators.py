"""Operators against small cases worked out by hand."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import policy
from textloom.operators import articles, corpus, dataprep, evidence, graph, metrics, pages
from textloom.plans.queries import ORACLES
from textloom.sources import readers, writers
from textloom.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_relevance_counts_repeats_of_kept_sentences_only(spark):
    s = "The council voted on Monday to close the bridge for repairs until the spring."
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Menu", "Menu", s, s.upper(), "Subscribe now!"])], "doc_id int, pos int, sentence string")
    assert [r[1] for r in rows(articles.relevance(df), "pos", "reason")] == ["too_short", "too_short", None, "duplicate", "boilerplate_keyword"]


def test_article_score(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.1), (1, 0.2), (2, 0.5)], "k int, signal double")
    assert rows(articles.article_score(df, ["k"]), "k", "score") == [(1, 65.0), (2, 50.0)]


def test_article_score_rounds_ties_as_its_sql(spark):
    """half the mean and half the peak of one signal of 0.2855 are 28.549999999999997, which SQL's round_even takes for a tie."""
    signals = [n / 10_000 for n in range(5, 10_000, 10)]
    df = spark.createDataFrame(list(enumerate(signals)), "k int, signal double")
    values = ", ".join(f"({k}, {s!r}::double)" for k, s in enumerate(signals))
    want = duckdb.sql(f"SELECT k, round_even(least(100.0, greatest(0.0, (0.5 * s + 0.5 * s) * 100)), 1) FROM (VALUES {values}) t(k, s) ORDER BY k").fetchall()
    assert want[285] == (285, 28.6)
    assert rows(articles.article_score(df, ["k"]), "k", "score") == want


def test_title_of_a_page_cut_inside_a_reference(spark):
    """the query's SQL reads the references of escaped text only; the document parser reads the others too, as browsers do."""
    titles = ["of.&amp;&amp", "a &lt;b&gt; &quot;c&#x27;", "&amp;amp; &amp;lt; &lt", "R&D & co &copy; &#39", " \n ", "x\u00a0 y\t&nbsp;"]
    df = spark.createDataFrame([(i, f"<html><head><TITLE lang='en'>{t}</TITLE></head><body>&amp</body></html>") for i, t in enumerate(titles)], "page_id int, html string")
    got = rows(df.select("page_id", pages.escaped_title(F.col("html")).alias("title")), "page_id", "title")
    pages_ = df.toPandas()  # noqa: F841  (the SQL's table)
    assert got == duckdb.sql(f"WITH pages AS (FROM pages_) SELECT * FROM ({ORACLES['s09_html_title']}) ORDER BY 1").fetchall()
    assert [t for _, t in got] == ["of.&&amp", "a <b> \"c'", "&amp; &lt; &lt", "R&D & co &copy; &#39", None, "x\u00a0 y &nbsp;"]
    assert pages.parse("<title>of.&amp;&amp</title>")["title"] == "of.&&"


def test_article_levels_round_ties_as_their_sql(spark):
    """articles of one sentence, some of whose scores are ties."""
    df = spark.createDataFrame([(i, f"The council voted on motion {i} about the old bridge today.") for i in range(4000)], "doc_id int, text string")
    documents = df.toPandas()  # noqa: F841  (the SQL's table)
    want = duckdb.sql(f"SELECT doc_id, score, level FROM ({ORACLES['flagship_article_levels']}) ORDER BY doc_id").fetchall()
    assert rows(articles.article_levels(df), "doc_id", "score", "level") == want


def test_windows_merge_where_they_touch(spark):
    lengths = spark.createDataFrame([(1, 20)], "doc_id int, n int")
    sel = spark.createDataFrame([(1, p) for p in (0, 5, 12)], "doc_id int, pos int")
    assert rows(articles.merged_windows(sel, lengths), "start_pos", "end_pos") == [(0, 7), (10, 14)]
    assert rows(articles.merged_windows(sel, lengths, limit=1), "start_pos", "end_pos") == [(0, 7)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long")), "node", "comp"))
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_units_are_placed_in_balance():
    units = [(f"u{i}", 1 + i % 3, {"b:1": i % 2, "b:0": 1}) for i in range(400)]
    shares = dict(zip(dataprep.PARTITIONS, (0.5, 0.15, 0.15, 0.2), strict=True))
    total, labels = sum(n for _, n, _ in units), {"b:1": 200, "b:0": 400}
    want = {p: {k: n * f for k, n in labels.items()} for p, f in shares.items()}
    place = lambda us: dataprep.place_units(us, {p: total * f for p, f in shares.items()}, want, 23)
    got = place(units)
    assert got == place(list(reversed(units))) and set(place(units[:4]).values()) == set(dataprep.PARTITIONS)
    for p, f in shares.items():
        own = [u for u in units if got[u[0]] == p]
        assert abs(sum(n for _, n, _ in own) / total - f) < 0.01 and abs(sum(c["b:1"] for _, _, c in own) / 200 - f) < 0.04


def test_split_of_small_and_large_units(spark, monkeypatch):
    """Large units one by one, the others by hash; every key stays in one partition."""
    monkeypatch.setattr(dataprep, "SINGLE", 20)
    rows_ = spark.createDataFrame([(i, f"k{0 if i < 300 else i % 700}", i % 2) for i in range(2000)], "id long, key string, label int")
    shares = {"train": 0.5, "development": 0.2, "calibration": 0.1, "locked_test": 0.2}
    got = dataprep.split_manifest(rows_, "id", ["key"], ["label"], shares, 7)
    joined = rows_.join(got, "id").toPandas()
    assert len(joined) == 2000 and joined.groupby("key").partition.nunique().max() == 1
    for p, f in shares.items():
        assert abs((joined.partition == p).mean() - f) < 0.05
    with pytest.raises(ValueError):
        dataprep.split_manifest(rows_.limit(3), "id", ["key"], ["label"], shares, 7)


def test_annotations_merge_without_pairs(spark):
    r = "record_id string, dataset string, text_hash string, canonical_url string, source_record_ids array<string>, source_datasets array<string>"
    left = spark.createDataFrame([("l1", "A", "h", "u1", ["l1"], ["A"]), ("l2", "A", "h", "u2", ["l2"], ["A"]), ("l3", "A", "g", None, ["l3"], ["A"])], r)
    right = spark.createDataFrame([("r1", "B", "h", "u1", [], []), ("r2", "B", "h", None, [], []), ("r3", "B", "g", None, [], []), ("r4", "B", "g", "u9", [], []), ("r5", "B", None, None, [], [])], r)
    merged, matched = dataprep.merge_annotations(left, right)
    assert rows(merged, "record_id", "source_record_ids") == [("l1", ["l1", "r1"]), ("l2", ["l2"]), ("l3", ["l3", "r3"])]
    assert rows(matched, "right_id", "matched") == [("r1", True), ("r2", False), ("r3", True), ("r4", False), ("r5", False)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.7, 1), (1, 0.8, 1), (1, 0.9, 1)], "truth int, p double, pred int")
    m = metrics.confusion(df, [0, 1])
    assert rows(m, "truth", "pred", "n") == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    assert metrics.overall(m).first()["accuracy"] == 0.75
    assert metrics.roc_auc(df).first()[0] == 1.0 and metrics.average_precision(df).first()[0] == 1.0
    assert metrics.roc_auc(df.where("truth = 1")).first()[0] is None


def test_auc_with_ties_is_the_pairwise_share(spark):
    r = random.Random(1)
    data = [(r.randint(0, 1), r.randint(0, 9) / 10) for _ in range(200)]
    pos, neg = [p for t, p in data if t], [p for t, p in data if not t]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(spark.createDataFrame(data, "truth int, p double")).first()[0] - want) < 1e-12


@pytest.mark.parametrize("data,upper,target,least,want", [
    ([(0.05, 0)] * 30 + [(0.90, 1)] * 10, False, 0.85, 30, (True, 0.05, 30, None)), ([(0.9, 1)] * 20, True, 0.5, 30, (False, None, 20, "minimum_predicted_support_not_met")),
    ([(0.99, 1)] * 30 + [(0.80, 1)] * 30 + [(0.10, 0)] * 10, True, 0.85, 30, (True, 0.80, 60, None)), ([(0.9, 1)] * 2, True, 0.9, 1, (False, None, 2, "target_wilson_lcb_not_met")),
    ([(0.1, 0)] * 40 + [(0.7, 1)] * 40, False, 0.9, 30, (True, 0.1, 40, None)), ([(0.1, 1)] * 40, False, 0.9, 30, (False, None, 40, "no_negative_reference_examples")), ([(0.1, 0)] * 40, True, 0.9, 30, (False, None, 40, "no_positive_reference_examples")),
    ([], True, 0.9, 30, (False, None, 0, "no_supervised_calibration_examples")),
])
def test_confident_region(spark, data, upper, target, least, want):
    rows = spark.createDataFrame(data, "p double, truth int")
    r = metrics.confident_region(rows, upper=upper, target=target, min_support=least).first()
    assert (r["enabled"], r["threshold"], r["support"], r["reason"]) == want
    if r["enabled"]:  # the threshold takes in the very rows that it was chosen for
        assert rows.where(F.col("p") >= r["threshold"] if upper else F.col("p") <= r["threshold"]).count() == r["support"]


def test_bootstrap_is_seeded_and_knows_its_labels(spark):
    df = spark.createDataFrame([(f"g{i % 7}", i % 2, (i // 2) % 2) for i in range(60)], "g string, truth int, pred int")
    a = metrics.bootstrap_lower(df, "g", [0, 1], resamples=200)
    assert a == metrics.bootstrap_lower(df, "g", [0, 1], resamples=200) and 0 <= a <= 1
    one = spark.createDataFrame([("g", 0, 0)] * 5, "g string, truth int, pred int")  # an absent class counts as 0
    assert metrics.bootstrap_lower(one, "g", [0, 1], resamples=20) == 0.5 and metrics.macro_f1([{(0, 0): 5}], [0, 1]) == 0.5
    table = metrics.bootstrap_table(df, "g", [0, 1], resamples=200)
    values = sorted(r["macro_f1"] for r in table.collect())
    assert len(values) == 200 and metrics.bootstrap_bound(table, 200).first()[0] == values[10] and abs(values[10] - a) < 0.2


def test_release_gates(spark):
    bias = spark.createDataFrame([(1, True)] * 60 + [(0, False)] * 60, "truth int, selected boolean")
    style = spark.createDataFrame([(f"g{i}", i % 2, i % 2) for i in range(80)], "g string, truth int, pred int")
    r = metrics.binary_gates(bias, style, "g", resamples=64).first()
    assert r["failures"] == [] and r["promotion_state"] == "eligible"
    few = metrics.binary_gates(bias.limit(0), style.where("truth = 0"), "g", resamples=64).first()
    assert few["failures"] == ["insufficient_clear_bias_selected_support", "insufficient_opinionated_style_support", "clear_bias_precision_lcb_below_target", "opinion_style_macro_f1_bootstrap_lcb_below_target", "opinionated_style_recall_lcb_below_target"]
    three = metrics.three_class_gates(bias, style, "g", resamples=64).first()
    assert three["failures"] == ["insufficient_locked_test_bias_positive_support", "insufficient_locked_test_middle_support", "article_report_precision_gate_not_evaluable"] or "opinion_macro_f1_lcb_below_target" in three["failures"]


def test_fusion_in_two_stages(spark):
    s = "scope int, item_id string, provider_order int, rank int, url string, title string, snippet string, document_id string, content_hash string, material_kind string, claim_ids array<string>"
    items = [
        (1, "a-web", 0, 1, "https://x.org/a", "A", "s", None, None, "search_snippet", ["a"]), (1, "b-web", 0, 2, "https://x.org/b", "B", "s", None, None, "search_snippet", ["b-web"]),
        (1, "b-corpus", 1, 1, "https://x.org/b?utm_source=q", "B", "s", "d1", None, "corpus_chunk", ["b-corpus"]), (1, "c", 1, 2, "https://x.org/c", "C", "s", None, None, "corpus_chunk", ["c"]),
        (1, "b-again", 1, 3, "https://x.org/b2", "B", "s", "d1", None, "corpus_chunk", ["late"]),
    ]
    got = evidence.fuse(spark.createDataFrame(items, s), "scope", 10).orderBy("position").collect()
    assert [r["item_id"] for r in got] == ["b-corpus", "a-web", "c"] and abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-9
    assert set(got[0]["claim_ids"]) == {"b-web", "b-corpus", "late"}


def test_upsert(spark):
    t = "point_id string, document_id string, content_hash string"
    old = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("3", "b", "y")], t)
    new = spark.createDataFrame([("4", "a", "z"), ("5", "b", "y"), ("6", "c", "w")], t)
    assert rows(corpus.upsert(old, new), "point_id") == [("3",), ("4",), ("6",)]
    assert rows(corpus.upsert_status(old, new), "document_id", "status", "deleted") == [("a", "replaced", 2), ("b", "duplicate", 0), ("c", "ingested", 0)]
    again = corpus.upsert(corpus.upsert(old, new), new)
    assert rows(again, "point_id") == [("3",), ("4",), ("6",)]


def test_nearest(spark, monkeypatch):
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, query_vector array<double>")
    v = spark.createDataFrame([("a", [0.5, 1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [2.0, 0.0, 0.0])], "id string, vector array<double>")
    assert [r["id"] for r in corpus.nearest(q, v, 2).orderBy("rank").collect()] == ["b", "c"]
    many = spark.createDataFrame([(f"q{i}", [float(i % 5), 1.0]) for i in range(40)], "query_id string, query_vector array<double>")
    own = spark.createDataFrame([(i, [float(i % 7), 1.0 if i else 0.0]) for i in range(300)], "id long, vector array<double>").repartition(3)
    want = {f"q{i}": sorted((round(-sum(a * b for a, b in zip(x, [i % 5, 1])) / (sum(a * a for a in x) ** 0.5 or 1) / ((i % 5) ** 2 + 1) ** 0.5, 9), n) for n, x in enumerate([[n % 7, 1 if n else 0] for n in range(300)]))[:4] for i in range(40)}
    monkeypatch.setattr(corpus, "QUERY_BYTES", 200)
    got = corpus.nearest(many, own, 4).collect()
    assert {k: [n for _, n in v] for k, v in want.items()} == {k: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == k] for k in want}
    assert corpus.nearest(many, own.limit(0), 4).count() == 0 == corpus.nearest(many.limit(0), own, 4).count()


def test_assessment_needs_an_allowed_citation(spark):
    claims = spark.createDataFrame([(1, c, "found") for c in ("c1", "c2", "c3")], "scope int, claim_id string, retrieval_status string")
    cites = spark.createDataFrame([(1, "E1", ["c1", "c2"], True), (1, "E2", ["c3"], False)], "scope int, citation_id string, claim_ids array<string>, eligible boolean")
    answers = spark.createDataFrame([("c1", "supported", ["E1"]), ("c2", "contradicted", ["E9"]), ("c3", "supported", ["E2"])], "claim_id string, evidence_status string, citation_ids array<string>")
    assert rows(evidence.assess(claims, cites, answers, "scope"), "claim_id", "status", "citation_ids") == [("c1", "supported", ["E1"]), ("c2", "insufficient_evidence", []), ("c3", "insufficient_evidence", [])]


def test_pages(spark):
    p = "<p>" + "The council voted on Monday to close the bridge, and repairs will go on until the spring. " * 2 + "</p>"
    good = f"<html><head><title>T &amp; U</title></head><body><nav><p>Subscribe to our newsletter and get all of it first.</p></nav><article><h1>Head</h1>{p * 3}</article></body></html>"
    bad = "<html><body><div class='cookie-banner'><p>We use cookies to improve your experience on this site.</p></div></body></html>"
    df = spark.createDataFrame([(1, good), (2, bad), (3, None)], "page_id int, html string")
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert got[1]["ok"] and got[1]["title"] == "Head" and "newsletter" not in got[1]["text"] and got[1]["lead_text"].startswith("Head. The council")
    assert not got[2]["ok"] and got[2]["reason"] == "insufficient_prose" and not got[3]["ok"]
    d = pages.parse("<script type='application/ld+json'>{\"@graph\": [{\"datePublished\": \"2024-01-02\"}]}</script><link rel='canonical' href='https://x.org/a'><title>a</title>b")
    assert d["dates"] == ["2024-01-02"] and d["canonical"] == "https://x.org/a" and d["text"] == "a b"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "MBIC_train.csv").write_text("text;label\na;1\n;2\n")
    df = readers.read_strings(spark, str(tmp_path / "MBIC_train.csv"))
    assert rows(df, "text", "label", "source_file") == [("", "2", "MBIC_train.csv"), ("a", "1", "MBIC_train.csv")]
    (tmp_path / "art.csv").write_text("article_id\ttext\toutlet\nx\thello\tP\ny\t \tQ\n")
    got = readers.read_articles(spark, str(tmp_path / "art.csv")).collect()
    assert [(r["article_id"], r["text"], r["metadata"]) for r in got] == [("x", "hello", {"outlet": "P"})]
    assert readers.discover([str(tmp_path / "*.csv")])[0].endswith("MBIC_train.csv")
    with pytest.raises(FileNotFoundError):
        readers.discover([str(tmp_path / "*.none")])
    writers.write_json_atomically({"b": 1, "a": "é"}, str(tmp_path / "m" / "x.json"))
    assert json.loads((tmp_path / "m" / "x.json").read_text()) == {"a": "é", "b": 1} and writers.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    record = writers.snapshot(df, str(tmp_path / "snap"), "1", ["text", "label"])
    assert writers.verify_snapshot(spark, record, ["text", "label"]) and not writers.verify_snapshot(spark, record | {"n": 3}, ["text", "label"])


def test_fetch_is_injected(spark):
    def fetcher(url):
        if url == "slow":
            raise TimeoutError
        return ("text/html; charset=latin-1", b"caf\xe9") if url == "ok" else ("image/png", b"")

    got = readers.fetch(spark.createDataFrame([("ok",), ("slow",), ("png",)], "url string"), fetcher)
    assert rows(got, "url", "status", "text") == [("ok", "ok", "café"), ("png", "content_type_not_allowed", None), ("slow", "timeout", None)]


def test_streaming_ingestion_survives_a_rerun(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()

    def put(n, docs):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"url": u, "text": t, "source_id": "s", "fetched_at": "2024-01-01T00:00:00Z", "retention_days": 30}) for u, t in docs))
        ingest.ingest(spark, str(src), root, str(tmp_path / "ck"), once=True).awaitTermination()

    put(1, [("https://x.org/a", "one two"), ("https://x.org/b", "three")])
    put(2, [("https://x.org/a", "changed"), ("https://x.org/b", "three"), ("https://x.org/c", "new")])
    assert [r[0] for r in rows(ingest.latest(spark, root), "chunk")] == ["changed", "new", "three"]


def test_policy():
    head = policy.Head(policy.Region(True, 0.2), policy.Region(True, 0.8))
    assert [head.state(p) for p in (0.2, 0.5, 0.8)] == ["clear_non_bias", "possible_bias", "clear_bias"]
    with pytest.raises(ValueError):
        policy.Head(policy.Region(True, 0.8), policy.Region(True, 0.2))
    assert policy.next_state("pending_locked_test", gates_failed=[]) == "eligible" and policy.next_state("eligible", gates_failed=["x"]) == "eligible"
    assert policy.retrieval_failures(0.8, 0.3, 0.8, 10) == [] and len(policy.retrieval_failures(0, None, 0, 11)) == 4


STRICT, LEGACY = {"schema_version": "calibration/v3"}, {"schema_version": 2, "heads": {"bias": {"threshold": 0.7, "temperature": 1.5}, "opinion": {"enabled": False, "threshold": 0.4, "disabled_reason": "few"}}, "label_mappings": {"bias_label2id": {"a": 0}}}


def test_selection_never_falls_back():
    resolve = policy.resolve_selection
    assert resolve("argmax", None).effective == "argmax" and resolve("argmax", None).compatible
    for mode in ("auto", "calibrated"):
        got = resolve(mode, STRICT, disagreements=[])
        assert (got.effective, got.reason, got.compatible) == ("calibrated", "manifest_bound_calibration_loaded", False)
        for bad in ({"calibration": None}, {"calibration": LEGACY, "disagreements": []}, {"calibration": STRICT}, {"calibration": STRICT, "disagreements": ["head type"]}, {"calibration": STRICT, "disagreements": [], "overrides": {"bias": 0.5}}):
            with pytest.raises(ValueError):
                resolve(mode, **bad)
    for bad in (("odd", STRICT, {}), ("legacy", None, {}), ("legacy", {"schema_version": 9}, {}), ("argmax", None, {"overrides": {"bias": 0.5}}), ("legacy", LEGACY, {"labels": {"bias": {"a": 1}}}), ("legacy", LEGACY, {"head_type": "other"}), ("legacy", LEGACY, {"overrides": {"bias": 1.5}})):
        with pytest.raises(ValueError):
            resolve(bad[0], bad[1], **bad[2])


def test_legacy_gates():
    got = policy.resolve_selection("legacy", LEGACY, labels={"bias": {"a": 0}, "opinion": {"b": 0}}).gates
    assert got["bias"] == policy.HeadGate(0.7, 1.5) and got["opinion"].reason == "few" and got["report_trigger"].reason == "missing_calibration_head" and not got["report_trigger"].enabled
    got = policy.resolve_selection("legacy", LEGACY, overrides={"opinion": 0.3, "report_trigger": 0.9}).gates
    assert got["opinion"] == policy.HeadGate(0.3) and got["report_trigger"] == policy.HeadGate(0.9)
    assert policy.head_gate({"enabled": True}).reason == "missing_threshold"
    with pytest.raises(ValueError):
        policy.head_gate({"threshold": 0.5, "temperature": 0})


def test_reconcile_and_diff(spark):
    m = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "document_id string, expected_points int")
    s = spark.createDataFrame([("a",), ("b",), ("d",)], "document_id string")
    assert rows(corpus.reconcile(m, s), "document_id", "problem") == [("a", "point_count_mismatch"), ("c", "missing"), ("d", "unexpected")]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 1)], "k string, v int")
    assert rows(corpus.manifest_diff(old, new, "k", ["v"]), "k", "change") == [("a", "removed"), ("b", "changed"), ("c", "added")]


def test_url_policy_prefers_the_longest_prefix(spark):
    rules = spark.createDataFrame([("wide", ["example.com"], ["https://"], [], True, False), ("narrow", ["example.com"], ["https://example.com/p/"], ["https://example.com/p/no"], True, True)], "source_id string, domains array<string>, allowed_prefixes array<string>, excluded_prefixes array<string>, fetch_allowed boolean, ingest_allowed boolean")
    urls = spark.createDataFrame([(u,) for u in ("https://example.com/p/yes", "https://example.com/p/no/1", "https://www.example.com/x", "https://other.com/", "http://example.com/")], "url string")
    got = {r["url"]: (r["source_id"], r["allowed"]) for r in corpus.url_policy(urls, rules, "ingest").collect()}
    assert got == {"https://example.com/p/yes": ("narrow", True), "https://example.com/p/no/1": ("narrow", False), "https://www.example.com/x": ("wide", False), "https://other.com/": (None, False), "http://example.com/": (None, False)}
