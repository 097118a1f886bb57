"""Manifest and data set rules, and selection, against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import manifests, selection

HASH = "a" * 64
GOOD = {
    "position": 0, "source_id": "s", "canonical_document_id": "d0", "canonical_url": "https://x.org/a", "title": "T", "extraction_version": "1", "status": "approved", "content_hash": HASH, "archive_hash": HASH, "published_at": None,
    "fetched_at": "2024-01-02T03:04:05Z", "refresh_after": "2024-02-02", "retention_until": "2025-02-02", "expected_point_count": 3, "rights_basis": ("l", "https://x.org/l"), "rights_review": ("approved", "r", "2024-01-03", False),
}


def document_rules(spark, rows, **options):
    table = spark.createDataFrame([GOOD | r for r in rows], manifests.DOCUMENT)
    return {(r["position"], r["rule"]) for r in manifests.document_errors(table, **options).collect()}


@pytest.mark.parametrize("change,rules", [
    ({}, set()), ({"title": ""}, {"title is required"}), ({"canonical_url": "http://x.org/a"}, {"canonical_url must be canonical HTTPS"}), ({"status": "odd"}, {"status is unsupported"}), ({"status": "candidate", "content_hash": None, "fetched_at": None}, set()),
    ({"expected_point_count": -1}, {"expected_point_count must be a non-negative integer", "expected_point_count must be positive when approved"}), ({"expected_point_count": 0}, {"expected_point_count must be positive when approved"}),
    ({"published_at": "yesterday"}, {"published_at must be ISO-8601 or null"}), ({"fetched_at": None}, {"fetched_at is required when approved"}), ({"content_hash": "A"}, {"content_hash must be a SHA-256 hash"}),
    ({"rights_review": None}, {"rights_review is required", "rights_review must be an object", "rights_review.status must be approved"}), ({"rights_review": ("approved", "", None, False)}, {"rights_review needs reviewer and reviewed_at"}),
    ({"rights_review": ("approved", "r", "d", True)}, {"is marked as third-party material"}), ({"rights_review": ("open", None, None, None)}, {"rights_review.status must be approved"}), ({"rights_basis": ("l", None)}, {"rights_basis needs id and url"}),
])
def test_document_rules(spark, change, rules):
    assert {r for _, r in document_rules(spark, [change])} == rules


def test_documents_together(spark):
    more = [{}, {"position": 1, "canonical_url": "https://X.org:443/a#b"}, {"position": 2, "canonical_document_id": "d2", "canonical_url": "https://x.org/c", "status": "candidate"}]
    assert document_rules(spark, more) == {(1, "canonical_document_id is duplicated"), (1, "canonical_url is duplicated")}
    assert (2, "status is not approved") in document_rules(spark, more, require_approved=True)
    registry = spark.createDataFrame([("s", ["x.org"], ["https://x.org/"], ["https://x.org/no"], True, True, "l", "https://x.org/l"), ("t", ["y.org"], ["https://y.org/"], [], True, True, "m", "https://y.org/m")], "source_id string, domains array<string>, allowed_prefixes array<string>, excluded_prefixes array<string>, fetch_allowed boolean, ingest_allowed boolean, license_id string, license_url string")
    rows = [{}, {"position": 1, "canonical_document_id": "d1", "canonical_url": "https://x.org/no/1"}, {"position": 2, "canonical_document_id": "d2", "canonical_url": "https://y.org/1"}, {"position": 3, "canonical_document_id": "d3", "canonical_url": "https://x.org/2", "rights_basis": ("z", "u")}]
    assert document_rules(spark, rows, registry=registry) == {(1, "is rejected by the current source policy"), (2, "source_id does not match the source registry"), (3, "rights_basis does not match the source registry")}


def test_header():
    good = {"schema_version": "trusted_corpus_manifest/v1", "manifest_id": "m", "created_at": "t", "policy_version": "1", "collection": "c", "embedding": dict(manifests.EMBEDDING)}
    assert manifests.header_errors(good) == []
    assert manifests.header_errors(good | {"collection": "", "embedding": good["embedding"] | {"chunk_words": 1}}) == ["manifest field 'collection' is required", "embedding.chunk_words must be 350"]
    assert manifests.header_errors({})[-1] == "embedding must be an object" and len(manifests.header_errors({})) == 7


def test_dataset(spark):
    ok, span = ("reviewed", "r", "d"), ("d", "c", 0, 5, "high")
    cases = [(i, f"c{i}", "development" if i < 80 else "held_out", "x", i < 96, manifests.SOURCES[i % 8], ["d"] if i < 96 else [], 10, [span] if i < 96 else [], ok) for i in range(120)]
    scenarios = [(i, "development" if i < 16 else "held_out", ["c1", "c2"], ok) for i in range(24)]
    c, s = spark.createDataFrame(cases, manifests.CASE), spark.createDataFrame(scenarios, manifests.SCENARIO)
    whole = manifests.dataset_totals(c, s).first()
    assert whole["errors"] == [] and whole["review_complete"] and manifests.case_errors(c).count() == 0 == manifests.scenario_errors(s, c).count()
    bad = [(0, "c", "development", "x", True, "us_sec", [], 10, [span], ok), (1, "c", "odd", "x", False, "us_sec", ["d"], 0, [], None), (2, "e", "held_out", "x", True, "us_sec", ["d"], 3, [("d", None, 0, 1, "x")], ok), (3, "f", "held_out", "x", True, "us_sec", ["d"], 10, None, ok)]
    b = spark.createDataFrame(bad, manifests.CASE)
    assert {(r["position"], r["rule"]) for r in manifests.case_errors(b).collect()} == {
        (0, "is answerable without a relevant document"), (1, "case_id is duplicated"), (1, "split is invalid"), (1, "is unanswerable but has relevant documents"), (2, "needs reviewed top-10 relevance judgments"), (2, "contains an invalid relevant chunk span"), (3, "needs reviewed relevant chunk spans"),
    }
    few = spark.createDataFrame([(0, "development", ["c"], ok), (1, "held_out", ["c", "zz"], ok), (2, "held_out", ["c", "e"], None)], manifests.SCENARIO)
    assert [(r["position"], r["rule"]) for r in manifests.scenario_errors(few, b).orderBy("position").collect()] == [(0, "claim_ids is invalid"), (1, "claim_ids is invalid")]
    total = manifests.dataset_totals(b, few).first()
    assert len(total["errors"]) == 6 and not total["review_complete"]


def test_selection(spark):
    rows = spark.createDataFrame([(0, "Biased", "Entirely factual", 0.7, 0.9), (1, "Biased", "other", 0.55, 0.2), (2, "Non-biased", "Entirely factual", 0.2, 0.8), (3, "Biased", "other", None, None)], "i int, b string, o string, p double, f double")
    cols = [F.col(c) for c in ("b", "o", "p", "f")]

    def of(column):
        return [(r["x"]["selected"], r["x"]["reasons"], r["x"]["abstained"], r["x"]["status"]) for r in rows.select("i", column.alias("x")).orderBy("i").collect()]

    gate = selection.Gate
    assert of(selection.by_labels(*cols[:2])) == [(True, ["bias_argmax"], [], "uncertain"), (True, ["bias_argmax", "opinion_argmax"], [], "uncertain"), (False, [], ["no_positive_label"], "uncertain"), (True, ["bias_argmax", "opinion_argmax"], [], "uncertain")]
    got = of(selection.by_thresholds(*cols, bias=gate(True, 0.6), opinion=gate(True, 0.9)))
    assert got == [(True, ["bias_threshold_met"], [], "confident"), (False, [], ["bias_below_threshold", "opinion_below_threshold"], "abstained"), (False, [], ["no_positive_label"], "abstained"), (False, [], ["bias_below_threshold", "opinion_below_threshold"], "abstained")]
    got = of(selection.by_thresholds(*cols, bias=gate(True), report=gate(True, 0.75), compatible=True))
    assert got == [(False, [], ["bias_missing_threshold", "report_trigger_below_threshold"], "uncertain"), (True, ["report_trigger_threshold_met"], [], "uncertain"), (False, [], ["no_positive_label"], "uncertain"), (False, [], ["bias_missing_threshold", "opinion_head_disabled", "report_trigger_below_threshold"], "uncertain")]
    assert of(selection.by_thresholds(*cols, report=gate(True)))[2][2] == ["no_positive_label", "report_trigger_missing_threshold"]
