"""Plans of a corpus's life, by hand."""

import datetime
import json

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.operators import lifecycle, manifests

NOW = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)
BASE = {c: "x" for c in ("source_id", "title", "extraction_version")} | {"published_at": None, "fetched_at": "2024-01-01T00:00:00Z", "refresh_after": "2024-02-01", "retention_until": "2025-01-01T00:00:00Z", "expected_point_count": 1, "rights_basis": ("l", "u"), "rights_review": ("approved", "r", "d", True), "archive_hash": "a"}


def made(spark, rows):
    """Documents with ids and hashes as their URL and text have them, unless stated."""
    table = spark.createDataFrame([{"position": i, "canonical_url": f"https://x.org/{i}", "status": "approved", "canonical_document_id": None, "content_hash": None} | BASE | r for i, r in enumerate(rows)], manifests.DOCUMENT)
    return table.withColumn("canonical_document_id", F.coalesce("canonical_document_id", T.document_id(U.document_url(F.col("canonical_url"))))).withColumn("content_hash", F.coalesce("content_hash", T.content_hash(F.concat(F.lit("text "), F.col("position")))))


def test_ingest_plan(spark):
    docs = made(spark, [{}, {}, {}, {"status": "candidate"}, {"archive_hash": "b"}, {"canonical_document_id": "odd"}, {"expected_point_count": 2}, {"content_hash": "f" * 64}, {"content_hash": "e" * 64}])
    h = lambda i: T.content_hash(F.lit(f"text {i}"))
    staged = spark.range(7).select(T.content_hash(F.concat(F.lit("text "), F.col("id"))).alias("content_hash"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("a").alias("archive_hash"))
    staged = staged.union(spark.createDataFrame([("e" * 64, "other", "a")], staged.schema))
    ids = {r["position"]: r["canonical_document_id"] for r in docs.collect()}
    store = spark.range(1).select(F.lit(ids[1]).alias("document_id"), h(1).alias("content_hash")).union(spark.range(1).select(F.lit(ids[2]), F.lit("old")))
    got = {r["document_id"]: (r["action"], r["reason"]) for r in lifecycle.ingest_plan(docs, staged, store).collect()}
    assert got == {
        ids[0]: ("ingest", None), ids[1]: ("skip", None), ids[2]: ("replace", None), ids[4]: ("refuse", "staged archive has another hash"), ids[5]: ("refuse", "document id is not that of its URL"),
        ids[6]: ("refuse", "point count differs from the manifest"), ids[7]: ("refuse", "staged content is missing"), ids[8]: ("refuse", "staged text has another hash"),
    }


def test_refresh_and_expiry(spark, tmp_path):
    docs = made(spark, [{}, {"refresh_after": "2024-04-01"}, {"refresh_after": None, "status": "pending_fetch"}, {"status": "expired"}, {"retention_until": "2024-02-29T00:00:00Z"}])
    assert [r["position"] for r in lifecycle.due_for_refresh(docs, NOW).orderBy("position").collect()] == [0, 2, 4]
    ids = {r["position"]: r["canonical_document_id"] for r in docs.collect()}
    fetched = spark.createDataFrame([(ids[0], "https://x.org/new?utm_source=q#f", "New", "one two", "z", None, 10)], "canonical_document_id string, final_url string, title string, text string, archive_hash string, published_at string, retention_days int")
    after = {r["position"]: r for r in lifecycle.refreshed(docs, fetched, NOW).collect()}
    new = after[0]
    assert (new["status"], new["canonical_url"], new["title"], new["fetched_at"], new["refresh_after"], new["retention_until"], new["expected_point_count"]) == ("pending_review", "https://x.org/new", "New", "2024-03-01T00:00:00Z", "2024-03-31T00:00:00Z", "2024-03-11T00:00:00Z", 1)
    assert tuple(new["rights_review"]) == ("pending", None, None, False) and after[1]["status"] == "approved" and set(after) == set(range(5))
    assert [r["status"] for r in lifecycle.expired(docs, NOW).orderBy("position").collect()] == ["approved", "approved", "pending_fetch", "expired", "expired"]
    again = lifecycle.approved(lifecycle.refreshed(docs, fetched, NOW), [new["canonical_document_id"]], "me", "2024-03-02").where("position = 0").first()
    assert again["status"] == "approved" and tuple(again["rights_review"]) == ("approved", "me", "2024-03-02", False)
    record = json.loads(open(lifecycle.run_record(str(tmp_path), "expire", {"documents": 1}, now=NOW)).read())
    assert record["schema_version"] == "corpus_run/v1" and record["created_at"] == "2024-03-01T00:00:00Z" and record["result"] == {"documents": 1}
