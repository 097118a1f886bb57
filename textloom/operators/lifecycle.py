"""Plans for the life of a corpus: what an ingestion, a refresh or an expiry would do, and the documents after it. Nothing changes until a caller writes the outcome."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.writers import write_json_atomically
from .manifests import APPROVED

# --- Fixed values ---
RUN_SCHEMA, REFRESH_DAYS = "corpus_run/v1", 30


def _at(c: str) -> Column:
    return F.try_to_timestamp(F.trim(F.col(c)))


def _utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ingest_plan(documents: DataFrame, staged: DataFrame, store: DataFrame) -> DataFrame:
    """Per approved document: document_id, action (ingest, replace, skip, or refuse) and why it is refused.

    documents: canonical_document_id, canonical_url, status, content_hash, archive_hash,
    expected_point_count; staged: content_hash (its address), text, archive_hash; store:
    points with document_id and content_hash. Content that the store has is skipped
    whatever document it belongs to.
    """
    ours = documents.where(F.col("status").isin(APPROVED)).select("canonical_document_id", "canonical_url", "content_hash", F.col("archive_hash").alias("want_archive"), "expected_point_count")
    there = staged.select("content_hash", F.col("archive_hash").alias("held_archive"), T.content_hash(F.col("text")).alias("held_hash"), F.size(T.chunk_words(F.col("text"))).alias("chunks")).dropDuplicates(["content_hash"])
    known = store.select("content_hash").distinct().withColumn("known", F.lit(True))
    old = store.select(F.col("document_id").alias("canonical_document_id")).distinct().withColumn("old", F.lit(True))
    rows = ours.join(there, "content_hash", "left").join(known, "content_hash", "left").join(old, "canonical_document_id", "left")
    why = (
        F.when(F.col("held_hash").isNull(), "staged content is missing").when(F.col("held_hash") != F.col("content_hash"), "staged text has another hash").when(~F.col("held_archive").eqNullSafe(F.col("want_archive")), "staged archive has another hash")
        .when(~F.col("canonical_document_id").eqNullSafe(T.document_id(U.document_url(F.col("canonical_url")))), "document id is not that of its URL").when(F.col("chunks") != F.col("expected_point_count"), "point count differs from the manifest")
    )
    action = F.when(why.isNotNull(), "refuse").when(F.col("known"), "skip").when(F.col("old"), "replace").otherwise("ingest")
    return rows.select(F.col("canonical_document_id").alias("document_id"), action.alias("action"), why.alias("reason"))


def due_for_refresh(documents: DataFrame, now: datetime.datetime) -> DataFrame:
    """Approved documents, and those that wait to be fetched, whose refresh date has come or can't be read."""
    return documents.where(F.col("status").isin([*APPROVED, "pending_fetch"]) & (F.coalesce(_at("refresh_after"), F.lit(now)) <= F.lit(now)))


def refreshed(documents: DataFrame, fetched: DataFrame, now: datetime.datetime) -> DataFrame:
    """The candidate manifest's documents: fetched ones get their new content and wait for a review, never approved; the others stay.

    fetched: canonical_document_id (as it was), final_url, title, text, archive_hash, published_at, retention_days.
    """
    url = U.document_url(F.col("final_url"))
    new = fetched.select(
        "canonical_document_id", F.lit(True).alias("_new"), T.document_id(url).alias("_id"), url.alias("_url"), F.col("title").alias("_title"), T.content_hash(F.col("text")).alias("_hash"), F.col("archive_hash").alias("_archive"), F.col("published_at").alias("_published"),
        _utc(F.lit(now) + F.make_dt_interval(days=F.col("retention_days"))).alias("_until"), F.size(T.chunk_words(F.col("text"))).cast("long").alias("_points"),
    )
    rows = documents.join(new, "canonical_document_id", "left")
    values = {
        "canonical_document_id": F.col("_id"), "canonical_url": F.col("_url"), "title": F.col("_title"), "content_hash": F.col("_hash"), "archive_hash": F.col("_archive"), "published_at": F.col("_published"), "fetched_at": _utc(F.lit(now)),
        "refresh_after": _utc(F.lit(now) + F.make_dt_interval(days=F.lit(REFRESH_DAYS))), "retention_until": F.col("_until"), "status": F.lit("pending_review"), "expected_point_count": F.col("_points"),
    }
    kind = documents.schema
    if "rights_review" in documents.columns:
        values["rights_review"] = F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("reviewed_at"), F.lit(False).alias("third_party_marked"))
    return rows.select(*[F.when(F.col("_new"), values[c].cast(kind[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in documents.columns])


def expired(documents: DataFrame, now: datetime.datetime) -> DataFrame:
    """The documents with ``expired`` as the status of those whose retention has ended."""
    over = F.coalesce(_at("retention_until") <= F.lit(now), F.lit(False))
    return documents.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def approved(documents: DataFrame, ids: list[str], reviewer: str, at: str) -> DataFrame:
    """The documents with a review for the named ones, which become approved."""
    named = F.col("canonical_document_id").isin(ids)
    review = F.struct(F.lit("approved").alias("status"), F.lit(reviewer).alias("reviewer"), F.lit(at).alias("reviewed_at"), F.coalesce(F.col("rights_review.third_party_marked"), F.lit(False)).alias("third_party_marked"))
    return documents.withColumn("rights_review", F.when(named, review).otherwise(F.col("rights_review"))).withColumn("status", F.when(named, "approved").otherwise(F.col("status")))


def run_record(folder: str, operation: str, result: dict, *, now: datetime.datetime | None = None) -> str:
    """Writes what an applied operation did; returns the file's path."""
    run = f"run_{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/runs/{run}.json"
    at = (now or datetime.datetime.now(datetime.UTC)).isoformat().replace("+00:00", "Z")
    write_json_atomically({"schema_version": RUN_SCHEMA, "run_id": run, "operation": operation, "created_at": at, "result": result}, path)
    return path
