"""What a manifest of corpus documents, or a retrieval data set, breaks: one line a broken rule. Tables of any size; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import corpus

# --- Fixed values ---
CORPUS_SCHEMA, DATASET_SCHEMA = "trusted_corpus_manifest/v1", "retrieval_eval/v1"
HEADER_FIELDS = ["manifest_id", "created_at", "policy_version", "collection", "embedding"]
EMBEDDING = {"model": "sentence-transformers/all-MiniLM-L6-v2", "distance": "cosine", "vector_name": "content", "content_field": "chunk_text", "chunk_words": corpus.CHUNK_WORDS, "chunk_overlap_words": corpus.CHUNK_OVERLAP}
DOCUMENT_FIELDS = ["source_id", "canonical_document_id", "canonical_url", "title", "extraction_version", "rights_basis", "rights_review", "refresh_after", "retention_until", "status", "expected_point_count"]
DATE_FIELDS = ["published_at", "fetched_at", "refresh_after", "retention_until"]
APPROVED, CANDIDATE = ["approved", "active"], ["candidate", "pending_fetch", "pending_review", "expired"]
SOURCES = ["us_bls", "us_gao", "us_bea", "us_census", "us_cbo", "us_federal_reserve", "us_cdc", "us_sec"]
SPLITS = ["development", "held_out"]

#: Columns of a manifest's documents; texts, but for the count and the two nested ones.
DOCUMENT = (
    "position long, " + ", ".join(f"{c} string" for c in ["source_id", "canonical_document_id", "canonical_url", "title", "extraction_version", "status", "content_hash", "archive_hash", *DATE_FIELDS])
    + ", expected_point_count long, rights_basis struct<id:string,url:string>, rights_review struct<status:string,reviewer:string,reviewed_at:string,third_party_marked:boolean>"
)
CASE = (
    "position long, case_id string, split string, claim string, answerable boolean, source_id string, relevant_document_ids array<string>, judgments int, "
    "spans array<struct<document_id:string,chunk_id:string,start_word:int,end_word:int,relevance:string>>, review struct<status:string,reviewer:string,reviewed_at:string>"
)
SCENARIO = "position long, split string, claim_ids array<string>, review struct<status:string,reviewer:string,reviewed_at:string>"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``_later``: not the first row with its key. Keys are reduced before they meet their rows."""
    first = rows.where(~_blank(F.col(key))).groupBy(key).agg(F.min("position").alias("_first"))
    return rows.join(first, key, "left").withColumn("_later", F.coalesce(F.col("position") > F.col("_first"), F.lit(False))).drop("_first")


def header_errors(manifest: dict) -> list[str]:
    """Rules of a corpus manifest's own fields."""
    out = [] if manifest.get("schema_version") == CORPUS_SCHEMA else [f"schema_version must be {CORPUS_SCHEMA}"]
    out += [f"manifest field {f!r} is required" for f in HEADER_FIELDS if not manifest.get(f)]
    embedding = manifest.get("embedding")
    if not isinstance(embedding, dict):
        return [*out, "embedding must be an object"]
    return out + [f"embedding.{k} must be {v!r}" for k, v in EMBEDDING.items() if embedding.get(k) != v]


def document_errors(documents: DataFrame, *, require_approved: bool = False, registry: DataFrame | None = None) -> DataFrame:
    """(position, rule) from rows of the columns in ``DOCUMENT``. ``registry``: rules as ``corpus.url_policy`` takes them, and license_id and license_url."""
    url = U.document_url(F.col("canonical_url"))
    rows = documents.withColumn("_url", url)
    rows = _repeated(rows, "canonical_document_id").withColumnRenamed("_later", "_id_later")
    rows = _repeated(rows, "_url").withColumnRenamed("_later", "_url_later")
    count, review, basis = F.col("expected_point_count"), F.col("rights_review"), F.col("rights_basis")
    must, known = {}, F.col("status").isin(APPROVED)
    for f in DOCUMENT_FIELDS:
        must[f"{f} is required"] = F.col(f).isNotNull() if f in ("rights_basis", "rights_review", "expected_point_count") else ~_blank(F.col(f))
    must["canonical_document_id is duplicated"] = ~F.col("_id_later")
    must["canonical_url must be canonical HTTPS"] = F.col("_url").isNotNull()
    must["canonical_url is duplicated"] = ~F.col("_url_later")
    must["status is unsupported"] = F.col("status").isin(APPROVED + CANDIDATE)
    must["expected_point_count must be a non-negative integer"] = count >= 0
    for f in DATE_FIELDS:
        must[f"{f} must be ISO-8601 or null"] = F.col(f).isNull() | T.iso_utc(F.col(f)).isNotNull()
    must["rights_review must be an object"] = review.isNotNull()
    must["rights_basis needs id and url"] = ~_blank(basis["id"]) & ~_blank(basis["url"])
    strict = F.lit(True) if require_approved else F.coalesce(known, F.lit(False))
    approved = {
        "status is not approved": known, "fetched_at is required when approved": T.iso_utc(F.col("fetched_at")).isNotNull(), "rights_review.status must be approved": review["status"] == "approved",
        "rights_review needs reviewer and reviewed_at": (F.coalesce(review["status"], F.lit("")) != "approved") | (~_blank(review["reviewer"]) & ~_blank(review["reviewed_at"])),
        "is marked as third-party material": ~F.coalesce(review["third_party_marked"], F.lit(False)), "expected_point_count must be positive when approved": count > 0,
        **{f"{f} must be a SHA-256 hash": T.is_sha256(F.col(f)) for f in ("content_hash", "archive_hash")},
    }
    must |= {m: ~strict | F.coalesce(ok, F.lit(False)) for m, ok in approved.items()}
    if registry is not None:
        licensed = registry.select("source_id", F.struct("license_id", "license_url").alias("_license")).dropDuplicates(["source_id"])
        judged = corpus.url_policy(rows.select("position", "_url").where("_url is not null"), registry, "ingest", "_url").select("position", F.col("source_id").alias("_source"), "allowed")
        rows = rows.join(judged.join(licensed.withColumnRenamed("source_id", "_source"), "_source", "left"), "position", "left")
        allowed = F.coalesce("allowed", F.lit(True))
        own = F.coalesce(F.col("source_id") == F.col("_source"), F.col("_url").isNull())
        must["is rejected by the current source policy"] = allowed
        must["source_id does not match the source registry"] = ~allowed | own
        must["rights_basis does not match the source registry"] = ~allowed | ~own | basis.isNull() | F.col("_url").isNull() | ((basis["id"] == F.col("_license.license_id")) & (basis["url"] == F.col("_license.license_url")))
    return corpus.violations(rows, "position", must)


def case_errors(cases: DataFrame) -> DataFrame:
    """(position, rule) from rows of the columns in ``CASE``; only reviewed cases need judgments and spans."""
    rows = _repeated(cases, "case_id")
    found = F.size(F.coalesce("relevant_document_ids", F.array().cast("array<string>"))) > 0
    answerable, spans = F.coalesce("answerable", F.lit(False)), F.coalesce(F.size("spans"), F.lit(0))
    reviewed = _reviewed()
    whole = F.forall(F.coalesce("spans", F.array().cast(cases.schema["spans"].dataType)), lambda s: s["document_id"].isNotNull() & s["chunk_id"].isNotNull() & s["start_word"].isNotNull() & s["end_word"].isNotNull() & s["relevance"].isNotNull())
    return corpus.violations(rows, "position", {
        "case_id is duplicated": ~F.col("_later"), "split is invalid": F.col("split").isin(SPLITS), "is answerable without a relevant document": ~answerable | found, "is unanswerable but has relevant documents": answerable | ~found,
        "needs reviewed top-10 relevance judgments": ~reviewed | (F.coalesce("judgments", F.lit(0)) >= 10), "needs reviewed relevant chunk spans": ~reviewed | ~answerable | (spans > 0), "contains an invalid relevant chunk span": ~reviewed | whole,
    })


def _reviewed() -> Column:
    return F.coalesce((F.col("review.status") == "reviewed") & ~_blank(F.col("review.reviewer")) & ~_blank(F.col("review.reviewed_at")), F.lit(False))


def scenario_errors(scenarios: DataFrame, cases: DataFrame) -> DataFrame:
    """(position, rule): a scenario names two claims at least, all of them cases."""
    named = scenarios.select("position", F.explode("claim_ids").alias("case_id")).join(cases.select("case_id").distinct(), "case_id", "left_anti").select("position").distinct().withColumn("_unknown", F.lit(True))
    rows = scenarios.join(named, "position", "left")
    return corpus.violations(rows, "position", {"claim_ids is invalid": (F.size("claim_ids") >= 2) & F.col("_unknown").isNull()})


def dataset_totals(cases: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row: the counts, whether all is reviewed, and the rules of the whole data set that they break."""
    a = cases.agg(F.count("*").alias("cases"), F.count_if(F.col("answerable")).alias("answerable"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.coalesce(F.bool_and(_reviewed()), F.lit(True)).alias("cases_reviewed"))
    b = scenarios.agg(F.count("*").alias("scenarios"), *[F.count_if(F.col("split") == s).alias(f"scenarios_{s}") for s in SPLITS], F.coalesce(F.bool_and(_reviewed()), F.lit(True)).alias("scenarios_reviewed"))
    by_source = cases.groupBy(F.coalesce("source_id", F.lit("")).alias("source_id")).agg(F.count("*").alias("n"))
    even = by_source.agg(((F.count("*") == len(SOURCES)) & F.bool_and((F.col("n") == 15) & F.col("source_id").isin(SOURCES))).alias("even"))
    rules = [
        ("dataset must contain exactly 120 atomic cases", F.col("cases") == 120), ("dataset must contain exactly 96 answerable cases", F.col("answerable") == 96), ("dataset must contain exactly 24 unanswerable cases", F.col("cases") - F.col("answerable") == 24),
        ("dataset split must be 80 development and 40 held-out", (F.col("development") == 80) & (F.col("held_out") == 40)), ("cases must be evenly stratified with 15 cases per source", F.coalesce("even", F.lit(False))),
        ("multi-claim scenarios must split 16 development and 8 held-out", (F.col("scenarios") == 24) & (F.col("scenarios_development") == 16) & (F.col("scenarios_held_out") == 8)),
    ]
    out = a.crossJoin(b).crossJoin(even)  # one row each
    out = out.withColumn("errors", F.filter(F.array(*[F.when(~ok, m) for m, ok in rules]), lambda x: x.isNotNull()))
    return out.withColumn("review_complete", F.col("cases_reviewed") & F.col("scenarios_reviewed")).drop("cases_reviewed", "scenarios_reviewed", "even")
