"""Trusted corpus: chunks and points, search, upsert, policy, manifests, reconciliation, retention."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# --- Fixed values ---
CHUNK_WORDS, CHUNK_OVERLAP = 350, 50
CHUNKING_VERSION = "word_window/v1"
POINT_NAMESPACE = uuid.UUID("0a0e6d4c-1ef2-5a29-b33b-66ea281d2dc2")
EMBEDDING_BYTES = 384 * 4
FILTER_FIELDS = ["source_id", "source_domain", "source_tier", "license_id", "document_id", "content_hash"]
RANGE_FIELDS = ["published_at", "fetched_at", "retention_until"]

#: Bytes of query vectors that a task holds at a time, and vectors that it multiplies at a time.
QUERY_BYTES, VECTORS = 16 << 20, 2048


def chunks(docs: DataFrame, text_col: str, keep: list[str], size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per word window."""
    return docs.select(*keep, F.inline(T.chunk_words(F.col(text_col), size, overlap)))


def points(docs: DataFrame) -> DataFrame:
    """Points to index, from url, title, text, fetched_at (timestamp), retention_days and any source fields: ids, hashes, chunk and payload."""
    known = [c for c in docs.columns if c not in ("text", "url")]
    base = docs.withColumn("canonical_url", U.document_url(F.col("url"))).where("canonical_url is not null")
    rows = chunks(base.withColumn("document_id", T.document_id(F.col("canonical_url"))).withColumn("content_hash", T.content_hash(F.col("text"))), "text", ["document_id", "canonical_url", "content_hash", *known])
    made = rows.withColumn("chunk_hash", T.content_hash(F.col("chunk"))).withColumn("chunk_id", T.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("chunk_hash"), CHUNKING_VERSION))
    return made.withColumn("point_id", T.point_id(POINT_NAMESPACE)(F.col("chunk_id"))).withColumn("source_domain", U.url_domain(F.col("canonical_url"))).withColumn("retention_until", F.col("fetched_at") + F.make_dt_interval(days=F.col("retention_days")))


def metadata_filter(fields: dict[str, list], ranges: dict[str, tuple] | None = None, now=None, columns: list[str] = ()) -> Column:
    """AND of IN-lists (empty: no condition) and ranges; unless a retention range is given, only what is still retained at ``now``."""
    cond = F.lit(True)
    for name, values in fields.items():
        if values:
            cond = cond & F.col(name).isin(list(values))
    for name, (low, high) in (ranges or {}).items():
        if low is not None:
            cond = cond & (F.col(name) >= F.lit(low))
        if high is not None:
            cond = cond & (F.col(name) <= F.lit(high))
    if now is not None and "retention_until" not in (ranges or {}):
        cond = cond & (F.col("retention_until") >= F.lit(now))
    return cond


def _cosines(ids: pa.Array, vectors: pa.Array, query: np.ndarray, norms: np.ndarray, k: int, threshold: float | None):
    """For each query the positions and scores of a batch's k best vectors, and of those that tie with them."""
    x = np.stack([v for v in vectors.to_numpy(zero_copy_only=False)]).astype(np.float64)
    own = np.sqrt((x * x).sum(1))
    scale = own[:, None] * norms[None, :]
    rough = np.divide(x @ query.T, scale, out=np.zeros(scale.shape), where=scale > 0)
    for j in range(len(query)):
        column = rough[:, j]
        at = np.arange(len(x)) if len(x) <= k else np.flatnonzero(column >= np.partition(column, -k)[-k] - 1e-9)
        # Summed row by row, so that equal vectors have equal scores whatever the batch.
        score = np.divide((x[at] * query[j]).sum(1), scale[at, j], out=np.zeros(len(at)), where=scale[at, j] > 0)
        if threshold is not None:
            at, score = at[score >= threshold], score[score >= threshold]
        yield j, at, score


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, threshold: float | None = None) -> DataFrame:
    """queries (query_id, query_vector), vectors (id, vector) -> the k best per query by cosine (0 where a norm is 0), ties to the smaller id; vectors of other lengths are an error.

    The queries are a matrix in every task (``QUERY_BYTES`` at most; more of them make
    several passes), multiplied with each batch of vectors; only the best k of each batch
    and query leave it. No pair becomes a row.
    """
    few = queries.select("query_id", "query_vector")
    n, width = few.agg(F.count("*"), F.max(F.size("query_vector"))).first()
    passes = 1 + n * max(width or 0, 1) * 8 // QUERY_BYTES
    kinds = f"id {vectors.schema['id'].dataType.simpleString()}, query_id {queries.schema['query_id'].dataType.simpleString()}, score double"
    scored = None
    for i in range(passes):
        part = few.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow().combine_chunks()
        shared = queries.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            table = shared.value
            names = table["query_id"].combine_chunks() if len(table) else None
            if names is None:
                return
            query = np.stack(table["query_vector"].to_numpy()).astype(np.float64)
            norms = np.sqrt((query * query).sum(1))
            for batch in batches:
                if any(n != query.shape[1] for n in pc.unique(pc.list_value_length(batch.column(1))).to_pylist()):
                    raise ValueError("vectors differ in length")
                held, asked, scores = [], [], []
                for at in range(0, len(batch), VECTORS):
                    piece = batch.slice(at, VECTORS)
                    for j, own, score in _cosines(piece.column(0), piece.column(1), query, norms, k, threshold):
                        held.append(own + at)
                        asked.append(np.full(len(own), j))
                        scores.append(score)
                if held:
                    ids, by = batch.column(0).take(pa.array(np.concatenate(held))), names.take(pa.array(np.concatenate(asked)))
                    yield pa.RecordBatch.from_arrays([ids, by, pa.array(np.concatenate(scores))], names=["id", "query_id", "score"])

        one = vectors.select("id", "vector").mapInArrow(run, kinds)
        scored = one if scored is None else scored.union(one)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert(current: DataFrame, new: DataFrame, key: str = "point_id", document: str = "document_id", content: str = "content_hash") -> DataFrame:
    """The table after ``new``: documents whose content is there already stay as they are; others replace all their old points."""
    held = current.select(content).distinct()
    fresh = new.join(held, content, "left_anti")
    kept = current.join(fresh.select(document).distinct(), document, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_status(current: DataFrame, new: DataFrame, document: str = "document_id", content: str = "content_hash") -> DataFrame:
    """Per new document: duplicate, replaced or ingested, and how many old points go."""
    docs = new.groupBy(document).agg(F.first(content).alias(content), F.count("*").alias("points"))
    same = current.select(content).distinct().withColumn("same", F.lit(True))
    old = current.groupBy(document).agg(F.count("*").alias("old_points"))
    j = docs.join(same, content, "left").join(old, document, "left")
    status = F.when(F.col("same"), "duplicate").when(F.col("old_points") > 0, "replaced").otherwise("ingested")
    return j.select(document, status.alias("status"), "points", F.when(status == "replaced", F.col("old_points")).otherwise(0).alias("deleted"))


def staging_plan(new: DataFrame, staged: DataFrame, key: str = "content_hash", body: str = "archive_hash") -> DataFrame:
    """Content-addressed writes: ``write`` for a new address, ``same`` for the same bytes, ``collision`` for others."""
    want = new.groupBy(key).agg(F.min(body).alias("low"), F.max(body).alias("high"))
    have = staged.groupBy(key).agg(F.min(body).alias("held"))
    action = F.when((F.col("low") != F.col("high")) | (F.col("held").isNotNull() & (F.col("held") != F.col("low"))), "collision").when(F.col("held").isNull(), "write").otherwise("same")
    return want.join(have, key, "left").select(key, action.alias("action"))


def trust_class(domain: Column, research: list[str], wire: list[str], suffixes: list[str], official: list[str]) -> Column:
    """First match: research, wire service, official suffix, official domain; null otherwise."""
    any_of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda t: U.domain_matches(domain, t)) if names else F.lit(False)
    ends = F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(domain, s)) if suffixes else F.lit(False)
    return F.when(any_of(research), "empirical_research").when(any_of(wire), "wire_service").when(ends | any_of(official), "primary_official")


def url_policy(urls: DataFrame, rules: DataFrame, purpose: str, url_col: str = "url") -> DataFrame:
    """Adds canonical_url, source_id, allowed, reason. ``rules``: source_id, domains, allowed_prefixes, excluded_prefixes, fetch_allowed, ingest_allowed.

    A URL meets only rules that list its domain or a parent domain (an equi join on the
    exploded domains); of those whose prefix it has, the one with the longest prefix wins.
    """
    if purpose not in ("discover", "fetch", "ingest"):
        raise ValueError(f"purpose: {purpose!r}")
    keyed = urls.select(F.monotonically_increasing_id().alias("_row"), "*").withColumn("canonical_url", U.document_url(F.col(url_col))).withColumn("_domain", U.url_domain(F.col("canonical_url")))
    labels = F.split("_domain", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    low = F.lower("canonical_url")
    rule = rules.select(F.explode("domains").alias("_parent"), "source_id", "allowed_prefixes", "excluded_prefixes", "fetch_allowed", "ingest_allowed")
    hits = keyed.where("_domain is not null").select("_row", "canonical_url", F.explode(parents).alias("_parent")).join(rule, "_parent").where(F.exists("allowed_prefixes", lambda p: F.startswith(low, F.lower(p))))
    longest = F.array_max(F.transform("allowed_prefixes", F.length))
    best = hits.groupBy("_row").agg(F.max_by(F.struct("source_id", "excluded_prefixes", "fetch_allowed", "ingest_allowed"), F.struct(longest, "source_id")).alias("r"))
    j = keyed.join(best, "_row", "left")
    may = F.lit(True) if purpose == "discover" else F.col(f"r.{purpose}_allowed")
    reason = (
        F.when(F.col("canonical_url").isNull(), "source URL must be absolute HTTPS without credentials").when(F.col("r").isNull(), "source is not explicitly permitted by the trusted-source registry")
        .when(F.exists("r.excluded_prefixes", lambda p: F.startswith(low, F.lower(p))), "URL is explicitly excluded by the source policy")
        .when(~may, F.concat(F.lit("source '"), F.col("r.source_id"), F.lit(f"' is not permitted for {purpose}")))
    )
    return j.select(*urls.columns, "canonical_url", F.col("r.source_id").alias("source_id"), reason.isNull().alias("allowed"), reason.alias("reason"))


def manifest_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per id: added, removed, changed or unchanged."""
    line = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    j = old.select(key, line.alias("a")).join(new.select(key, line.alias("b")), key, "full_outer")
    return j.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged").alias("change"))


def reconcile(manifest: DataFrame, store: DataFrame, document: str = "document_id") -> DataFrame:
    """manifest (document, expected_points), store (points) -> documents that are missing, unexpected, or hold another number of points."""
    held = store.groupBy(document).agg(F.count("*").alias("points"))
    j = manifest.select(document, "expected_points").join(held, document, "full_outer")
    state = F.when(F.col("points").isNull(), "missing").when(F.col("expected_points").isNull(), "unexpected").when(F.col("points") != F.col("expected_points"), "point_count_mismatch")
    return j.select(document, state.alias("problem"), F.coalesce("expected_points", F.lit(0)).alias("expected_points"), F.coalesce("points", F.lit(0)).alias("points")).where("problem is not null")


def statistics(store: DataFrame, now, due_days: int = 30) -> DataFrame:
    """Exact corpus statistics in one row."""
    docs = store.groupBy("document_id").agg(F.count("*").alias("chunks"), F.first("content_hash").alias("content_hash"), F.min("retention_until").alias("until"))
    per_hash = docs.groupBy("content_hash").agg(F.count("*").alias("n"))
    shared = per_hash.agg(F.count_if(F.col("n") > 1).alias("duplicate_contents"))
    at = F.lit(now)
    a = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("until") <= at).alias("expired"), F.count_if((F.col("until") > at) & (F.col("until") <= at + F.make_dt_interval(days=F.lit(due_days)))).alias("due"))
    return a.crossJoin(shared).withColumn("vector_bytes", F.col("chunks") * EMBEDDING_BYTES)  # one row each


def source_statistics(store: DataFrame) -> DataFrame:
    """Documents, chunks and distinct contents of each source."""
    docs = store.groupBy("source_id", "document_id").agg(F.count("*").alias("chunks"), F.min("content_hash").alias("content_hash"))
    by_content = docs.groupBy("source_id", "content_hash").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
    return by_content.groupBy("source_id").agg(F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"), F.count("*").alias("contents"))


def due(rows: DataFrame, now, column: str = "refresh_after", statuses: list[str] | None = None) -> DataFrame:
    out = rows.where(F.col(column) <= F.lit(now))
    return out.where(F.col("status").isin(statuses)) if statuses else out


def keep_newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Adds ``keep``: among the newest n of its key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("keep", F.row_number().over(w) <= n)


def violations(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """One row per record and broken rule; ``rules``: message -> condition that must hold (null fails)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules.items()]), lambda m: m.isNotNull())
    return rows.select(id_col, F.explode(broken).alias("rule"))


def unique_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values that occur more than once, by column."""
    parts = [rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(c).alias("column"), "value", "n") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def expected_columns(df: DataFrame, schema: dict[str, str]) -> list[str]:
    """What a table lacks of a schema, or has under another type."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')}, expected {t}" for c, t in schema.items() if have.get(c) != t]
