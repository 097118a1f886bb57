"""Readers: text tables, articles, routed splits, fetched pages."""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import written

# --- Fixed values ---
PDF_MIN_CHARS, PDF_CHARS_PER_PAGE, PDF_MAX_PAGES, PDF_LETTERS = 200, 20, 250, 0.35
MAX_BYTES = 12 << 20
ARTICLE_ALIASES = {"text": ["text", "article", "content", "body"], "id": ["article_id", "id", "uuid"]}
METADATA = ["news_link", "outlet", "topic", "type"]


def read_strings(spark: SparkSession, paths: str | list[str], sep: str = ";") -> DataFrame:
    """Delimited text with every column a string; an empty field is the empty string, never null; ``source_file`` is the file's name."""
    df = spark.read.csv(paths, sep=sep, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\x00", emptyValue="")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns], F.col("_metadata.file_name").alias("source_file"))


def read_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """By suffix: ``.csv`` or ``.parquet``; others are an error."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return read_strings(spark, path, sep)
    raise ValueError(f"unknown kind of table: {path}")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs most in the first line."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return max(",;\t|", key=lambda c: (line.count(c), c == ","))


def read_articles(spark: SparkSession, path: str, sep: str | None = None, text_column: str | None = None, id_column: str | None = None) -> DataFrame:
    """article_id, text, metadata: blank texts are left out; a row without an id column is ``row-N``."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = read_strings(spark, path, sep or sniff_separator(spark, path)).drop("source_file")
    text = T.first_existing(df.columns, text_column, ARTICLE_ALIASES["text"], required=True)
    key = T.first_existing(df.columns, id_column, ARTICLE_ALIASES["id"])
    rows = df if key else with_row_numbers(df)
    number = F.col(key).cast("string") if key else F.concat(F.lit("row-"), F.col("_n"))
    meta = [x for c in METADATA if c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return rows.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(number.alias("article_id"), F.col(text).alias("text"), (F.create_map(*meta) if meta else F.create_map().cast("map<string,string>")).alias("metadata"))


def with_row_numbers(df: DataFrame) -> DataFrame:
    """Adds ``_n``: the row's number from 0 in the order in which the files are read. Partitions are counted first; one number a partition comes together."""
    placed = written(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_id").alias("_low"))
    before = sizes.select("_part", "_low", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row a partition
    return placed.join(F.broadcast(before), "_part").withColumn("_n", F.col("_before") + F.col("_id") - F.col("_low")).drop("_part", "_id", "_low", "_before")


def inline_article(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("article-0", text)], "article_id string, text string")


def file_articles(spark: SparkSession, path: str) -> DataFrame:
    """One article per file, named by the file's stem."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("article_id"), F.col("value").alias("text"))


def discover(patterns: list[str]) -> list[str]:
    """Sorted distinct matches; none is an error."""
    found = sorted({f for p in patterns for f in glob.glob(p)})
    if not found:
        raise FileNotFoundError(f"nothing matches {patterns}")
    return found


def split_files(paths: list[str]) -> dict[str, list[str]]:
    """``train`` and ``test`` by file name; everything is ``train`` if neither occurs."""
    out = {k: [p for p in paths if k in os.path.basename(p).lower()] for k in ("train", "test")}
    return out if out["train"] and out["test"] else {"train": list(paths), "test": []}


def route_splits(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Rows whose split column, folded, is one of ``names``; ``dataset_split`` says which."""
    value = F.lower(F.trim(column))
    out = F
    for k, v in names.items():
        out = out.when(value == k.casefold(), v)
    return df.withColumn("dataset_split", out).where("dataset_split is not null")


def read_splits(spark: SparkSession, paths: list[str], sep: str = ";", split_column: str | None = None) -> DataFrame:
    """Files to one table: by a split column, by file names, or all as train."""
    if split_column:
        return route_splits(_all(spark, paths, sep), split_column, {"train": "train", "test": "test"})
    parts = [_all(spark, fs, sep).withColumn("dataset_split", F.lit(k)) for k, fs in split_files(paths).items() if fs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _all(spark, paths, sep):
    out = None
    for p in paths:
        df = read_table(spark, p, sep)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def pdf_quality(text: Column, pages: Column) -> Column:
    """Whether a document's extracted text is fit to keep."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (pages >= 1) & (pages <= PDF_MAX_PAGES) & (F.char_length(text) >= F.greatest(F.lit(PDF_MIN_CHARS), pages * PDF_CHARS_PER_PAGE)) & (letters / F.greatest(F.lit(1), F.char_length(text)) >= PDF_LETTERS)


FETCHED = "url string, status string, mime string, body binary, text string, content_hash string, archive_hash string"


def fetch(urls: DataFrame, fetcher: Callable[[str], tuple[str, bytes]], allowed_types: tuple[str, ...] = ("text/html", "text/plain"), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Fetches each URL by an injected function url -> (content type, bytes); failures are rows with a status, not errors. No network code lives here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_fetched(u, fetcher, allowed_types, max_bytes) for u in b["url"]], columns=[c.split()[0] for c in FETCHED.split(", ")])

    return urls.select("url").mapInPandas(run, FETCHED)


def _fetched(url, fetcher, allowed, most):
    import re

    try:
        kind, body = fetcher(url)
    except TimeoutError:
        return [url, "timeout", None, None, None, None, None]
    except Exception:
        return [url, "network_error", None, None, None, None, None]
    mime = (kind or "").split(";")[0].strip().lower()
    if mime not in allowed:
        return [url, "content_type_not_allowed", mime, None, None, None, None]
    if len(body) > most:
        return [url, "too_large", mime, None, None, None, None]
    m = re.search(r"charset\s*=\s*[\"']?([^;\"'\s]+)", kind or "", re.I)
    text = " ".join(T.decode_bytes(body, m[1] if m else None).split())
    return [url, "ok", mime, body, text, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(body).hexdigest()]


def search(queries: DataFrame, provider: Callable[[str], list[dict]]) -> DataFrame:
    """Search hits by an injected function query -> ranked hits with url, title, snippet."""

    def run(batches):
        for b in batches:
            rows = [(q, i, h.get("url"), h.get("title"), h.get("snippet")) for q in b["query"] for i, h in enumerate(provider(q), 1)]
            yield pd.DataFrame(rows, columns=["query", "rank", "url", "title", "snippet"])

    return queries.select("query").mapInPandas(run, "query string, rank int, url string, title string, snippet string")


def load_manifest(pointer: str) -> dict:
    """The manifest that ``current.json`` points to: inside its folder, with the stated hash, approved."""
    p = Path(pointer)
    at = json.loads(p.read_text())
    target = (p.parent / at["path"]).resolve()
    if p.parent.resolve() not in target.parents:
        raise ValueError("manifest pointer leaves its folder")
    data = target.read_bytes()
    if hashlib.sha256(data).hexdigest() != at["sha256"]:
        raise ValueError("manifest hash differs")
    manifest = json.loads(data)
    if not manifest.get("approved"):
        raise ValueError("manifest is not approved")
    return manifest
