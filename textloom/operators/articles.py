"""Articles: sentences, relevance, scores, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: id, pos (from 0), sentence."""
    return docs.select(id_col, F.posexplode(T.paragraph_sentences(F.col(text_col))).alias("pos", "sentence"))


def relevance(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``reason``: why a sentence is left out, null if it stays. A repeat counts only against sentences that passed the other tests."""
    first = rows.withColumn("reason", T.boilerplate_reason(F.col("sentence")))
    same = Window.partitionBy(id_col, T.casefold(T.collapse(F.col("sentence"))), F.col("reason").isNull()).orderBy("pos")
    return first.withColumn("nth", F.row_number().over(same)).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("nth") > 1), "duplicate").otherwise(F.col("reason"))).drop("nth")


def semantic_relevance(rows: DataFrame, anchors: DataFrame, vector_col: str, on: str, threshold: float = 0.18) -> DataFrame:
    """Drops UI-like sentences far from their article's anchor vector; rows without a vector or an anchor stay. ``anchors``: (on, anchor)."""
    near = S.cosine(F.col(vector_col), F.col("anchor"))
    joined = rows.join(anchors, on, "left").withColumn("similarity", F.when(F.col("anchor").isNotNull() & F.col(vector_col).isNotNull(), near))
    return joined.where(T.is_prose(F.col("sentence")) | F.col("similarity").isNull() | (F.col("similarity") >= threshold)).drop("anchor")


def article_score(rows: DataFrame, keys: list[str], signal_col: str = "signal") -> DataFrame:
    """Score 0 to 100 per key: half the mean, half the mean of the strongest 15 % (one at least)."""
    by = Window.partitionBy(*keys).orderBy(F.col(signal_col).desc())
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = rows.withColumn("rank", F.row_number().over(by)).withColumn("peaks", F.greatest(F.lit(1), S.round_even(n * F.lit(S.PEAK_FRACTION)).cast("int")))
    mean, peak = F.avg(signal_col), F.avg(F.when(F.col("rank") <= F.col("peaks"), F.col(signal_col)))
    return ranked.groupBy(*keys).agg(S.round_even(S.clamp((mean * S.COVERAGE_WEIGHT + peak * S.PEAK_WEIGHT) * 100, 0.0, 100.0), 1).alias("score"), F.count("*").alias("n"))


def article_levels(docs: DataFrame) -> DataFrame:
    """The flagship: sentences, relevance, surrogate scores, article score and level."""
    rows = relevance(sentences(docs))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("sentence_count"), F.count_if(F.col("reason").isNull()).alias("kept_count"))
    kept = rows.where("reason is null").withColumn("signal", S.signal(S.surrogate_probability(F.col("sentence")), S.surrogate_probability(F.concat(F.lit("o:"), F.col("sentence")))))
    scored = article_score(kept, ["doc_id"]).drop("n")
    joined = docs.select("doc_id").join(counts, "doc_id", "left").join(scored, "doc_id", "left")
    score = F.coalesce("score", F.lit(0.0))
    return joined.select("doc_id", F.coalesce("sentence_count", F.lit(0)).alias("sentence_count"), F.coalesce("kept_count", F.lit(0)).alias("kept_count"), score.alias("score"), S.bucket(score).alias("level"))


def context_inputs(rows: DataFrame, k: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Adds ``before`` and ``after``: the k sentences on either side, joined by blanks."""
    w = Window.partitionBy(id_col).orderBy("pos")
    text = lambda a, b: F.concat_ws(" ", F.collect_list("sentence").over(w.rowsBetween(a, b)))
    return rows.withColumn("before", text(-k, -1)).withColumn("after", text(1, k))


def merged_windows(selected: DataFrame, lengths: DataFrame, k: int = 2, limit: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Windows of k sentences around selected ones, clipped to the article, merged where they touch; the first ``limit`` of each article (0: all)."""
    spans = selected.join(lengths, id_col).select(id_col, F.greatest(F.lit(0), F.col("pos") - k).alias("s"), F.least(F.col("n") - 1, F.col("pos") + k).alias("e"))
    w = Window.partitionBy(id_col).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # A window function can't nest in another, so the reach is a column first.
    marked = spans.withColumn("reach", reach).withColumn("new", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), 1).otherwise(0))
    grouped = marked.withColumn("window", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).groupBy(id_col, "window").agg(F.min("s").alias("start_pos"), F.max("e").alias("end_pos"), F.count("*").alias("n_selected"))
    return grouped if limit <= 0 else grouped.where(F.col("window") <= limit)


def first_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def mock_selection(rows: DataFrame) -> DataFrame:
    """The analyser without a model: every fourth sentence of over 30 characters; score by their share."""
    picked = (F.col("pos") % 4 == 1) & (F.char_length("sentence") > 30)
    n, s = F.count("*"), F.count_if(picked)
    return rows.groupBy("doc_id").agg(n.alias("sentence_count"), s.alias("selected_count"), S.round_even(F.least(F.lit(100.0), s / n * 220), 1).alias("score"))


def report_text(sentence_array: Column, limit: int = 12, width: int = 200) -> Column:
    """The fallback report: the first sentences, cut to a width."""
    return F.array_join(F.transform(F.slice(sentence_array, 1, limit), lambda s: F.substring(s, 1, width)), "\n")
