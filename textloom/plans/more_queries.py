"""Named queries, second part: windows, metrics, vectors, evidence, corpus, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import articles, corpus, dataprep, evidence, manifests, metrics, pages, selection
from ..operators.graph import written
from .queries import (
    Q_BUCKET, Q_DOT, Q_PROBABLE, Q_RELEVANCE, Q_SCORED, Q_SENTENCES, Q_SIGNAL, _q_url, _stamp, probable, q_collapse, q_cosine, q_cut, q_lit, q_prob, q_wilson, query, records, sentence_rows, table,
)
from .queries import Q_RECORDS, _Q_BUILT

# --- windows ---


@query("w01_positions", f"WITH {Q_SENTENCES} SELECT doc_id, max(pos) AS last, count(*) AS n FROM sents GROUP BY doc_id")
def _(spark, sf):
    return sentence_rows(spark, sf).groupBy("doc_id").agg(F.max("pos").alias("last"), F.count("*").alias("n"))


@query("w02_context_inputs", f"WITH {Q_SENTENCES} SELECT doc_id, pos, coalesce(string_agg(sentence, ' ') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(sentence, ' ') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def _(spark, sf):
    return articles.context_inputs(sentence_rows(spark, sf)).select("doc_id", "pos", "before", "after")


Q_SELECTED = f"WITH {Q_SENTENCES}, n AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id), spans AS (SELECT doc_id, pos, greatest(0, pos - 2) AS s, least(n - 1, pos + 2) AS e FROM sents JOIN n USING (doc_id) WHERE {q_prob('sentence')} >= 0.9), r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING)::int AS win FROM r)"


def _selected(spark, sf):
    rows = sentence_rows(spark, sf)
    return rows.where(S.surrogate_probability(F.col("sentence")) >= 0.9), rows.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("w03_context_windows", f"{Q_SELECTED} SELECT doc_id, win AS window, min(s)::bigint AS start_pos, max(e)::bigint AS end_pos, count(*) AS n_selected FROM g GROUP BY doc_id, win")
def _(spark, sf):
    out = articles.merged_windows(*_selected(spark, sf))
    return out.select("doc_id", "window", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"), "n_selected")


@query("l01_first_windows", f"{Q_SELECTED} SELECT doc_id, win AS window, min(s)::bigint AS start_pos FROM g WHERE win <= 2 GROUP BY doc_id, win")
def _(spark, sf):
    return articles.merged_windows(*_selected(spark, sf), limit=2).select("doc_id", "window", F.col("start_pos").cast("bigint").alias("start_pos"))


@query("w04_keep_first", f"WITH {Q_SENTENCES} SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower({q_collapse('sentence')}) ORDER BY pos) AS n FROM sents) WHERE n = 1")
def _(spark, sf):
    rows = sentence_rows(spark, sf).withColumn("k", F.lower(T.collapse(F.col("sentence"))))
    return articles.first_n(rows, ["doc_id", "k"], ["pos"], 1).select("doc_id", "pos")


Q_CHUNKS = f"""w AS (SELECT doc_id, list_filter(string_split({q_collapse('text')}, ' '), lambda x: x <> '') AS l FROM documents),
ch AS (SELECT doc_id, l, unnest(range(CASE WHEN len(l) = 0 THEN 0 WHEN len(l) <= 350 THEN 1 ELSE ceil((len(l) - 350) / 300.0)::bigint + 1 END)) AS i FROM w),
chunk AS (SELECT doc_id, i::int AS chunk_index, (i * 300)::int AS start_word, least(i * 300 + 350, len(l))::int AS end_word, array_to_string(l[i * 300 + 1 : i * 300 + 350], ' ') AS chunk FROM ch)"""


@query("w08_word_chunks", f"WITH {Q_CHUNKS} SELECT * FROM chunk")
def _(spark, sf):
    return corpus.chunks(table(spark, sf, "documents"), "text", ["doc_id"])


def corpus_points(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://www.example.com/d/"), F.col("doc_id")).alias("url"), "text", F.col("source").alias("source_id"), F.timestamp_add("DAY", (F.col("doc_id") % 60).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"), F.lit(30).alias("retention_days"))
    return corpus.points(d)


Q_POINTS = f"""{Q_CHUNKS}, pt AS (SELECT doc_id, 'doc_' || sha256('https://www.example.com/d/' || doc_id) AS document_id, chunk_index, start_word, end_word, sha256(chunk) AS chunk_hash, source AS source_id, sha256({q_collapse('text')}) AS content_hash,
 TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::int) + INTERVAL 30 DAY AS retention_until FROM chunk JOIN documents USING (doc_id)),
point AS (SELECT *, 'chunk_' || sha256(document_id || chr(0) || chunk_index || chr(0) || chunk_hash || chr(0) || 'word_window/v1') AS chunk_id FROM pt)"""


@query("w09_corpus_points", f"WITH {Q_POINTS} SELECT document_id, chunk_id, chunk_index, start_word, end_word, content_hash, 'example.com' AS source_domain, strftime(retention_until, '%Y-%m-%dT%H:%M:%SZ') AS retention_until FROM point")
def _(spark, sf):
    p = corpus_points(spark, sf)
    return p.select("document_id", "chunk_id", "chunk_index", "start_word", "end_word", "content_hash", "source_domain", F.date_format("retention_until", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retention_until"))


_Q_NAMESPACE = "".join(f"\\x{b:02X}" for b in corpus.POINT_NAMESPACE.bytes)
_Q_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::int & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("t19_point_ids", f"WITH {Q_POINTS} SELECT chunk_id, {_Q_UUID} AS point_id FROM (SELECT chunk_id, sha1('{_Q_NAMESPACE}'::blob || encode(chunk_id)) AS h FROM point)")
def _(spark, sf):
    return corpus_points(spark, sf).select("chunk_id", "point_id")


@query("j11_neighbours", f"WITH {Q_SENTENCES} SELECT a.doc_id, a.pos, count(b.pos) AS neighbours FROM sents a LEFT JOIN sents b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos GROUP BY ALL")
def _(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return sentence_rows(spark, sf).select("doc_id", "pos", (F.count("*").over(w.rowsBetween(-2, 2)) - 1).alias("neighbours"))


# --- metrics ---


@query("m03_batch_classification", f"{'WITH ' + Q_PROBABLE} SELECT doc_id, pos, round(1 / (1 + exp(-(ln((p + 0.00005) / (1 - p + 0.00005))) / 1.2)), 9) AS calibrated, CASE WHEN p >= 0.5 THEN 'Biased' ELSE 'Non-biased' END AS label FROM prob")
def _(spark, sf):
    p = F.col("p")
    logit = F.log((p + 0.00005) / (1 - p + 0.00005))
    return probable(spark, sf).select("doc_id", "pos", F.round(S.sigmoid(logit, 1.2), 9).alias("calibrated"), F.when(p >= 0.5, "Biased").otherwise("Non-biased").alias("label"))


@query("m02_scoring_head", f"SELECT vec_id, round(1 / (1 + exp(-({Q_DOT.format(a='embedding', b='list_transform(range(64), lambda i: (i % 5 - 2) / 4.0)')}))), 7) AS p FROM embeddings")
def _(spark, sf):
    weights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 5 - 2) / F.lit(4.0))
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.sigmoid(S.dot(F.col("embedding"), weights)), 7).alias("p"))


Q_PRED = f"{Q_PROBABLE}, pr AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM prob)"


def predicted(spark, sf):
    return probable(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


@query("a07_confusion", f"WITH {Q_PRED} SELECT t.i::int AS truth, q.i::int AS pred, count(pr.p) AS n FROM range(2) t(i) CROSS JOIN range(2) q(i) LEFT JOIN pr ON pr.truth = t.i AND pr.pred = q.i GROUP BY ALL")
def _(spark, sf):
    return metrics.confusion(predicted(spark, sf), [0, 1])


Q_CLASS = f"{Q_PRED}, cl AS (SELECT c.i::int AS label, count(*) FILTER (truth = c.i) AS support, count(*) FILTER (truth = c.i AND pred = c.i) AS tp, count(*) FILTER (truth <> c.i AND pred = c.i) AS fp, count(*) FILTER (truth = c.i AND pred <> c.i) AS fn FROM range(2) c(i), pr GROUP BY ALL), pc AS (SELECT label, support, coalesce(tp / nullif(tp + fp, 0)::double, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) AS f1 FROM cl)"


@query("a08_per_class", f"WITH {Q_CLASS} SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pc")
def _(spark, sf):
    c = metrics.per_class(metrics.confusion(predicted(spark, sf), [0, 1]))
    return c.select("label", "support", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query("a08_overall", f"WITH {Q_CLASS} SELECT round((SELECT avg((truth = pred)::int) FROM pr), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy FROM pc")
def _(spark, sf):
    o = metrics.overall(metrics.confusion(predicted(spark, sf), [0, 1]))
    return o.select(*[F.round(x, 9).alias(x) for x in ("accuracy", "macro_f1", "balanced_accuracy")])


@query("a09_decision", f"WITH {Q_PROBABLE}, a AS (SELECT count(*) FILTER (truth = 1 AND p >= 0.9) AS tp, count(*) FILTER (truth <> 1 AND p >= 0.9) AS fp, count(*) FILTER (truth = 1 AND p < 0.9) AS fn, count(*) AS n FROM prob) SELECT tp, fp, fn, round((tp + fp) / n::double, 9) AS coverage, round(tp / (tp + fp)::double, 9) AS precision, round(tp / (tp + fn)::double, 9) AS recall, round({q_wilson('tp', '(tp + fp)')}, 9) AS precision_lower, round({q_wilson('tp', '(tp + fn)')}, 9) AS recall_lower FROM a")
def _(spark, sf):
    d = metrics.decision(probable(spark, sf).withColumn("selected", F.col("p") >= 0.9))
    return d.select("tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("coverage", "precision", "recall", "precision_lower", "recall_lower")])


@query("a10_roc_auc", f"WITH {Q_PROBABLE}, r AS (SELECT truth, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM prob) SELECT round((sum(rk) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2.0) / (count(*) FILTER (truth = 1) * count(*) FILTER (truth = 0)), 9) AS roc_auc FROM r")
def _(spark, sf):
    return metrics.roc_auc(probable(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


Q_STEPS = "g AS (SELECT p, count(*) FILTER (truth = 1) AS pos, count(*) AS n FROM prob GROUP BY p), c AS (SELECT p, pos, n, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS allp FROM g)"


@query("a11_average_precision", f"WITH {Q_PROBABLE}, {Q_STEPS} SELECT round(sum(pos / allp::double * cp / cn::double), 9) AS average_precision FROM c")
def _(spark, sf):
    return metrics.average_precision(probable(spark, sf)).select(F.round("average_precision", 9).alias("average_precision"))


@query("w05_mean_rank", f"WITH {Q_PROBABLE} SELECT doc_id, pos, rank() OVER (PARTITION BY doc_id ORDER BY p) + (count(*) OVER (PARTITION BY doc_id, p) - 1) / 2.0 AS mean_rank FROM prob")
def _(spark, sf):
    peers = F.count("*").over(Window.partitionBy("doc_id", "p"))
    return probable(spark, sf).select("doc_id", "pos", (F.rank().over(Window.partitionBy("doc_id").orderBy("p")) + (peers - 1) / 2).alias("mean_rank"))


@query("w06_running_counts", f"WITH {Q_PROBABLE}, {Q_STEPS} SELECT p AS score, pos, cp::bigint AS cum_pos, (cn - cp)::bigint AS cum_neg FROM c")
def _(spark, sf):
    return metrics.by_score(probable(spark, sf), [], "p", F.col("truth") == 1).select("score", "pos", "cum_pos", "cum_neg")


def q_region(upper: bool) -> str:
    order, right = ("DESC", 1) if upper else ("ASC", 0)
    none = "no_positive_reference_examples" if upper else "no_negative_reference_examples"
    return f"""(WITH g AS (SELECT p, count(*) FILTER (truth = {right}) AS pos, count(*) AS n FROM prob GROUP BY p), c AS (SELECT p, sum(pos) OVER (ORDER BY p {order})::bigint AS cp, sum(n) OVER (ORDER BY p {order})::bigint AS cn FROM g),
l AS (SELECT *, {q_wilson('cp', 'cn')} AS lcb, (SELECT sum(n) FROM g) AS total, (SELECT sum(pos) FROM g) AS reference FROM c), w AS (SELECT *, target, cn >= 30 AND lcb >= target AS good FROM l, (VALUES (0.5), (0.55), (0.99)) t(target)),
b AS (SELECT target, bool_or(good) AS enabled, arg_max({{'p': p, 'cn': cn, 'cp': cp, 'lcb': lcb}}, cn) FILTER (good) AS best, max(total) AS total, max(reference) AS reference FROM w GROUP BY target),
tried AS (SELECT p, cn, cp, lcb FROM l ORDER BY lcb DESC, cn DESC, p {'ASC' if upper else 'DESC'} LIMIT 1)
SELECT {'true' if upper else 'false'} AS upper, b.target::double AS target, enabled, round(best.p, 9) AS threshold, CASE WHEN enabled THEN NULL WHEN b.total = 0 THEN 'no_supervised_calibration_examples' WHEN b.reference = 0 THEN '{none}' WHEN b.total < 30 THEN 'minimum_predicted_support_not_met' ELSE 'target_wilson_lcb_not_met' END AS reason,
CASE WHEN enabled THEN best.cn ELSE tried.cn END AS support, CASE WHEN enabled THEN best.cp ELSE tried.cp END AS correct, round(CASE WHEN enabled THEN best.lcb ELSE tried.lcb END, 9) AS lcb, round(tried.p, 9) AS best_threshold FROM b, tried)"""


@query("w07_confident_region", f"WITH {Q_PROBABLE} SELECT * FROM {q_region(True)} UNION ALL SELECT * FROM {q_region(False)}")
def _(spark, sf):
    """Both sides for three targets: one that is easy to reach, one near the base rate, one out of reach."""
    rows = written(probable(spark, sf).select("p", "truth"))
    out = None
    for upper in (True, False):
        for target in (0.5, 0.55, 0.99):
            r = metrics.confident_region(rows, upper=upper, target=target, min_support=30)
            r = r.select(F.lit(upper).alias("upper"), F.lit(target).alias("target"), "enabled", F.round("threshold", 9).alias("threshold"), "reason", "support", "correct", F.round("lcb", 9).alias("lcb"), F.round("best_threshold", 9).alias("best_threshold"))
            out = r if out is None else out.union(r)
    return out


@query("a13_state_coverage", f"WITH {Q_PROBABLE}, s AS (SELECT CASE WHEN p <= 0.2 THEN 'clear_non_bias' WHEN p >= 0.8 THEN 'clear_bias' ELSE 'possible_bias' END AS state FROM prob) SELECT position::int AS position, k AS state, count(s.state) AS n, round(count(s.state) / (SELECT count(*) FROM s)::double, 9) AS share FROM (VALUES (0, 'clear_non_bias'), (1, 'possible_bias'), (2, 'clear_bias'), (3, 'never')) v(position, k) LEFT JOIN s ON s.state = k GROUP BY ALL")
def _(spark, sf):
    rows = probable(spark, sf).withColumn("state", decide(F.col("p")))
    return metrics.state_coverage(rows, ["clear_non_bias", "possible_bias", "clear_bias", "never"], "state").withColumn("share", F.round("share", 9))


def decide(p, low=0.2, high=0.8):
    """Lower region first, then upper, else the middle."""
    return F.when(p <= low, "clear_non_bias").when(p >= high, "clear_bias").otherwise("possible_bias")


@query("d01_decisions", f"WITH {Q_PROBABLE} SELECT doc_id, pos, CASE WHEN p <= 0.2 THEN 'clear_non_bias' WHEN p >= 0.8 THEN 'clear_bias' ELSE 'possible_bias' END AS state, p >= 0.8 OR (p > 0.2 AND p_style >= 0.5) AS selected FROM prob")
def _(spark, sf):
    state = decide(F.col("p"))
    return probable(spark, sf).select("doc_id", "pos", state.alias("state"), ((state == "clear_bias") | ((state == "possible_bias") & (F.col("p_style") >= 0.5))).alias("selected"))


@query("f15_possible_inclusion", f"WITH {Q_PROBABLE} SELECT doc_id, pos FROM prob WHERE p > 0.2")
def _(spark, sf):
    return probable(spark, sf).where(decide(F.col("p")).isin("clear_bias", "possible_bias")).select("doc_id", "pos")


_LABELS = "CASE WHEN p >= 0.5 THEN 'Biased' ELSE 'Non-biased' END AS bl, CASE WHEN p_style >= 0.45 THEN 'tinted' ELSE 'Entirely factual' END AS ol"


@query("d02_threshold_gates", f"""WITH {Q_PROBABLE}, l AS (SELECT doc_id, pos, p, p_style, {_LABELS} FROM prob), g AS (SELECT *, bl = 'Biased' AND p >= 0.6 AS bias_ok, ol = 'tinted' AND 1 - (1 - p_style) >= 0.5 AS opinion_ok, greatest(p, 1 - (1 - p_style)) AS score FROM l),
f AS (SELECT *, CASE WHEN bl = 'Biased' AND NOT bias_ok THEN 'bias_below_threshold' END AS f1, CASE WHEN ol = 'tinted' AND NOT opinion_ok THEN 'opinion_below_threshold' END AS f2, CASE WHEN bl <> 'Biased' AND ol <> 'tinted' THEN 'no_positive_label' END AS f3 FROM g)
SELECT 'heads' AS mode, doc_id, pos, bias_ok OR opinion_ok AS selected, array_to_string(list_filter([CASE WHEN bias_ok THEN 'bias_threshold_met' END, CASE WHEN opinion_ok THEN 'opinion_threshold_met' END], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN bias_ok OR opinion_ok THEN '' ELSE array_to_string(list_filter([f1, f2, f3], lambda x: x IS NOT NULL), ',') END AS abstained FROM f
UNION ALL SELECT 'report', doc_id, pos, f3 IS NULL AND score >= 0.7, CASE WHEN f3 IS NULL AND score >= 0.7 THEN 'report_trigger_threshold_met' ELSE '' END, CASE WHEN f3 IS NULL AND score >= 0.7 THEN '' ELSE array_to_string(list_filter([f1, f2, f3, CASE WHEN f3 IS NULL THEN 'report_trigger_below_threshold' END], lambda x: x IS NOT NULL), ',') END FROM f
UNION ALL SELECT 'labels', doc_id, pos, f3 IS NULL, array_to_string(list_filter([CASE WHEN bl = 'Biased' THEN 'bias_argmax' END, CASE WHEN ol = 'tinted' THEN 'opinion_argmax' END], lambda x: x IS NOT NULL), ','), coalesce(f3, '') FROM f""")
def _(spark, sf):
    rows = probable(spark, sf).selectExpr("doc_id", "pos", "p", "p_style", *[x.strip() for x in _LABELS.split(", ")])
    labels = [F.col("bl"), F.col("ol")]
    scores, gates = [F.col("p"), 1 - F.col("p_style")], {"bias": selection.Gate(True, 0.6), "opinion": selection.Gate(True, 0.5)}
    modes = {"heads": selection.by_thresholds(*labels, *scores, **gates), "report": selection.by_thresholds(*labels, *scores, **gates, report=selection.Gate(True, 0.7)), "labels": selection.by_labels(*labels)}
    each = rows.select("doc_id", "pos", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), v["selected"].alias("selected"), F.array_join(v["reasons"], ",").alias("reasons"), F.array_join(v["abstained"], ",").alias("abstained")) for k, v in modes.items()])).alias("x"))
    return each.select("doc_id", "pos", "x.*")


@query("a06_abstention", f"WITH {Q_PROBABLE}, f AS (SELECT p >= 0.8 AS selected, unnest(list_filter([CASE WHEN p < 0.6 THEN 'below_bias_threshold' END, CASE WHEN p_style < 0.4 THEN 'below_style_threshold' END], lambda x: x IS NOT NULL)) AS reason FROM prob) SELECT selected, reason, count(*) AS n FROM f GROUP BY ALL")
def _(spark, sf):
    f = F.filter(F.array(F.when(F.col("p") < 0.6, "below_bias_threshold"), F.when(F.col("p_style") < 0.4, "below_style_threshold")), lambda x: x.isNotNull())
    return probable(spark, sf).select((F.col("p") >= 0.8).alias("selected"), F.explode(f).alias("reason")).groupBy("selected", "reason").agg(F.count("*").alias("n"))


@query("a17_reliability", f"WITH {Q_PROBABLE} SELECT b.i::int AS bin, count(p) AS n, round(coalesce(avg(p), 0), 9) AS mean_p, round(coalesce(avg(truth), 0), 9) AS frequency FROM range(10) b(i) LEFT JOIN prob ON least(floor(p * 10), 9) = b.i GROUP BY ALL")
def _(spark, sf):
    return metrics.reliability(probable(spark, sf)).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("frequency", 9).alias("frequency"))


@query("a17_ece_brier", f"WITH {Q_PROBABLE}, b AS (SELECT count(*) AS n, avg(p) AS m, avg(truth) AS f FROM prob GROUP BY least(floor(p * 10), 9)) SELECT round((SELECT sum(n * abs(m - f)) / sum(n) FROM b), 9) AS ece, round(avg((p - truth) * (p - truth)), 9) AS brier FROM prob")
def _(spark, sf):
    return metrics.calibration_error(probable(spark, sf)).select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"))


@query("a18_binary_loss", f"WITH {Q_PROBABLE} SELECT round(avg(ln(1 + exp(-abs(x))) + greatest(x, 0) - x * truth), 9) AS loss FROM (SELECT truth, (p - 0.5) * 8 / 1.3 AS x FROM prob)")
def _(spark, sf):
    return probable(spark, sf).agg(F.round(F.avg(S.binary_loss(F.col("truth"), (F.col("p") - 0.5) * 8, 1.3)), 9).alias("loss"))


@query("m04_temperature_grid", f"WITH {Q_PROBABLE}, t AS (SELECT (i + 1) / 10.0 AS t FROM range(1, 50) r(i)), l AS (SELECT t, round(avg(ln(1 + exp(-abs(x / t))) + greatest(x / t, 0) - x / t * truth), 9) AS loss FROM t, (SELECT truth, (p - 0.5) * 8 AS x FROM prob) GROUP BY t) SELECT round(arg_min(t, {{'l': loss, 't': t}}), 2) AS temperature FROM l")
def _(spark, sf):
    grid = [(i + 1) / 10.0 for i in range(1, 50)]
    x = (F.col("p") - 0.5) * 8
    losses = probable(spark, sf).agg(*[F.round(F.avg(S.binary_loss(F.col("truth"), x, t)), 9).alias(f"t{i}") for i, t in enumerate(grid)])  # one pass for the whole grid
    best = F.array_min(F.array(*[F.struct(F.col(f"t{i}").alias("l"), F.lit(t).alias("t")) for i, t in enumerate(grid)]))
    return losses.select(F.round(best["t"], 2).alias("temperature"))


@query("a15_article_rollup", f"WITH {Q_PROBABLE} SELECT doc_id, bool_or(truth = 1) AS gold, bool_or(p >= 0.8) AS selected FROM prob GROUP BY doc_id")
def _(spark, sf):
    return probable(spark, sf).groupBy("doc_id").agg(F.bool_or(F.col("truth") == 1).alias("gold"), F.bool_or(F.col("p") >= 0.8).alias("selected"))


Q_TIER = f"{Q_PROBABLE}, ti AS (SELECT (doc_id % 3)::int AS truth, CASE WHEN p < 0.5 THEN 0 WHEN p_style < 0.5 THEN 1 ELSE 2 END AS pred FROM prob)"


def tiers(spark, sf):
    return probable(spark, sf).select((F.col("doc_id") % 3).cast("int").alias("truth"), F.when(F.col("p") < 0.5, 0).when(F.col("p_style") < 0.5, 1).otherwise(2).alias("pred"), "p", "p_style")


@query("a16_middle_class", f"WITH {Q_TIER} SELECT count(*) FILTER (truth = 1) AS support, round(count(*) FILTER (truth = 1 AND pred = 1) / count(*) FILTER (truth = 1)::double, 9) AS recall, round({q_wilson('count(*) FILTER (truth = 1 AND pred = 1)', 'count(*) FILTER (truth = 1)')}, 9) AS recall_lower FROM ti")
def _(spark, sf):
    hit, n = F.count_if((F.col("truth") == 1) & (F.col("pred") == 1)), F.count_if(F.col("truth") == 1)
    return tiers(spark, sf).agg(n.alias("support"), hit.alias("hit")).select("support", F.round(S.ratio(F.col("hit"), F.col("support")), 9).alias("recall"), F.round(S.wilson_lower(F.col("hit"), F.col("support")), 9).alias("recall_lower"))


@query("a19_hierarchical", f"WITH {Q_TIER} SELECT t.i::int AS truth, q.i::int AS pred, count(ti.pred) AS n FROM range(3) t(i) CROSS JOIN range(3) q(i) LEFT JOIN ti ON ti.truth = t.i AND ti.pred = q.i GROUP BY ALL")
def _(spark, sf):
    return metrics.confusion(tiers(spark, sf), [0, 1, 2])


def q_bundle(truth: str, score: str) -> str:
    """The bundle of a head, from ``prob``."""
    z = f"(SELECT {truth} AS t, {score} AS s, ({score} >= 0.5)::int AS q FROM prob)"
    return f"""(WITH z AS {z}, c AS (SELECT k.i::int AS label, count(*) FILTER (t = k.i) AS support, count(*) FILTER (q = k.i) AS predicted_support, count(*) FILTER (t = k.i AND q = k.i) AS tp FROM z, range(2) k(i) GROUP BY ALL),
d AS (SELECT *, coalesce(tp / nullif(predicted_support, 0)::double, 0) AS precision, coalesce(tp / nullif(support, 0)::double, 0) AS recall, coalesce(2 * tp / nullif(support + predicted_support, 0)::double, 0) AS f1, {q_wilson('tp', 'predicted_support')} AS precision_lower, {q_wilson('tp', 'support')} AS recall_lower FROM c),
g AS (SELECT s, count(*) FILTER (t = 1) AS pos, count(*) FILTER (t = 0) AS neg FROM z GROUP BY s), r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn, sum(pos) OVER () AS allp, sum(neg) OVER () AS alln FROM g)
SELECT label, support, predicted_support, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(precision_lower, 9) AS precision_lower, round(recall_lower, 9) AS recall_lower, round((SELECT sum(tp) / sum(support)::double FROM d), 9) AS accuracy, round((SELECT avg(f1) FROM d), 9) AS macro_f1,
round((SELECT avg(recall) FILTER (support > 0) FROM d), 9) AS balanced_accuracy, round((SELECT sum(neg * (cp - pos) + pos * neg / 2.0) / (any_value(allp) * any_value(alln))::double FROM r), 9) AS roc_auc, round((SELECT sum(pos / allp::double * cp / (cp + cn)::double) FROM r), 9) AS average_precision FROM d)"""


_BUNDLE = ["precision", "recall", "f1", "precision_lower", "recall_lower", "accuracy", "macro_f1", "balanced_accuracy", "roc_auc", "average_precision"]


def bundle(rows, score, truth):
    b = metrics.binary_bundle(rows, score, truth)
    return b.select("label", "support", "predicted_support", "tp", *[F.round(x, 9).alias(x) for x in _BUNDLE])


@query("a12_binary_bundle", f"WITH {Q_PROBABLE} SELECT * FROM {q_bundle('truth', 'p')}")
def _(spark, sf):
    return bundle(probable(spark, sf), "p", "truth")


@query("a27_masked_mean", "SELECT round(sum(w * x) / sum(w), 9) AS mean FROM (SELECT CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN 0.7 ELSE 1.8 END AS w, n_chars::double AS x FROM documents LEFT JOIN labels USING (doc_id))")
def _(spark, sf):
    w = F.when(F.col("quality").isNull(), 0.0).when(F.col("quality") == 1, 0.7).otherwise(1.8)
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.agg(F.round(F.sum(w * F.col("n_chars")) / F.sum(w), 9).alias("mean"))


def q_bootstrap(rows: str, labels: int, name: str = "boot") -> str:
    """CTEs up to ``name``(resample, macro_f1) from ``rows``(doc_id, truth, pred)."""
    cells = [f"{k}{x}" for x in range(labels) for k in ("tp", "fp", "fn")]
    counts = ", ".join(f"count(*) FILTER (truth = {x} AND pred = {x}) AS tp{x}, count(*) FILTER (truth <> {x} AND pred = {x}) AS fp{x}, count(*) FILTER (truth = {x} AND pred <> {x}) AS fn{x}" for x in range(labels))
    k = " + ".join(f"(u >= {edge})::int" for edge in metrics.POISSON)
    f1 = " + ".join(f"coalesce(2.0 * tp{x} / nullif(2 * tp{x} + fp{x} + fn{x}, 0), 0)" for x in range(labels))
    return f"""{name}_g AS (SELECT doc_id, {counts} FROM {rows} GROUP BY doc_id), {name}_h AS (SELECT g.*, b.i AS block, sha256('42:' || b.i || ':' || doc_id) AS hash FROM {name}_g g, range({metrics.RESAMPLES // 16}) b(i)),
{name}_u AS (SELECT h.*, block * 16 + s.i AS resample, ('0x' || substr(hash, (4 * s.i + 1)::int, 4))::int AS u FROM {name}_h h, range(16) s(i)), {name}_s AS (SELECT resample, {", ".join(f"sum(({k}) * {c}) AS {c}" for c in cells)} FROM {name}_u GROUP BY resample),
{name} AS (SELECT resample, ({f1}) / {labels}.0 AS macro_f1 FROM {name}_s)"""


Q_BOUND = "coalesce((SELECT list_sort(list(macro_f1))[101] FROM boot), 0)"


@query("a14_group_bootstrap", f"WITH {Q_PRED}, {q_bootstrap('pr', 2)} SELECT resample, round(macro_f1, 9) AS macro_f1, round({Q_BOUND}, 9) AS lower_bound FROM boot")
def _(spark, sf):
    table = written(metrics.bootstrap_table(predicted(spark, sf), "doc_id", [0, 1]))
    return table.crossJoin(metrics.bootstrap_bound(table)).select(F.col("resample").cast("bigint").alias("resample"), F.round("macro_f1", 9).alias("macro_f1"), F.round("lower_bound", 9).alias("lower_bound"))  # one row


_MEASURED = ["clear_precision", "objective_recall", "opinionated_recall", "macro_f1_bound"]


@query("d04_release_gates", f"""WITH {Q_PROBABLE}, st AS (SELECT doc_id, toxic AS truth, (p_style >= 0.5)::int AS pred FROM prob), {q_bootstrap('st', 2)},
m AS (SELECT (SELECT count(*) FILTER (p >= 0.8) FROM prob) AS clear_selected, (SELECT {q_wilson('count(*) FILTER (p >= 0.8 AND truth = 1)', 'count(*) FILTER (p >= 0.8)')} FROM prob) AS clear_precision, (SELECT count(*) FILTER (truth = 0) FROM st) AS objective_support, (SELECT count(*) FILTER (truth = 1) FROM st) AS opinionated_support,
(SELECT {q_wilson('count(*) FILTER (truth = 0 AND pred = 0)', 'count(*) FILTER (truth = 0)')} FROM st) AS objective_recall, (SELECT {q_wilson('count(*) FILTER (truth = 1 AND pred = 1)', 'count(*) FILTER (truth = 1)')} FROM st) AS opinionated_recall, {Q_BOUND} AS macro_f1_bound),
f AS (SELECT *, list_filter([CASE WHEN clear_selected < 30 THEN 'insufficient_clear_bias_selected_support' END, CASE WHEN objective_support < 30 THEN 'insufficient_objective_style_support' END, CASE WHEN opinionated_support < 30 THEN 'insufficient_opinionated_style_support' END, CASE WHEN clear_precision < 0.9 THEN 'clear_bias_precision_lcb_below_target' END,
CASE WHEN macro_f1_bound < 0.65 THEN 'opinion_style_macro_f1_bootstrap_lcb_below_target' END, CASE WHEN objective_recall < 0.5 THEN 'objective_style_recall_lcb_below_target' END, CASE WHEN opinionated_recall < 0.5 THEN 'opinionated_style_recall_lcb_below_target' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT clear_selected, objective_support, opinionated_support, {", ".join(f"round({x}, 9) AS {x}" for x in _MEASURED)}, array_to_string(failed, ',') AS failures, CASE WHEN len(failed) = 0 THEN 'eligible' ELSE 'rejected' END AS promotion_state FROM f""")
def _(spark, sf):
    rows = written(probable(spark, sf).select("doc_id", "p", "p_style", "truth", "toxic"))
    bias = rows.select("truth", (decide(F.col("p")) == "clear_bias").alias("selected"))
    style = rows.select("doc_id", F.col("toxic").alias("truth"), (F.col("p_style") >= 0.5).cast("int").alias("pred"))
    out = metrics.binary_gates(bias, style, "doc_id")
    return out.select("clear_selected", "objective_support", "opinionated_support", *[F.round(x, 9).alias(x) for x in _MEASURED], F.array_join("failures", ",").alias("failures"), "promotion_state")


@query("a25_article_score", f"WITH {Q_SCORED} SELECT doc_id, score FROM scored")
def _(spark, sf):
    kept = articles.relevance(sentence_rows(spark, sf)).where("reason is null")
    kept = kept.withColumn("signal", S.signal(S.surrogate_probability(F.col("sentence")), S.surrogate_probability(F.concat(F.lit("o:"), F.col("sentence")))))
    return articles.article_score(kept, ["doc_id"]).select("doc_id", "score")


@query("d10_mock_analysis", f"WITH {Q_SENTENCES} SELECT doc_id, count(*) AS sentence_count, count(*) FILTER (pos % 4 = 1 AND length(sentence) > 30) AS selected_count, round_even(least(100.0, count(*) FILTER (pos % 4 = 1 AND length(sentence) > 30) / count(*)::double * 220), 1) AS score FROM sents GROUP BY doc_id")
def _(spark, sf):
    return articles.mock_selection(sentence_rows(spark, sf))


# --- retrieval evaluation and vectors ---

Q_NEAR = f"near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({q_cosine('v.embedding', 'q.embedding')}, 9) AS score, q.label = v.label AS relevant FROM embeddings q JOIN embeddings v ON q.vec_id % 25 = 0 AND q.vec_id <> v.vec_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near)"


def neighbours(spark, sf, k):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = corpus.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k + 1).where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy(F.col("rank"))
    hits = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    label = e.select("vec_id", "label")
    return hits.join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("hit")), "id").join(label.select(F.col("vec_id").alias("query_id"), "label"), "query_id").withColumn("relevant", F.col("hit") == F.col("label"))


@query("j09_vector_topk", f"WITH {Q_NEAR} SELECT query_id, rank::int AS rank, id FROM ranked WHERE rank <= 5")
def _(spark, sf):
    return neighbours(spark, sf, 5).select("query_id", "rank", "id")


@query("j09_best_chunk", f"SELECT doc, claim_id, arg_max(idx, {{'s': s, 'i': -idx}}) AS idx, max(s) AS score FROM (SELECT a.label AS doc, a.vec_id AS claim_id, b.vec_id AS idx, round({q_cosine('a.embedding', 'b.embedding')}, 9) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id) GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    claims = e.where("vec_id % 20 = 0").select(F.col("label").alias("doc"), F.col("vec_id").alias("claim_id"), F.col("embedding").alias("cv"))
    return evidence.best_chunk(claims, e.select(F.col("label").alias("doc"), F.col("vec_id").alias("idx"), F.col("embedding").alias("v")), apart=True)


@query("a21_recall", f"WITH {Q_NEAR}, f AS (SELECT query_id, min(rank) FILTER (relevant) AS first FROM ranked WHERE rank <= 10 GROUP BY query_id) SELECT " + ", ".join(f"round(avg(coalesce((first <= {k})::int, 0)), 9) AS recall_at_{k}" for k in (1, 3, 5, 10)) + " FROM f")
def _(spark, sf):
    hits = neighbours(spark, sf, 10).withColumnRenamed("query_id", "case_id")
    cases = table(spark, sf, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("case_id"), F.lit(True).alias("answerable"))
    r = metrics.recall_at(cases, hits)
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query("a22_irrelevant_rate", f"WITH {Q_NEAR}, j AS (SELECT CASE WHEN id % 3 = 0 THEN NULL WHEN relevant THEN 'relevant' ELSE 'irrelevant' END AS judgment FROM ranked WHERE rank <= 5) SELECT count(judgment) AS judged, count(*) FILTER (judgment IS NULL) AS unjudged, round(count(*) FILTER (judgment = 'irrelevant') / count(judgment)::double, 9) AS irrelevant_rate FROM j")
def _(spark, sf):
    hits = neighbours(spark, sf, 10).withColumn("judgment", F.when(F.col("id") % 3 != 0, F.when(F.col("relevant"), "relevant").otherwise("irrelevant")))
    return metrics.irrelevant_rate(hits).withColumn("irrelevant_rate", F.round("irrelevant_rate", 9))


@query("a23_scenario_coverage", f"WITH {Q_NEAR}, h AS (SELECT DISTINCT query_id FROM ranked WHERE rank <= 10 AND relevant), s AS (SELECT vec_id % 4 AS scenario_id, avg((vec_id IN (SELECT query_id FROM h))::int) AS c FROM embeddings WHERE vec_id % 25 = 0 GROUP BY 1) SELECT round(avg(c), 9) AS coverage FROM s")
def _(spark, sf):
    scenarios = table(spark, sf, "embeddings").where("vec_id % 25 = 0").groupBy((F.col("vec_id") % 4).alias("scenario_id")).agg(F.collect_list("vec_id").alias("claim_ids"))
    return metrics.scenario_coverage(scenarios, neighbours(spark, sf, 10).withColumnRenamed("query_id", "case_id")).select(F.round("coverage", 9).alias("coverage"))


@query("a24_latencies", "SELECT event_type, round(max(value) FILTER (n = 1), 9) AS cold, round(quantile_cont(value, 0.5) FILTER (n > 1), 9) AS warm_p50, round(quantile_cont(value, 0.95) FILTER (n > 1), 9) AS warm_p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) GROUP BY event_type")
def _(spark, sf):
    return metrics.latencies(table(spark, sf, "events"), "event_id", "value", "event_type").select("event_type", *[F.round(c, 9).alias(c) for c in ("cold", "warm_p50", "warm_p95")])


@query("d06_retrieval_gates", f"WITH {Q_NEAR}, f AS (SELECT query_id, min(rank) FILTER (relevant) AS first FROM ranked GROUP BY query_id) SELECT avg((first <= 5)::int) >= 0.8 AS recall_ok, CASE WHEN avg((first <= 5)::int) >= 0.8 THEN 'dense' ELSE 'dense_reranked' END AS mode FROM f")
def _(spark, sf):
    hits = neighbours(spark, sf, 5).withColumnRenamed("query_id", "case_id")
    cases = table(spark, sf, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("case_id"), F.lit(True).alias("answerable"))
    r = metrics.recall_at(cases, hits, [5])
    return r.select((F.col("recall_at_5") >= 0.8).alias("recall_ok"), F.when(F.col("recall_at_5") >= 0.8, "dense").otherwise("dense_reranked").alias("mode"))


@query("l02_topk_ties", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def _(spark, sf):
    return articles.first_n(table(spark, sf, "documents"), ["source"], [F.col("n_chars").desc(), "doc_id"], 3).select("source", "doc_id")


@query("l03_rerank", f"WITH {Q_NEAR} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {q_prob(chr(39) + 'r:' + chr(39) + ' || query_id || ' + chr(39) + ':' + chr(39) + ' || id')} DESC, rank)::int AS position FROM ranked WHERE rank <= 20")
def _(spark, sf):
    """A reranker is an injected scorer of (query, hit); here the surrogate."""
    hits = neighbours(spark, sf, 20).withColumn("s", S.surrogate_probability(F.concat(F.lit("r:"), F.col("query_id"), F.lit(":"), F.col("id"))))
    return hits.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "rank")).alias("position"))


@query("l04_keep_newest", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2 AS keep FROM events")
def _(spark, sf):
    return corpus.keep_newest(table(spark, sf, "events"), ["user_id"], "event_id", 2).select("event_id", "keep")


@query("l05_lexicographic_best", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, -n_chars, doc_id) AS n FROM documents) WHERE n = 1")
def _(spark, sf):
    best = F.min(F.struct("lang", -F.col("n_chars"), "doc_id"))
    return table(spark, sf, "documents").groupBy("source").agg(best.alias("b")).select("source", "b.doc_id")


@query("l06_ordered_output", "SELECT doc_id, source FROM documents ORDER BY doc_id")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").orderBy("doc_id")


@query("w11_largest_first", "SELECT source, n, row_number() OVER (ORDER BY n DESC, sha256('42:' || source))::int AS position FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def _(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.col("n").desc(), T.seeded_hash(42, F.col("source")))))  # one row a unit


# --- evidence ---


def evidence_items(spark, sf):
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    return p.select(
        (i % 10).alias("scope"), F.concat(F.lit("i"), F.lpad(i.cast("string"), 9, "0")).alias("item_id"), (i % 3 % 2).cast("int").alias("provider_order"), i.cast("int").alias("rank"), F.concat(F.lit("https://example.com/"), F.when(i % 7 == 0, i % 20).otherwise(i)).alias("url"),
        F.lit("t").alias("title"), F.lit("s").alias("snippet"), F.when(i % 11 == 0, F.concat(F.lit("d"), i % 22)).alias("document_id"), F.lit(None).cast("string").alias("content_hash"),
        F.when(i % 2 == 0, "corpus_chunk").otherwise("search_snippet").alias("material_kind"), F.array(F.concat(F.lit("c"), i % 4)).alias("claim_ids"),
    )


@query("w10_rank_fusion")
def _(spark, sf):
    return evidence.fuse(evidence_items(spark, sf), "scope", 5).withColumn("claim_ids", F.array_join("claim_ids", ","))


@query("g03_identity_keys", "SELECT page_id, 'url:https://example.com/' || page_id AS keys FROM pages WHERE page_id % 11 <> 0 UNION ALL SELECT page_id, 'document:d' || (page_id % 22) || ',url:https://example.com/' || page_id FROM pages WHERE page_id % 11 = 0")
def _(spark, sf):
    i = F.col("page_id")
    keys = evidence.identity_keys(F.concat(F.lit("https://example.com/"), i, F.lit("?utm_medium=a")), F.when(i % 11 == 0, F.concat(F.lit("d"), i % 22)), F.lit(None).cast("string"), F.lit("t"), F.lit("s"))
    return table(spark, sf, "pages").select("page_id", F.array_join(keys, ",").alias("keys"))


Q_CITE = """i AS (SELECT page_id % 10 AS scope, page_id AS pos, 'https://example.com/' || (page_id % 40) AS url, 'title ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'corpus_chunk' ELSE 'search_snippet' END AS kind, 'c' || (page_id % 4) AS claim FROM pages),
g AS (SELECT scope, url, min(pos) AS first, arg_min(title, {'k': (kind <> 'corpus_chunk')::int, 'p': pos}) AS title, arg_min(kind, {'k': (kind <> 'corpus_chunk')::int, 'p': pos}) AS material_kind, list(claim ORDER BY pos) AS claims FROM i GROUP BY scope, url),
cite AS (SELECT scope, 'E' || row_number() OVER (PARTITION BY scope ORDER BY first) AS citation_id, url, title, material_kind, claims, material_kind = 'corpus_chunk' AS eligible FROM g)"""


def citations(spark, sf):
    i = F.col("page_id")
    items = table(spark, sf, "pages").select((i % 10).alias("scope"), i.alias("pos"), F.concat(F.lit("https://example.com/"), i % 40).alias("url"), F.concat(F.lit("title "), i).alias("title"), F.when(i % 2 == 0, "corpus_chunk").otherwise("search_snippet").alias("material_kind"), F.array(F.concat(F.lit("c"), i % 4)).alias("claim_ids"))
    return evidence.cite(items, "scope")


@query("w12_citations", f"WITH {Q_CITE} SELECT scope, citation_id, url, title, material_kind, eligible, array_to_string(list_distinct_ordered, ',') AS claims FROM (SELECT *, list_filter(claims, lambda c, i: list_position(claims, c) = i) AS list_distinct_ordered FROM cite)")
def _(spark, sf):
    return citations(spark, sf).select("scope", "citation_id", "url", "title", "material_kind", "eligible", F.array_join("claim_ids", ",").alias("claims"))


@query("j07_claim_citations", f"WITH {Q_CITE}, e AS (SELECT DISTINCT scope, citation_id, unnest(claims) AS claim_id FROM cite WHERE eligible) SELECT scope, claim_id, count(*) AS n FROM e GROUP BY ALL")
def _(spark, sf):
    return citations(spark, sf).where("eligible").select("scope", F.explode("claim_ids").alias("claim_id")).groupBy("scope", "claim_id").agg(F.count("*").alias("n"))


@query("d08_claim_assessment", f"""WITH {Q_CITE}, e AS (SELECT DISTINCT scope, citation_id, unnest(claims) AS claim_id FROM cite WHERE eligible), u AS (SELECT scope, claim_id, list_sort(list(citation_id)) AS allowed FROM e GROUP BY ALL),
c AS (SELECT s.i AS scope, 'c' || k.i AS claim_id, CASE s.i WHEN 3 THEN 'not_requested' WHEN 4 THEN 'error' ELSE 'found' END AS st, ['supported', 'contradicted', 'insufficient_evidence', 'nonsense'][k.i + 1] AS said FROM range(10) s(i), range(5) k(i)),
j AS (SELECT c.*, coalesce(allowed, []) AS allowed, list_filter(['E1', 'E2'], lambda x: list_contains(coalesce(allowed, []), x)) AS cited FROM c LEFT JOIN u USING (scope, claim_id)),
r AS (SELECT *, CASE WHEN st = 'not_requested' THEN 'not_assessed' WHEN st = 'error' AND len(allowed) = 0 THEN 'not_assessed' WHEN len(allowed) = 0 THEN 'insufficient_evidence' WHEN said IS NULL OR said = 'nonsense' THEN 'not_assessed' WHEN said IN ('supported', 'contradicted') AND len(cited) = 0 THEN 'insufficient_evidence' ELSE said END AS status FROM j)
SELECT scope, claim_id, status, CASE WHEN status IN ('supported', 'contradicted') THEN array_to_string(cited, ',') ELSE '' END AS citations FROM r""")
def _(spark, sf):
    claims = spark.range(10).select(F.col("id").alias("scope"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("scope", F.concat(F.lit("c"), F.col("k")).alias("claim_id"), F.when(F.col("scope") == 3, "not_requested").when(F.col("scope") == 4, "error").otherwise("found").alias("retrieval_status"))
    answers = spark.createDataFrame([(f"c{i}", s, ["E1", " E2 ", "E1"]) for i, s in enumerate(["supported", "Contradicted ", "insufficient_evidence", "nonsense"])], "claim_id string, evidence_status string, citation_ids array<string>")
    return evidence.assess(claims, citations(spark, sf), answers, "scope").withColumn("citations", F.array_join("citation_ids", ",")).drop("citation_ids")


@query("a28_sentence_status", "SELECT doc_id % 50 AS s, CASE WHEN bool_or(doc_id % 4 = 3) THEN 'not_assessed' WHEN count(DISTINCT doc_id % 4) = 1 THEN ['supported', 'contradicted', 'insufficient_evidence'][min(doc_id % 4) + 1] ELSE 'insufficient_evidence' END AS status FROM documents GROUP BY 1")
def _(spark, sf):
    status = F.element_at(F.array(F.lit("supported"), F.lit("contradicted"), F.lit("insufficient_evidence"), F.lit("not_assessed")), (F.col("doc_id") % 4 + 1).cast("int"))
    return evidence.sentence_status(table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("s"), status.alias("status")), ["s"])


@query("d07_retrieval_status", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 2 > 0 THEN 'partial' WHEN doc_id % 3 > 0 THEN 'found' WHEN doc_id % 2 > 0 THEN 'error' ELSE 'none_found' END AS status FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", evidence.retrieval_status(F.col("doc_id") % 3, F.col("doc_id") % 2).alias("status"))


@query("t47_failure_codes", "SELECT doc_id, ['timeout', 'network_error', 'provider_failure'][(doc_id % 3) + 1] AS code FROM documents")
def _(spark, sf):
    raw = F.element_at(F.array(F.lit("Deadline exceeded"), F.lit("DNS failure"), F.lit("HTTP 500")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", evidence.failure_code(raw).alias("code"))


@query("d09_verdicts", "SELECT doc_id, ['verified', 'disputed', 'unverified'][(doc_id % 3) + 1] AS verdict FROM documents")
def _(spark, sf):
    status = F.element_at(F.array(F.lit("supported"), F.lit("contradicted"), F.lit("insufficient_evidence")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", evidence.verdict(status).alias("verdict"))


@query("o01_union_all", "SELECT item_id AS id FROM benchmark UNION ALL SELECT doc_id FROM labels")
def _(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id")).unionByName(table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


# --- corpus ---


@query("a20_corpus_statistics", f"WITH {Q_POINTS}, d AS (SELECT document_id, count(*) AS c, any_value(content_hash) AS h, min(retention_until) AS u FROM point GROUP BY 1) SELECT count(*) AS documents, sum(c)::bigint AS chunks, count(*) FILTER (u <= TIMESTAMP '2024-02-15') AS expired, count(*) FILTER (u > TIMESTAMP '2024-02-15' AND u <= TIMESTAMP '2024-03-16') AS due, (SELECT count(*) FROM (SELECT h FROM d GROUP BY h HAVING count(*) > 1)) AS duplicate_contents, (sum(c) * 1536)::bigint AS vector_bytes FROM d")
def _(spark, sf):
    return corpus.statistics(corpus_points(spark, sf), _stamp("2024-02-15"))


@query("a20_by_source", f"WITH {Q_POINTS} SELECT source_id, count(DISTINCT document_id) AS documents, count(*) AS chunks, count(DISTINCT content_hash) AS contents FROM point GROUP BY source_id")
def _(spark, sf):
    return corpus.source_statistics(corpus_points(spark, sf))


@query("j04_manifest_diff", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'unchanged' END AS change FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    new = d.where("doc_id % 10 <> 0").withColumn("lang", F.when(F.col("doc_id") % 10 == 2, F.concat("lang", F.lit("!"))).otherwise(F.col("lang")))
    return corpus.manifest_diff(d.where("doc_id % 10 <> 1"), new, "doc_id", ["source", "lang"])


@query("j05_reconcile", f"WITH {Q_POINTS}, p AS (SELECT document_id, count(*) AS points FROM point WHERE doc_id % 10 <> 0 GROUP BY 1), m AS (SELECT document_id, any_value(doc_id) AS doc_id, count(*) + (any_value(doc_id) % 10 = 2)::int AS expected_points FROM point WHERE doc_id % 10 <> 1 GROUP BY 1) SELECT document_id, CASE WHEN points IS NULL THEN 'missing' WHEN expected_points IS NULL THEN 'unexpected' ELSE 'point_count_mismatch' END AS problem, coalesce(expected_points, 0) AS expected_points, coalesce(points, 0) AS points FROM m FULL JOIN p USING (document_id) WHERE points IS DISTINCT FROM expected_points")
def _(spark, sf):
    p = corpus_points(spark, sf)
    m = p.where("doc_id % 10 <> 1").groupBy("document_id").agg((F.count("*") + F.first((F.col("doc_id") % 10 == 2).cast("int"))).alias("expected_points"))
    return corpus.reconcile(m, p.where("doc_id % 10 <> 0"))


def versions(spark, sf):
    """All documents twice: as they are, and with every fifth changed and every third under a new id."""
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    old = d.select(F.concat(F.lit("a"), n).alias("point_id"), n.alias("document_id"), T.content_hash(text).alias("content_hash"))
    changed = (n % 5 == 0) | (n % 3 == 0)
    new = d.select(F.concat(F.lit("b"), n).alias("point_id"), (n + F.when(n % 3 == 0, 10**9).otherwise(0)).alias("document_id"), T.content_hash(F.concat(text, F.when(changed, F.concat(F.lit("b"), n)).otherwise(""))).alias("content_hash"))
    return old, new


_Q_CHANGED = "coalesce(text, '') || CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'b' || doc_id ELSE '' END"
_Q_TEXT = "coalesce(text, '')"
Q_VERSIONS = f"a AS (SELECT 'a' || doc_id AS point_id, doc_id AS document_id, sha256({q_collapse(_Q_TEXT)}) AS content_hash FROM documents), b AS (SELECT 'b' || doc_id AS point_id, doc_id + CASE WHEN doc_id % 3 = 0 THEN 1000000000 ELSE 0 END AS document_id, sha256({q_collapse(_Q_CHANGED)}) AS content_hash FROM documents), fresh AS (SELECT * FROM b WHERE content_hash NOT IN (SELECT content_hash FROM a))"


@query("s17_upsert", f"WITH {Q_VERSIONS} SELECT point_id FROM a WHERE document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT point_id FROM fresh")
def _(spark, sf):
    return corpus.upsert(*versions(spark, sf)).select("point_id")


@query("s17_upsert_status", f"WITH {Q_VERSIONS} SELECT document_id, CASE WHEN content_hash IN (SELECT content_hash FROM a) THEN 'duplicate' WHEN document_id IN (SELECT document_id FROM a) THEN 'replaced' ELSE 'ingested' END AS status FROM b")
def _(spark, sf):
    return corpus.upsert_status(*versions(spark, sf)).select("document_id", "status")


_Q_ADDRESS = "coalesce(text, '') || CASE WHEN doc_id % 4 = 1 THEN '!' || doc_id ELSE '' END"


@query("s16_staging_plan", f"SELECT content_hash, CASE WHEN lo <> hi OR (held IS NOT NULL AND held <> lo) THEN 'collision' WHEN held IS NULL THEN 'write' ELSE 'same' END AS action FROM (SELECT sha256({q_collapse(_Q_ADDRESS)}) AS content_hash, min(sha256({_Q_TEXT})) AS lo, max(sha256({_Q_TEXT})) AS hi FROM documents GROUP BY 1) LEFT JOIN (SELECT sha256({q_collapse(_Q_TEXT)}) AS content_hash, min(sha256({_Q_TEXT} || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE '' END)) AS held FROM documents GROUP BY 1) USING (content_hash)")
def _(spark, sf):
    """All texts to stage against all texts staged: every fourth has a new address, every seventh other bytes."""
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    new = d.select(T.content_hash(F.concat(text, F.when(n % 4 == 1, F.concat(F.lit("!"), n)).otherwise(""))).alias("content_hash"), F.sha2(text, 256).alias("archive_hash"))
    staged = d.select(T.content_hash(text).alias("content_hash"), F.sha2(F.concat(text, F.when(n % 7 == 0, "?").otherwise("")), 256).alias("archive_hash"))
    return corpus.staging_plan(new, staged)


@query("d11_expiry_plan", "SELECT event_id, ts + INTERVAL 30 DAY <= TIMESTAMP '2024-02-10' AS expire FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("interval 30 days") <= F.lit(_stamp("2024-02-10"))).alias("expire"))


@query("v01_canonical_rules", f"WITH {Q_RECORDS} SELECT record_id, unnest(list_filter([CASE WHEN bias_label IS NULL THEN 'bias label missing' END, CASE WHEN length(text) < 100 THEN 'text too short' END, CASE WHEN canonical_url IS NULL THEN 'url missing' END], lambda x: x IS NOT NULL)) AS rule FROM recs")
def _(spark, sf):
    return corpus.violations(records(spark, sf), "record_id", {"bias label missing": F.col("bias_label").isNotNull(), "text too short": F.char_length("text") >= 100, "url missing": F.col("canonical_url").isNotNull()})


@query("v01_unique", "SELECT 'source' AS column, source AS value, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def _(spark, sf):
    return corpus.unique_violations(table(spark, sf, "documents"), ["doc_id", "source"])


@query("v02_partition_keys", "SELECT source, count(DISTINCT doc_id % 3) AS partitions FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 3) > 1")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("partition", F.col("doc_id") % 3)
    return d.groupBy("source").agg(F.countDistinct("partition").alias("partitions")).where("partitions > 1")


@query("v03_manifest_rules", f"""SELECT page_id, unnest(list_filter([CASE WHEN canonical IS NULL THEN 'canonical_url must be canonical HTTPS' END, CASE WHEN page_id > min(page_id) OVER (PARTITION BY canonical) AND canonical IS NOT NULL THEN 'canonical_url is duplicated' END,
CASE WHEN page_id % 7 = 3 THEN 'status is unsupported' END, CASE WHEN page_id % 5 = 0 THEN 'fetched_at must be ISO-8601 or null' END, CASE WHEN page_id % 5 = 0 AND page_id % 7 < 2 THEN 'fetched_at is required when approved' END, CASE WHEN page_id % 7 < 2 AND page_id % 4 = 1 THEN 'rights_review.status must be approved' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT page_id, CASE WHEN scheme = 'https' AND host <> '' AND NOT contains(u.auth, '@') THEN {_Q_BUILT} END AS canonical FROM {_q_url(U.DOCUMENT_TRACKING)})""")
def _(spark, sf):
    """Pages as a manifest's documents, some of them with an odd status, date or review."""
    n = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, ["approved", "active", "candidate", "odd", "expired", "pending_fetch", "pending_review"])), (n % 7 + 1).cast("int"))
    text = {c: F.lit("x") for c in ("source_id", "title", "extraction_version")} | {"canonical_document_id": n.cast("string"), "canonical_url": F.col("url"), "status": status, "content_hash": T.content_hash(F.col("html")), "archive_hash": F.sha2("html", 256), "published_at": F.lit(None).cast("string")}
    text |= {"fetched_at": F.when(n % 5 == 0, "soon").otherwise("2024-01-02T03:04:05Z"), "refresh_after": F.lit("2024-03-01"), "retention_until": F.lit("2025-03-01")}
    rights = F.struct(F.when(n % 4 == 1, "open").otherwise("approved").alias("status"), F.lit("r").alias("reviewer"), F.lit("d").alias("reviewed_at"), F.lit(False).alias("third_party_marked"))
    rows = table(spark, sf, "pages").select(n.alias("position"), *[c.alias(k) for k, c in text.items()], F.lit(2).alias("expected_point_count"), F.struct(F.lit("l").alias("id"), F.lit("u").alias("url")).alias("rights_basis"), rights.alias("rights_review"))
    return manifests.document_errors(rows).withColumnRenamed("position", "page_id")


# --- pages ---


@query("h03_paragraphs", r"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), lambda p: length(p) >= 25), chr(10)) AS prose FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(pages.paragraphs(F.col("html")), "\n").alias("prose"))


@query("h04_title", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '')) AS title FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query("h05_locate", f"WITH {Q_SENTENCES}, t AS (SELECT doc_id, lower({q_collapse('text')}) AS t FROM documents), s AS (SELECT doc_id, pos, substr(lower({q_collapse('sentence')}), 1, 240) AS n FROM sents) SELECT doc_id, pos, CASE WHEN length(n) >= 12 THEN ((length(t) - length(replace(t, n, ''))) / length(n))::int ELSE 0 END AS hits FROM s JOIN t USING (doc_id)")
def _(spark, sf):
    """Every sentence in its own text; a text's sentences are looked up in one row, so the text isn't repeated for each."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(pages.locate_all(F.col("text"), T.paragraph_sentences(F.col("text")))).alias("pos", "hits"))
