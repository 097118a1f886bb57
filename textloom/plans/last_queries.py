"""Named queries, third part: what the first two leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import articles, corpus, dataprep, evidence, metrics, pages
from ..operators.graph import written
from .more_queries import Q_BOUND, Q_CITE, Q_NEAR, Q_POINTS, bundle, citations, corpus_points, neighbours, q_bootstrap, q_bundle
from .queries import _Q_BUILT, Q_PROBABLE, Q_RECORDS, Q_SENTENCES, _q_url, _stamp, probable, q_collapse, q_cut, q_lit, q_prob, q_wilson, query, records, sentence_rows, table


@query("t03_legacy_normalisers", f"SELECT doc_id, {q_collapse('text')} AS text, CASE lower(trim(lang)) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE trim(lang) END AS label FROM documents")
def _(spark, sf):
    label = F.coalesce(F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))[F.lower(F.trim("lang"))], F.trim("lang"))
    return table(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"), label.alias("label"))


@query("t06_canonical_json", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}') AS h FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.to_json(F.struct("lang", "n_chars", "source"), {"ignoreNullFields": "false"}), 256).alias("h"))


@query("t16_label_order", "SELECT lang, (row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, lang) - 1)::int AS position FROM (SELECT DISTINCT lang FROM documents)")
def _(spark, sf):
    found = [r["lang"] for r in table(spark, sf, "documents").select("lang").distinct().collect()]  # labels, not rows
    return spark.createDataFrame([(x, i) for i, x in enumerate(T.ordered_labels(found, ["fr", "en"]))], "lang string, position int")


@query("t29_coercers", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'verified' WHEN doc_id % 3 = 1 THEN 'disputed' ELSE 'unverified' END AS status, substr(trim(text), 1, 280) AS claim, substr('id-' || doc_id || '-0123456789abcdef', 1, 16) AS id FROM documents")
def _(spark, sf):
    raw = F.element_at(F.array(F.lit(" Verified "), F.lit("DISPUTED"), F.lit("who knows")), (F.col("doc_id") % 3 + 1).cast("int"))
    low = F.lower(F.trim(raw))
    status = F.when(low.isin("verified", "disputed", "unverified"), low).otherwise("unverified")
    return table(spark, sf, "documents").select("doc_id", status.alias("status"), F.substring(F.trim("text"), 1, 280).alias("claim"), F.substring(F.concat(F.lit("id-"), F.col("doc_id"), F.lit("-0123456789abcdef")), 1, 16).alias("id"))


@query("t43_prompts", f"WITH {Q_SENTENCES} SELECT doc_id, 'Review these sentences:' || chr(10) || array_to_string(list('[' || pos || '] ' || sentence ORDER BY pos), chr(10)) AS prompt FROM sents GROUP BY doc_id")
def _(spark, sf):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: F.concat(F.lit("["), x["pos"], F.lit("] "), x["sentence"]))
    return sentence_rows(spark, sf).groupBy("doc_id").agg(F.concat(F.lit("Review these sentences:\n"), F.array_join(lines, "\n")).alias("prompt"))


@query("t45_point_to_evidence", f"SELECT page_id, url, snippet, 'Untitled' AS title, host AS domain FROM (SELECT p.page_id, {_Q_BUILT} AS url, host, scheme, u, substr({q_collapse('html')}, 1, 200) AS snippet FROM {_q_url(U.DOCUMENT_TRACKING)} p JOIN (SELECT page_id, html FROM pages) USING (page_id)) WHERE scheme = 'https' AND host <> '' AND NOT contains(u.auth, '@') AND snippet <> ''")
def _(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", U.document_url(F.col("url")).alias("url"), F.substring(T.collapse(F.col("html")), 1, 200).alias("snippet"), F.lit(None).cast("string").alias("title"))
    rows = rows.where("url is not null and snippet <> ''").withColumn("domain", F.lower(F.try_parse_url("url", F.lit("HOST"))))
    return rows.withColumn("title", F.coalesce("title", F.lit("Untitled")))


@query("t46_candidate_identity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cand' || doc_id WHEN doc_id % 3 = 1 THEN 'chunk' || doc_id ELSE 'doc' || doc_id END AS id FROM documents")
def _(spark, sf):
    i = F.col("doc_id")
    cand, chunk = F.when(i % 3 == 0, F.concat(F.lit("cand"), i)).otherwise(""), F.when(i % 3 == 1, F.concat(F.lit("chunk"), i))
    blank = lambda c: F.nullif(c, F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(blank(cand), blank(chunk), F.concat(F.lit("doc"), i)).alias("id"))


@query("f06_relevance_pipeline", f"WITH {Q_SENTENCES}, first AS (SELECT doc_id, min(pos) AS pos FROM sents WHERE (len(regexp_extract_all(sentence, '[A-Za-z0-9''-]+')) >= 12 AND length(sentence) >= 80) GROUP BY doc_id) SELECT doc_id, pos, 'Title. ' || sentence AS anchor FROM first JOIN sents USING (doc_id, pos)")
def _(spark, sf):
    """The anchor text of an article without a lead: its title and the first long sentence."""
    rows = sentence_rows(spark, sf).where((T.word_count(F.col("sentence")) >= 12) & (F.char_length("sentence") >= 80))
    return rows.groupBy("doc_id").agg(F.min_by("sentence", "pos").alias("s"), F.min("pos").alias("pos")).select("doc_id", "pos", F.concat(F.lit("Title. "), F.col("s")).alias("anchor"))


@query("f09_metadata_filter", f"WITH {Q_POINTS} SELECT chunk_id FROM point WHERE source_id IN ('src1', 'src2') AND retention_until >= TIMESTAMP '2024-02-20'")
def _(spark, sf):
    return corpus_points(spark, sf).where(corpus.metadata_filter({"source_id": ["src1", "src2"], "license_id": []}, now=_stamp("2024-02-20"))).select("chunk_id")


@query("f13_rejected_blocks")
def _(spark, sf):
    page = table(spark, sf, "pages").select("page_id", pages.html_blocks(F.col("html"))["blocks"].alias("b"))
    return page.select("page_id", F.explode("b").alias("b")).groupBy("page_id").agg(F.count("*").alias("blocks"), F.count("b.reason").alias("rejected"))


@query("f17_web_candidates", f"SELECT page_id, {_Q_BUILT} AS url, 'empirical_research' AS source_type FROM {_q_url([], True)} WHERE scheme = 'https' AND host <> '' AND NOT contains(u.auth, '@') AND (regexp_replace(host, '^www\\.', '') = 'example.com' OR ends_with(host, '.example.com'))")
def _(spark, sf):
    url = U.web_url(F.col("url"))
    kind = corpus.trust_class(U.domain_of(F.col("url")), ["example.com"], [], [], [])
    return table(spark, sf, "pages").select("page_id", url.alias("url"), kind.alias("source_type")).where("url is not null and source_type is not null")


@query("f18_single_partition", "SELECT doc_id FROM documents WHERE doc_id % 4 = 2")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    a = d.withColumn("partition", F.element_at(F.array(*map(F.lit, dataprep.PARTITIONS)), (F.col("doc_id") % 4 + 1).cast("int")))
    return dataprep.rows_of_partition(d, a, "calibration", "doc_id")


@query("j08_case_judgments", f"WITH {Q_NEAR} SELECT query_id, rank::int AS rank, id, id % 4 = query_id % 4 OR relevant AS relevant FROM ranked WHERE rank <= 10")
def _(spark, sf):
    """Relevance by document id or by chunk id: two equi joins, not one OR."""
    hits = neighbours(spark, sf, 10).withColumnRenamed("relevant", "by_document")
    judged = hits.select("query_id", "id").where(F.col("id") % 4 == F.col("query_id") % 4).distinct().withColumn("by_chunk", F.lit(True))
    return hits.join(judged, ["query_id", "id"], "left").select("query_id", "rank", "id", (F.col("by_document") | F.coalesce("by_chunk", F.lit(False))).alias("relevant"))


@query("j12_claim_outcomes", f"WITH {Q_SENTENCES} SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'verifiable' ELSE 'not_assessed' END AS verifiability, CASE WHEN pos % 3 = 0 THEN 'article-' || doc_id || ':sentence:' || pos || ':claim:1' END AS claim_id FROM sents")
def _(spark, sf):
    rows = sentence_rows(spark, sf)
    said = rows.where("pos % 3 = 0").select("doc_id", "pos", F.lit("verifiable").alias("v"))
    claim = F.when(F.col("v").isNotNull(), F.concat(F.lit("article-"), F.col("doc_id"), F.lit(":sentence:"), F.col("pos"), F.lit(":claim:1")))
    return rows.join(said, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("v", F.lit("not_assessed")).alias("verifiability"), claim.alias("claim_id"))


@query("a31_tree_hash", "SELECT lang, sha256(string_agg(source || chr(0) || h, chr(10) ORDER BY source)) AS tree FROM (SELECT lang, source, sha256(count(*)::varchar) AS h FROM documents GROUP BY ALL) GROUP BY lang")
def _(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", "source").agg(F.sha2(F.count("*").cast("string"), 256).alias("h"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("source", "h"))), lambda x: F.concat(x["source"], F.lit(chr(0)), x["h"]))
    return g.groupBy("lang").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("tree"))


@query("a33_development_bundle", f"WITH {Q_PROBABLE} SELECT 'bias' AS head, * FROM {q_bundle('truth', 'p')} UNION ALL SELECT 'style', * FROM {q_bundle('toxic', 'p_style')}")
def _(spark, sf):
    """The metrics of both heads."""
    rows = written(probable(spark, sf).select("p", "p_style", "truth", "toxic"))
    return bundle(rows, "p", "truth").withColumn("head", F.lit("bias")).unionByName(bundle(rows, "p_style", "toxic").withColumn("head", F.lit("style")))


@query("d05_three_class_gates", f"""WITH {Q_PROBABLE}, bias AS (SELECT truth, p >= 0.8 AS selected FROM prob), ti AS (SELECT doc_id, (doc_id % 3)::int AS truth, CASE WHEN p < 0.5 THEN 0 WHEN p_style < 0.5 THEN 1 ELSE 2 END AS pred FROM prob), {q_bootstrap('ti', 3)},
rep AS (SELECT doc_id, bool_or(toxic = 1) AS gold, bool_or(p >= 0.8) AS selected FROM prob WHERE quality = 1 GROUP BY doc_id),
m AS (SELECT (SELECT count(*) FILTER (truth = 1) FROM bias) AS bias_support, (SELECT {q_wilson('count(*) FILTER (truth = 1 AND selected)', 'count(*) FILTER (selected)')} FROM bias) AS bias_precision, (SELECT count(*) FILTER (truth = 1) FROM ti) AS middle_support,
(SELECT {q_wilson('count(*) FILTER (truth = 1 AND pred = 1)', 'count(*) FILTER (truth = 1)')} FROM ti) AS middle_recall, (SELECT CASE WHEN count(*) > 0 THEN {q_wilson('count(*) FILTER (gold AND selected)', 'count(*) FILTER (selected)')} END FROM rep) AS report_precision, {Q_BOUND} AS macro_f1_bound)
SELECT bias_support, middle_support, {", ".join(f"round({x}, 9) AS {x}" for x in ("bias_precision", "middle_recall", "report_precision", "macro_f1_bound"))}, array_to_string(list_filter([CASE WHEN bias_support < 500 THEN 'insufficient_locked_test_bias_positive_support' END, CASE WHEN middle_support < 300 THEN 'insufficient_locked_test_middle_support' END, CASE WHEN bias_precision < 0.9 THEN 'bias_positive_precision_lcb_below_target' END,
CASE WHEN report_precision IS NULL THEN 'article_report_precision_gate_not_evaluable' END, CASE WHEN report_precision < 0.9 THEN 'article_report_precision_lcb_below_target' END, CASE WHEN macro_f1_bound < 0.65 THEN 'opinion_macro_f1_lcb_below_target' END, CASE WHEN middle_recall < 0.5 THEN 'middle_recall_lcb_below_target' END], lambda x: x IS NOT NULL), ',') AS failures FROM m""")
def _(spark, sf):
    rows = written(probable(spark, sf).select("doc_id", "p", "p_style", "truth", "toxic", "quality"))
    bias = rows.select("truth", (F.col("p") >= 0.8).alias("selected"))
    opinion = rows.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("truth"), F.when(F.col("p") < 0.5, 0).when(F.col("p_style") < 0.5, 1).otherwise(2).alias("pred"))
    reports = rows.select("doc_id", F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("gold"), (F.col("p") >= 0.8).alias("selected"))
    out = metrics.three_class_gates(bias, opinion, "doc_id", reports)
    return out.select("bias_support", "middle_support", *[F.round(x, 9).alias(x) for x in ("bias_precision", "middle_recall", "report_precision", "macro_f1_bound")], F.array_join("failures", ",").alias("failures"))


@query("d10_response", f"WITH {Q_SENTENCES} SELECT doc_id, 'article-' || doc_id AS article, count(*) AS sentence_count, array_to_string(list(pos ORDER BY pos) FILTER (pos % 4 = 1 AND length(sentence) > 30), ',') AS selected FROM sents GROUP BY doc_id")
def _(spark, sf):
    picked = F.filter(F.array_sort(F.collect_list(F.when((F.col("pos") % 4 == 1) & (F.char_length("sentence") > 30), F.col("pos")))), lambda x: x.isNotNull())
    out = sentence_rows(spark, sf).groupBy("doc_id").agg(F.count("*").alias("sentence_count"), F.array_join(F.transform(picked, lambda x: x.cast("string")), ",").alias("selected"))
    return out.select("doc_id", F.concat(F.lit("article-"), F.col("doc_id")).alias("article"), "sentence_count", F.nullif("selected", F.lit("")).alias("selected"))


@query("h01_container_scores")
def _(spark, sf):
    page = table(spark, sf, "pages").select("page_id", pages.html_blocks(F.col("html")).alias("p"))
    scored = F.transform("p.boxes", lambda b: F.struct(b["box"].alias("box"), b["tag"].alias("tag"), b["length"].alias("length"), pages.container_score(b).alias("score")))
    return page.select("page_id", F.inline(scored))


@query("m01_surrogate_encoder", f"SELECT item_id, round({q_prob(chr(39) + '0:' + chr(39) + ' || text')}, 9) AS first, round({q_prob(chr(39) + '7:' + chr(39) + ' || text')}, 9) AS last FROM benchmark")
def _(spark, sf):
    """Eight hashed coordinates in place of a sentence encoder."""
    v = F.array(*[S.surrogate_probability(F.concat(F.lit(f"{i}:"), F.col("text"))) for i in range(8)])
    return table(spark, sf, "benchmark").select("item_id", F.round(v[0], 9).alias("first"), F.round(v[7], 9).alias("last"))


@query("s18_rotation", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n > 3")
def _(spark, sf):
    return corpus.keep_newest(table(spark, sf, "events"), ["event_type"], "event_id", 3).where("not keep").select("event_id")


@query("s22_local_documents", f"SELECT page_id, {q_collapse('html')} <> '' AS readable, length(html) <= 12582912 AS size_ok FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", (T.collapse(F.col("html")) != "").alias("readable"), (F.char_length("html") <= 12 << 20).alias("size_ok"))


@query("v04_dataset_shape", "SELECT 'cases' AS rule, count(*) AS found, count(*) = 120 AS ok FROM benchmark UNION ALL SELECT 'with_text', count(*), count(*) = 120 FROM benchmark WHERE trim(text) <> ''")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    a = b.agg(F.count("*").alias("cases"), F.count_if(F.trim("text") != "").alias("with_text"))
    return a.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("found"), (F.col(n) == 120).alias("ok")) for n in ("cases", "with_text")])))


@query("w12_citation_count", f"WITH {Q_CITE} SELECT scope, count(*) AS n FROM cite GROUP BY scope")
def _(spark, sf):
    return citations(spark, sf).groupBy("scope").agg(F.count("*").alias("n"))


