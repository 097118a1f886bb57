"""Named queries over the test tables, each with the SQL that gives the same rows.

Column conventions: scores are rounded where two engines add in different orders. The
surrogate probability (a hash of the text) stands in for models that need training data
and hardware which a batch engine does not bring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import articles, corpus, dataprep, evidence, metrics, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments ---


def q_collapse(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def q_fold(x):
    return f"replace(lower({x}), 'ß', 'ss')"


def q_prob(x):
    return f"(('0x' || substr(sha256({x}), 1, 8))::bigint % 10000 / 10000.0)"


def q_lit(s):
    return "'" + s.replace("'", "''") + "'"


def q_cut(x, lookahead=r"""["''(\[]?[A-Z0-9]"""):
    return rf"list_filter(string_split(regexp_replace({q_collapse(x)}, '([.!?])\s+({lookahead})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


Q_SENTENCES = rf"""sents AS (SELECT doc_id, unnest(range(len(l)))::int AS pos, unnest(l) AS sentence FROM (
  SELECT doc_id, flatten(list_transform(list_filter(list_transform(string_split_regex(text, '\n+'), lambda b: trim(b)), lambda b: b <> ''), lambda b: {q_cut('b')})) AS l FROM documents))"""
Q_WORDS = r"len(regexp_extract_all(sentence, '[A-Za-z0-9''-]+'))"


def q_boundary(patterns):
    """RE2's word boundary is ASCII; the sentences at hand are matched with guards instead."""
    return "|".join(p.replace(r"\b", "") if p.startswith("^") else "(?:^|[^A-Za-z0-9_À-ÿ])" + p.replace(r"\b", "") + "(?:$|[^A-Za-z0-9_À-ÿ])" for p in patterns)


Q_RELEVANCE = rf"""{Q_SENTENCES}, judged AS (SELECT *, CASE WHEN regexp_matches(sentence, '(?i){q_boundary(T.STRONG_BOILERPLATE)}') OR (length(sentence) < 120 AND {Q_WORDS} <= 20 AND regexp_matches(sentence, '(?i){q_boundary(T.BOILERPLATE)}')) THEN 'boilerplate_keyword'
  WHEN {Q_WORDS} <= 3 AND length(sentence) < 30 THEN 'too_short' END AS r FROM sents),
relevant AS (SELECT doc_id, pos, sentence, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY doc_id, {q_fold(q_collapse('sentence'))}, r IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE r END AS reason FROM judged)"""
Q_SIGNAL = f"least(1.0, greatest(0.0, 0.65 * {q_prob('sentence')} + 0.35 * {q_prob(chr(39) + 'o:' + chr(39) + ' || sentence')}))"
Q_BUCKET = "CASE WHEN score < 20 THEN 'Low' WHEN score < 45 THEN 'Moderate' WHEN score < 70 THEN 'High' ELSE 'Severe' END"
Q_SCORED = f"""{Q_RELEVANCE}, sig AS (SELECT doc_id, {Q_SIGNAL} AS signal FROM relevant WHERE reason IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY signal DESC) AS rank, greatest(1, round_even(count(*) OVER (PARTITION BY doc_id) * 0.15, 0)) AS peaks FROM sig),
scored AS (SELECT doc_id, round_even(least(100.0, greatest(0.0, (0.5 * avg(signal) + 0.5 * avg(CASE WHEN rank <= peaks THEN signal END)) * 100)), 1) AS score FROM ranked GROUP BY doc_id)"""


def sentence_rows(spark, sf):
    return articles.sentences(table(spark, sf, "documents"))


def probable(spark, sf):
    """Sentences with both surrogate probabilities, the label of their document as truth."""
    rows = articles.relevance(sentence_rows(spark, sf)).where("reason is null")
    return rows.select("doc_id", "pos", "sentence", S.surrogate_probability(F.col("sentence")).alias("p"), S.surrogate_probability(F.concat(F.lit("o:"), F.col("sentence"))).alias("p_style")).join(table(spark, sf, "labels"), "doc_id").withColumn("truth", F.col("quality"))


Q_PROBABLE = f"{Q_RELEVANCE}, prob AS (SELECT doc_id, pos, sentence, {q_prob('sentence')} AS p, {q_prob(chr(39) + 'o:' + chr(39) + ' || sentence')} AS p_style, quality, toxic, quality AS truth FROM relevant JOIN labels USING (doc_id) WHERE reason IS NULL)"


# --- flagship ---


@query("flagship_article_levels", f"WITH {Q_SCORED}, counts AS (SELECT doc_id, count(*) AS sentence_count, count(*) FILTER (reason IS NULL) AS kept_count FROM relevant GROUP BY doc_id) SELECT doc_id, coalesce(sentence_count, 0) AS sentence_count, coalesce(kept_count, 0) AS kept_count, coalesce(score, 0.0) AS score, CASE WHEN coalesce(score, 0) < 20 THEN 'Low' WHEN score < 45 THEN 'Moderate' WHEN score < 70 THEN 'High' ELSE 'Severe' END AS level FROM (SELECT doc_id FROM documents) LEFT JOIN counts USING (doc_id) LEFT JOIN scored USING (doc_id)")
def _(spark, sf):
    return articles.article_levels(table(spark, sf, "documents"))


# --- sources ---


@query("s02_read_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("s06_concat_different_columns", "SELECT doc_id AS id, text, lang, NULL::bigint AS turn FROM documents UNION ALL SELECT conv_id AS id, text, NULL AS lang, turn FROM conversations")
def _(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return a.unionByName(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", "turn"), allowMissingColumns=True)


@query("s07_split_router", "SELECT doc_id, CASE lower(trim(lang)) WHEN 'en' THEN 'train' WHEN 'de' THEN 'test' END AS dataset_split FROM documents WHERE lower(trim(lang)) IN ('en', 'de')")
def _(spark, sf):
    from ..sources.readers import route_splits

    return route_splits(table(spark, sf, "documents"), "lang", {"en": "train", "de": "test"}).select("doc_id", "dataset_split")


@query("s09_html_title", r"""SELECT page_id, nullif(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '') AS title FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.escaped_title(F.col("html")).alias("title"))


@query("s09_html_document")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.parse_html(F.col("html")).alias("d")).select("page_id", "d.*")


@query("s13_filtered_scan", "SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src0', 'src3') AND n_chars BETWEEN 500 AND 5000")
def _(spark, sf):
    return table(spark, sf, "documents").where(corpus.metadata_filter({"source": ["src0", "src3"], "lang": []}, {"n_chars": (500, 5000)})).select("doc_id", "source", "n_chars")


@query("s20_page_articles")
def _(spark, sf):
    return pages.extract(table(spark, sf, "pages"))


@query("h02_article_choice")
def _(spark, sf):
    return pages.extract(table(spark, sf, "pages")).select("page_id", "ok", "reason", "sentence_count")


# --- text functions ---


@query("t01_normalize_text", f"SELECT doc_id, {q_collapse('text')} AS normal FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query("t02_collapse", f"SELECT page_id, {q_collapse('html')} AS normal FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.collapse(F.col("html")).alias("normal"))


@query("t04_text_hash", f"SELECT doc_id, sha256({q_fold(q_collapse('text'))}) AS text_hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))


@query("t05_content_hash", f"SELECT doc_id, sha256({q_collapse('text')}) AS content_hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def _q_url(tracking, keep_query=False):
    names = ", ".join(q_lit(x) for x in tracking)
    parts = r"regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)\??([^#]*)', ['scheme', 'auth', 'path', 'query'])"
    fields = f"list_filter(string_split(u.query, '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT list_contains([{names}]::varchar[], lower(split_part(p, '=', 1))))"
    pairs = f"array_to_string(list_transform(list_sort(list_transform({fields}, lambda p: {{'k': split_part(p, '=', 1), 'v': CASE WHEN contains(p, '=') THEN regexp_extract(p, '([^=]*)$', 1) ELSE '' END}})), lambda s: s.k || '=' || s.v), '&')"
    query_text = "u.query" if keep_query else pairs
    return f"(SELECT page_id, url, u, {query_text} AS q, lower(u.scheme) AS scheme, rtrim(lower(regexp_extract(u.auth, '(?:.*@)?([^:]*)', 1)), '.') AS host, regexp_extract(u.auth, ':([0-9]+)$', 1) AS port FROM (SELECT page_id, url, {parts} AS u FROM pages))"


_Q_BUILT = "scheme || '://' || host || CASE WHEN port <> '' AND NOT (scheme = 'http' AND port = '80') AND NOT (scheme = 'https' AND port = '443') THEN ':' || port ELSE '' END || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END"


@query("t07_article_url", f"SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN {_Q_BUILT} END AS canonical FROM {_q_url(U.ARTICLE_TRACKING)}")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.article_url(F.col("url")).alias("canonical"))


@query("t08_document_url", f"SELECT page_id, CASE WHEN scheme = 'https' AND host <> '' AND NOT contains(u.auth, '@') THEN {_Q_BUILT} END AS canonical FROM {_q_url(U.DOCUMENT_TRACKING)}")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.document_url(F.col("url")).alias("canonical"))


@query("t09_web_url", f"SELECT page_id, CASE WHEN scheme = 'https' AND host <> '' AND NOT contains(u.auth, '@') THEN {_Q_BUILT} END AS canonical FROM {_q_url([], True)}")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.web_url(F.col("url")).alias("canonical"))


@query("t10_domain", f"SELECT page_id, regexp_replace(host, '^www\\.', '') AS domain FROM {_q_url([])}")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.domain_of(F.col("url")).alias("domain"))


@query("t11_domain_matches", f"SELECT page_id, (d = 'example.com' OR ends_with(d, '.example.com')) AS matches FROM (SELECT page_id, regexp_replace(host, '^www\\.', '') AS d FROM {_q_url([])})")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.domain_matches(U.domain_of(F.col("url")), F.lit("example.com")).alias("matches"))


@query("t12_iso_utc", "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS day_utc, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS at_utc, NULL::varchar AS bad FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.iso_utc(F.date_format("ts", "yyyy-MM-dd")).alias("day_utc"), T.iso_utc(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at_utc"), T.iso_utc(F.lit("not a time")).alias("bad"))


_RAW_BIAS = "element_at(array('Biased', ' non-biased ', '1.0', '0', 'NONBIASED', 'mixed'), cast(doc_id % 6 as int) + 1)"
_Q_RAW_BIAS = "['Biased', ' non-biased ', '1.0', '0', 'NONBIASED', 'mixed'][(doc_id % 6) + 1]"
_RAW_OPINION = "element_at(array('entirely  factual', 'Somewhat factual but also opinionated', 'expresses writer’s OPINION', 'No agreement', ''), cast(doc_id % 5 as int) + 1)"
_Q_RAW_OPINION = "['entirely  factual', 'Somewhat factual but also opinionated', 'expresses writer’s OPINION', 'No agreement', ''][(doc_id % 5) + 1]"
_Q_BIAS = f"(CASE lower(trim({_Q_RAW_BIAS})) WHEN 'biased' THEN 'Biased' WHEN '1' THEN 'Biased' WHEN '1.0' THEN 'Biased' WHEN '0' THEN 'Non-biased' WHEN '0.0' THEN 'Non-biased' WHEN 'nonbiased' THEN 'Non-biased' WHEN 'non-biased' THEN 'Non-biased' ELSE trim({_Q_RAW_BIAS}) END)"
_Q_OPINION_PLAIN = f"replace({q_collapse(_Q_RAW_OPINION)}, '’', '''')"
_Q_OPINION = f"(CASE lower({_Q_OPINION_PLAIN}) " + " ".join(f"WHEN {q_lit(x.lower())} THEN {q_lit(x)}" for x in T.OPINION_TIERS) + f" ELSE {_Q_OPINION_PLAIN} END)"
_Q_OPINION_ID = f"(CASE {_Q_OPINION} " + " ".join(f"WHEN {q_lit(x)} THEN {i}" for i, x in enumerate(T.OPINION_TIERS)) + " END)"


@query("t13_bias_label", f"SELECT doc_id, {_Q_BIAS} AS label, CASE {_Q_BIAS} WHEN 'Biased' THEN 1 WHEN 'Non-biased' THEN 0 END AS id FROM documents")
def _(spark, sf):
    label = T.bias_label(F.expr(_RAW_BIAS))
    return table(spark, sf, "documents").select("doc_id", label.alias("label"), T.bias_id(label).alias("id"))


@query("t14_opinion_label", f"SELECT doc_id, {_Q_OPINION} AS label, {_Q_OPINION_ID} AS id FROM documents")
def _(spark, sf):
    label = T.opinion_label(F.expr(_RAW_OPINION))
    return table(spark, sf, "documents").select("doc_id", label.alias("label"), T.opinion_id(label).alias("id"))


@query("t15_style_label", f"SELECT doc_id, CASE {_Q_OPINION_ID} WHEN 0 THEN 'objective_style' WHEN 1 THEN 'opinionated_style' WHEN 2 THEN 'opinionated_style' END AS style, CASE {_Q_OPINION_ID} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS id FROM documents")
def _(spark, sf):
    label = T.opinion_label(F.expr(_RAW_OPINION))
    return table(spark, sf, "documents").select("doc_id", T.style_label(label).alias("style"), T.style_id(label).alias("id"))


@query("t17_classifier_input", f"SELECT doc_id, '[TARGET]' || chr(10) || {q_collapse('text')} AS input FROM documents WHERE {q_collapse('text')} <> ''")
def _(spark, sf):
    d = table(spark, sf, "documents").where(T.collapse(F.col("text")) != "")
    return d.select("doc_id", T.classifier_input(F.col("text")).alias("input"))


@query("t18_stable_ids", f"SELECT page_id, 'doc_' || sha256(url) AS document_id, 'chunk_' || sha256('doc_' || sha256(url) || chr(0) || '0' || chr(0) || sha256({q_collapse('html')}) || chr(0) || 'word_window/v1') AS chunk_id FROM pages")
def _(spark, sf):
    doc = T.document_id(F.col("url"))
    return table(spark, sf, "pages").select("page_id", doc.alias("document_id"), T.chunk_id(doc, F.lit(0), T.content_hash(F.col("html")), corpus.CHUNKING_VERSION).alias("chunk_id"))


@query("t20_sentences", f"WITH l AS (SELECT doc_id, {q_cut('text')} AS s FROM documents) SELECT doc_id, unnest(range(len(s)))::int AS pos, unnest(s) AS sentence FROM l")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("t21_paragraph_sentences", f"WITH {Q_SENTENCES} SELECT * FROM sents")
def _(spark, sf):
    return sentence_rows(spark, sf)


Q_LINK_CUT = q_cut("text", r"""[A-Z0-9"''(\[]""")


@query("t22_count_sentences", rf"""SELECT doc_id, len({Q_LINK_CUT})::int AS n FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.count_sentences(F.col("text")).alias("n"))


@query("t23_word_count", f"WITH {Q_SENTENCES} SELECT doc_id, pos, {Q_WORDS}::int AS words FROM sents")
def _(spark, sf):
    return sentence_rows(spark, sf).select("doc_id", "pos", T.word_count(F.col("sentence")).cast("int").alias("words"))


@query("t24_prose", rf"""WITH {Q_SENTENCES} SELECT doc_id, pos, ({Q_WORDS} >= 12 AND length(sentence) >= 80) OR ({Q_WORDS} >= 6 AND regexp_matches(rtrim(sentence), '[.!?"”]$') AND regexp_matches(substr(sentence, 2), '\p{{Ll}}')) AS prose FROM sents""")
def _(spark, sf):
    return sentence_rows(spark, sf).select("doc_id", "pos", T.is_prose(F.col("sentence")).alias("prose"))


def q_compact(x):
    words = f"list_filter(regexp_extract_all(replace({x}, 'â€™', ''''), '[A-Za-z][A-Za-z0-9''-]{{2,}}'), lambda w: NOT list_contains([{', '.join(map(q_lit, T.STOP_WORDS))}], lower(w)))"
    return f"(SELECT array_to_string(list_filter(l, lambda w, i: list_position(list_transform(l, lambda v: lower(v)), lower(w)) = i)[:14], ' ') FROM (SELECT {words} AS l))"


@query("t25_compact_query", f"SELECT item_id, {q_compact('text')} AS query FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.compact_query(F.col("text")).alias("query"))


@query("t26_claim_queries", f"""WITH c AS (SELECT item_id % 7 AS scope, item_id AS pos, 'claim-' || item_id AS claim_id, text, 'context ' || text AS context FROM benchmark),
b AS (SELECT scope, pos, claim_id, 0 AS kind, {q_compact('text')} AS query FROM c UNION ALL SELECT scope, pos, claim_id, 1, {q_compact('context')} FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY kind, pos) AS n FROM b WHERE query <> ''),
g AS (SELECT scope, lower(query) AS k, min(n) AS n, arg_min(query, n) AS query, arg_min(kind, n) AS kind, list(claim_id ORDER BY n) AS ids FROM n WHERE n <= 3 GROUP BY ALL)
SELECT scope, (row_number() OVER (PARTITION BY scope ORDER BY n))::int AS position, query, CASE kind WHEN 0 THEN 'selected_sentence' ELSE 'context_window' END AS source, array_to_string(ids, ',') AS claims FROM g""")
def _(spark, sf):
    c = table(spark, sf, "benchmark").select((F.col("item_id") % 7).alias("scope"), F.col("item_id").alias("pos"), F.concat(F.lit("claim-"), F.col("item_id")).alias("claim_id"), "text", F.concat(F.lit("context "), F.col("text")).alias("context"))
    return evidence.claim_queries(c).select("scope", "position", "query", "source", F.array_join("claim_ids", ",").alias("claims"))


@query("t27_merge_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = doc_id % 5 THEN 'a' || (doc_id % 3) || ',b' ELSE 'a' || (doc_id % 3) || ',b,a' || (doc_id % 5) END AS ids FROM documents")
def _(spark, sf):
    a, b = F.array(F.concat(F.lit("a"), F.col("doc_id") % 3), F.lit("b")), F.array(F.concat(F.lit("a"), F.col("doc_id") % 5), F.lit("b"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.merge_ids(a, b), ",").alias("ids"))


@query("t30_content_type", "SELECT doc_id, 'text/html' AS mime, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' END AS charset FROM documents")
def _(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, 'Text/HTML; Charset="UTF-8"').otherwise("text/html")
    return table(spark, sf, "documents").select("doc_id", T.mime_type(raw).alias("mime"), T.charset(raw).alias("charset"))


@query("t32_sigmoid_softmax", "SELECT doc_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 9) AS p, round(exp(1.0 - m) / (exp(1.0 - m) + exp(y - m)), 9) AS first FROM (SELECT doc_id, (n_chars / 1000.0 - 2) / 1.5 AS x, n_chars / 5000.0 AS y, greatest(1.0, n_chars / 5000.0) AS m FROM documents)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.round(S.sigmoid(F.col("n_chars") / 1000.0 - 2, 1.5), 9).alias("p"), F.round(S.softmax(F.array(F.lit(1.0), F.col("n_chars") / 5000.0))[0], 9).alias("first"))


@query("t33_three_tiers", f"WITH {Q_SENTENCES} SELECT doc_id, pos, round(1 - q, 9) AS a, round(q * (1 - w), 9) AS b, round(q * w, 9) AS c FROM (SELECT *, {q_prob('sentence')} AS q, {q_prob(chr(39) + 'o:' + chr(39) + ' || sentence')} AS w FROM sents)")
def _(spark, sf):
    t = S.three_tiers(S.surrogate_probability(F.col("sentence")), S.surrogate_probability(F.concat(F.lit("o:"), F.col("sentence"))))
    return sentence_rows(spark, sf).select("doc_id", "pos", t.alias("t")).select("doc_id", "pos", *[F.round(F.col("t")[i], 9).alias(n) for i, n in enumerate("abc")])


@query("t34_signal", f"WITH {Q_SENTENCES} SELECT doc_id, pos, round({Q_SIGNAL}, 9) AS signal FROM sents")
def _(spark, sf):
    return sentence_rows(spark, sf).select("doc_id", "pos", F.round(S.signal(S.surrogate_probability(F.col("sentence")), S.surrogate_probability(F.concat(F.lit("o:"), F.col("sentence")))), 9).alias("signal"))


@query("t35_bucket_caption", f"SELECT doc_id, score, {Q_BUCKET} AS level, {Q_BUCKET} || ' bias — ' || (doc_id % 7) || ' of ' || (doc_id % 11) || ' relevant sentence(s) flagged for review.' AS caption FROM (SELECT doc_id, (doc_id % 101)::double AS score FROM documents)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 101).cast("double").alias("score"))
    return d.select("doc_id", "score", S.bucket(F.col("score")).alias("level"), S.caption(F.col("score"), F.col("doc_id") % 7, F.col("doc_id") % 11).alias("caption"))


def q_wilson(k, n, z="1.6448536269514722"):
    return f"(CASE WHEN {n} > 0 THEN greatest(0.0, (({k})::double / ({n}) + {z} * {z} / (2.0 * ({n})) - {z} * sqrt(({k})::double / ({n}) * (1 - ({k})::double / ({n})) / ({n}) + {z} * {z} / (4.0 * ({n}) * ({n})))) / (1 + {z} * {z} / ({n}))) ELSE 0.0 END)"


@query("t36_wilson_lower", f"SELECT source, n, good, round({q_wilson('good', 'n')}, 9) AS lower FROM (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)")
def _(spark, sf):
    g = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    return g.withColumn("lower", F.round(S.wilson_lower(F.col("good"), F.col("n")), 9))


Q_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1]::double * t[2]::double))"


def q_cosine(a, b):
    d = lambda x, y: Q_DOT.format(a=x, b=y)
    return f"({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)})))"


@query("t37_cosine", f"SELECT a.vec_id, round({q_cosine('a.embedding', 'b.embedding')}, 7) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    one = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("b")))
    return e.crossJoin(one).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("b")), 7).alias("score"))


@query("t38_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 9).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 9).alias("p95"))


@query("t39_source_dataset", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'MBIC' WHEN 1 THEN 'BASIL' ELSE 'BABE' END AS dataset FROM documents")
def _(spark, sf):
    name = F.element_at(F.array(F.lit("mbic/data/MBIC_v1.csv"), F.lit("x/basil.csv"), F.lit("mbic/final_labels.csv")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", T.source_dataset(name).alias("dataset"))


@query("t40_seeded_hash", "SELECT doc_id, sha256('42:' || doc_id) AS h FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.seeded_hash(42, F.col("doc_id").cast("string")).alias("h"))


@query("t41_checks", "SELECT doc_id, doc_id % 2 = 0 AS hash_ok, doc_id % 3 = 0 AS same_minor FROM documents")
def _(spark, sf):
    h = F.when(F.col("doc_id") % 2 == 0, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise("ABC")
    v = F.when(F.col("doc_id") % 3 == 0, "1.14.7").otherwise("1.15.0")
    return table(spark, sf, "documents").select("doc_id", T.is_sha256(h).alias("hash_ok"), T.same_minor(v, F.lit("1.14.0")).alias("same_minor"))


@query("t44_fallback_report", f"WITH l AS (SELECT doc_id, {q_cut('text')} AS s FROM documents) SELECT doc_id, array_to_string(list_transform(s[:12], lambda x: substr(x, 1, 200)), chr(10)) AS report FROM l")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", articles.report_text(T.sentences(F.col("text"))).alias("report"))


@query("t48_warmup_decay", "SELECT i::bigint AS step, round(CASE WHEN i < 100 THEN (i + 1) / 100.0 ELSE greatest(0.0, 1 - (i - 100) / 900.0) END, 9) AS factor FROM range(1000) t(i)")
def _(spark, sf):
    return spark.range(1000).select(F.col("id").alias("step"), F.round(S.warmup_decay(F.col("id"), 100, 1000), 9).alias("factor"))


@query("t49_mask_label", "SELECT doc_id, coalesce(quality, -100) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", T.mask_label(F.col("quality")).alias("label"))


@query("t50_label_map", f"SELECT item_id, {q_prob('text')} AS biased, 1 - {q_prob('text')} AS other FROM benchmark")
def _(spark, sf):
    p = S.surrogate_probability(F.col("text"))
    m = F.map_from_arrays(F.array(F.lit("Biased"), F.lit("Non-biased")), F.array(p, 1 - p))
    return table(spark, sf, "benchmark").select("item_id", m.alias("m")).select("item_id", F.col("m")["Biased"].alias("biased"), F.col("m")["Non-biased"].alias("other"))


# --- filters ---


@query("f04_relevance_reasons", f"WITH {Q_RELEVANCE} SELECT * FROM relevant")
def _(spark, sf):
    return articles.relevance(sentence_rows(spark, sf)).select("doc_id", "pos", "sentence", "reason")


@query("a32_reason_counts", f"WITH {Q_RELEVANCE} SELECT reason, count(*) AS n FROM relevant WHERE reason IS NOT NULL GROUP BY reason")
def _(spark, sf):
    return articles.relevance(sentence_rows(spark, sf)).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("f05_semantic_filter", f"SELECT vec_id FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label) USING (label) WHERE {q_cosine('embedding', 'anchor')} >= 0.18")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("sentence", F.lit("Menu"))
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return articles.semantic_relevance(e, anchors, "embedding", "label").select("vec_id")


@query("f07_trust_class", f"SELECT page_id, CASE WHEN d LIKE '%.org' THEN 'primary_official' WHEN d = 'example.com' OR ends_with(d, '.example.com') THEN 'empirical_research' END AS class FROM (SELECT page_id, regexp_replace(host, '^www\\.', '') AS d FROM {_q_url([])})")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", corpus.trust_class(U.domain_of(F.col("url")), ["example.com"], ["wire.example"], [".org"], []).alias("class"))


def registry(spark):
    rows = [("wide", ["example.com", "example.org"], ["https://"], [], True, False), ("narrow", ["example.com"], ["https://www.example.com/"], ["https://www.example.com/p/1"], True, True)]
    return spark.createDataFrame(rows, "source_id string, domains array<string>, allowed_prefixes array<string>, excluded_prefixes array<string>, fetch_allowed boolean, ingest_allowed boolean")


_REG_SQL = f"""WITH c AS (SELECT page_id, url, CASE WHEN scheme = 'https' AND host <> '' AND NOT contains(u.auth, '@') THEN {_Q_BUILT} END AS canonical_url, regexp_replace(host, '^www\\.', '') AS d FROM {_q_url(U.DOCUMENT_TRACKING)}),
r(source_id, domain, prefix, excluded, ingest) AS (VALUES ('wide', 'example.com', 'https://', NULL, false), ('wide', 'example.org', 'https://', NULL, false), ('narrow', 'example.com', 'https://www.example.com/', 'https://www.example.com/p/1', true)),
m AS (SELECT c.page_id, arg_max(r, length(prefix)) AS b FROM c JOIN r ON canonical_url IS NOT NULL AND (d = domain OR ends_with(d, '.' || domain)) AND starts_with(lower(canonical_url), prefix) GROUP BY c.page_id)
SELECT page_id, canonical_url, b.source_id AS source_id, reason IS NULL AS allowed, reason FROM (SELECT *, CASE WHEN canonical_url IS NULL THEN 'source URL must be absolute HTTPS without credentials' WHEN b IS NULL THEN 'source is not explicitly permitted by the trusted-source registry' WHEN starts_with(lower(canonical_url), b.excluded) THEN 'URL is explicitly excluded by the source policy' WHEN NOT b.ingest THEN 'source ''' || b.source_id || ''' is not permitted for ingest' END AS reason FROM c LEFT JOIN m USING (page_id))"""


@query("f08_url_policy", _REG_SQL)
def _(spark, sf):
    return corpus.url_policy(table(spark, sf, "pages").select("page_id", "url"), registry(spark), "ingest").drop("url")


QUERIES["j10_longest_prefix"], ORACLES["j10_longest_prefix"] = QUERIES["f08_url_policy"], _REG_SQL


@query("f10_retention", "SELECT event_id FROM events WHERE ts + INTERVAL 30 DAY >= TIMESTAMP '2024-02-15 00:00:00'")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("retention_until", F.col("ts") + F.expr("interval 30 days"))
    return e.where(corpus.metadata_filter({}, now=_stamp("2024-02-15"))).select("event_id")


def _stamp(day):
    import datetime

    return datetime.datetime.fromisoformat(day)


@query("f11_score_threshold", f"SELECT item_id FROM benchmark WHERE {q_prob('text')} >= 0.4 OR item_id % 9 = 0")
def _(spark, sf):
    score = F.when(F.col("item_id") % 9 != 0, S.surrogate_probability(F.col("text")))
    return table(spark, sf, "benchmark").where(score.isNull() | (score >= 0.4)).select("item_id")


@query("f12_eligibility", "SELECT doc_id, kind, kind IN ('corpus_chunk', 'source_excerpt') AS eligible FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'corpus_chunk' WHEN 1 THEN 'source_excerpt' WHEN 2 THEN 'corpus_chunk' ELSE 'search_snippet' END AS kind FROM documents)")
def _(spark, sf):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = evidence.material_kind(pick(["search_snippet", "search_snippet", "", "search_snippet"]), pick(["qdrant", "source_fetch", "qdrant", "web"]))
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"), evidence.eligible(kind).alias("eligible"))


@query("f14_quality_gates", f"SELECT doc_id, length({q_collapse('text')}) < 120 AS low_quality, length(text) < 250 OR len({q_cut('text')}) < 2 AS insufficient_prose, length(text) >= greatest(200, 20 * 3) AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(1, length(text)) >= 0.35 AS pdf_ok FROM documents")
def _(spark, sf):
    from ..sources.readers import pdf_quality

    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", (F.char_length(T.collapse(text)) < 120).alias("low_quality"), ((F.char_length(text) < 250) | (F.size(T.sentences(text)) < 2)).alias("insufficient_prose"), pdf_quality(text, F.lit(3)).alias("pdf_ok"))


@query("f16_due", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type IN ('click', 'view')")
def _(spark, sf):
    return corpus.due(table(spark, sf, "events").withColumn("status", F.col("event_type")), _stamp("2024-01-20"), "ts", ["click", "view"]).select("event_id")


# --- annotated records ---


def records(spark, sf):
    d = table(spark, sf, "documents")
    raw = d.select(F.concat(F.lit("r"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("record_id"), F.when(F.col("doc_id") % 3 == 0, "BABE").otherwise("BASIL").alias("dataset"), F.col("source").alias("file"), "text", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("https://www.Example.com/a/"), F.col("doc_id") % 50, F.lit("?utm_source=x"))).alias("url"), F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("Story-"), F.col("doc_id") % 9)).alias("event_id"), F.expr(_RAW_BIAS).alias("bias"), F.expr(_RAW_OPINION).alias("opinion"))
    return dataprep.canonical_records(raw)


Q_RECORDS = f"""rec AS (SELECT 'r' || lpad(doc_id::varchar, 9, '0') AS record_id, CASE WHEN doc_id % 3 = 0 THEN 'BABE' ELSE 'BASIL' END AS dataset, source AS file, {q_collapse('text')} AS text, sha256({q_fold(q_collapse('text'))}) AS text_hash,
 CASE WHEN doc_id % 4 <> 0 THEN 'https://www.example.com/a/' || (doc_id % 50) END AS canonical_url, CASE WHEN doc_id % 40 = 0 THEN 'story-' || (doc_id % 9) END AS event_id,
 CASE {_Q_BIAS} WHEN 'Biased' THEN 1 WHEN 'Non-biased' THEN 0 END AS bias_label, {_Q_OPINION_ID} AS opinion_label, CASE WHEN lower({_Q_OPINION}) LIKE 'no agreement%' THEN 'no_agreement' ELSE 'single_annotated' END AS annotation_state FROM documents),
recs AS (SELECT *, CASE WHEN event_id IS NOT NULL THEN lower(dataset) || ':event:' || event_id WHEN canonical_url IS NOT NULL THEN 'url:' || canonical_url ELSE 'text:' || text_hash END AS group_id, CASE WHEN event_id IS NOT NULL THEN 'event_id' WHEN canonical_url IS NOT NULL THEN 'url' ELSE 'text_hash' END AS grouping_method FROM rec)"""
Q_CLEAN = f"""{Q_RECORDS}, c1 AS (SELECT *, CASE WHEN text = '' THEN 'empty_text' WHEN annotation_state = 'no_agreement' THEN 'no_agreement' WHEN bias_label IS NULL OR opinion_label IS NULL THEN 'missing_required_label' END AS e1 FROM recs),
c2 AS (SELECT *, CASE WHEN e1 IS NULL AND (min(bias_label) OVER w < max(bias_label) OVER w OR min(opinion_label) OVER w < max(opinion_label) OVER w) THEN 'conflicting_text_labels' ELSE e1 END AS e2 FROM c1 WINDOW w AS (PARTITION BY text_hash, e1 IS NULL)),
clean AS (SELECT *, CASE WHEN e2 IS NULL AND row_number() OVER (PARTITION BY text_hash, e2 IS NULL ORDER BY dataset, file, record_id) > 1 THEN 'global_duplicate' ELSE e2 END AS excluded FROM c2)"""
LABELS = ["bias_label", "opinion_label"]


@query("d00_canonical_records", f"WITH {Q_RECORDS} SELECT record_id, dataset, text_hash, canonical_url, event_id, group_id, grouping_method, bias_label, opinion_label, annotation_state FROM recs")
def _(spark, sf):
    return records(spark, sf).select("record_id", "dataset", "text_hash", "canonical_url", "event_id", "group_id", "grouping_method", "bias_label", "opinion_label", "annotation_state")


@query("f01_cleaning", f"WITH {Q_CLEAN} SELECT record_id, excluded FROM clean")
def _(spark, sf):
    return dataprep.cleaning_steps(records(spark, sf), LABELS).select("record_id", "excluded")


@query("f02_annotation_state", f"WITH {Q_RECORDS} SELECT record_id, annotation_state FROM recs")
def _(spark, sf):
    return records(spark, sf).select("record_id", "annotation_state")


@query("f03_rare_labels", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND source IN (SELECT source FROM documents WHERE doc_id % 5 = 0 GROUP BY source HAVING count(*) >= 2)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return dataprep.drop_rare_labels(d.where("doc_id % 5 = 0"), d.where("doc_id % 5 <> 0"), "source")[1].select("doc_id")


@query("a01_partition_summary", f"WITH {Q_RECORDS} SELECT p AS partition, coalesce(n, 0) AS rows, coalesce(g, 0) AS distinct_group_id FROM (SELECT unnest(['train', 'development', 'calibration', 'locked_test']) AS p) LEFT JOIN (SELECT ['train', 'development', 'calibration'][(substr(record_id, 2)::bigint % 3) + 1] AS p, count(*) AS n, count(DISTINCT group_id) AS g FROM recs GROUP BY 1) USING (p)")
def _(spark, sf):
    part = F.element_at(F.array(F.lit("train"), F.lit("development"), F.lit("calibration")), (F.substring("record_id", 2, 20).cast("bigint") % 3 + 1).cast("int"))
    return dataprep.partition_summary(records(spark, sf).withColumn("partition", part), "partition", ["group_id"])


_PARTITION = "['train', 'development', 'calibration'][(substr(record_id, 2)::bigint % 3) + 1]"


@query("a01_value_counts", f"WITH {Q_RECORDS} SELECT p AS partition, field, value, count(*) AS n FROM (SELECT {_PARTITION} AS p, unnest(['dataset', 'file', 'annotation_state', 'bias_label']) AS field, unnest([coalesce(nullif(dataset, ''), '<missing>'), coalesce(nullif(file, ''), '<missing>'), coalesce(nullif(annotation_state, ''), '<missing>'), coalesce(bias_label::varchar, '<missing>')]) AS value FROM recs) GROUP BY ALL")
def _(spark, sf):
    """Per partition how often each source, state and label occurs, missing values named."""
    part = F.element_at(F.array(F.lit("train"), F.lit("development"), F.lit("calibration")), (F.substring("record_id", 2, 20).cast("bigint") % 3 + 1).cast("int"))
    rows = records(spark, sf).withColumn("partition", part)
    names = ["dataset", "file", "annotation_state", "bias_label"]
    long = rows.select("partition", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw")) for c in names])).alias("x")).select("partition", "x.*")
    return dataprep.value_counts(long, ["partition", "field"], "raw")


@query("a02_conflicts", f"WITH {Q_RECORDS} SELECT text_hash FROM recs GROUP BY text_hash HAVING count(DISTINCT bias_label) > 1 OR count(DISTINCT opinion_label) > 1")
def _(spark, sf):
    return dataprep.conflicts(records(spark, sf).select("text_hash", *[F.coalesce(c).alias(c) for c in LABELS]), LABELS)


@query("a03_dedupe", f"WITH {Q_CLEAN} SELECT record_id, ids FROM (SELECT text_hash, min(CASE WHEN excluded IS NULL THEN record_id END) AS record_id, array_to_string(list_sort(list(record_id)), ',') AS ids FROM clean WHERE excluded IS NULL OR excluded = 'global_duplicate' GROUP BY text_hash)")
def _(spark, sf):
    return dataprep.cleaned(records(spark, sf), LABELS).select("record_id", F.array_join("source_record_ids", ",").alias("ids"))


@query("a04_cleaning_stats", f"WITH {Q_CLEAN} SELECT coalesce(excluded, 'kept') AS outcome, count(*) AS n FROM clean GROUP BY 1")
def _(spark, sf):
    return dataprep.cleaning_steps(records(spark, sf), LABELS).groupBy(F.coalesce("excluded", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query("a05_support_gate", f"WITH {Q_RECORDS} SELECT count(*) FILTER (bias_label = 1) AS bias_positive, count(*) FILTER (opinion_label = 1) AS middle_opinion, count(*) FILTER (bias_label = 1) >= 500 AND count(*) FILTER (opinion_label = 1) >= 300 AS supported FROM recs")
def _(spark, sf):
    return dataprep.support_gate(records(spark, sf))


@query("a26_class_weights", "SELECT quality AS label, n, total / (k * n) AS weight FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality), (SELECT count(*)::double AS total, count(DISTINCT quality) AS k FROM labels WHERE quality IS NOT NULL)")
def _(spark, sf):
    return dataprep.class_weights(table(spark, sf, "labels").withColumnRenamed("quality", "label"), "label")


@query("a30_label_counts", f"SELECT CASE WHEN label = '' THEN '<missing>' WHEN label IN ({', '.join(map(q_lit, T.OPINION_TIERS))}) THEN label ELSE '<unrecognized>' END AS label, count(*) AS n FROM (SELECT {_Q_OPINION} AS label FROM documents) GROUP BY 1")
def _(spark, sf):
    label = F.nullif(T.opinion_label(F.expr(_RAW_OPINION)), F.lit(""))
    return table(spark, sf, "documents").groupBy(dataprep.known_label(label, T.OPINION_TIERS).alias("label")).agg(F.count("*").alias("n"))


Q_HALVES = f"{Q_RECORDS}, l AS (SELECT * FROM recs WHERE substr(record_id, 2)::bigint % 2 = 0), r AS (SELECT * FROM recs WHERE substr(record_id, 2)::bigint % 2 = 1)"


@query("j01_merge_annotations", f"WITH {Q_HALVES}, p AS (SELECT r.record_id AS right_id, count(*) AS n FROM r JOIN l ON r.text_hash = l.text_hash AND (r.canonical_url IS NULL OR l.canonical_url = r.canonical_url) GROUP BY 1) SELECT record_id AS right_id, coalesce(n, 0) = 1 AS matched FROM r LEFT JOIN p ON record_id = right_id")
def _(spark, sf):
    r = records(spark, sf)
    even = F.substring("record_id", 2, 20).cast("bigint") % 2 == 0
    return dataprep.merge_annotations(r.where(even), r.where(~even))[1]


@query("j02_partition_lookup", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    a = d.select("doc_id", F.element_at(F.array(*map(F.lit, dataprep.PARTITIONS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("partition"))
    return dataprep.rows_of_partition(d, a, "development", "doc_id").select("doc_id")


@query("j03_conflict_anti_join", f"WITH {Q_RECORDS} SELECT record_id FROM recs WHERE text_hash NOT IN (SELECT text_hash FROM recs GROUP BY text_hash HAVING count(DISTINCT bias_label) > 1 OR count(DISTINCT opinion_label) > 1)")
def _(spark, sf):
    r = records(spark, sf)
    return r.join(dataprep.conflicts(r, LABELS), "text_hash", "left_anti").select("record_id")


@query("j06_text_overlap", f"WITH {Q_RECORDS} SELECT count(*) AS overlap FROM (SELECT DISTINCT text_hash FROM recs WHERE dataset = 'BABE' INTERSECT SELECT text_hash FROM recs WHERE dataset = 'BASIL')")
def _(spark, sf):
    r = records(spark, sf)
    return r.where("dataset = 'BABE'").select("text_hash").intersect(r.where("dataset = 'BASIL'").select("text_hash")).agg(F.count("*").alias("overlap"))


@query("j13_label_ids", "SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::int AS lang_id FROM documents WHERE lang IS NOT NULL")
def _(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null")
    ids = d.select("lang").distinct().withColumn("lang_id", F.row_number().over(Window.orderBy("lang")) - 1)  # one row a label
    return d.join(F.broadcast(ids), "lang").select("doc_id", "lang_id")


@query("j14_stratified_split", "SELECT doc_id, CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'dev' ELSE 'test' END AS partition FROM (SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) - 1) / (count(*) OVER (PARTITION BY lang))::double AS place FROM documents)")
def _(spark, sf):
    return dataprep.hash_split(table(spark, sf, "documents"), "doc_id", ["lang"], [("train", 0.7), ("dev", 0.15), ("test", 0.15)], 42).select("doc_id", "partition")


@query("o02_leakage", f"WITH {Q_RECORDS}, k AS (SELECT DISTINCT dataset AS p, text_hash AS v FROM recs) SELECT 'text_hash' AS column, 'BABE' AS left_partition, 'BASIL' AS right_partition, count(*) AS shared, array_to_string(list_sort(list(a.v))[:10], ',') AS examples FROM k a JOIN k b USING (v) WHERE a.p < b.p HAVING count(*) > 0")
def _(spark, sf):
    return dataprep.leakage(records(spark, sf), ["text_hash"], "dataset").withColumn("examples", F.array_join("examples", ","))


@query("o03_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("o04_distinct", "SELECT DISTINCT source, lang FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct()


#: Hash of the digests ``h`` from their number and the sums of four slices.
Q_SUMS = "sha256(count(*) || " + " || ".join(f"':' || sum(('0x' || substr(h, {15 * i + 1}, 15))::bigint)" for i in range(4)) + ")"


def keyed_documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), F.sha2(T.sentences(F.col("text"))[0], 256).alias("opening")).join(table(spark, sf, "labels"), "doc_id", "left")


@query("g01_split_units", f"""WITH RECURSIVE k AS (SELECT doc_id, unnest(['text_hash:' || sha256({q_fold(q_collapse('text'))}), 'opening:' || sha256({q_cut('text')}[1])]) AS key FROM documents),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN (SELECT key, min(doc_id) AS doc_id FROM k GROUP BY key) b USING (key)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT w.node, s.b FROM w JOIN s ON w.seen = s.a), c AS (SELECT node AS doc_id, min(seen) AS comp FROM w GROUP BY node)
SELECT doc_id, unit_id FROM c JOIN (SELECT comp, 'unit:' || {Q_SUMS} AS unit_id FROM (SELECT DISTINCT comp, sha256(key) AS h FROM c JOIN k USING (doc_id) WHERE key IS NOT NULL) GROUP BY comp) USING (comp)""")
def _(spark, sf):
    return dataprep.split_units(keyed_documents(spark, sf), "doc_id", ["text_hash", "opening"])


FRACTIONS = {"train": 0.5, "development": 0.15, "calibration": 0.15, "locked_test": 0.2}


@query("g02_disjoint_split", "SELECT 0::bigint AS shared_keys, count(*) AS rows, true AS balanced FROM documents")
def _(spark, sf):
    """No key in two partitions, and each partition within 2 % of all rows of its share."""
    rows = keyed_documents(spark, sf)
    split = dataprep.split_manifest(rows, "doc_id", ["text_hash", "opening"], ["quality", "toxic"], FRACTIONS, 42)
    joined = rows.join(split, "doc_id")
    share = F.create_map(*[F.lit(x) for kv in FRACTIONS.items() for x in kv])[F.col("partition")]
    sizes = joined.groupBy("partition").agg(F.count("*").alias("n"))
    off = sizes.select(share.alias("share"), "n").crossJoin(sizes.agg(F.sum("n").alias("all"), F.count("*").alias("parts")))  # one row
    balanced = off.agg((F.max(F.abs(F.col("n") / F.col("all") - F.col("share"))) <= 0.02).alias("near"), F.max("parts").alias("parts")).select((F.col("near") & (F.col("parts") == 4)).alias("balanced"))
    return joined.agg(F.count("*").alias("rows")).crossJoin(dataprep.leakage(joined, ["text_hash", "opening"]).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("shared_keys"))).crossJoin(balanced)  # one row each


@query("g04_split_manifest")
def _(spark, sf):
    return dataprep.split_manifest(keyed_documents(spark, sf), "doc_id", ["text_hash", "opening"], ["quality", "toxic"], FRACTIONS, 42)


@query("a29_fingerprint", f"SELECT count(*) AS n, {Q_SUMS} AS fingerprint FROM (SELECT sha256('{{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}}') AS h FROM documents)")
def _(spark, sf):
    return dataprep.fingerprint(table(spark, sf, "documents"), ["doc_id", "lang"])
