"""Text, URL and score functions against values worked out by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from textloom.functions import scores as S
from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.operators.corpus import POINT_NAMESPACE


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [
    ("https://Example.com/article/1?utm_source=test", "https://example.com/article/1"), ("http://example.com:80", "http://example.com/"), ("https://user:pw@example.com:8443/a#b", "https://example.com:8443/a"),
    ("https://example.com/?b=2&a=1&fbclid=x", "https://example.com/?a=1&b=2"), ("ftp://example.com/x", None), ("not a url", None), ("", None),
    ("https://example.com/?t=YQ==&u=b=c", "https://example.com/?t=YQ%3D%3D&u=b%3Dc"), ("https://example.com/?q=a+b&q=%41&r&=x&&s=", "https://example.com/?=x&q=A&q=a+b&r=&s="),
    ("https://example.com/a?x=%zz&y=100%&z=*~/:é", "https://example.com/a?x=%25zz&y=100%25&z=%2A~%2F%3A%C3%A9"), ("https://example.com/?UTM_Source=1&utm%5Fx=2&Fbclid=3&k=4", "https://example.com/?k=4"),
    ("https://example.com:0443/a b/c|d?e=f#g?h", "https://example.com/a b/c|d?e=f"), ("https://example.com:99999/", None), ("https://example.com:x/", None), ("https://example.com:/", "https://example.com/"),
    ("http://[2001:DB8::1]:8080/x", "http://2001:db8::1:8080/x"), ("ｈｔｔｐｓ://Example.com/ﬁ", "https://example.com/fi"), ("https:///x", None), ("https://example.com?b=1", "https://example.com/?b=1"),
])
def test_article_url(spark, raw, want):
    assert one(spark, U.article_url(F.lit(raw))) == want


def test_document_and_web_urls(spark):
    assert one(spark, U.document_url(F.lit("https://WWW.Example.com./a?gclid=1&x=2"))) == "https://www.example.com/a?x=2"
    assert one(spark, U.document_url(F.lit("http://example.com/a"))) is None
    assert one(spark, U.document_url(F.lit("https://u@example.com/a"))) is None
    assert one(spark, U.web_url(F.lit("https://example.com/a?z=1&b=2#c"))) == "https://example.com/a?z=1&b=2"
    assert one(spark, U.domain_of(F.lit("https://user@www.Example.com:443/x"))) == "example.com"
    assert one(spark, U.domain_matches(F.lit("a.b.gov"), F.lit("b.gov"))) and not one(spark, U.domain_matches(F.lit("ab.gov"), F.lit("b.gov")))


def test_normal_forms(spark):
    assert one(spark, T.normalize_text(F.lit("  ﬁne \n\t x "))) == "fine x"
    assert one(spark, T.normalize_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.casefold_exact(F.lit("Straße"))) == "strasse" == one(spark, T.casefold(F.lit("Straße")))
    assert one(spark, T.casefold(F.lit("ŒUVRE Ǆ ﬀ Σς"))) == "œuvre ǆ ff σσ" and one(spark, T.casefold(F.lit(None).cast("string"))) is None
    assert one(spark, T.text_hash(F.lit("ﬁne ½ Straße"))) == one(spark, T.text_hash(F.lit("FINE 1⁄2  STRASSE")))
    assert one(spark, T.bias_label(F.lit("Ｂｉａｓｅｄ"))) == "Biased" and one(spark, T.classifier_input(F.lit("ﬁ"))) == "[TARGET]\nfi"
    assert one(spark, T.text_hash(F.lit("A  b"))) == one(spark, T.text_hash(F.lit("a B"))) and one(spark, T.content_hash(F.lit("A b"))) != one(spark, T.content_hash(F.lit("a b")))


@pytest.mark.parametrize("raw,label,number", [(" entirely  FACTUAL ", "Entirely factual", 0), ("Expresses writer’s opinion", "Expresses writer's opinion", 2), ("expresses writer＇s opinion", "Expresses writer's opinion", 2), ("No agreement", "No agreement", None)])
def test_opinion_labels(spark, raw, label, number):
    got = T.opinion_label(F.lit(raw))
    assert one(spark, got) == label and one(spark, T.opinion_id(got)) == number
    assert one(spark, T.style_id(got)) == {0: 0, 2: 1, None: None}[number]


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit('He said no. "Why?" she asked. 3 came. end'))) == ["He said no.", '"Why?" she asked.', "3 came. end"]
    assert one(spark, T.sentences(F.lit("  "))) == [] and one(spark, T.sentences(F.lit("no end"))) == ["no end"]
    assert one(spark, T.paragraph_sentences(F.lit("Menu\n\nA b. C d.\n"))) == ["Menu", "A b.", "C d."]


@pytest.mark.parametrize("text,reason", [("Menu", "too_short"), ("Subscribe now!", "boilerplate_keyword"), ("Accept all cookies " + "to go on reading this page " * 8, "boilerplate_keyword"), ("The report, sent in a newsletter to several thousand readers across the whole country this week, names three officials who had known of it for years.", None), ("© 2024 Somebody", "boilerplate_keyword")])
def test_boilerplate(spark, text, reason):
    assert one(spark, T.boilerplate_reason(F.lit(text))) == reason


def test_compact_query(spark):
    assert one(spark, T.compact_query(F.lit("The Report said that THE report shows it's Rising, rising by 7% in 2024 there"))) == "The Report shows it's Rising"


def test_chunks(spark):
    got = one(spark, T.chunk_words(F.lit("One two three four five six"), 3, 1))
    assert [(c["start_word"], c["end_word"]) for c in got] == [(0, 3), (2, 5), (4, 6)] and got[2]["chunk"] == "five six"
    assert one(spark, T.chunk_words(F.lit(" "), 3, 1)) == []
    with pytest.raises(ValueError):
        T.chunk_words(F.lit("x"), 3, 3)


def test_point_id_is_a_version_5_uuid(spark):
    for name in ("chunk_1", "ä", ""):
        assert one(spark, T.point_id(POINT_NAMESPACE)(F.lit(name))) == str(uuid.uuid5(POINT_NAMESPACE, name))


def test_json_and_bytes():
    assert T.json_list('```json\n[{"a": 1}]\n```') == [{"a": 1}] and T.json_list("so: [1, 2] ok") == [1, 2] and T.json_list('{"a": 1}') == [] and T.json_list("") == []
    assert T.decode_bytes("é".encode(), None) == "é" and T.decode_bytes(b"\xe9", "utf-8") == "é" and T.decode_bytes(b"a", "no-such") == "a"


def test_dates_and_types(spark):
    assert one(spark, T.iso_utc(F.lit("2024-03-01"))) == "2024-03-01T00:00:00Z" and one(spark, T.iso_utc(F.lit("2024-03-01T10:00:00+02:00"))) == "2024-03-01T08:00:00Z" and one(spark, T.iso_utc(F.lit("x"))) is None
    assert one(spark, T.mime_type(F.lit(" Text/HTML ; charset=utf-8"))) == "text/html" and one(spark, T.charset(F.lit("text/html; charset='UTF-8'"))) == "utf-8"


def test_scores(spark):
    assert round(one(spark, S.wilson_lower(F.lit(182), F.lit(199))), 3) == 0.876 and one(spark, S.wilson_lower(F.lit(0), F.lit(0))) == 0
    assert [one(spark, S.bucket(F.lit(float(x)))) for x in (0, 20, 45, 70)] == ["Low", "Moderate", "High", "Severe"]
    assert one(spark, S.signal(F.lit(1.0), F.lit(None).cast("double"))) == 0.65
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0))))


def test_classifier_input(spark):
    assert one(spark, T.classifier_input(F.lit(" a  b "))) == "[TARGET]\na b"
    with pytest.raises(Exception, match="must not be empty"):
        one(spark, T.classifier_input(F.lit(" ")))


def test_alias_resolution():
    assert T.first_existing(["a", "text"], "body", ["text"]) == "text" and T.first_existing(["a"], None, ["b"]) is None
    with pytest.raises(ValueError):
        T.first_existing(["a"], None, ["b"], required=True)
    assert T.ordered_labels(["z", "b", "a"], ["b", "c"]) == ["b", "a", "z"]


def test_time_follows_text_length(spark):
    """Words are split once, not for every window or word."""
    import time

    def took(n):
        df = spark.range(1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word"), i.cast("string")))).alias("t"))
        began = time.time()
        (r,) = df.select(T.chunk_words(F.col("t")).alias("c"), T.compact_query(F.col("t")).alias("q")).collect()
        assert r["c"][-1]["end_word"] == n and r["q"].split()[0] == "word1" and len(r["q"].split()) == 14
        return time.time() - began

    took(1000)
    assert took(120_000) < 8
