"""Text, url and HTML functions against plain models."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltmill.functions import html, urls
from siltmill.functions import text as tx

CASES = ["", None, "A b", "naïve café", "x y z", "“Curly” don’t", "ﬁ ² ½", "é", "a_b-c 12", "  ", "one...two … three", "..."]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def model_norm(s):
    return " " + " ".join(re.findall(r"\w+", s.lower())) + " "


def test_norm_text(spark):
    got = column(spark, CASES, tx.norm_text)
    for s, g in zip(CASES, got, strict=True):
        if s is None or all(unicodedata.category(c)[0] in "LZPN" and c not in "²½" for c in s):
            assert g == model_norm(s or "")
    assert column(spark, ["ﬁ ²"], tx.nfkc) == ["fi 2"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aé .…-_1\n", max_size=20), min_size=1, max_size=20))
def test_quote_fragments(spark, values):
    want = [[model_norm(p) for p in re.split(r"\.\.\.|…", v) if re.findall(r"\w+", p)] for v in values]
    assert column(spark, values, tx.quote_fragments) == want


def test_words_and_dates(spark):
    assert column(spark, ["a b　c\x1cd", "", None], tx.word_count) == [4, 0, 0]
    assert column(spark, ["2026-04-06T01:02:03Z", "2026-4-6", None, "x"], tx.date_int) == [20260406, None, None, None]
    assert column(spark, [None, "", "  ​", "x"], tx.is_blank) == [True, True, True, False]
    assert column(spark, [None, " a\t\n b "], tx.squeezed) == ["", "a b"]


def test_questions(spark):
    q = ["Do I need a permit, and can I work while I wait?", "Only one part here please", "I moved here last year. Does that change anything for me? What fee do spouses pay?"]
    parts = column(spark, q, tx.question_parts)
    assert parts[0] == ["Do I need a permit", "can I work while I wait"] and parts[1] == []
    assert column(spark, ["does that change anything for me", "what fee do spouses pay monthly"], tx.is_vague) == [True, False]


def test_urls(spark):
    u = ["HTTPS://Ex.org/a/?utm_source=1&b=2&a=1&c=#f", " https://ex.org/a?x ", "https://EX.org", None, "https://ex.org/a;p?B=%20x"]
    assert column(spark, u, urls.normal_url)[0] == "https://ex.org/a?a=1&b=2"
    assert column(spark, u, urls.normal_url)[2:4] == ["https://ex.org/", None]
    assert column(spark, u, urls.page_url) == ["https://ex.org/a", "https://ex.org/a", "https://ex.org", None, "https://ex.org/a;p"]
    assert column(spark, u, urls.match_url)[1] == "https://ex.org/a" and column(spark, u, urls.match_url)[3] == ""
    assert column(spark, u, urls.host)[0] == "ex.org"


PAGE = """<html><head><title> T  t </title></head><body><nav><a href="/n">n</a></nav><main><h1>A</h1><p>x  y</p><p>x y</p>
<ul><li>one<li><p>two</p></ul><table><tr><td>a</td><td>b</td></tr></table><script>no</script><a href="b.html">b</a>
<time property="dateModified">2025-01-02</time></main></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "https://e.org/d/", PAGE), (2, None, None), (3, "u", "<p>plain &amp; open")], "k long, u string, h string")
    rows = {r["k"]: r for r in html.extract(df, "k", "u", "h").collect()}
    assert rows[1]["title"] == "T t" and rows[1]["date_modified"] == "2025-01-02"
    assert rows[1]["text"].split("\n") == ["# A", "x y", "- one", "- two", "two", "a | b"]
    assert rows[1]["links"] == ["https://e.org/d/b.html"]
    assert rows[2]["text"] == "" and rows[3]["text"] == "plain & open"
