"""Addresses and entities as Columns, against Python's own functions and tables of cases."""

import html
import random
from urllib.parse import quote, unquote_to_bytes, urljoin

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text, url

BASE = "http://a.org/b/c/d?q=1#f"


def _all(spark, make, values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} string" for k in range(len(values[0]))))
    out = df.select("i", make(*[F.col(f"c{k}") for k in range(len(values[0]))]).alias("o")).collect()
    return [r.o for r in sorted(out)]


def test_absolute_as_the_standard_says(spark):
    # the examples of RFC 3986, 5.4 (those with an empty address have no result here)
    given = ["g:h", "g", "./g", "g/", "/g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", ".", "./", "..", "../", "../g", "../..", "../../", "../../g",
        "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h"]
    got = _all(spark, url.absolute, [(v, BASE) for v in given])
    assert got == [urljoin(BASE, v) for v in given]


def test_absolute_cases(spark):
    cases = [
        ("//X.org/p", BASE, "http://x.org/p"), ("HTTPS://X.org", BASE, "https://x.org/"), ("/a&amp;b?x&#38;y", BASE, "http://a.org/a&b?x&y"), (r"\p\q", BASE, "http://a.org/p/q"),
        ("/%2e%2E/x/%2e/y", BASE, "http://a.org/x/y"), ("mailto:a@b.org", BASE, "mailto:a@b.org"), ("x", "no address", None), ("", BASE, None), (None, BASE, None), ("x", None, None),
        ("http://x.org/a/../b?c=../d#e/../f", BASE, "http://x.org/b?c=../d#e/../f"),
        ("https://x.org/a", None, "https://x.org/a"), ("img.png", "https://h.org:8080", "https://h.org:8080/img.png"), ("a:b/../c", BASE, "a:b/../c"), (" ../z ", BASE, "http://a.org/b/z"), ("//x.org", "nothing", None),
    ]
    assert _all(spark, url.absolute, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_percent_decoding(spark):
    def plain(p):
        try:
            if any(not (p[i + 1 : i + 3].isalnum() and len(p[i + 1 : i + 3]) == 2 and all(x in "0123456789abcdefABCDEF" for x in p[i + 1 : i + 3])) for i, x in enumerate(p) if x == "%"):
                return p
            return unquote_to_bytes(p).decode("utf-8")
        except UnicodeDecodeError:
            return p

    r = random.Random(3)
    given = ["/a+b%20c", "/%ED%95%9C%EA%B5%AD", "/%E0%A4", "/100%", "/%zz", "/%25", "/%FF", "/�", "/%EF%BF%BD", "", "/" + quote("한국 디자인 é"), "/%f0%9f%98%80"]
    given += ["".join(r.choice(["%", "%4", "a", "+", "%C3%A9", "%C3", "한", "%2F"]) for _ in range(6)) for _ in range(100)]
    assert _all(spark, url.decoded, [(g,) for g in given]) == [plain(g) for g in given]


def test_numeric_entities(spark):
    given = ["&#8217;&#x2019;", "a&#38;#39;b", "&#0;&#xD800;&#x110000;", "&#128512;", "&#xAC00; &amp; &#", "none", "", "&#9;x&#10;", "&#38&#38;"]
    want = ["’’", "a&#39;b", "&#0;&#xD800;&#x110000;", "\U0001f600", "가 &amp; &#", "none", "", "\tx\n", "&#38&"]
    assert _all(spark, text.decode_numeric, [(g,) for g in given]) == want
    assert html.unescape(given[3]) == want[3]
    assert _all(spark, text.decode_numeric, [(None,)]) == [None]


@pytest.mark.parametrize(
    ("a", "b", "shared"),
    [
        (("https://h.org/%ED%95%9C%EA%B5%AD-x", None, None, None), ("https://www.h.org/ko/한국-x/", None, None, None), {"p:h.org/한국-x"}),
        (("https://h.org/a", None, "https://news.org/1", None), ("https://news.org/1/", None, None, None), {"u:https://news.org/1"}),
        (("https://h.org/in/one-two-three-four-five-six?utm_source=x", None, None, None), ("https://m.h.org/work/one-two-three-four-five-six.html", None, None, None), {"s:h.org/one-two-three-four-five-six"}),
        ((None, "Four words of a long title", None, "Source"), ("", "four words of a LONG title!", None, "source"), {"t:source|four words of a long title"}),
        (("https://h.org/100%-x", None, None, None), ("https://h.org/100%-y", None, None, None), set()),
    ],
)
def test_keys_that_two_rows_share(spark, a, b, shared):
    one, two = _all(spark, url.identity_keys, [a, b])
    assert set(one) & set(two) == shared


def test_an_address_is_taken_apart_once_a_key(spark):
    made = spark.range(3).select(url.identity_keys(F.concat(F.lit("https://a.org/x/"), F.col("id").cast("string")), F.lit("a title"), F.lit("https://b.org/")).alias("k"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") < 60 and plan.count("https://a.org/x/") == 1
