"""Column functions on hand-made rows."""

from pyspark.sql import functions as F

from quillmark.functions import text, url, values
from quillmark.operators import curate, dedupe, ranges, select


def one(spark, column, **values_):
    frame = spark.createDataFrame([tuple(values_.values())], ", ".join(f"{k} string" for k in values_)) if values_ else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_canonical_url(spark):
    c = lambda u: one(spark, url.canonical(F.col("u")), u=u)
    assert c("http://WWW.Example.com:80/a/b//?utm_source=x&b=2&a=1&ref=z#top") == "https://example.com/a/b?a=1&b=2"
    assert c("https://example.com") == "https://example.com/"
    assert c("https://example.com:8443/") == "https://example.com:8443/"
    assert c("  not a url ") == "not a url"
    assert c("https://example.com/?LANG=ko") == "https://example.com/"
    assert one(spark, url.history_url(F.col("u")), u="ftp://example.com/a") == ""


def test_identity_keys(spark):
    k = lambda u, t: set(one(spark, url.identity_keys(F.col("u"), F.col("t")), u=u, t=t))
    a = k("https://m.site.com/ko/work/a-very-long-story-about-things.html", "Some title that is long enough to be a key")
    assert "p:site.com/work/a-very-long-story-about-things.html" in a and "s:site.com/a-very-long-story-about-things" in a
    assert "t:site.com|some title that is long enough to be a key" in a
    assert {x[0] for x in k("https://site.com/a/12", "short")} == {"u", "p"}
    assert {x[0] for x in k("https://site.com/", "short")} == {"u"}
    assert "t:site.com|a long enough story about many small things" in k("https://site.com/x", "A long enough story about many small things - Site Magazine")


def test_hosts(spark):
    assert one(spark, url.host_suffixes(F.col("h")), h="a.b.c.com") == ["a.b.c.com", "b.c.com", "c.com"]
    assert one(spark, url.host(F.col("h")), h="nothing") is None


def test_texts(spark):
    html = "<html><script>x()</script><style>p{}</style><article><p>Tom &amp; &quot;Eve&quot;</p></article></html>"
    assert one(spark, text.strip_html(F.col("h")), h=html) == 'Tom & "Eve"'
    assert one(spark, text.title_key(F.col("t")), t="Big Things! - Dezeen") == "big things"
    assert one(spark, text.title_tokens(F.col("t"), F.array(F.lit("the"))), t="The 2024 plan, the PLAN of 12024") == ["plan", "of", "12024"]
    assert one(spark, text.snippet(F.col("t"), ["needle"]), t="x" * 200 + "needle" + "y" * 400).startswith("...x")
    assert one(spark, text.has_term(F.col("t"), "ai"), t="ai시대") is True
    assert one(spark, text.has_term(F.col("t"), "ai"), t="paint") is False
    assert one(spark, text.clean_feed(F.col("t")), t="Good text. The post A appeared first on B.") == "Good text."
    assert one(spark, text.clean_feed(F.col("t")), t="[보기] 글 [더 읽기]") == "글"
    assert one(spark, text.clean_feed(F.col("t")), t="좋은 글이다. 제목 | 잡지 에 처음 등장했습니다.") == ""
    assert one(spark, text.same_meaning(F.col("a"), F.col("b")), a="A-B c", b="xx abc yy") is True
    assert one(spark, text.loose_json(F.col("t"), "a int"), t='```json\n{"a": 3}\n```')["a"] == 3


def test_values(spark):
    assert one(spark, values.kst_day(F.lit("2024-01-01 15:00:00").cast("timestamp")).cast("string")) == "2024-01-02"
    assert one(spark, values.kst_day(F.lit("2024-01-01 14:59:59").cast("timestamp")).cast("string")) == "2024-01-01"
    assert one(spark, values.quantised(F.array(F.lit(-2.5 / 400), F.lit(1.0), F.lit(-1.0)))) == [-2, 127, -127]
    assert one(spark, values.webkit_timestamp(F.lit("13253760000000000")).cast("string")) == "2020-12-30 00:00:00"  # 1609286400 s after 1970
    assert one(spark, values.lenient_timestamp(F.col("t")).isNull(), t="no date") is True
    assert one(spark, values.lenient_timestamp(F.col("t")).cast("string"), t="Tue, 05 Mar 2024 10:00:00 +0000") == "2024-03-05 10:00:00"


def test_last_value_first_position(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, pos long, v string")
    assert sorted(map(tuple, dedupe.first_position_last_value(df, "k", "pos").collect())) == [("a", 1, "z"), ("b", 2, "y")]


def test_earlier_keys(spark):
    df = spark.createDataFrame([(1, ["k1"]), (2, ["k2"]), (3, ["k1", "k2"]), (4, ["k9"])], "id long, keys array<string>")
    got = {r.id: r.dropped for r in dedupe.shares_earlier_key(df, "keys", ["id"], "id").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_unique_texts(spark):
    df = spark.createDataFrame([(1, "t", "a"), (2, "t", "a"), (3, "t", "a"), (4, "u", "b")], "id long, t string, extra string")
    got = {r.id: r.t for r in dedupe.unique_texts(df, "t", ["id"], ["extra"]).collect()}
    assert got[1] == "t" and got[2] == "t (a)" and len(set(got.values())) == 4


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-02")], "id long, v string, day string")
    new = spark.createDataFrame([(2, None, "2024-01-02"), (3, "c", "2024-01-02")], "id long, v string, day string")
    assert {r.id: r.v for r in dedupe.upsert(old, new, "id").collect()} == {1: "a", 2: "b", 3: "c"}
    assert sorted(r.id for r in dedupe.replace_days(old, new).collect()) == [1, 2, 3]


def test_selections(spark):
    items = spark.createDataFrame([("a", i, i, "s1" if i < 6 else "s2") for i in range(10)] + [("b", 20, 20, "s1")], "lane string, pos long, id long, source string")
    got = [r.id for r in select.select_balanced(items, ["a", "b"], 4, 2).orderBy("rank").collect()]
    assert got == [0, 20, 6, 7]
    rr = select.round_robin(items.select("id", "lane", "pos"), "lane", "pos", 4)
    assert [r.id for r in rr.collect()] == [0, 20, 1, 2]


def test_novel(spark):
    data = [("t", 0, 0, "s", "one", ["u:1"], ["big", "red", "dog", "x"]), ("t", 1, 1, "s", "one", ["u:2"], ["a"]), ("t", 2, 2, "s2", "two", ["u:1"], ["b"]),
            ("t", 3, 3, "s3", "three", ["u:3"], ["big", "red", "dog"]), ("t", 4, 4, "s", "four", ["u:4"], ["c"]), ("t", 5, 5, "s4", "five", ["u:5"], ["d"])]
    df = spark.createDataFrame(data, "tab string, pos long, id long, source string, title_key string, keys array<string>, words array<string>")
    assert [r.id for r in select.select_novel(df, 10, 1).orderBy("rank").collect()] == [0, 5]
    assert [r.id for r in select.select_novel(df, 10, 1, loose_per_source=2).orderBy("rank").collect()] == [0, 5, 4]


def test_novel_and_merge_as_plain_loops(spark):
    """Random candidates, with blocks smaller than a group, against loops over rows in order."""
    import random

    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), r.randrange(40), i, r.choice(["s1", "s2", "s3", None]), r.choice(["", None, *map(str, range(30))]),
             [f"k{r.randrange(60)}" for _ in range(r.randrange(3))], [r.choice("abcdefghi") for _ in range(r.randrange(6))]) for i in range(150)]
    df = spark.createDataFrame(data, "tab string, pos long, id long, source string, title_key string, keys array<string>, words array<string>")

    def novel(limit, caps):
        want = []
        for tab in ("a", "b", None):
            chosen, order = [], sorted((x for x in data if x[0] == tab), key=lambda x: (x[1], x[2]))
            for cap in caps:
                for x in order:
                    full = len(chosen) >= limit or sum(c[3] == x[3] for c in chosen) >= cap
                    same = any(set(x[5]) & set(c[5]) or x[4] and x[4] == c[4] for c in chosen)
                    near = any(len(set(x[6]) & set(c[6])) >= max(3, 0.6 * min(len(set(x[6])), len(set(c[6])))) for c in chosen)
                    if x[5] and not (full or same or near):
                        chosen.append(x)
            want += [(tab, c[2], i + 1) for i, c in enumerate(chosen)]
        return sorted(want, key=str)

    for limit in (1, 12):
        got = select.select_novel(df, limit, 1, 0.6, loose_per_source=3).collect()
        assert sorted(map(tuple, got), key=str) == novel(limit, (1, 3))
    assert select.select_novel(df.where("false"), 3, 1).count() == 0

    rows = [(r.choice(["a", None]), r.randrange(50), i, r.choice(["", *(f"u{k}" for k in range(70))]), r.choice(["", None, *map(str, range(50))])) for i in range(300)]
    cols = "tab string, pos long, id long, url_key string, title_key string"
    new, old = [x for x in rows if x[2] % 4 == 0], [x for x in rows if x[2] % 4]
    seen, want = set(), []
    for x in sorted(new, key=lambda x: x[1:3]) + sorted(old, key=lambda x: x[1:3]):
        mine = {("u", x[0], x[3])} | ({("t", x[0], x[4])} if x[4] else set())
        if x[3] and not mine & seen:
            seen |= mine
            want.append((x[0], x[2]))
    got = curate.merge_archives(spark.createDataFrame(new, cols), spark.createDataFrame(old, cols), "tab").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert curate.merge_archives(spark.createDataFrame([], cols), spark.createDataFrame([], cols), "tab").count() == 0


def test_range_join(spark):
    p = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    i = spark.createDataFrame([(2.0, 5.0, "a"), (4.5, 19.0, "b")], "lo double, hi double, n string")
    got = sorted((r.v, r.n) for r in ranges.range_join(p, i, "v", "lo", "hi", 3.0).collect())
    assert got == sorted([(float(v), "a") for v in range(2, 5)] + [(float(v), "b") for v in range(5, 19)])


def test_clean_feed_leaves_plain_texts_at_one_scan(spark):
    """Each pattern in turn says the same, and a long text without a tail costs little."""
    import time

    said = [
        "a  b \n c ", " x", "", None, "The post On |y appeared first on Some Site.", "it APPEARED FIRST ON x. More", "a | Site 에 처음 등장했습니다. b", "Site에 처음 등장했습니다",
        "[Watch] me [Read more] [자세히 읽기] [더 읽기] [보기] […] [...] [watch]", "go Continue reading …", "Read more", "Read mo[Watch]re", "| 에 처음 등장", "appeared [Watch]first on x",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string")
    want = F.col("t")
    for pattern in text.FEED_TAILS:
        want = F.regexp_replace(want, pattern, "")
    want = F.trim(F.regexp_replace(want, text.SPACE, " "))
    got = df.select("i", text.clean_feed(F.col("t")).alias("got"), want.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    long = spark.range(1).select(F.repeat(F.lit("word | of a text "), 100_000).alias("t"))
    text_of = lambda f: long.select(F.length(f(F.col("t")))).first()
    text_of(text.clean_feed)
    start = time.monotonic()
    text_of(text.clean_feed)
    assert time.monotonic() - start < 1.5


def test_evidence_sentence_ties_go_to_the_earlier(spark, tmp_path):
    """The sentences n and n + 20 have equal scores, at any n."""
    from quillmark.plans import documents

    short, middle, long = "x", "m" * 40, "l" * 100
    texts = [(n, ". ".join([short] * n + [middle] + [short] * 19 + [long])) for n in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = documents.evidence_sentence(spark, str(tmp_path)).collect()
    assert len(got) == 30 and {r.evidence for r in got} == {middle}


def test_the_beginning_of_a_feed_summary(spark):
    import random

    r, signs = random.Random(2), ["[Read More]", " Appeared first on x. ", "[", "... continue reading", "\ufeff\n ", " " * 30, "word", " ", "[…]", "에 처음 등장했습니다"]
    texts = [None, "", *("".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(text.clean_feed(F.col("t"), 8).alias("a"), F.left(text.clean_feed(F.col("t")), F.lit(8)).alias("b")).collect()
    assert [x.a for x in got] == [x.b for x in got]
