"""Sources and sinks on hand-made files."""

import json

from pyspark.sql import functions as F

from quillmark.operators import curate, quality
from quillmark.plans import sources
from quillmark.sources import feeds, registry_files
from quillmark.streaming import streams

RSS = """<rss><channel><title>Site</title>
<item><title><![CDATA[One &amp; all]]></title><link>/a/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate>
<description>&lt;p&gt;Text. The post One appeared first on Site.&lt;/p&gt;</description><enclosure url="https://img.example.com/1.jpg"/></item>
<item><title>Two</title><guid>https://example.com/b</guid><pubDate>no date</pubDate><content:encoded><![CDATA[<img src="https://img.example.com/2.png"> words]]></content:encoded></item>
<item><title></title><link>https://example.com/c</link></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed><entry><title>Three</title><link rel="self" href="https://example.com/self"/><link rel="alternate" href="https://example.com/d"/>
<updated>2024-03-05T10:00:00Z</updated><summary>S</summary></entry></feed>"""


def test_feeds(spark):
    landed = spark.createDataFrame([("s", "https://example.com/feeds/x.xml", RSS), ("t", "https://example.com/atom", ATOM), ("u", "https://e.com", "not xml"), ("v", None, None)], "source string, feed_url string, xml string")
    got = {r.title: r for r in feeds.parse_feeds(landed).collect()}
    assert set(got) == {"One & all", "Two", "Three"}
    assert got["One & all"].url == "https://example.com/a/1" and got["One & all"].summary == "Text." and got["One & all"].image.endswith("1.jpg")
    assert got["Two"].url == "https://example.com/b" and got["Two"].date is None and got["Two"].image.endswith("2.png")
    assert got["Three"].url == "https://example.com/d" and str(got["Three"].date) == "2024-03-05 10:00:00"


def test_landed_pages_are_bounded(spark, sf, monkeypatch):
    monkeypatch.setattr(sources, "PAGE", 20)
    for landed, column, block in ((sources._feeds, "xml", "</item>|</entry>"), (sources._sitemaps, "xml", "</url>"), (sources._posts, "json", '"rendered":')):
        n = landed(spark, sf).select(F.regexp_count(column, F.lit(block)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        assert 0 < n[0] <= 20 < n[1]


def test_first_full_feed(spark):
    items = spark.createDataFrame([("s", "f2", "x"), ("s", "f3", "y")], "source string, feed_url string, title string")
    order = spark.createDataFrame([("s", 0, "f1"), ("s", 1, "f2"), ("s", 2, "f3")], "source string, feed_pos int, feed_url string")
    assert [r.title for r in feeds.first_full_feed(items, order).collect()] == ["x"]


def test_posts_and_sitemaps(spark):
    post = [{"title": {"rendered": "A &amp; B"}, "link": "https://e.com/1", "date_gmt": "2024-03-05T10:00:00", "excerpt": {"rendered": "<p>x</p>"}}, {"title": {"rendered": ""}, "link": "https://e.com/2"}]
    p = feeds.parse_posts(spark.createDataFrame([("s", json.dumps(post)), ("s", "broken")], "source string, json string")).collect()
    assert [(r.title, r.url, r.summary) for r in p] == [("A & B", "https://e.com/1", "x")]
    m = "<urlset><url><loc>https://e.com/a</loc><lastmod>2024-01-02</lastmod></url><sitemap><loc>https://e.com/s.xml</loc></sitemap></urlset>"
    got = {r.url: (r.is_index, r.modified is None) for r in feeds.parse_sitemaps(spark.createDataFrame([(m,)], "xml string")).collect()}
    assert got == {"https://e.com/a": (False, False), "https://e.com/s.xml": (True, True)}


def test_registry(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps({"sources": [{"id": "a", "name": "A", "url": "https://a.com/", "category": "film", "feedUrls": ["f1", "f2"], "jsonUrls": ["j"]}, {"id": "b", "name": "B", "url": "https://www.b.com"}]}))
    s = registry_files.read_sources(spark, str(path))
    assert [(r.source, r.feed_pos, r.feed_url) for r in registry_files.feeds_of(s).orderBy("source", "feed_pos").collect()] == [("a", 0, "f1"), ("a", 1, "f2"), ("a", 2, "j")]
    assert {r.id: (r.host, r.kind) for r in registry_files.verified_items(s).collect()} == {"a": ("a.com", "video"), "b": ("b.com", "web")}


def test_bookmarks(spark):
    nodes = [("1", None, "root", "folder", None, None), ("2", "1", "up", "folder", None, None), ("3", "2", "deep", "folder", None, None), ("4", "3", "A", "url", "https://a.com/x", "13253760000000000"),
             ("5", "1", "B", "url", "https://b.com/", "13253760000000000"), ("6", "2", "login", "url", "https://c.com/login", "13253760000000000")]
    df = spark.createDataFrame(nodes, "node_id string, parent_id string, name string, type string, url string, added string")
    got = registry_files.bookmarks(spark, df, ["up"]).collect()
    assert [(r.title, r.folder, r.path) for r in got] == [("A", "up", "up/deep/A")]


def test_archive_days(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = lambda day, ids: spark.createDataFrame([("u", day, i) for i in ids], "tab string, day string, id long")
    registry_files.write_archive(rows("2024-01-01", [1, 2]).union(rows("2024-01-02", [3])), path)
    registry_files.write_archive(rows("2024-01-02", [4, 5]), path)
    assert sorted(r.id for r in registry_files.read_archive(spark, path, "u").collect()) == [1, 2, 4, 5]
    s = registry_files.archive_summary(registry_files.read_archive(spark, path)).first()
    assert (s["items"], s["days"]) == (4, 2)


def test_reused_vectors(spark):
    docs = spark.createDataFrame([(1, "h1", "d1"), (2, "h2", "d2"), (3, "h3", "d3")], "id long, h string, day string")
    old = spark.createDataFrame([(1, "h1", [1.0]), (2, "other", [2.0])], "id long, h string, embedding array<double>")
    got = {r.id: (r.embedding, r.embed) for r in registry_files.reused_vectors(docs, old, 1).collect()}
    assert got == {1: ([1.0], False), 2: (None, False), 3: (None, True)}


def test_link_tiers(spark):
    p = spark.createDataFrame([("https://a.com/x/y", 200, None), ("https://b.com/", 403, None), ("https://c.com/x/y", None, "timeout")], "url string, status int, error string")
    t = feeds.tiers(feeds.link_status(p), spark.createDataFrame([("a.com",)], "host string"))
    assert {r.host: (r.health, r.tier) for r in t.collect()} == {"a.com": ("reachable", "A"), "b.com": ("restricted", "B"), "c.com": ("timeout", "C")}


def test_assertions_and_quarantine(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    got = {r.check_id: r.ok for r in quality.assertions(df, [("n", F.count("*"), ">=", 2), ("nulls", F.count_if(F.col("v").isNull()), "=", 0)]).collect()}
    assert got == {"n": True, "nulls": False}
    sound, bad = quality.quarantine(df, [("missing", F.col("v").isNull())])
    assert [r.k for r in sound.collect()] == ["a"] and [(r.k, r.defects) for r in bad.collect()] == [("b", ["missing"])]


def test_merge_archives(spark):
    cols = "tab string, pos long, id long, url_key string, title_key string"
    new = spark.createDataFrame([("t", 0, 1, "u1", "a"), ("t", 1, 2, "u1", "b"), ("t", 2, 3, "u3", "")], cols)
    old = spark.createDataFrame([("t", 0, 4, "u4", "b"), ("t", 1, 5, "u5", "a"), ("t", 2, 6, "", "z"), ("t", 3, 7, "u7", "")], cols)
    # row 2 goes by its address, so its title b is free for row 4; row 5 goes by its title; row 6 has no address
    assert sorted(r.id for r in curate.merge_archives(new, old, "tab").collect()) == [1, 3, 4, 7]


def test_streams(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 16:00:00")], "id long, ts string").select("id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("id long, ts timestamp").parquet(src)
    once = streams.deduplicated(stream, ["id"], "ts", "1 hour").withColumn("day", F.to_date(F.from_utc_timestamp("ts", "Asia/Seoul")).cast("string"))
    streams.write_days(once, out, check).awaitTermination()
    assert sorted((r.id, str(r.day)) for r in spark.read.parquet(out).collect()) == [(1, "2024-01-01"), (2, "2024-01-02")]
    # a further row of a day that is there already
    spark.createDataFrame([(3, "2024-01-01 17:00:00")], "id long, ts string").select("id", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(src)
    streams.write_days(once, out, check).awaitTermination()
    assert sorted((r.id, str(r.day)) for r in spark.read.parquet(out).collect()) == [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")]


def test_publish_guard_and_freshness(spark):
    from quillmark.operators import publish, tabs

    items = spark.createDataFrame([("a", "2024-01-01", True), ("a", "2024-01-02", None), ("b", "2024-01-02", False)], "tab string, day string, keep boolean")
    now = publish.tab_report(items, "tab", "day", F.col("keep"))
    assert {(r.tab, r["items"], r.read, r.kept, r.latest) for r in now.collect()} == {("a", 2, 1, 1, "2024-01-02"), ("b", 1, 1, 0, "2024-01-02")}
    before = now.withColumn("items", F.col("items") + 1).withColumn("latest", F.lit("2024-01-03"))
    assert {(r.tab, tuple(r.failures)) for r in publish.publish_guard(now, before, "tab").collect()} == {("a", ("items dropped", "latest went back")), ("b", ("items dropped", "latest went back"))}
    named = spark.createDataFrame([("a",), ("b",), ("c",)], "tab string")
    assert {r.tab: r.level for r in publish.freshness(items, named, "tab", "day", F.lit("2024-01-02"), 1).collect()} == {"a": "ok", "b": "ok", "c": "error"}
    read = spark.createDataFrame([("s", False, 1, "2024-01-01")] * 9, "source string, keep boolean, sharpness int, day string")
    status = lambda today: tabs.source_status(read, "source", F.lit(today).cast("date")).first().status
    assert (status("2024-01-20"), status("2024-03-01")) == ("demoted", "watch")
