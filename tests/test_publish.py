"""Archive writes, history, guards, unique texts, the site export and sitemap trees against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillmark.operators import dedupe, publish, tabs
from quillmark.sources import crawl, site, versions

ITEM = "tab string, day string, pos long, id string, url string, title string, note string"


def test_archive_write_as_a_plain_loop(spark):
    r = random.Random(6)
    row = lambda k: (r.choice(["a", "b", None]), f"2024-01-0{r.randint(1, 3)}", k, f"i{r.randrange(40)}", r.choice([None, "", *(f"https://e.com/{i}" for i in range(30))]),
                     r.choice([None, "", *(f"Title {i}" for i in range(25))]), r.choice(["same", "other", None]))
    old, new = [row(k) for k in range(60)], [row(k) for k in range(40)]
    for replace in (False, True):
        want = []
        for tab in ("a", "b", None):
            mine = [x for x in sorted((x for x in new if x[0] == tab), key=lambda x: x[2])][:12]
            mine = [x for x in mine if x[4]]
            kept_old = [x for x in old if x[0] == tab and x[4] and not (replace and x[1] in {y[1] for y in mine})]
            urls, titles, rows = set(), set(), []
            for part, x in [(0, x) for x in mine] + [(1, x) for x in sorted(kept_old, key=lambda x: x[2])]:
                key = (x[5] or "").lower()
                if x[4] in urls or key and key in titles:
                    continue
                urls.add(x[4])
                titles.add(key)
                rows.append((part, x))
            days = defaultdict(int)
            for _, x in rows:
                days[x[1]] += 1
                if days[x[1]] <= 4:
                    want.append(x)
        got = publish.archived(spark.createDataFrame(old, ITEM), spark.createDataFrame(new, ITEM), snapshot=12, replace_days=replace, most=4)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    unique = publish.archived(spark.createDataFrame(old, ITEM), spark.createDataFrame(new, ITEM), unique="note").collect()
    notes = [x.note for x in unique if x.note]
    assert len(notes) == len(set(notes)) and len(unique) > 10
    nothing = spark.createDataFrame([], ITEM)
    assert publish.archived(nothing, nothing).count() == 0 and publish.archived(nothing, spark.createDataFrame(new[:5], ITEM)).count() <= 5


def test_history_once_a_key(spark):
    cols = "url string, title string, seen int"
    old = spark.createDataFrame([("u1", "a", 1), ("u1", None, 2), (None, "x", 1)], cols)
    new = spark.createDataFrame([("u1", "b", 5), ("u1", None, 6), ("u2", "c", 1), (None, "y", 2), ("u2", "c", 1)], cols)
    assert sorted(map(tuple, publish.upserted_history(old, new, "url", "seen").collect())) == [("u1", "b", 6), ("u2", "c", 1)]
    assert publish.upserted_history(old.limit(0), new.limit(0), "url").count() == 0


def test_guard_sees_vanished_tabs(spark):
    cols = "tab string, day string, keep boolean, id string"
    before = publish.tab_report(spark.createDataFrame([("a", "2024-01-01", True, "1"), ("gone", "2024-01-01", True, "2")], cols), "tab", "day", F.col("keep"))
    items = spark.createDataFrame([("a", "2024-01-01", True, "1"), ("a", None, None, "1"), ("new", "2024-01-02", None, ""), (None, "2024-01-02", None, None)], cols)
    now = publish.tab_report(items, "tab", "day", F.col("keep"), "id")
    got = {r.tab: r.failures for r in publish.publish_guard(now, before, "tab", least=2).collect()}
    assert got == {"a": ["repeated ids"], "gone": ["tab vanished"], "new": ["too few items", "empty ids"], None: ["too few items", "empty ids"]}
    assert publish.reads_dropped(now, before).first().dropped is True and publish.reads_dropped(now, now).first().dropped is False


def test_update_reasons(spark):
    terms = tabs.UpdateTerms(("interview",), ("film", "design"), ("how",), ("poster",), ("grid",), (r"\bcoupon\b",), (r"\bopen call\b",))

    def score(title, summary, address=""):
        df = spark.createDataFrame([(title, summary, address)], "t string, s string, u string")
        return df.select(tabs.update_score(tabs.update_words(F.col("t"), F.col("s"), F.col("u")), F.col("s"), F.lit(True), F.lit(1), F.lit(False), terms).alias("x")).first().x

    long = "how a film design was made, and how it went on from there until it was done and shown to all of us"
    soft = score("A film design", long)
    assert soft.eligible and soft.score >= 35 and soft.rejected == soft.soft == ["outside-creative-practice", "no-creative-point-of-view"]
    assert score("A film design", long, "https://e.com/open-call").eligible and not score("A film design", long, "https://e.com/?x=open call").eligible
    assert score("A coupon film design", long).rejected[0] == "commercial-noise" and not score("A coupon film design", long).eligible
    assert not score("A coupon-film design", long).eligible and score("A couponä film design", long).rejected[0] == "commercial-noise"  # edges are of plain letters
    assert score(None, None).rejected[:1] == ["insufficient-evidence"] and not score(None, None).eligible


def test_unique_texts_as_a_plain_loop(spark):
    r = random.Random(9)
    for _ in range(3):
        data = [(i, r.choice(["t", "t (a)", "t (b)", "t (#2)", "u", "t (#3)", "", None, "t (a) (b)"]), r.choice(["a", "b", "", None]), r.choice(["b", "c", None])) for i in range(70)]
        seen, want = set(), {}
        for i, t, x, y in data:
            if not t:
                want[i] = t
                continue
            tries = [t, *(f"{t} ({e})" for e in (x, y) if e)]
            n, k = 0, 2
            while n < len(tries) and tries[n] in seen:
                n += 1
            made = tries[n] if n < len(tries) else None
            while made is None or made in seen:
                made, k = f"{t} (#{k})", k + 1
            seen.add(made)
            want[i] = made
        df = spark.createDataFrame(data, "id long, t string, x string, y string")
        assert {q.id: q.t for q in dedupe.unique_texts(df, "t", ["id"], ["x", "y"]).collect()} == want
    assert dedupe.unique_texts(df.limit(0), "t", ["id"], ["x"]).count() == 0
    same = spark.range(300).select("id", F.lit("t").alias("t"), F.lit("a").alias("x"))
    assert sorted(q.t for q in dedupe.unique_texts(same, "t", ["id"], ["x"]).collect()) == sorted(["t", "t (a)", *(f"t (#{k})" for k in range(2, 300))])


def test_site_export(spark, tmp_path):
    cols = ("id long, tab string, at timestamp, archived_at timestamp, original timestamp, title string, article_title string, title_ko string, deep_title string, url string, image string, "
            "image_kind string, source string, summary string, summary_ko string, deep_summary string, deep_category string, keep boolean, sharpness int")  # fmt: skip
    r, data = random.Random(1), []
    import datetime

    for i in range(200):
        at = datetime.datetime(2024, 1, 1, 20) + datetime.timedelta(days=r.randrange(40))
        deep = r.random() < 0.5
        data.append((i, r.choice(["u", "k"]), at if i % 9 else None, datetime.datetime(2024, 1, 3, 20), at - datetime.timedelta(days=r.choice([1, 400])) if i % 3 else None, f"title {i}", None, "", f"deep {i}" if deep else None,
                     f"https://e.com/{i}", "img", r.choice(["related", "own", None]), r.choice(["s1", "s2", "s3", None]), "plain", "stock phrase" if i % 4 == 0 else "local", None, None, r.random() < 0.6 if deep else None, r.randint(1, 10) if deep else None))
    root, items = str(tmp_path / "site"), spark.createDataFrame(data, cols)
    assert site.export(items, root, F.lit("other"), "stock phrase") == 1
    rows = {x.id: x for x in versions.checked(spark, root, "all").collect()}
    assert len(rows) == 200 and {x.img for x in rows.values() if data[x.id][11] == "related"} == {""}
    for x in data:
        got = rows[x[0]]
        assert got.t == (x[8] or x[5]) and got.sum == ("plain" if x[0] % 4 == 0 else "local") and got.old == (x[4] is not None and ((x[2] or x[3]) - x[4]).days > 365)
        assert got.day == str(((x[2] or x[3]) + datetime.timedelta(hours=9)).date())
    for m in versions.read(spark, root, "meta").collect():
        mine = [x for x in rows.values() if x.tab == m.tab]
        days = sorted({x.day for x in mine}, reverse=True)
        assert (m.item_count, m.date_count, m.latest, m.dates) == (len(mine), len(days), days[0], days)
        assert m.day_counts == {d: sum(x.day == d for x in mine) for d in days[:14]} and m.read_count == sum(x.sh is not None for x in mine)
        recent = site.tab_items(spark, root, m.tab).collect()
        assert {x.id for x in recent} == {x.id for x in mine if x.day in days[:21]} and [x.day for x in recent] == sorted((x.day for x in recent), reverse=True)
    last = sorted({x.day for x in rows.values()}, reverse=True)[:3]
    want, per = [], defaultdict(int)
    for x in sorted((x for x in rows.values() if x.day in last and x.k), key=lambda x: (-x.sh, [-int(c) for c in x.day.split("-")], x.id)):
        if per[x.s] < 2 and len(want) < 12:
            per[x.s] += 1
            want.append(x.id)
    assert [x.id for x in versions.read(spark, root, "today").orderBy(F.desc("sh"), F.desc("day"), "id").collect()] == want
    # a second export is seen as a whole, the first one stays readable
    assert site.export(items.where("tab = 'u'"), root, F.lit("other"), replaces=1) == 2
    assert versions.read(spark, root, "meta").count() == 1 and versions.read(spark, root, "meta", 1).count() == 2


def test_sitemap_trees_as_a_plain_walk(spark):
    r, files, roots = random.Random(12), {}, []
    for s in range(6):
        for m in range(9):
            inside = [f"<sitemap><loc>https://e{s}.com/m{r.randrange(11)}.xml</loc></sitemap>" for _ in range(r.randint(0, 4))]
            inside += [f"<url><loc>https://e{s}.com/p?a={r.randrange(30)}&amp;b=1</loc><lastmod>2024-01-0{r.randint(1, 9)}</lastmod></url>" for _ in range(r.randint(0, 5))]
            r.shuffle(inside)
            files[f"https://e{s}.com/m{m}.xml"] = f"<x>{''.join(inside)}</x>"
        roots += [(f"s{s}", f"https://e{s}.com/m0.xml"), (f"s{s}", f"https://www.e{s}.com/m0.xml#x")]
    roots += [(None, "https://e0.com/m0.xml"), ("none", None), ("lost", "https://lost.com/s.xml")]
    import re

    for most, depth in ((12, 8), (4, 8), (12, 2)):
        want, maps = {}, []
        for s in sorted({s for s, u in roots if s and u}):
            level, seen, n = list(dict.fromkeys(u.replace("www.", "").split("#")[0] for t, u in roots if t == s)), [], 0
            for _ in range(depth):
                following = []
                level = [u for u in dict.fromkeys(level) if u not in seen][: most - len(seen)]
                for u in level:
                    seen.append(u)
                    n += 1
                    maps.append((s, u, n, u in files))
                    for kind, loc in re.findall(r"<(sitemap|url)><loc>(.*?)</loc>", files.get(u, "")):
                        if kind == "sitemap":
                            following.append(loc)
                        else:
                            want.setdefault((s, loc.replace("&amp;", "&")), n)
                level = following
        pages, found = crawl.walk_sitemaps(spark.createDataFrame(list(files.items()), "url string, xml string"), spark.createDataFrame(roots, "source string, url string"), most, depth)
        assert sorted(map(tuple, found.collect())) == sorted(maps)
        assert {(x.source, x.url): x.map for x in pages.collect()} == want
    pages, found = crawl.walk_sitemaps(spark.createDataFrame([], "url string, xml string"), spark.createDataFrame([], "source string, url string"))
    assert pages.count() == found.count() == 0


def test_the_export_makes_items_compact_once(spark, tmp_path):
    calls, one = spark.sparkContext.accumulator(0), F.lit(None).cast("string")

    def said(x):
        calls.add(1)
        return "other"

    at, texts = F.timestamp_seconds(F.lit(1_704_067_200)), ("title", "article_title", "title_ko", "deep_title", "url", "image", "image_kind", "summary", "summary_ko", "deep_summary", "deep_category")
    items = spark.range(6).select("id", F.lit("u").alias("tab"), at.alias("at"), at.alias("archived_at"), at.alias("original"), *[one.alias(c) for c in texts], F.lit("s").alias("source"), F.lit(True).alias("keep"), F.lit(1).alias("sharpness"))
    site.export(items, str(tmp_path / "site"), F.udf(said)("id"))
    assert calls.value == 6


def test_an_updates_words_are_made_once(spark):
    terms = tabs.UpdateTerms(("idea",), ("tool",), ("built",), ("room",), ("wood",), ("sale",), (r"\bmit\b",))
    score = tabs.update_score(tabs.update_words(F.lit("known title"), F.col("s"), F.lit("")), F.col("s"), F.lit(True), F.lit(1), F.lit(False), terms)
    plan = spark.createDataFrame([("x",)], "s string").select(score.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("known title") == 1


def test_word_edges_after_their_letter(spark):
    import re

    r = random.Random(5)
    texts = ["".join(r.choice(["mit", "m", "a", "b", " ", "é", "_", "-", "2"]) for _ in range(r.randint(0, 6))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for p in (r"\bmit\b", r"a\b", r"\bab?\b", r"\bb?a", r"a2\b|\bm", r"[ab]\b"):
        want = [len(re.findall(p, t, re.A)) > 0 for t in texts]
        assert [x.n == 1 for x in df.select("i", tabs.hit_count(F.col("t"), (p,)).alias("n")).orderBy("i").collect()] == want
