"""Loose JSON and packed vectors: odd lines, round trips, and what must raise."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmark.sources import loose, packed, versions


def test_odd_lines(spark):
    post = {"author": {"handle": "a"}, "record": {"text": "t" * 150, "createdAt": "2024-01-02T03:04:05Z"}, "uri": "at://x/9", "likeCount": 2, "repostCount": 3, "replyCount": 4}
    lines = [
        ("bluesky", json.dumps({"posts": [post, {}, None, 5, {**post, "likeCount": "x", "author": 7, "embed": {"external": {"uri": "https://e.org", "title": "T", "thumb": "no"}}}]})),
        ("bluesky", "{"), ("bluesky", json.dumps({"posts": 3})), ("bluesky", json.dumps([1])), ("other", json.dumps({"posts": [post]})),
        ("reddit", json.dumps({"data": {"children": [{"data": {"url": "https://r.org", "score": 1.0, "num_comments": 2, "created_utc": 60, "thumbnail": "https://i"}}, {"data": None}]}})),
        ("youtube", json.dumps({"items": [{"id": {"videoId": "v"}, "snippet": {"title": "", "description": "", "thumbnails": {"medium": {"url": "http://m"}}}}]})),
    ]
    df = spark.createDataFrame(lines, "platform string, line string").withColumn("entry_", F.lit(1)).withColumn("v_", F.lit(2))
    got = loose.candidates(df).collect()
    assert len(got) == 8 and {r.entry_ for r in got} == {1}
    first, last = [r for r in got if r.platform == "bluesky" and r.text]
    assert (first.url, first.title, first.engagement, first.image) == ("https://bsky.app/profile/a/post/9", "t" * 100, 12, "")
    assert (last.url, last.title, last.engagement, last.image, last.author) == ("https://e.org", "T", 10, "", "")
    found = {(r.platform, r.url): r for r in loose.usable(loose.candidates(df)).collect()}
    assert len(found) == 4
    assert found["reddit", "https://r.org"].engagement == 5 and found["reddit", "https://r.org"].image == "https://i" and found["reddit", "https://r.org"].date.minute == 1
    assert found["youtube", "https://www.youtube.com/watch?v=v"].title is None and found["youtube", "https://www.youtube.com/watch?v=v"].image == "http://m"
    counts = {r.platform: (r.lines, r.broken, r.without) for r in loose.broken(df).collect()}
    assert counts == {"bluesky": (4, 1, 2), "other": (1, 0, 1), "reddit": (1, 0, 0), "youtube": (1, 0, 0)}
    assert loose.candidates(df.limit(0)).count() == 0 and loose.broken(df.limit(0)).count() == 0


def test_vectors_round_trip(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice([0, 1, None]), r.choice([i, 7, None]), r.choice([None, [r.randint(-128, 127) for _ in range(6)]]), f"x{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "shard long, id long, v array<int>, _shard_ string")
    packed.write(df, str(tmp_path), "shard", "id", "v", 6)
    got = packed.read(spark, str(tmp_path), "shard").collect()
    assert sorted(map(str, ((g.shard, g.id, g.vector, g._shard_) for g in got))) == sorted(map(str, rows))
    for s in (0, 1, None):
        mine = sorted((g for g in got if g.shard == s), key=lambda g: g.place)
        assert [g.place for g in mine] == list(range(1, len(mine) + 1))
        assert [g.vec for g in mine] == sorted((g.vec for g in mine), reverse=True)


def test_vectors_that_do_not_fit(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(0, i, [i, -i]) for i in range(5)], "shard long, id long, v array<int>")
    rows, shards = packed.pack(df, "shard", "id", "v", 2)
    assert packed.aligned(rows, shards, "shard").orderBy("id").collect()[3].vector == [3, -3]
    short = shards.withColumn("packed", F.substring("packed", F.lit(1), F.lit(9)))
    for bad in (short, shards.limit(0), shards.withColumn("vectorised", F.lit(4))):
        with pytest.raises(Exception, match="misaligned shard 0"):
            packed.aligned(rows, bad, "shard").collect()
    with pytest.raises(Exception, match="length: 2"):
        packed.write(df, str(tmp_path), "shard", "id", "v", 3)
    monkeypatch.setattr(packed, "MOST", 4)
    with pytest.raises(Exception, match="more than 4 rows"):
        packed.write(df, str(tmp_path), "shard", "id", "v", 2)
    assert versions.head(spark, str(tmp_path)) is None  # nothing was published
    with pytest.raises(ValueError):
        packed.pack(df.withColumn("place", F.lit(1)), "shard", "id", "v", 2)


def test_vectors_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "shard long, id long, v array<int>")
    packed.write(df, str(tmp_path), "shard", "id", "v", 2)
    assert packed.read(spark, str(tmp_path), "shard").count() == 0
