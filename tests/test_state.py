"""Source states in a stream: several batches, a restart in between, expiry without further rows, equal to the batch answer."""

import datetime
import random

from pyspark.sql import functions as F

from quillmark.operators import tabs
from quillmark.streaming import state

COLS = "source string, ts timestamp, keep boolean, sharpness double"


def run(spark, src, out, check, rows):
    spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(COLS).parquet(src)
    state.follow_sources(stream, out, check, late="0 seconds").awaitTermination()
    return {r.source: r.status for r in state.latest_states(spark, out).collect()}


def test_demotions_end_and_survive_restarts(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    r, day0 = random.Random(3), datetime.datetime(2024, 1, 1, 12)
    at = lambda d: day0 + datetime.timedelta(days=d)
    rows = [("low", at(d), False, 1.0) for d in range(10)] + [("good", at(d), True, 9.0) for d in range(8)] + [("few", at(0), False, 1.0), (None, at(0), True, 1.0)]
    rows += [("again", at(d), None, None if d % 2 else 2.0) for d in range(9)]
    assert run(spark, src, out, check, rows) == {"low": "demoted", "good": "trusted", "few": "watch", "again": "demoted"}
    # a later stream, from the checkpoint: one source is read again and stays demoted, the other one's time goes on
    assert run(spark, src, out, check, [("again", at(30), False, 1.0)])["again"] == "demoted"
    # time passes by readings of other sources alone: low ends after day 39, again only after day 60
    got = run(spark, src, out, check, [("clock", at(45), True, 5.0)])
    got = run(spark, src, out, check, [("clock", at(46), True, 5.0)])
    assert (got["low"], got["again"]) == ("watch", "demoted")
    ended = {x.source for x in spark.read.parquet(out).where("ended").collect()}
    assert ended == {"low"}
    # a source whose demotion ended is demoted again by a further reading
    assert run(spark, src, out, check, [("low", at(47), False, 1.0)])["low"] == "demoted"

    # random further batches against the batch answer for the day of the watermark
    known = [x.asDict() for x in spark.read.schema(COLS).parquet(src).collect()]
    for d in (50, 58, 66, 90):
        more = [(r.choice(["low", "good", "few", "again", "new", "x"]), at(d - r.randint(0, 2)), r.random() < 0.3, float(r.randint(1, 9))) for _ in range(12)] + [("clock", at(d), True, 5.0)]
        run(spark, src, out, check, more)
        known += [dict(zip(("source", "ts", "keep", "sharpness"), x, strict=True)) for x in more]
        after = at(d) + datetime.timedelta(seconds=1)
        got = run(spark, src, out, check, [("clock", after, True, 5.0)])
        known.append({"source": "clock", "ts": after, "keep": True, "sharpness": 5.0})
        frame = spark.createDataFrame([(x["source"], x["ts"], x["keep"], x["sharpness"]) for x in known], COLS).where("source IS NOT NULL")
        frame = frame.select("source", F.coalesce("keep", F.lit(False)).alias("keep"), "sharpness", F.to_date("ts").alias("day"))
        want = {x.source: x.status for x in tabs.source_status(frame, "source", F.lit(at(d)).cast("date")).collect()}
        assert got == want
