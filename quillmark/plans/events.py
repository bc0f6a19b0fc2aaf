"""Queries over events: days, sessions, gaps, logs, taste and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import select
from ..operators.rounds import shared_folder
from ..streaming import state, streams
from .registry import query
from .tables import table

DAY = "CAST(ts + INTERVAL 9 HOUR AS DATE)"
#: Days in results are text, which compares alike everywhere.
TEXT_DAY = f"CAST({DAY} AS VARCHAR)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("agg_day_counts", f"SELECT {TEXT_DAY} AS day, count(*) AS n FROM events GROUP BY 1")
def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: rows a day in Korea Standard Time."""
    return _events(spark, sf_dir).groupBy(values.kst_day(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("fn19_kst_keys", f"SELECT event_id, {TEXT_DAY} AS day, strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS month, CAST({DAY} + INTERVAL 14 HOUR + INTERVAL 59 MINUTE + INTERVAL 59 SECOND AS VARCHAR) AS day_end FROM events")
def kst_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = values.kst_day(F.col("ts"))
    return _events(spark, sf_dir).select("event_id", day.cast("string").alias("day"), values.kst_month(F.col("ts")).alias("month"), values.end_of_kst_day(day).cast("timestamp_ntz").cast("string").alias("day_end"))


@query("fn21_recency", "SELECT event_id, CASE WHEN a <= 14 THEN 'fresh' WHEN a <= 45 THEN 'recent' WHEN a <= 180 THEN 'season' ELSE 'old' END AS recency FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us(ts)) / 86400000000.0 AS a FROM events)")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", values.recency(values.age_days(F.col("ts"), F.lit("2024-02-20 00:00:00").cast("timestamp"))).alias("recency"))


@query("flt04_staleness", "SELECT event_id FROM events WHERE event_type = 'purchase' OR (epoch_us(TIMESTAMP '2025-07-10 00:00:00') - epoch_us(ts)) / 86400000000.0 <= 540")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = values.age_days(F.col("ts"), F.lit("2025-07-10 00:00:00").cast("timestamp"))
    return _events(spark, sf_dir).where((F.col("event_type") == "purchase") | (age <= 540)).select("event_id")


@query("flt11_one_kst_day", f"SELECT event_id FROM events WHERE {DAY} = DATE '2024-01-10'")
def one_kst_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day as a range of instants, so that the condition reaches the scan."""
    t = F.col("ts")
    return table(spark, sf_dir, "events").where((t >= F.expr("TIMESTAMP_NTZ '2024-01-09 15:00:00'")) & (t < F.expr("TIMESTAMP_NTZ '2024-01-10 15:00:00'"))).select("event_id")


@query("agg13_gap_fill", f"""WITH d AS (SELECT {DAY} AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
    s AS (SELECT CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM d)
    SELECT CAST(s.day AS VARCHAR) AS day, coalesce(n, 0) AS n, greatest(200 - coalesce(n, 0), 0) AS missing FROM s LEFT JOIN d ON s.day = d.day""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first to the last, with its count and what it lacks to the target of 200."""
    d = _events(spark, sf_dir).where("event_type = 'error'").groupBy(values.kst_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    spine = d.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spine.join(d, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.greatest(200 - F.coalesce("n", F.lit(0)), F.lit(0)).alias("missing"))


@query("win02_todays_picks", f"""WITH e AS (SELECT event_id, user_id, event_type, value, {DAY} AS day, dense_rank() OVER (ORDER BY {DAY} DESC) AS dr FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM e WHERE dr <= 3 AND event_type = 'purchase')
    SELECT event_id, user_id, value FROM k WHERE rn <= 2 ORDER BY value DESC, event_id LIMIT 12""")
def todays_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows of the last three distinct days, two a source, the best twelve. The days are ranked as days, not rows."""
    e = _events(spark, sf_dir).withColumn("day", values.kst_day(F.col("ts")))
    days = e.select("day").distinct().orderBy(F.desc("day")).limit(3)
    kept = e.join(F.broadcast(days), "day", "left_semi").where("event_type = 'purchase'").select("event_id", "user_id", "value")
    return select.capped_top(kept, "user_id", [F.desc("value"), F.col("event_id")], 2, 12)


@query("win10_latest_day", f"SELECT event_id, {TEXT_DAY} AS day FROM events WHERE {DAY} = (SELECT max({DAY}) FROM events)")
def latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", values.kst_day(F.col("ts")).alias("day"))
    return e.join(F.broadcast(e.agg(F.max("day").alias("day"))), "day", "left_semi").select("event_id", F.col("day").cast("string").alias("day"))


@query("str04_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.sessions(_events(spark, sf_dir), "user_id", "ts", "30 minutes")
    return s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


@query("str05_tumbling_days", f"SELECT {TEXT_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.kst_days(_events(spark, sf_dir), "ts", "event_type").withColumn("day", F.col("day").cast("string"))


@query("str06_sliding_evidence", """WITH w AS (SELECT unnest(range(date_trunc('day', ts) - INTERVAL 13 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS start, user_id FROM events WHERE event_type = 'signup')
    SELECT start AS started, count(*) AS n, count(DISTINCT user_id) AS users FROM w GROUP BY 1""")
def sliding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'signup'")
    w = e.groupBy(F.window("ts", "14 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "n", "users")


@query("sel17_day_groups", f"""WITH d AS (SELECT {TEXT_DAY} AS day, count(*) AS n FROM events GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
    SELECT day, n FROM c WHERE coalesce(before, 0) <= 2200""")
def day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest days until enough rows are shown; the running sum is over day totals."""
    d = day_counts(spark, sf_dir)
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("before", before).where("before <= 2200").select("day", "n")


@query("sel20_recent_reads", "SELECT event_id, user_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def recent_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'view'")
    return select.cap_per_group(e.select("event_id", "user_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@query("str07_source_states", """WITH r AS (SELECT 'u' || user_id AS source, ts, event_id % 10 < user_id % 10 AS keep, event_id % 8 AS sharp FROM events),
    g AS (SELECT source, count(*) AS seen, count(*) FILTER (WHERE keep) AS kept, avg(sharp) AS sharp, max(CAST(ts AS DATE)) AS last FROM r GROUP BY 1), n AS (SELECT CAST(max(ts) + INTERVAL 1 SECOND AS DATE) AS today FROM r)
    SELECT source, seen, CASE WHEN seen >= 8 AND kept / CAST(seen AS DOUBLE) < 0.2 AND sharp < 4.5 AND today - last < 3 THEN 'demoted' WHEN seen >= 6 AND kept / CAST(seen AS DOUBLE) >= 0.6 THEN 'trusted' ELSE 'watch' END AS status FROM g, n""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, STR-10: the states of a stream that is started anew for each third of the events; demotions end after three unseen days."""
    root = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    e = _events(spark, sf_dir)
    cols = "source string, ts timestamp, keep boolean, sharpness double"
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "ts", (F.col("event_id") % 10 < F.col("user_id") % 10).alias("keep"), (F.col("event_id") % 8).cast("double").alias("sharpness"))
    low, high = e.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    third = F.least(F.lit(2), F.floor((F.unix_seconds("ts") - low) * 3 / max(high - low, 1)))
    clock = rows.agg(F.max("ts").alias("ts")).select(F.lit("clock").alias("source"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.lit(True).alias("keep"), F.lit(5.0).alias("sharpness"))
    parts = [rows.where(third == k) for k in range(3)] + [clock, clock.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))]
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        state.follow_sources(spark.readStream.schema(cols).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint", 3, "0 seconds").awaitTermination()
    seen = rows.groupBy("source").agg(F.count("*").alias("seen"))
    return state.latest_states(spark, f"{root}/out").where("source <> 'clock'").select("source", "status").join(seen, "source").select("source", "seen", "status")


@query("cls24_taste_boost", """WITH a AS (SELECT user_id, event_type, CAST(sum(CASE WHEN CAST(props->>'k' AS INT) >= 50 THEN 1 ELSE -1 END) AS BIGINT) AS affinity FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, affinity, greatest(-1.5, least(1.5, 0.25 * affinity)) AS boost FROM a""")
def taste_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed counts of saves and hides a kind (AGG-18) and the clamped boost."""
    k = F.get_json_object("props", "$.k").cast("int")
    a = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum(F.when(k >= 50, 1).otherwise(-1)).cast("long").alias("affinity"))
    return a.withColumn("boost", values.clamp(0.25 * F.col("affinity"), -1.5, 1.5))


@query("snk09_bounded_log", f"WITH d AS (SELECT {TEXT_DAY} AS day, arg_max(event_id, ts) AS last_event FROM events GROUP BY 1) SELECT day, last_event FROM d ORDER BY day DESC LIMIT 10")
def bounded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day, the latest wins; the newest ten days stay."""
    e = _events(spark, sf_dir).groupBy(values.kst_day(F.col("ts")).cast("string").alias("day")).agg(F.max_by("event_id", "ts").alias("last_event"))
    return e.orderBy(F.desc("day")).limit(10)


@query("jn16_snapshot_compare", f"""WITH c AS (SELECT event_type, count(*) AS now FROM events GROUP BY 1), p AS (SELECT event_type, count(*) AS was FROM events WHERE {DAY} < DATE '2024-01-20' GROUP BY 1)
    SELECT event_type, now, coalesce(was, 0) AS was, now < coalesce(was, 0) AS shrunk FROM c LEFT JOIN p USING (event_type)""")
def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two snapshots from one scan, and whether any group shrank."""
    e = _events(spark, sf_dir).withColumn("old", values.kst_day(F.col("ts")) < F.lit("2024-01-20").cast("date"))
    return e.groupBy("event_type").agg(F.count("*").alias("now"), F.count_if("old").alias("was")).withColumn("shrunk", F.col("now") < F.col("was"))


@query("jn_asof_last_purchase", """SELECT e.event_id, coalesce(p.event_id, -1) AS purchase FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join as one union and a window: the last purchase at or before each error of a user."""
    e = _events(spark, sf_dir).where("event_type IN ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase", last).where("event_type = 'error'").select("event_id", F.coalesce("purchase", F.lit(-1)).alias("purchase"))


@query("win_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir)
    return e.select("event_id", F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("mean"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))
