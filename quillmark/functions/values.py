"""Dates in Korea Standard Time, numbers, vectors and hash ids, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KST = "Asia/Seoul"


def kst_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), KST))


def kst_month(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), KST), "yyyy-MM")


def end_of_kst_day(day: Column) -> Column:
    """The last second of a day, as an instant."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:59"))), KST)


def lenient_timestamp(text: Column) -> Column:
    """The first of the usual feed formats that reads; null if none does."""
    t = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9},? +", "")
    return F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(t, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "yyyy.MM.dd")])


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency(days: Column) -> Column:
    """fresh, recent, season or old: up to 14, 45, 180 days or more."""
    return F.when(days <= 14, "fresh").when(days <= 45, "recent").when(days <= 180, "season").otherwise("old")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def webkit_timestamp(micros: Column) -> Column:
    """Microseconds since 1601 as an instant."""
    return F.timestamp_micros(micros.cast("long") - F.lit(11_644_473_600_000_000))


def hash_id(text: Column, digits: int = 20) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def short_id(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, digits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at length 1 (a zero vector as it is)."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def quantised(v: Column, scale: int = 400) -> Column:
    """Rounded half up and clamped to a signed byte."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * scale + 0.5).cast("int"))))
