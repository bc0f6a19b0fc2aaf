"""Removing duplicates: by key, by any of several keys, and by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import written


def first_position_last_value(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row a key: the values of its last row at the position of its first."""
    rest = [c for c in df.columns if c not in (key, pos)]
    out = df.groupBy(key).agg(F.min(pos).alias(pos), F.max_by(F.struct(*rest), pos).alias("v"))
    return out.select(key, pos, *[F.col(f"v.`{c}`").alias(c) for c in rest])


def first_value(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row a key: the first in the given order (a sort-free aggregate over structs)."""
    ranks = [F.expr(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[r.alias(f"o{i}") for i, r in enumerate(ranks)])).alias("v"))
    return out.select(key, *[F.col(f"v.`{c}`").alias(c) for c in rest])


def shares_earlier_key(df: DataFrame, keys: str, order: list[str], row_id: str) -> DataFrame:
    """df and ``dropped``: the row shares one of its keys with an earlier row.

    Each key's first row owns it; a row that isn't the owner of all its keys is dropped. The keys are computed once,
    into a table of (row, order, key); the least order of a key is an aggregate, so that a frequent key is combined
    before it is shuffled.
    """
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*order, row_id])])
    entries = written(df.select(row_id, at.alias("at"), F.explode(keys).alias("k")))
    owners = entries.groupBy("k").agg(F.min("at").alias("owner"))
    late = entries.join(owners, "k").where(F.col("owner") < F.col("at")).select(row_id).distinct().withColumn("dropped", F.lit(True))
    return df.join(late, row_id, "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def any_key_anti(df: DataFrame, other: DataFrame, keys: str, row_id: str) -> DataFrame:
    """Rows of df that share none of their keys with any row of other."""
    used = other.select(F.explode(keys).alias("k")).distinct()
    hit = df.select(row_id, F.explode(keys).alias("k")).join(used, "k", "left_semi").select(row_id).distinct()
    return df.join(hit, row_id, "left_anti")


def replace_days(existing: DataFrame, incoming: DataFrame, day: str = "day") -> DataFrame:
    """Existing rows of other days, and all incoming rows."""
    return existing.join(incoming.select(day).distinct(), day, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge: new values win field by field, where they aren't null."""
    o, n = old.alias("o"), new.alias("n")
    rest = [c for c in old.columns if c != key]
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def unique_texts(df: DataFrame, text: str, order: list[str], extras: list[str]) -> DataFrame:
    """Repeated texts made distinct, in order: a row takes its text, else the first of its made ones that no earlier row has.

    A row tries its text, the text with each of its own extras (empty ones are skipped), then with #2, #3 and so on; a
    made text may equal one that exists, which then gives way if it comes later. In rounds, every row holds the next
    text it hasn't lost, each text goes to its earliest row, and the losers go on. What a row has lost stays lost, so the
    end is that of a loop over the rows in order. Rows of one text that are left to numbers start at their rank.

    Edge cases: null and empty texts are left alone; rows of equal order count in an order of their own; rounds end when
    no two rows hold the same text.
    """
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()))
    made = F.filter(F.array(*[F.col(f"`{e}`").cast("string") for e in extras]), lambda e: F.coalesce(e, F.lit("")) != "")
    at = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate([*order, "_row"])])
    live = rows.where(F.coalesce(F.col(text), F.lit("")) != "").select("_row", at.alias("at"), F.col(text).alias("t"), made.alias("extras"), F.lit(0).cast("long").alias("k"))
    said = F.when(F.col("k") <= F.size("extras"), F.concat(F.lit(" ("), F.get("extras", (F.col("k") - 1).cast("int")), F.lit(")")))
    said = F.when(F.col("k") == 0, F.lit("")).otherwise(F.coalesce(said, F.concat(F.lit(" (#"), (F.col("k") - F.size("extras") + 1).cast("string"), F.lit(")"))))
    rank = F.row_number().over(Window.partitionBy("t").orderBy("at"))
    while True:
        held = written(live.withColumn("c", F.concat("t", said)))
        first = held.groupBy("c").agg(F.min("at").alias("first"))
        judged = written(held.join(first, "c").select("_row", "at", "t", "extras", "c", (F.col("k") + (F.col("at") != F.col("first")).cast("long")).alias("k"), (F.col("at") != F.col("first")).alias("lost")))
        if judged.where("lost").isEmpty():
            break
        numbered = judged.where("k > size(extras)").withColumn("k", F.greatest("k", F.size("extras") + rank))
        live = judged.where("k <= size(extras)").unionByName(numbered).drop("c", "lost")
    texts = judged.select("_row", F.col("c").alias("_made"))
    out = rows.join(texts, "_row", "left").withColumn(text, F.coalesce("_made", F.col(text)))
    return out.select(*df.columns)
