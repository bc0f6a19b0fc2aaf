"""Vector shards: rows and one packed file of signed bytes a shard, aligned by position, published as one state.

``write`` gives each row of a shard its place, rows with a vector first, and packs the quantised vectors of those in that
order into one binary of ``dimensions`` bytes each; both tables become the state by one manifest, so that no reader sees
rows of one write and bytes of another. ``read`` joins a row with its shard's bytes and cuts its vector out by position;
a shard whose bytes are not exactly its vectorised rows times ``dimensions`` raises, whatever is asked of it.

A shard is one row of bytes, so the caller's shard column has to bound it; one of more than ``MOST`` rows raises in
``write`` before anything is published. Rows are dealt by shard and numbered inside of it, which is the only shuffle.

Edge cases: a null vector is a row without one; a vector of another length raises; rows of equal ids are all kept, in the
order of their columns' hash; rows of a null shard form a shard of their own; an empty table gives an empty state;
further columns are kept, but for the four made here (``vec``, ``place``, ``vector``, ``packed``), which raise if taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import versions

MOST = 65_536
MADE = ("vec", "place", "vector", "packed")


def as_bytes(vector: Column) -> Column:
    """Whole numbers of -128 to 127 as two's complement in hexadecimal."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(255))), 2, "0")), "")


def as_numbers(packed: Column, dimensions: Column) -> Column:
    """The bytes of one vector as whole numbers."""
    one = lambda i: F.conv(F.hex(F.substring(packed, i, F.lit(1))), 16, 10).cast("int")
    return F.transform(F.transform(F.sequence(F.lit(1), dimensions), one), lambda n: F.when(n > 127, n - 256).otherwise(n))


def pack(docs: DataFrame, shard: str, ident: str, vector: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(rows with vec and place, one row a shard: shard, dimensions, count, vectorised, packed)."""
    clash = [c for c in docs.columns if c.lower() in MADE and c != vector]
    if clash:
        raise ValueError(f"columns {clash} are made by the shards")
    rest = [c for c in docs.columns if c != vector]
    sound = F.when(F.col(vector).isNotNull() & (F.size(vector) != dimensions), F.raise_error(F.concat(F.lit("a vector has not the shard's length: "), F.size(vector).cast("string")))).otherwise(F.col(vector))
    d = docs.select(*rest, sound.alias("vector")).withColumn("vec", F.col("vector").isNotNull())
    order = Window.partitionBy(shard).orderBy(F.desc("vec"), F.col(ident), F.xxhash64(*rest, "vector"))
    placed = d.withColumn("place", F.row_number().over(order))
    placed = placed.withColumn("place", F.when(F.col("place") > MOST, F.raise_error(F.lit(f"a shard has more than {MOST} rows"))).otherwise(F.col("place")))
    bytes_ = F.array_sort(F.collect_list(F.when(F.col("vec"), F.struct("place", as_bytes(F.col("vector")).alias("b")))))
    shards = placed.groupBy(shard).agg(F.lit(dimensions).alias("dimensions"), F.count("*").alias("count"), F.count_if("vec").alias("vectorised"), F.unhex(F.array_join(F.transform(bytes_, lambda x: x["b"]), "")).alias("packed"))
    return placed.select(*rest, "vec", "place"), shards


def write(docs: DataFrame, root: str, shard: str, ident: str, vector: str, dimensions: int) -> int:
    """Publishes the shards of docs; returns the version."""
    rows, shards = pack(docs, shard, ident, vector, dimensions)
    return versions.commit(docs.sparkSession, root, {"rows": rows, "shards": shards})


def aligned(rows: DataFrame, shards: DataFrame, shard: str) -> DataFrame:
    """Rows with their vectors (null for rows without one); raises where bytes and rows are not aligned."""
    dimensions = F.col("dimensions")
    fits = (F.octet_length("packed") == F.col("vectorised") * dimensions) & (~F.col("vec") | (F.col("place") <= F.col("vectorised")))
    bad = F.raise_error(F.concat(F.lit("misaligned shard "), F.coalesce(F.col(shard).cast("string"), F.lit("null"))))
    s = shards.select(F.col(shard).alias("_shard"), "dimensions", "vectorised", "packed")
    j = rows.join(s, rows[shard].eqNullSafe(F.col("_shard")), "left")
    own = F.substring("packed", (F.col("place") - 1) * dimensions + 1, dimensions)
    cut = F.when(F.coalesce(fits, F.lit(False)), F.when(F.col("vec"), own)).otherwise(bad.cast("binary"))
    j = j.withColumn("packed", cut)
    return j.select(*rows.columns, F.when(F.col("packed").isNotNull(), as_numbers(F.col("packed"), dimensions)).alias("vector"))


def read(spark: SparkSession, root: str, shard: str, version: int | None = None) -> DataFrame:
    """The rows of a state, each with its vector."""
    return aligned(versions.read(spark, root, "rows", version), versions.read(spark, root, "shards", version), shard)
