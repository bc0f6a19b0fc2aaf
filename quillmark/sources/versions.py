"""Several tables as one state: files that are staged first, and a manifest that makes them the state at once.

``commit`` writes every table into a new folder that no reader knows of, and then one manifest: a file of one row that
names the version, the version it replaces, and for each table its folders, rows and columns. Readers follow the manifest of
the highest version, so a write that dies between two files leaves the old state as it was; folders that no manifest
names are never read. A commit may add folders to a table instead of replacing it.

One writer at a time is assumed. A writer that says which version it has read is refused if another one was committed
since; a commit of a tag that was committed before changes nothing, which makes a repeated batch harmless.

Edge cases: a root without manifests has no state (``head`` is None, ``read`` raises); empty tables keep their columns;
a table whose files are fewer rows than the manifest says raises in ``checked``; nulls and repeated rows are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, previous long, tag string, tables map<string, array<string>>, rows map<string, long>, schemas map<string, string>"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests of a root, one row a version; none if there is no such folder."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifests/*")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def head(spark: SparkSession, root: str, version: int | None = None) -> Row | None:
    """The manifest of a version, of the highest by default."""
    found = manifests(spark, root)
    if version is not None:
        found = found.where(F.col("version") == version)
    return found.orderBy(F.desc("version")).first()


def committed(spark: SparkSession, root: str, tag: str) -> int | None:
    """The version that was committed under a tag."""
    found = manifests(spark, root).where(F.col("tag") == tag).agg(F.max("version")).first()
    return found[0]


def folders(spark: SparkSession, state: Row, table: str) -> DataFrame:
    """The rows of all folders that a manifest names for a table; each may have partition columns."""
    schema = StructType.fromJson(json.loads(state.schemas[table]))
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(p) for p in state.tables[table]])


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as the manifest names it."""
    state = head(spark, root, version)
    if state is None or table not in state.tables:
        raise ValueError(f"{root} has no committed table {table}")
    return folders(spark, state, table)


def checked(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """The same, after comparing its rows with the manifest's."""
    found, said = read(spark, root, table, version), head(spark, root, version).rows[table]
    if found.count() != said:
        raise ValueError(f"{table} of {root} should have {said} rows")
    return found


def commit(
    spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], tag: str | None = None, add: bool = False,
    partition_by: dict[str, list[str]] | None = None, replaces: int | None = None,
) -> int:
    """Stages all tables and makes them the state; returns its version. Tables that aren't given stay as they are.

    They are staged as listed; a table may be given as a function of those that were staged before it.
    """
    if tag is not None and (done := committed(spark, root, tag)) is not None:
        return done
    before = head(spark, root)
    old = before.version if before else 0
    if replaces is not None and replaces != old:
        raise ValueError(f"{root} is at version {old}, not {replaces}")
    paths, rows, schemas = (dict(before[c]) if before else {} for c in ("tables", "rows", "schemas"))
    staged: dict[str, DataFrame] = {}
    for name, df in tables.items():
        folder = f"{root}/data/{old + 1:010d}-{uuid.uuid4().hex}/{name}"
        df = df(staged) if callable(df) else df
        df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(folder)
        staged[name] = spark.read.schema(df.schema).parquet(folder)
        n = staged[name].count()
        paths[name] = [*(paths.get(name, []) if add else []), folder]
        rows[name] = n + (rows.get(name, 0) if add else 0)
        schemas[name] = df.schema.json()
    publish(spark, root, Row(version=old + 1, previous=old, tag=tag, tables=paths, rows=rows, schemas=schemas))
    return old + 1


def publish(spark: SparkSession, root: str, manifest: Row) -> None:
    """Writes the manifest: the one file that changes what readers see. A folder left by a dead writer is replaced."""
    out = spark.createDataFrame([manifest], MANIFEST).coalesce(1)
    out.write.mode("overwrite").json(f"{root}/manifests/{manifest.version:010d}")
