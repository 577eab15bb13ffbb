"""Keyed tables: upsert, append, soft delete, lookup, versions. A table is a Parquet snapshot; a result replaces it as a whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(target: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Whole-row replacement by key: the update last in ``order`` wins over earlier ones and over the target.

    One shuffle by key: both sides are tagged, and the last row per key is the greatest of a struct, so it is combined
    before the shuffle and a key with many updates stays one row per task.
    """
    both = target.withColumn("_turn", F.lit(None).cast(updates.schema[order].dataType)).unionByName(updates.withColumnRenamed(order, "_turn").select(*target.columns, "_turn"))
    rest = [c for c in target.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col("_turn").isNotNull().alias("new"), "_turn")).alias("_row"))
    return newest.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*target.columns)


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Appends the rows whose key is not in the target, each key once."""
    return target.unionByName(rows.dropDuplicates([key]).join(target.select(key), key, "left_anti").select(*target.columns))


def soft_delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    marked = table.join(ids.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left")
    return marked.withColumn("status", F.when(F.col("_gone").isNotNull(), "deleted").otherwise(F.col("status"))).drop("_gone")


def active(table: DataFrame) -> DataFrame:
    return table.where(F.col("status") == "active")


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_semi")


def parse_metadata(text: Column) -> Column:
    """A JSON object as a map; anything else as an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def matching(table: DataFrame, equal: Mapping[str, object], k: int, order: str) -> DataFrame:
    """The first k rows by ``order`` that equal all given values."""
    for column, value in equal.items():
        table = table.where(F.col(column) == F.lit(value))
    return table.orderBy(order).limit(k)


def exists(table: DataFrame, column: str, value: object) -> DataFrame:
    return table.agg(F.coalesce(F.bool_or(F.lower(F.col(column).cast("string")) == str(value).lower()), F.lit(False)).alias("found"))


def active_version(versions: DataFrame, partition: str, order: str) -> DataFrame:
    """The newest version of each partition."""
    rest = [c for c in versions.columns if c != partition]
    return versions.groupBy(partition).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(partition, *(F.col(f"_row.{c}").alias(c) for c in rest))


def version_intervals(versions: DataFrame, partition: str, order: str) -> DataFrame:
    """Each version with the one that closed it (null: still active)."""
    closed = F.lead(order).over(Window.partitionBy(partition).orderBy(order))
    return versions.withColumn("closed_by", closed).withColumn("is_active", F.col("closed_by").isNull())


def violations(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that a row fails; a null check fails."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())


def one_question(text: Column) -> Column:
    """Whether a clarification asks exactly one question, on one line, and not as a list item."""
    marks = F.length(F.regexp_replace(text, "[^?؟]", ""))
    return (marks == 1) & ~text.contains("\n") & ~text.rlike(r"^\s*([-*•]|\d+[.)])\s")


def has_dims(vector: Column, dims: int) -> Column:
    """Whether an embedding is unset or has so many dimensions."""
    return vector.isNull() | (F.size(vector) == dims)


def grounded(claims: Column, n_citations: Column) -> Column:
    """Whether an answer that claims a status has a citation."""
    return ~claims | (n_citations > 0)
