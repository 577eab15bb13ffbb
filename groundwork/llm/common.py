"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='groundwork-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage and outlives executors.

    The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/groundwork-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Adds ``out``: the row's number from 0 within ``keys`` by ``order``, without one task per key.

    Rows are range-partitioned by (keys, order) and written; a row's number is its place in its range plus the rows
    of that key in earlier ranges. Only one small row per (range, key) is gathered.
    """
    ranges = (
        df.repartitionByRange(partitions(df.sparkSession), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    ranges = written(ranges, "ranked")
    counts = ranges.groupBy("_range", *keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(F.col("_range").alias("_in"), *(F.col(k).alias(f"_of_{k}") for k in keys), "_first", "_before")
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return ranges.join(counts, same).withColumn(out, F.col("_row") - F.col("_first") + F.col("_before")).select(*df.columns, out)


def joined_by_size(rows: DataFrame, facts: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to their key's one row of ``facts``, in which ``count`` is how many of ``total`` rows have the key.

    Keys with over a thousandth of all rows are at most a thousand, so their facts are broadcast and their rows stay where they are. The others
    are shuffled, at most a thousandth of the rows to any key. Keys must not be null.
    """
    hot = F.col(count) * 1000 > total
    near = rows.join(F.broadcast(facts.where(hot)), on)
    far = rows.join(F.broadcast(facts.where(hot).select(*on)), on, "left_anti").join(facts.where(~hot), on, how)
    return near.unionByName(far)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def appended(df: DataFrame, column: str, compute: Callable[[list], dict[str, list]], schema: str, *, binary: bool = False) -> DataFrame:
    """Replaces ``column`` by what ``compute`` makes of its values (UTF-8 bytes if ``binary``), an Arrow batch at a time.

    The other columns pass through untouched, so that null keys and large integers stay as they are.
    """
    kept = df.drop(column)
    added = df.sparkSession.createDataFrame([], schema).schema
    names = [*kept.columns, *added.names]
    kinds = {f.name: _arrow_type(f.dataType.simpleString()) for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            made = compute((values.cast(pa.binary()) if binary else values).to_pylist())
            passed = [c for name, c in zip(batch.schema.names, batch.columns) if name != column]
            yield pa.RecordBatch.from_arrays([*passed, *(pa.array(made[n], kinds[n]) for n in kinds)], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in [*kept.schema.fields, *added.fields]]
    return df.mapInArrow(run, ", ".join(fields))


def _arrow_type(name: str) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return simple[name]
