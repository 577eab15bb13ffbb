"""Streaming twins. Event time is ``ts``; rows later than the watermark delay are dropped; without late rows each equals its batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from groundwork.operators.tables import upsert
from groundwork.streaming.stateful import DELAY, cache_hits, clarify_stream, quota_anchored  # noqa: F401  (part of this surface)


def request_metrics(events: DataFrame, path: str, failed: Column, latency: str, window: str | None = None, delay: str = DELAY) -> DataFrame:
    """Running metrics per path (update or complete mode), or per tumbling window (append mode)."""
    keys = [F.col(path).alias("path")]
    if window:
        events, keys = events.withWatermark("ts", delay), [F.window("ts", window), *keys]
    return events.groupBy(*keys).agg(F.count("*").alias("request_count"), F.count_if(failed).alias("error_count"), F.sum(latency).alias("latency_sum"))


def quota_aligned(events: DataFrame, key: str, limit: int, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Requests, allowed and denied ones per key and tumbling window."""
    n = events.withWatermark("ts", delay).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))
    return n.select(key, F.col("window.start").alias("started"), "n", F.least("n", F.lit(limit)).alias("n_allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("n_denied"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Sessions by idle gap, closed once the watermark passes."""
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return rows.select(key, F.col("session_window.start").alias("started"), "ended", "n")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append sink: Parquet files with a checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket of a snapshot, by the names of its folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for s in (fs.globStatus(hadoop(f"{path}/v=*/bucket=*")) or []) if fs.exists(root) else []:
        if fs.exists(hadoop(f"{path}/v={(v := int(s.getPath().getParent().getName()[2:]))}/_SUCCESS")):
            found.setdefault(int(s.getPath().getName()[7:]), []).append(v)
    return found


def snapshot(spark: SparkSession, path: str, schema: StructType, before: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
    """The table that ``incremental_upsert`` keeps: the newest version (below ``before``) of every bucket (of ``only``)."""
    newest = {b: max(v for v in own if before is None or v < before) for b, own in _versions(spark, path).items() if (only is None or b in only) and (before is None or min(own) < before)}
    if not newest:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/v={v}/bucket={b}" for b, v in newest.items()))


def incremental_upsert(rows: DataFrame, path: str, key: str, order: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, buckets: int = 64) -> DataStreamWriter:
    """Upserts each micro-batch, as ``prepare`` makes it of what arrived, into a snapshot (``snapshot``) of ``buckets`` buckets by a hash of the key.

    A micro-batch reads and writes only the buckets that its keys fall into, as path/v=<batch>/bucket=<bucket>, where nothing is overwritten: a batch that runs again reads the versions before it and
    writes its own anew, so restarts neither double nor lose rows, and readers see whole buckets. Versions before the last but one of a rewritten bucket are deleted.
    """

    def apply(arrived: DataFrame, number: int) -> None:
        batch = prepare(arrived)
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
        if touched:
            target = snapshot(spark, path, batch.drop(order).schema, number, touched)
            new = upsert(target, batch, key, order).withColumn("bucket", bucket)
            new.repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/v={number}")
        batch.unpersist()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        versions = _versions(spark, path) if touched else {}
        for b in touched:
            for v in sorted(v for v in versions[b] if v < number)[:-1]:
                fs.delete(hadoop(f"{path}/v={v}/bucket={b}"), True)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
