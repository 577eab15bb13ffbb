"""Request metrics, quotas, caches and sessions over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwork.operators import scans


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch (session time zone UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000000).cast("long")


def request_metrics(events: DataFrame, path: str, failed: Column, latency: str) -> DataFrame:
    return events.groupBy(F.replace(F.col(path), F.lit('"'), F.lit("")).alias("path")).agg(
        F.count("*").alias("request_count"), F.count_if(failed).alias("error_count"), F.sum(latency).alias("latency_sum")
    )


def metrics_text(metrics: DataFrame, prefix: str) -> DataFrame:
    """Exposition lines of the three metrics, by metric and path. Paths without errors have no error line."""
    rows = metrics.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("n"), "path", F.format_string(prefix + '_request_count{path="%s"} %d', "path", "request_count").alias("line")),
                F.struct(F.lit(2).alias("n"), "path", F.when(F.col("error_count") > 0, F.format_string(prefix + '_error_count{path="%s"} %d', "path", "error_count")).alias("line")),
                F.struct(F.lit(3).alias("n"), "path", F.format_string(prefix + '_latency_seconds_sum{path="%s"} %.6f', "path", "latency_sum").alias("line")),
            )
        ).alias("x")
    )
    return rows.select("x.*").where("line is not null").orderBy("n", "path")


def quota_aligned(events: DataFrame, key: str, ts: str, limit: int, width: int, tie: str) -> DataFrame:
    """Epoch-aligned windows: allowed, remaining and reset_at per event. Denied requests count too. Events without a time share a window without an end."""
    if limit < 1 or width < 1:
        raise ValueError("limit and width must be at least 1")
    rows = events.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.floor(seconds(F.col(ts)) / width).cast("long").alias("_win"))
    rows = scans.numbered(rows, ["_key", "_win"], ["_ts", "_tie"])
    left = F.greatest(limit - F.col("n"), F.lit(0)).cast("long")
    return rows.select(F.col("_key").alias(key), F.col("_tie").alias(tie), (F.col("n") <= limit).alias("allowed"), left.alias("remaining"), ((F.col("_win") + 1) * width).alias("reset_at"))


def anchored_windows(events: DataFrame, key: str, at: Column, tie: str, width: int, block: int = scans.BLOCK) -> DataFrame:
    """(_key, _tie, window_start, turn from 1): a window opens at a key's first event and again at the first one ``width`` or more later. ``at`` is a whole number.

    An event's possible next start is the first event at ``at + width`` or later. Its number is the count of events before that time, and the event's own number is the count of such times before it: one
    running count over both, in ranges (``scans``). Which events are starts is then found by pointer doubling from each key's first (``scans.chains``), so a hot key is spread like any other.
    Null keys are one key. Events without a time have a null window_start and turn.
    """
    rows = events.select(F.col(key).alias("_key"), F.col(tie).alias("_tie"), at.cast("long").alias("_at"))
    timed = rows.where("_at is not null")
    asks = timed.withColumns({"_when": F.col("_at") + width, "_kind": F.lit(0)})
    order = ["_when", "_kind", "_tie"]
    both = scans.ranges(asks.unionByName(timed.select("_key", "_tie", "_at", F.col("_at").alias("_when"), F.lit(1).alias("_kind"))), ["_key"], order)
    is_event, is_ask = F.col("_kind"), 1 - F.col("_kind")
    before, whole = scans.earlier(["_key"]), Window.partitionBy("_key")
    carries = {"_e": F.coalesce(F.sum("_es").over(before), F.lit(0)), "_a": F.coalesce(F.sum("_as").over(before), F.lit(0)), "_total": F.sum("_es").over(whole)}
    both = scans.carried(both, ["_key"], {"_es": F.sum(is_event), "_as": F.sum(is_ask)}, carries)
    so_far = scans.within(["_key"], order).rowsBetween(Window.unboundedPreceding, 0)
    after, rank = (F.sum(is_event).over(so_far) + F.col("_e")).cast("long"), (F.sum(is_ask).over(so_far) + F.col("_a") - 1).cast("long")
    both = both.select("_key", "_tie", "_at", "_kind", "_total", after.alias("_after"), rank.alias("_rank")).where("_kind = 0").drop("_kind")
    found = scans.chains(scans.written(both, "pointers"), "_key", block)
    starts = found.where("_rank = _start").select(F.col("_key").alias("_sk"), F.col("_rank").alias("_sr"), F.col("_at").alias("window_start"))
    found = _started(found, starts)
    out = found.select("_key", "_tie", "window_start", (F.col("_rank") - F.col("_start") + 1).alias("turn"))
    nothing = F.lit(None).cast("long")
    return out.unionByName(rows.where("_at is null").select("_key", "_tie", nothing.alias("window_start"), nothing.alias("turn")))


def _started(found: DataFrame, starts: DataFrame) -> DataFrame:
    """Each row with the time of its start. A start with many rows is met by blocks of these, so that no task has all."""
    part = (F.col("_rank") / scans.BLOCK).cast("long")
    spans = found.groupBy(F.col("_key").alias("_pk"), F.col("_start").alias("_ps")).agg(F.min(part).alias("_lo"), F.max(part).alias("_hi"))
    known = scans.joined(spans, starts, {"_pk": "_sk", "_ps": "_sr"}, "inner")
    parts = known.select("_pk", "_ps", "window_start", F.explode(F.sequence("_lo", "_hi")).alias("_part"))
    return scans.joined(found.withColumn("_at_part", part), parts, {"_key": "_pk", "_start": "_ps", "_at_part": "_part"}, "inner")


def quota_anchored(events: DataFrame, key: str, ts: str, limit: int, width: int, tie: str, block: int = scans.BLOCK) -> DataFrame:
    """Windows anchored at a key's first request, in whole seconds: allowed, remaining, reset_at. A request without a time is denied."""
    if limit < 1 or width < 1:
        raise ValueError("limit and width must be at least 1")
    rows = anchored_windows(events, key, seconds(F.col(ts)), tie, width, block)
    left = F.greatest(limit - F.coalesce("turn", F.lit(limit)), F.lit(0)).cast("long")
    return rows.select(F.col("_key").alias(key), F.col("_tie").alias(tie), F.coalesce(F.col("turn") <= limit, F.lit(False)).alias("allowed"), left.alias("remaining"), (F.col("window_start") + width).alias("reset_at"))


def cache_hits(events: DataFrame, key: str, ts: str, ttl: int, tie: str, block: int = scans.BLOCK) -> DataFrame:
    """Each read of a cache that a miss fills for ``ttl`` seconds: hit, and when the entry expires. Hits don't extend it. A read without a time is a miss."""
    rows = anchored_windows(events, key, F.unix_micros(F.col(ts).cast("timestamp")), tie, ttl * 1000000, block)
    expires = F.round(F.col("window_start") / 1000000 + ttl, 6)
    return rows.select(F.col("_key").alias(key), F.col("_tie").alias(tie), F.coalesce(F.col("turn") > 1, F.lit(False)).alias("hit"), expires.alias("expires_at"))


def cache_asof(writes: DataFrame, reads: DataFrame, key: str, ts: str, ttl: int, tie: str) -> DataFrame:
    """Per read, the last written value at or before it that hasn't expired (expires_at > now), else null: one union, in ranges that carry a key's last write on."""
    of = lambda rows, value, kind: rows.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), value.cast(writes.schema["value"].dataType).alias("_value"), F.lit(kind).alias("_kind"))
    order = ["_ts", "_kind", "_tie"]
    log = scans.ranges(of(writes, F.col("value"), 0).unionByName(of(reads, F.lit(None), 1)), ["_key"], order)
    write = F.when(F.col("_kind") == 0, F.struct("_ts", "_tie", "_value"))
    log = scans.carried(log, ["_key"], {"_w": F.max(write)}, {"_before": F.last("_w", ignorenulls=True).over(scans.earlier(["_key"]))})
    seen = F.last(write, ignorenulls=True).over(scans.within(["_key"], order).rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("w", F.coalesce(seen, F.col("_before"))).where("_kind = 1")
    live = F.unix_micros(F.col("w._ts").cast("timestamp")) + ttl * 1000000 > F.unix_micros(F.col("_ts").cast("timestamp"))
    return rows.select(F.col("_key").alias(key), F.col("_tie").alias(tie), F.when(live, F.col("w._value")).alias("value"), F.coalesce(live, F.lit(False)).alias("hit"))


def sessionize(events: DataFrame, key: str, ts: str, gap: int, tie: str) -> DataFrame:
    """(key, session, started, ended, n): a session ends when the gap is over ``gap`` seconds.

    Breaks inside a range are counted there; of each (range, key) its first and last time and its breaks are carried on.
    """
    rows = events.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_m"))
    order = ["_ts", "_tie"]
    wide = lambda now, last: F.coalesce((now - last > gap * 1000000).cast("long"), F.lit(0))
    own = scans.within(["_key"], order)
    rows = scans.ranges(rows, ["_key"], order).withColumn("_new", wide(F.col("_m"), F.lag("_m").over(own)))
    before = scans.earlier(["_key"])
    facts = {"_first": F.min("_m"), "_last": F.max("_m"), "_breaks": F.sum("_new")}
    opens = wide(F.col("_first"), F.max("_last").over(before))
    rows = scans.carried(rows, ["_key"], facts, {"_opens": opens, "_carry": F.coalesce(F.sum("_breaks").over(before), F.lit(0))})
    firsts = rows.select("_range", "_key", "_opens").distinct().select(F.col("_range").alias("_of"), F.col("_key").alias("_of_key"), F.sum("_opens").over(Window.partitionBy("_key").orderBy("_range")).alias("_opened"))
    rows = scans.joined(rows, firsts, {"_range": "_of", "_key": "_of_key"})
    rows = rows.withColumn("session", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_carry") + F.col("_opened"))
    return rows.groupBy(F.col("_key").alias(key), "session").agg(F.min("_ts").alias("started"), F.max("_ts").alias("ended"), F.count("*").alias("n"))


def expired_sessions(events: DataFrame, key: str, ts: str, timeout: int, now: str) -> DataFrame:
    """Keys whose last activity is over ``timeout`` seconds before ``now``."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_activity"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))
    return last.where(age > timeout * 1000000)
