"""Queries over events: path = event_type, latency = value, an error is a failed request, the key is user_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import traffic

from .registry import query, table

DAY, LIMIT, GAP, TTL = 86400, 5, 1800, 43200
NOW, TIMEOUT = "2024-01-31 00:00:00", 43200


def events(spark, sf):
    return table(spark, sf, "events")


def metrics(spark, sf):
    return traffic.request_metrics(events(spark, sf), "event_type", F.col("event_type") == "error", "value")


_METRICS = "SELECT event_type AS path, count(*) AS request_count, count_if(event_type = 'error')::BIGINT AS error_count, sum(value) AS latency_sum FROM events GROUP BY 1"


@query(_METRICS.replace("sum(value)", "round(sum(value), 4)"))
def request_metrics(spark, sf):
    return metrics(spark, sf).withColumn("latency_sum", F.round("latency_sum", 4))


@query(f"""SELECT 1 AS n, path, 'x_request_count{{path="' || path || '"}} ' || request_count AS line FROM ({_METRICS}) UNION ALL
SELECT 2, path, 'x_error_count{{path="' || path || '"}} ' || error_count FROM ({_METRICS}) WHERE error_count > 0 UNION ALL
SELECT 3, path, 'x_latency_seconds_sum{{path="' || path || '"}} ' || format('{{:.6f}}', latency_sum) FROM ({_METRICS})""")
def render_metrics_text(spark, sf):
    return traffic.metrics_text(metrics(spark, sf), "x")


@query(f"""SELECT user_id, event_id, n <= {LIMIT} AS allowed, greatest({LIMIT} - n, 0) AS remaining, (win + 1) * {DAY} AS reset_at FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, win ORDER BY ts, event_id) AS n FROM (SELECT *, epoch_us(ts) // 1000000 // {DAY} AS win FROM events))""")
def quota_aligned(spark, sf):
    return traffic.quota_aligned(events(spark, sf), "user_id", "ts", LIMIT, DAY, "event_id")


def _folded(at: str, width: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {at} AS sec, row_number() OVER (PARTITION BY user_id ORDER BY {at}, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, sec AS start, 1 AS turn FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.sec - w.start >= {width} THEN e.sec ELSE w.start END,
CASE WHEN e.sec - w.start >= {width} THEN 1 ELSE w.turn + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) """


@query(_folded("epoch_us(ts) // 1000000", DAY) + f"SELECT user_id, event_id, turn <= {LIMIT} AS allowed, greatest({LIMIT} - turn, 0)::BIGINT AS remaining, start + {DAY} AS reset_at FROM w")
def quota_anchored(spark, sf):
    return traffic.quota_anchored(events(spark, sf), "user_id", "ts", LIMIT, DAY, "event_id")


@query(_folded("epoch_us(ts)", TTL * 1000000) + f"SELECT user_id, event_id, turn > 1 AS hit, round(start / 1000000 + {TTL}, 6)::DOUBLE AS expires_at FROM w")
def cache_hits(spark, sf):
    return traffic.cache_hits(events(spark, sf), "user_id", "ts", TTL, "event_id")


@query(f"""WITH r AS (SELECT * FROM events WHERE event_type <> 'purchase'), w AS (SELECT * FROM events WHERE event_type = 'purchase'),
j AS (SELECT r.user_id, r.event_id, r.ts, arg_max(w.value, (w.ts, w.event_id)) AS v, max(w.ts) AS written FROM r LEFT JOIN w ON w.user_id = r.user_id AND w.ts <= r.ts GROUP BY ALL)
SELECT user_id, event_id, CASE WHEN epoch_us(written) + {TTL * 1000000} > epoch_us(ts) THEN v END AS value, coalesce(epoch_us(written) + {TTL * 1000000} > epoch_us(ts), false) AS hit FROM j""")
def cache_asof(spark, sf):
    e = events(spark, sf)
    return traffic.cache_asof(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), "user_id", "ts", TTL, "event_id")


@query(f"""WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {GAP * 1000000})::INT, 0) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2""")
def sessionize(spark, sf):
    return traffic.sessionize(events(spark, sf), "user_id", "ts", GAP, "event_id")


@query(f"SELECT user_id, max(ts) AS last_activity FROM events GROUP BY 1 HAVING epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) > {TIMEOUT * 1000000}")
def expired_sessions(spark, sf):
    return traffic.expired_sessions(events(spark, sf), "user_id", "ts", TIMEOUT, NOW)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN 'host' || user_id ELSE 'unknown-client' END AS client FROM events")
def client_key(spark, sf):
    i, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    forwarded = F.when(i == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(", 10.1.1.1")))
    return events(spark, sf).select("event_id", T.client_key(forwarded, F.when(i == 1, F.concat(F.lit("host"), u)).otherwise("")).alias("client"))
