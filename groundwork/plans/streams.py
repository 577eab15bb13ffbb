"""Streams over the tables, run to the end of what is there, and sinks that are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import chunking, evaluation
from groundwork.sources import corpus
from groundwork.sources.shared import fresh_folder
from groundwork.streaming import streams

from . import retrieval, rules, traffic
from .corpus import _CHUNKS, OVERLAP, SIZE
from .registry import query, table

CLOSED = "(SELECT epoch_us(max(ts)) - 600 * 1000000 FROM events)"


def stream(spark, sf, name) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")  # as a pattern, so that one file serves as well as a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows


def finished(rows: DataFrame, mode: str, idle_batches: bool = True) -> DataFrame:
    """Runs a stream over all there is and returns its rows: those of every batch in append mode, of the last one in complete mode.

    A stream whose state ends by the clock would go on for ever with batches without data, so it runs without these (``idle_batches``).
    """
    spark = rows.sparkSession
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(idle_batches and before == "true").lower())
    out = fresh_folder(spark, "stream")
    schema = rows.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={number if mode == 'append' else 0}")

    held = rows.writeStream.outputMode(mode).option("checkpointLocation", fresh_folder(spark, "state")).trigger(availableNow=True).foreachBatch(keep).start()
    spark.conf.set(setting, before)
    held.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/v=*")


@query("SELECT event_type AS path, count(*) AS request_count, count_if(event_type = 'error')::BIGINT AS error_count, round(sum(value), 4) AS latency_sum FROM events GROUP BY 1")
def stream_request_metrics(spark, sf):
    rows = streams.request_metrics(stream(spark, sf, "events"), "event_type", F.col("event_type") == "error", "value")
    return finished(rows, "complete").withColumn("latency_sum", F.round("latency_sum", 4))


@query(f"""SELECT user_id, epoch_us(ts) // 1000000 // 3600 * 3600 AS started, count(*) AS n, least(count(*), 2) AS n_allowed, greatest(count(*) - 2, 0) AS n_denied FROM events GROUP BY 1, 2
HAVING (started + 3600) * 1000000 <= {CLOSED}""")
def stream_quota_aligned(spark, sf):
    return finished(streams.quota_aligned(stream(spark, sf, "events"), "user_id", 2), "append").withColumn("started", F.unix_seconds("started"))


@query(traffic._folded("epoch_us(ts) // 1000000", traffic.DAY) + f"SELECT user_id, event_id, turn <= {traffic.LIMIT} AS allowed, greatest({traffic.LIMIT} - turn, 0)::BIGINT AS remaining, start + {traffic.DAY} AS reset_at FROM w")
def stream_quota_anchored(spark, sf):
    return finished(streams.quota_anchored(stream(spark, sf, "events"), "user_id", "event_id", traffic.LIMIT, traffic.DAY), "append")


@query(traffic._folded("epoch_us(ts)", traffic.TTL * 1000000) + f"SELECT user_id, event_id, turn > 1 AS hit, round(start / 1000000 + {traffic.TTL}, 6)::DOUBLE AS expires_at FROM w")
def stream_cache_hits(spark, sf):
    return finished(streams.cache_hits(stream(spark, sf, "events"), "user_id", "event_id", traffic.TTL), "append")


@query(f"""WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000)::INT, 0) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, session HAVING epoch_us(max(ts)) + 1800000000 <= {CLOSED}""")
def stream_sessions(spark, sf):
    rows = finished(streams.sessions(stream(spark, sf, "events"), "user_id"), "append")
    return rows.withColumns({"started": F.unix_micros("started"), "ended": F.unix_micros("ended")})


@query()
def stream_clarification(spark, sf):
    users = stream(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", "text")
    return finished(streams.clarify_stream(users, operations=rules.WORDS), "append", idle_batches=False)


@query("SELECT conv_id AS session_id, turn, text AS answer FROM conversations WHERE role = 'assistant'")
def stream_audit(spark, sf):
    rows = stream(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("answer"))
    out = fresh_folder(spark, "audit")
    streams.append_to(rows, out, fresh_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query(f"""SELECT md5('doc_' || doc_id || ':' || chunk_index) AS chunk_id, doc_id, chunk_index, total_chunks, token_count, text FROM (SELECT doc_id, text, least(length(text) // 4, 512) AS token_count,
(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM ({_CHUNKS}) WHERE length(text) // 4 >= 50)""")
def incremental_ingest(spark, sf):
    """New documents are chunked whole, numbered, keyed by document and number, and upserted, a micro-batch at a time."""

    def prepare(batch: DataFrame) -> DataFrame:
        chunks = chunking.number_chunks(chunking.in_token_range(chunking.chunk_fixed(batch, "doc_id", SIZE, OVERLAP)), "doc_id", "start")
        key = T.chunk_id(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("chunk_index"))
        return chunks.select(key.alias("chunk_id"), "doc_id", "chunk_index", "total_chunks", "token_count", "text", F.lit(0).alias("seq"))

    rows = stream(spark, sf, "documents").select("doc_id", "text")
    out = fresh_folder(spark, "chunks")
    streams.incremental_upsert(rows, out, "chunk_id", "seq", fresh_folder(spark, "state"), prepare).trigger(availableNow=True).start().awaitTermination()
    return streams.snapshot(spark, out, prepare(table(spark, sf, "documents").limit(0)).drop("seq").schema)


# --- sinks, read back ----------------------------------------------------------------------------------------------
@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def reset_collection(spark, sf):
    out, docs = fresh_folder(spark, "collection"), table(spark, sf, "documents")
    corpus.reset(docs.select("doc_id", F.lit("old").alias("lang")), out)
    corpus.reset(docs.select("doc_id", "lang"), out)
    return spark.read.schema("doc_id bigint, lang string").parquet(out).groupBy("lang").agg(F.count("*").alias("n"))


@query(retrieval._RESULTS + f"SELECT case_count, round(hit_at_k, 9) AS hit_at_k, round(mrr, 9) AS mrr FROM ({retrieval._SUMMARY})")
def write_eval_report(spark, sf):
    out = fresh_folder(spark, "report")
    report = evaluation.summary(retrieval.results(spark, sf))
    corpus.write_report(report, out)
    back = spark.read.schema(report.schema).json(out)
    return back.select("case_count", F.round("hit_at_k", 9).alias("hit_at_k"), F.round("mrr", 9).alias("mrr"))


@query("SELECT text AS query, item_id % 3 <> 0 AS answerable, 'doc_' || item_id AS expected FROM benchmark")
def load_eval_cases(spark, sf):
    case = F.struct(F.col("text").alias("question"), (F.col("item_id") % 3 != 0).alias("answerable"), F.array().cast("array<string>").alias("expected_chunks"), F.array(F.concat(F.lit("doc_"), F.col("item_id").cast("string"))).alias("required_source_ids"))
    out = fresh_folder(spark, "cases")
    table(spark, sf, "benchmark").select(F.to_json(F.struct(F.array(case).alias("cases"))).alias("value")).write.option("maxRecordsPerFile", 1).text(out)
    return corpus.load_eval_cases(spark, out).select("query", "answerable", F.array_join("expected", ",").alias("expected"))


@query("""SELECT 'standard_' || doc_id || '_' || coalesce(lang, 'none') || '_x.md' AS file_name, lang AS source_language, max(coalesce(text, '')) AS text FROM documents WHERE lang IN ('en', 'fr') GROUP BY doc_id, lang""")
def scan_corpus(spark, sf):
    """All documents as files named by key and language, and two files that don't belong; the scan opens those in two languages."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("standard_"), F.col("doc_id").cast("string"), F.lit("_"), F.coalesce("lang", F.lit("none")), F.lit("_x.md"))
    others = spark.createDataFrame([("INDEX.md", "x"), ("notes_en_.txt", "x")], "file_name string, content string")
    out = fresh_folder(spark, "files")
    corpus.write_markdown(d.select(name.alias("file_name"), F.col("text").alias("content")).unionByName(others), out)
    return corpus.scan_corpus(spark, out, ("en", "fr"), known=("ar", "en", "fr")).select("file_name", "source_language", "text")
