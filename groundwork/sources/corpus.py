"""Corpus files, evaluation cases, event logs, and the sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators.scans import written

from .files import TextFiles

EXCLUDED = ("INDEX.md", "CONVERSION_SUMMARY.md", ".gitkeep")
EXPECTED_FIELDS = ("expected_chunk_ids", "expected_chunks", "required_source_ids", "expected_standards")


def scan_corpus(spark: SparkSession, root: str, languages: Sequence[str], excluded: Sequence[str] = EXCLUDED, known: Sequence[str] = ("ar", "en"), partitions: int = 64) -> DataFrame:
    """(path, file_name, source_language, text) of the Markdown files in the wanted languages, of any depth. Sort by path where order matters.

    Languages are told by the file name, among the codes ``known``; other files are not opened. An empty folder gives no rows.
    """
    spark.dataSource.register(TextFiles)
    lists = {"languages": languages, "excluded": excluded, "known": known}
    return spark.read.format("text_files").options(partitions=partitions, **{name: json.dumps(list(x)) for name, x in lists.items()}).load(root)


def load_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query, answerable, expected) from JSON: a list of cases, or an object with ``cases`` or ``questions``."""
    case = "struct<query:string,question:string,answerable:boolean," + ",".join(f"{f}:array<string>" for f in EXPECTED_FIELDS) + ">"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{case}>")
    inside = F.from_json("value", f"struct<cases:array<{case}>,questions:array<{case}>>")
    cases = raw.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(inside["cases"], inside["questions"]))).alias("c")).select("c.*")
    expected = F.coalesce(*(F.when(F.size(f) > 0, F.col(f)) for f in EXPECTED_FIELDS), F.array().cast("array<string>"))
    return cases.select(F.coalesce("query", "question").alias("query"), F.coalesce("answerable", F.lit(True)).alias("answerable"), expected.alias("expected"))


def parse_event_log(log: Column) -> Column:
    """array<struct<seq, event, data, valid>>: blocks of an event-stream text that name an event; data lines are joined."""
    blocks = F.filter(F.split(F.replace(log, F.lit("\r\n"), F.lit("\n")), "\n\n"), lambda b: b.rlike(r"(?m)^event:\s*\S"))

    def parsed(b: Column, i: Column) -> Column:
        data = F.array_join(F.regexp_extract_all(b, F.lit(r"(?m)^data:[ ]?(.*)$"), 1), "\n")
        return F.struct(i.alias("seq"), F.trim(F.regexp_extract(b, r"(?m)^event:\s*(.*)$", 1)).alias("event"), data.alias("data"), F.try_parse_json(data).isNotNull().alias("valid"))

    return F.transform(blocks, parsed)


def markdown_document(number: Column, language: Column, title: Column, body: Column, prefix: str) -> tuple[Column, Column]:
    """(file name, content): YAML front matter, body and a closing line."""
    name = F.concat(F.lit(f"{prefix}_"), number, F.lit("_"), language, F.lit("_"), T.safe_filename(title), F.lit(".md"))
    front = F.concat(F.lit("---\ntitle: \""), F.replace(title, F.lit('"'), F.lit("'")), F.lit('"\nnumber: "'), number, F.lit('"\nlanguage: "'), language, F.lit('"\n---\n\n# '), title)
    return name, F.concat(front, F.lit("\n\n"), body, F.lit("\n\n---\n*End of document*\n"))


def write_markdown(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """``docs`` (file_name, content) as files of those names in ``buckets`` folders, in place of what is there.

    Of rows with one name the greatest content stays; null names write nothing, null contents an empty file. Names are counted first, so that only contents of repeated names are shuffled.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TextFiles)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    rows = docs.where(F.col("file_name").isNotNull()).select("file_name", F.coalesce("content", F.lit("")).alias("content"))
    repeated = written(rows.groupBy("file_name").agg(F.count("*").alias("n")).where("n > 1").select("file_name"), "names")
    several = rows.join(repeated, "file_name", "left_semi").groupBy("file_name").agg(F.max("content").alias("content"))
    rows.join(repeated, "file_name", "left_anti").unionByName(several).write.format("text_files").option("buckets", buckets).mode("append").save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A summary of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def audit_rows(answers: DataFrame) -> DataFrame:
    """One row per answer: citations and metadata as JSON, with an id and a time."""
    return answers.select(
        F.expr("uuid()").alias("audit_id"), "request_id", "session_id", "query", "status", "answer", F.to_json("citations").alias("citations"), F.to_json("metadata").alias("metadata"), F.current_timestamp().alias("created_at")
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def reset(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def expand_answer_events(answers: DataFrame) -> DataFrame:
    """(request_id, seq, event, data): started, retrieval, token, one citation each, done; a failed answer ends in error instead."""
    event = lambda name, data: F.struct(F.lit(name).alias("event"), F.to_json(data).alias("data"))
    head = F.array(event("started", F.struct("request_id")))
    body = F.concat(
        F.array(event("retrieval", F.struct("confidence")), event("token", F.struct(F.col("answer").alias("text")))),
        F.transform("citations", lambda c: event("citation", F.struct(c.alias("citation")))),
        F.array(event("done", F.struct("status"))),
    )
    failed = F.array(event("error", F.struct(F.col("error").alias("message"))))
    rows = answers.select("request_id", F.posexplode(F.concat(head, F.when(F.col("error").isNull(), body).otherwise(failed))).alias("seq", "e"))
    return rows.select("request_id", "seq", "e.event", "e.data")
