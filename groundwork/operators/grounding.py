"""Citations of answers held against what was retrieved for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import citations as C


def cited(answers: DataFrame) -> DataFrame:
    """(answer_id, position, standard, section) of every citation marker."""
    return answers.select("answer_id", F.explode(C.parse_citations(F.col("answer"))).alias("c")).select("answer_id", "c.position", "c.standard", "c.section")


def _met(citations: DataFrame, chunks: DataFrame, how: str) -> DataFrame:
    c = chunks.withColumnsRenamed({"answer_id": "_answer", "standard": "chunk_standard", "section": "chunk_section"})
    section = F.col("section").isNull() | F.col("_norm").isNull() | (F.col("section") == F.col("_norm"))
    return citations.join(c.withColumn("_norm", C.normalize_section(F.col("chunk_section"))), (F.col("answer_id") == F.col("_answer")) & (F.col("standard") == F.col("chunk_standard")) & section, how)


def evidence(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Backed citations: per answer and (standard, section) of a chunk, the first chunk met, in order of citation and rank.

    ``chunks`` has answer_id, rank, chunk_id, standard (normalised), section, text. A missing section on either side matches any.
    """
    met = _met(citations, chunks, "inner")
    first = F.min_by(F.struct("chunk_id", "text", "rank"), F.struct("position", "rank")).alias("x")
    return met.groupBy("answer_id", "chunk_standard", "chunk_section").agg(first).select(
        "answer_id", F.col("chunk_standard").alias("standard"), F.col("chunk_section").alias("section"), "x.chunk_id", C.evidence_quote(F.col("x.text")).alias("quote")
    )


def unsupported(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations that no chunk backs."""
    return _met(citations, chunks, "left_anti")


def marker_positions(citations: DataFrame, markers: DataFrame) -> DataFrame:
    """For each marker (answer_id, marker, standard, section): the position of the first citation that matches, else -1."""
    m = markers.withColumnsRenamed({"standard": "_s", "section": "_n"}).withColumnRenamed("answer_id", "_a")
    hit = m.join(citations, (F.col("answer_id") == F.col("_a")) & (F.col("standard") == F.col("_s")) & (F.col("_n").isNull() | F.col("section").isNull() | (F.col("section") == F.col("_n"))), "left")
    return hit.groupBy(F.col("_a").alias("answer_id"), "marker").agg(F.coalesce(F.min("position"), F.lit(-1)).alias("position"))


def supported_refs(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("standard") != "") & (F.col("section") != "")).select("answer_id", "standard", "section").distinct()


def with_status(answers: DataFrame, backed: DataFrame) -> DataFrame:
    """Answers with n_citations and the status that their words and citations give."""
    n = backed.groupBy("answer_id").agg(F.count("*").alias("n_citations"))
    out = answers.join(n, "answer_id", "left").fillna(0, ["n_citations"])
    return out.withColumn("status", C.derive_status(F.col("answer"), F.col("n_citations")))


def prompt_context(chunks: DataFrame, fallback: str = "No sources were found.") -> DataFrame:
    """(answer_id, context): ``[i] standard §section (score: 0.00)`` and text of each chunk in rank order, joined by ---."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("standard"), F.when(F.col("section").isNotNull(), F.concat(F.lit(" §"), F.col("section"))).otherwise(""))
    body = F.concat(head, F.lit(" (score: "), F.format_string("%.2f", "score"), F.lit(")\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", body.alias("t"))))
    return chunks.groupBy("answer_id").agg(F.coalesce(F.nullif(F.array_join(F.transform(parts, lambda x: x["t"]), "\n---\n"), F.lit("")), F.lit(fallback)).alias("context"))
