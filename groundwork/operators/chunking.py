"""Sections and chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window


def sections(docs: DataFrame, key: str, heading: str) -> DataFrame:
    """(key, section, title, text): lines grouped under the last heading line before them.

    A heading is the group's title and no part of its text; text before any heading is "Introduction"; a heading right after a
    heading replaces it. The running group number is a window per document, bounded by its lines.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).withColumn("head", F.col("line").rlike(heading))
    running = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumn("section", F.sum(F.col("head").cast("int")).over(running))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("at", "line"))))
    out = grouped.groupBy(key, "section").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.trim("line"))), F.lit("Introduction")).alias("title"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")
    )
    return out.where(F.trim("text") != "")


def chunk_fixed(docs: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """(key, start, text): windows of ``size`` characters, each ``overlap`` into the one before; an empty text gives one empty chunk."""
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size - overlap)))
    rows = docs.where(F.col("text").isNotNull()).select(key, "text", starts.alias("start"))
    return rows.select(key, "start", F.substr("text", "start", F.lit(size)).alias("text"))


def number_chunks(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """0-based index per document over the given chunks, and their number."""
    by = Window.partitionBy(key)
    return chunks.withColumns({"chunk_index": F.row_number().over(by.orderBy(order)) - 1, "total_chunks": F.count("*").over(by)})


def in_token_range(chunks: DataFrame, least: int = 50, most: int = 512) -> DataFrame:
    """Drops chunks of under ``least`` tokens (characters / 4) and clips the count at ``most``."""
    tokens = F.floor(F.length("text") / 4).cast("long")
    return chunks.withColumn("token_count", F.least(tokens, F.lit(most).cast("long"))).where(tokens >= least)


#: Paragraphs, lines, sentences of Latin and Arabic script, clauses, words, characters.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "؟ ", "۔ ", "؛ ", "; ", "، ", ", ", ": ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, stop) of chunks of at most ``size`` characters that cover the text.

    A chunk ends after the last occurrence of the first separator that has one in reach. The next one starts at most ``overlap`` characters
    before that end: after the first separator of the best kind there, or right at the end where none stands in the overlap.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        stop = min(start + size, n)
        if stop < n:
            for s in separators:
                at = text.rfind(s, start + overlap + 1, stop) if s else stop
                if at >= 0:
                    stop = min(stop, at + len(s))
                    break
        out.append((start, stop))
        if stop >= n:
            break
        back, start = max(start + 1, stop - overlap), stop
        for s in separators:
            at = text.find(s, max(0, back - len(s)), stop) if s else -1
            if back <= at + len(s) < stop and at >= 0:
                start = at + len(s)
                break
    return out


def chunk_recursive(docs: DataFrame, key: str, size: int = 512, overlap: int = 50, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(key, chunk_index, start, stop, text): ``split_text`` of every whole text, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], [[], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(split_text(text or "", size, overlap, separators)):
                    rows.append(i)
                    for c, v in zip(columns, (k, a, b, text[a:b])):
                        c.append(v)
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *made], names=[key, "chunk_index", "start", "stop", "text"])

    rows = docs.select(key, "text")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, chunk_index int, start int, stop int, text string")


def register_chunker(spark: SparkSession, name: str = "chunk_text", separators: Sequence[str] = SEPARATORS) -> None:
    """Makes ``split_text`` a table function for SQL: ``FROM docs, LATERAL chunk_text(text, size, overlap)`` gives (chunk_index, start, stop, text). A null or empty text gives no rows."""

    class Chunks:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
            for k, (a, b) in enumerate(split_text(text or "", size, overlap, separators)):
                yield k, a, b, text[a:b]

    spark.udtf.register(name, udtf(Chunks, returnType="chunk_index int, start int, stop int, text string"))


def chunk_sections(docs: DataFrame, key: str, heading: str, *, size: int = 2048, overlap: int = 200, least: int = 50, most: int = 512, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(key, section, title, chunk_index, total_chunks, token_count, text): sections cut by ``split_text``, chunks of under ``least`` tokens dropped, the rest numbered per document.

    ``size`` and ``overlap`` count characters, four to a token. Null texts and documents without a chunk in range give no rows.
    """
    parts = sections(docs.where(F.col("text").isNotNull()), key, heading)
    named = parts.select(F.struct(key, "section", "title").alias("_at"), "text")
    cut = chunk_recursive(named, "_at", size, overlap, separators)
    kept = in_token_range(cut.select("_at.*", F.col("chunk_index").alias("_part"), "text"), least, most)
    placed = kept.withColumn("_order", F.struct("section", "_part"))
    return number_chunks(placed, key, "_order").select(key, "section", "title", "chunk_index", "total_chunks", "token_count", "text")
