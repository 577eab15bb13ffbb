"""Nearest neighbours, reranking, thresholds and fallbacks for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwork.operators.neighbours import MOST_BYTES, knn_approx, knn_exact, rank_within_query  # noqa: F401  (part of this surface)


def at_threshold(rows: DataFrame, score: str, threshold: float) -> DataFrame:
    return rows.where(F.col(score) >= min(max(threshold, 0.0), 1.0))


def rescored(rows: DataFrame, hits: Column, same_language: Column) -> DataFrame:
    """similarity + 0.035 for each of up to 4 term hits + 0.015 for the same language, at most 1."""
    bonus = F.lit(0.035) * F.least(hits, F.lit(4)) + F.when(same_language, 0.015).otherwise(0.0)
    return rows.withColumn("score", F.round(F.least(F.col("similarity") + bonus, F.lit(1.0)), 6))


def topk_rerank(candidates: DataFrame, k: int, threshold: float, *, fallback: bool = False) -> DataFrame:
    """Best k of rescored candidates over the threshold; with ``fallback``, a query of which none passes keeps its best k."""
    limit = min(max(threshold, 0.0), 1.0)
    passes = F.col("score") >= limit
    if fallback:
        passes = passes | (F.max(F.col("score")).over(Window.partitionBy("query_id")) < limit)
    return rank_within_query(candidates.drop("rank").withColumn("_in", passes).where("_in").drop("_in"), "score", k)


def wide_retry(found: DataFrame, queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int) -> DataFrame:
    """Adds results of a wider search, max(8k, 40) without threshold, for the queries that found nothing."""
    left = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(search(left, max(8 * k, 40)).select(*found.columns))


def _joined(words: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def expand_terms(queries: DataFrame, lexicon: DataFrame, least: int = 3, most_words: int = 2) -> DataFrame:
    """(query_id, terms): sorted set of a query's tokens and the expansions of triggers, which may be several words or the head of ``trigger/...``.

    ``lexicon`` has trigger and expansions.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}/]+"), lambda w: w != "")
    grams = [words]
    for n in range(2, most_words + 1):
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        grams.append(F.transform(at, _joined(words, n)))
    tokens = queries.select("query_id", F.explode(F.array_distinct(F.concat(*grams))).alias("token"))
    tokens = tokens.withColumn("_head", F.split_part("token", F.lit("/"), F.lit(1)))
    hits = tokens.join(lexicon, F.col("_head") == F.col("trigger"), "left")
    single = F.when(~F.col("token").contains(" "), F.array("token")).otherwise(F.array().cast("array<string>"))
    terms = hits.select("query_id", F.explode(F.concat(single, F.coalesce("expansions", F.array().cast("array<string>")))).alias("term")).where(F.length("term") >= least)
    return terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def lexical_hits(haystack: Column, terms: Column) -> Column:
    low = F.lower(haystack)
    return F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))


def hashed_embedding(texts: DataFrame, text: str = "text", dims: int = 768) -> DataFrame:
    """The default embedder: unit vectors of hashed word counts; an empty text gives an empty vector."""
    rows = texts.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    words = Tokenizer(inputCol="_text", outputCol="_words").transform(rows)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
    vector = F.when(F.trim("_text") == "", F.array().cast("array<float>")).otherwise(vector_to_array("_unit", "float32"))
    return unit.withColumn("vector", vector).drop("_text", "_words", "_counts", "_unit")


def embed_distinct(rows: DataFrame, text: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embeds each distinct text once and joins the vectors back, by a 256-bit hash of the text, so that of every distinct text one copy a task is shuffled and no row's."""
    hashed = rows.withColumn("_hash", F.sha2(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("")).cast("binary"), 256))
    distinct = hashed.groupBy("_hash").agg(F.first(text).alias("text"))
    vectors = embed(distinct).select("_hash", "vector")
    return hashed.join(vectors, "_hash", "left").drop("_hash")


def passages_in(docs: DataFrame, passages: DataFrame, key: str, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(passage_id, key): documents whose text holds a passage whole. ``passages`` has passage_id and text.

    One pass over the texts per block of passages of at most ``most_bytes`` (measured first), with a string automaton that finds all of them at once;
    nothing but the hits is shuffled.
    """
    import ahocorasick

    total = passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // most_bytes))
    rows, out = docs.select(key, "text"), None
    schema = f"passage_id {passages.schema['passage_id'].dataType.simpleString()}, `{key}` {rows.schema[key].dataType.simpleString()}"
    for block in range(blocks):
        words: dict[str, list] = {}
        for r in passages.where(F.pmod(F.xxhash64("passage_id"), F.lit(blocks)) == block).where("text <> ''").toLocalIterator():
            words.setdefault(r.text, []).append(r.passage_id)
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for text, ids in shared.value.items():
                machine.add_word(text, ids)
            if shared.value:
                machine.make_automaton()
            for batch in batches:
                hits, at = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    found = {p for _, ids in machine.iter(text) for p in ids} if text and shared.value else ()
                    hits += found
                    at += [i] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), batch.column(0).take(pa.array(at, pa.int64()))], names=["passage_id", key])

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out
