"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD
from .language import UNKNOWN, identify, train
from .mixing import mix_sources
from .packing import pack
from .simhash import near_copies
from .substrings import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: null texts and those without a letter. A null lang gets the predicted one; others stay as labelled.

    Documents whose language is ambiguous stay, as they may be clean. Null ids and repeated rows are rows like any others. No rows: no rows.
    """
    book = train(docs)
    out = identify(docs.withColumn("_whole", F.col("text")), book, keep=("_whole", *REST))
    return out.where(F.col("lang_pred") != UNKNOWN).select("doc_id", F.col("_whole").alias("text"), F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every component of near copies (five-word shingles, similarity 0.8), equal rows once. Rows without an id stay, each text once.

    Null and empty texts are one component. No rows: no rows.
    """
    ids = near_copies(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    marked = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text"))
    kept = marked.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "_text"])
    nameless = marked.where("doc_id is null").dropDuplicates(["_text"])
    return kept.unionByName(nameless).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated 100-byte strings out of the texts; a document of which nothing is left goes. n_chars follows the text.

    Null texts become empty ones and stay, like empty texts; rows without an id count as the first. No rows: no rows.
    """
    left = remove_repeats(docs, texts=True, keep=("lang", "source"))
    left = left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it whole, and cuts its last copy after the words that are left.

    Documents of which the mix takes nothing go, and so do null texts and those without a word. Copies are rows of their own with the same doc_id; null ids and sources are kept. No rows: no rows.
    """
    named = docs.withColumnRenamed("source", "_source").withColumn("source", F.col("_source"))
    taken = mix_sources(named, keep=("text", "lang", "_source"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    last = F.when(part > 0, F.array(F.array_join(F.slice(words, 1, part), ""))).otherwise(F.array().cast("array<string>"))
    copies = taken.select("doc_id", F.explode(F.concat(F.array_repeat("text", whole), last)).alias("text"), "lang", F.col("_source").alias("source"))
    return copies.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the mix took into sequences. Null and empty texts are the end id alone; null ids stay null. No rows: no rows."""
    return pack(docs)
