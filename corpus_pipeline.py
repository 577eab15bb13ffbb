"""The training-data pipeline: five stages over ``documents``, each one operator applied to all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import stages
from groundwork.llm.common import documents, written

STAGES = [
    ("language_id", stages.known_language),
    ("simhash_near_dedup", stages.one_of_each_group),
    ("suffix_array_dedup", stages.without_repeats),
    ("mix_sources", stages.mixed),
    ("mixture_packing", stages.packed),
]

#: No SQL: the stages use learned classifiers, fingerprint components and a tokenizer. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
