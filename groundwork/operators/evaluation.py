"""Retrieval evaluation: hits, reciprocal ranks, rates and gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_results(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per case: matched, reciprocal rank of the first relevant row, and the share of expected ids found.

    ``cases`` has query_id, answerable, expected (array); ``retrieved`` has query_id, rank, ids (all ids that a row answers to).
    """
    joined = cases.join(retrieved, "query_id", "left")
    relevant = F.coalesce(F.arrays_overlap("expected", "ids"), F.lit(False))
    per = joined.groupBy("query_id").agg(
        F.first("answerable").alias("answerable"),
        F.first("expected").alias("expected"),
        F.count("rank").alias("n_retrieved"),
        F.bool_or(relevant).alias("matched"),
        F.coalesce(1 / F.min(F.when(relevant, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("candidates"),
    )
    found = F.size(F.array_intersect("expected", "candidates"))
    return per.withColumn("recall_fraction", F.when(F.size("expected") > 0, found / F.size("expected")).otherwise(0.0))


def summary(results: DataFrame) -> DataFrame:
    """hit@k, MRR and recall over answerable cases, retrieval rate over the others; 0 where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    of = lambda c: F.avg(F.when(F.col("answerable"), c))
    return results.agg(
        F.count("*").alias("case_count"),
        F.count_if("answerable").alias("answerable_case_count"),
        zero(of(F.col("matched").cast("double"))).alias("hit_at_k"),
        zero(of(F.col("matched").cast("double"))).alias("recall_at_k"),
        zero(of(F.col("reciprocal_rank"))).alias("mrr"),
        zero(of(F.col("recall_fraction"))).alias("recall_fraction"),
        zero(F.avg(F.when(~F.col("answerable"), (F.col("n_retrieved") > 0).cast("double")))).alias("unanswerable_retrieval_rate"),
    )


def gates(report: DataFrame, least: Mapping[str, float], most: Mapping[str, float]) -> DataFrame:
    """One row per gate: metric, actual, bound, passed, and whether all passed. Bounds outside [0, 1] are an error."""
    for name, bound in [*least.items(), *most.items()]:
        if not 0 <= bound <= 1 and not name.endswith("count"):
            raise ValueError(f"the bound of {name} must be between 0 and 1")
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("actual"), F.lit(float(b)).alias("bound"), (F.col(n) >= b).alias("passed")) for n, b in least.items()]
    rows += [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("actual"), F.lit(float(b)).alias("bound"), (F.col(n) <= b).alias("passed")) for n, b in most.items()]
    every = report.select(F.array(*rows).alias("g")).withColumn("all_passed", F.forall("g", lambda x: x["passed"]))
    return every.select(F.explode("g").alias("x"), "all_passed").select("x.*", "all_passed")
