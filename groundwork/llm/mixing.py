"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, ranked, written

BITS, LEVELS, HASH_BITS = 12, 3, 60


def key_hash(key: Column) -> Column:
    """60 bits of md5 of the key's text (null: empty), as a long: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Adds ``target`` to (no_source, source, source_size): shares of all words by weight, none above its cap.

    With cap = max_repeat * size, the targets are min(cap, level * weight) for the one level at which they sum to all
    words. The level is found by fixing the sources at their cap and sharing the rest anew until no more get fixed;
    each turn is one aggregate, and the driver sees its three sums only.
    """
    turn = ranked(sizes, [], [F.col("no_source"), F.col("source")], "turn")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    s = written(turn.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * max_repeat}), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        fixed = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        caps, rest = s.agg(F.sum(F.when(fixed, F.col("cap")).otherwise(0)), F.sum(F.when(fixed, 0).otherwise(F.col("weight")))).first()
        new = (total - caps) / rest if rest else level
        if new == level or new is None:
            break
        level = new
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(float(level or 0)) * F.col("weight")))


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, key: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """How many words of each document the mix takes.

    Words are summed by source and hash bucket (12 bits of a 60-bit hash of the key). In each source the bucket in which the
    budget runs out is split by the next 12 bits, three times; the documents below the last threshold are taken
    whole, those in its bucket (fewer than one on average up to 2**36 documents) in hash order until the budget ends,
    the last one in part; rows that share a hash are numbered by ranges, not in one task. A target over the source's size takes every document whole as often as it fits, then
    the rest in that way. Nothing is sorted but the documents of the last bucket.

    Returns key, ``keep`` columns, size, source_size, target, taken. Null text: 0 words. Null source: a source of its
    own, last. Null key: hashed as the empty text. Rows of one hash go by size and a hash of what is kept. Repeated rows count and are taken one by one. No rows: no rows. Other columns of
    ``docs`` are neither read nor returned.
    """
    base = written(
        docs.select(
            F.col(key).alias("_key"),
            *(F.col(c).alias(f"_keep_{c}") for c in keep),
            F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            key_hash(F.col(key)).alias("_hash"),
            F.xxhash64("text", *keep).alias("_tie"),
            F.monotonically_increasing_id().alias("_no"),  # spreads equal rows, among which it makes no difference
        ),
        "sizes",
    )
    by = ["no_source", "source"]
    targets = source_targets(base.groupBy(*by).agg(F.sum("size").alias("source_size")), weights, max_repeat)
    words = F.round("target").cast("long")
    repeats = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.select(
        *by, "source_size", "target", repeats.alias("_repeats"), (words - repeats * F.col("source_size")).alias("_left"), F.lit(0).cast("long").alias("_prefix")
    )
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        inside = base.join(state, by).where(F.shiftright("_hash", shift + BITS) == F.col("_prefix"))
        sums = inside.groupBy(*by, F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"), F.first("_left").alias("_budget"))
        up_to = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        edge = (
            sums.withColumn("_up_to", up_to)
            .where(F.col("_up_to") > F.col("_budget"))
            .groupBy(*by)
            .agg(F.min_by(F.struct("_bucket", (F.col("_budget") - F.col("_up_to") + F.col("_sum")).alias("_rest")), "_bucket").alias("_edge"))
        )
        state = written(
            state.join(edge, by, "left").select(
                *by,
                "source_size",
                "target",
                "_repeats",
                F.coalesce("_edge._rest", F.lit(0)).cast("long").alias("_left"),
                F.coalesce("_edge._bucket", F.lit(1 << (BITS * level))).cast("long").alias("_prefix"),
            ),
            f"thresholds{level}",
        )
    placed = base.join(state, by).withColumn("_at", F.shiftright("_hash", HASH_BITS - BITS * LEVELS))
    outside = placed.where(F.col("_at") != F.col("_prefix")).withColumn("_part", F.when(F.col("_at") < F.col("_prefix"), F.col("size")).otherwise(0))
    # rows of one hash and size are alike, so a row's budget follows from the sums of earlier pairs and its number among its own
    edge = placed.where(F.col("_at") == F.col("_prefix"))
    pair = [*by, "_hash", "size"]
    earlier = Window.partitionBy(*by).orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    pairs = edge.groupBy(*pair).agg(F.sum("size").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    left = F.col("_left") - F.col("_before") - F.col("_rank") * F.col("size")
    edge = ranked(edge, pair, [F.col("_tie"), F.col("_no")], "_rank").join(pairs, pair).withColumn("_part", F.least("size", F.greatest(left, F.lit(0)))).drop("_rank", "_before")
    return outside.unionByName(edge).select(
        F.col("_key").alias(key),
        *(F.col(f"_keep_{c}").alias(c) for c in keep),
        "size",
        "source_size",
        "target",
        (F.col("_repeats") * F.col("size") + F.col("_part")).alias("taken"),
    )
