"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_size, ranked, written

TWO_64 = 18446744073709551616.0


def _chance(*columns: object) -> F.Column:
    """A number in [0, 1) from a hash of the columns."""
    return (F.xxhash64(*columns).cast("double") / TWO_64) + 0.5


def propagate(linked: DataFrame, n: int, capacity: int, turns: int) -> DataFrame:
    """Moves linked documents towards the shard where most of their group is, ``turns`` times, under quotas.

    ``linked`` has _id, _group, shard, and ``n`` rows at most. In a turn, every (group, shard) cell votes with its size; the group's target is the fullest
    cell among shards that still have over a tenth of their room, and smaller cells ask to move there. Movers to a target are let in with the chance quota / requests: by group, so that small groups
    stay together, or document by document where the group is over a tenth of a shard, as such a group moved whole would overshoot the quota. Cells and loads are
    pre-aggregated; the documents meet one row per cell, which is broadcast where the cell is hot (``joined_by_size``).
    """
    for turn in range(turns):
        cells = linked.groupBy("_group", "shard").agg(F.count("*").alias("_n"))
        loads = F.broadcast(cells.groupBy("shard").agg(F.sum("_n").alias("_load")))  # one row per shard
        roomy = cells.join(loads, "shard").withColumn("_room", F.greatest(F.lit(capacity) - F.col("_load"), F.lit(0)))
        spread = F.col("_room") > capacity // 10  # a shard that is nearly full draws no more documents
        order = F.struct("_n", F.xxhash64("_group", "shard"))
        best = F.max(F.struct(spread.cast("int").alias("open"), order.alias("order"), F.col("shard").alias("shard"))).alias("_best")
        target = roomy.groupBy("_group").agg(best, F.sum("_n").alias("_all"))
        target = target.where("_best.open = 1").select("_group", "_all", F.col("_best.shard").alias("_target"), F.col("_best.order").alias("_order"))
        moves = cells.join(target, "_group").where((F.col("shard") != F.col("_target")) & (order < F.col("_order")))
        asked = moves.groupBy("_target").agg(F.sum("_n").alias("_asked"))
        room = loads.select(F.col("shard").alias("_target"), F.greatest(F.lit(capacity) - F.col("_load"), F.lit(0)).alias("_quota"))
        chance = F.broadcast(asked.join(room, "_target", "left").select("_target", F.least(F.coalesce("_quota", F.lit(capacity)) / F.col("_asked"), F.lit(1.0)).alias("_chance")))
        goal = moves.join(chance, "_target").select("_group", "shard", "_n", "_all", "_target", "_chance")
        by = F.when(F.col("_all") > capacity / 10, _chance("_id", "_group", F.lit(turn))).otherwise(_chance("_group", F.lit(turn)))
        moved = joined_by_size(linked, goal, ["_group", "shard"], "_n", n, "left").withColumn("shard", F.when(by < F.col("_chance"), F.col("_target")).otherwise(F.col("shard")))
        linked = written(moved.select("_id", "_group", "shard"), f"labels{turn}")
    return linked


def shard_documents(docs: DataFrame, *, shards: int = 24, turns: int = 6, key: str = "doc_id") -> DataFrame:
    """Puts all documents into ``shards`` shards whose counts differ by one at most (law ``rows``), equal texts together where they fit.

    Documents with equal texts are linked (null text: as the empty one). Labels start from a hash and are propagated (``propagate``). Then the law is made exact:
    each shard keeps linked documents up to its count, in group order; unlinked ones and the overflow, groups in a row, fill
    what is left. Ranks come from range partitions, so no task or driver holds a shard. Chances and order come from a document's rank by key and text,
    so a rerun, or another partitioning of the input, gives equal rows.

    Returns key, size (UTF-8 bytes + 8), text_crc32, law, shard, slot (from 0, no gaps), grown_shard (null), group_size.
    Null or repeated keys are rows like any others; which of several equal rows gets which slot does not matter. No rows: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_group"),
    )
    # equal rows are told apart by their place, which only says which of them is which
    base = ranked(base.withColumn("_tie", F.monotonically_increasing_id()), [], [F.col("_key"), F.col("_group"), F.col("_tie")], "_id").drop("_tie")
    base = written(base, "documents")
    n = base.count()
    capacity = -(-n // shards)
    sizes = base.groupBy("_group").agg(F.count("*").alias("group_size"))
    base = written(joined_by_size(base, sizes, ["_group"], "group_size", n), "grouped")

    start = F.pmod(F.xxhash64("_group", "_id"), F.lit(shards)).cast("int")
    labels = propagate(base.where("group_size > 1").select("_id", "_group", start.alias("shard")), n, capacity, turns)
    linked = ranked(labels, ["shard"], [F.col("_group"), F.col("_id")], "_rank")
    room = F.lit(n // shards) + (F.col("shard") < n % shards).cast("long")
    linked = linked.withColumn("_kept", F.col("_rank") < room)
    kept = linked.where("_kept").select("_id", "shard", F.col("_rank").alias("slot"))

    held = dict(kept.groupBy("shard").count().collect())  # one row per shard
    ends, starts, end = [], [], 0
    for shard in range(shards):
        starts.append(held.get(shard, 0) - end)
        end += n // shards + (shard < n % shards) - held.get(shard, 0)
        ends.append(end)

    overflow = linked.where("not _kept").select("_id", "_group")
    pool = ranked(base.where("group_size = 1").select("_id", "_group").unionByName(overflow), [], [F.col("_group"), F.col("_id")], "_place")
    full = sum((F.col("_place") >= e).cast("int") for e in ends[:-1])
    filled = pool.withColumn("shard", full if shards > 1 else F.lit(0))
    filled = filled.select("_id", "shard", (F.col("_place") + F.element_at(F.array(*map(F.lit, starts)), F.col("shard") + 1)).cast("long").alias("slot"))
    return base.join(kept.unionByName(filled), "_id").select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "group_size",
    )
