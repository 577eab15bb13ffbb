"""Running values per key in order, without one task per key: range partitions, and one carried row for each (range, key)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from groundwork.sources.shared import fresh_folder

BLOCK = 1 << 16  # rows of one key that a task follows at once


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: lineage ends here, and lost executors lose nothing."""
    path = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with _range: ranges by (keys, order) of about equal size, so that a key with many rows has many ranges. ``order`` must tell a key's rows apart well enough."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def within(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """A key's rows of one range, in order: never more than a range holds."""
    return Window.partitionBy("_range", *keys).orderBy(*order)


def carried(rows: DataFrame, keys: Sequence[str], facts: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns ``carries``: expressions over the ``facts`` (aggregates) of each (range, key), which may look at the key's other ranges through ``earlier()``."""
    totals = rows.groupBy("_range", *keys).agg(*(c.alias(n) for n, c in facts.items()))
    made = totals.select(F.col("_range").alias("_of"), *(F.col(k).alias(f"_of_{k}") for k in keys), *(c.alias(n) for n, c in carries.items()))
    return joined(rows, made, {"_range": "_of"} | {k: f"_of_{k}" for k in keys}).drop("_of", *(f"_of_{k}" for k in keys))


def joined(rows: DataFrame, facts: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """A join in which null keys meet null keys."""
    same = F.lit(True)
    for mine, theirs in on.items():
        same = same & F.col(mine).eqNullSafe(F.col(theirs))
    return rows.join(facts, same, how)


def earlier(keys: Sequence[str]) -> WindowSpec:
    """A key's earlier ranges."""
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n") -> DataFrame:
    """``rows`` with their number from 1 within ``keys`` by ``order``."""
    held = ranges(rows, keys, order)
    held = carried(held, keys, {"_n": F.count("*")}, {"_before": F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0))})
    return held.withColumn(out, F.row_number().over(within(keys, order)) + F.col("_before")).drop("_range", "_before")


def _segments(batches: Iterator[pa.RecordBatch], block: int, rank: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows of (key, block), several at once, with each row's rank; a run starts where the rank is a multiple of ``block``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(batch.column(rank).to_numpy() % block == 0)
        if len(starts):
            done = [*held, batch.slice(0, int(starts[-1]))]
            held = []
            if sum(b.num_rows for b in done):
                whole = pa.Table.from_batches(done).combine_chunks()
                yield whole, whole.column(rank).to_numpy()
            batch = batch.slice(int(starts[-1]))
        held.append(batch)
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, whole.column(rank).to_numpy()


def _inside(rank: np.ndarray, after: np.ndarray, total: np.ndarray, block: int) -> np.ndarray:
    """Each row's next one as a place in the table, itself if that is in another block or there is none."""
    here = (after < total) & (after // block == rank // block)
    return np.arange(len(rank)) + np.where(here, after - rank, 0)


def chains(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``rows`` (key, _rank from 0, _after: the rank of the row to go on with, _total) with _start: the rank of the row at or before each one that is reached from the key's first row.

    A key's rows are cut into blocks of ``block`` rows. In a block pointers are doubled in memory, which gives where each row leaves it. Keys of several blocks then find the row by which each
    block is entered by doubling these exits, in as many joins as the number of blocks has bits. Last, each block marks what its entry reaches, and the last mark of earlier blocks is carried on.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block).cast("long"))
    fields = [*rows.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    most = rows.agg(F.max("_total")).first()[0] or 0
    entries = None
    if most > block:
        large = rows.where(F.col("_total") > block).select(F.col(key).alias("_k"), "_block", "_rank", "_after", "_total")

        def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, rank in _segments(batches, block, 2):
                after, total = table.column(3).to_numpy(), table.column(4).to_numpy()
                to = _inside(rank, after, total, block)
                while (to != to[to]).any():
                    to = to[to]
                out = pa.table([table.column(0), pa.array(rank), pa.array(after[to])], names=["_k", "_rank", "_exit"]).filter(pa.array(after[to] < total))
                yield from out.to_batches()

        kind = large.schema["_k"].dataType.simpleString()
        dealt = large.repartition(n, "_k", "_block").sortWithinPartitions("_k", "_block", "_rank")
        jump = written(dealt.mapInArrow(leave, f"_k {kind}, _rank long, _exit long"), "exits")
        entries = large.where("_rank = 0").select("_k", "_rank")
        for _ in range(int(most // block).bit_length()):
            other = jump.select(F.col("_k").alias("_ok"), F.col("_rank").alias("_orank"), F.col("_exit").alias("_oexit"))
            found = joined(entries, other, {"_k": "_ok", "_rank": "_orank"}, "inner").select("_k", F.col("_oexit").alias("_rank"))
            entries = written(entries.unionByName(found), "entries")
            jump = written(joined(jump, other, {"_k": "_ok", "_exit": "_orank"}, "inner").select("_k", "_rank", F.col("_oexit").alias("_exit")), "exits")
    if entries is None:
        rows = rows.withColumn("_entry", F.lit(0).cast("long"))
    else:
        marks = entries.select(F.col("_k").alias("_ek"), F.floor(F.col("_rank") / block).cast("long").alias("_eb"), F.col("_rank").alias("_entry"))
        rows = joined(rows, marks, {key: "_ek", "_block": "_eb"}).select(*fields, F.when(F.col("_total") <= block, 0).otherwise(F.col("_entry")).cast("long").alias("_entry"))
    at = [rows.columns.index(c) for c in ("_rank", "_after", "_total", "_entry")]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rank in _segments(batches, block, at[0]):
            after, total = table.column(at[1]).to_numpy(), table.column(at[2]).to_numpy()
            entry = table.column(at[3]).fill_null(-1).to_numpy()
            marked, to = rank == entry, _inside(rank, after, total, block)
            while True:
                marked[to[marked]] = True
                if (to == to[to]).all():
                    break
                to = to[to]
            first = np.flatnonzero(rank % block == 0)
            base = np.repeat(first, np.diff([*first, len(rank)]))
            last = np.maximum.accumulate(np.where(marked, np.arange(len(rank)), -1))
            start = np.where(last >= base, rank[np.maximum(last, 0)], -1)
            yield from table.drop_columns("_entry").append_column("_start", pa.array(start, mask=start < 0)).to_batches()

    dealt = rows.repartition(n, key, "_block").sortWithinPartitions(key, "_block", "_rank")
    out = dealt.mapInArrow(mark, schema + ", _start long")
    if entries is None:
        return out.drop("_block")
    out = written(out, "marked")
    ends = out.where(F.col("_total") > block).groupBy(F.col(key).alias("_ck"), F.col("_block").alias("_cb")).agg(F.max("_start").alias("_end"))
    before = Window.partitionBy("_ck").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_ck", "_cb", F.max("_end").over(before).alias("_carry"))
    return joined(out, carry, {key: "_ck", "_block": "_cb"}).withColumn("_start", F.coalesce("_start", "_carry")).drop("_ck", "_cb", "_carry", "_block")
