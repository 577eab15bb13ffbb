"""Streams with state per key that ends: windows close with the watermark, dialogues after an idle time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegralType

from groundwork.functions import rules
from groundwork.operators.dialogue import STEPS, Dialogue, stepped, with_facts
from groundwork.operators.traffic import seconds

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "10 minutes"
#: Column names have no leading underscore here: Spark renames those on the way to a stateful processor.
LEAST = -(2**63)


def _sortable(rows: DataFrame, column: str) -> Column:
    """A column without nulls that sorts as ``column`` does, exactly, in pandas."""
    whole = isinstance(rows.schema[column].dataType, IntegralType)
    return F.coalesce(F.col(column).cast("long"), F.lit(LEAST)) if whole else F.coalesce(F.col(column).cast("string"), F.lit(""))


class OpenWindow(StatefulProcessor):
    """The open window (start, turn) of a key, in units of which ``per_second`` make a second. A timer ends it when the watermark reaches its end: later events open another anyway."""

    def __init__(self, width: int, per_second: int):
        self.width, self.per_second = width, per_second

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, turn long")

    def _end(self, start: int) -> int:
        return -(-(start + self.width) * 1000 // self.per_second)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, turn = self.open.get() if self.open.exists() else (None, 0)
        frames = list(rows)  # of a key's rows in this micro-batch, time, order and tie
        at, order = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("at", "place"))
        tie = np.concatenate([f["tie_text"].to_numpy(dtype=object) for f in frames])
        by = np.lexsort((order, at))
        at, tie = at[by], tie[by]
        starts, turns, i = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64), 0
        before = start
        while i < len(at):  # a turn of the loop for each window, not for each row
            if start is None or at[i] - start >= self.width:
                start, turn = int(at[i]), 0
            stop = max(i + 1, int(np.searchsorted(at, start + self.width)))
            starts[i:stop], turns[i:stop] = start, turn + 1 + np.arange(stop - i)
            turn, i = turn + stop - i, stop
        self.open.update((start, turn))
        if start != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(start))
        yield pd.DataFrame({"key_text": [key[0]] * len(at), "tie_text": tie, "window_start": starts, "turn": turns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and self._end(self.open.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def _windows(events: DataFrame, key: str, tie: str, at: Column, width: int, per_second: int, delay: str) -> DataFrame:
    """(key, tie, window_start, turn) per event that is not late. Events without a time can't be told from late ones and are dropped by the watermark."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    rows = rows.select("ts", F.col(key).cast("string").alias("key_text"), F.col(tie).cast("string").alias("tie_text"), _sortable(events, tie).alias("place"), at.alias("at"))
    out = rows.groupBy("key_text").transformWithStateInPandas(OpenWindow(width, per_second), "key_text string, tie_text string, window_start long, turn long", "append", "eventTime")
    return out.select(F.col("key_text").cast(events.schema[key].dataType).alias(key), F.col("tie_text").cast(events.schema[tie].dataType).alias(tie), "window_start", "turn")


def quota_anchored(events: DataFrame, key: str, tie: str, limit: int, width: int, delay: str = DELAY) -> DataFrame:
    """Allowed, remaining and reset_at per event, in whole seconds, as the batch twin. Within a micro-batch events are taken in order of time; micro-batches must come in that order too."""
    rows = _windows(events, key, tie, seconds(F.col("ts")), width, 1, delay)
    return rows.select(key, tie, (F.col("turn") <= limit).alias("allowed"), F.greatest(limit - F.col("turn"), F.lit(0)).alias("remaining"), (F.col("window_start") + width).alias("reset_at"))


def cache_hits(events: DataFrame, key: str, tie: str, ttl: int, delay: str = DELAY) -> DataFrame:
    """Hit or miss per read; a miss fills the cache for ``ttl`` seconds, a hit doesn't extend it. An entry is dropped once the watermark has passed its end."""
    rows = _windows(events, key, tie, F.unix_micros(F.col("ts").cast("timestamp")), ttl * 1000000, 1000000, delay)
    return rows.select(key, tie, (F.col("turn") > 1).alias("hit"), F.round(F.col("window_start") / 1000000 + ttl, 6).alias("expires_at"))


class OpenDialogue(StatefulProcessor):
    """A session's dialogue as JSON, dropped when the session has been idle for ``idle`` milliseconds."""

    def __init__(self, required, most_questions: int, idle: int):
        self.required, self.most_questions, self.idle = required, most_questions, idle

    def init(self, handle) -> None:
        self.state = handle.getValueState("dialogue", "json string", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = Dialogue(**json.loads(self.state.get()[0])) if self.state.exists() else Dialogue()
        turns = pd.concat(list(rows)).sort_values("place", kind="stable")
        out = [(key[0], t.turn, *stepped(state, t.kind, t.facts, t.text, self.required, self.most_questions)) for t in turns.itertuples(index=False)]
        self.state.update((json.dumps(asdict(state)),))
        yield pd.DataFrame(out, columns=["session_id", "turn", *(c.split()[0] for c in STEPS.split(", "))])

    def close(self) -> None:
        pass


def clarify_stream(turns: DataFrame, *, operations=rules.OPERATIONS, required=rules.REQUIRED, most_questions: int = 2, idle: int = 86_400_000) -> DataFrame:
    """``dialogue.clarify`` over a stream of turns that arrive in order within a session; Spark keeps the state and drops it after ``idle`` milliseconds without a turn.

    State that ends by the clock makes Spark run batches without data for ever: a run over what is there (trigger availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = with_facts(turns, operations).select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("turn"), _sortable(turns, "turn").alias("place"), "text", "kind", "facts")
    out = rows.groupBy("session_id").transformWithStateInPandas(OpenDialogue(required, most_questions, idle), f"session_id string, turn string, {STEPS}", "append", "processingTime")
    return out.withColumns({c: F.col(c).cast(turns.schema[c].dataType) for c in ("session_id", "turn")})
