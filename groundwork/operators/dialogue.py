"""Clarification dialogues: one state per session, moved on by each user turn, in batch and in a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import rules


@dataclass
class Dialogue:
    """Where a session stands. ``state`` is INITIAL, CLARIFYING or READY (ANALYZING is passed inside a step)."""

    state: str = "INITIAL"
    kind: str | None = None
    known: dict[str, str] = field(default_factory=dict)
    awaiting: str | None = None
    asked: int = 0

    def step(self, kind: str | None, facts: Mapping[str, str], text: str, required: Mapping[str, Sequence[str]], most_questions: int) -> tuple[str, str | None, list[str]]:
        """Moves on by a turn: (status, the one variable asked for next, what is missing)."""
        self.kind = kind or self.kind
        if self.kind is None:
            self.state, self.awaiting, self.asked = "CLARIFYING", "operation_type", self.asked + 1
            return "clarifying", "operation_type", ["operation_type"]
        answered = facts.get(f"answer:{self.awaiting}") or (text.strip() if self.awaiting in required.get(self.kind, ()) and f"answer:{self.awaiting}" not in facts else None)
        new = {k: v for k, v in facts.items() if v is not None and not k.startswith("answer:")}
        if self.awaiting and self.awaiting != "operation_type" and answered:
            new[self.awaiting] = answered
        self.known |= new | {"operation_type": self.kind}
        missing = [v for v in required.get(self.kind, ()) if v not in self.known]
        if not missing or self.asked >= most_questions:
            self.state, self.awaiting = "READY", None
            return "ready", None, missing
        self.state, self.awaiting, self.asked = "CLARIFYING", missing[0], self.asked + 1
        return "clarifying", missing[0], missing


STEPS = "status string, state string, asks string, missing string, known string"


def _named(kind: str):
    return lambda e: F.struct(F.concat(F.lit(f"{kind}|"), e["key"]).alias("key"), e["value"].alias("value"))


def with_facts(turns: DataFrame, operations=rules.OPERATIONS) -> DataFrame:
    """Adds ``kind`` and ``facts`` (JSON) to turns, in the JVM. Answers to an open question that need a number come as ``answer:<variable>``."""
    clean = F.trim("text")
    kind = rules.operation_type(F.col("text"), operations)
    stated = turns.withColumn("kind", kind)
    number = F.create_map(
        *(x for name in ("non_compliant_revenue_percent", "interest_rate") for x in (F.lit(f"answer:{name}"), rules.percent(clean).cast("string"))),
        *(x for name in ("principal_amount", "price") for x in (F.lit(f"answer:{name}"), rules.amount(clean).cast("string"))),
        *(x for name in ("term_months", "duration") for x in (F.lit(f"answer:{name}"), F.coalesce(rules.months(clean).cast("string"), clean))),
    )
    # facts are for the kind a turn names; a turn without one is read for every kind and filtered by the session's
    every = F.map_from_entries(F.flatten(F.array(*(F.transform(F.map_entries(rules.facts(F.col("text"), F.lit(k))), _named(k)) for k in rules.REQUIRED))))
    return stated.select("session_id", "turn", "text", "kind", F.coalesce(F.to_json(F.map_concat(number, every)), F.lit("{}")).alias("facts"))


def stepped(state: Dialogue, kind: str | None, facts: str, text: str | None, required: Mapping[str, Sequence[str]], most_questions: int) -> tuple:
    """The columns of ``STEPS`` after a turn, which moves ``state`` on. A null text says nothing."""
    stated = json.loads(facts)
    kind = kind if isinstance(kind, str) else None
    own = f"{kind or state.kind}|"
    known = {k.removeprefix(own): v for k, v in stated.items() if k.startswith(own)} | {k: v for k, v in stated.items() if k.startswith("answer:")}
    named = {f"answer:{v}": None for v in ("non_compliant_revenue_percent", "interest_rate", "principal_amount", "price")}
    status, asks, missing = state.step(kind, named | known, text if isinstance(text, str) else "", required, most_questions)
    return status, state.state, asks, json.dumps(missing), json.dumps(state.known, sort_keys=True, ensure_ascii=False)


def clarify(turns: DataFrame, *, operations=rules.OPERATIONS, required=rules.REQUIRED, most_questions: int = 2) -> DataFrame:
    """One row per user turn (session_id, turn, text): status, state, the one variable asked for, what is missing, what is known.

    Turns are shuffled by session and read in order as a stream with one open state, so a session of any length needs constant memory. Turns without a session form one session; null turns come first.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_facts(turns, operations).repartition(n, "session_id").sortWithinPartitions("session_id", "turn")
    keys = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("session_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), Dialogue()
        for batch in batches:
            out = []
            for session, text, kind, facts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("session_id", "text", "kind", "facts"))):
                if session != last:
                    last, state = session, Dialogue()
                out.append(stepped(state, kind, facts, text, required, most_questions))
            made = [pa.array([r[i] for r in out], pa.string()) for i in range(len(STEPS.split(", ")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["session_id", "turn", *(c.split()[0] for c in STEPS.split(", "))])

    return rows.mapInArrow(run, f"{keys}, {STEPS}")
