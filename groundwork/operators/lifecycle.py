"""The way of a table of queries to their answers, put together from parts that can each be swapped."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import citations as C
from groundwork.functions import rules

from . import grounding
from .scans import written

# What a query is told that gets no answer from the evidence.
MESSAGES = {
    "empty": "Please enter a question.",
    "refused": "This asks for a binding ruling, which is out of scope.",
    "unanswered": "The sources at hand do not address this question.",
    "ungrounded": "There is not enough evidence in the sources for an answer.",
}

CONTRACT = ("query_id", "session_id", "route", "status", "answer", "question", "n_citations", "confidence", "prompt")


@dataclass(frozen=True)
class Lifecycle:
    """Parts, each from the queries still open (query_id, session_id, query) to rows of its own. Keys are query_id unless named.

    ``retrieve`` gives (query_id, rank, chunk_id, standard, section, text, score); ``generate`` gives (query_id, answer) for rows with a prompt, and may leave
    queries out; ``clarify`` gives (query_id, question), one row at most, for queries that need one first; ``history`` gives (session_id, text), one row at most;
    ``validate`` gives the backed citations of (answer_id, answer) against the chunks, a row each; ``build`` makes the prompt of context, history and query.
    """

    retrieve: Callable[[DataFrame], DataFrame]
    generate: Callable[[DataFrame], DataFrame]
    clarify: Callable[[DataFrame], DataFrame] | None = None
    history: Callable[[DataFrame], DataFrame] | None = None
    validate: Callable[[DataFrame, DataFrame], DataFrame] = lambda answers, chunks: grounding.evidence(grounding.cited(answers), chunks)
    refuses: Callable[[Column], Column] = rules.refused
    defines: Callable[[Column], Column] = rules.is_definition
    build: Callable[[Column, Column, Column], Column] = lambda context, history, query: F.concat_ws("\n\n", context, history, query)
    messages: Mapping[str, str] = field(default_factory=lambda: MESSAGES)

    def run(self, queries: DataFrame) -> DataFrame:
        """``CONTRACT`` of every query (query_id, session_id, query); query_id is unique and not null.

        Routes, the first that fits: empty (null or blank), refused, clarify, unanswered (no chunk, or no answer came), definition (answered from the best chunk), answer.
        ``n_citations`` counts backed citations and decides the status; ``prompt`` is null where none was needed. Joins are on the keys alone, so each part may be of any size.
        What ``retrieve`` and ``generate`` give is kept in the shared folder, so that an index or a model is asked once, and again only for lost tasks.
        """
        named = queries.select("query_id", "session_id", F.trim(F.col("query")).alias("query"))
        said = F.coalesce(F.col("query"), F.lit(""))
        start = F.when(said == "", "empty").when(self.refuses(said), "refused")
        routed = written(named.withColumn("_start", start), "queries")
        open_ = routed.where("_start IS NULL").drop("_start")
        asked = self.clarify(open_).select("query_id", "question") if self.clarify else None
        if asked is not None:
            open_ = open_.join(asked.where("question IS NOT NULL"), "query_id", "left_anti")
        chunks = written(self.retrieve(open_), "chunks")
        best = F.min_by(F.struct("text", "standard", "section"), "rank").alias("_best")
        found = chunks.groupBy("query_id").agg(best, F.round(F.avg("score"), 6).alias("confidence"))
        context = grounding.prompt_context(chunks.withColumnRenamed("query_id", "answer_id")).withColumnRenamed("answer_id", "query_id")
        ready = open_.join(found, "query_id").withColumn("_defines", self.defines(F.col("query")))
        prompts = ready.where(~F.col("_defines")).join(context, "query_id")
        past = self.history(prompts).select("session_id", F.col("text").alias("_past")) if self.history else None
        prompts = prompts.join(past, "session_id", "left") if past is not None else prompts.withColumn("_past", F.lit(None).cast("string"))
        prompts = prompts.select("query_id", "session_id", "query", self.build(F.col("context"), F.col("_past"), F.col("query")).alias("prompt"))
        prompts = written(prompts, "prompts")
        answers = written(self.generate(prompts).select("query_id", F.col("answer").alias("_answer")), "answers")
        backed = self.validate(answers.select(F.col("query_id").alias("answer_id"), F.col("_answer").alias("answer")), chunks.withColumnRenamed("query_id", "answer_id"))
        counts = backed.groupBy(F.col("answer_id").alias("query_id")).agg(F.count("*").alias("n_citations"))

        rows = routed.join(ready.select("query_id", "_best", "confidence", "_defines"), "query_id", "left")
        rows = rows.join(prompts.select("query_id", "prompt"), "query_id", "left").join(answers, "query_id", "left").join(counts, "query_id", "left")
        rows = rows.join(asked.withColumnRenamed("question", "_asked"), "query_id", "left") if asked is not None else rows.withColumn("_asked", F.lit(None).cast("string"))
        rows = rows.withColumns({"n_citations": F.coalesce("n_citations", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.0)), "_defines": F.coalesce("_defines", F.lit(False))})
        route = F.coalesce("_start", F.when(F.col("_asked").isNotNull(), "clarify").when(F.col("_defines"), "definition").when(F.col("_answer").isNull(), "unanswered").otherwise("answer"))
        rows = rows.withColumn("route", route)
        rows = rows.withColumn("_follow", F.when(F.col("route") == "answer", C.followup_question(F.col("_answer"), F.col("n_citations"))))
        question = F.coalesce("_asked", "_follow")
        status = F.when(question.isNotNull(), "CLARIFICATION_NEEDED").when(F.col("route") == "answer", C.derive_status(F.col("_answer"), F.col("n_citations"))).otherwise("INSUFFICIENT_DATA")
        rows = rows.withColumns({"question": question, "status": status})
        told = F.lit(None).cast("string")
        for name in ("empty", "refused", "unanswered"):
            told = F.when(F.col("route") == name, self.messages[name]).otherwise(told)
        ungrounded = (F.col("status") == "INSUFFICIENT_DATA") & (F.col("n_citations") == 0) & (F.col("route") == "answer")
        cited = C.definition_answer(F.col("_best.text"), C.citation_marker(F.col("_best.standard"), F.col("_best.section")))
        answer = F.coalesce("question", told, F.when(F.col("route") == "definition", cited), F.when(ungrounded, self.messages["ungrounded"]), F.col("_answer"))
        return rows.withColumn("answer", answer).select(*CONTRACT)
