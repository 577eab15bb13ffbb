"""The whole way from the turns of conversations to contract rows: turns before an answer are the queries, the conversation's turns the chunks, recorded answers the model's."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import rules as R
from groundwork.operators import history
from groundwork.operators.lifecycle import MESSAGES, Lifecycle

from . import grounding, rules
from .registry import query, table

REFUSED, STARTS, BLOCKS = ("ueno", "heit"), ("the ", "de ", "le ", "die "), ("tion",)
ASKED = "Which kind of transaction is it?"

_ROUTED = f"""WITH q AS (SELECT a.answer_id AS query_id, a.conv_id AS session_id, trim(p.text, ' ') AS query, a.answer, a.turn FROM ({grounding._ANSWERS}) a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1),
k AS (SELECT * FROM ({grounding._CHUNKS}) WHERE answer_id % 11 <> 0), p AS (SELECT * FROM ({grounding.prompt_context_sql('SELECT * FROM k')})),
n AS (SELECT answer_id, count(*) AS n FROM (SELECT DISTINCT k.answer_id, k.standard, k.section FROM ({grounding._CITED}) c JOIN k ON {grounding._MET}) GROUP BY 1),
b AS (SELECT answer_id, arg_min(text, rank) AS text, arg_min(standard, rank) AS standard, min(rank) AS rank, round(avg(score), 6) AS confidence FROM k GROUP BY 1),
r AS (SELECT *, CASE WHEN coalesce(query, '') = '' THEN 'empty' WHEN {rules.any_of('lower(query)', REFUSED)} THEN 'refused' WHEN ({rules._KIND.replace('text', 'query')}) IS NULL THEN 'clarify' WHEN query_id % 11 = 0 THEN 'unanswered'
WHEN {rules.starting('lower(query)', STARTS)} AND NOT {rules.any_of('lower(query)', BLOCKS)} THEN 'definition' WHEN query_id % 13 = 0 THEN 'unanswered' ELSE 'answer' END AS route FROM q)"""


@query(f"""{_ROUTED}, j AS (SELECT r.*, CASE WHEN route = 'answer' THEN coalesce(n, 0) ELSE 0 END AS n_citations, CASE WHEN route IN ('empty', 'refused', 'clarify') THEN 0 ELSE coalesce(b.confidence, 0) END AS confidence,
b.text AS best, b.standard AS best_standard, (SELECT section FROM k WHERE k.answer_id = query_id AND k.rank = b.rank) AS best_section, p.context, h.text AS past
FROM r LEFT JOIN n ON n.answer_id = query_id LEFT JOIN b ON b.answer_id = query_id LEFT JOIN p ON p.answer_id = query_id LEFT JOIN ({rules._HISTORY}) h ON h.conv_id = session_id),
f AS (SELECT *, CASE WHEN route = 'clarify' THEN '{ASKED}' WHEN route = 'answer' AND n_citations = 0 AND contains(lower(answer), 'missing') THEN 'What is the single most important detail that is missing?' END AS question FROM j),
s AS (SELECT *, CASE WHEN question IS NOT NULL THEN 'CLARIFICATION_NEEDED' WHEN route = 'answer' THEN {grounding._STATUS} ELSE 'INSUFFICIENT_DATA' END AS status,
trim(regexp_replace(best, '[\\t\\n\\f\\r ]+', ' ', 'g')) AS squeezed FROM f)
SELECT query_id, session_id, route, status, CASE WHEN question IS NOT NULL THEN question WHEN route = 'empty' THEN '{MESSAGES['empty']}' WHEN route = 'refused' THEN '{MESSAGES['refused']}' WHEN route = 'unanswered' THEN '{MESSAGES['unanswered']}'
WHEN route = 'definition' THEN 'INSUFFICIENT_DATA: This is a definition question. Based on the retrieved excerpt: ' || CASE WHEN length(squeezed) > 420 THEN rtrim(substr(squeezed, 1, 417)) || '...' ELSE squeezed END
|| ' [' || best_standard || CASE WHEN best_section IS NOT NULL THEN ' §' || best_section ELSE '' END || ']' WHEN status = 'INSUFFICIENT_DATA' AND n_citations = 0 THEN '{MESSAGES['ungrounded']}' ELSE answer END AS answer,
question, n_citations, confidence::DOUBLE AS confidence, CASE WHEN route = 'answer' OR (route = 'unanswered' AND query_id % 11 <> 0) THEN concat_ws(chr(10) || chr(10), context, past, query) END AS prompt FROM s""")
def query_lifecycle(spark, sf):
    """Every 11th query finds no chunk, and of every 13th no answer is on record."""
    turns, answers = table(spark, sf, "conversations"), grounding.answers(spark, sf)
    before = turns.select("conv_id", (F.col("turn") + 1).alias("_turn"), F.col("text").alias("query"))
    asked = answers.withColumn("_turn", F.col("answer_id") - F.col("conv_id") * 1000).join(before, ["conv_id", "_turn"], "left")
    queries = asked.select(F.col("answer_id").alias("query_id"), F.col("conv_id").alias("session_id"), "query")
    chunks = grounding.chunks(spark, sf).withColumnRenamed("answer_id", "query_id").where("query_id % 11 <> 0")
    recorded = answers.select(F.col("answer_id").alias("query_id"), "answer").where("query_id % 13 <> 0")
    kind = R.operation_type(F.col("query"), rules.WORDS)
    parts = Lifecycle(
        retrieve=lambda open_: chunks.join(open_.select("query_id"), "query_id", "left_semi"),
        generate=lambda prompts: prompts.join(recorded, "query_id"),
        clarify=lambda open_: open_.where(kind.isNull()).select("query_id", F.lit(ASKED).alias("question")),
        history=lambda prompts: history.history_text(turns, "conv_id", "turn").withColumnRenamed("conv_id", "session_id"),
        refuses=lambda text: R.refused(text, REFUSED),
        defines=lambda text: R.is_definition(text, STARTS, BLOCKS),
    )
    return parts.run(queries)
