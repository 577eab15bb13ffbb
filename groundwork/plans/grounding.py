"""Queries that hold answers against evidence. Answers are assistant turns with a citation put after them; chunks are the turns of the same conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import citations as C
from groundwork.operators import grounding as G
from groundwork.operators import tables
from groundwork.sources import corpus
from groundwork.sources.shared import fresh_folder

from .registry import query, table


def text(*parts):
    return F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))


def answers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    i, t = F.col("conv_id"), F.col("turn")
    word = F.when(t % 4 == 1, "COMPLIANT: ").when(t % 4 == 3, "Non-compliant: ").otherwise("Missing. Question: which asset\n")
    mark = F.when(i % 5 == 0, "").otherwise(text(" [FAS-", i % 40, " §", t - 1, "] and [see FAS", i % 7, "]"))
    return c.select((i * 1000 + t).alias("answer_id"), "conv_id", F.concat(word, F.col("text"), mark).alias("answer"))


_ANSWERS = """SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, CASE turn % 4 WHEN 1 THEN 'COMPLIANT: ' WHEN 3 THEN 'Non-compliant: ' ELSE 'Missing. Question: which asset' || chr(10) END || text
|| CASE WHEN conv_id % 5 = 0 THEN '' ELSE ' [FAS-' || conv_id % 40 || ' §' || turn - 1 || '] and [see FAS' || conv_id % 7 || ']' END AS answer FROM conversations WHERE role = 'assistant'"""
_PAD = "'FAS-' || CASE WHEN length(({0})::VARCHAR) < 2 THEN lpad(({0})::VARCHAR, 2, '0') ELSE ({0})::VARCHAR END"
_CITED = f"""SELECT answer_id, 0 AS position, {_PAD.format('conv_id % 40')} AS standard, (turn - 1)::VARCHAR AS section FROM ({_ANSWERS}) WHERE conv_id % 5 <> 0 UNION ALL
SELECT answer_id, 1, {_PAD.format('conv_id % 7')}, NULL FROM ({_ANSWERS}) WHERE conv_id % 5 <> 0"""


def chunks(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "own")
    a = answers(spark, sf).select("answer_id", "conv_id")
    i, t = F.col("own"), F.col("turn")
    name = F.when(t % 3 == 0, text("FAS-", i % 40)).when(t % 3 == 1, text("Standard_", i % 7, "_x")).otherwise(text("other", i))
    ref = C.chunk_ref(F.when(t % 2 == 0, name), F.when(t % 2 == 1, name), F.lit(""))
    section = F.when(t % 4 != 1, text("Section ", t))
    return a.join(c, F.col("conv_id") == F.col("own")).select(
        "answer_id", (i * 1000 + t).alias("chunk_id"), (t + 1).alias("rank"), ref.alias("standard"), section.alias("section"), "text", F.round(1 / (t + 1.5), 6).alias("score")
    )


_CHUNKS = f"""SELECT answer_id, own * 1000 + turn AS chunk_id, turn + 1 AS rank, CASE turn % 3 WHEN 0 THEN {_PAD.format('own % 40')} WHEN 1 THEN {_PAD.format('own % 7')} ELSE 'other' || own END AS standard,
CASE WHEN turn % 4 <> 1 THEN 'Section ' || turn END AS section, CASE WHEN turn % 4 <> 1 THEN turn::VARCHAR END AS norm, text, round(1 / (turn + 1.5), 6)::DOUBLE AS score
FROM (SELECT answer_id, conv_id FROM ({_ANSWERS})) a JOIN (SELECT conv_id AS own, turn, text FROM conversations) c ON own = conv_id"""
_MET = "c.answer_id = k.answer_id AND c.standard = k.standard AND (c.section IS NULL OR norm IS NULL OR c.section = norm)"
_EVIDENCE = f"""SELECT k.answer_id, k.standard, k.section, arg_min(chunk_id, (position, rank)) AS chunk_id FROM ({_CITED}) c JOIN ({_CHUNKS}) k ON {_MET} GROUP BY 1, 2, 3"""


def evidence(spark, sf):
    return G.evidence(G.cited(answers(spark, sf)), chunks(spark, sf))


@query(_CITED)
def parse_citations(spark, sf):
    return G.cited(answers(spark, sf))


@query(f"SELECT answer_id, chunk_id, standard FROM ({_CHUNKS})")
def chunk_ref(spark, sf):
    return chunks(spark, sf).select("answer_id", "chunk_id", "standard")


@query(f"SELECT conv_id, turn, {_PAD.format('conv_id')} AS standard FROM conversations")
def normalize_standard(spark, sf):
    name = F.when(F.col("turn") % 2 == 0, text("Standard_", F.col("conv_id"), "_en")).otherwise(text("x FAS", F.col("conv_id")))
    return table(spark, sf, "conversations").select("conv_id", "turn", C.normalize_standard(name).alias("standard"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN turn || '.a' END AS section FROM conversations")
def normalize_section(spark, sf):
    t = F.col("turn")
    raw = F.when(t % 5 == 0, text(" Section ", t, ".A.; ")).when(t % 5 == 1, text("§", t, ".A")).when(t % 5 == 2, text("القسم ", t, ".A،")).when(t % 5 == 3, text(t, ".a:")).otherwise("  ")
    return table(spark, sf, "conversations").select("conv_id", "turn", C.normalize_section(raw).alias("section"))


@query(_EVIDENCE)
def citation_evidence(spark, sf):
    return evidence(spark, sf).drop("quote")


@query(f"SELECT answer_id, position, standard, section FROM ({_CITED}) c WHERE NOT EXISTS (SELECT 1 FROM ({_CHUNKS}) k WHERE {_MET})")
def unsupported_citations(spark, sf):
    return G.unsupported(G.cited(answers(spark, sf)), chunks(spark, sf))


@query(f"SELECT DISTINCT answer_id, standard, section FROM ({_CHUNKS}) WHERE section IS NOT NULL")
def supported_refs(spark, sf):
    return G.supported_refs(chunks(spark, sf))


@query(f"SELECT DISTINCT k.answer_id, first_value(chunk_id) OVER (PARTITION BY k.answer_id, standard, section ORDER BY rank) AS chunk_id, standard, section FROM ({_CHUNKS}) k")
def first_seen_dedupe(spark, sf):
    k = chunks(spark, sf).groupBy("answer_id", "standard", "section").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    return k.select("answer_id", "chunk_id", "standard", "section")


@query(f"SELECT a.answer_id, 'm' AS marker, coalesce(min(position) FILTER (c.standard = {_PAD.format('a.conv_id % 7')}), -1)::INT AS position FROM ({_ANSWERS}) a LEFT JOIN ({_CITED}) c USING (answer_id) GROUP BY a.answer_id")
def resolve_citation_marker(spark, sf):
    a = answers(spark, sf)
    markers = a.select("answer_id", F.lit("m").alias("marker"), C.padded_number((F.col("conv_id") % 7).cast("string")).alias("standard"), F.lit(None).cast("string").alias("section"))
    return G.marker_positions(G.cited(a), markers)


_COUNTED = f"SELECT a.*, coalesce(n, 0) AS n_citations FROM ({_ANSWERS}) a LEFT JOIN (SELECT answer_id, count(*) AS n FROM ({_EVIDENCE}) GROUP BY 1) USING (answer_id)"


@query(f"""SELECT answer_id, n_citations, CASE WHEN contains(upper(answer), 'INSUFFICIENT') OR n_citations = 0 THEN 'INSUFFICIENT_DATA' WHEN contains(upper(answer), 'NON-COMPLIANT') THEN 'NON_COMPLIANT'
WHEN contains(upper(answer), 'COMPLIANT') THEN 'COMPLIANT' ELSE 'INSUFFICIENT_DATA' END AS status FROM ({_COUNTED})""")
def derive_status(spark, sf):
    return G.with_status(answers(spark, sf), evidence(spark, sf)).select("answer_id", "n_citations", "status")


@query(f"SELECT answer_id, substr(string_split(trim(answer), chr(10))[1], 1, 300) AS summary FROM ({_ANSWERS})")
def reasoning_summary(spark, sf):
    return answers(spark, sf).select("answer_id", C.reasoning_summary(F.col("answer")).alias("summary"))


@query(f"SELECT answer_id, CASE WHEN n_citations = 0 AND contains(lower(answer), 'missing') THEN 'What is the single most important detail that is missing?' END AS question FROM ({_COUNTED})")
def followup_question(spark, sf):
    a = G.with_status(answers(spark, sf), evidence(spark, sf))
    return a.select("answer_id", C.followup_question(F.col("answer"), F.col("n_citations")).alias("question"))


_QUOTE = r"""SELECT answer_id, chunk_id, quote, greatest(instr(clean, quote) - 1, 0)::INT AS start, (greatest(instr(clean, quote) - 1, 0) + length(quote))::INT AS stop
FROM (SELECT *, substr(coalesce(list_filter(parts, lambda s: length(s) >= 40)[1], parts[1], ''), 1, 500) AS quote
FROM (SELECT *, string_split(regexp_replace(clean, '([.!?؟۔])[\t\n\v\f\r ]+', '\1' || chr(1), 'g'), chr(1)) AS parts
FROM (SELECT answer_id, chunk_id, regexp_replace(text, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g') AS clean FROM ({}) JOIN ({}) USING (answer_id, chunk_id))))"""


@query(_QUOTE.format(f"SELECT answer_id, chunk_id FROM ({_EVIDENCE})", f"SELECT answer_id, chunk_id, text FROM ({_CHUNKS})"))
def evidence_quote(spark, sf):
    return evidence(spark, sf).select("answer_id", "chunk_id", "quote.quote", "quote.start", "quote.stop")


@query(
    rf"""SELECT 'document' AS kind, doc_id AS row_id, concat_ws(',', CASE WHEN text IS NULL OR trim(text) = '' THEN 'content' END, CASE WHEN length(text) // 4 NOT BETWEEN 50 AND 512 THEN 'tokens' END,
CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END) AS violations FROM documents
UNION ALL SELECT 'embedding', vec_id, CASE WHEN len(embedding) <> 64 THEN 'dims' ELSE '' END FROM embeddings
UNION ALL SELECT 'answer', answer_id, concat_ws(',', CASE WHEN contains(upper(answer), 'COMPLIANT') AND n_citations = 0 THEN 'grounding' END,
CASE WHEN length(regexp_replace(answer, '[^?؟]', '', 'g')) <> 1 OR contains(answer, chr(10)) OR regexp_matches(answer, '^\s*([-*•]|\d+[.)])\s') THEN 'question' END) FROM ({_COUNTED})"""
)
def contract_violations(spark, sf):
    tokens = F.floor(F.length("text") / 4)
    listed = lambda **checks: F.array_join(tables.violations(checks), ",").alias("violations")
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    out = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("row_id"), listed(content=F.trim("text") != "", tokens=tokens.between(50, 512), language=F.col("lang").isin("en", "de")))
    out = out.unionByName(vectors.select(F.lit("embedding").alias("kind"), F.col("vec_id").alias("row_id"), listed(dims=tables.has_dims(F.col("embedding"), 64))))
    said = G.with_status(answers(spark, sf), evidence(spark, sf))
    ok = tables.grounded(F.upper("answer").contains("COMPLIANT"), F.col("n_citations"))
    return out.unionByName(said.select(F.lit("answer").alias("kind"), F.col("answer_id").alias("row_id"), listed(grounding=ok, question=tables.one_question(F.col("answer")))))


@query(r"""SELECT conv_id, turn, 'INSUFFICIENT_DATA: This is a definition question. Based on the retrieved excerpt: ' || CASE WHEN length(s) > 420 THEN rtrim(substr(s, 1, 417)) || '...' ELSE s END || ' [FAS-01 §' || turn || ']' AS answer
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g')) AS s FROM conversations)""")
def definition_answer(spark, sf):
    mark = C.citation_marker(F.lit("FAS-01"), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").select("conv_id", "turn", C.definition_answer(F.col("text"), mark).alias("answer"))


def prompt_context_sql(chunks: str) -> str:
    return f"""SELECT answer_id, string_agg('[' || rank || '] ' || standard || CASE WHEN section IS NOT NULL THEN ' §' || section ELSE '' END || ' (score: ' || format('{{:.2f}}', score) || ')' || chr(10) || text,
chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM ({chunks}) GROUP BY answer_id"""


@query(prompt_context_sql(_CHUNKS))
def prompt_context(spark, sf):
    return G.prompt_context(chunks(spark, sf))


def requests(spark, sf):
    a = G.with_status(answers(spark, sf), evidence(spark, sf))
    c = G.cited(answers(spark, sf)).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.col("standard"))).alias("citations"))
    bad = F.when(F.col("answer_id") % 7 == 0, F.lit("timeout"))
    return a.join(c, "answer_id", "left").select(
        F.col("answer_id").alias("request_id"), F.col("conv_id").alias("session_id"), F.lit("q").alias("query"), "status", "answer", F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
        F.create_map(F.lit("n"), F.col("n_citations").cast("string")).alias("metadata"), F.lit(0.5).alias("confidence"), bad.alias("error"),
    )


_STATUS = """CASE WHEN contains(upper(answer), 'INSUFFICIENT') OR n_citations = 0 THEN 'INSUFFICIENT_DATA' WHEN contains(upper(answer), 'NON-COMPLIANT') THEN 'NON_COMPLIANT'
WHEN contains(upper(answer), 'COMPLIANT') THEN 'COMPLIANT' ELSE 'INSUFFICIENT_DATA' END"""


@query(f"""SELECT a.answer_id AS request_id, conv_id AS session_id, 'q' AS query, {_STATUS} AS status, answer, coalesce(s, '[]') AS citations, '{{"n":"' || n_citations || '"}}' AS metadata, 36 AS id_length, true AS timed FROM ({_COUNTED}) a
LEFT JOIN (SELECT answer_id, '[' || string_agg('"' || standard || '"', ',' ORDER BY standard) || ']' AS s FROM ({_CITED}) GROUP BY 1) USING (answer_id)""")
def audit_append(spark, sf):
    """Appended to a table in two batches and read back."""
    out, rows = fresh_folder(spark, "audit"), requests(spark, sf)
    for failed in (False, True):
        corpus.append(corpus.audit_rows(rows.where(F.col("error").isNotNull() == F.lit(failed))), out)
    back = spark.read.schema(corpus.audit_rows(rows).schema).parquet(out)
    return back.withColumns({"id_length": F.length("audit_id"), "timed": F.col("created_at").isNotNull()}).drop("audit_id", "created_at")


@query(f"""SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY k, standard) - 1)::INT AS seq, event FROM (
SELECT answer_id AS request_id, 0 AS k, '' AS standard, 'started' AS event FROM ({_ANSWERS}) UNION ALL SELECT answer_id, 9, '', 'error' FROM ({_ANSWERS}) WHERE answer_id % 7 = 0
UNION ALL SELECT answer_id, 1, '', 'retrieval' FROM ({_ANSWERS}) WHERE answer_id % 7 <> 0 UNION ALL SELECT answer_id, 2, '', 'token' FROM ({_ANSWERS}) WHERE answer_id % 7 <> 0
UNION ALL SELECT answer_id, 3, standard, 'citation' FROM ({_CITED}) WHERE answer_id % 7 <> 0 UNION ALL SELECT answer_id, 4, '', 'done' FROM ({_ANSWERS}) WHERE answer_id % 7 <> 0)""")
def expand_answer_events(spark, sf):
    return corpus.expand_answer_events(requests(spark, sf)).select("request_id", "seq", "event")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS seq, role AS event, '{\"turn\": ' || turn || '}' AS data, true AS valid FROM conversations")
def parse_event_log(spark, sf):
    block = F.concat(F.lit("event: "), F.col("role"), F.lit('\ndata: {"turn": '), F.col("turn").cast("string"), F.lit("}\n\n"))
    logs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("x"))
    logs = logs.select("conv_id", F.array_join(F.transform("x", lambda x: x["b"]), "").alias("log"))
    return logs.select("conv_id", F.explode(corpus.parse_event_log(F.col("log"))).alias("e")).select("conv_id", "e.seq", "e.event", "e.data", "e.valid")
