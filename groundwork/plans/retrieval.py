"""Queries over embeddings, benchmark passages and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import embedding, evaluation, retrieval

from .registry import query, table

K, EVERY = 5, 50


def vectors(spark, sf):
    """Queries (every vec_id divisible by EVERY) and the corpus of all vectors."""
    e = table(spark, sf, "embeddings")
    queries = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("q_label"))
    return queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_SIMS = f"""SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS q_label, c.label,
round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, id)"


def top(k: int) -> str:
    return f"SELECT * FROM (SELECT *, {_RANK.format('similarity')} AS rank FROM ({_SIMS})) WHERE rank <= {k}"


def found(spark, sf, k):
    queries, data = vectors(spark, sf)
    return retrieval.knn_exact(queries, data, k)


@query(f"SELECT query_id, id, similarity, rank FROM ({top(K)})")
def knn_exact(spark, sf):
    return found(spark, sf, K)


@query()
def knn_approx(spark, sf):
    queries, data = vectors(spark, sf)
    return retrieval.knn_approx(queries, data, K)


@query(f"SELECT query_id, id, similarity, rank FROM ({top(K)})")
def knn_cells(spark, sf):
    """The inverted file with every cell that the triangle inequality leaves: the exact rows."""
    queries, data = vectors(spark, sf)
    return retrieval.knn_approx(queries, data, K, exact=True)


@query(f"SELECT query_id, id, similarity, rank FROM ({top(40)}) WHERE similarity >= 0.3")
def similarity_threshold(spark, sf):
    return retrieval.at_threshold(found(spark, sf, 40), "similarity", 0.3)


@query(f"SELECT query_id, id, similarity, {_RANK.format('similarity')} AS rank FROM (SELECT * FROM ({top(40)}) WHERE similarity >= 0.3) QUALIFY rank <= 3")
def rank_within_query(spark, sf):
    return retrieval.rank_within_query(retrieval.at_threshold(found(spark, sf, 40), "similarity", 0.3).drop("rank"), "similarity", 3)


def candidates(spark, sf):
    queries, data = vectors(spark, sf)
    near = retrieval.knn_exact(queries, data, 3 * K).join(queries.select("query_id", "q_label"), "query_id").join(data.select("id", "label"), "id")
    return retrieval.rescored(near, F.col("id") % 6, F.col("label") == F.col("q_label"))


_CAND = f"SELECT query_id, id, similarity, round(least(similarity + 0.035 * least(id % 6, 4) + CASE WHEN label = q_label THEN 0.015 ELSE 0 END, 1.0), 6)::DOUBLE AS score FROM ({top(3 * K)})"
_RERANK = "SELECT query_id, id, similarity, score, {} AS rank FROM ({}) QUALIFY rank <= {}"


@query(_RERANK.format(_RANK.format("score"), f"SELECT * FROM ({_CAND}) WHERE score >= 0.45", K))
def topk_rerank(spark, sf):
    return retrieval.topk_rerank(candidates(spark, sf), K, 0.45).select("query_id", "id", "similarity", "score", "rank")


@query(_RERANK.format(_RANK.format("score"), f"SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ({_CAND}) QUALIFY score >= 0.6 OR best < 0.6", K))
def topk_fallback(spark, sf):
    return retrieval.topk_rerank(candidates(spark, sf), K, 0.6, fallback=True).select("query_id", "id", "similarity", "score", "rank")


@query(f"""WITH f AS (SELECT * FROM ({top(K)}) WHERE similarity >= 0.5) SELECT query_id, id, similarity, rank FROM f UNION ALL
SELECT query_id, id, similarity, rank FROM ({top(40)}) WHERE query_id NOT IN (SELECT query_id FROM f)""")
def topk_wide_retry(spark, sf):
    queries, data = vectors(spark, sf)
    first = retrieval.at_threshold(retrieval.knn_exact(queries, data, K), "similarity", 0.5)
    return retrieval.wide_retry(first, queries, lambda left, k: retrieval.knn_exact(left, data, k), K)


@query(f"SELECT query_id, round(coalesce(avg(similarity), 0), 9) AS confidence FROM ({top(K)}) GROUP BY query_id")
def answer_confidence(spark, sf):
    return found(spark, sf, K).groupBy("query_id").agg(F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 9).alias("confidence"))


@query()
def embed_distinct_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.embed_distinct(d, "text", lambda t: retrieval.hashed_embedding(t, dims=64)).select("doc_id", "vector")


_LETTERS = ", ".join(f"length(text) - length(replace(text, '{chr(97 + i)}', ''))" for i in range(26))
_WEIGHTED = "list_transform(range(8), lambda j: list_sum(list_transform(range(26), lambda i: n[i + 1] * ((i * 7 + j * 3) % 5 - 2))))"


@query(f"""WITH v AS (SELECT doc_id, text, {_WEIGHTED} AS v FROM (SELECT doc_id, text, [{_LETTERS}] AS n FROM documents)), s AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))::DOUBLE) AS norm FROM v)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::FLOAT[] ELSE list_transform(v, lambda x: (x / CASE WHEN norm = 0 THEN 1 ELSE norm END)::FLOAT) END AS vector FROM s""")
def embed(spark, sf):
    """Every distinct text goes through a model once."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.embed_distinct(d, "text", embedding.embedder(embedding.letter_model(8), dims=8)).select("doc_id", "vector")


# --- terms ---------------------------------------------------------------------------------------------------------
LEXICON = [("the", ["teh", "article"]), ("de", ["von"]), ("of the", ["of-the"]), ("und", ["and", "sowie"])]


def terms_of(spark, sf):
    lexicon = F.broadcast(spark.createDataFrame(LEXICON, "trigger string, expansions array<string>"))  # a parameter of four rows
    return retrieval.expand_terms(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), lexicon)


_LEX = "(VALUES " + ", ".join("('{}', [{}])".format(t, ", ".join(f"'{e}'" for e in x)) for t, x in LEXICON) + ") l(trigger, expansions)"
_TERMS = rf"""WITH w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}/]+') AS ws FROM benchmark),
k AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(ws) AS token FROM w UNION ALL SELECT query_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS token FROM w)),
j AS (SELECT query_id, token, expansions FROM k LEFT JOIN {_LEX} ON trigger = split_part(token, '/', 1)),
x AS (SELECT query_id, token AS term FROM j WHERE NOT contains(token, ' ') UNION SELECT query_id, unnest(expansions) AS term FROM j)
SELECT query_id, list_sort(list(DISTINCT term)) AS terms FROM x WHERE length(term) >= 3 GROUP BY query_id"""


@query(_TERMS)
def expand_terms(spark, sf):
    return terms_of(spark, sf)


@query(f"SELECT query_id, text || ' ' || array_to_string(terms, ' ') AS expanded FROM ({_TERMS}) JOIN benchmark ON item_id = query_id")
def expand_query_text(spark, sf):
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return terms_of(spark, sf).join(texts, "query_id").select("query_id", F.concat_ws(" ", "text", F.array_join("terms", " ")).alias("expanded"))


TERMS = ("thing", "ation", "queou", "ungen", "mente")


@query("SELECT doc_id, " + " + ".join(f"contains(lower(text || ' ' || source), '{t}')::INT" for t in TERMS) + " AS hits FROM documents")
def lexical_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", retrieval.lexical_hits(F.concat_ws(" ", "text", "source"), F.array(*map(F.lit, TERMS))).alias("hits"))


# --- evaluation ----------------------------------------------------------------------------------------------------
def gold(spark, sf):
    """Cases: benchmark passages, expected in the documents that hold them whole; a passage that no document holds isn't answerable."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    held = retrieval.passages_in(table(spark, sf, "documents"), items, "doc_id").groupBy("passage_id").agg(F.array_sort(F.collect_set("doc_id")).alias("expected"))
    cases = items.select("passage_id").join(held, "passage_id", "left")
    none = F.array().cast("array<bigint>")
    return cases.select(F.col("passage_id").alias("query_id"), F.col("expected").isNotNull().alias("answerable"), F.coalesce("expected", none).alias("expected"))


def retrieved(spark, sf):
    """What was retrieved for each case: documents by length after the item's number, a stand-in ranking that needs no model."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 40).alias("query_id"), "n_chars")
    ranked = retrieval.rank_within_query(d.withColumnRenamed("doc_id", "id"), "n_chars", 20)
    return ranked.select("query_id", "rank", F.array("id").alias("ids"))


_RESULTS = """WITH g AS (SELECT b.item_id AS query_id, list_sort(list(DISTINCT d.doc_id) FILTER (d.doc_id IS NOT NULL)) AS e FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
c AS (SELECT query_id, e IS NOT NULL AND len(e) > 0 AS answerable, coalesce(e, []) AS expected FROM g),
r AS (SELECT doc_id % 40 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
p AS (SELECT c.query_id, any_value(answerable) AS answerable, any_value(expected) AS expected, count(rank) AS n_retrieved, coalesce(bool_or(list_contains(expected, id)), false) AS matched,
coalesce(1.0::DOUBLE / min(rank) FILTER (list_contains(expected, id)), 0.0::DOUBLE) AS reciprocal_rank, coalesce(list_sort(list(DISTINCT id) FILTER (id IS NOT NULL)), []) AS candidates FROM c LEFT JOIN r USING (query_id) GROUP BY 1),
f AS (SELECT *, CASE WHEN len(expected) > 0 THEN len(list_intersect(expected, candidates)) / len(expected) ELSE 0.0::DOUBLE END AS recall_fraction FROM p) """


def results(spark, sf):
    return evaluation.case_results(gold(spark, sf), retrieved(spark, sf))


@query(_RESULTS + "SELECT query_id, matched, answerable FROM f")
def eval_relevance(spark, sf):
    return results(spark, sf).select("query_id", "matched", "answerable")


@query(_RESULTS + "SELECT query_id, reciprocal_rank FROM f")
def reciprocal_rank(spark, sf):
    return results(spark, sf).select("query_id", "reciprocal_rank")


@query(_RESULTS + "SELECT query_id, candidates FROM f")
def candidate_id_union(spark, sf):
    return results(spark, sf).select("query_id", "candidates")


@query(_RESULTS + "SELECT query_id, list_sort(list_intersect(expected, candidates)) AS both_ids FROM f")
def expected_intersect(spark, sf):
    return results(spark, sf).select("query_id", F.array_sort(F.array_intersect("expected", "candidates")).alias("both_ids"))


_SUMMARY = """SELECT count(*) AS case_count, count_if(answerable)::BIGINT AS answerable_case_count, coalesce(avg(matched::INT) FILTER (answerable), 0)::DOUBLE AS hit_at_k,
coalesce(avg(matched::INT) FILTER (answerable), 0)::DOUBLE AS recall_at_k, coalesce(avg(reciprocal_rank) FILTER (answerable), 0)::DOUBLE AS mrr, coalesce(avg(recall_fraction) FILTER (answerable), 0)::DOUBLE AS recall_fraction,
coalesce(avg((n_retrieved > 0)::INT) FILTER (NOT answerable), 0)::DOUBLE AS unanswerable_retrieval_rate FROM f"""
_ROUNDED = ("hit_at_k", "recall_at_k", "mrr", "recall_fraction", "unanswerable_retrieval_rate")


@query(_RESULTS + "SELECT case_count, answerable_case_count, " + ", ".join(f"round({c}, 9) AS {c}" for c in _ROUNDED) + f" FROM ({_SUMMARY})")
def retrieval_eval(spark, sf):
    return evaluation.summary(results(spark, sf)).withColumns({c: F.round(c, 9) for c in _ROUNDED})


@query(
    _RESULTS
    + f""", s AS ({_SUMMARY}), g AS (SELECT 'hit_at_k' AS metric, hit_at_k AS actual, 0.7 AS bound, hit_at_k >= 0.7 AS passed FROM s UNION ALL SELECT 'mrr', mrr, 0.2, mrr >= 0.2 FROM s
UNION ALL SELECT 'answerable_case_count', answerable_case_count, 1, answerable_case_count >= 1 FROM s UNION ALL SELECT 'unanswerable_retrieval_rate', unanswerable_retrieval_rate, 0.5, unanswerable_retrieval_rate <= 0.5 FROM s)
SELECT metric, round(actual::DOUBLE, 9) AS actual, bound::DOUBLE AS bound, passed, bool_and(passed) OVER () AS all_passed FROM g""".replace("), g AS", "), gt AS").replace("FROM g", "FROM gt")
)
def threshold_gates(spark, sf):
    g = evaluation.gates(evaluation.summary(results(spark, sf)), {"hit_at_k": 0.7, "mrr": 0.2, "answerable_case_count": 1}, {"unanswerable_retrieval_rate": 0.5})
    return g.withColumn("actual", F.round("actual", 9))


@query(
    """SELECT query_id, arg_max(doc_id, (score, -doc_id)) AS doc_id, max(score) AS score FROM (SELECT doc_id % 40 AS query_id, doc_id, round(0.25 + n_chars / 100000.0, 6)::DOUBLE AS score FROM documents
WHERE contains(lower(text), 'ation') AND contains(lower(text), ' is ')) GROUP BY query_id"""
)
def best_definition_chunk(spark, sf):
    d = table(spark, sf, "documents").where(T.contains_any(F.lower("text"), ("ation",)) & T.contains_any(F.lower("text"), (" is ",)))
    d = d.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"), F.round(F.lit(0.25) + F.col("n_chars") / 100000, 6).alias("score"))
    return retrieval.rank_within_query(d, "score", 1).select("query_id", F.col("id").alias("doc_id"), "score")
