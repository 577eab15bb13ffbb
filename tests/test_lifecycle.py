"""The query lifecycle with parts of its own."""

from pyspark.sql import functions as F

from groundwork.operators.lifecycle import CONTRACT, MESSAGES, Lifecycle

QUERIES = [(1, 7, " "), (2, 7, None), (3, 7, "Please refuse"), (4, 7, "vague"), (5, 7, "lost?"), (6, 8, "what is a loan"), (7, None, "is it allowed"), (8, 8, "silent"), (9, 8, "is it missing"), (10, 8, "bare claim")]


def rows(spark, **parts):
    queries = spark.createDataFrame([(*q, "clash") for q in QUERIES], "query_id long, session_id long, query string, text string")

    def retrieve(open_):
        at = F.col("rank")
        return open_.where("query NOT LIKE 'lost%'").withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2)))).select(
            "query_id", "rank", F.lit("c").alias("chunk_id"), F.concat(F.lit("FAS-0"), at.cast("string")).alias("standard"), F.lit("3").alias("section"), F.col("query").alias("text"), (1.0 / at).alias("score")
        )

    def generate(prompts):
        said = F.when(F.col("query").like("%allowed"), "COMPLIANT [FAS-01 §3]").when(F.col("query").like("%missing"), "A detail is missing").otherwise("COMPLIANT without a source")
        return prompts.where("query <> 'silent'").select("query_id", said.alias("answer"))

    given = dict(
        retrieve=retrieve,
        generate=generate,
        clarify=lambda open_: open_.where("query = 'vague'").select("query_id", F.lit("Which one?").alias("question")),
        refuses=lambda t: t.contains("refuse"),
    )
    out = Lifecycle(**(given | parts)).run(queries)
    assert out.columns == list(CONTRACT)
    return {r.query_id: r for r in out.collect()}


def test_routes(spark):
    got = rows(spark)
    assert {i: (r.route, r.status) for i, r in got.items()} == {
        1: ("empty", "INSUFFICIENT_DATA"),
        2: ("empty", "INSUFFICIENT_DATA"),
        3: ("refused", "INSUFFICIENT_DATA"),
        4: ("clarify", "CLARIFICATION_NEEDED"),
        5: ("unanswered", "INSUFFICIENT_DATA"),
        6: ("definition", "INSUFFICIENT_DATA"),
        7: ("answer", "COMPLIANT"),
        8: ("unanswered", "INSUFFICIENT_DATA"),
        9: ("answer", "CLARIFICATION_NEEDED"),
        10: ("answer", "INSUFFICIENT_DATA"),
    }
    assert got[4].answer == got[4].question == "Which one?" and got[10].answer == MESSAGES["ungrounded"] and got[5].confidence == 0.0
    assert got[7].n_citations == 1 and got[7].confidence == 0.75 and got[6].answer.endswith("what is a loan [FAS-01 §3]") and got[6].prompt is None
    assert got[7].prompt.startswith("[1] FAS-01 §3 (score: 1.00)\nis it allowed") and got[7].prompt.endswith("\n\nis it allowed")


def test_parts_can_be_swapped(spark):
    past = lambda p: spark.createDataFrame([(8, "User: before")], "session_id long, text string")
    got = rows(spark, clarify=None, history=past, messages=MESSAGES | {"refused": "No."}, build=lambda context, history, query: F.concat_ws("|", history, query), validate=lambda answers, chunks: answers.select("answer_id"))
    assert got[3].answer == "No." and got[4].route == "answer" and got[10].prompt == "User: before|bare claim" and got[7].prompt == "is it allowed"
    assert got[10].status == "COMPLIANT" and got[10].n_citations == 1


def test_no_queries(spark):
    empty = spark.createDataFrame([], "query_id long, session_id long, query string")
    chunks = spark.createDataFrame([], "query_id long, rank int, chunk_id string, standard string, section string, text string, score double")
    assert Lifecycle(retrieve=lambda q: chunks, generate=lambda p: p.select("query_id", F.lit("x").alias("answer"))).run(empty).count() == 0
