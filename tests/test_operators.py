"""Operators on hand-made rows, after the facts of the fixtures."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from groundwork.functions import rules
from groundwork.functions import text as T
from groundwork.operators import chunking, dialogue, embedding, evaluation, grounding, history, pages, retrieval, tables, traffic
from groundwork.sources import corpus
from groundwork.streaming import streams


def test_upsert_and_insert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "id long, v string, seq int")
    assert sorted(map(tuple, tables.upsert(target, updates, "id", "seq").collect())) == [(1, "a"), (2, "y"), (3, None)]
    assert sorted(tables.insert_new(target, updates.drop("seq"), "id").select("id").toPandas().id) == [1, 2, 3]


def test_metadata(spark):
    rows = spark.createDataFrame([('{"language":"en","pages":12}',), ("no json",), ("[1]",)], "t string")
    assert [r.m for r in rows.select(tables.parse_metadata(F.col("t")).alias("m")).collect()] == [{"language": "en", "pages": "12"}, {}, {}]


def test_chunks_cover_the_text(spark):
    text = "One two three. " * 90 + "x" * 700 + "\n\nlast part"
    rows = chunking.chunk_recursive(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string"), "doc_id", 200, 20).collect()
    mine = sorted((r.start, r.stop, r.text) for r in rows if r.doc_id == 1)
    assert mine[0][0] == 0 and mine[-1][1] == len(text) and all(b - a <= 200 and t == text[a:b] for a, b, t in mine)
    assert all(0 <= x[1] - y[0] <= 20 for x, y in zip(mine, mine[1:])) and {r.doc_id for r in rows} == {1, 3}


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\n# B\nbody\nmore\n# C\n")], "doc_id long, text string")
    rows = chunking.sections(docs, "doc_id", "^# ").orderBy("section").collect()
    assert [(r.title, r.text) for r in rows] == [("Introduction", "intro"), ("# B", "body\nmore")]


def test_html():
    assert pages.page_text("<html><script>var x='</p>';</script><nav>n<b>x</b></nav><p>One <b>two</b></p>\n<p> &amp; three") == "One\ntwo\n& three"
    assert pages.page_text(None) == "" and pages.page_text("<nav>never closed") == ""


def test_html_elements_end_with_those_around_them():
    assert pages.page_text("<div><nav>menu</div><p>article</p>") == "article"
    assert pages.page_text("<body><header><p>a<br>b<footer>c</header><main>d<img src=x>e</main></body>") == "d\ne"
    assert pages.page_text("</nav>x<style>y</style>z") == "x\nz"


def test_next_chunk_starts_after_a_separator():
    text = " ".join(f"word{i}" for i in range(400)) + "\n\n" + "y" * 300 + " " + "الكلمة؟ التالية، " * 40
    spans = chunking.split_text(text, 200, 30)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert 0 <= b - c <= 30 and d > b
        assert c == b or text[c - 1] in " \n" or b - a == 200  # a whole word begins, unless nothing separates
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert any(c < b and text[c - 1] == " " for (_, b), (c, _) in zip(spans, spans[1:]))


def test_section_chunks_are_numbered(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "one two. " * 100 + "\n# B\nshort\n# C\n" + "three. " * 60), (2, None), (3, "tiny")], "doc_id long, text string")
    rows = chunking.chunk_sections(docs, "doc_id", "^# ", size=400, overlap=40).orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and all(r.total_chunks == len(rows) for r in rows)
    assert {r.title for r in rows} == {"# A", "# C"} and all(50 <= r.token_count <= 100 for r in rows) and {r.doc_id for r in rows} == {1}


def test_contract_checks(spark):
    rows = spark.createDataFrame([("Which asset?", [1.0, 2.0], True, 1), ("Which?\nWhat?", [1.0], True, 0), ("- Which?", None, False, 0), ("أي أصل؟", None, False, 2), ("None", [], True, 1)], "t string, v array<double>, c boolean, n int")
    got = [tuple(r) for r in rows.select(tables.one_question(F.col("t")), tables.has_dims(F.col("v"), 2), tables.grounded(F.col("c"), F.col("n"))).collect()]
    assert got == [(True, True, True), (False, False, False), (False, True, True), (True, True, True), (False, False, True)]


def test_embeddings_of_repeated_and_null_texts(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")], "id long, text string")
    got = {r.id: list(r.vector) for r in retrieval.embed_distinct(rows, "text", lambda t: retrieval.hashed_embedding(t, dims=8)).collect()}
    assert got[1] == got[2] != got[5] and got[3] == got[4] == [] and len(got) == 5


def test_links(spark):
    rows = spark.createDataFrame([(1, '<a href="/standard-1">A</a><a class="x" href="http://y.org/z">FAS 2</a><a href="/no">n</a>')], "page_id long, html string")
    assert [(r.title, r.url) for r in pages.extract_links(rows, "page_id", "html", F.lit("https://x.org")).collect()] == [("A", "https://x.org/standard-1"), ("FAS 2", "http://y.org/z")]


def test_threshold_and_fallback(spark):
    rows = spark.createDataFrame([(1, 10, 0.15), (1, 11, 0.1), (2, 10, 0.9), (2, 11, 0.2)], "query_id long, id long, similarity double")
    scored = retrieval.rescored(rows, F.lit(0), F.lit(False))
    assert {(r.query_id, r.id) for r in retrieval.topk_rerank(scored, 5, 0.3).collect()} == {(2, 10)}
    assert {(r.query_id, r.id) for r in retrieval.topk_rerank(scored, 5, 0.3, fallback=True).collect()} == {(1, 10), (1, 11), (2, 10)}
    assert retrieval.at_threshold(rows, "similarity", 5.0).count() == 0 and retrieval.at_threshold(rows, "similarity", -1.0).count() == 4


def test_rerank_moves_a_term_hit_up(spark):
    rows = spark.createDataFrame([(1, "general", 0.80, 0), (1, "murabaha", 0.78, 1)], "query_id long, id string, similarity double, hits int")
    best = retrieval.topk_rerank(retrieval.rescored(rows, F.col("hits"), F.lit(False)), 1, 0.3).first()
    assert best.id == "murabaha" and best.score == pytest.approx(0.815)


def test_terms(spark):
    lexicon = spark.createDataFrame([("real estate", ["rental income"]), ("ijarah", ["lease", "x"])], "trigger string, expansions array<string>")
    rows = retrieval.expand_terms(spark.createDataFrame([(1, "Real estate and ijarah/lease to own")], "query_id long, text string"), lexicon)
    assert {"rental income", "lease", "estate"} <= set(rows.first().terms) and "x" not in rows.first().terms


def test_passages(spark):
    docs = spark.createDataFrame([(1, "a whole passage here"), (2, "a whole"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "whole passage"), (8, "absent")], "passage_id long, text string")
    for most in (1 << 20, 8):
        assert [tuple(r) for r in retrieval.passages_in(docs, items, "doc_id", most_bytes=most).collect()] == [(7, 1)]


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, True, ["b"]), (2, False, [])], "query_id long, answerable boolean, expected array<string>")
    got = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["b", "B"]), (2, 1, ["z"])], "query_id long, rank int, ids array<string>")
    s = evaluation.summary(evaluation.case_results(cases, got))
    r = s.first()
    assert (r.hit_at_k, r.mrr, r.recall_fraction, r.unanswerable_retrieval_rate, r.answerable_case_count) == (1.0, 0.5, 1.0, 1.0, 1)
    gates = {g.metric: g for g in evaluation.gates(s, {"hit_at_k": 0.7, "mrr": 0.6}, {"unanswerable_retrieval_rate": 0.5}).collect()}
    assert gates["hit_at_k"].passed and not gates["mrr"].passed and not gates["unanswerable_retrieval_rate"].passed and not gates["mrr"].all_passed
    with pytest.raises(ValueError):
        evaluation.gates(s, {"mrr": 1.5}, {})
    assert evaluation.summary(evaluation.case_results(cases.limit(0), got)).first().mrr == 0.0


@pytest.mark.parametrize("answer, standard, section, n", [("See [FAS-99 §9].", "FAS-01", "1", 0), ("[FAS-28 §999.9, p.1]", "FAS-28", "3.1", 0), ("[FAS-1 section 1]", "FAS-01", "1", 1), ("[FAS-1]", "FAS-01", "4", 1), ("[FAS-1 §2]", "FAS-01", None, 1)])
def test_evidence(spark, answer, standard, section, n):
    answers = spark.createDataFrame([(1, answer)], "answer_id long, answer string")
    chunks = spark.createDataFrame([(1, 1, "c", standard, section, "t", 0.5)], "answer_id long, rank int, chunk_id string, standard string, section string, text string, score double")
    cited = grounding.cited(answers)
    assert grounding.evidence(cited, chunks).count() == n
    assert grounding.unsupported(cited, chunks).count() == cited.count() - n


def quota(spark, rows, limit, width):
    events = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k string, t long, i long").withColumn("ts", F.timestamp_seconds("t"))
    return {r.i: r for r in traffic.quota_anchored(events, "k", "ts", limit, width, "i").collect()}


def test_anchored_quota(spark):
    out = quota(spark, [("a", 1000), ("a", 1000), ("a", 1000), ("a", 1011), ("b", 1000)], 2, 10)
    assert [out[i].allowed for i in range(5)] == [True, True, False, True, True] and out[0].reset_at == 1010 and out[3].reset_at == 1021
    assert [quota(spark, [("a", 5)] * 4, 3, 10)[i].remaining for i in range(4)] == [2, 1, 0, 0]
    assert quota(spark, [("a", 0), ("a", 10)], 1, 10)[1].allowed
    with pytest.raises(ValueError):
        quota(spark, [], 0, 10)


def test_sessions_end_after_the_gap(spark):
    events = spark.createDataFrame([("a", 0, 0), ("a", 1800, 1), ("a", 3601, 2)], "k string, t long, i long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.n for r in traffic.sessionize(events, "k", "ts", 1800, "i").collect()) == [1, 2]


def test_metrics_text(spark):
    events = spark.createDataFrame([('/q"', 200, 0.5), ("/q", 503, 1.0)], "path string, status int, s double")
    lines = [r.line for r in traffic.metrics_text(traffic.request_metrics(events, "path", F.col("status") >= 500, "s"), "x").collect()]
    assert lines == ['x_request_count{path="/q"} 2', 'x_error_count{path="/q"} 1', 'x_latency_seconds_sum{path="/q"} 1.500000']


INVESTMENT = [(1, 1, "I want to invest in a company"), (1, 2, "It is a software company"), (1, 3, "3% of revenue is haram")]


def test_dialogue(spark):
    turns = [*INVESTMENT, (2, 1, "hello"), (2, 2, "a loan"), (2, 3, "dunno"), (3, 1, "The bank buys a car and sells it with disclosed markup and deferred payment after possession")]
    rows = {(r.session_id, r.turn): r for r in dialogue.clarify(spark.createDataFrame(turns, "session_id long, turn long, text string")).collect()}
    assert rows[1, 1].asks == "company_activity" and rows[1, 3].state == "READY"
    assert json.loads(rows[1, 3].known)["non_compliant_revenue_percent"] == "3.0"
    assert rows[2, 1].asks == "operation_type" and rows[2, 2].asks == "principal_amount" and rows[2, 3].status == "ready" and json.loads(rows[2, 3].missing)
    assert rows[3, 1].status == "ready" and json.loads(rows[3, 1].known)["item_type"] == "car"


def test_dialogue_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame(INVESTMENT, "session_id long, turn long, text string")
    turns.write.parquet(str(tmp_path / "in"))
    stream = streams.clarify_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")))
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(setting, "false")  # else batches without data follow for ever, as the state ends by the clock
    try:
        streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(setting, "true")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, dialogue.clarify(turns).collect()))


def test_histories(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}" * 3) for i in range(14)] + [(2, 0, "system", "why?")], "c long, turn long, role string, text string")
    assert [h.turn for h in history.recent_history(turns, "c", "turn").where("c = 1").first().history] == list(range(4, 14))
    assert history.history_text(turns, "c", "turn").where("c = 1").first().text.count("User: ") == 3
    assert {r.c: r.title for r in history.titles(turns, "c", "turn").collect()} == {1: "t0t0t0", 2: "New conversation"}
    assert {r.c: r.n_questions for r in history.question_turns(turns, "c").collect()} == {1: 0, 2: 1}


def test_scan_and_cases(spark, tmp_path):
    for name in ("a_28_en_x.md", "a_28_ar_x.md", "INDEX.md", "notes.md"):
        (tmp_path / name).write_text(f"line\n{name}")
    rows = corpus.scan_corpus(spark, str(tmp_path), ("en", "ar")).orderBy("path").collect()
    assert [r.source_language for r in rows] == ["ar", "en"] and rows[0].text.startswith("line\n")
    assert corpus.scan_corpus(spark, str(tmp_path), ("ar",)).count() == 1
    (tmp_path / "c.json").write_text('[{"question": "q", "expected_chunks": [], "expected_standards": ["s"]},\n {"query": "p", "answerable": false}]')
    cases = {r["query"]: r for r in corpus.load_eval_cases(spark, str(tmp_path / "c.json")).collect()}
    assert cases["q"].expected == ["s"] and cases["q"].answerable and not cases["p"].answerable


def test_event_log(spark):
    log = 'event: started\ndata: {"a": 1}\n\ndata: lost\n\nevent: token\ndata: not json\n\n'
    rows = spark.createDataFrame([(log,)], "t string").select(corpus.parse_event_log(F.col("t")).alias("e")).first().e
    assert [(r.event, r.data, r.valid) for r in rows] == [("started", '{"a": 1}', True), ("token", "not json", False)]


def test_answer_events(spark):
    rows = spark.createDataFrame([(1, "a", ["c1", "c2"], "COMPLIANT", 0.5, None), (2, "b", [], "x", 0.1, "timeout")], "request_id long, answer string, citations array<string>, status string, confidence double, error string")
    out = [(r.request_id, r.event) for r in corpus.expand_answer_events(rows).orderBy("request_id", "seq").collect()]
    assert [e for i, e in out if i == 1] == ["started", "retrieval", "token", "citation", "citation", "done"] and [e for i, e in out if i == 2] == ["started", "error"]


def test_markdown_sink(spark, tmp_path):
    rows = [("a_en_.md", "x\ny\n"), ("a_en_.md", "w"), ("b_ar.md", None), (None, "lost"), ("c_en_ü.md", "é" * 70000), (".hidden", "no")]
    docs = spark.createDataFrame(rows, "file_name string, content string")
    for _ in range(2):  # the second write takes the place of the first
        corpus.write_markdown(docs.where("file_name is null or file_name <> '.hidden'"), f"file://{tmp_path}/md", buckets=2)
    found = {p.name: p.read_text() for p in (tmp_path / "md").rglob("*") if p.is_file()}
    assert found == {"a_en_.md": "x\ny\n", "b_ar.md": "", "c_en_ü.md": "é" * 70000} and len(list((tmp_path / "md").iterdir())) <= 2
    back = corpus.scan_corpus(spark, f"file://{tmp_path}/md", ("en",))
    assert {(r.file_name, r.source_language, r.text) for r in back.collect()} == {("a_en_.md", "en", "x\ny\n"), ("c_en_ü.md", "en", "é" * 70000)}
    assert back.where(F.col("source_language") != T.language_by_file_name(F.col("file_name"))).count() == 0
    assert spark.read.text(back.where("file_name = 'a_en_.md'").first().path, wholetext=True).first().value == "x\ny\n"
    with pytest.raises(Exception, match="not a file name"):
        corpus.write_markdown(docs, str(tmp_path / "bad"))
    corpus.write_markdown(docs.limit(0), str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert corpus.scan_corpus(spark, str(tmp_path / "empty"), ("en",)).count() == 0


def test_files_that_do_not_belong_are_not_opened(spark, tmp_path):
    (tmp_path / "a_en_.md").write_bytes(b"x\xffy")
    (tmp_path / "b_ar_.md").write_text("x")
    (tmp_path / "b_ar_.md").chmod(0)
    (tmp_path / "c_en_.md.gone").symlink_to(tmp_path / "nowhere")
    assert [r.text for r in corpus.scan_corpus(spark, str(tmp_path), ("en",)).collect()] == ["x\ufffdy"]


def test_embedder_loads_once_and_calls_in_batches(spark, tmp_path):
    def load():
        (tmp_path / f"load-{uuid.uuid4().hex}").touch()

        def model(texts):
            (tmp_path / f"call-{len(texts)}-{uuid.uuid4().hex}").touch()
            return [[len(t), 3.0] for t in texts]

        return model

    rows = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(100)] + [(100, None)], "id long, text string").repartition(1)
    got = {r.id: list(r.vector) for r in embedding.embedder(load, dims=2, batch_size=8)(rows).collect()}
    assert got[4] == pytest.approx([0.8, 0.6]) and got[0] == [] and got[100] == [] and len(got) == 101
    calls = [int(p.name.split("-")[1]) for p in tmp_path.glob("call-*")]
    assert max(calls) == 8 and sum(calls) == 101 and len(list(tmp_path.glob("load-*"))) == 1
    with pytest.raises(Exception, match="dimensions"):
        embedding.embedder(load, dims=3)(rows).collect()


def test_table_function_cuts_as_the_operator(spark):
    docs = spark.createDataFrame([(1, "One two. Three; four, five\n\nsix " * 30), (2, None), (3, ""), (4, "ab")], "doc_id long, text string")
    chunking.register_chunker(spark)
    lateral = spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL chunk_text(d.text, 90, 20) c", d=docs)
    assert sorted(map(tuple, lateral.collect())) == sorted(map(tuple, chunking.chunk_recursive(docs, "doc_id", 90, 20).collect()))


def test_missing_facts(spark):
    row = spark.range(1).select(rules.missing_facts(F.lit("loan"), F.create_map(F.lit("purpose"), F.lit("x"))).alias("m")).first()
    assert row.m == ["principal_amount", "interest_rate", "term_months"]
