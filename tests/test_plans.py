"""Plans keep the shape that scale needs: pushed filters, pruned columns, limits before shuffles, one-pass splits."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_exact", "topk_rerank"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "Partial" in plan(spark, name) and "WindowGroupLimit" in plan(spark, name)


def test_filters_reach_the_scan(spark):
    text = plan(spark, "metadata_filter")
    assert "EqualTo(lang,fr)" in text and "text" not in text.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["collection_stats", "corpus_profile", "request_metrics", "validation_report"])
def test_aggregates_are_partial(spark, name):
    assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name", sorted(set(entry.PLANS.QUERIES) - {n for n in entry.PLANS.QUERIES if n.startswith("stream")}))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_page_text_and_its_sql_read_character_references_alike(spark, tmp_path):
    parts = ["<h1>and&amp</h1>", "&ampx;y &am &a &quo &", "&notit; &notin; &frac12x &NotEqualTilde;", "&nbsp;a&nbsp;b　", "&#39 &#x41;&#X41 &#0; &#128;&#3;x", "&#55296; &#1114112; &#99999999999999999999; &#;&#xg", "&amp;lt; &lt;p&gt; &#10;b", "a\x01b", None]
    spark.createDataFrame(list(enumerate(parts)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in entry.queries()["html_to_text"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(db.execute(entry.oracle_sql()["html_to_text"]).fetchall()) == got
    assert got[0] == "and&" and got[2] == "¬it; ∉ ½x ≂̸" and got[3] == "a\xa0b" and got[4] == "' AA � €x"
