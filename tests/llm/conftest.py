import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """Documents from texts, or (id, text, lang, source) tuples."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang, source = r if isinstance(r, tuple) else (i, r, "en", "a")
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture()
def odd(make):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} of" for i in range(30000))
    return make(
        [(1, "the same words in the same order " * 9, "en", "a"), (1, "the same words in the same order " * 9, "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, long, "en", "b"), (4, "another text", "de", "a"),
         (None, "no id at all", "en", "a"), (None, None, None, None), (5, " \n\t ", "en", "a"), (6, "é ü ß 漢字 👍 the same words", "de", None), (7, "a" * 5000, "en", "b"), (8, "123 !!", "en", "b")]
    )


@pytest.fixture()
def clash(odd):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("_key", "_text", "_doc", "_group", "_id", "size", "target", "taken", "fp", "_queue", "_host", "kept", "score", "shard", "slot", "rank", "key", "length", "start", "_range", "held_out", "fingerprint")
    return odd.withColumns({n: F.lit("x") for n in names})
