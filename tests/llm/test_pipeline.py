"""The pipeline: decisions of every stage take effect, and run() agrees with stages applied by hand on a small corpus."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_operators import alike, prose, repeats_by_force, targets_by_force  # noqa: E402


def test_run(spark, make, tmp_path):
    texts = [prose(i, 60) for i in range(30)]
    shared = prose(99, 30)
    rows = [(i, t if i % 4 else f"{t} {shared}", "en", "abc"[i % 3]) for i, t in enumerate(texts)]
    rows += [(49, " ".join(["new", *texts[6].split()[1:]]), "en", "c"), (50, texts[7], "en", "b"), (51, "1 2 3 !", "en", "a"), (52, None, "en", "a"), (53, texts[8], "en", None)]
    random.Random(1).shuffle(rows)
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).toPandas()

    docs = {i: (t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)}
    near = {(i, j): alike(docs[i][0], docs[j][0]) >= 0.8 for i in docs for j in docs}
    root = {i: i for i in docs}
    for _ in range(len(docs)):
        for i in docs:
            for j in docs:
                if near[i, j]:
                    root[i] = root[j] = min(root[i], root[j])
    docs = {i: d for i, d in docs.items() if root[i] == i}
    order = sorted(docs)
    left = repeats_by_force([docs[i][0].encode() for i in order], 100)
    docs = {i: (b.decode("utf-8", "ignore"), docs[i][1]) for i, (b, _) in zip(order, left) if b}
    assert 49 not in docs and 50 not in docs and 51 not in docs and set(got.doc_id) <= set(docs)

    sizes = {}
    for text, source in docs.values():
        sizes[source] = sizes.get(source, 0) + len(text.split())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, (t, _) in docs.items()}
    wanted = targets_by_force(sizes)
    whole = got[["doc_id", "doc_tokens", "start"]].query("start == 0")
    for source, want in wanted.items():
        mine = whole[[docs[i][1] == source for i in whole.doc_id]]
        copies = sum(min(1.0, r.doc_tokens / tokens[r.doc_id]) * len(docs[r.doc_id][0].split()) for r in mine.itertuples())
        assert abs(copies - want) <= 0.1 * max(want, 60)
    lengths = got.groupby("sequence_id").length.sum()
    assert (lengths.iloc[:-1] == 1024).all() and np.all(got.length > 0)


def test_stages_keep_columns_and_odd_rows(spark, odd, tmp_path):
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
    empty = odd.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
