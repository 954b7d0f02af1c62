"""The step that feature table, fits and reports share: documents picked by their score, features split once."""

from __future__ import annotations

import pytest

from commentlab.operators import blocks as B
from commentlab.plans import fixtures as fx
from commentlab.plans import q_learn
from commentlab.plans.q_vocab import Corpus

DIM = fx.DIM
TEXTS = [(i, f"w{i % 7} of w{i % 3} " * 8) for i in range(60)] + [(7, "w1 once more"), (60, None), (61, ""), (None, "of w1")]
LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 62, 3)] + [(3, 1, 1), (1, -1, 0), (None, 1, 1), (99, 1, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    tables = {
        "documents": spark.createDataFrame(TEXTS, "doc_id bigint, text string"),
        "labels": spark.createDataFrame(LABELS, "doc_id bigint, toxic int, quality int"),
        "embeddings": spark.createDataFrame([(i, [float((i * j) % 5 - 2) for j in range(DIM)]) for i in range(8)], "vec_id bigint, embedding array<float>"),
    }
    for name, df in tables.items():
        df.repartition(2).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_documents_are_picked_by_their_labels_without_a_shuffle_of_texts(spark, folder, monkeypatch):
    dealt, made = [], B.document_blocks
    monkeypatch.setattr(B, "document_blocks", lambda docs, *a, **k: dealt.append(docs) or made(docs, *a, **k))
    q_learn._comment_features(spark, folder)
    (docs,) = dealt
    assert "BroadcastHashJoin" in plan(docs) and "SortMergeJoin" not in plan(docs) and "Exchange" not in plan(docs)
    scored = {i for i, toxic, _ in LABELS if toxic != -1}
    assert sorted(docs.collect()) == sorted((i, t) for i, t in TEXTS if i is not None and i in scored)


def test_blocks_are_made_for_the_picked_documents_only(spark, folder, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_TOKENS", 50)
    n = []
    made = B.document_blocks
    monkeypatch.setattr(B, "document_blocks", lambda docs, tokens, n_blocks, *a, **k: n.append(n_blocks) or made(docs, tokens, n_blocks, *a, **k))
    c = Corpus(spark, folder)
    c.blocks()
    c.blocks(ids=spark.createDataFrame([(0,), (1,)], "id bigint"))
    c.blocks(ids=spark.createDataFrame([], "id bigint"))
    assert n[0] > 20 and n[1:] == [1, 1]


def test_features_are_split_once(spark, folder):
    for parts in (q_learn._features(spark, folder), tuple(q_learn._three_parts(spark, folder).values())):
        assert not any("Join" in plan(p) or "Exchange" in plan(p) for p in parts)
        labels = fx.scored_comments(spark, folder).where("length(comment_text) > 0").groupBy("id").count().collect()
        rows = sorted(r["id"] for p in parts for r in p.collect())
        assert rows == sorted(i for i, k in map(tuple, labels) for _ in range(k * k))  # a row of either side of the split's join
