"""Stages that drop or change rows, on nulls, repeated rows and clashing columns."""

import pytest

from lodestone.llm import decontamination, personal_data, toxicity

SCHEMA = "doc_id long, text string, n_chars long, _mark string, row int, item_id long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "m", 2, 3) for i, t in texts], SCHEMA).repartition(3)


PASSAGE = "one two three four five six seven eight nine ten eleven"


def test_without_contaminated(spark):
    texts = [(1, None), (2, ""), (3, f"x {PASSAGE} y"), (3, f"x {PASSAGE} y"), (4, "clean"), (4, "clean"), (None, PASSAGE), (None, "a")]
    docs = frame(spark, texts)
    items = spark.createDataFrame([(7, PASSAGE, "z"), (8, None, "z")], "item_id long, text string, doc_id string")
    kept = decontamination.without_contaminated(docs, items)
    assert kept.dtypes == docs.dtypes
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == [(1, None), (2, ""), (4, "clean"), (4, "clean")]
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["a"]
    assert decontamination.without_contaminated(docs, items.limit(0)).count() == len(texts)
    assert decontamination.without_contaminated(docs.limit(0), items).count() == 0


def test_redacted(spark):
    texts = [(1, None), (2, ""), (3, "to bob@host.example now"), (3, "to bob@host.example now"), (None, "plain")]
    docs = frame(spark, texts)
    found = personal_data.redacted(docs)
    assert found.dtypes == docs.dtypes
    rows = found.collect()
    assert len(rows) == len(texts)
    said = [r["text"] for r in rows if r["doc_id"] == 3]
    assert len(said) == 2 and said[0] == said[1] and "bob@" not in said[0]
    assert {r["text"] for r in rows if r["doc_id"] in (1, 2)} <= {None, ""}
    assert [r["text"] for r in rows if r["doc_id"] is None] == ["plain"]


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.001"
    return toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def test_without_toxic(spark, model):
    texts = [(1, None), (2, ""), (3, "a plain line"), (3, "a plain line"), (None, "another")]
    docs = frame(spark, texts)
    kept = toxicity.without_toxic(docs, model)
    assert kept.dtypes == docs.dtypes
    scored = {(r["doc_id"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    want = sum((i, 0) in scored for i, _ in texts)
    assert kept.count() == want
    assert toxicity.without_toxic(docs.limit(0), model).count() == 0
