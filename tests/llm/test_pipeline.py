"""Each stage against the operator it stands for, and the whole run."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lodestone.llm import decontamination, personal_data, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for _, stage in pipeline.STAGES:
        found.append(spark.createDataFrame(stage(spark, found[-1], FOLDER).toArrow()))
    return found


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(steps):
    for df in steps[:-1]:
        assert df.dtypes == steps[0].dtypes
    assert steps[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = by_id(steps[1])
    clean = [d for d in by_id(steps[0]) if labels.get(d) == 0]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)


def test_one_of_each_group_stays(steps):
    groups = simhash.near_copies(steps[1]).collect()
    assert set(by_id(steps[2])) == {r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]}
    assert steps[2].count() == len(by_id(steps[2]))


def test_contaminated_documents_go(spark, steps):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = decontamination.contamination(steps[2], items).collect()
    assert set(by_id(steps[3])) == {r["doc_id"] for r in found if not r["hits"]}


def test_personal_data_is_replaced(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    assert set(before) == set(after)
    anchors = personal_data.automaton()
    for d, row in before.items():
        spans = personal_data.spans_of(row["text"], anchors)
        assert after[d]["text"] == personal_data.redact(row["text"], spans)
        assert after[d]["n_chars"] == len(after[d]["text"])


def test_tokens_are_the_librarys(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = by_id(steps[4])
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)


def test_run(spark, steps):
    want = {(r["doc_id"], bytes(r["ids"])) for r in steps[-1].collect()}
    assert {(r["doc_id"], bytes(r["ids"])) for r in pipeline.run(spark, FOLDER).collect()} == want


def test_one_of_each_with_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "", "a"), (7, None, "b"), (3, "one", "c"), (3, "one", "d"), (3, "two words", "e"), (9, "two words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string").withColumnRenamed("root", "_mark")
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, "one"), (3, "two words"), (7, None)]


def test_stages_on_no_rows(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.dtypes == steps[0].dtypes
    assert pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0
