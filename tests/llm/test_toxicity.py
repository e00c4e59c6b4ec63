"""The chain's marginals against all label sequences, and held-out accuracy."""

import itertools

import numpy as np
import pytest

from lodestone.llm import toxicity


def test_marginals_are_the_sums_over_all_sequences():
    rng = np.random.default_rng(1)
    emission, transition = rng.normal(size=(3, 5)), rng.normal(size=2)
    present = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], dtype=bool)
    got = toxicity.marginals(np.where(present, emission, 0), present, transition)[0]
    for row in range(3):
        n = present[row].sum()
        weight = {}
        for states in itertools.product((0, 1), repeat=int(n)):
            score = sum(s * (emission[row, t] + transition[states[t - 1] if t else 0]) for t, s in enumerate(states))
            weight[states] = np.exp(score)
        for t in range(n):
            want = sum(w for s, w in weight.items() if s[t]) / sum(weight.values())
            assert got[t, row] == pytest.approx(want)


@pytest.fixture(scope="module")
def scored(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    docs = read("documents")
    model = toxicity.train(docs, read("labels"), toxic_rows=2000, clean_rows=2000)
    return docs, toxicity.score(docs, model).join(read("labels"), "doc_id").collect(), model


def test_held_out_accuracy(scored):
    rows = [r for r in scored[1] if r["held_out"]]
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_spans_are_tokens_of_the_text(scored):
    texts = {r["doc_id"]: r["text"].encode() for r in scored[0].collect()}
    marked = [r for r in scored[1] if r["spans"]]
    assert marked
    for r in marked:
        for span in r["spans"].split(","):
            a, b = map(int, span.split(":"))
            assert texts[r["doc_id"]][a:b].lower().strip() and b" " not in texts[r["doc_id"]][a:b]


def test_edges(spark, scored):
    model = scored[2]
    rows = [(1, None, 0.5), (1, "", 0.5), (None, "word " * 100_000, 0.5), (2, "!!", 0.5), (2, "!!", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for value, want in ((0, 0), (1, 1), (None, 0)):
        labels = spark.createDataFrame([(i, value) for i in [*range(20), 99, None]], "doc_id long, toxic int")
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert {r["predicted"] for r in got} == {want}


def test_training_is_the_same_on_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    models = [toxicity.train(d, labels, chain_rows=60) for d in (docs.coalesce(1), docs.repartition(7, "text"))]
    assert np.array_equal(models[0].weights, models[1].weights)
    assert np.allclose(models[0].calibration, models[1].calibration, rtol=1e-9)
