import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.plans import catalog

RANKING = "qid bigint, pid bigint, rank int"


def run(spark, rows):
    return spark.createDataFrame(rows, RANKING)


def qrels(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, pid bigint")


def test_reciprocal_rank_uses_the_first_positive_only(spark):
    ranked = run(spark, [(1, 9, 1), (1, 5, 2), (1, 6, 3)] + [(2, p, p) for p in range(1, 13)] + [(3, 1, 1)])
    judged = qrels(spark, [(1, 6), (1, 5), (2, 11), (3, 8)])
    marked = ranking.mark_positives(ranked, judged)
    queries = ranking.positives_per_query(judged)
    value = ranking.mean_reciprocal_rank(marked, queries).first()["mrr_at_10"]
    assert value == pytest.approx((1 / 2 + 0 + 0) / 3)


def test_recall_counts_a_repeated_hit_once(spark):
    ranked = run(spark, [(1, 5, 1), (1, 5, 2), (1, 6, 60), (2, 7, 51)])
    judged = qrels(spark, [(1, 5), (1, 6), (2, 7)])
    out = ranking.recall(
        ranking.mark_positives(ranked, judged), ranking.positives_per_query(judged), [50, 200]
    ).first()
    assert out["recall_at_50"] == pytest.approx((0.5 + 0) / 2)
    assert out["recall_at_200"] == 1.0


def test_score_run_and_key_check(spark):
    ranked, judged = run(spark, [(1, 5, 1), (2, 5, 1)]), qrels(spark, [(1, 5), (3, 5)])
    assert {r["qid"] for r in ranking.unmatched_queries(ranked, judged).collect()} == {2, 3}
    with pytest.raises(ValueError, match="same queries"):
        ranking.score_run(ranked, judged, 10, [50])
    with pytest.raises(ValueError, match="cut at 20"):
        ranking.score_run(ranked, judged, 10, [50], depth=20, check_queries=False)
    out = {r["metric"]: r["value"] for r in ranking.score_run(ranked, judged, 10, [50], check_queries=False).collect()}
    assert out == {"mrr_at_10": 0.5, "recall_at_50": 0.5}


def test_probabilities_over_the_cut_do_not_overflow(spark):
    rows = [(1, p, p, 1000.0 - p) for p in range(1, 6)]
    df = spark.createDataFrame(rows, "qid bigint, pid bigint, rank int, score double")
    out = sorted(ranking.with_probabilities(df, 3).collect(), key=lambda r: r["rank"])
    weights = [math.exp(-i) for i in range(3)]
    assert [r["prob"] for r in out] == pytest.approx([w / sum(weights) for w in weights])
    assert ranking.with_probabilities(df, 500).count() == 5


def test_responses_order_by_score_then_pid(spark):
    rows = [("q", "t2", 2, 1, 0.5, 0.3), ("q", "t1", 1, 2, 0.5, 0.3), ("q", "t3", 3, 3, 0.9, 0.4)]
    df = spark.createDataFrame(rows, "query string, text string, pid bigint, rank int, score double, prob double")
    topk = ranking.responses(df).first()["topk"]
    assert [(e["pid"], e["rank"]) for e in topk] == [(3, 3), (1, 2), (2, 1)]


def test_merged_workers_must_not_repeat_a_query(spark):
    merged = ranking.merge_rankings([run(spark, [(1, 5, 1), (2, 5, 1)]), run(spark, [(2, 6, 1), (3, 6, 1)])])
    assert [r["qid"] for r in ranking.repeated_queries(merged).collect()] == [2]


def test_rerank_skips_queries_without_candidates(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "pid bigint, embedding array<float>")
    queries = spark.createDataFrame([(7, [0.2, 0.9])], "qid bigint, embedding array<float>")
    pairs = qrels(spark, [(7, 1), (7, 2), (8, 1)])
    out = {(r["qid"], r["pid"]): r["rank"] for r in ranking.rerank_candidates(pairs, queries, docs).collect()}
    assert out == {(7, 2): 1, (7, 1): 2}


def test_regroup_keeps_order_and_gaps(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["zz"])], "k bigint, bg array<string>")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "text string, embedding array<float>")
    out = {r["k"]: r["embeddings"] for r in ranking.regroup_embeddings(rows, "k", "bg", vectors).collect()}
    assert out == {1: [[2.0], [1.0], [2.0]], 2: [None]}


def test_repeated_questions_are_searched_once(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else "other") for i in range(9)], "k bigint, q string")
    seen = []

    def find(distinct):
        seen.append(distinct.count())
        return distinct.select("q", F.explode(F.array(F.lit(1), F.lit(2))).alias("pid"))

    out = ranking.answer_repeated_once(rows, "k", "q", find)
    assert seen == [2] and out.count() == 18


def test_stage_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 1.0)], "stage string, t double")
    assert {r["stage"]: r["share"] for r in ranking.stage_shares(df, "stage", "t").collect()} == {"a": 0.5, "b": 0.5}


def test_validation_ignores_foreign_judgements(spark):
    from lodestone.plans import jobs

    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "pid bigint, embedding array<float>")
    queries = spark.createDataFrame([(7, [0.2, 0.9]), (8, [1.0, 0.0])], "qid bigint, embedding array<float>")
    pairs = qrels(spark, [(7, 1), (7, 2), (8, 1)])
    out = jobs.validate_candidates(pairs, qrels(spark, [(7, 1), (99, 1)]), queries, docs)
    assert out.first()["mrr_at_10"] == 0.25  # query 7 at rank 2, query 8 has no positive


@pytest.mark.parametrize("name", ["mrr_at_10", "recall_at_k"])
def test_vectors_without_a_label_ask_too(spark, tmp_path, name):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], None if i % 10 == 9 else i % 3) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = db.execute(catalog.SQL[name]).fetchone()
    assert tuple(catalog.QUERIES[name](spark, str(tmp_path)).first()) == pytest.approx(want, abs=2e-6)
