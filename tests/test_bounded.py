"""Searches with bounds against brute force, on clustered and on shapeless data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import bounded, joins, ranking, search

from .test_search import grouped, table


def brute(queries, docs, k, exclude=False):
    out = {}
    for i, q in enumerate(queries.astype(float)):
        d = ((docs.astype(float) - q) ** 2).sum(axis=1)
        if exclude:
            d[i] = np.inf
        out[i] = [int(x) for x in np.lexsort((np.arange(len(docs)), d))[:k] if np.isfinite(d[x])]
    return out


@pytest.fixture(scope="module")
def islands():
    """Forty tight clusters, one of which holds a third of all vectors."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 12)) * 5
    own = np.r_[np.zeros(200, int), rng.integers(0, 40, 400)]
    docs = (middles[own] + 0.1 * rng.normal(size=(600, 12))).astype(np.float32)
    return docs, middles.astype(np.float32)


def stored_cells(spark, docs, centres, path):
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, embedding array<float>")
    assigned = search.nearest_cells(table(spark, docs, "pid"), centroids)
    search.write_cells(assigned, str(path))
    cells, sizes = search.read_cells(spark, str(path))
    return centroids, cells, sizes


@pytest.mark.parametrize("nprobe", [1, 5])
def test_probing_by_radii_is_exact_and_reads_few_cells(spark, islands, tmp_path, nprobe):
    docs, middles = islands
    centroids, cells, sizes = stored_cells(spark, docs, middles, tmp_path / "cells")
    queries = np.r_[docs[::40], np.zeros((1, 12), np.float32)]
    hits, visits = bounded.exact_probe_topk(table(spark, queries, "qid"), cells, centroids, sizes, 7, nprobe, visits=True)
    assert grouped(hits) == brute(queries, docs, 7)
    n = {r["qid"]: r["n_cells"] for r in visits.collect()}
    assert set(n) == set(range(len(queries)))
    assert np.mean([n[i] for i in range(len(queries) - 1)]) < 0.3 * len(middles)


def test_probing_shapeless_vectors_and_more_than_there_are(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs = rng.normal(size=(120, 16)).astype(np.float32)
    docs[100:] = docs[100]
    centroids, cells, sizes = stored_cells(spark, docs, docs[:9], tmp_path / "cells")
    q = table(spark, docs, "qid")
    found = bounded.exact_probe_topk(q, cells, centroids, sizes, 5, 2, exclude_self=True)
    assert grouped(found) == brute(docs, docs, 5, exclude=True)
    every = bounded.exact_probe_topk(q.filter("qid < 3"), cells, centroids, sizes, 500, 2)
    assert grouped(every) == {i: x for i, x in brute(docs, docs, 500).items() if i < 3}
    assert bounded.exact_probe_topk(q.limit(0), cells, centroids, sizes, 5).count() == 0
    none = bounded.exact_probe_topk(q, cells.limit(0), centroids.limit(0), sizes, 5)
    assert none.count() == 0


def test_groups_of_centres_give_the_nearest_cell(spark, islands):
    docs, middles = islands
    rng = np.random.default_rng(3)
    centres = np.repeat(middles, 10, axis=0) + 0.3 * rng.normal(size=(400, 12))
    centres[7] = centres[3]  # a tie goes to the smaller cell
    centres = centres.astype(np.float32)
    centroids = spark.createDataFrame([(5 * i, c.tolist()) for i, c in enumerate(centres)], "cell int, embedding array<float>")
    rows = bounded.nearest_cell_by_groups(table(spark, docs, "pid"), centroids).collect()
    near = brute(docs, centres, 1)
    assert {r["pid"]: r["cell"] for r in rows} == {i: 5 * x[0] for i, x in near.items()}
    assert np.mean([r["compared"] for r in rows]) < 0.4 * len(centres)


@pytest.mark.parametrize("bits, share", [(2, 1.0), (5, 0.8)])
def test_codes_with_errors_find_what_vectors_find(spark, islands, bits, share):
    docs, middles = islands
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(middles)], "cell int, embedding array<float>")
    assigned = search.nearest_cells(table(spark, docs, "pid"), centroids)
    book = search.train_codes(assigned, centroids, m=4, bits=bits, iterations=5)
    codes = bounded.with_code_errors(assigned, search.pq_encode(assigned, centroids, book), centroids, book)
    queries = table(spark, docs, "qid")
    want = grouped(search.probe_topk(queries, assigned, centroids, 6, 3, exclude_self=True))
    hits, scored = bounded.pq_exact_topk(
        queries, codes, table(spark, docs, "pid"), centroids, book, 6, 3, exclude_self=True, query_rows=100, doc_rows=64, rescored=True
    )
    assert grouped(hits) == want
    total = scored.agg(F.sum("n_scored") / F.sum("n_probed")).first()[0]
    assert total <= share


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_deep_lists(spark, islands, metric):
    docs, _ = islands
    q, d = table(spark, docs[:9], "qid"), table(spark, docs, "pid").repartition(7)
    for k in (1, 40, 450, 9999):
        hits, sent = bounded.deep_topk(q, d, k, metric, bins=2000, sent=True)
        assert grouped(hits) == grouped(search.exact_topk(q, d, k, metric))
        if k == 40:
            # far fewer than k from each of seven tasks; the hot cluster lies within few bins
            assert sent.count() < (9 * 7 * 40 if metric == "dot" else 9 * 600)
    assert grouped(bounded.deep_topk(q, d, 3, metric, exclude_self=True)) == grouped(search.exact_topk(q, d, 3, metric, exclude_self=True))
    assert bounded.deep_topk(q, d.limit(0), 3, metric).count() == 0
    assert bounded.deep_topk(q.limit(0), d, 3, metric).count() == 0


def token_table(spark, docs, key, per):
    """Consecutive vectors, ``per[i]`` of them for document i."""
    ends = np.cumsum(per)
    rows = [(i, j, docs[end - n + j].tolist()) for i, (n, end) in enumerate(zip(per, ends)) for j in range(n)]
    return spark.createDataFrame(rows, f"{key} bigint, pos int, embedding array<float>")


@pytest.mark.parametrize("save_k", [4, 500])
def test_late_interaction_by_bounds_scores_few_documents(spark, islands, save_k):
    docs, middles = islands
    order = np.argsort(search.goodness(docs, middles, "l2").argmax(axis=1), kind="stable")
    per = np.r_[np.full(90, 5), np.full(50, 3)]
    tokens = token_table(spark, docs[order], "pid", per)
    asked = token_table(spark, docs[::25] + 0.05, "qid", [3, 4, 5, 6, 6])
    centroids = spark.createDataFrame([(3 * i, c.tolist()) for i, c in enumerate(middles)], "cell int, embedding array<float>")
    pairs = spark.range(5).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(139).cast("long"))).alias("pid"))
    pairs = pairs.unionByName(pairs.filter("pid % 3 = 0"))
    want = ranking.late_interaction(pairs.distinct(), asked, tokens, doc_max_len=5, save_k=save_k)
    stored = storage.bucketed(ranking.document_rows(tokens, 5), "pid", 4)
    signatures = bounded.token_signatures(tokens, centroids, 5)
    hits, scored = bounded.bounded_late_interaction(
        pairs, asked, stored, signatures, centroids, doc_max_len=5, save_k=save_k, scored=True
    )
    assert grouped(hits) == grouped(want)
    met, known = scored.agg(F.sum("n_scored"), F.sum("n_candidates")).first()
    assert known == 5 * 140
    assert met < 0.35 * known if save_k < 5 else met <= known


def test_bounds_hold_and_edges_of_late_interaction(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(300, 9)).astype(np.float32)
    flat[:30] = flat[30]  # ties
    flat[40] = 0
    tokens, asked = token_table(spark, flat, "pid", [6] * 50), token_table(spark, flat[20:60], "qid", [10] * 4)
    centres = np.r_[flat[100:106], np.zeros((1, 9), np.float32)]
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, embedding array<float>")
    pairs = spark.range(4).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"))).alias("pid"))
    signatures = bounded.token_signatures(tokens, centroids)
    docs = storage.bucketed(ranking.document_rows(tokens), "pid", 3)
    queries = ranking.query_rows(asked)
    for length in (6, 180):
        bounds = bounded.score_bounds(pairs, queries, signatures, centroids, length)
        true = ranking.score_pairs(pairs, queries, ranking.document_rows(tokens), length)
        rows = bounds.join(true, ["qid", "pid"]).collect()
        assert len(rows) == 200 and all(r["bound"] >= r["score"] for r in rows)
        want = ranking.late_interaction(pairs, asked, tokens, doc_max_len=length, save_k=7)
        found = bounded.bounded_late_interaction(pairs, asked, docs, signatures, centroids, doc_max_len=length, save_k=7)
        assert grouped(found) == grouped(want)
    for none in ((pairs.limit(0), asked), (pairs, asked.limit(0))):
        assert bounded.bounded_late_interaction(*none, docs, signatures, centroids).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_table_in_buckets_stays_where_it_is(spark, how):
    right = spark.range(400).select(F.col("id").alias("pid"), F.concat(F.lit("text "), "id").alias("text"))
    hits = spark.range(3000).select(
        F.col("id").alias("qid"), F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 = 1 THEN null ELSE id % 500 END").alias("pid")
    )
    table = storage.bucketed(right, "pid", 6)
    joined = joins.stored_join(hits, table, "pid", [F.col("qid")], how, hot_rows=500)
    want = hits.join(right, "pid", how).select("qid", "pid", "text")
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, want.collect()))
    assert joined.count() == want.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = hits.join(table, "pid")._jdf.queryExecution().executedPlan().toString()
        plan = joins.stored_join(hits, table, "pid", [F.col("qid")], how, hot_rows=500)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one shuffle of the hits, none of the table
    assert plain.count("Exchange hashpartitioning(pid") == 1 and "Bucketed: true" in plain
    assert "Bucketed: true" in plan


def test_codes_that_tell_nothing_apart_keep_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    docs = rng.normal(size=(500, 8)).astype(np.float32)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(docs[:4])], "cell int, embedding array<float>")
    assigned = search.nearest_cells(table(spark, docs, "pid"), centroids)
    book = spark.createDataFrame([(j, c, [9.0 * c] * 4) for j in range(2) for c in range(2)], "part int, code int, embedding array<float>")
    codes = bounded.with_code_errors(assigned, search.pq_encode(assigned, centroids, book), centroids, book)
    kept = []
    monkeypatch.setattr(bounded, "stored", lambda df: kept.append(storage.stored(df)) or kept[-1])
    queries = table(spark, docs, "qid")
    want = grouped(search.probe_topk(queries, assigned, centroids, 5, 3, exclude_self=True))
    hits, scored = bounded.pq_exact_topk(queries, codes, table(spark, docs, "pid"), centroids, book, 5, 3, exclude_self=True, rescored=True)
    assert grouped(hits) == want
    assert scored.agg(F.sum("n_scored")).first()[0] > 500 * 100  # nearly all pairs of the three cells
    assert max(df.count() for df in kept) <= 500 * 3 * (5 + 1)
    again = queries.unionByName(queries.filter("qid = 7"))  # a query given twice: each row of it meets both
    hits = bounded.pq_exact_topk(again, codes, table(spark, docs, "pid"), centroids, book, 5, 3, exclude_self=True)
    found = [r["pid"] for r in hits.filter("qid = 7").orderBy("rank").collect()]
    assert found == [want[7][0]] * 4 + [want[7][1]]


def test_code_search_meets_every_pair_twice_at_most(spark, islands):
    """The bounds are searched once; the limits they give are stored before the second pass counts its queries."""
    docs, centres = islands
    centroids = table(spark, centres[:4], "cell").withColumn("cell", F.col("cell").cast("int"))
    assigned = search.nearest_cells(table(spark, docs[:200], "pid"), centroids)
    book = search.train_codes(assigned, centroids, m=2, bits=2, iterations=2)
    codes = bounded.with_code_errors(assigned, search.pq_encode(assigned, centroids, book), centroids, book)
    hits = bounded.pq_exact_topk(table(spark, docs[:200], "qid"), codes, table(spark, docs[:200], "pid"), centroids, book, 3, 2)
    assert hits._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
