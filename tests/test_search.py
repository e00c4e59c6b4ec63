import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import ranking, search
from lodestone.plans import catalog


def table(spark, array, key):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(array)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    docs = rng.normal(size=(300, 16)).astype(np.float32)
    docs[200:300] = docs[200] + 0.001 * rng.normal(size=(100, 16))  # a third of all in one place
    queries = rng.normal(size=(25, 16)).astype(np.float32)
    queries[0] = docs[200]
    return queries, docs, table(spark, queries, "qid"), table(spark, docs, "pid").repartition(5)


def brute(queries, docs, k, metric):
    scores = search.goodness(queries.astype(float), docs.astype(float), metric)
    return {i: list(np.lexsort((np.arange(len(docs)), -row))[:k]) for i, row in enumerate(scores)}


def grouped(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["pid"])
    return out


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_exact_search_both_ways(data, metric):
    queries, docs, q, d = data
    want = brute(queries, docs, 7, metric)
    assert grouped(search.exact_topk(q, d, 7, metric)) == want
    assert grouped(search.exact_topk(q, d, 7, metric, broadcast_rows=3)) == want
    assert grouped(search.grid_topk(q, d, 7, metric, query_rows=6, doc_rows=40)) == want
    for rows in (5, 60):  # fewer and more than k
        assert grouped(search.exact_topk(q, d, 7, metric, warm_up_rows=rows)) == want


def test_ties_go_to_the_smaller_id(spark):
    d = table(spark, [[1, 0]] * 9, "pid").repartition(3)
    q = table(spark, [[1, 0]], "qid")
    assert grouped(search.exact_topk(q, d, 4)) == {0: [0, 1, 2, 3]}
    assert grouped(search.exact_topk(q, d, 4, exclude_self=True)) == {0: [1, 2, 3, 4]}


def test_fewer_documents_than_k(spark):
    q, d = table(spark, [[1, 0]], "qid"), table(spark, [[1, 0], [0, 1]], "pid")
    assert grouped(search.exact_topk(q, d, 5)) == {0: [0, 1]}


def test_probing_all_cells_is_exact_and_recall_grows(spark, data, tmp_path):
    queries, docs, q, d = data
    centroids = table(spark, docs[::20], "cell").withColumn("cell", F.col("cell").cast("int"))
    cells = search.write_cells(search.nearest_cells(d, centroids), str(tmp_path / "cells"))
    want = brute(queries, docs, 5, "l2")
    shares = []
    for nprobe in (1, 4, 15):
        got = grouped(search.probe_topk(q, cells, centroids, 5, nprobe))
        shares.append(np.mean([len(set(got.get(i, [])) & set(want[i])) / 5 for i in want]))
    assert shares[0] <= shares[1] <= shares[2] == 1.0


def test_large_centroid_table_takes_the_other_way(data, spark):
    _, docs, _, d = data
    centroids = table(spark, docs[::20], "cell").withColumn("cell", F.col("cell").cast("int"))
    near = search.nearest_cells(d, centroids, 2)
    other = search.nearest_cells(d, centroids, 2, table_rows=4)
    a = {(r["pid"], r["cell"]) for r in near.collect()}
    assert a == {(r["pid"], r["cell"]) for r in other.collect()} and len(a) == 600


def test_codes_rank_by_their_reconstruction(spark, data):
    queries, docs, q, d = data
    centroids = table(spark, docs[::30], "cell").withColumn("cell", F.col("cell").cast("int"))
    cells = search.nearest_cells(d, centroids)
    book = search.train_codes(cells, centroids, m=4, bits=3, seed=1, iterations=4)
    assert book.count() == 4 * 8
    codes = search.pq_encode(cells, centroids, book)
    centre = {r["cell"]: np.array(r["embedding"]) for r in centroids.collect()}
    words = {(r["part"], r["code"]): np.array(r["embedding"]) for r in book.collect()}
    rebuilt = np.zeros((300, 16))
    for r in codes.collect():
        gap = np.concatenate([words[(j, c)] for j, c in enumerate(r["codes"])])
        rebuilt[r["pid"]] = centre[r["cell"]] + gap
    hits = search.pq_topk(q, codes, centroids, book, 6, nprobe=10)
    want = -search.goodness(queries.astype(float), rebuilt, "l2")
    for r in hits.collect():
        assert abs(r["score"] - want[r["qid"], r["pid"]]) < 1e-6
    best = {i: np.sort(want[i])[:6] for i in range(25)}
    for i in range(25):
        got = sorted(r["score"] for r in hits.filter(F.col("qid") == i).collect())
        assert np.allclose(got, best[i], atol=1e-6)


def test_trained_codes_shrink_the_error(spark, data):
    _, docs, _, d = data
    centroids = table(spark, docs[:1], "cell").withColumn("cell", F.col("cell").cast("int"))
    cells = search.nearest_cells(d, centroids)

    def error(iterations):
        book = search.train_codes(cells, centroids, m=4, bits=3, seed=1, iterations=iterations)
        words = {(r["part"], r["code"]): np.array(r["embedding"]) for r in book.collect()}
        total = 0.0
        for r in search.pq_encode(cells, centroids, book).collect():
            gap = np.concatenate([words[(j, c)] for j, c in enumerate(r["codes"])])
            total += ((docs[r["pid"]] - docs[0] - gap) ** 2).sum()
        return total

    assert error(5) < error(0)


def test_trained_cells_cover_the_table(spark, data):
    cells = search.train_cells(data[3], nlist=4, seed=1, iterations=3)
    assert cells.count() == 4 and len(cells.first()["embedding"]) == 16


def test_worked_example_finds_the_fifth_passage(spark):
    passages = table(spark, [[1, 0, 0], [0, 1, 0], [0.5, 0.5, 0], [0, 0.2, 0.1], [0, 0.3, 0.9]], "pid")
    hit = search.exact_topk(table(spark, [[0.1, 0.1, 1.0]], "qid"), passages, 1).first()
    assert hit["pid"] == 4 and hit["rank"] == 1


def test_vector_expressions(value):
    a, b = (F.array(*[F.lit(x) for x in v]).cast("array<float>") for v in ([3, 4], [1, 2]))
    assert value(vectors.dot(a, b)) == 11.0
    assert value(vectors.squared_distance(a, b)) == 8.0
    assert value(vectors.normalized(a)) == [0.6, 0.8]


def tokens(spark, rows, key):
    flat = [(k, i, [float(x) for x in v]) for k, vs in rows for i, v in enumerate(vs)]
    return spark.createDataFrame(flat, f"{key} bigint, pos int, embedding array<float>")


def test_late_interaction_floors_short_documents_only(spark):
    query = tokens(spark, [(7, [[1.0, 0.0]])], "qid")
    docs = tokens(spark, [(0, [[-1.0, 0.0]]), (1, [[-1.0, 0.0], [-2.0, 0.0]]), (2, [[0.5, 0], [0, 9], [9, 0]])], "pid")
    pairs = spark.createDataFrame([(7, 0), (7, 1), (7, 2)], "qid bigint, pid bigint")
    out = {r["pid"]: (r["rank"], r["score"]) for r in ranking.late_interaction(pairs, query, docs, doc_max_len=2).collect()}
    # 0 is short: padded to 0. 1 is full: no floor. 2 is cut after two tokens.
    assert out == {2: (1, 0.5), 0: (2, 0.0), 1: (3, -1.0)}


def test_late_interaction_against_brute_force(spark):
    rng = np.random.default_rng(8)
    q = [(i, rng.normal(size=(rng.integers(1, 5), 6))) for i in range(6)]
    d = [(i, rng.normal(size=(rng.integers(1, 9), 6))) for i in range(20)]
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(20)], "qid bigint, pid bigint")
    got = ranking.late_interaction(pairs, tokens(spark, q, "qid"), tokens(spark, d, "pid"), doc_max_len=8, save_k=20)
    want = {}
    for a, x in q:
        for b, y in d:
            best = (x.astype(np.float32).astype(float) @ y.astype(np.float32).astype(float).T).max(axis=1)
            want[a, b] = (np.maximum(best, 0) if len(y) < 8 else best).sum()
    rows = got.collect()
    assert len(rows) == 120
    for r in rows:
        assert abs(r["score"] - want[r["qid"], r["pid"]]) < 1e-6


def test_last_token_and_offsets(spark):
    t = tokens(spark, [(3, [[1, 1], [2, 2]]), (5, [[3, 3]]), (900, [[4, 4], [5, 5], [6, 6]])], "pid")
    assert {r["pid"]: r["embedding"] for r in ranking.last_token_vector(t).collect()} == {
        3: [2, 2], 5: [3, 3], 900: [6, 6]
    }
    out = {r["pid"]: (r["length"], r["start"]) for r in ranking.document_offsets(t).collect()}
    assert out == {3: (2, 0), 5: (1, 2), 900: (3, 3)}
    places = {r["position"]: r["pid"] for r in ranking.token_positions(t).collect()}
    assert places == {0: 3, 1: 3, 2: 5, 3: 900, 4: 900, 5: 900}


def test_distances_survive_a_large_offset(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)) * 1e-3 + 30_000.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "qid long, embedding array<double>")
    docs = df.withColumnRenamed("qid", "pid")
    want = {}
    for i, q in enumerate(base):
        d = ((base - q) ** 2).sum(axis=1)
        want[i] = sorted((d[j], j) for j in range(40))[:5]
    for how in ({}, {"broadcast_rows": 3}, {"warm_up_rows": 10}):
        got = {}
        for r in search.exact_topk(df, docs, 5, "l2", **how).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["score"], r["pid"]))
        for i, rows in got.items():
            assert [x[2] for x in sorted(rows)] == [j for _, j in want[i]]
            assert [x[1] for x in sorted(rows)] == pytest.approx([d for d, _ in want[i]], rel=1e-9)


def test_zero_null_and_uneven_vectors(spark):
    rows = [(i, [0.0, 0.0] if i < 2 else [1.0, float(i)]) for i in range(20)]
    docs = spark.createDataFrame(rows, "pid long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 5.0])], "qid long, embedding array<double>")
    hits = search.exact_topk(queries, docs, 5, "cosine").collect()
    assert [r["qid"] for r in hits] == [1] * 5 and all(r["pid"] > 1 for r in hits)
    for bad, message in (([(1, None)], "null"), ([(1, [1.0]), (2, [1.0, 2.0])], "differ in width")):
        odd = spark.createDataFrame(bad, "pid long, embedding array<double>").coalesce(1)
        with pytest.raises(Exception, match=message):
            search.exact_topk(queries, odd, 5).collect()


def test_probing_reads_the_probed_cells_only(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 10 * (i % 8)).tolist()) for i in range(400)]
    docs = spark.createDataFrame(rows, "pid long, embedding array<double>")
    centroids = spark.createDataFrame([(c, [10.0 * c] * 4) for c in range(8)], "cell int, embedding array<double>")
    search.write_cells(search.nearest_cells(docs, centroids), str(tmp_path / "cells"))
    cells, counts = search.read_cells(spark, str(tmp_path / "cells"))
    queries = spark.createDataFrame([(900, [20.1] * 4)], "qid long, embedding array<double>")
    probes = search.nearest_cells(queries, centroids, 2)
    plan = search.probed(cells, probes)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell_group" in plan and "In(cell" in plan
    assert search.probed(cells, probes).count() == 100
    got = [r["pid"] for r in search.probe_topk(queries, cells, centroids, 7, 2, counts=counts).orderBy("rank").collect()]
    near = sorted((float(((np.array(v) - 20.1) ** 2).sum()), i) for i, v in rows if i % 8 in (1, 2, 3))
    assert got == [i for _, i in near[:7]]


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_long_lists_are_cut_once_a_query(monkeypatch, metric):
    rng = np.random.default_rng(5)
    docs = rng.normal(size=(400, 8))
    docs[300:] = docs[:100]  # ties go to the smaller id
    ids, sorted_rows, best = np.arange(400), [], search._best
    monkeypatch.setattr(search, "BLOCK_CELLS", 4000)
    monkeypatch.setattr(search, "_best", lambda q, p, s, k: sorted_rows.append(len(q)) or best(q, p, s, k))
    q, p, s = search.best_vectors(ids, docs, ids, docs, 150, metric, True)
    assert sum(sorted_rows) < 400 * 150 * 1.1  # not anew with every block of documents
    scores = search.goodness(docs, docs, metric)
    np.fill_diagonal(scores, -np.inf)
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -np.round(scores, 9)), axis=1)[:, :150]
    assert np.array_equal(q, np.repeat(ids, 150)) and np.array_equal(p.reshape(400, 150), want)
    twice = search.best_vectors(np.r_[ids, ids], np.r_[docs, docs], ids, docs, 150, metric, True)
    assert np.array_equal(np.unique(twice[0], return_counts=True)[1], np.full(400, 150))


def test_hits_beyond_a_limit_are_not_sent(spark):
    rng = np.random.default_rng(6)
    docs = rng.normal(size=(90, 8)).astype(np.float32)
    near = np.sort(((docs[:, None] - docs[None]) ** 2).sum(axis=2), axis=1)[:, 3] ** 0.5
    limits = spark.createDataFrame([(i, float(x) * (1 + 1e-6)) for i, x in enumerate(near)], "qid bigint, limit double")
    q = table(spark, docs, "qid").join(limits, "qid")
    d = table(spark, docs, "pid")
    assert grouped(search.grid_topk(q, d, 9, "l2")) == grouped(search.exact_topk(q, d, 4, "l2"))


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
@pytest.mark.parametrize("order", ["mixed", "rising"])
def test_a_few_hits_of_a_wide_block(monkeypatch, metric, order):
    """The k-th score among some columns is only a first limit, ties and documents in order of their score included."""
    rng = np.random.default_rng(3)
    docs, queries = (np.round(4 * rng.normal(size=(n, 4))) / 4 for n in (900, 40))  # quarters: sums are exact
    docs[600:] = docs[:300]
    if order == "rising":
        docs = docs[np.argsort(search.goodness(queries[:1], docs, metric)[0])]
        docs[::9] = docs[0]
    scores = -((queries[:, None] - docs) ** 2).sum(axis=2) if metric == "l2" else search.goodness(queries, docs, metric)
    monkeypatch.setattr(search, "SOME_COLUMNS", 50)
    for cells in (search.BLOCK_CELLS, 2000):
        monkeypatch.setattr(search, "BLOCK_CELLS", cells)
        q, p, _ = search.best_vectors(np.arange(40), queries, np.arange(900), docs, 5, metric, False)
        for i, row in enumerate(scores):
            assert p[q == i].tolist() == np.lexsort((np.arange(900), -row))[:5].tolist()


def test_merged_rankings_are_searched_once(spark):
    plan = catalog.QUERIES["merge_rankings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapCoGroupsInArrow" not in plan
