"""Whitening against a full eigen-decomposition and whole numbers of any size."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import whitening
from lodestone.llm.queries import QUERIES


def expected(rows, components=4):
    """{vec_id: (deviation, whitened)} of kept rows, and the explained shares."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = {i: tuple(math.floor(256 * c) + 0 for c in v) for i, v in kept}
    fit = sorted(set(xs.values()))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[float(c - Fraction(s, n)) for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in xs.items():
        row = np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums)])
        out[i] = sum((n * c - s) ** 2 for c, s in zip(x, sums)), row @ vectors / np.sqrt(values)
    return out, values / np.trace(centred.T @ centred / n), n


def check(spark, rows, got, components=4):
    want, explained, n = expected(rows, components)
    assert len(got) == len(want) * components
    white = {i: np.zeros(components) for i in want}
    for r in got:
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]][0]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-10)
        assert r["identity_error"] < 1e-9
        white[r["vec_id"]][r["component"] - 1] = r["whitened"]
    a = np.array([white[i] for i in want])
    b = np.array([want[i][1] for i in want])
    signs = np.sign((a * b).sum(axis=0))
    assert np.abs(a - b * signs).max() < 1e-7


def frame(spark, rows):
    kind = "vec_id long, embedding array<float>, n string, x int, component int"
    return spark.createDataFrame([(i, v, "n", 1, 2) for i, v in rows], kind).repartition(4)


@pytest.mark.parametrize("shape", [(300, 24), (6, 9), (40, 4)])
def test_against_eigenvectors(spark, shape):
    rng = np.random.default_rng(shape[0])
    data = rng.standard_normal(shape) * np.linspace(3, 0.5, shape[1])
    rows = list(enumerate(data.astype(np.float32).tolist()))
    copies = [(1000 + i, rows[i % 3][1]) for i in range(30)]
    rows += copies
    check(spark, rows, whitening.whiten(frame(spark, rows)).collect())


def test_repeated_eigenvalues(spark):
    """Two directions of the same spread: a Krylov space of one vector has only one of them."""
    rows = []
    for d in range(5):
        for s in (-1, 1):
            v = [0.0] * 5
            v[d] = s * (4.0 if d < 2 else 1.0 + d)
            rows.append((len(rows), v))
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 40 and {round(r["identity_error"], 9) for r in got} == {0.0}
    shares = sorted({(r["component"], round(r["explained"], 9)) for r in got})
    spreads = sorted([16.0, 16.0, 9.0, 16.0, 25.0], reverse=True)
    assert [x for _, x in shares] == [round(s / sum(spreads), 9) for s in spreads[:4]]


def test_rows_that_are_left_out(spark):
    rng = np.random.default_rng(7)
    good = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 5)).astype(np.float32))]
    bad = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [float("nan")] * 5), (53, [0.0, float("inf"), 0.0, 0.0, 0.0]), (54, [])]
    short = [(55, [1.0, 2.0])]
    check(spark, good, whitening.whiten(frame(spark, good + bad + short)).collect())
    again = whitening.whiten(frame(spark, [(None, v) for _, v in good])).collect()
    assert len(again) == 160 and {r["vec_id"] for r in again} == {None}


def test_few_directions(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert len(got) == 9 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_deviation_beyond_64_bits(spark):
    rows = [(0, [1e7, 0.0]), (1, [-1e7, 1.0]), (2, [5.0, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    n, xs = 3, [(2560000000, 0), (-2560000000, 256), (1280, 512)]
    sums = [sum(c) for c in zip(*xs)]
    for i, x in enumerate(xs):
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert got[i] == (exact if exact < 1 << 63 else None)
    assert None in got.values()


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(spark, rows, QUERIES["op12_whitening"](spark, folder).collect())
