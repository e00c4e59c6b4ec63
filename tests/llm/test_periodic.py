"""Periodic runs against a scan of every period."""

import random
import time
import zlib

import numpy as np
import pytest

from lodestone.llm.periodic import Catchers, periodic_runs, runs_of
from lodestone.llm.queries import QUERIES


def brute(words):
    """Every run, by trying every period on the whole text."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        s = 0
        for t in range(n - q + 1):
            if t == n - q or words[t] != words[t + q]:
                if t + q - s >= max(24, 3 * q):
                    found.setdefault((s, t + q), q)
                s = t + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    words = []
    while len(words) < rng.choice([10, 30, 100, 400]):
        kind = rng.random()
        if kind < 0.5:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
            words += (unit * rng.randint(2, 12))[: rng.randint(1, 200)]
        else:
            words += [rng.choice("abcdefghij") for _ in range(rng.randint(1, 20))]
    return words


def test_against_every_period():
    rng = random.Random(1)
    some = 0
    for _ in range(300):
        words = made(rng)
        want = brute(words)
        some += len(want)
        assert runs_of([w.encode() for w in words]) == want
    assert some > 200


@pytest.mark.parametrize("step", [1, 7, 64])
def test_words_appended_a_few_at_a_time(step):
    rng = random.Random(step)
    for _ in range(15):
        words = made(rng)
        items = np.array([ord(w) for w in words])
        catchers = Catchers()
        for at in range(0, len(items), step):
            catchers.append(items[at : at + step])
            if rng.random() < 0.05:
                assert catchers.runs() == brute(words[: at + step])
        assert catchers.runs() == brute(words)


def test_structured_words():
    fibonacci, last = "ab", "a"
    while len(fibonacci) < 2000:
        fibonacci, last = fibonacci + last, fibonacci
    thue = "a"
    while len(thue) < 2000:
        thue += thue.translate(str.maketrans("ab", "ba"))
    for text in (fibonacci[:1500], thue[:1200], "a" * 700 + "b" + "a" * 700, ("a" * 40 + "b") * 30, thue[:1200] * 3):
        assert runs_of([c.encode() for c in text]) == brute(text)


def test_long_texts_take_nearly_linear_time():
    start = time.time()
    n = 400_000
    assert runs_of([b"a"] * n) == [(0, n, 1)]
    assert runs_of([b"a"] * n + [b"b"] + [b"a"] * n) == [(0, n, 1), (n + 1, n, 1)]
    assert runs_of([b"%d" % (i % 1000) for i in range(n)]) == [(0, n, 1000)]
    assert time.time() - start < 60


def test_rows(spark):
    line = " ".join(["x"] * 30)
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, line),
        (4, line),
        (5, "a b " * 12 + "c"),
        (None, "p q\n" * 15),
        (6, "one two three"),
    ]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, length int, runs string")
    got = sorted(periodic_runs(docs.repartition(3)).collect(), key=repr)
    assert len(got) == len(rows)
    by = {(r["doc_id"], bytes(r["collapsed"]).decode()): r for r in got}
    assert by[4, "x"]["runs"] == [(0, 30, 1)] and by[4, "x"]["exponent_milli"] == 30_000
    assert by[None, "p q"]["runs"] == [(0, 30, 2)]
    # 24 words of one kind are needed, 12 are not enough
    assert by[5, ("a b " * 12 + "c")]["runs"] == []
    for i in (1, 2, 3):
        assert by[i, ""]["runs"] == [] and by[i, ""]["start"] is None
    assert periodic_runs(docs.limit(0)).count() == 0


def rewritten(doc, text):
    """The words of a document as the query's contract makes them."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()), len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query(spark):
    """The whole small table; texts of up to 1,500 words against every period."""
    from hashlib import sha256

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        words = rewritten(r["doc_id"], texts[r["doc_id"]])
        want = brute(words) if len(words) <= 1500 else runs_of(words)
        some += len(want)
        assert r["n_runs"] == len(want)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        assert r["runs_sha256"] == sha256(listed.encode()).hexdigest()
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["collapsed_sha256"] == sha256(left).hexdigest()
        if want:
            best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None
    assert some >= 5
