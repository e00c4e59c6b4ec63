"""Removed bytes against a dictionary of all windows, and the index against plain search."""

import random

import numpy as np
import pytest

from lodestone.llm.repeats import LEAST, RunIndex, without_repeats


def brute(rows, length):
    order = sorted({(d, t or b"") for d, t in rows}, key=lambda r: (LEAST if r[0] is None else r[0]))
    first, out = {}, {}
    for d, t in order:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in first:
                gone[i : i + length] = True
            first.setdefault(w, (d, i))
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d, t] = (len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes())
    return sorted(((d, *out[d, t or b""]) for d, t in rows), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, None if t is None else t.decode(), 5) for d, t in rows], "doc_id long, text string, bucket int")
    got = without_repeats(df.repartition(4), **how).collect()
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr)


def corpus(seed, n=60, alphabet=b"ab"):
    rng = random.Random(seed)
    letters = lambda k: bytes(rng.choice(alphabet) for _ in range(k))
    passages = [letters(rng.randint(5, 80)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [letters(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), letters(rng.randint(0, 15))]
        text = b"".join(parts)
        if texts and rng.random() < 0.3:  # a near copy
            text = rng.choice(texts)
            at = rng.randint(0, len(text))
            text = text[:at] + letters(1) + text[at + rng.randint(0, 2) :]
        texts.append(text)
    return [(i * 3 - 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(5))
def test_against_all_windows(spark, seed):
    rows = corpus(seed, alphabet=b"ab" if seed % 2 else b"abcdefgh ")
    rows += [(500, None), (501, b""), (None, rows[3][1]), rows[4], rows[4]]
    assert run(spark, rows, length=20, gram=7, bucket_bytes=500) == brute(rows, 20)


def test_hot_anchors_are_split(spark):
    rng = random.Random(8)
    phrase = b"the same twelve "
    rows = [(i, bytes(rng.choice(b"abcdef") for _ in range(30)) + phrase + bytes(rng.choice(b"ab") for _ in range(30))) for i in range(300)]
    assert run(spark, rows, length=24, gram=9, bucket_bytes=2000, hot_share=2000) == brute(rows, 24)


def test_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"].encode()) for r in docs.collect()]
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in without_repeats(docs).collect()), key=repr)
    want = brute(rows, 100)
    assert got == want and sum(r[2] for r in want) > 1000


def test_a_run_of_one_letter_and_a_long_text(spark):
    rows = [(1, b"a" * 3000), (2, bytes(random.Random(1).choice(b"xyz") for _ in range(300_000))), (3, b"a" * 99)]
    assert run(spark, rows) == brute(rows, 100)
    assert run(spark, []) == []


def test_index_finds_shared_lengths():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] * 2
    index = RunIndex(texts)
    assert index.runs < len(index.data)
    matched, earlier = index.statistics()
    order = index._suffixes()
    suffix = lambda i: texts[index.text_of[i]][i - index.starts[index.text_of[i]] :]
    for a, b in zip(order, order[1:]):
        x, y = suffix(a), suffix(b)
        assert (x, index.text_of[a]) < (y, index.text_of[b])
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert matched[b] == n and earlier[b] == a
