"""Language models against dictionaries of counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyarrow import fs

from lodestone.llm import language_model
from lodestone.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))), None]


def kneser_ney(texts):
    """(probability of a word after another, base log10 of a word, counts)."""
    pairs, words = Counter(), Counter()
    for text in texts:
        last = "start"
        for t in tokens(text):
            pairs[last, t] += 1
            words[t] += 1
            last = t
    before, after, total = Counter(), defaultdict(Counter), Counter()
    for (v, w), c in pairs.items():
        before[w] += 1
        after[v][min(c, 3)] += 1
        total[v] += c
    of_pairs = language_model.discounts(*[sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    of_words = language_model.discounts(*[sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    n, size = sum(words.values()), len(words)

    def cut(c, taken):
        return max(0.0, c - taken[min(c, 3) - 1]) if c else 0.0

    mass = sum(of_words[min(c, 3) - 1] for c in before.values()) / len(pairs) if pairs else 1.0

    def alone(w):
        return mass / (size + 1) + cut(before[w], of_words) / max(1, len(pairs))

    def chance(v, w):
        if not total[v]:
            return alone(w)
        rest = sum(of_pairs[k - 1] * c for k, c in after[v].items()) / total[v]
        return cut(pairs[v, w], of_pairs) / total[v] + rest * alone(w)

    return chance, lambda w: math.log10((words[w] + 0.1) / (n + 0.1 * (size + 1))), words


def expected(texts, chance, base):
    for text in texts:
        last, a, b = "start", 0.0, 0.0
        for t in tokens(text):
            a, b, last = a + math.log10(chance(last, t)), b + base(t), t
        yield a, b


def corpus(rng, n):
    made = [" ".join(rng.choice(["a", "b", "C", "d", "é", "the", "zz%d" % rng.randint(0, 40)]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*made, None, "", " \t", "The the THE", "the the the", "x" * 5000]


def frame(spark, texts):
    rows = [(i if i % 9 else None, t, 5, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, shard string").repartition(5)


def compare(spark, seen, asked):
    model = language_model.train(frame(spark, seen))
    chance, base, words = kneser_ney(seen)
    rows = language_model.score(frame(spark, asked), model).collect()
    got = sorted((r["n_tokens"], r["n_known"], round(r["score"], 6), round(r["base_score"], 6)) for r in rows)
    want = sorted(
        (len(tokens(t)), sum(words[w] > 0 for w in tokens(t)), round(a, 6), round(b, 6))
        for t, (a, b) in zip(asked, expected(asked, chance, base))
    )
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=2e-6)
    assert {r["train_tokens"] for r in rows} <= {sum(words.values())}
    return model, chance, words


def test_against_dictionaries(spark):
    rng = random.Random(4)
    seen = corpus(rng, 80)
    asked = [*corpus(rng, 30), "never seen words here", *seen]
    model, chance, words = compare(spark, seen, asked)
    assert model.words == len(words)
    for v in ("start", b"a", b"the", b"unseen"):
        assert sum(chance(v, w) for w in words) + chance(v, "nothing like it") == pytest.approx(1)


def test_pairs_held_by_a_task_are_bounded(spark, monkeypatch):
    rng = random.Random(5)
    texts = corpus(rng, 60)
    whole = list(language_model.token_pairs([(t or "").encode() for t in texts]))
    assert sum(len(left) for left, _, _ in whole) == sum(len(tokens(t)) for t in texts)
    monkeypatch.setattr(language_model, "MOST_PAIRS", 50)
    monkeypatch.setattr(language_model, "blocks", lambda texts: language_model_blocks(texts, 200))
    monkeypatch.setattr(language_model, "MOST_TOKENS", 64)
    compare(spark, texts, texts)


language_model_blocks = language_model.blocks


def test_small_tables(spark):
    compare(spark, [], ["a b", None])
    compare(spark, ["a"], [])
    compare(spark, [None], ["a b", "", None])
    compare(spark, ["a b"] * 7, ["a b", "b a"])


def test_counts_above_a_byte():
    x = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (language_model._unpacked(language_model._packed(x), len(x)) == x).all()


def test_copies_from_other_storage(tmp_path):
    (tmp_path / "part").write_bytes(np.arange(1000, dtype=np.uint64).tobytes())
    other = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    for _ in range(2):
        assert (language_model.mapped(other, "part", np.uint64) == np.arange(1000)).all()
    assert len(language_model.mapped(other, "none", np.uint64)) == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    chance, base, words = kneser_ney([t for d, t in texts.items() if not held[d]])
    rows = {r["doc_id"]: r for r in QUERIES["op13_lm_scores"](spark, folder).collect()}
    assert set(rows) == set(texts)
    for d, (a, b) in zip(texts, expected(texts.values(), chance, base)):
        r = rows[d]
        assert (r["held_out"], r["train_tokens"]) == (held[d], sum(words.values()))
        assert r["score"] == pytest.approx(a, rel=1e-9) and r["base_score"] == pytest.approx(b, rel=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert len(out) > 50 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
