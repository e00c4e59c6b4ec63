"""Hit words against a plain search of every window."""

import random
import re

from lodestone.llm.decontamination import contamination, item_blocks, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, ids = words(text), set(), set()
        for item, passage in items:
            own = words(passage)
            n = min(10, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out.append((doc_id, len(ws), sorted(hit), sorted(ids)))
    return sorted(out, key=repr)


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(d, i, **how).collect()
    return sorted([(r["doc_id"], r["n_words"], list(r["hits"]), list(r["items"])) for r in rows], key=repr)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "é", "D9", "ß", "x"][: rng.randint(2, 7)]
    gap = [" ", "-", "\n", ", "]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(gap) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(5)] + [(77, None), (78, "!!")]
    docs = []
    for i in range(25):
        t = text(rng.randint(0, 40))
        if rng.random() < 0.6:
            passage = rng.choice(items)[1] or ""
            cut = rng.randint(0, 6)
            t += passage[cut:] + text(rng.randint(0, 5)) + passage
        docs.append((i // 2, t))
    return [*docs, (3, None), (None, items[0][1]), *docs[:4]], items


def test_against_brute_force(spark):
    for seed in range(12):
        docs, items = sample(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = sample(99)
    assert run(spark, docs, items, block_bytes=30) == brute(docs, items)


def test_long_texts_and_no_items(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    long = "filler " * 300_000 + passage + " tail" * 10
    (row,) = run(spark, [(1, long)], [(1, passage)])
    assert row[2] == list(range(300_000, 300_030)) and row[3] == ["1"]
    assert run(spark, [(1, "a b")], []) == [(1, 2, [], [])]
    assert run(spark, [], [(1, passage)]) == []


def test_items_that_repeat_fill_no_block(spark):
    docs, items = sample(5)
    assert run(spark, docs, items * 40, block_bytes=60) == brute(docs, items)
    many = spark.createDataFrame(items * 40, "item_id long, text string")
    number, index_of = item_blocks(many, 10, 5, 60)
    assert sum(len(index_of(b).ids) for b in range(number)) == len({(i, t or "") for i, t in items})


def test_rows_without_a_passage_stay_whole(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "x " + passage, "c"), (None, "clean text", "d"), (None, "clean text", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, passage), (10, None), (None, "")], "item_id long, text string")
    got = sorted(map(tuple, without_contaminated(docs, items).collect()), key=repr)
    assert got == sorted((r for r in rows if r[0] != 3), key=repr)
    assert without_contaminated(docs, items.limit(0)).count() == len(rows)
    assert without_contaminated(docs.limit(0), items).count() == 0
