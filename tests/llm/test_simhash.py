"""Fingerprints and components against every pair."""

import random
import re

import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, n=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    """Smallest index reachable from each."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], fingerprint(r["text"])) for r in docs.collect())
    ids = roots([f for _, f in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    want = [(d, f"{f:016x}", rows[i][0]) for (d, f), i in zip(rows, ids)]
    assert sorted(map(tuple, simhash.near_copies(docs).collect())) == want


@pytest.mark.parametrize("count", [3, 4, 5])
def test_links_lose_no_component(spark, count):
    rng = random.Random(count)
    prints = set()
    for _ in range(40):  # clusters that chain, far apart and near, one of them large
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 10, 120])):
            prints.add(at)
            for _ in range(rng.randint(1, 6)):
                at ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, 4, count).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    linked = {frozenset(p) for p in found}
    by_forest = roots(prints, lambda a, b: frozenset((a, b)) in linked)
    assert by_forest == roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_a_hot_meeting_place_gives_a_forest(spark):
    base = 0x0123456789ABCDEF
    df = spark.createDataFrame([(base ^ (a << 40) ^ b,) for a in range(8) for b in range(64)], "fingerprint long")
    rows = simhash.links(df, 4, 3).count()
    assert rows < 3 * 23 * 512


@pytest.mark.parametrize("count", [3, 5])
def test_full_places_are_cut_anew_and_lose_no_component(spark, count):
    rng = random.Random(count)
    family = rng.getrandbits(64)
    prints = {family ^ (rng.getrandbits(22) << 21) for _ in range(300)}  # alike in two of three segments
    for _ in range(30):
        at = family ^ (rng.getrandbits(43) if rng.random() < 0.7 else rng.getrandbits(64))
        for _ in range(8):
            prints.add(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    places = simhash.Places(4, count, 0)
    start = df.selectExpr("0L as place", "0 as path", "fingerprint")
    hot = {r["place"] for r in places.hot(start, 40, 10**6).collect()}
    sizes = {r["place"]: r["count"] for r in places.lookups(start).groupBy("place").count().collect()}
    assert hot and all(n <= 40 or place in hot for place, n in sizes.items())
    want = roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    for levels in (1, 2, 4):
        linked = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(df, 4, count, 40, levels).collect()}
        assert all(a.bit_count() <= 4 for a in (x ^ y for x, y in map(tuple, linked)))
        assert roots(prints, lambda a, b: frozenset((a, b)) in linked) == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (3, None)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "x long, y long")).collect()))
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_edges(spark):
    rows = [(None, None, 1), (7, "", 1), (8, " \t\n", 1), (3, "One", 1), (4, "one", 1), (4, "one", 1), (9, "w " * 300_000, 1)]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, 7), (7, 7), (8, 7), (3, 3), (4, 3), (9, 9)}
    assert len(got) == 7
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
