import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_answer
from lodestone.operators import answers
from lodestone.plans import jobs

ROW = "k bigint, said string, gold array<string>"


def rows(spark, data):
    return spark.createDataFrame([(i, s, g) for i, (s, g) in enumerate(data)], ROW)


def test_exact_match(spark):
    df = rows(spark, [("The cat!", ["dog", "a cat"]), ("cats", ["cat"]), ("", ["the"])])
    hit = answers.exact_match(F.col("said"), F.col("gold"))
    assert [r[0] for r in df.orderBy("k").select(hit).collect()] == [True, False, True]


def brute_f1(left, right):
    common = sum((Counter(left) & Counter(right)).values())
    if not common:
        return 0.0
    p, r = common / len(left), common / len(right)
    return 2 * p * r / (p + r)


def test_token_and_char_f1_against_brute_force(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["red", "Red,", "blue", "the", "x", ""]) for _ in range(rng.randint(0, 7)))
    data = [(text(), [text() for _ in range(rng.randint(1, 3))]) for _ in range(60)]
    df = rows(spark, data)
    norm = {
        r["k"]: (r["s"], r["g"])
        for r in df.select(
            "k", normalize_answer(F.col("said")).alias("s"), F.transform("gold", normalize_answer).alias("g")
        ).collect()
    }
    token = {r["k"]: r["f1"] for r in answers.token_f1(df, "k", "said", "gold").collect()}
    char = {r["k"]: r["f1"] for r in answers.char_f1(df, "k", "said", "gold").collect()}
    assert len(token) == len(char) == 60
    for k, (s, golds) in norm.items():
        assert token[k] == pytest.approx(max(brute_f1(s.split(), g.split()) for g in golds))
        assert char[k] == pytest.approx(max(brute_f1(list(s), list(g)) for g in golds))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_helpers_against_the_table():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 15))] for _ in range(2))
        want = plain_lcs(a, b)
        assert answers.lcs_length(a, b) == want
        places = sorted(answers.lcs_places(a, b))
        assert len(places) == want and plain_lcs([a[p] for p in places], b) == want


def test_rouge_l_takes_the_best_answer_and_keeps_case(spark):
    df = rows(spark, [("the cat sat", ["The cat", "cat sat down"]), ("", ["x"]), ("a", ["b"])])
    got = [r[0] for r in df.orderBy("k").select(answers.rouge_l(F.col("said"), F.col("gold"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0]


def test_rouge_lsum_unions_lines(spark):
    df = spark.createDataFrame(
        [("w1 w2\nw3 w4", "w1 w3 w4 w5"), ("a", "b"), ("x y", "x y")], "said string, ref string"
    )
    got = [r[0] for r in df.select(answers.rouge_lsum(F.col("said"), F.col("ref"))).collect()]
    # the reference line shares w1 with one line and w3 w4 with the other
    assert got == [pytest.approx(2 * 0.75 * 0.75 / 1.5), 0.0, 1.0]


def test_fact_check_words_and_unknown_verdict(spark):
    df = spark.createDataFrame([("Yes!", "True"), ("it refutes", "False"), ("maybe", "True")], "said string, v string")
    scored = jobs.score_outputs(df.withColumn("k", F.monotonically_increasing_id()), "factkg", "k", "said", "v")
    assert sorted(r["score"] for r in scored.collect()) == [0.0, 1.0, 1.0]
    odd = spark.createDataFrame([("yes", "Perhaps")], "said string, v string")
    with pytest.raises(Exception, match="unknown verdict"):
        odd.select(answers.verdict_answers(F.col("v"))).collect()


def test_context_hits_treat_missing_text_as_no_hit(spark):
    df = spark.createDataFrame([(1, ["a cat", None, "dog"], ["Cat"])], "k bigint, ctxs array<string>, gold array<string>")
    out = answers.context_hits(df, ["k"], "ctxs", "gold")
    assert [r["hit"] for r in out.orderBy("pos").collect()] == [True, False, False]


@pytest.mark.parametrize("small_rows", [1000, 1])
def test_find_answers_against_brute_force(spark, small_rows):
    rng = random.Random(5)
    words = ["the"] * 6 + ["a", "b", "c", "é", "ab"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 20)))) for i in range(80)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(30)] + [(99, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    a = spark.createDataFrame(items, "item_id bigint, answer string")
    want = {(i, j) for i, x in items if x for j, t in docs if f" {x} " in f" {t} "}
    got = [(r["item_id"], r["doc_id"]) for r in answers.find_answers(d, a, small_rows, salts=3).collect()]
    # an answer without tokens is in every document: one row, without a document
    assert len(got) == len(set(got)) and set(got) == want | {(99, None)}


def test_rows_without_answers_score_zero(spark):
    data = [(1, "red", ["red"]), (2, "red", []), (3, "red", None), (4, "", ["x"])]
    df = spark.createDataFrame(data, "k int, said string, gold array<string>")
    for metric in (answers.token_f1, answers.char_f1):
        assert {r["k"]: r["f1"] for r in metric(df, "k", "said", "gold").collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert answers.truthful_scores(df.filter("k < 3"), "k", "said", "gold").first()["f1"] == 0.5


def test_bleu_of_equal_and_disjoint_texts(spark):
    pairs = lambda data: spark.createDataFrame([(i, *p) for i, p in enumerate(data)], "k int, h string, r string")
    same = answers.corpus_bleu(pairs([("a b c d e", "a b c d e")]), "k", "h", "r").first()
    assert same["bleu"] == pytest.approx(100)
    none = answers.corpus_bleu(pairs([("a b c d e", "v w x y z")]), "k", "h", "r").first()
    want = 100 * math.exp(sum(math.log(0.5**n / (6 - n)) for n in range(1, 5)) / 4)
    assert none["bleu"] == pytest.approx(want)
    short = answers.corpus_bleu(pairs([("a b c d", "a b c d e")]), "k", "h", "r").first()
    assert short["bleu"] == pytest.approx(100 * math.exp(1 - 5 / 4))
    clipped = answers.corpus_bleu(pairs([("a a a a a", "a b c d e")]), "k", "h", "r").first()
    assert clipped["matches_1"] == 1 and clipped["ngrams_1"] == 5


def test_places_of_a_common_subsequence():
    def table(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
            rows.append(row)
        return rows[-1][-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        places = sorted(answers.lcs_places(a, b))
        kept, rest = [a[i] for i in places], iter(b)
        assert len(places) == table(a, b) == answers.lcs_length(a, b) and all(x in rest for x in kept)


def test_rouge_n(spark):
    df = spark.createDataFrame([(1, "a b c", "A b d"), (2, "x", "y")], "k int, h string, r string")
    one = {r["k"]: r["f"] for r in answers.rouge_n(df, "k", "h", "r", 1).collect()}
    two = {r["k"]: r["f"] for r in answers.rouge_n(df, "k", "h", "r", 2).collect()}
    assert one == {1: pytest.approx(2 / 3), 2: 0.0} and two == {1: 0.5, 2: 0.0}


def test_metrics_do_not_depend_on_partitions(spark):
    data = [(f"red blue {i % 7}", [f"blue {i % 5}"]) for i in range(50)]
    df = rows(spark, data)
    score = lambda d: answers.truthful_scores(d, "k", "said", "gold").first()
    a, b = score(df.repartition(1)), score(df.repartition(6))
    assert a["f1"] == pytest.approx(b["f1"]) and a["rl"] == pytest.approx(b["rl"])
