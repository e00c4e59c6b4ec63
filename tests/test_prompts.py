import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import prompts
from lodestone.plans import jobs


def test_attach_follows_the_order_asked_for(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k bigint")
    hits = spark.createDataFrame([(k, r, f"t{k}{r}") for k in (1, 2) for r in (1, 2, 3)], "k bigint, rank int, text string")
    out = {r["k"]: r["background"] for r in prompts.attach_background(rows, "k", hits, [3, 1]).collect()}
    assert out == {1: ["t13", "t11"], 2: ["t23", "t21"]}
    with pytest.raises(Exception, match="misses a rank"):
        prompts.attach_background(rows, "k", hits.filter("k = 1"), [1]).collect()


def test_prompts_with_and_without_retrieval(value):
    task = F.lit("open_qa")
    bg = F.array(F.lit("one"), F.lit("two "))
    plain = prompts.example_prompt(task, F.lit("why"), bg)
    assert value(plain) == "Background: one two\n\nQuestion: why?"
    short = prompts.example_prompt(task, F.lit("why"), bg, embed_len=2)
    assert value(short) == "Background: <DOC> <DOC> <DOC> <DOC>\n\nQuestion: why?"
    claim = prompts.example_prompt(F.lit("fact_checking"), F.lit("so "))
    assert value(claim) == "Claim: so"
    none = F.array().cast("array<string>")
    full = prompts.full_prompt(prompts.start_prompt(task, False), none, prompts.example_prompt(task, F.lit("why")))
    assert value(full) == "[INST] Answer the questions:\n\nQuestion: why? [/INST] The answer is:"
    shots = prompts.full_prompt(F.lit("s"), F.array(F.lit("x"), F.lit("y")), F.lit("z"), as_chat=False)
    assert value(shots) == "s\n\nx\n\ny\n\nz"


def test_backgrounds_of_a_row_come_before_those_of_its_shots(value):
    both = prompts.all_backgrounds(F.array(F.lit("own")), F.array(F.lit("s1"), F.lit("s2")))
    assert value(both) == ["own", "s1", "s2"]


def test_shots_shrink_to_fit(spark):
    dev = spark.createDataFrame([(i, "s" if i < 3 else "t", "w " * 10) for i in range(8)], "k int, subject string, q string")
    shots = prompts.first_shots(dev, "k", F.trim("q"), 5, "subject")
    assert {r["subject"]: len(r["shots"]) for r in shots.collect()} == {"s": 3, "t": 5}
    assert {r["subject"] for r in prompts.subjects_without_exactly(dev, "subject").collect()} == {"s"}
    rows = spark.createDataFrame([(1, "s", 5), (2, "t", 5), (3, "t", 200), (4, "none", 5)], "k int, subject string, n int")
    example = F.array_join(F.array_repeat(F.lit("w"), F.col("n")), " ")
    out = prompts.n_shot_prompts(rows, "k", F.lit("go"), example, shots, "subject", limit=46, as_chat=False)
    got = {r["k"]: r for r in out.collect()}
    # go + 5 words leave room for 40 of the tens: four shots at most
    assert {k: r["n_shot"] for k, r in got.items()} == {1: 3, 2: 4, 3: 0, 4: 0}
    assert got[4]["prompt"] == "go\n\nw w w w w"
    assert len(got[2]["prompt"].split()) == 46


def test_shots_without_a_subject(spark):
    dev = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "k int, q string")
    shots = prompts.first_shots(dev, "k", F.col("q"), 2)
    out = prompts.n_shot_prompts(spark.range(1), "id", F.lit("go"), F.lit("z"), shots, as_chat=False).first()
    assert out["prompt"] == "go\n\nq0\n\nq1\n\nz"


DOCS = [(0, "apple apple banana"), (1, "banana cherry"), (2, "x y"), (3, "cherry cherry date date")]


def test_tfidf_against_brute_force(spark):
    df = spark.createDataFrame(DOCS, "k int, text string")
    bags = {k: Counter(w for w in t.split() if len(w) > 1) for k, t in DOCS}
    freq = Counter(w for b in bags.values() for w in b)
    raw = {k: {w: n * (math.log(5 / (1 + freq[w])) + 1) for w, n in b.items()} for k, b in bags.items()}
    got = {(r["k"], r["term"]): r["weight"] for r in prompts.tfidf_scores(df, "k", "text").collect()}
    for k, b in raw.items():
        length = math.sqrt(sum(v * v for v in b.values()))
        for w, v in b.items():
            assert got[k, w] == pytest.approx(v / length)
    assert len(got) == sum(map(len, raw.values()))
    words = sorted(freq)
    for top in (1, 2, 3):
        out = {r["k"]: r["keywords"] for r in prompts.tfidf_keywords(df, "k", "text", top).collect()}
        for k in bags:
            want = sorted(words, key=lambda w: (-raw[k].get(w, 0.0), w))[:top]
            assert out[k] == " ".join(want)


def test_audit_and_reports(spark):
    rows = spark.createDataFrame(
        [(1, "<DOC> x", [[1.0]]), (2, "<DOC> <DOC>", [[1.0], None]), (3, "", [])],
        "k int, prompt string, e array<array<float>>",
    )
    bad = prompts.placeholder_audit(rows, "k", "prompt", "e").collect()
    assert [(r["k"], r["placeholders"], r["vectors"]) for r in bad] == [(2, 2, 1)]
    report = {r["mode"]: r["mean_length"] for r in prompts.compression_report(
        spark.createDataFrame([("a", "<DOC> b"), ("a", "c"), ("b", "d e f")], "mode string, p string"), "mode", "p"
    ).collect()}
    assert report == {"a": 1.5, "b": 3.0}


def test_passages_by_retriever(value):
    assert value(prompts.passage_text(F.lit("t"), "intfloat/e5-large-v2")) == "passage: t"
    assert value(prompts.passage_text(F.lit("t"), "intfloat/e5-mistral-7b-instruct")) == "t</s>"
    assert value(prompts.passage_text(F.lit("t"), "another")) == "t"


def test_retriever_texts_are_flattened_in_order(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "k int, t array<string>")
    out = prompts.retriever_texts(df, "k", "t", "intfloat/e5-large-v2").orderBy("k", "pos")
    assert [tuple(r) for r in out.collect()] == [(1, 0, "passage: a"), (1, 1, "passage: b"), (2, 0, "passage: c")]


def test_evaluation_job(spark):
    rows = spark.createDataFrame([(0, "why", ["apple"]), (1, "who", ["zz"])], "k int, question string, answer array<string>")
    hits = spark.createDataFrame([(k, 1, t) for k, t in DOCS[:2]], "k int, rank int, text string")
    out = jobs.evaluation_prompts(rows, "k", F.lit("open_qa"), hits, [1], keywords=1, retriever="intfloat/e5-large-v2")
    got = {r["k"]: r["prompt"] for r in out.collect()}
    assert got[0] == (
        "[INST] Refer to the background document and answer the questions:\n\n"
        "Background: passage: apple\n\nQuestion: why? [/INST] The answer is:"
    )
    assert "passage: cherry" in got[1]
    outputs = out.withColumn("said", F.lit("An Apple"))
    scored = jobs.score_outputs(outputs, "triviaqa", "k", "said", "answer")
    assert {r["k"]: r["score"] for r in scored.collect()} == {0: 1.0, 1: 0.0}
    record = prompts.eval_record(
        outputs.join(scored, "k"), "triviaqa", "m", None, 4, "prompt", "score"
    ).first()
    assert record["score"] == 0.5 and record["metric"] == "substring_match" and not record["include_retrieval"]
    both = jobs.score_outputs(outputs, "truthfulqa", "k", "said", "answer")
    assert {r["k"]: r["f1"] for r in both.collect()} == {0: 1.0, 1: 0.0}


def test_evaluation_with_shots(spark):
    rows = spark.createDataFrame([(0, "why", "x"), (1, "who", "y")], "k int, question string, subject string")
    hits = spark.createDataFrame([(0, 1, "own0"), (1, 1, "own1")], "k int, rank int, text string")
    shots = [(i, f"q{i}", s, [f"text {s}{i}"]) for s in "xy" for i in range(5)]
    dev = spark.createDataFrame(shots, "k int, question string, subject string, background array<string>")
    how = dict(retrieved=hits, ranks=[1], dev=dev, n_shot=2, subject="subject")
    got = {r["k"]: r for r in jobs.evaluation_prompts(rows, "k", F.lit("open_qa"), **how).collect()}
    assert got[1]["background"] == ["own1", "text y0", "text y1"] and got[1]["n_shot"] == 2
    assert got[1]["prompt"].index("text y0") < got[1]["prompt"].index("text y1") < got[1]["prompt"].index("own1")
    tight = jobs.evaluation_prompts(rows, "k", F.lit("open_qa"), **how, limit=35).collect()
    assert {(r["n_shot"], len(r["background"])) for r in tight} == {(0, 1)} or all(r["n_shot"] < 2 for r in tight)
    with pytest.raises(ValueError, match="exactly 5"):
        jobs.evaluation_prompts(rows, "k", F.lit("open_qa"), **(how | {"dev": dev.filter("k > 0 or subject = 'x'")}))
    with pytest.raises(ValueError, match="exactly 5"):
        jobs.evaluation_prompts(rows, "k", F.lit("open_qa"), **(how | {"dev": dev.filter("subject = 'x'")}))
    free = jobs.evaluation_prompts(rows.drop("subject"), "k", F.lit("open_qa"), dev=dev.select("k", "question").limit(3))
    assert all(r["background"] == [] and r["n_shot"] == 3 for r in free.collect())


def test_end_mark_is_for_encoders_only(value):
    name = "Intfloat/E5-mistral-7b-instruct"
    assert value(prompts.passage_text(F.lit("t"), name)) == "t</s>"
    assert value(prompts.prefixed_passage(F.lit("t"), name)) == "t"
    assert value(prompts.prefixed_passage(F.lit("t"), "INTFLOAT/e5-large-v2")) == "passage: t"


def test_words_are_weighed_in_as_many_parts_as_texts_are_long(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 30, f"alpha beta word{i} word{i % 7} beta") for i in range(40)] + [(99, None), (None, "alpha")], "doc_id bigint, text string")
    few = {tuple(r) for r in prompts.tfidf_scores(docs, "doc_id", "text").select("doc_id", "term", F.round("weight", 9)).collect()}
    monkeypatch.setattr(prompts, "PART_CHARS", 50)
    weighed, _ = prompts._weighted_terms(docs, "doc_id", "text")
    assert weighed.rdd.getNumPartitions() >= 20
    many = {tuple(r) for r in prompts.tfidf_scores(docs, "doc_id", "text").select("doc_id", "term", F.round("weight", 9)).collect()}
    assert few == many and len(few) > 90


@pytest.mark.parametrize("frequent", [1, 3, 1000])
def test_weights_of_frequent_and_rare_words(spark, monkeypatch, frequent):
    """The same weights however many words are broadcast; rows of one key, or without one, are one document."""
    monkeypatch.setattr(prompts, "FREQUENT_TERMS", frequent)
    rows = [(1, "aa bb aa cc"), (2, "AA dd ee"), (2, "dd ff"), (None, "aa bb"), (None, "gg"), (3, ""), (4, None), (5, "a . hh")]
    held = {}
    for k, text in rows:
        held.setdefault(k, []).append([w for w in (text or "").lower().split() if len(w) > 1])
    df = Counter(w for parts in held.values() for words in parts for w in set(words))
    want = {}
    for k, parts in held.items():
        raw = {w: n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in Counter(sum(parts, [])).items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(k, w): pytest.approx(x / length) for w, x in raw.items()}
    docs = spark.createDataFrame(rows, "k long, text string")
    found = prompts.tfidf_scores(docs, "k", "text").collect()
    assert len(found) == len(want) and {(r["k"], r["term"]): r["weight"] for r in found} == want
