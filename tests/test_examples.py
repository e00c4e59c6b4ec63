import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import chat, wording
from lodestone.functions.text import tokenize
from lodestone.operators import examples, vocabulary
from lodestone.plans import catalog, jobs


def tokens_of(n):
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))


@pytest.mark.parametrize(
    "n, total, sizes",
    [
        (180, 1024, [180]),
        (200, 1024, [180]),  # a tail of 20 is dropped
        (201, 1024, [180, 21]),  # a tail of 21 stays
        (5, 1024, [5]),  # the only chunk stays
        (2000, 380, [180, 180]),  # the cut leaves a tail of 20
        (360, 1024, [180, 180]),
    ],
)
def test_chunks(value, n, total, sizes):
    chunks = value(examples.chunk_tokens(tokens_of(n), total))
    assert [len(c) for c in chunks] == sizes
    assert value(examples.chunk_count(tokens_of(n), total)) == len(sizes)
    flat = [t for c in chunks for t in c]
    assert flat == [str(i + 1) for i in range(len(flat))]


def test_no_tokens_give_one_empty_chunk(value):
    none = F.array().cast("array<string>")
    assert value(examples.chunk_tokens(none)) == [[]]
    assert value(examples.chunk_count(none)) == 1


TALK = [("user", " hi  "), ("assistant", "yo "), ("user", "bye"), ("assistant", "ok")]


def messages(talk):
    return F.array(
        *[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in talk]
    )


def test_render_strips_or_keeps(value):
    assert value(chat.render(messages(TALK))) == "[INST] hi [/INST]yo</s>[INST] bye [/INST]ok</s>"
    assert value(chat.render(messages(TALK[:2]), chat.INSTRUCT_VERBATIM)) == "[INST]  hi   [/INST]yo </s>"
    assert (
        value(chat.render(messages([("system", "s"), *TALK[:2]]), chat.TAGGED))
        == "<|system|>\ns\n<|user|>\nhi\n<|assistant|>\nyo</s>\n"
    )


def test_unknown_role(value):
    odd = messages([("system", "x"), ("user", "y")])
    with pytest.raises(Exception, match="Invalid role"):
        value(chat.render(odd))
    assert value(chat.render(odd, strict=False)) is None


def test_label_mask_of_a_row(value):
    x = value(examples.messages_label_mask(messages(TALK)))
    live = [t for t in x["labels"] if t != "-100"]
    assert live == ["yo", "</s>", "ok", "</s>"]
    assert len(x["labels"]) == len(x["input_tokens"])
    assert all(a in ("-100", b) for a, b in zip(x["labels"], x["input_tokens"]))
    short = value(examples.messages_label_mask(messages(TALK), max_len=4))
    assert len(short["labels"]) == 4 and set(short["labels"]) == {"-100"}


def test_tagged_mask_hides_the_assistant_tag_after_another_role(value):
    talk = messages([("assistant", "a"), ("user", "u"), ("assistant", "b"), ("assistant", "c")])
    x = value(examples.messages_label_mask(talk, chat.TAGGED))
    live = "".join(t for t in x["labels"] if t != "-100")
    assert live == "<|assistant|>a</s>b</s><|assistant|>c</s>"


def test_long_and_row_forms_agree(spark):
    rng = random.Random(3)
    rows, turns = [], []
    for conv in range(20):
        talk = []
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system"])
            talk.append((role, " ".join(rng.choice(["a", "b.", "<DOC>"]) for _ in range(rng.randint(0, 9)))))
            turns.append((conv, turn, *talk[-1]))
        rows.append((conv, talk))
    by_row = spark.createDataFrame(rows, "conv bigint, m array<struct<role:string,content:string>>")
    by_turn = spark.createDataFrame(turns, "conv bigint, turn bigint, role string, content string")
    x = examples.messages_label_mask(F.col("m"), chat.TAGGED, 25).alias("x")
    a = by_row.select("conv", x).select("conv", "x.*")
    b = examples.chat_label_mask(by_turn, "conv", "turn", chat.TAGGED, 25)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    spans = examples.turn_spans(by_turn, "conv", "turn", chat.TAGGED, bits=1)
    whole = {r["conv"]: r["t"] for r in by_row.select("conv", chat.render(F.col("m"), chat.TAGGED).alias("t")).collect()}
    for r in spans.collect():
        assert whole[r["conv"]][r["char_start"] :].startswith(r["segment"])


def test_prompt_completion(value):
    x = value(examples.prompt_completion(F.lit("bg"), F.lit("q? "), F.lit(" yes")))
    assert x["input_tokens"] == ["Background", ":", "bg", "q", "?", "yes", "</s>"]
    assert x["labels"] == ["-100"] * 5 + ["yes", "</s>"]
    assert value(examples.join_prompt(F.lit("a "), F.lit(" b"))) == "a b"


def test_answer_example_keeps_last_match_and_last_token(value):
    x = value(examples.answer_example(F.lit("yes no yes it was"), F.lit("yes")))
    assert x["labels"] == ["-100", "-100", "yes", "-100", "was"]
    x = value(examples.answer_example(F.lit("bg b c : a"), F.lit("zz"), F.lit("b c")))
    assert x["labels"] == ["-100", "b", "c", "-100", "-100"]


def test_placeholders_are_never_labels(value):
    x = value(examples.paraphrase_completion(F.lit(" a <DOC> b "), F.lit("k"), 1))
    assert [t for t in x["labels"] if t != "-100"] == ["a", "b"]


def test_dual_views_touch_the_first_user_only(value):
    talk = messages([("assistant", "x"), ("user", "q"), ("user", "r")])
    compressed, plain = examples.dual_views(talk, F.concat_ws(" ", tokens_of(400)), embed_len=2)
    a, b = value(compressed), value(plain)
    run = " ".join([wording.PLACEHOLDER] * 6)
    assert a[1]["content"] == f"Refer to the background document: {run}\n\nq"
    assert b[1]["content"].endswith(" 400\n\nq")
    assert a[0] == b[0] and a[2] == b[2] and a[2]["content"] == "r"


def test_answered_prompt_fills_every_field_once(value):
    prompt = value(
        examples.answered_prompt(
            F.lit("open_qa"), F.lit("{answer}"), F.lit("A"), F.lit("{question}"), F.lit("real {background}")
        )
    )
    assert prompt == (
        "Refer to the background document and answer the questions:\n\nBackground: {question}\n"
        "The above background document is just a paraphrase of the following: real {background}\n\n"
        "Q: {answer}?\nA: A"
    )


def test_collate_pads_left_or_right_and_keeps_live_labels(spark):
    rows = [(i, list(range(1, i + 2)), [-100] * i + [9]) for i in range(5)]
    df = spark.createDataFrame(rows, "k bigint, ids array<int>, labels array<int>")
    batched = examples.with_batch(df, "k", 2, 0, shuffle=False)
    for side in ("left", "right"):
        out = {r["k"]: r for r in examples.collate(batched, side=side).collect()}
        assert [out[k]["batch"] for k in range(5)] == [0, 0, 1, 1, 2]
        assert [len(out[k]["ids"]) for k in range(5)] == [2, 2, 4, 4, 5]
        for k in range(5):
            assert [x for x in out[k]["labels"] if x != -100] == [9]
            assert sum(out[k]["attention_mask"]) == k + 1
    assert out[0]["ids"] == [1, 0] and out[0]["labels"] == [9, -100]


def test_trim_padding_uses_the_longest_row_of_the_batch(spark):
    rows = [(0, [5, 0, 0, 0]), (1, [5, 6, 7, 0]), (2, [1, 0, 0, 0])]
    df = spark.createDataFrame(rows, "k bigint, ids array<int>")
    out = examples.trim_padding(examples.with_batch(df, "k", 2, 0, shuffle=False))
    assert {r["k"]: r["ids"] for r in out.collect()} == {0: [5, 0, 0], 1: [5, 6, 7], 2: [1]}


def test_batch_targets_stack_negatives_and_devices(spark):
    df = spark.range(8).withColumnRenamed("id", "k")
    batched = examples.with_batch(df, "k", 2, 0, shuffle=False)
    out = {r["k"]: r for r in examples.batch_targets(batched, "k", 2, devices=2).collect()}
    assert [out[k]["target"] for k in range(4)] == [0, 1, 4, 5]
    assert [out[k]["step"] for k in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert {r["negatives"] for r in out.values()} == {7}


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(0, "b a a"), (1, "a zz"), (2, "")], "k bigint, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    vocab = vocabulary.build_vocabulary(df, words)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids["a"] == vocabulary.FIRST_WORD_ID and sorted(ids.values()) == [7, 8, 9]
    known = vocab.filter("token <> 'zz'")
    out = {r["k"]: r["ids"] for r in vocabulary.encode(df, ["k"], words, known).collect()}
    assert out == {0: [ids["b"], ids["a"], ids["a"]], 1: [ids["a"], 1], 2: []}


def test_fixed_width_inputs(value):
    ids = F.array(*[F.lit(i) for i in (9, 8)])
    assert value(vocabulary.document_input(ids, 4)) == [4, 9, 8, 0]
    assert value(vocabulary.document_input(ids, 2)) == [4, 9]
    assert value(vocabulary.query_input(ids, 5)) == [3, 9, 8, 2, 2]
    assert value(vocabulary.attention(vocabulary.query_input(ids, 5), 2)) == [1, 1, 1, 0, 0]


def test_training_batches(spark):
    long = " ".join(str(i) for i in range(300))
    rows = [
        (f"r{i}", [("user", "q"), ("assistant", "a" * i)], "close_qa" if i else "other", long) for i in range(9)
    ]
    schema = "id string, messages array<struct<role:string,content:string>>, task_type string, background string"
    table = spark.createDataFrame(rows, schema)
    out = jobs.training_rows(table, excluded=["other"])
    assert out.count() == 8
    assert {len(r["chunks"]) for r in out.collect()} == {2}
    words = vocabulary.build_vocabulary(table, tokenize(F.col("background")))
    batches = jobs.training_batches(out, "compressed", words, 4, seed=1).collect()
    for r in batches:
        assert all(isinstance(x, int) for x in r["ids"] + r["labels"])
        assert all(y in (-100, x) for x, y in zip(r["ids"], r["labels"])) and set(r["labels"]) != {-100}
        assert [int(x != 0) for x in r["ids"]] == r["attention_mask"]
    for batch in {r["batch"] for r in batches}:
        assert len({len(r["ids"]) for r in batches if r["batch"] == batch}) == 1
    with pytest.raises(Exception, match="no background in row"):
        jobs.training_rows(table.withColumn("background", F.lit(None).cast("string"))).collect()
    # a cut that removes the answer from the plain view only drops the row
    assert jobs.training_rows(table, max_len=100).count() == 0


def test_an_answer_or_background_without_tokens_labels_nothing(value):
    x = value(examples.answer_example(F.lit("a b : 12"), F.lit("12"), F.lit(" \u200b ")))
    assert x["labels"] == ["-100", "-100", "-100", "12"]
    x = value(examples.answer_example(F.lit("a b : 12"), F.lit(""), F.lit("a b")))
    assert x["labels"] == ["a", "b", "-100", "12"]


def test_answered_views_of_documents_without_tokens(spark, tmp_path):
    texts = ["", " \n", "\u200b", "some words, 12 of them"]
    rows = [(i, text, "en", "web", 12) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(catalog.SQL["answered_views"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["answered_views"](spark, str(tmp_path)).collect())) == sorted(want)


def test_answered_rows_label_the_answer_in_both_views(spark):
    df = spark.createDataFrame([(1, "why", "because", "some background words")], "k int, question string, answer string, background string")
    for restate in (False, True):
        row = jobs.answered_rows(df, "k", F.lit("open_qa"), restate=restate).first()
        live = {v: [x for x in row[v]["labels"] if x != "-100"] for v in ("compressed", "plain")}
        assert "because" in live["plain"] and "because" in live["compressed"]
        assert ("background" in live["compressed"]) == restate


def test_stacked_documents_put_positives_first(spark):
    df = spark.createDataFrame([(i, [i], [10 + i]) for i in range(3)], "k bigint, p array<int>, n array<int>")
    out = examples.stack_documents(examples.with_batch(df, "k", 2, 0, shuffle=False), "p", "n")
    got = {(r["batch"], r["place"]): r["ids"][0] for r in out.collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 10, (0, 3): 11, (1, 0): 2, (1, 1): 12}


def test_each_view_is_tokenised_once(spark):
    rows = spark.createDataFrame([("a", "w " * 300, "what?", "that")], "id string, background string, q string, a string")
    views = examples.encoded_views(chat.conversation(F.col("q"), F.col("a")), F.col("background"))
    found = rows.select("id", F.inline(views)).filter(F.size("chunks") > 0).filter(F.size("plain.labels") > 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the background, and each of the two views
    assert plan.count("regexp_extract_all(") == 3
    row = found.first()
    assert len(row["chunks"]) == 2 and row["compressed"]["input_tokens"].count("<DOC>") == 2
    assert row["plain"]["labels"][-2:] == ["that", "</s>"] and row["plain"]["input_tokens"].count("w") == 300


def test_views_with_other_labels_are_left_out(spark):
    rows = spark.createDataFrame([(1, "w " * 1020), (2, "w " * 2000), (3, "w")], "id int, background string")
    messages = chat.conversation(F.lit("q"), F.lit("one two three"))
    both = [r["id"] for r in rows.select("id", F.inline(examples.encoded_views(messages, F.col("background")))).collect()]
    views = examples.encoded_views(messages, F.col("background"), match_views=False)
    any_label = [r["id"] for r in rows.select("id", F.inline(views)).collect()]
    assert both == [3] and set(any_label) <= {1, 3}


def test_ids_in_slots_and_beyond_them(spark, monkeypatch):
    """The same ids whether all words, some or none have a slot."""
    rng = random.Random(2)
    lists = [[rng.choice(["a", "b", "</s>", *[f"w{i}" for i in range(60)]]) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    lists += [None, [], ["a", None, "never seen", "</s>"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, t array<string>")
    words = vocabulary.build_vocabulary(rows.filter("k < 30"), F.col("t"))
    number = {r["token"]: r["token_id"] for r in words.collect()} | vocabulary.SPECIAL_IDS
    unknown = vocabulary.SPECIAL_IDS[wording.UNK]
    want = {k: [number.get(x, unknown) for x in (t or []) if x is not None][:20] for k, t in enumerate(lists) if k < 42}
    for slots, count in ((65_536, 16_384), (64, 16_384), (2, 3), (65_536, 5)):
        monkeypatch.setattr(vocabulary, "SLOTS", slots)
        monkeypatch.setattr(vocabulary, "SLOT_WORDS", count)
        got = {r["k"]: r["ids"] for r in vocabulary.encode(rows.filter("k < 42"), ["k"], F.col("t"), words, 20).collect()}
        assert got == want
        last = vocabulary.encode(rows.filter("k = 42"), ["k"], F.col("t"), words).first()["ids"]
        assert last == [number["a"], unknown, number["</s>"]]
    assert vocabulary.encode(rows.limit(0), ["k"], F.col("t"), words).count() == 0
