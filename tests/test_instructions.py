import pytest
from pyspark.sql import functions as F

from lodestone.functions import wording
from lodestone.operators import instructions
from lodestone.plans import jobs

# one row of every source in its own shape: (schema, row, answer, background)
SAMPLES = {
    "commonsense_qa": ("key int, question string, choices struct<label:array<string>,text:array<string>>, answerKey string",
                       (1, "q", (["A", "B"], ["x", "y"]), "B"), "B", None),
    "web_questions": ("key int, question string, answers array<string>", (1, "q", ["a", "b"]), "a", None),
    "wiki_qa": ("key int, question string, answer string, label int", (1, "q", "a", 1), "a", None),
    "yahoo_answers_qa": ("key int, question string, answer string", (1, "q", "a"), "a", None),
    "freebase_qa": ("key int, RawQuestion string, Parses struct<Answers:array<struct<AnswersName:array<array<string>>>>>",
                    (1, "q", ([([["a", "z"], ["y"]],)],)), "a", None),
    "ms_marco": ("key int, query string, answers array<string>", (1, "))q", ["a"]), "a", None),
    "coqa": ("key int, story string, questions array<string>, answers struct<input_text:array<string>>",
             (1, "s", ["q", "r"], (["a", "b"],)), "a", "s"),
    "drop": ("key int, question string, passage string, answers_spans struct<spans:array<string>>",
             (1, "q", "p", (["a"],)), "a", "p"),
    "narrativeqa": ("key int, question struct<text:string>, answers array<struct<text:string>>, document struct<summary:struct<text:string>>",
                    (1, ("q",), [("a",)], (("d",),)), "a", "d"),
    "pubmed_qa": ("key int, question string, long_answer string, final_decision string, context struct<contexts:array<string>>",
                  (1, "q", "L.", "yes", (["c", "d"],)), "L.So the final answer is: yes", "c\nd"),
    "quail": ("key int, question string, context string, answers array<string>, correct_answer_id int",
              (1, "q", "c", ["w", "x", "y", "z"], 2), "C", "c"),
    "squad_v2": ("key int, question string, context string, answers struct<text:array<string>>",
                 (1, "q", "c", ([],)), "I don't know.", "c"),
    "cnn_dailymail": ("key int, article string, highlights string", (1, "t", "h"), "h", "t"),
    "samsum": ("key int, dialogue string, summary string", (1, "x\r\ny", "h"), "h", "x\ny"),
    "dialogsum": ("key int, dialogue string, summary string", (1, "x\r\ny", "h"), "h", "x\r\ny"),
    "pwc": ("key int, input string, prompt string, answer string", (1, "i", "q", "a"), "a", "i"),
    "nq_open": ("key int, question string, answer array<string>", (1, "q", ["a", "b"]), "a", None),
    "fm2": ("key int, question string, answer string", (1, "q", "it supports"), "True", None),
    "triviaqa": ("key int, question string, answer array<string>", (1, "q", ["a"]), "a", None),
}
TASKS = {
    "open_qa": ["commonsense_qa", "web_questions", "wiki_qa", "yahoo_answers_qa", "freebase_qa", "ms_marco", "nq_open", "triviaqa"],
    "close_qa": ["coqa", "drop", "narrativeqa", "pubmed_qa", "quail", "squad_v2", "pwc"],
    "summarization": ["cnn_dailymail", "samsum", "dialogsum"],
    "fact_checking": ["fm2"],
}


def frames(spark, names=SAMPLES):
    return {n: spark.createDataFrame([SAMPLES[n][1]], SAMPLES[n][0]) for n in names}


def question_of(name):
    if name == "commonsense_qa":
        return "q\n\nA. x\nB. y\n"
    if name == "quail":
        return "q\nA. w\nB. x\nC. y\nD. z\n"
    newline = name in ("web_questions", "wiki_qa", "yahoo_answers_qa", "freebase_qa", "ms_marco", "coqa", "drop")
    return "q\n" if newline else "q"


def test_every_source(spark):
    assert set(SAMPLES) == set(instructions.SOURCES) and len(SAMPLES) == 19
    out = {r["source"]: r for r in instructions.instruction_table(frames(spark)).collect()}
    for name, (_, _, answer, background) in SAMPLES.items():
        row = out[name]
        assert row["id"] == ("nq_1" if name == "nq_open" else f"{name}_1")
        assert name in TASKS[row["task_type"]]
        assert row["messages"][0]["role"] == "user" and row["messages"][1]["role"] == "assistant"
        assert row["messages"][1]["content"] == answer and row["background"] == background
        templates = instructions.TEMPLATES[instructions.SOURCES[name].template]
        said = row["messages"][0]["content"]
        assert said in [t.replace("{question}", question_of(name)) for t in templates]
    talk = out["coqa"]["messages"]
    assert [m["content"] for m in talk][2:] == ["r\n", "b"]


def test_filters_and_defaults(spark):
    wiki = spark.createDataFrame([(1, "q", "a", 0), (2, "q", "a", 1)], SAMPLES["wiki_qa"][0])
    assert [r["id"] for r in instructions.to_instruction(wiki, "wiki_qa").collect()] == ["wiki_qa_2"]
    squad = spark.createDataFrame([(1, "q", "c", (["x", "y"],))], SAMPLES["squad_v2"][0])
    assert instructions.to_instruction(squad, "squad_v2").first()["messages"][1]["content"] == "x"
    fm2 = spark.createDataFrame([(1, "q", "refutes")], SAMPLES["fm2"][0])
    assert instructions.to_instruction(fm2, "fm2").first()["messages"][1]["content"] == "False"


def test_uneven_turns_are_an_error(spark):
    odd = spark.createDataFrame([(1, "s", ["q", "r"], (["a"],))], SAMPLES["coqa"][0])
    with pytest.raises(Exception, match="differ in number"):
        instructions.to_instruction(odd, "coqa").collect()


def test_templates_are_seeded_and_spread(spark):
    df = spark.range(400).select(F.col("id").alias("key"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    first = instructions.to_instruction(df, "yahoo_answers_qa", seed=1)
    again = instructions.to_instruction(df.repartition(5), "yahoo_answers_qa", seed=1)
    assert first.exceptAll(again).count() == 0
    used = first.select(F.col("messages")[0]["content"].alias("t")).distinct().count()
    assert used == len(wording.QA_TEMPLATES) == 13 and len(wording.SUMMARY_TEMPLATES) == 8


def test_backfill(spark):
    talk = lambda *m: [{"role": r, "content": c} for r, c in m]
    rows = [
        ("a", talk(("system", "s"), ("user", "same"), ("user", "other")), "open_qa", None),
        ("b", talk(("user", "same")), "open_qa", None),
        ("c", talk(("user", "same")), "close_qa", "own"),
        ("d", talk(("user", "unknown")), "open_qa", None),
    ]
    table = spark.createDataFrame(rows, "id string, messages array<struct<role:string,content:string>>, task_type string, background string")
    found = spark.createDataFrame([("same", "text")], "query string, text string")
    out = {r["id"]: r["background"] for r in instructions.backfill_background(table, found).collect()}
    assert out == {"a": "text", "b": "text", "c": "own", "d": None}


def test_exclude_and_profile(spark):
    table = instructions.instruction_table(frames(spark, ["nq_open", "fm2", "coqa"]))
    kept = instructions.exclude_types(table, ["open_qa", "close_qa"])
    assert [r["task_type"] for r in kept.collect()] == ["fact_checking"]
    assert instructions.exclude_types(table, []).count() == 3
    assert {(r["source"], r["n"]) for r in instructions.instruction_profile(table).collect()} == {
        ("nq_open", 1), ("fm2", 1), ("coqa", 1)
    }


def test_build_job_partitions_by_task(spark, tmp_path):
    out = jobs.build_instructions(frames(spark, ["nq_open", "coqa"]), str(tmp_path / "t"))
    assert out.filter("task_type = 'close_qa'").count() == 1 and out.count() == 2


def test_evaluation_shapes(spark, value):
    text = value(instructions.exam_question(F.lit(" q "), [F.lit(c) for c in "wxyz"], F.lit("B")))
    assert text == "q\nA. w\nB. x\nC. y\nD. z\nAnswer: B"
    df = spark.createDataFrame([("i", [("a",), ("b",)])], "input string, output array<struct<answer:string>>")
    assert instructions.knowledge_task(df).first().asDict() == {"question": "i", "answer": "a"}
