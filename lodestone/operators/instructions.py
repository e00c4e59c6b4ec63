"""One instruction table out of many question and summary sources.

Every source is one :class:`SourceSpec`, a set of Spark SQL expressions over
the source's own columns. ``to_instruction`` projects a source onto the common
schema ``id, messages, task_type, background``; no source needs code of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chat, wording
from ..functions.binding import let
from ..functions.choice import fill, pick
from .joins import skewed_join
from .ordering import head_n

TEMPLATES = {
    "qa": wording.QA_TEMPLATES,
    "summary": wording.SUMMARY_TEMPLATES,
    "fact_check": wording.FACT_CHECK_TEMPLATES,
    "none": ["{question}"],
}


@dataclass(frozen=True)
class SourceSpec:
    """How one source becomes chats.

    ``question`` and ``answer`` are SQL expressions; with ``multi_turn`` they
    are arrays of equal length. ``where`` keeps rows.
    """

    task_type: str
    question: str
    answer: str
    background: str | None = None
    template: str = "qa"
    where: str | None = None
    multi_turn: bool = False
    prefix: str | None = None


LETTERS = "array('A', 'B', 'C', 'D')"
NEWLINE = "'\\n'"

SOURCES = {
    "commonsense_qa": SourceSpec(
        "open_qa",
        "concat(question, '\\n\\n', array_join(transform(arrays_zip(choices.label, choices.text),"
        " c -> concat(c.label, '. ', c.text, '\\n')), ''))",
        "answerKey",
    ),
    "web_questions": SourceSpec("open_qa", f"concat(question, {NEWLINE})", "get(answers, 0)"),
    "wiki_qa": SourceSpec("open_qa", f"concat(question, {NEWLINE})", "answer", where="label <> 0"),
    "yahoo_answers_qa": SourceSpec("open_qa", f"concat(question, {NEWLINE})", "answer"),
    "freebase_qa": SourceSpec(
        "open_qa", f"concat(RawQuestion, {NEWLINE})", "get(get(get(Parses.Answers, 0).AnswersName, 0), 0)"
    ),
    "ms_marco": SourceSpec(
        "open_qa", f"concat(ltrim(')', query), {NEWLINE})", "get(answers, 0)"
    ),
    "coqa": SourceSpec(
        "close_qa",
        f"transform(questions, q -> concat(q, {NEWLINE}))",
        "answers.input_text",
        "story",
        multi_turn=True,
    ),
    "drop": SourceSpec(
        "close_qa", f"concat(question, {NEWLINE})", "get(answers_spans.spans, 0)", "passage"
    ),
    "narrativeqa": SourceSpec("close_qa", "question.text", "get(answers, 0).text", "document.summary.text"),
    "pubmed_qa": SourceSpec(
        "close_qa",
        "question",
        f"concat(long_answer, '{wording.FINAL_ANSWER_CUE}', final_decision)",
        f"array_join(context.contexts, {NEWLINE})",
    ),
    "quail": SourceSpec(
        "close_qa",
        "concat(question, '\\n', array_join(transform(answers,"
        f" (a, i) -> concat(element_at({LETTERS}, i + 1), '. ', a, '\\n')), ''))",
        f"get({LETTERS}, correct_answer_id)",
        "context",
    ),
    "squad_v2": SourceSpec(
        "close_qa", "question", f'coalesce(get(answers.text, 0), "{wording.UNANSWERABLE}")', "context"
    ),
    "cnn_dailymail": SourceSpec(
        "summarization", "''", "highlights", "article", template="summary"
    ),
    "samsum": SourceSpec(
        "summarization", "''", "summary", "replace(dialogue, '\\r\\n', '\\n')", template="summary"
    ),
    "dialogsum": SourceSpec("summarization", "''", "summary", "dialogue", template="summary"),
    "pwc": SourceSpec("close_qa", "prompt", "answer", "input", template="none"),
    "nq_open": SourceSpec("open_qa", "question", "get(answer, 0)", prefix="nq"),
    "fm2": SourceSpec(
        "fact_checking",
        "question",
        "if(contains(answer, 'supports'), 'True', 'False')",
        template="fact_check",
    ),
    "triviaqa": SourceSpec("open_qa", "question", "get(answer, 0)"),
}


def _single_turn(template: Column, spec: SourceSpec) -> Column:
    return chat.conversation(fill(template, question=F.expr(spec.question)), F.expr(spec.answer))


def _multi_turn(template: Column, spec: SourceSpec) -> Column:
    """Alternating messages; only the first question goes into a template."""

    def turns(v):
        pair = lambda i: chat.conversation(
            F.when(i == 0, fill(v["template"], question=F.get(v["questions"], i))).otherwise(
                F.get(v["questions"], i)
            ),
            F.get(v["answers"], i),
        )
        count = F.size(v["questions"])
        places = F.transform(v["questions"], lambda _, i: i)
        return F.when(count == F.size(v["answers"]), F.flatten(F.transform(places, pair))).otherwise(
            F.raise_error(F.lit("questions and answers differ in number")).cast(chat.MESSAGES)
        )

    return let(
        turns, template=template, questions=F.expr(spec.question), answers=F.expr(spec.answer)
    )


def to_instruction(
    df: DataFrame, source: str, key: str = "key", seed: str | int = 0, head: int | None = None
) -> DataFrame:
    """Rows of one source as (id, messages, task_type, background).

    The id is the source name and the row's key; the template follows from seed
    and id, so the same row always reads the same. With ``head`` only the first
    rows by key are taken; all rows are the default.
    """
    spec = SOURCES[source]
    if head is not None:
        df = head_n(df, key, head)
    if spec.where is not None:
        df = df.filter(spec.where)
    row_id = F.concat_ws("_", F.lit(spec.prefix or source), F.col(key).cast("string"))
    template = pick(TEMPLATES[spec.template], seed, row_id)
    build = _multi_turn if spec.multi_turn else _single_turn
    background = F.expr(spec.background) if spec.background else F.lit(None)
    return df.select(
        row_id.alias("id"),
        build(template, spec).cast(chat.MESSAGES).alias("messages"),
        F.lit(spec.task_type).alias("task_type"),
        background.cast("string").alias("background"),
    )


def instruction_table(
    sources: dict[str, DataFrame], key: str = "key", seed: str | int = 0, heads: dict[str, int] | None = None
) -> DataFrame:
    """All sources in one table, with the source name. ``heads`` limits single
    sources to their first rows by key."""
    parts = [
        to_instruction(df, name, key, seed, (heads or {}).get(name)).withColumn("source", F.lit(name))
        for name, df in sources.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def instruction_profile(table: DataFrame) -> DataFrame:
    return table.groupBy("source", "task_type").agg(F.count("*").alias("n"))


def backfill_background(table: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Give rows without a background the best text found for their first user
    message. ``retrieved`` is (query, text), one row per distinct query."""
    missing = F.when(F.col("background").isNull(), chat.first_user_content(F.col("messages")))
    keyed = table.withColumn("_query", missing)
    found = retrieved.select(F.col("query").alias("_query"), F.col("text").alias("_text"))
    # many rows may need nothing (null) or ask the same question
    joined = skewed_join(keyed, found, "_query", [F.col("id")], "left")
    return joined.withColumn("background", F.coalesce("background", "_text")).select(*table.columns)


def exclude_types(table: DataFrame, types: list[str], column: str = "task_type") -> DataFrame:
    """Rows whose type is not listed; rows without a type stay."""
    return table.filter(F.col(column).isNull() | ~F.col(column).isin(types)) if types else table


# --- evaluation sources --------------------------------------------------------------


def exam_question(question: Column, choices: list[Column], answer: Column) -> Column:
    """A multiple-choice question as one query text, choices lettered from A."""
    lines = [F.concat(F.lit(f"\n{letter}. "), choice) for letter, choice in zip("ABCD", choices)]
    return F.concat(strip_question(question), *lines, F.lit("\nAnswer: "), answer)


def strip_question(question: Column) -> Column:
    from ..functions.text import strip

    return strip(question)


def knowledge_task(df: DataFrame) -> DataFrame:
    """(input, output ARRAY<STRUCT<answer>>) as (question, answer)."""
    return df.select(F.col("input").alias("question"), F.get("output", F.lit(0))["answer"].alias("answer"))
