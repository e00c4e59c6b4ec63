"""The instruction table: every source built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import chat, wording
from ..operators import instructions, ranking, search
from .registry import QA, Tables, VECTORS, as_docs, as_queries, choice, qa_pairs, query, quoted, with_

JUDGED = """
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"""
BASE = {"qa": QA, "judged": JUDGED}


def source_shapes(t: Tables) -> dict[str, DataFrame]:
    """Each source in its own shape, filled from documents, benchmark and talk."""
    qa, docs, items = qa_pairs(t), t.documents, t.benchmark
    judged = docs.join(t.labels, "doc_id")
    lines = "split(text, '\\n')"
    nested = (
        "struct(array(struct(array(array(answer, question)) AS AnswersName)) AS Answers) AS Parses"
    )
    return {
        "commonsense_qa": items.selectExpr(
            "item_id AS key",
            "text AS question",
            f"struct(transform({lines}, (x, i) -> char(65 + i)) AS label, {lines} AS text) AS choices",
            f"char(65 + pmod(item_id, size({lines}))) AS answerKey",
        ),
        "web_questions": qa.selectExpr("key", "question", "array(answer) AS answers"),
        "wiki_qa": judged.selectExpr("doc_id AS key", "text AS question", "source AS answer", "quality AS label"),
        "yahoo_answers_qa": qa.select("key", "question", "answer"),
        "freebase_qa": qa.selectExpr("key", "question AS RawQuestion", nested),
        "ms_marco": qa.selectExpr("key", "concat('))', question) AS query", "array(answer, question) AS answers"),
        "coqa": docs.selectExpr(
            "doc_id AS key",
            "source AS story",
            f"{lines} AS questions",
            f"struct(transform({lines}, x -> lower(x)) AS input_text) AS answers",
        ),
        "drop": docs.selectExpr(
            "doc_id AS key", "lang AS question", "text AS passage", "struct(array(source) AS spans) AS answers_spans"
        ),
        "narrativeqa": qa.selectExpr(
            "key",
            "struct(question AS text) AS question",
            "array(struct(answer AS text)) AS answers",
            "struct(struct(answer AS text) AS summary) AS document",
        ),
        "pubmed_qa": docs.selectExpr(
            "doc_id AS key",
            "source AS question",
            "concat(lang, '. ') AS long_answer",
            "if(n_chars > 1000, 'yes', 'no') AS final_decision",
            f"struct({lines} AS contexts) AS context",
        ),
        "quail": items.selectExpr(
            "item_id AS key",
            "text AS question",
            "text AS context",
            "array('one', 'two', 'three', cast(length(text) AS string)) AS answers",
            "cast(pmod(item_id, 4) AS int) AS correct_answer_id",
        ),
        "squad_v2": judged.selectExpr(
            "doc_id AS key",
            "source AS question",
            "text AS context",
            "struct(if(toxic = 1, cast(array() AS array<string>), array(lang)) AS text) AS answers",
        ),
        "cnn_dailymail": docs.selectExpr("doc_id AS key", "text AS article", "source AS highlights"),
        "samsum": qa.selectExpr("key", "concat(question, '\\r\\n', answer) AS dialogue", "question AS summary"),
        "dialogsum": qa.selectExpr("key", "concat(question, '\\r\\n', answer) AS dialogue", "question AS summary"),
        "pwc": qa.selectExpr("key", "answer AS input", "question AS prompt", "answer"),
        "nq_open": items.selectExpr("item_id AS key", "text AS question", "array(text) AS answer"),
        "fm2": judged.selectExpr(
            "doc_id AS key", "text AS question", "if(quality = 1, 'it supports', 'it refutes') AS answer"
        ),
        "triviaqa": items.selectExpr("item_id AS key", "text AS question", "array(lower(text), text) AS answer"),
    }


# name: (id prefix, task, template list, question, answer, background, from)
QA_LIST, SUM_LIST = wording.QA_TEMPLATES, wording.SUMMARY_TEMPLATES
LINES = r"string_split(text, E'\n')"
LETTERED = (
    rf"array_to_string(list_transform({LINES}, lambda x, i: chr(64 + i::INT) || '. ' || x || E'\n'), '')"
)
TWINS = {
    "commonsense_qa": (
        "commonsense_qa", "open_qa", QA_LIST, rf"text || E'\n\n' || {LETTERED}",
        f"chr(65 + (item_id % len({LINES}))::INT)", "NULL", "item_id AS key, * FROM benchmark",
    ),
    "web_questions": ("web_questions", "open_qa", QA_LIST, r"question || E'\n'", "answer", "NULL", "* FROM qa"),
    "wiki_qa": (
        "wiki_qa", "open_qa", QA_LIST, r"text || E'\n'", "source", "NULL",
        "doc_id AS key, * FROM judged WHERE quality <> 0",
    ),
    "yahoo_answers_qa": ("yahoo_answers_qa", "open_qa", QA_LIST, r"question || E'\n'", "answer", "NULL", "* FROM qa"),
    "freebase_qa": ("freebase_qa", "open_qa", QA_LIST, r"question || E'\n'", "answer", "NULL", "* FROM qa"),
    "ms_marco": (
        "ms_marco", "open_qa", QA_LIST, r"ltrim(question, ')') || E'\n'", "answer", "NULL",
        "* FROM qa",
    ),
    "drop": ("drop", "close_qa", QA_LIST, r"lang || E'\n'", "source", "text", "doc_id AS key, * FROM documents"),
    "narrativeqa": ("narrativeqa", "close_qa", QA_LIST, "question", "answer", "answer", "* FROM qa"),
    "pubmed_qa": (
        "pubmed_qa", "close_qa", QA_LIST, "source",
        "lang || '. So the final answer is: ' || CASE WHEN n_chars > 1000 THEN 'yes' ELSE 'no' END",
        "text", "doc_id AS key, * FROM documents",
    ),
    "quail": (
        "quail", "close_qa", QA_LIST,
        r"text || E'\nA. one\nB. two\nC. three\nD. ' || length(text) || E'\n'",
        "['A', 'B', 'C', 'D'][item_id % 4 + 1]", "text", "item_id AS key, * FROM benchmark",
    ),
    "squad_v2": (
        "squad_v2", "close_qa", QA_LIST, "source",
        "CASE WHEN toxic = 1 THEN 'I don''t know.' ELSE lang END", "text", "doc_id AS key, * FROM judged",
    ),
    "cnn_dailymail": (
        "cnn_dailymail", "summarization", SUM_LIST, "''", "source", "text",
        "doc_id AS key, * FROM documents",
    ),
    "samsum": ("samsum", "summarization", SUM_LIST, "''", "question", r"question || E'\n' || answer", "* FROM qa"),
    "dialogsum": (
        "dialogsum", "summarization", SUM_LIST, "''", "question", r"question || E'\r\n' || answer", "* FROM qa"
    ),
    "pwc": ("pwc", "close_qa", ["{question}"], "question", "answer", "answer", "* FROM qa"),
    "nq_open": ("nq", "open_qa", QA_LIST, "text", "text", "NULL", "item_id AS key, * FROM benchmark"),
    "fm2": (
        "fm2", "fact_checking", wording.FACT_CHECK_TEMPLATES, "text",
        "CASE WHEN quality = 1 THEN 'True' ELSE 'False' END", "NULL", "doc_id AS key, * FROM judged",
    ),
    "triviaqa": ("triviaqa", "open_qa", QA_LIST, "text", "lower(text)", "NULL", "item_id AS key, * FROM benchmark"),
}
SEED = "assemble"


def filled(templates: list[str], row_id: str, question: str) -> str:
    if len(templates) == 1:
        return f"replace({quoted(templates[0])}, '{{question}}', {question})"
    return f"replace({choice(templates, SEED, row_id)}, '{{question}}', {question})"


def twin(name: str) -> str:
    prefix, task, templates, question, answer, background, source = TWINS[name]
    row_id = f"'{prefix}_' || key"
    return rf"""SELECT '{name}' AS source, {row_id} AS id, '{task}' AS task_type,
      'user: ' || {filled(templates, row_id, question)} || E'\nassistant: ' || {answer} AS chat,
      ({background})::VARCHAR AS background FROM (SELECT {source})"""


COQA_TWIN = rf"""
  SELECT 'coqa' AS source, id, 'close_qa' AS task_type,
    string_agg('user: ' || CASE WHEN i = 1 THEN {filled(QA_LIST, 'id', r"q || E'\n'")} ELSE q || E'\n' END
      || E'\nassistant: ' || lower(q), E'\n' ORDER BY i) AS chat, any_value(story) AS background
  FROM (SELECT 'coqa_' || doc_id AS id, source AS story, unnest({LINES}) AS q,
        generate_subscripts({LINES}, 1) AS i FROM documents) GROUP BY id"""


def twins(*names: str) -> str:
    return with_(**BASE) + " UNION ALL ".join(COQA_TWIN if n == "coqa" else twin(n) for n in names)


def shown(table: DataFrame) -> DataFrame:
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return table.select("source", "id", "task_type", F.array_join(lines, "\n").alias("chat"), "background")


def register(name: str, *sources: str) -> None:
    @query(name, twins(*sources))
    def assemble(t):
        shapes = source_shapes(t)
        return shown(instructions.instruction_table({s: shapes[s] for s in sources}, seed=SEED))


register("instr_multiple_choice", "commonsense_qa", "quail")
register("instr_open_qa", "web_questions", "yahoo_answers_qa", "nq_open", "triviaqa")
register("instr_label_filter", "wiki_qa")
register("instr_nested_answer", "freebase_qa", "narrativeqa")
register("instr_ltrim", "ms_marco")
register("instr_multi_turn", "coqa")
register("instr_joined_background", "pubmed_qa", "drop", "pwc")
register("instr_default_answer", "squad_v2")
register("instr_summarization", "cnn_dailymail", "dialogsum")
register("instr_crlf", "samsum")
register("instr_fact_check", "fm2")
ALL = list(instructions.SOURCES)
register("instr_union", *ALL)


@query("instr_profile", with_(u="SELECT * FROM (" + twins(*ALL) + ")")
       + "SELECT source, task_type, count(*) AS n FROM u GROUP BY ALL")
def instr_profile(t):
    return instructions.instruction_profile(instructions.instruction_table(source_shapes(t), seed=SEED))


@query(
    "background_backfill",
    with_(
        qa=QA,
        v=VECTORS,
        h="""SELECT q.vec_id AS qid, d.vec_id AS pid, list_dot_product(q.e, d.e) AS score
             FROM v q JOIN v d ON q.vec_id <> d.vec_id
             QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, d.vec_id) = 1""",
        firsts="SELECT question, min(conv_id) AS conv_id FROM qa GROUP BY question",
        found="SELECT question, d.text FROM firsts f JOIN h ON h.qid = f.conv_id JOIN documents d ON d.doc_id = h.pid",
    )
    + """SELECT 'talk_' || key AS id, CASE WHEN turn = 0 THEN found.text ELSE answer END AS background
      FROM qa LEFT JOIN found ON turn = 0 AND found.question = qa.question""",
)
def background_backfill(t):
    """Opening questions have no background; they get the text of the nearest
    document of their conversation's vector. Distinct questions are looked up once."""
    qa = qa_pairs(t)
    table = qa.select(
        F.concat(F.lit("talk_"), F.col("key").cast("string")).alias("id"),
        chat.conversation(F.col("question"), F.col("answer")).alias("messages"),
        F.lit("close_qa").alias("task_type"),
        F.when(F.col("turn") > 0, F.col("answer")).alias("background"),
    )
    asked = qa.groupBy(F.col("question").alias("query")).agg(F.min("conv_id").alias("qid"))
    encoded = asked.join(as_queries(t.embeddings), "qid")
    asking = encoded.select("qid", "embedding").dropDuplicates(["qid"])
    hits = search.exact_topk(asking, as_docs(t.embeddings), 1, exclude_self=True)
    texts = t.documents.select(F.col("doc_id").alias("pid"), "text")
    found = ranking.fetch_documents(hits, texts)
    retrieved = encoded.select("query", "qid").join(found, "qid").select("query", "text")
    return instructions.backfill_background(table, retrieved).select("id", "background")
