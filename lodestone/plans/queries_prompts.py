"""Prompts, shots, keywords and run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wording
from ..functions.text import has_answer
from ..operators import prompts
from .queries_text import QA_WITH_BACKGROUND, with_background
from .queries_vectors import DOT, all_pairs, best, topk
from .registry import QA, VECTORS, prompt_tok, query, quoted, tok, trimmed, with_

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query(
    "attach_background",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 3))
    + """SELECT qid, (list_position([3, 1], rank) - 1)::BIGINT AS pos, coalesce(text, 'vector ' || pid) AS text
      FROM h LEFT JOIN documents ON doc_id = pid WHERE rank IN (1, 3)""",
)
def attach_background(t):
    """Every vector as a question, with the texts at ranks 3 and 1."""
    texts = t.documents.select(F.col("doc_id").alias("pid"), "text")
    named = F.coalesce("text", F.concat(F.lit("vector "), F.col("pid").cast("string"))).alias("text")
    retrieved = topk(t, 3).join(texts, "pid", "left").select("qid", "rank", named)
    rows = prompts.attach_background(
        t.embeddings.select(F.col("vec_id").alias("qid")), "qid", retrieved, [3, 1]
    )
    return rows.select("qid", F.posexplode("background").alias("pos", "text"))


@query(
    "tfidf_keywords",
    with_(
        w=f"SELECT doc_id, unnest({WORDS}) AS term FROM documents",
        tf="SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL",
        df="SELECT term, count(*) AS df FROM tf GROUP BY term",
        s="""SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS score
             FROM tf JOIN df USING (term)""",
        z="""SELECT d.doc_id, first.term, 0.0 AS score
             FROM documents d CROSS JOIN (SELECT term FROM df ORDER BY term LIMIT 10) first
             WHERE NOT EXISTS (FROM tf WHERE tf.doc_id = d.doc_id AND tf.term = first.term)""",
        r="""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS place
             FROM (FROM s UNION ALL FROM z)""",
    )
    + """SELECT doc_id, string_agg(term, ' ' ORDER BY place) AS keywords FROM r WHERE place <= 5
      GROUP BY doc_id""",
)
def tfidf_keywords(t):
    return prompts.tfidf_keywords(t.documents, "doc_id", "text", 5)


@query(
    "tfidf_scores",
    with_(
        w=f"SELECT doc_id, unnest({WORDS}) AS term FROM documents",
        tf="SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL",
        df="SELECT term, count(*) AS df FROM tf GROUP BY term",
        s="""SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS score
             FROM tf JOIN df USING (term)""",
    )
    + """SELECT doc_id, term, round(score / sqrt(sum(score * score) OVER (PARTITION BY doc_id)), 6) AS weight
      FROM s""",
)
def tfidf_scores(t):
    return prompts.tfidf_scores(t.documents, "doc_id", "text").select("doc_id", "term", "weight")


def start_sql(with_retrieval: bool) -> str:
    cases = " ".join(
        f"WHEN '{task}' THEN {quoted(text)}"
        for (task, flag), text in wording.START_PROMPTS.items()
        if flag == with_retrieval
    )
    return f"CASE task {cases} END"


EXAMPLE = (
    "CASE task WHEN 'open_qa' THEN " + trimmed("'Question: ' || question || '?'")
    + " ELSE " + trimmed("'Claim: ' || question") + " END"
)
TALK_TASK = "CASE WHEN turn = 0 THEN 'open_qa' ELSE 'fact_checking' END"


def chat_sql(start: str, background: str | None) -> str:
    shown = rf"'Background: ' || {trimmed(background)} || E'\n\n' || " if background else ""
    return rf"'[INST] ' || {start} || E'\n\n' || {shown}{EXAMPLE} || ' [/INST] The answer is:'"


TALK = {
    "qa": QA,
    "b": QA_WITH_BACKGROUND,
    "c": f"SELECT *, {TALK_TASK} AS task FROM b",
    "p": f"""SELECT key, {chat_sql(start_sql(True), "background || ' ' || answer")} AS plain,
      {chat_sql(start_sql(True), "'<DOC> <DOC>'")} AS compressed, {chat_sql(start_sql(False), None)} AS bare FROM c""",
}


def talk_prompts(t):
    """(key, plain, compressed, bare): each question with two backgrounds."""
    task = F.when(F.col("turn") == 0, "open_qa").otherwise("fact_checking")
    background = F.array("background", "answer")
    none = F.array().cast("array<string>")

    def prompt(shown, embed_len=0):
        start = prompts.start_prompt(task, shown is not None)
        return prompts.full_prompt(start, none, prompts.example_prompt(task, F.col("question"), shown, embed_len))

    return with_background(t).select(
        "key",
        "question",
        "answer",
        prompt(background).alias("plain"),
        prompt(background, 1).alias("compressed"),
        prompt(None).alias("bare"),
    )


@query("prompt_build", with_(**TALK) + "SELECT key, plain, compressed, bare FROM p")
def prompt_build(t):
    return talk_prompts(t).select("key", "plain", "compressed", "bare")


@query(
    "compression_report",
    with_(**TALK)
    + " UNION ALL ".join(
        f"SELECT '{m}' AS mode, count(*) AS n, round(avg(len({prompt_tok(m)})), 6) AS mean_length FROM p"
        for m in ("plain", "compressed", "bare")
    ),
)
def compression_report(t):
    long = talk_prompts(t).unpivot(["key"], ["plain", "compressed", "bare"], "mode", "prompt")
    return prompts.compression_report(long, "mode", "prompt")


@query(
    "eval_record",
    with_(**TALK)
    + f"""SELECT 'triviaqa' AS dataset, 4::BIGINT AS batch_size, true AS include_retrieval,
      round(avg(len({prompt_tok('plain')})), 6) AS avg_prompt_length, 'some-model' AS model,
      'substring_match' AS metric,
      round(avg(contains(chr(1) || array_to_string({tok('lower(answer)')}, chr(1)) || chr(1), chr(1) || 'the' || chr(1))::INT), 6) AS score,
      'some-retriever' AS retriever FROM p JOIN b USING (key)""",
)
def eval_record(t):
    scored = talk_prompts(t).withColumn("hit", has_answer(F.array(F.lit("The")), F.col("answer")))
    return prompts.eval_record(scored, "triviaqa", "some-model", "some-retriever", 4, "plain", "hit")


@query(
    "metric_dispatch",
    """SELECT dataset, CASE dataset WHEN 'factkg' THEN 'fact_checking' ELSE 'open_qa' END AS task,
      CASE dataset WHEN 'factkg' THEN 'fact_checking_acc' WHEN 'truthfulqa' THEN 'truthfulqa_f1_rl'
      ELSE 'substring_match' END AS metric, count(*) AS n
      FROM (SELECT CASE lang WHEN 'en' THEN 'triviaqa' WHEN 'fr' THEN 'truthfulqa' WHEN 'de' THEN 'factkg'
            ELSE 'webqa' END AS dataset FROM documents) GROUP BY ALL""",
)
def metric_dispatch(t):
    dataset = (
        F.when(F.col("lang") == "en", "triviaqa")
        .when(F.col("lang") == "fr", "truthfulqa")
        .when(F.col("lang") == "de", "factkg")
        .otherwise("webqa")
    )
    rows = t.documents.select(dataset.alias("dataset"))
    return rows.groupBy(
        "dataset",
        prompts.task_of(F.col("dataset")).alias("task"),
        prompts.metric_of(F.col("dataset")).alias("metric"),
    ).agg(F.count("*").alias("n"))


# --- shots -----------------------------------------------------------------------------

DOC_SHOT = "'Question: ' || " + trimmed("source || ' ' || text") + " || '?'"
SHOTS = f"""
  SELECT lang, doc_id, {DOC_SHOT} AS shot, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place
  FROM documents QUALIFY place <= 5"""


def document_shots(t):
    shot = prompts.example_prompt(F.lit("open_qa"), F.concat_ws(" ", "source", "text"))
    return prompts.first_shots(t.documents, "doc_id", shot, 5, "lang")


@query("n_shot", with_(s=SHOTS) + "SELECT lang, place - 1 AS pos, shot FROM s")
def n_shot(t):
    return document_shots(t).select("lang", F.posexplode("shots").alias("pos", "shot"))


@query(
    "n_shot_fit",
    with_(
        s=SHOTS,
        k=rf"""SELECT doc_id, lang, len({prompt_tok(rf"'[INST] Answer the questions:' || E'\n\n' || {DOC_SHOT} || ' [/INST] The answer is:'")}) AS base,
            {DOC_SHOT} AS example FROM documents""",
        c=f"""SELECT lang, place, shot, sum(len({prompt_tok('shot')})) OVER (PARTITION BY lang ORDER BY place) AS used FROM s""",
        f="""SELECT k.doc_id, coalesce(max(place), 0) AS n_shot FROM k LEFT JOIN c ON c.lang = k.lang AND base + used <= 2048
             GROUP BY k.doc_id""",
    )
    + rf"""SELECT doc_id, n_shot, md5('[INST] Answer the questions:' || E'\n\n' || coalesce((
        SELECT string_agg(shot, E'\n\n' ORDER BY place) FROM c WHERE c.lang = k.lang AND place <= n_shot) || E'\n\n', '')
        || example || ' [/INST] The answer is:') AS prompt FROM k JOIN f USING (doc_id)""",
)
def n_shot_fit(t):
    task = F.lit("open_qa")
    example = prompts.example_prompt(task, F.concat_ws(" ", "source", "text"))
    fitted = prompts.n_shot_prompts(
        t.documents, "doc_id", prompts.start_prompt(task, False), example, document_shots(t), "lang"
    )
    return fitted.select("doc_id", "n_shot", F.md5("prompt").alias("prompt"))
