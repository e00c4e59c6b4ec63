"""Whole jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat, wording
from ..functions.text import strip, tokenize
from ..operators import examples, prompts, search, vocabulary
from ..storage import stored
from . import jobs
from .queries_text import CHUNKS, COMPRESSED, PLAIN, QA_WITH_BACKGROUND, answered_sql, numbers_joined, scratch, with_background
from .queries_vectors import CELLS, DOT, assigned_cells, best
from .registry import QA, VOCABULARY, as_docs, as_queries, joined, label_means, prompt_tok, query, quoted, tok, trimmed, with_


def chat_length(first: str) -> str:
    return f"len({prompt_tok(chr(39) + '[INST] ' + chr(39) + ' || ' + trimmed(first) + ' || ' + chr(39) + ' [/INST]' + chr(39))})"


def talk_table(t):
    return with_background(t).select(
        F.concat(F.lit("talk_"), F.col("key").cast("string")).alias("id"),
        chat.conversation(F.col("question"), F.col("answer")).alias("messages"),
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("task_type"),
        "background",
    )


@query(
    "training_table",
    with_(
        qa=QA,
        b=QA_WITH_BACKGROUND,
        s="SELECT *, 'talk_' || key AS id FROM b",
        c=f"SELECT *, {CHUNKS.format(t=tok('background'), total=1024)} AS n FROM s WHERE turn <> 2",
        q=f"""SELECT id, n, {chat_length(COMPRESSED)} AS x, {chat_length(PLAIN)} AS y,
              len({prompt_tok(trimmed('answer') + " || '</s>'")}) AS said FROM c""",
    )
    + """SELECT id, n AS chunks, least(x + said, 1024) AS n_compressed, least(y + said, 1024) AS n_plain, said AS n_live
      FROM q WHERE x + said <= 1024 AND y + said <= 1024
        OR (least(said, greatest(1024 - x, 0)) = least(said, greatest(1024 - y, 0)) AND y < 1024)""",
)
def training_table(t):
    """Talks with a document as background: filtered, encoded twice."""
    rows = jobs.training_rows(talk_table(t), excluded=["turn2"])
    return rows.select(
        "id",
        F.size("chunks").alias("chunks"),
        F.size("compressed.input_tokens").alias("n_compressed"),
        F.size("plain.input_tokens").alias("n_plain"),
        examples.live_labels(F.col("plain.labels")).alias("n_live"),
    )


def batches_sql() -> str:
    """Both views as ids: encoded, batched by the shuffled id, padded on the left."""
    special = " ".join(f"WHEN '{token}' THEN {i}" for i, token in enumerate(wording.SPECIAL_TOKENS))
    unknown = wording.SPECIAL_TOKENS.index(wording.UNK)
    parts = [
        f"""SELECT id, '{view}' AS view, {prompt_tok("'[INST] ' || " + trimmed(first) + " || ' [/INST]'")} AS head,
            {prompt_tok(trimmed('answer') + " || '</s>'")} AS said FROM c"""
        for view, first in (("compressed", COMPRESSED), ("plain", PLAIN))
    ]
    return with_(
        qa=QA,
        b=QA_WITH_BACKGROUND,
        s="SELECT *, 'talk_' || key AS id FROM b",
        c=f"SELECT *, {CHUNKS.format(t=tok('background'), total=1024)} AS n FROM s WHERE turn <> 2",
        v=" UNION ALL ".join(parts),
        live="""SELECT id, view, list_concat(head, said)[1:1024] AS tokens, len(head) AS quiet,
                least(len(said), greatest(1024 - len(head), 0)) AS n_live FROM v""",
        kept="""SELECT id FROM live GROUP BY id
                HAVING max(n_live) = min(n_live) AND min(n_live) > 0""",
        placed="SELECT id, row_number() OVER (ORDER BY md5('5:1:' || id), id) - 1 AS position FROM kept",
        vocab=VOCABULARY.format(tokens=tok("text"), table="documents"),
        flat="""SELECT id, view, quiet, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos
                FROM live JOIN kept USING (id)""",
        coded=f"""SELECT id, view, quiet, pos, CASE token {special} ELSE coalesce(token_id, {unknown}) END AS i
                  FROM flat LEFT JOIN vocab USING (token)""",
        e="""SELECT id, view, list(i ORDER BY pos) AS ids,
             list(CASE WHEN pos <= quiet THEN -100 ELSE i END ORDER BY pos) AS labels FROM coded GROUP BY id, view""",
        w="""SELECT *, position // 4 AS batch, max(len(ids)) OVER (PARTITION BY view, position // 4) AS width
             FROM e JOIN placed USING (id)""",
    ) + f"""SELECT id, view, batch, position % 4 AS slot,
      {joined('list_concat(list_resize([]::BIGINT[], width - len(ids), 0), ids)')} AS ids,
      {joined('list_concat(list_resize([]::BIGINT[], width - len(ids), -100), labels)')} AS labels,
      {joined('list_concat(list_resize([]::BIGINT[], width - len(ids), 0), list_resize([]::BIGINT[], len(ids), 1))')} AS attention_mask
      FROM w"""


@query("training_batches", batches_sql())
def training_batches(t):
    """Both views of the training table as padded ids, labels and masks."""
    rows = stored(jobs.training_rows(talk_table(t), excluded=["turn2"]))
    words = stored(vocabulary.build_vocabulary(t.documents, tokenize(F.col("text"))))
    parts = [
        jobs.training_batches(rows, view, words, 4, 5, 1).withColumn("view", F.lit(view)) for view in ("compressed", "plain")
    ]
    return parts[0].unionByName(parts[1]).select(
        "id", "view", "batch", "slot", *[numbers_joined(c).alias(c) for c in ("ids", "labels", "attention_mask")]
    )


def found_at(tokens: str, run: str) -> str:
    """Last place of a token run in a list, -1 without one."""
    return (
        f"coalesce(list_max(list_filter(range(0, len({tokens}) - len({run}) + 1),"
        f" lambda i: {tokens}[i + 1 : i + len({run})] = {run})), -1)"
    )


RESTATED = r"E'\n\nBackground: <DOC>\nThe above background document is just a paraphrase of the following: ' || background || E'\n\n'"
SHOWN_TEXT = r"E'\n\nBackground: ' || background || E'\n\n'"


@query(
    "answered_views",
    with_(
        d=f"""SELECT doc_id, 'open_qa' AS task, source || ' ' || lang AS question, n_chars::VARCHAR AS answer,
              {trimmed('text')} AS background FROM documents""",
        v=f"""SELECT doc_id, {prompt_tok('background')} AS b, {prompt_tok('answer')} AS a,
              ({prompt_tok(answered_sql(True, RESTATED))})[1:1024] AS c, ({prompt_tok(answered_sql(True, SHOWN_TEXT))})[1:1024] AS p
              FROM d""",
        s=f"""SELECT *, {found_at('c', 'a')} AS ca, {found_at('c', 'b')} AS cb, {found_at('p', 'a')} AS pa FROM v""",
    )
    + """SELECT doc_id,
      len(list_filter(range(0, len(c)), lambda i: (ca >= 0 AND i >= ca AND i < ca + len(a)) OR (ca >= 0 AND i = len(c) - 1)
        OR (cb >= 0 AND i >= cb AND i < cb + len(b)))) AS live_compressed,
      len(list_filter(range(0, len(p)), lambda i: (pa >= 0 AND i >= pa AND i < pa + len(a)) OR (pa >= 0 AND i = len(p) - 1))) AS live_plain,
      md5(array_to_string(c, ' ')) AS compressed, md5(array_to_string(p, ' ')) AS plain FROM s""",
)
def answered_views(t):
    """Answered questions over every document, in both views; the compressed one
    also restates the document."""
    rows = t.documents.select(
        "doc_id",
        F.concat_ws(" ", "source", "lang").alias("question"),
        F.col("n_chars").cast("string").alias("answer"),
        strip(F.col("text")).alias("background"),
    )
    views = jobs.answered_rows(rows, "doc_id", F.lit("open_qa"), restate=True)
    live = [examples.live_labels(F.col(f"{v}.labels")).alias(f"live_{v}") for v in ("compressed", "plain")]
    texts = [F.md5(F.array_join(f"{v}.input_tokens", " ")).alias(v) for v in ("compressed", "plain")]
    return views.select("doc_id", *live, *texts)


EVAL_QUESTION = "source || ' ' || text"
EVAL_EXAMPLE = (
    rf"'Background: ' || {trimmed(quoted('passage: ') + ' || source || ' + quoted(' passage: ') + ' || n_chars')} || E'\n\n' || "
    f"'Question: ' || {trimmed(EVAL_QUESTION)} || '?'"
)
EVAL_START = quoted(wording.START_PROMPTS[("open_qa", True)])


@query(
    "evaluation_prompts",
    with_(
        s=f"""SELECT lang, source, n_chars, {EVAL_EXAMPLE} AS shot,
              row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents QUALIFY place <= 5""",
        k=rf"""SELECT doc_id, lang, source, n_chars, {EVAL_EXAMPLE} AS example,
               len({prompt_tok(rf"'[INST] ' || {EVAL_START} || E'\n\n' || {EVAL_EXAMPLE} || ' [/INST] The answer is:'")}) AS base
               FROM documents""",
        c=f"""SELECT *, sum(len({prompt_tok('shot')})) OVER (PARTITION BY lang ORDER BY place) AS used FROM s""",
        f="""SELECT k.doc_id, coalesce(max(place), 0) AS n_shot FROM k LEFT JOIN c ON c.lang = k.lang AND base + used <= 2048
             GROUP BY k.doc_id""",
    )
    + rf"""SELECT doc_id, n_shot, 2 * (n_shot + 1) AS n_background,
        md5('[INST] ' || {EVAL_START} || E'

' || coalesce((
          SELECT string_agg(shot, E'

' ORDER BY place) FROM c WHERE c.lang = k.lang AND place <= n_shot) || E'

', '')
          || example || ' [/INST] The answer is:') AS prompt,
        md5('passage: ' || source || '|passage: ' || n_chars || coalesce((
          SELECT '|' || string_agg('passage: ' || source || '|passage: ' || n_chars, '|' ORDER BY place)
          FROM c WHERE c.lang = k.lang AND place <= n_shot), '')) AS backgrounds
      FROM k JOIN f USING (doc_id)""",
)
def evaluation_prompts(t):
    """Every document as a question, with two retrieved texts and up to five
    shots of its language, which bring their own."""
    question = F.concat_ws(" ", "source", "text").alias("question")
    rows = t.documents.select("doc_id", "lang", question)
    texts = F.array("source", F.col("n_chars").cast("string"))
    retrieved = t.documents.select("doc_id", F.posexplode(texts).alias("at", "text"))
    retrieved = retrieved.select("doc_id", (F.col("at") + 1).alias("rank"), "text")
    first = prompts.first_shots(
        t.documents, "doc_id", F.struct("doc_id", question, F.transform(texts, lambda x: F.concat(F.lit("passage: "), x)).alias("background")), 5, "lang"
    )
    dev = first.select("lang", F.inline("shots"))
    found = jobs.evaluation_prompts(
        rows, "doc_id", F.lit("open_qa"), retrieved, [1, 2], retriever="intfloat/E5-large-v2", dev=dev, subject="lang"
    )
    return found.select(
        "doc_id", "n_shot", F.size("background").alias("n_background"), F.md5("prompt").alias("prompt"),
        F.md5(F.array_join("background", "|")).alias("backgrounds"),
    )


@query(
    "retrieval_run",
    with_(
        **CELLS,
        p="""SELECT n.vec_id AS qid, a.vec_id AS pid, pow(list_distance(n.e, a.e), 2) AS score
             FROM nearest n JOIN assigned a USING (cell) WHERE n.place <= 2 AND n.vec_id <> a.vec_id""",
        h=best("p", 8, "ASC"),
        c="SELECT DISTINCT qid // 10 AS qid, pid // 10 AS pid FROM h",
        m=f"""SELECT c.qid, c.pid, q.vec_id, greatest(max({DOT}), 0) AS s FROM c
              JOIN v q ON q.vec_id // 10 = c.qid JOIN v d ON d.vec_id // 10 = c.pid GROUP BY ALL""",
        s="SELECT qid, pid, sum(s) AS score FROM m GROUP BY ALL",
        r=best("s", 20),
    )
    + "SELECT qid, pid, rank, round(score, 6) AS score FROM r",
)
def retrieval_run(t):
    """Ten consecutive vectors are the tokens of a document, and of a query."""
    tokens = t.embeddings.select(
        F.expr("vec_id div 10").alias("pid"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        F.col("vec_id").alias("vec"),
        "embedding",
    )
    centroids = label_means(t.embeddings)
    return jobs.retrieval_run(
        tokens.withColumnRenamed("pid", "qid"),
        tokens,
        assigned_cells(t, centroids),
        centroids,
        search_k=8,
        nprobe=2,
        save_k=20,
        exclude_self=True,
        store=scratch(t, "candidates"),
    )


@query(
    "validate_candidates",
    with_(
        **CELLS,
        p="""SELECT n.vec_id AS qid, a.vec_id AS pid, pow(list_distance(n.e, a.e), 2) AS score
             FROM nearest n JOIN assigned a USING (cell) WHERE n.place <= 2 AND n.vec_id <> a.vec_id""",
        c=best("p", 30, "ASC"),
        s=f"SELECT qid, pid, {DOT} AS score FROM c JOIN v q ON q.vec_id = qid JOIN v d ON d.vec_id = pid",
        h=best("s", 30),
    )
    + """SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_at_10
      FROM (SELECT DISTINCT qid FROM c) a LEFT JOIN h ON h.qid = a.qid AND h.pid = a.qid + 1""",
)
def validate_candidates(t):
    """Candidates from two cells; the next vector is the one judged positive."""
    centroids = label_means(t.embeddings)
    queries, docs = as_queries(t.embeddings), as_docs(t.embeddings)
    found = search.probe_topk(queries, assigned_cells(t, centroids), centroids, 30, 2, exclude_self=True)
    qrels = t.embeddings.select("vec_id", F.col("vec_id").alias("pid")).select(
        (F.col("vec_id") - 1).alias("qid"), "pid"
    )
    path = scratch(t, "candidates")
    found.select("qid", "pid").write.parquet(path)
    return jobs.validate_candidates(t.spark.read.parquet(path), qrels, queries, docs)
