"""Files, tokens, chunks, chats and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat, wording
from ..functions.choice import fill, pick
from ..functions.text import last_subsequence, stop_truncate, strip, tokenize
from ..operators.joins import lookup_join
from ..operators import answers, examples, ordering, prompts, vocabulary
from ..sources import files
from ..storage import shared_folder
from .registry import (
    QA,
    Tables,
    VOCABULARY,
    choice,
    joined,
    prompt_tok,
    qa_pairs,
    query,
    quoted,
    tok,
    trimmed,
    with_,
)

LOWER_TOKENS = tok("lower(text)")


def words_joined(column) -> F.Column:
    return F.array_join(F.col(column) if isinstance(column, str) else column, " ")


def numbers_joined(column) -> F.Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), " ")


def scratch(t: Tables, name: str) -> str:
    """A fresh folder under the checkpoint folder of the session."""
    return shared_folder(t.spark, name)


# --- files -----------------------------------------------------------------------------


@query("read_jsonl", "SELECT doc_id::VARCHAR AS id, text FROM documents")
def read_jsonl(t):
    path = scratch(t, "jsonl")
    files.write_jsonl(t.documents.select(F.col("doc_id").cast("string").alias("id"), "text"), path)
    return files.read_jsonl(t.spark, path, files.schemas.PRETRAIN_DOCUMENT)


@query(
    "passage_format",
    "SELECT doc_id AS pid, source || ' | ' || text AS passage FROM documents WHERE length(text) >= 1",
)
def passage_format(t):
    raw = t.documents.select(
        F.col("doc_id").alias("pid"), F.col("text").alias("passage"), F.col("source").alias("title")
    )
    return files.usable_passages(raw)


@query("wiki_format", """SELECT doc_id AS pid, source || ' ' || trim(text, '"') AS passage FROM documents""")
def wiki_format(t):
    return t.documents.select(
        F.col("doc_id").alias("pid"), files.wiki_text(F.col("source"), F.col("text")).alias("passage")
    )


@query("collection_head", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 500")
def collection_head(t):
    return ordering.head_n(t.documents.select("doc_id", "source"), "doc_id", 500)


# --- tokens and ids ----------------------------------------------------------------------


@query(
    "simple_tokenize",
    f"""SELECT doc_id, len(cased) AS n_tokens, {joined('cased')} AS cased, {joined('uncased')} AS uncased
    FROM (SELECT doc_id, {tok('text')} AS cased, {LOWER_TOKENS} AS uncased FROM documents)""",
)
def simple_tokenize(t):
    tokens = t.documents.select(
        "doc_id", tokenize(F.col("text")).alias("cased"), tokenize(F.col("text"), uncased=True).alias("uncased")
    )
    return tokens.select(
        "doc_id",
        F.size("cased").alias("n_tokens"),
        words_joined("cased").alias("cased"),
        words_joined("uncased").alias("uncased"),
    )


def document_vocabulary(t):
    return vocabulary.build_vocabulary(t.documents, tokenize(F.col("text"), uncased=True))


DOCUMENT_VOCABULARY = VOCABULARY.format(tokens=LOWER_TOKENS, table="documents")
TURN_VOCABULARY = VOCABULARY.format(tokens=LOWER_TOKENS, table="conversations")


@query("vocab_build", DOCUMENT_VOCABULARY)
def vocab_build(t):
    return document_vocabulary(t)


def encoded_sql(table: str, keys: str, width: int) -> str:
    """(keys, ids) as a list, ids in token order."""
    return f"""
      SELECT {keys}, list(token_id ORDER BY pos) AS ids FROM (
        SELECT {keys}, unnest(k) AS token, generate_subscripts(k, 1) AS pos
        FROM (SELECT {keys}, ({LOWER_TOKENS})[1:{width}] AS k FROM {table})) x
      JOIN vocab USING (token) GROUP BY {keys}"""


@query(
    "encode_ids",
    with_(vocab=DOCUMENT_VOCABULARY, e=encoded_sql("documents", "doc_id", 180))
    + f"SELECT doc_id, len(ids) AS n_ids, {joined('ids')} AS ids FROM e",
)
def encode_ids(t):
    ids = vocabulary.encode(
        t.documents, ["doc_id"], tokenize(F.col("text"), uncased=True), document_vocabulary(t), 180
    )
    return ids.select("doc_id", F.size("ids").alias("n_ids"), numbers_joined("ids").alias("ids"))


@query(
    "pad_fixed",
    with_(vocab=DOCUMENT_VOCABULARY, e=encoded_sql("documents", "doc_id", 180))
    + f"""SELECT doc_id, least(len(ids) + 1, 180) AS n_real,
      {joined('list_resize(list_concat([4], ids)[1:180], 180, 0)')} AS ids FROM e""",
)
def pad_fixed(t):
    ids = vocabulary.encode(
        t.documents, ["doc_id"], tokenize(F.col("text"), uncased=True), document_vocabulary(t), 180
    )
    wide = ids.withColumn("ids", vocabulary.document_input(F.col("ids")))
    real = F.size(F.filter("ids", lambda i: i != vocabulary.SPECIAL_IDS[wording.PAD]))
    return wide.select("doc_id", real.alias("n_real"), numbers_joined("ids").alias("ids"))


@query(
    "query_augment",
    with_(vocab=TURN_VOCABULARY, e=encoded_sql("conversations", "conv_id, turn", 32))
    + f"""SELECT conv_id, turn, least(len(ids) + 1, 32) AS n_attended,
      {joined('list_resize(list_concat([3], ids)[1:32], 32, 2)')} AS ids FROM e""",
)
def query_augment(t):
    words = vocabulary.build_vocabulary(t.conversations, tokenize(F.col("text"), uncased=True))
    ids = vocabulary.encode(
        t.conversations, ["conv_id", "turn"], tokenize(F.col("text"), uncased=True), words, 32
    )
    wide = ids.withColumn("ids", vocabulary.query_input(F.col("ids")))
    attended = vocabulary.attention(F.col("ids"), vocabulary.SPECIAL_IDS[wording.MASK])
    return wide.select(
        "conv_id",
        "turn",
        F.aggregate(attended, F.lit(0), lambda a, b: a + b).alias("n_attended"),
        numbers_joined("ids").alias("ids"),
    )


@query(
    "passage_prefix",
    "SELECT doc_id, 'passage: ' || text AS prefixed, text || '</s>' AS ended, text AS plain FROM documents",
)
def passage_prefix(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        prompts.passage_text(text, "intfloat/e5-large-v2").alias("prefixed"),
        prompts.passage_text(text, "intfloat/e5-mistral-7b-instruct").alias("ended"),
        prompts.passage_text(text, "some-other-retriever").alias("plain"),
    )


@query("stop_truncate", r"SELECT doc_id, regexp_extract(text, '^[^\n.,]*[\n.,]?') AS answer FROM documents")
def stop_truncate_query(t):
    return t.documents.select("doc_id", stop_truncate(F.col("text")).alias("answer"))


# --- chats ----------------------------------------------------------------------------------

INST_SEGMENT = f"""CASE role WHEN 'user' THEN '[INST] ' || {{body}} || ' [/INST]'
  WHEN 'assistant' THEN {{body}} || '</s>' END"""
STRIPPED_INST = INST_SEGMENT.format(body=trimmed("text"))
TAG_SEGMENT = rf"""CASE role WHEN 'system' THEN E'<|system|>\n' || {trimmed('text')} || E'\n'
  WHEN 'user' THEN E'<|user|>\n' || {trimmed('text')} || E'\n'
  WHEN 'assistant' THEN E'<|assistant|>\n' || {trimmed('text')} || E'</s>\n' END"""


def spans_sql(segment: str, where: str) -> str:
    before = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
      SELECT conv_id, turn, segment, n_tokens,
        coalesce(sum(length(segment)) {before}, 0)::BIGINT AS char_start,
        coalesce(sum(n_tokens) {before}, 0)::BIGINT AS token_start
      FROM (SELECT conv_id, turn, segment, len({prompt_tok('segment')}) AS n_tokens
            FROM (SELECT conv_id, turn, {segment} AS segment FROM conversations {where}))"""


#: Conversations without a system turn; a style without one can't show the others.
SHOWN = "WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')"


def talk(t, system: bool):
    """Turns of the conversations that a style with or without system turns can show."""
    turns = t.conversations.withColumnRenamed("text", "content")
    return turns if system else turns.join(rejected(t), "conv_id", "left_anti")


def rejected(t):
    """Ids of the conversations with a turn of a role that the style doesn't know."""
    return t.conversations.filter("role NOT IN ('user', 'assistant')").select("conv_id").distinct()


@query(
    "chat_rejected",
    """SELECT conv_id, count(*) AS n_turns, sum((role = 'system')::INT)::BIGINT AS n_unknown FROM conversations
      GROUP BY conv_id HAVING sum((role = 'system')::INT) > 0""",
)
def chat_rejected(t):
    """What a style without system turns refuses: whole conversations, by id."""
    unknown = F.sum(F.when(F.col("role").isin("user", "assistant"), 0).otherwise(1)).alias("n_unknown")
    counted = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), unknown)
    return counted.filter("n_unknown > 0")


def spans(t, style, system):
    rows = examples.turn_spans(talk(t, system), "conv_id", "turn", style)
    return rows.select("conv_id", "turn", "segment", "n_tokens", "char_start", "token_start")


@query("chat_render_inst", spans_sql(STRIPPED_INST, SHOWN))
def chat_render_inst(t):
    return spans(t, chat.INSTRUCT, system=False)


@query("chat_render_verbatim", spans_sql(INST_SEGMENT.format(body="text"), SHOWN))
def chat_render_verbatim(t):
    return spans(t, chat.INSTRUCT_VERBATIM, system=False)


@query("chat_render_tags", spans_sql(TAG_SEGMENT, ""))
def chat_render_tags(t):
    return spans(t, chat.TAGGED, system=True)


def mask_sql(segment: str, where: str, quiet: str, max_len: int) -> str:
    return f"""
      WITH turns AS (SELECT conv_id, turn, role, {prompt_tok(segment)} AS tokens,
          lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations {where}),
      flat AS (SELECT conv_id, turn, role, previous, unnest(tokens) AS token,
          generate_subscripts(tokens, 1) AS pos FROM turns),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS place,
          CASE WHEN {quiet} THEN '-100' ELSE token END AS label FROM flat)
      SELECT conv_id, count(*) AS n_tokens, sum((label <> '-100')::INT)::BIGINT AS n_live,
        string_agg(token, ' ' ORDER BY place) AS input_tokens, string_agg(label, ' ' ORDER BY place) AS labels
      FROM placed WHERE place <= {max_len} GROUP BY conv_id"""


def masked(rows, key):
    return rows.select(
        key,
        F.size("input_tokens").alias("n_tokens"),
        examples.live_labels(F.col("labels")).alias("n_live"),
        words_joined("input_tokens").alias("input_tokens"),
        words_joined("labels").alias("labels"),
    )


@query("chat_label_mask", mask_sql(STRIPPED_INST, SHOWN, "role <> 'assistant'", 1024))
def chat_label_mask(t):
    return masked(
        examples.chat_label_mask(talk(t, False), "conv_id", "turn", chat.INSTRUCT, 1024), "conv_id"
    )


@query(
    "chat_label_mask_tags",
    mask_sql(TAG_SEGMENT, "", "role <> 'assistant' OR (previous <> 'assistant' AND pos <= 5)", 1024),
)
def chat_label_mask_tags(t):
    return masked(examples.chat_label_mask(talk(t, True), "conv_id", "turn", chat.TAGGED, 1024), "conv_id")


@query(
    "filter_has_label",
    with_(m=mask_sql(STRIPPED_INST, SHOWN, "role <> 'assistant'", 1024))
    + "SELECT conv_id, n_live FROM m WHERE n_live > 0",
)
def filter_has_label(t):
    rows = examples.chat_label_mask(talk(t, False), "conv_id", "turn", chat.INSTRUCT, 1024)
    kept = rows.filter(examples.has_live_label(F.col("labels")))
    return kept.select("conv_id", examples.live_labels(F.col("labels")).alias("n_live"))


# --- masks on one row -------------------------------------------------------------------------

QA_WITH_BACKGROUND = """
  SELECT d.doc_id AS key, qa.conv_id, qa.turn, qa.question, qa.answer, d.text AS background
  FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY key) - 1 AS place FROM qa) qa
  ON qa.place = d.doc_id % (SELECT count(*) FROM qa)"""


def with_background(t):
    """Every document as the background of a question and answer pair; the
    pairs are dealt out to the documents in turn."""
    pairs = qa_pairs(t)
    placed = ordering.with_position(pairs, [F.col("key")], ordering.range_bucket(pairs, "key"), name="place")
    docs = t.documents.select("doc_id", F.col("text").alias("background"))
    dealt = docs.withColumn("place", F.pmod("doc_id", F.lit(max(1, pairs.count()))))
    # the texts stay where they were read, spread over all cores, if the pairs, whole chat turns, are few;
    # else texts and pairs move once
    return lookup_join(dealt, placed.drop("key"), ["place"], [F.col("doc_id")], rows=4096).select(
        F.col("doc_id").alias("key"), "conv_id", "turn", "question", "answer", "background"
    )


def head_mask_sql(tokens: str, quiet: str) -> str:
    """Labels where the first ``quiet`` tokens are ignored."""
    return f"""list_transform({tokens}, lambda x, i: CASE WHEN i <= {quiet} THEN '-100' ELSE x END)"""


LIVE = "len(list_filter(labels, lambda x: x <> '-100'))"
FULL_PROMPT = rf"trim('Background: ' || background || E'\n\n' || question, E' \t\n\r')"


@query(
    "prompt_completion_mask",
    with_(
        qa=QA,
        b=QA_WITH_BACKGROUND,
        p=f"""SELECT key, ({prompt_tok(FULL_PROMPT + " || ' ' || " + trimmed('answer') + " || '</s>'")})[1:1024] AS k,
              len({prompt_tok(FULL_PROMPT)}) AS quiet FROM b""",
        m=f"SELECT key, k AS input_tokens, {head_mask_sql('k', 'quiet')} AS labels FROM p",
    )
    + f"""SELECT key, len(input_tokens) AS n_tokens, {LIVE} AS n_live, {joined('input_tokens')} AS input_tokens,
      {joined('labels')} AS labels FROM m""",
)
def prompt_completion_mask(t):
    example = examples.prompt_completion(F.col("background"), F.col("question"), F.col("answer"))
    return masked(with_background(t).select("key", example.alias("x")).select("key", "x.*"), "key")


FOUND = f"""
  SELECT b.item_id, d.doc_id, b.k AS answer_tokens, d.k AS doc_tokens
  FROM (SELECT item_id, {LOWER_TOKENS} AS k FROM benchmark WHERE len({LOWER_TOKENS}) > 0) b
  JOIN (SELECT doc_id, {LOWER_TOKENS} AS k FROM documents) d
  ON contains(chr(1) || array_to_string(d.k, chr(1)) || chr(1), chr(1) || array_to_string(b.k, chr(1)) || chr(1))
"""


@query(
    "has_answer",
    with_(found=FOUND)
    + f"""SELECT item_id, doc_id FROM found
      UNION ALL SELECT item_id, NULL FROM benchmark WHERE len({LOWER_TOKENS}) = 0""",
)
def has_answer(t):
    return answers.find_answers(
        t.documents, t.benchmark.select("item_id", F.col("text").alias("answer"))
    )


@query(
    "last_subsequence",
    with_(found=FOUND)
    + """SELECT item_id, doc_id, list_max(list_filter(range(0, len(doc_tokens) - len(answer_tokens) + 1),
      lambda i: doc_tokens[i + 1 : i + len(answer_tokens)] = answer_tokens)) AS start FROM found""",
)
def last_subsequence_query(t):
    items = t.benchmark.select("item_id", F.col("text").alias("answer"))
    pairs = answers.find_answers(t.documents, items)
    both = pairs.join(items, "item_id").join(t.documents.select("doc_id", "text"), "doc_id")
    start = last_subsequence(tokenize(F.col("text"), True), tokenize(F.col("answer"), True))
    return both.select("item_id", "doc_id", start.cast("bigint").alias("start"))


SPAN_PROMPT = rf"'Answer the questions:Q: ' || {trimmed('text')} || E'?\nA: ' || source"


@query(
    "span_label_mask",
    with_(
        p=f"SELECT doc_id, ({prompt_tok(SPAN_PROMPT)})[1:1024] AS k, {prompt_tok('source')} AS a FROM documents",
        s="""SELECT doc_id, k, len(a) AS m, coalesce(list_max(list_filter(range(0, len(k) - len(a) + 1),
             lambda i: k[i + 1 : i + len(a)] = a)), -1) AS start FROM p""",
        m="""SELECT doc_id, start, list_transform(k, lambda x, i: CASE WHEN start >= 0 AND
             ((i > start AND i <= start + m) OR i = len(k)) THEN x ELSE '-100' END) AS labels FROM s""",
    )
    + f"SELECT doc_id, start, {LIVE} AS n_live, {joined('labels')} AS labels FROM m",
)
def span_label_mask(t):
    prompt = examples.answered_prompt(F.lit("open_qa"), F.col("text"), F.col("source"))
    rows = t.documents.select("doc_id", examples.answer_example(prompt, F.col("source")).alias("x"), "source")
    return rows.select(
        "doc_id",
        last_subsequence(F.col("x.input_tokens"), chat.message_tokens(F.col("source"))).alias("start"),
        examples.live_labels(F.col("x.labels")).alias("n_live"),
        words_joined("x.labels").alias("labels"),
    )


def instruction_sql(key: str, seed: str, run: str) -> str:
    return f"replace({choice(wording.PARAPHRASE_INSTRUCTIONS, seed, key)}, '{{doc}}', {run})"


@query(
    "pretrain_completion",
    with_(
        p=f"""SELECT doc_id, {prompt_tok(instruction_sql('doc_id', 'restate', "'<DOC>'"))} AS head,
              {prompt_tok(trimmed('text'))} AS body FROM documents""",
        q="SELECT doc_id, len(head) AS h, list_concat(head, body)[1:336] AS k FROM p",
        m="""SELECT doc_id, k AS input_tokens, list_transform(k, lambda x, i:
             CASE WHEN i <= h OR x = '<DOC>' THEN '-100' ELSE x END) AS labels FROM q""",
    )
    + f"""SELECT doc_id, len(input_tokens) AS n_tokens, {LIVE} AS n_live, {joined('input_tokens')} AS input_tokens,
      {joined('labels')} AS labels FROM m""",
)
def pretrain_completion(t):
    example = examples.paraphrase_completion(F.col("text"), F.col("doc_id"), "restate")
    return masked(t.documents.select("doc_id", example.alias("x")).select("doc_id", "x.*"), "doc_id")


CHUNKS = """
  (greatest(ceil(least(len({t}), {total}) / 180.0), 1)
   - CASE WHEN ceil(least(len({t}), {total}) / 180.0) > 1 AND (least(len({t}), {total}) - 1) % 180 + 1 <= 20
     THEN 1 ELSE 0 END)::BIGINT"""


@query(
    "split_background",
    with_(
        k=f"SELECT doc_id, ({tok('text')})[1:1024] AS k FROM documents",
        c="SELECT doc_id, k, unnest(range(0, greatest(len(k), 1), 180)) AS s FROM k",
    )
    + f"""SELECT doc_id, (s // 180)::BIGINT AS chunk_no, len(k[s + 1 : s + 180]) AS n_tokens,
      {joined('k[s + 1 : s + 180]')} AS chunk FROM c WHERE s = 0 OR len(k) - s > 20""",
)
def split_background(t):
    chunks = examples.split_background(t.documents, ["doc_id"], tokenize(F.col("text")))
    return chunks.select("doc_id", "chunk_no", F.size("chunk").alias("n_tokens"), words_joined("chunk").alias("chunk"))


@query(
    "paraphrase_pairs",
    with_(
        p=f"""SELECT doc_id, {instruction_sql('doc_id', 'restate', "'<DOC> <DOC>'")} AS instruction,
              {trimmed('text')} AS document FROM documents""",
        c=f"""SELECT *, len({prompt_tok("'[INST] ' || trim(instruction) || ' [/INST]'")}) AS quiet,
              len({prompt_tok("document || '</s>'")}) AS said FROM p""",
    )
    + """SELECT doc_id, instruction, document, least(quiet + said, 336) AS n_tokens,
      greatest(least(quiet + said, 336) - quiet, 0) AS n_live FROM c""",
)
def paraphrase_pairs(t):
    messages = examples.paraphrase_messages(F.col("text"), F.col("doc_id"), "restate", embed_len=2)
    rows = t.documents.select("doc_id", messages.alias("m"))
    example = examples.messages_label_mask(F.col("m"), max_len=336)
    flat = rows.select("doc_id", "m", example.alias("x")).select("doc_id", "m", "x.*")
    return flat.select(
        "doc_id",
        F.col("m")[0]["content"].alias("instruction"),
        F.col("m")[1]["content"].alias("document"),
        F.size("input_tokens").alias("n_tokens"),
        examples.live_labels(F.col("labels")).alias("n_live"),
    )


CHAT_SQL = (
    "'[INST] ' || " + trimmed("{first}") + " || ' [/INST]' || " + trimmed("answer") + " || '</s>'"
)
COMPRESSED = r"'Refer to the background document: ' || trim(repeat('<DOC> ', n)) || E'\n\n' || question"
PLAIN = r"'Refer to the background document: ' || background || E'\n\n' || question"


@query(
    "rag_dual_view",
    with_(
        qa=QA,
        b=QA_WITH_BACKGROUND,
        c=f"SELECT *, {CHUNKS.format(t=tok('background'), total=1024)} AS n FROM b",
    )
    + f"""SELECT key, n AS placeholders, {CHAT_SQL.format(first=COMPRESSED)} AS compressed,
      {CHAT_SQL.format(first=PLAIN)} AS plain FROM c""",
)
def rag_dual_view(t):
    messages = chat.conversation(F.col("question"), F.col("answer"))
    compressed, plain = examples.dual_views(messages, F.col("background"))
    rows = with_background(t).select(
        "key", chat.render(compressed).alias("compressed"), chat.render(plain).alias("plain")
    )
    return rows.select(
        "key", prompts.placeholder_count(F.col("compressed")).alias("placeholders"), "compressed", "plain"
    )


@query(
    "filter_equal_labels",
    with_(
        qa=QA,
        b=QA_WITH_BACKGROUND,
        c=f"SELECT *, {CHUNKS.format(t=tok('background'), total=1024)} AS n FROM b",
        q=f"""SELECT key, len({prompt_tok("'[INST] ' || " + trimmed(COMPRESSED) + " || ' [/INST]'")}) AS x,
              len({prompt_tok("'[INST] ' || " + trimmed(PLAIN) + " || ' [/INST]'")}) AS y,
              len({prompt_tok(trimmed('answer') + " || '</s>'")}) AS said FROM c""",
    )
    + """SELECT key, least(said, greatest(1024 - x, 0)) AS n_live FROM q
      WHERE least(said, greatest(1024 - x, 0)) = least(said, greatest(1024 - y, 0))
        AND least(said, greatest(1024 - y, 0)) > 0""",
)
def filter_equal_labels(t):
    messages = chat.conversation(F.col("question"), F.col("answer"))
    kept = with_background(t).select("key", F.inline(examples.encoded_views(messages, F.col("background"))))
    return kept.select("key", examples.live_labels(F.col("compressed.labels")).alias("n_live"))


TASK = "CASE lang WHEN 'en' THEN 'open_qa' WHEN 'fr' THEN 'fact_checking' ELSE 'multiple_choice' END"


def answered_sql(with_background: bool, before: str) -> str:
    starts = " ".join(
        f"WHEN '{task}' THEN {quoted(text)}"
        for (task, flag), text in wording.START_PROMPTS.items()
        if flag == with_background
    )
    bodies = " ".join(
        f"WHEN '{task}' THEN " + quoted(text).replace("{question}", "' || question || '").replace("{answer}", "' || answer || '")
        for task, text in wording.ANSWERED_PROMPTS.items()
    )
    return f"(CASE task {starts} END) || {before} || (CASE task {bodies} END)"


@query(
    "qa_format",
    with_(
        d=f"""SELECT doc_id, {TASK} AS task, source || ' ' || lang AS question, n_chars::VARCHAR AS answer,
              {trimmed('text')} AS background FROM documents"""
    )
    + rf"""SELECT doc_id,
      {answered_sql(True, r"E'\n\nBackground: <DOC>\n\n'")} AS compressed,
      {answered_sql(True, r"E'\n\nBackground: ' || background || E'\n\n'")} AS plain,
      {answered_sql(True, r"E'\n\nBackground: <DOC>\nThe above background document is just a paraphrase of the following: ' || background || E'\n\n'")} AS restated,
      {answered_sql(False, "''")} AS bare FROM d""",
)
def qa_format(t):
    task = (
        F.when(F.col("lang") == "en", "open_qa")
        .when(F.col("lang") == "fr", "fact_checking")
        .otherwise("multiple_choice")
    )
    question, answer = F.concat_ws(" ", "source", "lang"), F.col("n_chars").cast("string")
    run, text = chat.placeholder_run(1), F.col("text")
    return t.documents.select(
        "doc_id",
        examples.answered_prompt(task, question, answer, run).alias("compressed"),
        examples.answered_prompt(task, question, answer, text).alias("plain"),
        examples.answered_prompt(task, question, answer, run, text).alias("restated"),
        examples.answered_prompt(task, question, answer).alias("bare"),
    )


def instructed_sql(seed: str, background: str) -> str:
    template = choice(wording.RAG_INSTRUCTIONS, seed, "key")
    return f"replace({template}, '{{background}}', {background}) || {trimmed('question')}"


@query(
    "completion_dual_view",
    with_(
        qa=QA,
        b=QA_WITH_BACKGROUND,
        c=f"SELECT *, {CHUNKS.format(t=tok(trimmed('background')), total=1024)} AS n FROM b",
        v=f"""SELECT key, answer, {instructed_sql('short', "trim(repeat('<DOC> ', n))")} AS compressed,
              {instructed_sql('long', trimmed('background'))} AS plain FROM c""",
    )
    + f"""SELECT key, compressed, plain,
      greatest(least(len({prompt_tok("compressed || ' ' || " + trimmed('answer'))}), 1024) - len({prompt_tok('compressed')}), 0) AS live_compressed,
      greatest(least(len({prompt_tok("plain || ' ' || " + trimmed('answer'))}), 1024) - len({prompt_tok('plain')}), 0) AS live_plain
      FROM v""",
)
def completion_dual_view(t):
    background = strip(F.col("background"))
    run = chat.placeholder_run(examples.chunk_count(tokenize(background)))
    rows = with_background(t).select(
        "key",
        strip(F.col("answer")).alias("answer"),
        examples.instructed_prompt(F.col("question"), run, F.col("key"), "short").alias("compressed"),
        examples.instructed_prompt(F.col("question"), background, F.col("key"), "long").alias("plain"),
    )

    def live(view):
        whole = F.concat_ws(" ", F.col(view), F.col("answer"))
        return examples.live_labels(examples.prompt_masked(whole, F.col(view), 1024)["labels"])

    return rows.select(
        "key", "compressed", "plain", live("compressed").alias("live_compressed"), live("plain").alias("live_plain")
    )


# --- rows and batches ------------------------------------------------------------------------------


@query("sample_n", "SELECT doc_id FROM documents ORDER BY md5('980406:0:' || doc_id), doc_id LIMIT 300")
def sample_n(t):
    return ordering.sample_n(t.documents.select("doc_id"), "doc_id", 300, 980406)


@query("exclude_types", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('de', 'es')")
def exclude_types(t):
    from ..operators.instructions import exclude_types as exclude

    return exclude(t.documents.select("doc_id", "lang"), ["de", "es"], "lang")


@query("head_samples", with_(qa=QA) + "SELECT key, question FROM qa ORDER BY key LIMIT 100")
def head_samples(t):
    return ordering.head_n(qa_pairs(t).select("key", "question"), "key", 100)


@query(
    "seeded_shuffle",
    """SELECT doc_id, row_number() OVER (ORDER BY md5('12345:2:' || doc_id), doc_id) - 1 AS position
    FROM documents""",
)
def seeded_shuffle(t):
    return ordering.seeded_shuffle(t.documents.select("doc_id"), "doc_id", 12345, epoch=2)


@query(
    "collate_pad",
    with_(
        vocab=TURN_VOCABULARY,
        e=encoded_sql("conversations", "conv_id, turn, role", 1024),
        r="""SELECT conv_id * 1000000 + turn AS key, ids,
             list_transform(ids, lambda i: CASE WHEN role = 'assistant' THEN i ELSE -100 END) AS labels FROM e""",
        b="SELECT *, row_number() OVER (ORDER BY md5('7:0:' || key), key) - 1 AS position FROM r",
        w="SELECT *, position // 4 AS batch, max(len(ids)) OVER (PARTITION BY position // 4) AS width FROM b",
    )
    + f"""SELECT key, batch, position % 4 AS slot, width AS width,
      {joined('list_concat(list_resize([]::BIGINT[], width - len(ids), 0), ids)')} AS ids,
      {joined('list_concat(list_resize([]::BIGINT[], width - len(ids), -100), labels)')} AS labels,
      {joined('list_concat(list_resize([]::BIGINT[], width - len(ids), 0), list_resize([]::BIGINT[], len(ids), 1))')} AS attention_mask
      FROM w""",
)
def collate_pad(t):
    turns = t.conversations
    words = vocabulary.build_vocabulary(turns, tokenize(F.col("text"), uncased=True))
    ids = vocabulary.encode(
        turns, ["conv_id", "turn", "role"], tokenize(F.col("text"), uncased=True), words, 1024
    )
    labels = F.when(F.col("role") == "assistant", F.col("ids")).otherwise(
        F.array_repeat(F.lit(wording.IGNORED_LABEL), F.size("ids"))
    )
    rows = ids.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("key"), "ids", labels.alias("labels")
    )
    keys = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("key"))
    batches = examples.collate(examples.with_batch(rows, "key", 4, 7, source=keys))
    return batches.select(
        "key",
        "batch",
        "slot",
        F.size("ids").alias("width"),
        numbers_joined("ids").alias("ids"),
        numbers_joined("labels").alias("labels"),
        numbers_joined("attention_mask").alias("attention_mask"),
    )


@query(
    "trim_padding",
    with_(
        vocab=DOCUMENT_VOCABULARY,
        e=encoded_sql("documents", "doc_id", 180),
        b="""SELECT doc_id, list_concat([4], ids)[1:180] AS ids,
             (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM e""",
        w="SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM b",
    )
    + f"SELECT doc_id, batch, width, {joined('list_resize(ids, width, 0)')} AS ids FROM w",
)
def trim_padding(t):
    ids = vocabulary.encode(
        t.documents, ["doc_id"], tokenize(F.col("text"), uncased=True), document_vocabulary(t), 180
    )
    wide = ids.select("doc_id", vocabulary.document_input(F.col("ids")).alias("ids"))
    batched = examples.with_batch(wide, "doc_id", 8, 0, shuffle=False, source=t.documents)
    trimmed_rows = examples.trim_padding(batched)
    return trimmed_rows.select(
        "doc_id", "batch", F.size("ids").alias("width"), numbers_joined("ids").alias("ids")
    )


@query(
    "template_assign",
    f"""SELECT doc_id, replace({choice(wording.QA_TEMPLATES, 'qa', 'doc_id')}, '{{question}}', text) AS question,
      {choice(wording.SUMMARY_TEMPLATES, 'sum', 'doc_id')} AS summary,
      replace({quoted(wording.FACT_CHECK_TEMPLATES[0])}, '{{question}}', source) AS claim FROM documents""",
)
def template_assign(t):
    key = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        fill(pick(wording.QA_TEMPLATES, "qa", key), question=F.col("text")).alias("question"),
        pick(wording.SUMMARY_TEMPLATES, "sum", key).alias("summary"),
        fill(pick(wording.FACT_CHECK_TEMPLATES, "fact", key), question=F.col("source")).alias("claim"),
    )
