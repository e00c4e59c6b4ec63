"""Retrieval-augmented prompts: attached texts, keywords, shots, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import chat, wording
from ..functions.binding import let
from ..functions.text import strip, terms
from ..storage import stored
from .joins import lookup_join, weighted_lookup_join


def attach_background(rows: DataFrame, key: str, retrieved: DataFrame, ranks: list[int]) -> DataFrame:
    """``rows`` with ``background``: the texts at the chosen ranks (from 1), in
    the order asked for. ``retrieved`` is (key, rank, text). A rank that was not
    retrieved is an error, as is a row without any retrieval.
    """
    order = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("rank").cast("int"))
    chosen = retrieved.filter(F.col("rank").isin(ranks))
    gathered = chosen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))).alias("_b"))
    joined = rows.join(gathered, key, "left")
    texts = F.transform("_b", lambda b: b["text"])
    problem = F.concat(F.lit("retrieval misses a rank for row "), F.col(key).cast("string"))
    checked = F.when(F.coalesce(F.size("_b"), F.lit(0)) == len(ranks), texts).otherwise(
        F.raise_error(problem).cast("array<string>")
    )
    return joined.withColumn("background", checked).drop("_b")


def _named(retriever: str, names) -> bool:
    return retriever.lower() in {n.lower() for n in names}


def prefixed_passage(text: Column, retriever: str) -> Column:
    """The text as a prompt shows it for a given retriever: with its prefix."""
    found = [p for name, p in wording.PASSAGE_PREFIXES.items() if name.lower() == retriever.lower()]
    return F.concat(F.lit(found[0] if found else ""), text)


def passage_text(text: Column, retriever: str) -> Column:
    """The text as a given retriever's encoder wants it: with its prefix or its end mark."""
    prefixed = prefixed_passage(text, retriever)
    return F.concat(prefixed, F.lit(wording.EOS)) if _named(retriever, wording.PASSAGE_EOS_MODELS) else prefixed


def retriever_texts(rows: DataFrame, key: str, texts: str, retriever: str) -> DataFrame:
    """(key, pos, text): the texts to embed of every row, one after another."""
    flat = rows.select(key, F.posexplode(texts).alias("pos", "text"))
    return flat.withColumn("text", passage_text(F.col("text"), retriever))


# --- keywords ---------------------------------------------------------------


PART_CHARS = 8_000_000  # characters whose words are counted, joined and weighed in one task


def _weighted_terms(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf, idf), placed by key, and the document frequencies (term, df).

    Documents are placed by key first, so the counts of a document need no
    further shuffle. There are as many parts as the texts are long, so a task's words stay as many. Frequencies come from the distinct terms of each row and
    collapse per task. The lookup of idf treats frequent words apart.
    """
    rows = docs.select(key, terms(F.col(text)).alias("_terms"))
    df = (
        rows.select(F.explode(F.array_distinct("_terms")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    placed = docs.select(key, text).repartition(parts, F.col(key))
    counted = (
        placed.select(key, F.explode(terms(F.col(text))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )
    total = docs.agg(F.count("*")).scalar()
    idf = df.withColumn("idf", F.log((1 + total) / (1 + F.col("df"))) + 1.0)
    weighed = weighted_lookup_join(counted, idf, "term", "df", ["idf"], [F.col(key)], parts=parts)
    return weighed.repartition(parts, F.col(key)), df


#: Words whose idf is broadcast; each of the others holds less than one in as many of all pairs of document and word.
FREQUENT_TERMS = 65_536


def tfidf_scores(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): l2-normalised TF-IDF with smooth idf.

    idf = ln((1 + n) / (1 + df)) + 1 over lower-cased words of two or more word
    characters. Rows of one key, or without one, are one document; each counts for n and df.

    The words of the texts are placed by key, and counted there each time they are needed. Frequent words find
    their idf in a broadcast and never move; only the rare ones go to their idf and back to the part of their key,
    where both sums of squares meet. So what is written is the words once and the rare ones three times.
    """
    total, chars = docs.agg(F.count("*"), F.sum(F.length(text))).first()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // PART_CHARS))
    df = (
        docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    idf = stored(df.withColumn("idf", F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1.0))
    frequent = F.broadcast(idf.orderBy(F.col("df").desc(), "term").limit(FREQUENT_TERMS).select("term", "idf"))
    whole = F.struct(F.col(key).alias("key"))  # equal for rows without a key, too
    placed = docs.select(whole.alias("_key"), F.array_join(terms(F.col(text)), " ").alias("_words")).repartition(parts, "_key")
    counted = (
        placed.select("_key", F.explode(F.split("_words", " ")).alias("term"))
        .filter("term <> ''")
        .groupBy("_key", "term")
        .agg(F.count("*").alias("tf"))
        .join(frequent, "term", "left")
        .withColumn("raw", F.col("tf") * F.col("idf"))
    )
    squares = F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("_key"))
    counted = counted.withColumn("_frequent", F.coalesce(squares, F.lit(0.0)))
    rare = counted.filter(F.col("idf").isNull()).select("_key", "term", "tf", "_frequent")
    rare = rare.repartition(parts, "term").join(idf.select("term", "idf").repartition(parts, "term"), "term")
    rare = rare.withColumn("raw", F.col("tf") * F.col("idf")).repartition(parts, "_key")
    rare = rare.select("_key", "term", "raw", "_frequent", squares.alias("_rare"))
    # all columns are named, so that both uses of the rare words read the same shuffle
    of_rare = rare.groupBy("_key").agg(F.max(F.struct("_rare", "_frequent", "term")).alias("_most"))
    found = counted.filter(F.col("idf").isNotNull()).join(of_rare, "_key", "left").withColumn("_rare", F.col("_most._rare"))
    length = F.sqrt(F.col("_frequent") + F.coalesce("_rare", F.lit(0.0)))
    columns = [F.col("_key.key").alias(key), "term", (F.col("raw") / length).alias("weight")]
    return found.select(*columns).unionByName(rare.select(*columns))


def tfidf_keywords(docs: DataFrame, key: str, text: str, k: int = 1) -> DataFrame:
    """(key, keywords): the ``k`` best terms of each document, joined by spaces.

    Ties go to the alphabetically smaller term. A document with fewer than
    ``k`` distinct terms is filled with the alphabetically first terms of the
    corpus it does not hold, which all score zero. The length of a document
    does not change the order of its terms, so raw weights are compared.
    """
    weighed, df = _weighted_terms(docs, key, text)
    best = Window.partitionBy(key).orderBy((F.col("tf") * F.col("idf")).desc(), "term")
    top = weighed.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    gathered = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_top"))
    own = F.coalesce(F.transform("_top", lambda t: t["term"]), F.array().cast("array<string>"))
    # k absent terms lie among the first 2k terms of the corpus, as a short row holds fewer than k
    head = df.filter(F.col("term").isNotNull()).orderBy("term").limit(2 * k)
    first = head.agg(F.sort_array(F.collect_list(F.struct("term", "df")))).scalar()
    joined = docs.select(key).join(gathered, key, "left").withColumn("_first", first)

    def filled(v):
        fill = F.filter(v["first"], lambda t: ~F.array_contains(v["own"], t))
        return F.array_join(F.slice(F.concat(v["own"], fill), 1, k), " ")

    return joined.select(key, let(filled, own=own, first=F.col("_first")["term"]).alias("keywords"))


# --- prompts ---------------------------------------------------------------------


def start_prompt(task: Column, with_retrieval: bool) -> Column:
    case = None
    for (name, flag), text in wording.START_PROMPTS.items():
        if flag == with_retrieval:
            case = F.when(task == name, F.lit(text)) if case is None else case.when(task == name, F.lit(text))
    return case


def example_prompt(task: Column, question: Column, background: Column | None = None, embed_len: int = 0) -> Column:
    """One question as the prompt shows it, without its answer.

    ``background`` is an array of texts: each one is followed by a space and
    the whole is stripped. With ``embed_len`` every text is stood for by that
    many placeholders.
    """
    case = None
    for name, template in wording.EVAL_PROMPTS.items():
        before, after = template.split("{question}")
        value = strip(F.concat(F.lit(before), question, F.lit(after)))
        case = F.when(task == name, value) if case is None else case.when(task == name, value)
    if background is None:
        return case
    shown = F.transform(background, lambda _: chat.placeholder_run(embed_len)) if embed_len else background
    before, after = wording.BACKGROUND_PREFIX.split("{background}")
    return F.concat(F.lit(before), strip(F.array_join(shown, " ")), F.lit(after), case)


def full_prompt(start: Column, shots: Column, example: Column, as_chat: bool = True) -> Column:
    """Start prompt, shots and example with blank lines between; as a chat turn
    it ends with the answer cue."""
    prompt = F.concat_ws("\n\n", start, shots, example)
    if not as_chat:
        return prompt
    turn = chat.render_message(F.lit("user"), prompt, chat.INSTRUCT_VERBATIM)
    return F.concat(turn, F.lit(wording.ANSWER_CUE))


def prompt_length(prompt: Column) -> Column:
    return F.size(chat.message_tokens(prompt))


def first_shots(dev: DataFrame, key: str, shot: Column, n: int, subject: str | None = None) -> DataFrame:
    """(subject, shots): the first ``n`` rows per subject, in key order.

    Without a subject there is one row for all. The window keeps at most ``n``
    rows per task and subject before anything is shuffled.
    """
    group = [subject] if subject else []
    rows = dev.select(*group, key, shot.alias("shot"))
    if subject:
        order = Window.partitionBy(subject).orderBy(key)
        rows = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")
    else:
        rows = rows.orderBy(key).limit(n)
    gathered = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(key, "shot"))).alias("_s"))
    return gathered.select(*group, F.transform("_s", lambda s: s["shot"]).alias("shots"))


def subjects_without_exactly(dev: DataFrame, subject: str, n: int = 5) -> DataFrame:
    """Subjects of the dev table that do not have exactly ``n`` rows."""
    return dev.groupBy(subject).agg(F.count("*").alias("n")).filter(F.col("n") != n)


def fitting_shots(base: Column, shots: Column, limit: int = 2048) -> Column:
    """The largest number of leading shots with which the prompt stays within
    ``limit`` tokens, 0 if even one is too many.

    Blank lines add no tokens, so the length is the base plus the shots.
    """

    def most(v):
        def fits(n):
            used = F.aggregate(F.slice(v["sizes"], F.lit(1), n), F.lit(0), lambda a, b: a + b)
            return v["base"] + used <= limit

        return F.coalesce(
            F.array_max(F.filter(F.sequence(F.lit(0), F.size(v["sizes"])), fits)), F.lit(0)
        )

    return let(most, base=base, sizes=F.transform(shots, prompt_length))


def n_shot_prompts(
    rows: DataFrame,
    key: str,
    start: Column,
    example: Column,
    shots: DataFrame,
    subject: str | None = None,
    limit: int = 2048,
    as_chat: bool = True,
) -> DataFrame:
    """(key, n_shot, prompt): every row with as many shots as fit."""
    group = [subject] if subject else []
    parts = rows.select(key, *group, start.alias("_start"), example.alias("_example"))
    if subject:
        joined = lookup_join(parts, shots, [subject], [F.col(key)], "left")
    else:
        joined = parts.withColumn("shots", shots.select("shots").scalar())
    shots_or_none = F.coalesce("shots", F.array().cast("array<string>"))
    bare = full_prompt(F.col("_start"), F.array().cast("array<string>"), F.col("_example"), as_chat)
    fitted = joined.withColumn("n_shot", fitting_shots(prompt_length(bare), shots_or_none, limit))
    kept = F.slice(shots_or_none, F.lit(1), F.col("n_shot"))
    return fitted.select(
        key, "n_shot", full_prompt(F.col("_start"), kept, F.col("_example"), as_chat).alias("prompt")
    )


def all_backgrounds(own: Column, shots: Column) -> Column:
    """A row's own backgrounds followed by those of its shots."""
    return F.concat(own, shots)


# --- checks and reports -----------------------------------------------------------


def placeholder_count(prompt: Column) -> Column:
    return F.size(F.regexp_extract_all(prompt, F.lit(f"({wording.PLACEHOLDER})"), F.lit(1)))


def placeholder_audit(rows: DataFrame, key: str, prompt: str, embeddings: str) -> DataFrame:
    """Rows whose placeholders and attached vectors differ in number."""
    counts = rows.select(
        key,
        placeholder_count(F.col(prompt)).alias("placeholders"),
        F.size(F.filter(embeddings, lambda e: e.isNotNull())).alias("vectors"),
    )
    return counts.filter("placeholders <> vectors")


def compression_report(prompts: DataFrame, mode: str, prompt: str) -> DataFrame:
    """(mode, n, mean_length) per way of showing the background."""
    return prompts.groupBy(mode).agg(
        F.count("*").alias("n"), F.avg(prompt_length(F.col(prompt))).alias("mean_length")
    )


def metric_of(dataset: Column) -> Column:
    """The metric a dataset is scored with."""
    case = None
    for name, (_, metric) in wording.EVAL_DATASETS.items():
        case = F.when(dataset == name, F.lit(metric)) if case is None else case.when(dataset == name, F.lit(metric))
    return case


def task_of(dataset: Column) -> Column:
    case = None
    for name, (task, _) in wording.EVAL_DATASETS.items():
        case = F.when(dataset == name, F.lit(task)) if case is None else case.when(dataset == name, F.lit(task))
    return case


def eval_record(
    scored: DataFrame, dataset: str, model: str, retriever: str | None, batch_size: int, prompt: str, value: str
) -> DataFrame:
    """One row that describes a run: settings, mean prompt length and score."""
    metric = wording.EVAL_DATASETS[dataset][1]
    return scored.agg(
        F.avg(prompt_length(F.col(prompt))).alias("avg_prompt_length"),
        F.avg(F.col(value).cast("double")).alias("score"),
    ).select(
        F.lit(dataset).alias("dataset"),
        F.lit(batch_size).alias("batch_size"),
        F.lit(retriever is not None).alias("include_retrieval"),
        "avg_prompt_length",
        F.lit(model).alias("model"),
        F.lit(metric).alias("metric"),
        "score",
        F.lit(retriever).cast("string").alias("retriever"),
    )
