"""The jobs a user runs end to end; each one only strings operators together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chat, wording
from ..functions.text import has_answer
from ..operators import answers, examples, instructions, ordering, prompts, ranking, search
from ..operators.joins import lookup_join
from ..operators.vocabulary import SPECIAL_IDS


def build_instructions(sources: dict[str, DataFrame], path: str, key: str = "key", seed: str | int = 0) -> DataFrame:
    """Assemble all sources and store them by task type."""
    table = instructions.instruction_table(sources, key, seed)
    table.write.mode("errorifexists").partitionBy("task_type").parquet(path)
    return table.sparkSession.read.parquet(path)


def training_rows(
    table: DataFrame,
    max_samples: int | None = None,
    excluded: list[str] | None = None,
    embed_len: int = 1,
    max_len: int = 1024,
    chunk_len: int = 180,
    seed: str | int = 0,
    match_views: bool = True,
) -> DataFrame:
    """Instruction rows with a background as model inputs.

    Sample, drop unwanted types, render the compressed and the plain view, mask
    labels, keep rows with a label and, if asked, rows whose views have equally
    many. ``chunks`` are the texts to embed, one per placeholder run.
    """
    if max_samples is not None:
        table = ordering.sample_n(table, "id", max_samples, seed)
    kept = instructions.exclude_types(table, excluded or [])
    missing = F.raise_error(F.concat(F.lit("no background in row "), F.col("id"))).cast("string")
    background = F.coalesce("background", missing)  # fill gaps with backfill_background first
    views = examples.encoded_views(F.col("messages"), background, embed_len, max_len, chunk_len, match_views)
    good = kept.select("id", F.inline(views))
    return good.withColumn("chunks", F.transform("chunks", lambda c: F.array_join(c, " ")))


def training_batches(
    rows: DataFrame, view: str, vocabulary: DataFrame, batch_size: int, seed, epoch: int = 0, side: str = "left"
) -> DataFrame:
    """One view of the training rows as model inputs: shuffled, batched, and
    padded (id, batch, slot, ids, labels, attention_mask), all numbers."""
    encoded = examples.example_ids(rows, ["id"], view, vocabulary)
    batched = examples.with_batch(encoded, "id", batch_size, seed, epoch, source=rows)
    return examples.collate(batched, pad_id=SPECIAL_IDS[wording.PAD], labels="labels", side=side)


def answered_rows(
    table: DataFrame, key: str, task: Column, embed_len: int = 1, max_len: int = 1024, restate: bool = False
) -> DataFrame:
    """(key, compressed, plain): answered prompts of (question, answer, background)
    in both views, with labels on the answer, and, if the compressed view is to
    restate the background, on that too."""
    question, answer, background = F.col("question"), F.col("answer"), F.col("background")
    run = chat.placeholder_run(embed_len)
    restated = background if restate else None
    compressed = examples.answered_prompt(task, question, answer, run, restated)
    plain = examples.answered_prompt(task, question, answer, background)
    return table.select(
        key,
        examples.answer_example(compressed, answer, restated, max_len).alias("compressed"),
        examples.answer_example(plain, answer, None, max_len).alias("plain"),
    )


def retrieval_run(
    query_tokens: DataFrame,
    doc_tokens: DataFrame,
    cells: DataFrame,
    centroids: DataFrame,
    search_k: int = 1024,
    nprobe: int = 32,
    save_k: int = 1000,
    doc_max_len: int = 180,
    exclude_self: bool = False,
    store: str | None = None,
) -> DataFrame:
    """(qid, pid, rank, score): probe the cells with every query token, gather
    the documents behind the hits and order them by late interaction.

    Token tables are (qid | pid, pos, vec, embedding); ``cells`` holds the
    document tokens as (pid = vec, embedding, cell). With ``store``, a folder
    all executors share, the candidates are written there between the two
    stages: re-ranking reads them more than once, and a lost executor does not
    repeat the search.
    """
    probes = query_tokens.select(F.col("vec").alias("qid"), "embedding")
    hits = search.probe_topk(probes, cells, centroids, search_k, nprobe, exclude_self)
    owners = query_tokens.select(F.col("vec").alias("_token"), F.col("qid").alias("_owner"))
    owned = hits.select(F.col("qid").alias("_token"), F.col("pid").alias("vec")).join(owners, "_token")
    found = ranking.candidate_documents(
        owned.select(F.col("_owner").alias("qid"), "vec"), doc_tokens.select("vec", "pid")
    )
    if store is not None:
        found.write.mode("errorifexists").parquet(store)
        found = found.sparkSession.read.parquet(store)
    return ranking.late_interaction(
        found, query_tokens, doc_tokens, doc_max_len=doc_max_len, save_k=save_k
    )


def validate_candidates(
    candidates: DataFrame, qrels: DataFrame, queries: DataFrame, docs: DataFrame, cutoff: int = 10
) -> DataFrame:
    """MRR over the queries of a candidate list (qid, pid), ordered by dot product.

    Judgements of queries that are not in the list are left out.
    """
    asked = candidates.select("qid").distinct()
    marked = ranking.mark_positives(
        ranking.rerank_candidates(candidates, queries, docs), qrels.join(asked, "qid", "left_semi")
    )
    return ranking.mean_reciprocal_rank(marked, asked, cutoff)


def evaluation_prompts(
    rows: DataFrame,
    key: str,
    task: Column,
    retrieved: DataFrame | None = None,
    ranks: list[int] | None = None,
    embed_len: int = 0,
    keywords: int = 0,
    retriever: str | None = None,
    dev: DataFrame | None = None,
    n_shot: int = 5,
    subject: str | None = None,
    per_subject: int = 5,
    limit: int = 2048,
) -> DataFrame:
    """``rows`` (key, question, ..) with ``background``, ``n_shot`` and ``prompt``.

    ``retrieved`` is (key, rank, text). With ``keywords`` the first background
    is replaced by its best TF-IDF terms. ``dev`` (key, question, [subject],
    [background: list of texts]) gives the shots: its first ``n_shot`` rows,
    of the row's subject if one is named, and as many of them as fit into
    ``limit`` tokens. ``background`` then holds the row's own texts and those of
    its shots, in the order of the prompt. A subject without exactly
    ``per_subject`` dev rows is an error.
    """
    if retrieved is not None:
        rows = prompts.attach_background(rows, key, retrieved, ranks or [1])
        if keywords:
            firsts = rows.select(key, F.get("background", F.lit(0)).alias("text"))
            best = prompts.tfidf_keywords(firsts, key, "text", keywords)
            rows = rows.join(best, key).withColumn("background", F.array("keywords")).drop("keywords")
        if retriever is not None:
            rows = rows.withColumn(
                "background", F.transform("background", lambda text: prompts.prefixed_passage(text, retriever))
            )
    use_texts = retrieved is not None
    none = F.array().cast("array<string>")
    own = F.col("background") if use_texts else none

    def example():
        shown = F.col("background") if use_texts else None
        return prompts.example_prompt(task, F.col("question"), shown, embed_len)

    rows = rows.withColumn("_example", example()).withColumn("_start", prompts.start_prompt(task, use_texts))
    if dev is None:
        shot = F.array().cast("array<struct<text:string,background:array<string>>>")
        rows = rows.withColumn("_shots", shot)
    else:
        if subject:
            check_subjects(rows, dev, subject, per_subject)
        texts = F.col("background") if use_texts else none
        shots = prompts.first_shots(
            dev, key, F.struct(example().alias("text"), texts.alias("background")), n_shot, subject
        ).withColumnRenamed("shots", "_shots")
        if subject:
            rows = lookup_join(rows, shots, [subject], [F.col(key)], "left")
        else:
            rows = rows.withColumn("_shots", shots.select("_shots").scalar())
    texts = F.transform("_shots", lambda s: s["text"])
    bare = prompts.full_prompt(F.col("_start"), none, F.col("_example"))
    fitted = rows.withColumn("n_shot", prompts.fitting_shots(prompts.prompt_length(bare), texts, limit))
    kept = F.slice("_shots", F.lit(1), F.col("n_shot"))
    shown = F.transform(kept, lambda s: s["text"])
    shot_texts = F.flatten(F.transform(kept, lambda s: s["background"]))
    return (
        fitted.withColumn("prompt", prompts.full_prompt(F.col("_start"), shown, F.col("_example")))
        .withColumn("background", prompts.all_backgrounds(own, shot_texts))
        .drop("_example", "_start", "_shots")
    )


def check_subjects(rows: DataFrame, dev: DataFrame, subject: str, n: int) -> None:
    odd = [r[subject] for r in prompts.subjects_without_exactly(dev, subject, n).limit(5).collect()]
    unknown = rows.select(subject).distinct().join(dev.select(subject).distinct(), subject, "left_anti")
    odd += [r[subject] for r in unknown.limit(5).collect()]
    if odd:
        raise ValueError(f"subjects without exactly {n} rows to show: {odd}")


def score_outputs(rows: DataFrame, dataset: str, key: str, output: str, answer: str) -> DataFrame:
    """(key, scores) by the metric of the dataset; ``answer`` is a list of
    strings, or the verdict of a fact check."""
    metric = wording.EVAL_DATASETS[dataset][1]
    if metric == "substring_match":
        return rows.select(key, has_answer(F.col(answer), F.col(output)).cast("double").alias("score"))
    if metric == "fact_checking_acc":
        accepted = answers.verdict_answers(F.col(answer))
        return rows.select(key, has_answer(accepted, F.col(output)).cast("double").alias("score"))
    f1 = answers.token_f1(rows, key, output, answer)
    longest = rows.select(key, answers.rouge_l(F.col(output), F.col(answer)).alias("rouge_l"))
    return f1.join(longest, key)
