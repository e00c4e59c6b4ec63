"""Rankings: positives, cut-off metrics, probabilities, merging, re-ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors
from .joins import skewed_join
from .ordering import prefix_aggregates, range_bucket

RECALL_CUTOFFS = [50, 200, 1000, 5000, 10_000]


def mark_positives(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """``ranking`` with ``positive``: whether (qid, pid) is in the judgements."""
    judged = qrels.select("qid", "pid").distinct().withColumn("positive", F.lit(True))
    return ranking.join(judged, ["qid", "pid"], "left").withColumn(
        "positive", F.coalesce("positive", F.lit(False))
    )


def positives_per_query(qrels: DataFrame) -> DataFrame:
    return qrels.select("qid", "pid").distinct().groupBy("qid").agg(F.count("*").alias("n_positive"))


def unmatched_queries(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Query ids that appear on one side only; empty when the key sets agree."""
    ranked = ranking.select("qid").distinct().withColumn("ranked", F.lit(True))
    judged = qrels.select("qid").distinct().withColumn("judged", F.lit(True))
    return ranked.join(judged, "qid", "full").filter(F.col("ranked").isNull() | F.col("judged").isNull())


def mean_reciprocal_rank(marked: DataFrame, queries: DataFrame, cutoff: int = 10) -> DataFrame:
    """One row: the mean over all ``queries`` of 1 / rank of the first positive,
    0 when it lies beyond ``cutoff`` or is missing."""
    first = marked.filter("positive").groupBy("qid").agg(F.min("rank").alias("first"))
    gain = F.when(F.col("first") <= cutoff, 1.0 / F.col("first")).otherwise(F.lit(0.0))
    return queries.select("qid").join(first, "qid", "left").agg(F.avg(gain).alias(f"mrr_at_{cutoff}"))


def recall(
    marked: DataFrame, queries: DataFrame, cutoffs: list[int] | None = None, depth: int | None = None
) -> DataFrame:
    """One row with recall at every cutoff. ``queries`` is (qid, n_positive).

    A document listed twice for a query counts once, at its better rank. A
    cutoff beyond ``depth``, the number of hits the ranking was cut at, is an
    error.
    """
    cutoffs = cutoffs or RECALL_CUTOFFS
    if depth is not None and max(cutoffs) > depth:
        raise ValueError(f"recall at {max(cutoffs)} needs as many hits; the ranking was cut at {depth}")
    best = marked.filter("positive").groupBy("qid", "pid").agg(F.min("rank").alias("rank"))
    hits = best.groupBy("qid").agg(
        *[F.count(F.when(F.col("rank") <= c, 1)).alias(f"hits_{c}") for c in cutoffs]
    )
    shares = queries.join(hits, "qid", "left")
    return shares.agg(
        *[
            F.avg(F.coalesce(F.col(f"hits_{c}"), F.lit(0)) / F.col("n_positive")).alias(f"recall_at_{c}")
            for c in cutoffs
        ]
    )


def score_run(
    ranking: DataFrame,
    qrels: DataFrame,
    cutoff: int = 10,
    cutoffs: list[int] | None = None,
    depth: int | None = None,
    check_queries: bool = True,
) -> DataFrame:
    """All ranking metrics as (metric, value) rows. A query that only the
    ranking or only the judgements know is an error, unless ``check_queries``
    is off."""
    if check_queries:
        odd = [r["qid"] for r in unmatched_queries(ranking, qrels).limit(5).collect()]
        if odd:
            raise ValueError(f"ranking and judgements don't have the same queries, for example {odd}")
    marked = mark_positives(ranking, qrels)
    queries = positives_per_query(qrels)
    parts = []
    for table in (mean_reciprocal_rank(marked, queries, cutoff), recall(marked, queries, cutoffs, depth)):
        parts.append(table.unpivot([], table.columns, "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def merge_rankings(parts: list[DataFrame]) -> DataFrame:
    """The rankings of several workers in one table."""
    marked = [part.withColumn("worker", F.lit(number)) for number, part in enumerate(parts)]
    return reduce(DataFrame.unionByName, marked)


def repeated_queries(merged: DataFrame) -> DataFrame:
    """Queries that more than one worker ranked; must be empty."""
    workers = merged.groupBy("qid").agg(F.min("worker").alias("first"), F.max("worker").alias("last"))
    return workers.filter("first <> last").select("qid")


def with_probabilities(ranking: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` hits with their softmax share.

    The largest score is taken off before the exponential, which leaves the
    shares as they are and cannot overflow.
    """
    query = Window.partitionBy("qid")
    cut = ranking.filter(F.col("rank") <= k).withColumn(
        "_weight", F.exp(F.col("score") - F.max("score").over(query))
    )
    return cut.withColumn("prob", F.col("_weight") / F.sum("_weight").over(query)).drop("_weight")


def fetch_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` with the columns of ``docs`` (pid, ...), one row per hit; a hit
    without a document keeps its row, with nulls. A document that very many
    queries hit is repeated instead of drawing them all together."""
    return skewed_join(hits, docs, "pid", [F.col("qid")], "left")


def responses(hits: DataFrame) -> DataFrame:
    """(query, topk) with one array per query, best score first, ties by pid.

    Expects (query, text, pid, rank, score, prob) cut to the top k.
    """
    entry = F.struct((-F.col("score")).alias("_order"), "pid", "text", "rank", "score", "prob")
    gathered = hits.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    return gathered.select(
        "query",
        F.transform(
            "_entries", lambda e: F.struct(*[e[c].alias(c) for c in ("text", "pid", "rank", "score", "prob")])
        ).alias("topk"),
    )


def rerank_candidates(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (qid, pid) ordered by the dot product of their vectors."""
    pairs = candidates.select("qid", "pid")
    pairs = skewed_join(pairs, docs.select("pid", F.col("embedding").alias("_doc")), "pid", [F.col("qid")])
    # a query has a bounded number of candidates, so its id is no hot key
    pairs = pairs.join(queries.select("qid", F.col("embedding").alias("_query")), "qid")
    scored = pairs.select("qid", "pid", vectors.dot(F.col("_query"), F.col("_doc")).alias("score"))
    best_first = Window.partitionBy("qid").orderBy(F.col("score").desc(), "pid")
    return scored.withColumn("rank", F.row_number().over(best_first))


def stage_shares(timings: DataFrame, stage: str, seconds: str) -> DataFrame:
    """(stage, seconds, share): each stage's part of all time spent."""
    per_stage = timings.groupBy(stage).agg(F.sum(seconds).alias("seconds"))
    whole = F.sum("seconds").over(Window.partitionBy())  # a handful of stages
    return per_stage.select(F.col(stage).alias("stage"), "seconds", (F.col("seconds") / whole).alias("share"))


# --- token vectors and late interaction --------------------------------------------------


def last_token_vector(tokens: DataFrame) -> DataFrame:
    """(pid, embedding): the vector at the last position of each document."""
    return tokens.groupBy("pid").agg(
        F.max("pos").alias("pos"), F.max_by("embedding", "pos").alias("embedding")
    )


def document_offsets(tokens: DataFrame) -> DataFrame:
    """(pid, length, start): how many vectors a document has and where they begin."""
    lengths = tokens.groupBy("pid").agg(F.count("*").alias("length"))
    return prefix_aggregates(
        lengths, [], [F.col("pid")], range_bucket(tokens, "pid"), {"start": ("sum", F.col("length"))}
    )


def token_positions(tokens: DataFrame) -> DataFrame:
    """(position, pid, pos): the place of every token vector when the documents
    are laid out one after another."""
    starts = document_offsets(tokens).select("pid", "start")
    placed = tokens.select("pid", "pos").join(starts, "pid")
    return placed.select((F.col("start") + F.col("pos")).alias("position"), "pid", "pos")


def candidate_documents(token_hits: DataFrame, positions: DataFrame) -> DataFrame:
    """Distinct (qid, pid) behind token hits (qid, vec); ``positions`` is (vec, pid).
    Very many queries may hit one vector."""
    hits = token_hits.select("qid", "vec").distinct()
    return skewed_join(hits, positions, "vec", [F.col("qid")]).select("qid", "pid").distinct()


def _as_rows(tokens: DataFrame, key: str, limit: int, name: str) -> DataFrame:
    """One row per document: its first ``limit`` token vectors, flattened in order."""
    kept = tokens.filter(F.col("pos") < limit)
    gathered = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("_t"))
    return gathered.select(
        key, F.flatten(F.transform("_t", lambda t: t["embedding"])).alias(name), F.size("_t").alias(f"{name}_n")
    )


def document_rows(doc_tokens: DataFrame, doc_max_len: int = 180) -> DataFrame:
    """(pid, doc, doc_n): the first token vectors of each document, flattened, and their number."""
    return _as_rows(doc_tokens, "pid", doc_max_len, "doc")


def query_rows(query_tokens: DataFrame, query_max_len: int = 32) -> DataFrame:
    """(qid, query, query_n), as :func:`document_rows`."""
    return _as_rows(query_tokens, "qid", query_max_len, "query")


def late_interaction(
    candidates: DataFrame,
    query_tokens: DataFrame,
    doc_tokens: DataFrame,
    query_max_len: int = 32,
    doc_max_len: int = 180,
    save_k: int = 1000,
) -> DataFrame:
    """(qid, pid, rank, score): for each query token the best document token, summed.

    A document shorter than ``doc_max_len`` is padded with zero scores, so each
    of its maxima is at least 0; a document of full length has no such floor.
    A candidate first gets its query's matrix, the smaller one, and moves to its
    document with it; a document that very many queries found is repeated
    rather than drawing them together. Documents are sent once, and only
    (qid, pid, score) goes on from there. Candidates are scored in blocks, as
    one product of padded arrays; no token pair becomes a row.
    """
    queries = query_rows(query_tokens, query_max_len)
    docs = document_rows(doc_tokens, doc_max_len)
    return ranked_pairs(score_pairs(candidates, queries, docs, doc_max_len), save_k)


def ranked_pairs(scored: DataFrame, save_k: int) -> DataFrame:
    best_first = Window.partitionBy("qid").orderBy(F.col("score").desc(), "pid")
    return (
        scored.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= save_k)
        .select("qid", "pid", "rank", "score")
    )


def score_pairs(
    candidates: DataFrame, queries: DataFrame, docs: DataFrame, doc_max_len: int = 180, join=skewed_join
) -> DataFrame:
    """(qid, pid, score) of every candidate, from :func:`query_rows` and
    :func:`document_rows`. ``join`` brings the candidates to the documents."""
    pairs = candidates.select("qid", "pid")
    asked = pairs.join(queries, "qid")  # a query has a bounded number of candidates
    joined = join(asked, docs, "pid", [F.col("qid")])

    def padded(column, counts, length):
        """Matrices of a list column, as one array with zeros after the last token."""
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        width = len(flat) // int(counts.sum())
        out = np.zeros((len(counts), length, width))
        out[np.arange(length)[None, :] < counts[:, None]] = flat.reshape(-1, width)
        return out

    def score(batches, rows=256):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                q_n, d_n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query_n", "doc_n"))
                q = padded(batch.column("query"), q_n, int(q_n.max()))
                # one zero token stands for the padding; a full document has none
                d = padded(batch.column("doc"), d_n, min(int(d_n.max()) + 1, doc_max_len))
                best = np.matmul(q, d.transpose(0, 2, 1)).max(axis=2)
                short = d_n[:, None] < doc_max_len
                scores = np.where(short, np.maximum(best, 0.0), best).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("qid"), batch.column("pid"), pa.array(scores)], names=["qid", "pid", "score"]
                )

    return joined.mapInArrow(score, "qid bigint, pid bigint, score double")


def regroup_embeddings(backgrounds: DataFrame, key: str, column: str, vectors_by_text: DataFrame) -> DataFrame:
    """(key, embeddings): the vectors of each row's backgrounds, in their order.

    ``vectors_by_text`` is (text, embedding). A sample has a handful of
    backgrounds, so the regrouped array is small. A background without a vector
    stays as null, which :func:`placeholder_audit` reports.
    """
    flat = backgrounds.select(key, F.posexplode(column).alias("_pos", "text"))
    found = skewed_join(flat, vectors_by_text, "text", [F.col(key), F.col("_pos")], "left")
    gathered = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "embedding"))).alias("_v")
    )
    return gathered.select(key, F.transform("_v", lambda v: v["embedding"]).alias("embeddings"))


def answer_repeated_once(questions: DataFrame, key: str, question: str, search) -> DataFrame:
    """Run ``search`` on the distinct questions and give every row its hits.

    ``search`` maps (question) to (question, ...hits). Hits are nested to one
    row per distinct question first, so that the join back is many-to-one; a
    question asked very often is spread.
    """
    distinct = questions.select(question).distinct()
    hits = search(distinct)
    fields = [c for c in hits.columns if c != question]
    nested = hits.groupBy(question).agg(F.collect_list(F.struct(*fields)).alias("_hits"))
    joined = skewed_join(questions, nested, question, [F.col(key)])
    return joined.select(*questions.columns, F.inline("_hits"))
