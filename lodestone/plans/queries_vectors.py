"""Vector search, cells and codes, late interaction, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import chat, vectors
from ..functions.text import tokenize
from ..operators import bounded, examples, prompts, ranking, search
from ..sources import files
from ..streaming.memory import retrieve_once
from ..streaming.retrieve import retrieve_stream
from .queries_text import CHUNKS, scratch
from ..operators.joins import lookup_join, stored_join
from ..storage import bucketed, stored
from .registry import (
    CENTROIDS,
    VECTORS,
    as_docs,
    as_queries,
    label_means,
    query,
    tok,
    token_vectors,
    trained,
    with_,
)


def all_pairs(score: str, condition: str = "q.vec_id <> d.vec_id") -> str:
    return f"""SELECT q.vec_id AS qid, d.vec_id AS pid, {score} AS score
      FROM v q JOIN v d ON {condition}"""


def best(source: str, k: int, order: str = "DESC") -> str:
    return f"""SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score {order}, pid) AS rank, score
      FROM {source} QUALIFY rank <= {k}"""


DOT = "list_dot_product(q.e, d.e)"
COSINE = "list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(d.e, d.e))"
L2 = "pow(list_distance(q.e, d.e), 2)"
OUT = "SELECT qid, pid, rank, round(score, 6) AS score FROM h"


def topk(t, k, metric="dot"):
    return search.exact_topk(
        as_queries(t.embeddings), as_docs(t.embeddings), k, metric, exclude_self=True
    )


@query("dense_topk", with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 10)) + OUT)
def dense_topk(t):
    return topk(t, 10)


@query("cosine_topk", with_(v=VECTORS, p=all_pairs(COSINE), h=best("p", 10)) + OUT)
def cosine_topk(t):
    return topk(t, 10, "cosine")


@query("l2_topk", with_(v=VECTORS, p=all_pairs(L2), h=best("p", 10, "ASC")) + OUT)
def l2_topk(t):
    return topk(t, 10, "l2")


@query("dense_topk_blocked", with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 10)) + OUT)
def dense_topk_blocked(t):
    """The same search the way it runs when the queries are too many to broadcast."""
    return search.exact_topk(
        as_queries(t.embeddings), as_docs(t.embeddings), 10, "dot", exclude_self=True, broadcast_rows=100
    )


@query(
    "normalized_vectors",
    """SELECT vec_id, i - 1 AS i, round(x / n, 6) AS x FROM (
      SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i, sqrt(list_dot_product(e, e)) AS n
      FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings))""",
)
def normalized_vectors(t):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = t.embeddings.select("vec_id", tripled.alias("e"))
    return rows.select("vec_id", F.posexplode(vectors.normalized(F.col("e"))).alias("i", "x"))


@query(
    "fetch_docs",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 3))
    + "SELECT qid, pid, rank, text FROM h LEFT JOIN documents ON doc_id = pid",
)
def fetch_docs(t):
    docs = t.documents.select(F.col("doc_id").alias("pid"), "text")
    return ranking.fetch_documents(topk(t, 3), docs).select("qid", "pid", "rank", "text")


@query(
    "last_token_pool",
    """SELECT pid, pos, i - 1 AS i, round(x, 6) AS x FROM (
      SELECT pid, pos, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM (
        SELECT vec_id // 10 AS pid, max(vec_id % 10) AS pos, arg_max(embedding::DOUBLE[], vec_id % 10) AS e
        FROM embeddings GROUP BY ALL))""",
)
def last_token_pool(t):
    pooled = ranking.last_token_vector(token_vectors(t.embeddings))
    values = F.transform("embedding", lambda x: x.cast("double"))
    return pooled.select("pid", "pos", F.posexplode(values).alias("i", "x"))


@query(
    "doc_offsets",
    """SELECT pid, length, (sum(length) OVER (ORDER BY pid) - length)::BIGINT AS start
      FROM (SELECT vec_id // 10 AS pid, count(*) AS length FROM embeddings GROUP BY ALL)""",
)
def doc_offsets(t):
    return ranking.document_offsets(token_vectors(t.embeddings)).select("pid", "length", "start")


@query(
    "token_positions",
    """SELECT vec_id // 10 AS pid, vec_id % 10 AS pos, row_number() OVER (ORDER BY vec_id) - 1 AS position
      FROM embeddings""",
)
def token_positions(t):
    return ranking.token_positions(token_vectors(t.embeddings))


@query("dense_topk_warm", with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 10)) + OUT)
def dense_topk_warm(t):
    """The same search with a lower bound per query found beforehand."""
    return search.exact_topk(
        as_queries(t.embeddings), as_docs(t.embeddings), 10, "dot", exclude_self=True, warm_up_rows=200
    )


# --- cells and codes ---------------------------------------------------------------------------

NEAREST = """
  SELECT v.vec_id, v.e, c.cell, c.e AS centre, pow(list_distance(v.e, c.e), 2) AS distance,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.e, c.e), c.cell) AS place
  FROM v JOIN centroids c ON true"""
ASSIGNED = "SELECT * FROM nearest WHERE place = 1"
CELLS = {"v": VECTORS, "centroids": CENTROIDS, "nearest": NEAREST, "assigned": ASSIGNED}


def assigned_cells(t, centroids=None):
    return search.nearest_cells(as_docs(t.embeddings), centroids or label_means(t.embeddings))


@query(
    "ivf_assign",
    with_(**CELLS) + "SELECT vec_id AS pid, cell::BIGINT AS cell, round(distance, 6) AS distance FROM assigned",
)
def ivf_assign(t):
    return assigned_cells(t).select("pid", "cell", "distance")


@query(
    "ivf_probe_topk",
    with_(
        **CELLS,
        p="""SELECT n.vec_id AS qid, a.vec_id AS pid, pow(list_distance(n.e, a.e), 2) AS score
             FROM nearest n JOIN assigned a USING (cell) WHERE n.place <= 3 AND n.vec_id <> a.vec_id""",
        h=best("p", 10, "ASC"),
    )
    + OUT,
)
def ivf_probe_topk(t):
    """Vectors stored by cell, then searched in the three nearest cells."""
    centroids = label_means(t.embeddings)
    assigned = search.nearest_cells(as_docs(t.embeddings), centroids)
    path = scratch(t, "cells")
    search.write_cells(assigned, path)
    cells, counts = search.read_cells(t.spark, path)
    return search.probe_topk(
        as_queries(t.embeddings), cells, centroids, 10, nprobe=3, exclude_self=True, counts=counts
    )


PARTS, WIDTH = 8, 8
RESIDUAL = """
  SELECT vec_id, label, cell, p AS part, list_transform(range(p * 8 + 1, p * 8 + 9), lambda i: e[i] - centre[i]) AS r
  FROM (SELECT a.vec_id, v.label, a.cell, a.e, a.centre, unnest(range(8)) AS p FROM assigned a JOIN v USING (vec_id))"""
CODEBOOK = """
  SELECT part, label AS code, list(x ORDER BY i) AS c FROM (
    SELECT part, label, i, avg(x) AS x FROM (
      SELECT part, label, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM residual) GROUP BY ALL)
  GROUP BY part, label"""
ENCODED = """
  SELECT vec_id, cell, part, code FROM (
    SELECT r.vec_id, r.cell, r.part, b.code,
      row_number() OVER (PARTITION BY r.vec_id, r.part ORDER BY list_distance(r.r, b.c), b.code) AS place
    FROM residual r JOIN codebook b USING (part)) WHERE place = 1"""
CODES = {**CELLS, "residual": RESIDUAL, "codebook": CODEBOOK, "encoded": ENCODED}


def label_codebook(t, cells, centroids):
    """(part, code, embedding): per sub-vector the mean residual of every label."""
    labels = t.embeddings.select(F.col("vec_id").alias("pid"), "label")
    gaps = search.residuals(cells, centroids).join(labels, "pid")
    flat = gaps.select("label", F.posexplode("residual").alias("at", "x")).select(
        "label",
        F.expr(f"at div {WIDTH}").cast("int").alias("part"),
        (F.col("at") % WIDTH).alias("i"),
        "x",
    )
    means = flat.groupBy("part", "label", "i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    book = means.groupBy("part", F.col("label").alias("code")).agg(ordered.alias("m"))
    return trained(book.select("part", "code", F.transform("m", lambda m: m["x"]).alias("embedding")))


def compressed(t):
    centroids = label_means(t.embeddings)
    cells = assigned_cells(t, centroids)
    codebook = label_codebook(t, cells, centroids)
    return search.pq_encode(cells, centroids, codebook), centroids, codebook


@query(
    "pq_encode",
    with_(**CODES)
    + """SELECT vec_id AS pid, cell::BIGINT AS cell, string_agg(code::VARCHAR, ' ' ORDER BY part) AS codes
      FROM encoded GROUP BY ALL""",
)
def pq_encode(t):
    codes, _, _ = compressed(t)
    return codes.select("pid", "cell", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


@query(
    "ivfpq_topk",
    with_(
        **CODES,
        probe="SELECT * FROM nearest WHERE place <= 3",
        gap="""SELECT vec_id, cell, p AS part, list_transform(range(p * 8 + 1, p * 8 + 9), lambda i: e[i] - centre[i]) AS r
               FROM (SELECT vec_id, cell, e, centre, unnest(range(8)) AS p FROM probe)""",
        lookup="SELECT g.vec_id, g.cell, g.part, b.code, pow(list_distance(g.r, b.c), 2) AS d FROM gap g JOIN codebook b USING (part)",
        p="""SELECT l.vec_id AS qid, x.vec_id AS pid, sum(l.d) AS score
             FROM lookup l JOIN encoded x USING (cell, part, code) WHERE l.vec_id <> x.vec_id
             GROUP BY l.vec_id, x.vec_id""",
        # documents with equal codes tie, but their sums may differ in the last bit
        h="""SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), pid) AS rank, score
             FROM p QUALIFY rank <= 10""",
    )
    + OUT,
)
def ivfpq_topk(t):
    codes, centroids, codebook = compressed(t)
    return search.pq_topk(
        as_queries(t.embeddings), codes, centroids, codebook, 10, nprobe=3, exclude_self=True
    )


@query(
    "training_sample",
    """SELECT vec_id, 1 + (('0x' || substr(md5('7:' || vec_id), 9, 8))::BIGINT % 2) AS copies FROM embeddings
      WHERE ('0x' || substr(md5('7:' || vec_id), 1, 8))::BIGINT < 0.2 * 4294967296""",
)
def training_sample(t):
    """A fifth of the vectors, one or two copies of each: 0.3 of the table on average."""
    drawn = search.training_sample(t.embeddings, "vec_id", 0.3, seed=7)
    return drawn.groupBy("vec_id").agg(F.count("*").alias("copies"))


def gap(e, c):
    pairs = F.zip_with(e, c, lambda x, y: (x.cast("double") - y.cast("double")) ** 2)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


@query(
    "ivf_train",
    """SELECT vec_id, true AS nearest, true AS finite FROM embeddings""",
)
def ivf_train(t):
    """Cells trained by k-means; every vector's cell is the one with the nearest
    centroid among all, measured without the search kernels."""
    cells = stored(search.train_cells(as_docs(t.embeddings), nlist=16, seed=7))
    assigned = search.nearest_cells(as_docs(t.embeddings), cells)
    centres = cells.agg(F.collect_list(F.struct("cell", "embedding")).alias("centres")).first()["centres"]  # nlist rows
    gaps = F.array(*[F.struct(gap(F.col("embedding"), F.array(*map(F.lit, c["embedding"]))).alias("d"), F.lit(c["cell"]).alias("cell")) for c in centres])
    least = F.array_min(F.transform(gaps, lambda g: g["d"]))
    own = F.get(F.filter(gaps, lambda g: g["cell"] == F.col("cell")), F.lit(0))["d"]
    return assigned.select(
        F.col("pid").alias("vec_id"), (own <= least * (1 + 1e-9) + 1e-12).alias("nearest"), (~F.isnan("distance")).alias("finite")
    )


@query(
    "pq_train",
    "SELECT part, code, true AS settled FROM range(8) a(part), range(16) b(code)",
)
def pq_train(t):
    """A codebook per sub-vector; its training error is below the error of zeros."""
    centroids = label_means(t.embeddings)
    cells = assigned_cells(t, centroids)
    book = stored(search.train_codes(cells, centroids, m=PARTS, bits=4, seed=7, iterations=5))
    flat = search.residuals(cells, centroids).select(
        *[search.part(F.col("residual"), j, WIDTH).alias(f"p{j}") for j in range(PARTS)]
    )
    rows = flat.select(F.inline(F.array(*[F.struct(F.lit(j).alias("part"), F.col(f"p{j}").alias("r")) for j in range(PARTS)])))
    zero = F.aggregate("r", F.lit(0.0), lambda a, x: a + x * x)
    books = book.groupBy("part").agg(F.collect_list("embedding").alias("codes"))  # 16 codes
    nearest = F.array_min(F.transform("codes", lambda c: gap(F.col("r"), c)))
    errors = rows.join(F.broadcast(books), "part").groupBy("part").agg((F.sum(nearest) < F.sum(zero)).alias("settled"))
    return book.join(errors, "part").select(F.col("part").cast("bigint").alias("part"), F.col("code").cast("bigint").alias("code"), "settled")


# --- late interaction -----------------------------------------------------------------------------

CANDIDATES = """
  SELECT DISTINCT qid // 10 AS qid, pid // 10 AS pid FROM h"""
TOKEN_HITS = {"v": VECTORS, "p": all_pairs(DOT), "h": best("p", 5)}


def candidates(t):
    """Token hits of every vector read as a query token, mapped to documents."""
    found = stored(topk(t, 5).select("qid", "pid"))  # its keys are counted before it is joined
    hits = found.select(F.expr("qid div 10").alias("qid"), F.col("pid").alias("vec"))
    positions = t.embeddings.select(F.col("vec_id").alias("vec"), F.expr("vec_id div 10").alias("pid"))
    return ranking.candidate_documents(hits, positions)


@query("candidate_docs", with_(**TOKEN_HITS, c=CANDIDATES) + "SELECT qid, pid FROM c")
def candidate_docs(t):
    return candidates(t)


def maxsim_sql(save_k: int) -> str:
    return with_(
        **TOKEN_HITS,
        c=CANDIDATES,
        m=f"""SELECT c.qid, c.pid, q.vec_id, greatest(max({DOT}), 0) AS s FROM c
              JOIN v q ON q.vec_id // 10 = c.qid JOIN v d ON d.vec_id // 10 = c.pid GROUP BY ALL""",
        s="SELECT qid, pid, sum(s) AS score FROM m GROUP BY ALL",
        r=best("s", save_k),
    ) + "SELECT qid, pid, rank, round(score, 6) AS score FROM r"


@query("maxsim_rerank", maxsim_sql(1000))
def maxsim_rerank(t):
    return ranking.late_interaction(
        stored(candidates(t)), token_vectors(t.embeddings, "qid"), token_vectors(t.embeddings)
    )


# --- responses ----------------------------------------------------------------------------------------

SOFTMAX = """SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY qid) AS prob FROM h"""


@query(
    "topk_softmax",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 10), s=SOFTMAX)
    + "SELECT qid, pid, rank, round(score, 6) AS score, round(prob, 6) AS prob FROM s",
)
def topk_softmax(t):
    return ranking.with_probabilities(topk(t, 10), 10)


@query(
    "topk_response",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 5), s=SOFTMAX)
    + """SELECT 'q' || qid AS query, rank - 1 AS pos, pid, rank, round(score, 6) AS score,
      round(prob, 6) AS prob, source AS text FROM s LEFT JOIN documents ON doc_id = pid""",
)
def topk_response(t):
    docs = t.documents.select(F.col("doc_id").alias("pid"), F.col("source").alias("text"))
    hits = ranking.with_probabilities(topk(t, 5), 5).join(docs, "pid", "left")
    nested = ranking.responses(hits.withColumn("query", F.concat(F.lit("q"), F.col("qid").cast("string"))))
    flat = nested.select("query", F.posexplode("topk").alias("pos", "hit"))
    return flat.select("query", "pos", "hit.pid", "hit.rank", "hit.score", "hit.prob", "hit.text")


@query(
    "bulk_retrieve_dedup",
    with_(
        v=VECTORS,
        c=CENTROIDS,
        p="SELECT c.cell AS qid, d.vec_id AS pid, list_dot_product(c.e, d.e) AS score FROM c JOIN v d ON true",
        h=best("p", 5),
    )
    + """SELECT vec_id, 'label ' || label AS question, pid, rank, round(score, 6) AS score
      FROM v JOIN h ON h.qid = v.label""",
)
def bulk_retrieve_dedup(t):
    """Every vector asks for its label; the ten distinct questions are searched once."""
    name = F.concat(F.lit("label "), F.col("label").cast("string")).alias("question")
    asked = t.embeddings.select("vec_id", name)
    encoder = label_means(t.embeddings, "label")

    def find(distinct):
        encoded = distinct.join(encoder.select("label", name, "embedding"), "question")
        hits = search.exact_topk(
            encoded.select(F.col("label").cast("bigint").alias("qid"), "embedding"), as_docs(t.embeddings), 5
        )
        question = F.concat(F.lit("label "), F.col("qid").cast("string")).alias("question")
        return hits.select(question, "pid", "rank", "score")

    return ranking.answer_repeated_once(asked, "vec_id", "question", find)


@query(
    "stream_memory",
    with_(
        v=VECTORS,
        c=CENTROIDS,
        p="SELECT c.cell AS qid, d.vec_id AS pid, list_dot_product(c.e, d.e) AS score FROM c JOIN v d ON true",
        h=best("p", 5),
    )
    + """SELECT vec_id AS qid, 'label ' || label AS question, pid, rank, round(score, 6) AS score,
      (SELECT count(DISTINCT label) FROM v) AS searches FROM v JOIN h ON h.qid = v.label""",
)
def stream_memory(t):
    """A stream of every vector's label as a question: each label is searched once, in its first micro-batch."""
    root = scratch(t, "memory")
    encoder = label_means(t.embeddings, "label").select("label", "embedding")
    asked = t.embeddings.select(F.col("vec_id").alias("qid"), "label").join(encoder, "label")
    question = F.concat(F.lit("label "), F.col("label").cast("string")).alias("question")
    asked.select("qid", question, "embedding").repartition(3, "qid").write.parquet(f"{root}/questions")
    schema = "qid bigint, question string, embedding array<double>"
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/questions")
    docs = as_docs(t.embeddings)
    paths = [f"{root}/{name}" for name in ("hits", "memory", "checkpoint")]
    retrieve_once(stream, lambda new: search.exact_topk(new, docs, 5), *paths).awaitTermination()
    searches = t.spark.read.parquet(paths[1]).count()
    hits = t.spark.read.parquet(paths[0]).select("qid", "question", "pid", "rank", "score")
    return hits.withColumn("searches", F.lit(searches).cast("bigint"))


@query("stream_retrieve", with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 5), s=SOFTMAX)
       + "SELECT qid, pid, rank, round(score, 6) AS score, round(prob, 6) AS prob FROM s")
def stream_retrieve(t):
    schema = t.embeddings.schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.folder}/embeddings*.parquet")
    root = scratch(t, "stream")
    running = retrieve_stream(
        as_queries(stream), as_docs(t.embeddings), 5, f"{root}/hits", f"{root}/checkpoint", exclude_self=True
    )
    running.awaitTermination()
    return t.spark.read.parquet(f"{root}/hits").select("qid", "pid", "rank", "score", "prob")


@query(
    "rerank_candidates",
    with_(
        **CELLS,
        p="""SELECT n.vec_id AS qid, a.vec_id AS pid, pow(list_distance(n.e, a.e), 2) AS score
             FROM nearest n JOIN assigned a USING (cell) WHERE n.place <= 2 AND n.vec_id <> a.vec_id""",
        c=best("p", 20, "ASC"),
        s=f"SELECT qid, pid, {DOT} AS score FROM c JOIN v q ON q.vec_id = qid JOIN v d ON d.vec_id = pid",
        h=best("s", 20),
    )
    + OUT,
)
def rerank_candidates(t):
    queries, docs = as_queries(t.embeddings), as_docs(t.embeddings)
    centroids = label_means(t.embeddings)
    found = search.probe_topk(queries, assigned_cells(t, centroids), centroids, 20, 2, exclude_self=True)
    return ranking.rerank_candidates(found, queries, docs).select("qid", "pid", "rank", "score")


@query(
    "inbatch_targets",
    """WITH b AS (SELECT vec_id, row_number() OVER (ORDER BY md5('3:0:' || vec_id), vec_id) - 1 AS position
        FROM embeddings),
      s AS (SELECT vec_id, position // 16 // 2 AS step, (position // 16) % 2 AS device, position % 16 AS slot FROM b)
      SELECT step, device, slot, vec_id, slot + device * 32 AS target,
        2 * count(*) OVER (PARTITION BY step) - 1 AS negatives FROM s""",
)
def inbatch_targets(t):
    batches = examples.with_batch(t.embeddings.select("vec_id"), "vec_id", 16, 3)
    return examples.batch_targets(batches, "vec_id", 16, devices=2)


@query(
    "embed_regroup",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 3))
    + """SELECT qid, rank - 1 AS pos, len(e) AS dim, round(list_sum(e), 6) AS total
      FROM h JOIN v ON vec_id = pid""",
)
def embed_regroup(t):
    """The three nearest documents of a query by name, replaced by their vectors."""
    name = F.concat(F.lit("document "), F.col("pid").cast("string"))
    hits = topk(t, 3).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", name.alias("text")))).alias("b")
    )
    rows = hits.select("qid", F.transform("b", lambda b: b["text"]).alias("background"))
    by_text = as_docs(t.embeddings).select(name.alias("text"), "embedding")
    regrouped = ranking.regroup_embeddings(rows, "qid", "background", by_text)
    flat = regrouped.select("qid", F.posexplode("embeddings").alias("pos", "e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return flat.select("qid", "pos", F.size("e").alias("dim"), total.alias("total"))


@query(
    "placeholder_audit",
    with_(c=f"SELECT doc_id, {CHUNKS.format(t=tok('text'), total=1024)} AS n FROM documents")
    + """SELECT doc_id, n AS placeholders, count(vec_id) AS vectors
      FROM c LEFT JOIN embeddings ON vec_id = doc_id GROUP BY doc_id, n HAVING n <> count(vec_id)""",
)
def placeholder_audit(t):
    """One vector per document against one placeholder per chunk."""
    rows = t.documents.select(
        "doc_id", chat.placeholder_run(examples.chunk_count(tokenize(F.col("text")))).alias("prompt")
    )
    attached = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.array("embedding").alias("embeddings"))
    joined = rows.join(attached, "doc_id", "left").withColumn(
        "embeddings", F.coalesce("embeddings", F.array().cast("array<array<float>>"))
    )
    return prompts.placeholder_audit(joined, "doc_id", "prompt", "embeddings")


# --- ranking metrics -------------------------------------------------------------------------------------


def marked_by_label(t, k):
    """A ranking whose positives share the query's label, and the queries."""
    labels = t.embeddings.select("vec_id", "label")
    hits = topk(t, k)
    # the hits stay where they are while the labels, 12 bytes a vector, fit into a broadcast
    marked = hits
    for side, name, other in (("qid", "ql", "pid"), ("pid", "pl", "qid")):
        own = labels.select(F.col("vec_id").alias(side), F.col("label").alias(name))
        marked = lookup_join(marked, own, [side], [F.col(other)], rows=4_000_000)
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_positive"))
    # a row for each of the few labels; a vector without one asks too, with no positives known
    queries = labels.join(F.broadcast(sizes), "label", "left").select(F.col("vec_id").alias("qid"), "n_positive")
    return marked.withColumn("positive", F.col("ql") == F.col("pl")), queries


MARKED = """
  SELECT h.qid, h.pid, h.rank, q.label = d.label AS positive, count(*) OVER () AS x
  FROM h JOIN v q ON q.vec_id = h.qid JOIN v d ON d.vec_id = h.pid"""


@query(
    "mrr_at_10",
    with_(
        v=VECTORS,
        p=all_pairs(DOT),
        h=best("p", 20),
        m=MARKED,
        f="SELECT qid, min(rank) AS first FROM m WHERE positive GROUP BY qid",
    )
    + """SELECT round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr_at_10
      FROM v LEFT JOIN f ON f.qid = v.vec_id""",
)
def mrr_at_10(t):
    marked, queries = marked_by_label(t, 20)
    return ranking.mean_reciprocal_rank(marked, queries, 10)


@query(
    "recall_at_k",
    with_(
        v=VECTORS,
        p=all_pairs(DOT),
        h=best("p", 1000),
        m=MARKED,
        n="SELECT label, count(*) - 1 AS n FROM v GROUP BY label",
        g="""SELECT v.vec_id, n.n::DOUBLE AS n, count(*) FILTER (rank <= 50 AND positive) AS a,
             count(*) FILTER (rank <= 200 AND positive) AS b, count(*) FILTER (rank <= 1000 AND positive) AS c
             FROM v JOIN n USING (label) LEFT JOIN m ON m.qid = v.vec_id GROUP BY ALL""",
    )
    + """SELECT round(avg(a / n), 6) AS recall_at_50, round(avg(b / n), 6) AS recall_at_200,
      round(avg(c / n), 6) AS recall_at_1000 FROM g""",
)
def recall_at_k(t):
    marked, queries = marked_by_label(t, 1000)
    return ranking.recall(marked, queries, [50, 200, 1000], depth=1000)


@query(
    "score_run",
    with_(
        v=VECTORS,
        p=all_pairs(DOT),
        h=best("p", 200),
        j="""SELECT a.vec_id AS qid, b.vec_id AS pid FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
        r="SELECT j.qid, h.rank FROM j LEFT JOIN h USING (qid, pid)",
    )
    + """SELECT 'mrr_at_10' AS metric, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS value FROM r
      UNION ALL SELECT 'recall_at_50', round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM r
      UNION ALL SELECT 'recall_at_200', round(avg(CASE WHEN rank <= 200 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM r""",
)
def score_run(t):
    """Judgements that name the next vector as the one positive, scored in full."""
    ids = t.embeddings.select("vec_id")
    following = ids.select((F.col("vec_id") - 1).alias("qid"), F.col("vec_id").alias("pid"))
    qrels = following.join(ids.select(F.col("vec_id").alias("qid")), "qid")
    ranked = topk(t, 200).join(qrels.select("qid"), "qid", "left_semi")  # the last vector has no next one
    ranked = stored(ranked.select("qid", "pid", "rank"))  # read by the check and by each metric
    return ranking.score_run(ranked, qrels, 10, [50, 200], depth=200)


@query(
    "ranking_roundtrip",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 10)) + "SELECT qid, pid, rank FROM h",
)
def ranking_roundtrip(t):
    path = scratch(t, "ranking")
    files.write_ranking(topk(t, 10), path)
    return files.read_ranking(t.spark, path)


@query(
    "merge_rankings",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 10))
    + """SELECT h.qid, h.pid, h.rank, (label >= 5)::BIGINT AS worker, false AS repeated
      FROM h JOIN v ON v.vec_id = h.qid""",
)
def merge_rankings(t):
    """Two workers ranked the queries of five labels each; none is ranked twice."""
    queries = t.embeddings.select(F.col("vec_id").alias("qid"), "label", "embedding")
    docs = as_docs(t.embeddings)
    parts = [
        search.exact_topk(queries.filter(half), docs, 10, exclude_self=True)
        for half in (F.col("label") < 5, F.col("label") >= 5)
    ]
    merged = stored(ranking.merge_rankings(parts))  # read twice; the searches run once
    twice = ranking.repeated_queries(merged).withColumn("repeated", F.lit(True))
    return merged.join(twice, "qid", "left").select(
        "qid", "pid", "rank", "worker", F.coalesce("repeated", F.lit(False)).alias("repeated")
    )


@query(
    "stage_share",
    """SELECT event_type AS stage, round(sum(value), 6) AS seconds,
      round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type""",
)
def stage_share(t):
    return ranking.stage_shares(t.events, "event_type", "value")


# --- searches with bounds -----------------------------------------------------------------------


@query("exact_probe_topk", with_(v=VECTORS, p=all_pairs(L2), h=best("p", 10, "ASC")) + OUT)
def exact_probe_topk(t):
    """The ten nearest vectors, all of them, from stored cells and their radii."""
    docs = as_docs(t.embeddings)
    centroids = stored(search.train_cells(docs, nlist=256, seed=7, iterations=5))
    path = scratch(t, "cells")
    search.write_cells(search.nearest_cells(docs, centroids), path)
    cells, sizes = search.read_cells(t.spark, path)
    return bounded.exact_probe_topk(as_queries(t.embeddings), cells, centroids, sizes, 10, nprobe=64, exclude_self=True)


@query(
    "probe_recall",
    with_(v=VECTORS, n="SELECT least(10, count(*) - 1) AS n FROM v")
    + "SELECT vec_id AS qid, 1.0::DOUBLE AS recall FROM v, n WHERE n > 0",
)
def probe_recall(t):
    """Share of each vector's ten true neighbours that the search by cells and radii finds."""
    found = exact_probe_topk(t).select("qid", "pid")
    true = topk(t, 10, "l2").select("qid", "pid")
    hit = found.withColumn("hit", F.lit(1))
    share = F.count("hit") / F.count("*")
    return true.join(hit, ["qid", "pid"], "left").groupBy("qid").agg(share.alias("recall"))


@query(
    "ivf_assign_grouped",
    with_(**CELLS) + "SELECT vec_id AS pid, cell::BIGINT AS cell, round(distance, 6) AS distance FROM assigned",
)
def ivf_assign_grouped(t):
    """Each vector's nearest centre, by groups of centres and their radii."""
    found = bounded.nearest_cell_by_groups(as_docs(t.embeddings), label_means(t.embeddings))
    return found.select("pid", "cell", "distance")


@query(
    "ivfpq_exact_topk",
    with_(
        **CELLS,
        p="""SELECT n.vec_id AS qid, a.vec_id AS pid, pow(list_distance(n.e, a.e), 2) AS score
             FROM nearest n JOIN assigned a USING (cell) WHERE n.place <= 3 AND n.vec_id <> a.vec_id""",
        h=best("p", 10, "ASC"),
    )
    + OUT,
)
def ivfpq_exact_topk(t):
    """Codes with their errors: the same hits as the vectors of the three cells give."""
    centroids = label_means(t.embeddings)
    cells = stored(assigned_cells(t, centroids))
    codebook = label_codebook(t, cells, centroids)
    codes = search.pq_encode(cells, centroids, codebook)
    coded = stored(bounded.with_code_errors(cells, codes, centroids, codebook))
    return bounded.pq_exact_topk(
        as_queries(t.embeddings), coded, as_docs(t.embeddings), centroids, codebook, 10, nprobe=3, exclude_self=True
    )


#: Whole numbers, so that products are exact and ties are ties in any order of adding.
LINE = "[sum(l_quantity)::BIGINT, l_linenumber::BIGINT, round(max(l_discount) * 100)::BIGINT, round(max(l_tax) * 100)::BIGINT]"


@query(
    "recall_deep",
    with_(
        d=f"""SELECT l_orderkey * 10 + l_linenumber AS pid, min(l_returnflag || l_linestatus) AS mode, {LINE} AS e
              FROM lineitem GROUP BY l_orderkey, l_linenumber""",
        q="""SELECT row_number() OVER (ORDER BY mode) AS qid, mode, count(*) AS n,
             [round(avg(e[1]))::BIGINT, 3, round(avg(e[3]))::BIGINT, round(avg(e[4]))::BIGINT] AS e FROM d GROUP BY mode""",
        p="""SELECT qid, pid, q.mode = d.mode AS positive, n,
             q.e[1] * d.e[1] + q.e[2] * d.e[2] + q.e[3] * d.e[3] + q.e[4] * d.e[4] AS score FROM q JOIN d ON true""",
        h="SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM p",
        g="SELECT qid, n, "
        + ", ".join(f"count(*) FILTER (rank <= {c} AND positive) AS c{c}" for c in (50, 200, 1000, 5000, 10000))
        + " FROM h GROUP BY qid, n",
    )
    + "SELECT "
    + ", ".join(f"round(avg(c{c} / n::DOUBLE), 6) AS recall_at_{c}" for c in (50, 200, 1000, 5000, 10000))
    + " FROM g",
)
def recall_deep(t):
    """Recall at up to 10,000 hits: every state of order lines, as their mean, asks for its lines."""
    line = F.array(
        F.sum("l_quantity").cast("long"),
        F.col("l_linenumber").cast("long"),
        F.round(F.max("l_discount") * 100).cast("long"),
        F.round(F.max("l_tax") * 100).cast("long"),
    )
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.concat("l_returnflag", "l_linestatus")).alias("mode"), line.alias("embedding")
    )
    docs = stored(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), "mode", "embedding"))
    mean = [F.round(F.avg(F.col("embedding")[i])).cast("long") for i in range(4)]
    mean[1] = F.lit(3).cast("long")
    modes = docs.groupBy("mode").agg(F.count("*").alias("n_positive"), F.array(*mean).alias("embedding"))
    place = F.row_number().over(Window.orderBy("mode"))  # a row for each of the few states
    modes = trained(modes.withColumn("qid", place.cast("long")))
    hits = bounded.deep_topk(modes, docs, 10_000)
    marked = hits.join(docs.select("pid", "mode"), "pid").join(F.broadcast(modes.select("qid", F.col("mode").alias("_mode"))), "qid")
    return ranking.recall(marked.withColumn("positive", F.col("mode") == F.col("_mode")), modes, depth=10_000)


# --- tables that stay where they are ------------------------------------------------------------------


def bounded_maxsim(t, save_k, **options):
    """Late interaction by the bounds of cells, over documents in buckets."""
    vectors = as_docs(t.embeddings)
    centroids = stored(search.train_cells(vectors, nlist=64, seed=7, iterations=5))
    tokens = token_vectors(t.embeddings)
    signatures = stored(bounded.token_signatures(tokens, centroids))
    docs = bucketed(ranking.document_rows(tokens), "pid", 16)
    return bounded.bounded_late_interaction(
        stored(candidates(t)), token_vectors(t.embeddings, "qid"), docs, signatures, centroids, save_k=save_k, **options
    )


@query("maxsim_bounded", maxsim_sql(5))
def maxsim_bounded(t):
    return bounded_maxsim(t, 5)


@query(
    "fetch_stored_docs",
    with_(v=VECTORS, p=all_pairs(DOT), h=best("p", 3))
    + "SELECT qid, pid, rank, text FROM h LEFT JOIN documents ON doc_id = pid",
)
def fetch_stored_docs(t):
    """The texts of hits, from documents kept in buckets: the hits move, the texts stay."""
    docs = bucketed(t.documents.select(F.col("doc_id").alias("pid"), "text"), "pid", 16)
    return stored_join(stored(topk(t, 3)), docs, "pid", [F.col("qid")], "left").select("qid", "pid", "rank", "text")
