"""Vector search: exact, by cells, and with compressed codes.

No pair of query and document ever becomes a row. Scores are matrix products
over Arrow blocks inside a task, and a task only emits the k best rows per
query; a window merges those. Ties are broken by document id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.choice import leading_bits
from ..storage import stored
from .joins import BROADCAST_BYTES, lookup_join, small_copy

HITS = "qid bigint, pid bigint, score double"
BLOCK_CELLS = 2_000_000  # scores held at once: 16 MB
BLOCK_BYTES = 64 * 1024 * 1024  # vectors of a block, as doubles
SOME_COLUMNS = 2048  # documents whose k-th score is a first limit
LEAST = -np.finfo(float).max  # of a hit; -inf is none


def matrix(table, column: str = "embedding") -> np.ndarray:
    """An Arrow list column as a 2-d double array. Null vectors and vectors of
    different widths are an error."""
    values = table.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        raise ValueError(f"{values.null_count} of {len(values)} vectors in {column!r} are null")
    widths = pc.unique(pc.list_value_length(values))
    if len(widths) > 1:
        raise ValueError(f"vectors in {column!r} differ in width: {sorted(widths.to_pylist())}")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def goodness(queries: np.ndarray, docs: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix, larger is better (squared distances come out negative).

    The cosine with a vector of length zero is -inf: it has no direction and is
    no hit. Distances are expanded around the documents' mean, so a common
    offset cancels; the hits kept are scored again without the expansion.
    """
    return scorer(queries, docs, metric)(slice(None))


def scorer(queries: np.ndarray, docs: np.ndarray, metric: str) -> Callable[[slice], np.ndarray]:
    """:func:`goodness` of a slice of the queries; what concerns the documents alone is done once."""
    if metric == "dot":
        return lambda rows: queries[rows] @ docs.T
    if metric == "cosine":
        own, others = np.linalg.norm(queries, axis=1), np.linalg.norm(docs, axis=1)[None, :]

        def cosine(rows):
            lengths = own[rows, None] * others
            products = queries[rows] @ docs.T
            return np.divide(products, lengths, out=np.full_like(products, -np.inf), where=lengths > 0)

        return cosine
    if metric == "l2":
        centre = docs.mean(axis=0) if len(docs) else 0.0
        docs = docs - centre
        others = (docs**2).sum(axis=1)[None, :]

        def l2(rows):
            some = queries[rows] - centre
            scores = some @ docs.T
            scores *= 2.0
            scores -= (some**2).sum(axis=1)[:, None] + others
            return np.minimum(scores, 0.0, out=scores)

        return l2
    raise ValueError(f"unknown metric {metric!r}")


def rounding(queries: np.ndarray, docs: np.ndarray, metric: str) -> np.ndarray:
    """Per query, by how much a score may be off in either direction."""
    unit = 8 * max(1, queries.shape[1]) * np.finfo(float).eps
    if metric == "cosine" or not len(docs):
        return np.full(len(queries), unit)
    if metric == "l2":
        centre = docs.mean(axis=0)
        queries, docs = queries - centre, docs - centre
    reach = np.linalg.norm(docs, axis=1).max()
    lengths = np.linalg.norm(queries, axis=1)
    return unit * ((lengths + reach) ** 2 if metric == "l2" else lengths * reach)


def _best(q: np.ndarray, p: np.ndarray, s: np.ndarray, k: int):
    """The k best hits of every query, from flat hit arrays."""
    order = np.lexsort((p, -s, q))
    q, p, s = q[order], p[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], dtype=int)
    sizes = np.diff(np.r_[starts, len(q)])
    keep = np.arange(len(q)) - np.repeat(starts, sizes) < k
    return q[keep], p[keep], s[keep]


def _block_best(
    scores: np.ndarray,
    qids: np.ndarray,
    pids: np.ndarray,
    k: int,
    floor: np.ndarray | None = None,
    slack: np.ndarray | float = 0.0,
    again: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
):
    """The k best hits per row of a score matrix, without sorting whole rows.

    Everything at least as good as the k-th score is kept and then cut, so ties
    are settled by id. ``floor`` gives a score per row below which a hit is
    known to be beaten; hits within ``slack`` of a limit are kept, and scored
    ``again`` before the cut. For few hits of many documents, the k-th score among some of
    them is a limit already; what reaches it gives the k-th of all.
    """
    width = scores.shape[1]
    step = width // max(SOME_COLUMNS, 8 * k) if k <= 100 else 1
    low = np.full(len(scores), LEAST) if floor is None else np.maximum(floor, LEAST)

    def above(some):
        limit = np.maximum(low, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]) if width > k else low
        return scores >= np.maximum(limit - slack, LEAST)[:, None]

    near = above(scores[:, ::step] if step > 1 else scores)
    if step > 1 and np.count_nonzero(near) > near.size // 16:  # some aren't like the others
        near, step = above(scores), 1
    rows, cols = np.divmod(np.flatnonzero(near), max(1, width))
    kept = scores[rows, cols]
    if step > 1:
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rows come in order
        at = np.lexsort((-kept, rows))[place == k - 1]
        kth = np.full(len(scores), LEAST)
        kth[rows[at]] = kept[at]
        near = kept >= (kth - slack)[rows]
        rows, cols, kept = rows[near], cols[near], kept[near]
    if again is not None:
        kept = again(rows, cols)
    return _best(qids[rows], pids[cols], kept, k)


NO_HITS = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))


def best_hits(
    qids: np.ndarray,
    pids: np.ndarray,
    score: Callable[[slice], np.ndarray],
    k: int,
    exclude_self: bool,
    floor: np.ndarray | None = None,
    slack: np.ndarray | float = 0.0,
    again: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
):
    """The k best documents per query. ``score(rows)`` scores a slice of the queries against all
    documents, ``again(rows, columns)`` single pairs. A few queries at a time meet every document, so
    each is cut to its k best once, however large k is."""
    height = max(1, BLOCK_CELLS // max(1, len(pids)))
    parts = []
    for start in range(0, len(qids) if len(pids) else 0, height):
        rows = slice(start, start + height)
        scores = score(rows)
        if exclude_self:
            scores[qids[rows, None] == pids[None, :]] = -np.inf
        anew = None if again is None else lambda i, j, start=start: again(i + start, j)
        low = None if floor is None else floor[rows]
        parts.append(_block_best(scores, qids[rows], pids, k, low, slack if np.isscalar(slack) else slack[rows], anew))
    if not parts:
        return NO_HITS
    kept = [np.concatenate(column) for column in zip(*parts)]
    return _best(*kept, k) if len(np.unique(qids)) < len(qids) else kept


def squares_apart(queries: np.ndarray, docs: np.ndarray, step: int = 1 << 14):
    """A function that gives the negative squared distance of single pairs."""

    def apart(rows, cols):
        parts = [
            -((queries[rows[i : i + step]] - docs[cols[i : i + step]]) ** 2).sum(axis=1)
            for i in range(0, len(rows), step)
        ]
        return np.concatenate(parts) if parts else np.empty(0)

    return apart


def best_vectors(
    qids: np.ndarray, queries: np.ndarray, pids: np.ndarray, docs: np.ndarray, k: int, metric: str,
    exclude_self: bool, floor: np.ndarray | None = None,
):
    """The k best documents per query, by their vectors."""

    slack = rounding(queries, docs, metric) if metric == "l2" or floor is not None else 0.0
    score = scorer(queries, docs, metric)
    return best_hits(qids, pids, score, k, exclude_self, floor, slack, squares_apart(queries, docs) if metric == "l2" else None)


def _hits_table(q, p, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.float64())],
        names=["qid", "pid", "score"],
    )


def ranked(hits: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """(qid, pid, rank, score) with ranks from 1; distances turn positive again."""
    best_first = Window.partitionBy("qid").orderBy(F.col("score").desc(), "pid")
    score = -F.col("score") if metric == "l2" else F.col("score")
    return (
        hits.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k)
        .select("qid", "pid", "rank", score.alias("score"))
    )


def _block_counts(df: DataFrame, rows_per_block: int, name: str) -> DataFrame:
    blocks = F.ceil(F.count("*") / rows_per_block).cast("int")
    return df.groupBy("cell").agg(blocks.alias(name))


def _blocked(df: DataFrame, key: str, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
    """Put each row into one of its own blocks and repeat it for every other block."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), own_blocks).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), other_blocks - 1))
    )


def _rows_for(df: DataFrame, rows: int, column: str = "embedding") -> int:
    """At most ``rows`` vectors, and as many as fit into BLOCK_BYTES as doubles."""
    first = df.select(F.size(column).alias("n")).first()
    return max(1, min(rows, BLOCK_BYTES // (8 * max(1, first["n"] if first else 1))))


def _grid(queries: DataFrame, docs: DataFrame, query_rows: int, doc_rows: int, counts: DataFrame | None = None):
    """Cut the queries and documents of each cell into blocks that meet pairwise.

    The number of blocks follows from counts per cell (``counts``, if they are
    stored), so a cell that holds a third of all vectors becomes many equal
    tasks. Each side is repeated once per block of the other side. Without a
    cell column there is a single cell.
    """
    if "cell" in docs.columns:
        if counts is None:
            counts = docs.groupBy("cell").agg(F.count("*").alias("n"))
        sized = counts.select("cell", F.ceil(F.col("n") / doc_rows).cast("int").alias("doc_blocks"))
        blocks = sized.join(_block_counts(queries, query_rows, "query_blocks"), "cell")  # one row per cell
        local = small_copy(blocks, 100_000)  # fetched once for both sides
        blocks = blocks if local is None else local
        left = lookup_join(queries, blocks, ["cell"], [F.col("qid")], rows=100_000)
        right = lookup_join(docs, blocks, ["cell"], [F.col("pid")], rows=100_000)
        query_blocks, doc_blocks = F.col("query_blocks"), F.col("doc_blocks")
        keys = ["cell", "qblock", "dblock"]
    else:
        left, right = queries, docs
        n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
        query_rows = min(query_rows, max(1024, -(-n // (4 * cores))))  # enough blocks for all cores
        query_blocks = F.lit(max(1, -(-n // query_rows)))
        doc_blocks = F.lit(max(1, -(-docs.count() // doc_rows)))
        keys = ["qblock", "dblock"]
    left = _blocked(left, "qid", "qblock", query_blocks, "dblock", doc_blocks)
    right = _blocked(right, "pid", "dblock", doc_blocks, "qblock", query_blocks)

    def renewed(df, columns):  # both sides may stem from one table; give each its own columns
        return df.select(*[F.col(c).alias(c) for c in [*columns, "qblock", "dblock"]]).groupBy(*keys)

    return renewed(left, queries.columns).cogroup(renewed(right, docs.columns))


def grid_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    metric: str = "dot",
    exclude_self: bool = False,
    query_rows: int | None = None,
    doc_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Top-k of (qid, embedding) among (pid, embedding), scored block by block.

    With a ``cell`` column on both sides a query only meets its own cells; it
    may appear in several, and its hits are merged over all of them. A ``limit`` column of the
    queries is a distance beyond which hits are of no use (l2 only). Each block sends k hits a query, so
    long lists ask for few, large blocks of documents.
    """
    query_rows = query_rows or (8192 if k <= 100 else 2048)
    doc_rows = doc_rows or (32_768 if k <= 100 else 131_072)

    def score_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.Table.from_batches([_hits_table([], [], [])])
        qids, pids = left.column("qid").to_numpy(), right.column("pid").to_numpy()
        floor = -(left.column("limit").to_numpy() ** 2) if limit else None
        hits = best_vectors(qids, matrix(left), pids, matrix(right), k, metric, exclude_self, floor)
        return pa.Table.from_batches([_hits_table(*hits)])

    cell = ["cell"] if "cell" in docs.columns else []
    limit = ["limit"] if "limit" in queries.columns and metric == "l2" else []
    left, right = queries.select("qid", *cell, "embedding", *limit), docs.select("pid", *cell, "embedding")
    query_rows, doc_rows = _rows_for(left, query_rows), _rows_for(left, doc_rows)
    hits = _grid(left, right, query_rows, doc_rows, counts).applyInArrow(score_block, HITS)
    return ranked(hits, k, metric)


def exact_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    metric: str = "dot",
    exclude_self: bool = False,
    broadcast_rows: int = 8192,
    warm_up_rows: int | None = None,
) -> DataFrame:
    """(qid, pid, rank, score): the k best documents of every query.

    Up to ``broadcast_rows`` queries travel to every task as one matrix and the
    documents are scanned once without a shuffle. More queries are met with the
    documents block by block.

    For a corpus of very many tasks, ``warm_up_rows`` documents are searched
    beforehand. The k-th score a query reaches there can only rise, so tasks
    leave out what lies below it and far fewer hits have to be merged.
    """
    queries, docs = queries.select("qid", "embedding"), docs.select("pid", "embedding")
    sample = queries.limit(broadcast_rows + 1).toArrow()
    if len(sample) > broadcast_rows or sample.nbytes > BROADCAST_BYTES:
        return grid_topk(queries, docs, k, metric, exclude_self)
    context = docs.sparkSession.sparkContext
    qids, rows = sample.column("qid").to_numpy(), matrix(sample)

    def scan_with(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, floor = shared.value
            kept = NO_HITS
            for batch in batches:
                if not batch.num_rows or not len(qids):
                    continue
                d, pids = matrix(batch), batch.column("pid").to_numpy()
                found = best_vectors(qids, q, pids, d, k, metric, exclude_self, floor)
                kept = _best(*[np.concatenate(pair) for pair in zip(kept, found)], k)
            yield _hits_table(*kept)

        return scan

    floor = None
    if warm_up_rows:
        first = docs.limit(warm_up_rows).mapInArrow(scan_with(context.broadcast((qids, rows, None))), HITS)
        reached = ranked(first, k).filter(F.col("rank") == k).select("qid", "score").toArrow()
        known = dict(zip(reached.column("qid").to_pylist(), reached.column("score").to_pylist()))
        # a matrix product may differ in its last bits from one block to the next: see ``rounding``
        slack = rounding(rows, matrix(docs.limit(warm_up_rows).select("embedding").toArrow()), metric)
        floor = np.array([known.get(qid, -np.inf) for qid in qids.tolist()]) - slack
    shared = context.broadcast((qids, rows, floor))
    return ranked(docs.mapInArrow(scan_with(shared), HITS), k, metric)


def nearest_cells(
    vectors: DataFrame, centroids: DataFrame, nprobe: int = 1, table_rows: int = 65_536
) -> DataFrame:
    """``vectors`` (key, embedding) with the ``nprobe`` nearest cells by L2.

    Adds (cell, distance) and gives one row per vector and cell. The centroid
    table (cell, embedding) is a trained artefact of bounded size; a larger one
    is searched block by block.
    """
    key = vectors.columns[0]
    table = centroids.select("cell", "embedding").limit(table_rows + 1).toArrow()
    if len(table) > table_rows or table.nbytes > BROADCAST_BYTES:
        as_queries = vectors.select(F.col(key).alias("qid"), "embedding")
        as_docs = centroids.select(F.col("cell").cast("bigint").alias("pid"), "embedding")
        hits = exact_topk(as_queries, as_docs, nprobe, "l2")
        found = hits.select(
            F.col("qid").alias(key), F.col("pid").cast("int").alias("cell"), F.col("score").alias("distance")
        )
        return vectors.join(found, key)
    order = np.argsort(table.column("cell").to_numpy())
    shared = vectors.sparkSession.sparkContext.broadcast(
        (table.column("cell").to_numpy()[order], matrix(table)[order])
    )
    extra = [T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())]
    schema = T.StructType([*vectors.schema.fields, *extra])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres = shared.value
        width = min(nprobe, len(cells))
        rows = max(1, BLOCK_CELLS // max(1, len(cells)))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                vectors = matrix(batch)
                _, place, best = best_vectors(
                    np.arange(len(vectors)), vectors, np.arange(len(cells)), centres, width, "l2", False
                )
                near, distance = place, -best
                repeated = pa.Table.from_batches([batch]).take(
                    pa.array(np.repeat(np.arange(batch.num_rows), width))
                )
                out = repeated.append_column("cell", pa.array(cells[near], pa.int32()))
                out = out.append_column("distance", pa.array(distance))
                yield from out.combine_chunks().to_batches()

    return vectors.mapInArrow(probe, schema)


def probed(cells: DataFrame, probes: DataFrame, table_rows: int = 65_536) -> DataFrame:
    """The rows of stored cells that some probe asks for.

    There are no more cells than the trained table has, so their numbers may be
    fetched; the scan then reads the folders and row groups of these cells only.
    """
    wanted = [r["cell"] for r in probes.select("cell").distinct().limit(table_rows + 1).collect()]
    if len(wanted) > table_rows:
        return cells
    kept = cells.filter(F.col("cell").isin(wanted))
    if GROUP in cells.columns:
        kept = kept.filter(F.col(GROUP).isin(sorted({cell % CELL_GROUPS for cell in wanted})))
    return kept


def probe_topk(
    queries: DataFrame,
    cells: DataFrame,
    centroids: DataFrame,
    k: int,
    nprobe: int,
    exclude_self: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Top-k by L2 among the vectors of the ``nprobe`` cells nearest to a query.

    ``cells`` is (pid, embedding, cell), for a large table as ``write_cells``
    stores it, with its ``counts``: only probed cells are read then.
    """
    probes = nearest_cells(queries.select("qid", "embedding"), centroids, nprobe)
    return grid_topk(probes, probed(cells, probes), k, "l2", exclude_self, counts=counts)


# --- training of cells and codes --------------------------------------------------


def training_sample(vectors: DataFrame, key: str, ratio: float = 0.3, seed: int = 0) -> DataFrame:
    """Vectors drawn with repetition by the md5 of seed and key: a share of
    2/3 ``ratio`` of them, one or two copies of each, so ``ratio`` of the table on
    average. The same on any cluster."""
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    drawn = leading_bits(mark, 8) < 2 / 3 * ratio * 2**32
    copies = 1 + leading_bits(F.substring(mark, 9, 8), 8) % 2
    return vectors.filter(drawn).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_copy")


def train_cells(
    vectors: DataFrame,
    nlist: int = 32_768,
    seed: int = 0,
    iterations: int = 20,
    sample_ratio: float | None = None,
) -> DataFrame:
    """Centroid table (cell, embedding) of k-means with ``nlist`` cells, trained
    on a sample of the vectors if a ratio is given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if sample_ratio is not None:
        vectors = training_sample(vectors, vectors.columns[0], sample_ratio, seed)
    ready = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=iterations).fit(ready)
    rows = [(cell, [float(x) for x in centre]) for cell, centre in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, embedding array<float>")


CELL_GROUPS = 256  # folders of stored cells
GROUP = "cell_group"


def write_cells(assigned: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Store assigned vectors clustered by cell and read them back.

    A folder holds the cells that agree modulo CELL_GROUPS; within it, files are
    cut by range of (cell, id), so a large cell fills several files, and the
    statistics of the row groups let a scan skip the other cells. The number of
    vectors per cell is stored beside them, see ``read_cells``, and, where their
    (squared) distances to the centre are known, the largest one as the cell's radius.
    """
    grouped = assigned.withColumn(GROUP, F.pmod("cell", F.lit(CELL_GROUPS)))
    ordered = grouped.repartitionByRange(GROUP, "cell", "pid").sortWithinPartitions(GROUP, "cell", "pid")
    ordered.write.mode(mode).partitionBy(GROUP).parquet(f"{path}/vectors")
    spark = assigned.sparkSession
    cells = spark.read.parquet(f"{path}/vectors")
    radius = [F.sqrt(F.max("distance")).alias("radius")] if "distance" in cells.columns else []
    cells.groupBy("cell").agg(F.count("*").alias("n"), *radius).write.mode(mode).parquet(f"{path}/counts")
    return cells


def read_cells(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, counts) as ``write_cells`` stored them."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/counts")


def residuals(assigned: DataFrame, centroids: DataFrame, key: str = "pid") -> DataFrame:
    """``assigned`` (.., embedding, cell) with ``residual`` = embedding - centroid."""
    centre = centroids.select("cell", F.col("embedding").alias("_centre"))
    gap = F.zip_with("embedding", "_centre", lambda x, c: x.cast("double") - c.cast("double"))
    joined = lookup_join(assigned, centre, ["cell"], [F.col(key)], rows=100_000)
    return joined.withColumn("residual", gap).drop("_centre")


def part(vector: Column, number: Column | int, width: int) -> Column:
    """Sub-vector ``number`` (from 0) of ``width`` entries."""
    number = number if isinstance(number, Column) else F.lit(number)
    return F.slice(vector, number * width + 1, F.lit(width))


def train_codes(
    assigned: DataFrame,
    centroids: DataFrame,
    m: int = 16,
    bits: int = 8,
    seed: int = 0,
    iterations: int = 20,
    sample_ratio: float | None = None,
) -> DataFrame:
    """Codebook (part, code, embedding): k-means on each sub-vector of the residuals.

    All sub-vectors are trained together, so an iteration is one pass over the
    table instead of one per sub-vector. A task returns the sum and count per
    code, m * 2**bits small rows however many vectors it read. The start is
    2**bits rows picked by the md5 of their id; a code nobody chose stays. With
    ``sample_ratio`` a sample of the vectors is used. The residuals are written
    to shared storage once.
    """
    if sample_ratio is not None:
        assigned = assigned.sample(fraction=sample_ratio, seed=seed)
    gaps = stored(residuals(assigned, centroids).select("pid", F.col("residual").alias("embedding")))
    spark, size = assigned.sparkSession, 2**bits
    start = matrix(gaps.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "pid")), "pid").limit(size).toArrow())
    if len(start) < size:
        raise ValueError(f"{size} codes need at least as many vectors, found {len(start)}")
    book = np.ascontiguousarray(start.reshape(size, m, -1).transpose(1, 0, 2))
    sums_schema = "part int, code int, n bigint, total array<double>"

    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(book)

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            totals, counts = np.zeros_like(now), np.zeros(now.shape[:2], dtype=np.int64)
            for batch in batches:
                pieces = matrix(batch).reshape(batch.num_rows, len(now), -1)
                for j in range(len(now) if batch.num_rows else 0):
                    code = goodness(pieces[:, j], now[j], "l2").argmax(axis=1)
                    order = np.argsort(code, kind="stable")
                    chosen, first = np.unique(code[order], return_index=True)
                    totals[j, chosen] += np.add.reduceat(pieces[order, j], first)
                    counts[j] += np.bincount(code, minlength=now.shape[1])
            part, code = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    pa.array(code, pa.int32()),
                    pa.array(counts[part, code]),
                    pa.array(list(totals[part, code]), pa.list_(pa.float64())),
                ],
                names=["part", "code", "n", "total"],
            )

        partial = gaps.select("embedding").mapInArrow(gather, sums_schema)
        flat = partial.select("part", "code", "n", F.posexplode("total").alias("i", "x"))
        means = flat.groupBy("part", "code", "i").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        book = book.copy()
        where = tuple(means.column(c).to_numpy() for c in ("part", "code", "i"))
        book[where] = means.column("x").to_numpy()
    rows = [(j, code, book[j, code].tolist()) for j in range(m) for code in range(size)]
    return spark.createDataFrame(rows, "part int, code int, embedding array<float>")


def _codebook(codebook: DataFrame) -> np.ndarray:
    """Codebook as an array [part, code, width]; m * 2**bits rows by construction."""
    rows = codebook.orderBy("part", "code").select("part", "code", "embedding").toArrow()
    parts = int(rows.column("part").to_numpy().max()) + 1
    flat = matrix(rows)
    return flat.reshape(parts, -1, flat.shape[1])


def pq_encode(assigned: DataFrame, centroids: DataFrame, codebook: DataFrame) -> DataFrame:
    """(pid, cell, codes): each sub-vector of the residual as its nearest code."""
    shared = assigned.sparkSession.sparkContext.broadcast(_codebook(codebook))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = matrix(batch, "residual").reshape(batch.num_rows, len(book), -1)
            codes = np.stack(
                [goodness(pieces[:, j], book[j], "l2").argmax(axis=1) for j in range(len(book))], axis=1
            )
            offsets = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
            packed = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("pid"), batch.column("cell"), packed], names=["pid", "cell", "codes"]
            )

    rows = residuals(assigned, centroids).select("pid", F.col("cell").cast("int").alias("cell"), "residual")
    return rows.mapInArrow(compress, "pid bigint, cell int, codes array<smallint>")


def pq_topk(
    queries: DataFrame,
    codes: DataFrame,
    centroids: DataFrame,
    codebook: DataFrame,
    k: int,
    nprobe: int,
    exclude_self: bool = False,
    query_rows: int = 1024,
    doc_rows: int = 65_536,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Top-k by approximate L2: each document is its centroid plus its codes.

    For a cell, the distances of the query residual to every code are looked up
    and summed over the sub-vectors.
    """
    shared = queries.sparkSession.sparkContext.broadcast(_codebook(codebook))

    def score_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.Table.from_batches([_hits_table([], [], [])])
        book = shared.value
        gap = matrix(left, "residual").reshape(len(left), len(book), -1)
        to_code = [goodness(gap[:, j], book[j], "l2") for j in range(len(book))]
        code = matrix(right, "codes").astype(np.int64)

        def score(rows):
            return sum(to_code[j][rows][:, code[:, j]] for j in range(len(book)))

        hits = best_hits(
            left.column("qid").to_numpy(), right.column("pid").to_numpy(), score, k, exclude_self
        )
        return pa.Table.from_batches([_hits_table(*hits)])

    probes = nearest_cells(queries.select("qid", "embedding"), centroids, nprobe)
    gaps = residuals(probes, centroids, "qid").select("qid", "cell", "residual")
    grid = _grid(gaps, probed(codes, probes).select("pid", "cell", "codes"), query_rows, doc_rows, counts)
    return ranked(grid.applyInArrow(score_block, HITS), k, "l2")
