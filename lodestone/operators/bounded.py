"""Vector search with bounds: exact results from cells, codes and deep lists,
where what is left out is shown to be no hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..storage import stored
from .joins import BROADCAST_BYTES, skewed_join, stored_join
from .ranking import query_rows, ranked_pairs, score_pairs
from .search import BLOCK_CELLS, HITS, _codebook, _grid, best_hits, best_vectors, goodness, grid_topk, matrix, nearest_cells, probed, ranked, residuals, rounding, scorer, squares_apart

#: Centres of a trained table that is sent to every task.
MOST_CENTRES = 65_536


def _table(rows: DataFrame, columns: list[str], most: int = MOST_CENTRES) -> pa.Table:
    """A trained table of bounded size; a larger one is an error."""
    found = rows.select(*columns).limit(most + 1).toArrow()
    if len(found) > most or found.nbytes > 4 * BROADCAST_BYTES:
        raise ValueError(f"a trained table of more than {most} rows or {4 * BROADCAST_BYTES} bytes")
    return found


# --- cells ------------------------------------------------------------------------------


def exact_probe_topk(
    queries: DataFrame,
    cells: DataFrame,
    centroids: DataFrame,
    sizes: DataFrame,
    k: int,
    nprobe: int = 8,
    exclude_self: bool = False,
    visits: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(qid, pid, rank, score): the k nearest vectors by squared L2 distance, all of
    them, from as few cells as the cells' radii allow.

    ``sizes`` is (cell, n, radius), as ``search.write_cells`` stores it beside the cells. No
    vector of a cell is nearer to a query than the distance to the cell's centre less its
    radius. A query first visits its ``nprobe`` nearest cells (more until they hold k
    vectors), then in waves of twice as many the cells of lowest bound, until
    no bound is below the distance of its k-th hit. Queries that are done leave; a wave reads the
    folders of its cells only. With ``visits`` a table (qid, n_cells) is returned too.
    """
    spark = queries.sparkSession
    known = centroids.select("cell", "embedding").join(sizes.select("cell", "n", "radius"), "cell")
    table = _table(known, ["cell", "n", "radius", "embedding"])
    if not len(table):
        none = spark.createDataFrame([], "qid bigint, pid bigint, rank int, score double")
        return (none, queries.select("qid", F.lit(0).alias("n_cells"))) if visits else none
    order = np.argsort(table.column("cell").to_numpy())
    shared = spark.sparkContext.broadcast(
        (*(table.column(c).to_numpy()[order] for c in ("cell", "n", "radius")), matrix(table)[order])
    )
    enough = k + (1 if exclude_self else 0)

    def choose(width):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, counts, radius, centres = shared.value
            rows = max(1, 4_000_000 // len(number))
            for whole in batches:
                for start in range(0, whole.num_rows, rows):
                    batch = whole.slice(start, rows)
                    q = matrix(batch)
                    slack = rounding(q, centres, "l2")[:, None]
                    squares = -goodness(q, centres, "l2")
                    bound = np.sqrt(np.maximum(0.0, squares - slack)) - np.sqrt(radius**2 + slack)
                    limit = batch.column("limit").to_numpy(zero_copy_only=False)
                    chosen, seen = [], []
                    for i, before in enumerate(batch.column("seen").to_pylist()):
                        if before is None:  # the first wave goes by the centres
                            by = np.argsort(squares[i], kind="stable")
                            filled = int(np.searchsorted(np.cumsum(counts[by]), enough)) + 1
                            now = by[: max(width, filled)]
                        else:
                            left = np.setdiff1d(np.flatnonzero(bound[i] <= limit[i]), np.searchsorted(number, before))
                            now = left[np.argsort(bound[i, left], kind="stable")][:width]
                        chosen.append(number[now])
                        seen.append(np.concatenate([before or [], number[now]]).astype(np.int32))
                    kind = pa.list_(pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in ("qid", "embedding", "limit")), pa.array(chosen, kind), pa.array(seen, kind)],
                        names=["qid", "embedding", "limit", "cells", "seen"],
                    )

        return run

    schema = T.StructType(
        [
            T.StructField("qid", T.LongType()),
            queries.schema["embedding"],
            T.StructField("limit", T.DoubleType()),
            *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("cells", "seen")],
        ]
    )
    state = queries.select(
        "qid", "embedding", F.lit(float("inf")).alias("limit"), F.lit(None).cast("array<int>").alias("seen")
    )
    hits, visited = None, []
    width = nprobe
    while True:
        wave = stored(state.mapInArrow(choose(width), schema).filter(F.size("cells") > 0))
        if wave.isEmpty():
            break
        visited.append(wave.select("qid", F.size("cells").alias("n")))
        # hits beyond the k-th so far are not sent; a hair more, as the limit is a rounded root
        limit = (F.col("limit") * (1 + 1e-12)).alias("limit")
        probes = wave.select("qid", "embedding", limit, F.explode("cells").alias("cell"))
        found = grid_topk(probes, probed(cells, probes), k, "l2", exclude_self, counts=sizes.select("cell", "n"))
        found = found.select("qid", "pid", (-F.col("score")).alias("score"))
        hits = stored(ranked(found if hits is None else hits.unionByName(found), k).select("qid", "pid", "score"))
        worst = hits.groupBy("qid").agg(F.count("*").alias("n"), F.sqrt(-F.min("score")).alias("limit"))
        limit = F.when(F.col("n") >= k, F.col("limit")).otherwise(F.lit(float("inf")))
        reached = worst.select("qid", limit.alias("limit"))
        state = wave.drop("limit").join(reached, "qid", "left").select(
            "qid", "embedding", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), "seen"
        )
        width *= 2
    found = ranked(hits, k, "l2") if hits is not None else spark.createDataFrame([], "qid bigint, pid bigint, rank int, score double")
    if not visits:
        return found
    counted = visited[0] if visited else queries.select("qid", F.lit(0).alias("n"))
    for more in visited[1:]:
        counted = counted.unionByName(more)
    return found, counted.groupBy("qid").agg(F.sum("n").cast("int").alias("n_cells"))


def grouped_centres(centres: np.ndarray, seed: int = 0, iterations: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre of each group, its radius, group of each centre): about as many groups
    as each has centres. ``centres`` is a trained table of bounded size."""
    count = max(1, int(np.sqrt(len(centres))))
    rng = np.random.default_rng(seed)
    heads = centres[rng.choice(len(centres), count, replace=False)]
    for _ in range(iterations):
        own = goodness(centres, heads, "l2").argmax(axis=1)
        for g in np.unique(own):
            heads[g] = centres[own == g].mean(axis=0)
    own = goodness(centres, heads, "l2").argmax(axis=1)
    apart = np.sqrt(((centres - heads[own]) ** 2).sum(axis=1))
    radius = np.zeros(count)
    np.maximum.at(radius, own, apart)
    return heads, radius, own


def nearest_cell_by_groups(vectors: DataFrame, centroids: DataFrame, seed: int = 0) -> DataFrame:
    """``vectors`` (key, embedding) with the nearest cell by L2, its squared distance, and
    how many centres the vector was compared with (cell, distance, compared).

    Centres are grouped around centres of their own. A vector meets the centres of its nearest
    group, then those of each group that could hold a nearer one: the distance to the
    group's centre less its radius is below the best so far. Ties go to the smaller cell.
    """
    table = _table(centroids, ["cell", "embedding"])
    order = np.argsort(table.column("cell").to_numpy())
    centres = matrix(table)[order]
    shared = vectors.sparkSession.sparkContext.broadcast(
        (table.column("cell").to_numpy()[order], centres, *grouped_centres(centres, seed))
    )
    extra = [("cell", T.IntegerType()), ("distance", T.DoubleType()), ("compared", T.IntegerType())]
    schema = T.StructType([*vectors.schema.fields, *[T.StructField(*x) for x in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres, heads, radius, own = shared.value
        members = [np.flatnonzero(own == g) for g in range(len(heads))]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            slack = rounding(x, heads, "l2")[:, None]
            squares = -goodness(x, heads, "l2")
            first = squares.argmin(axis=1)
            bound = np.sqrt(np.maximum(0.0, squares - slack)) - np.sqrt(radius**2 + slack)
            best, place = np.full(len(x), np.inf), np.full(len(x), len(cells))
            compared = np.full(len(x), len(heads))

            def meet(rows, g):
                if not len(rows) or not len(members[g]):
                    return
                _, near, score = best_vectors(np.arange(len(rows)), x[rows], np.arange(len(members[g])), centres[members[g]], 1, "l2", False)
                near = members[g][near]
                better = (-score < best[rows]) | ((-score == best[rows]) & (near < place[rows]))
                best[rows[better]], place[rows[better]] = -score[better], near[better]
                compared[rows] += len(members[g])

            for g in range(len(heads)):
                meet(np.flatnonzero(first == g), g)
            for g in range(len(heads)):
                meet(np.flatnonzero((first != g) & (bound[:, g] <= np.sqrt(best))), g)
            out = pa.Table.from_batches([batch])
            for name, values, kind in zip(("cell", "distance", "compared"), (cells[place], best, compared), (pa.int32(), pa.float64(), pa.int32())):
                out = out.append_column(name, pa.array(values, kind))
            yield from out.combine_chunks().to_batches()

    return vectors.mapInArrow(run, schema)


# --- codes ------------------------------------------------------------------------------


def with_code_errors(assigned: DataFrame, codes: DataFrame, centroids: DataFrame, codebook: DataFrame) -> DataFrame:
    """``codes`` (pid, cell, codes) with ``error``, the length of what the codes leave of the
    vector's residual. ``assigned`` is (pid, embedding, cell)."""
    shared = assigned.sparkSession.sparkContext.broadcast(_codebook(codebook))
    gaps = residuals(assigned, centroids).select("pid", "residual")
    rows = gaps.join(codes.select("pid", "cell", "codes"), "pid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            code = matrix(batch, "codes").astype(np.int64)
            rebuilt = np.concatenate([book[j][code[:, j]] for j in range(len(book))], axis=1)
            error = np.sqrt(((matrix(batch, "residual") - rebuilt) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("pid", "cell", "codes")), pa.array(error)], names=["pid", "cell", "codes", "error"]
            )

    return rows.mapInArrow(run, "pid bigint, cell int, codes array<smallint>, error double")


def pq_exact_topk(
    queries: DataFrame,
    codes: DataFrame,
    vectors: DataFrame,
    centroids: DataFrame,
    codebook: DataFrame,
    k: int,
    nprobe: int,
    exclude_self: bool = False,
    query_rows: int = 4096,
    doc_rows: int = 32_768,
    counts: DataFrame | None = None,
    rescored: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(qid, pid, rank, score): the k nearest by squared L2 distance among the vectors
    of the probed cells, found by their codes.

    ``codes`` has the ``error`` of :func:`with_code_errors`: a vector is at most that much
    nearer or farther than its codes say. A first pass over the codes sends the k least upper bounds of each
    query and block; the k-th of all blocks is the query's limit. In a second pass, vectors (pid, embedding)
    travel with their codes; what is surely not nearer than the limit is left out, the rest is scored on its
    vectors inside the block. Either pass sends k rows a query and block, however little the
    codes tell apart. With ``rescored`` a table (qid, n_scored, n_probed) is returned too.
    """
    shared = queries.sparkSession.sparkContext.broadcast(_codebook(codebook))

    def bounds(left: pa.Table, right: pa.Table):
        """Two functions of a slice of the queries, the least and the greatest distance to all documents of a
        block: a vector is at most its error away from what its codes stand for, and the distances
        to that are one product."""
        book = shared.value
        gap, code = matrix(left, "residual"), matrix(right, "codes").astype(np.int64)
        rebuilt = np.concatenate([book[j][code[:, j]] for j in range(len(book))], axis=1)
        qids, pids = left.column("qid").to_numpy(), right.column("pid").to_numpy()
        error = right.column("error").to_numpy() * (1 + 1e-12)
        apart, slack = scorer(gap, rebuilt, "l2"), rounding(gap, rebuilt, "l2")[:, None]

        def bound(rows, sign):
            found = apart(rows)  # negative squares
            found -= sign * slack[rows]
            np.sqrt(np.maximum(0.0, np.negative(found, out=found), out=found), out=found)
            found += sign * error
            if exclude_self:
                found[qids[rows, None] == pids[None, :]] = np.inf
            return found

        return lambda rows: bound(rows, -1), lambda rows: bound(rows, 1)

    def limit_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64())], ["qid", "high"])
        qids, (_, greatest) = left.column("qid").to_numpy(), bounds(left, right)
        width, step, least = min(k, len(right)), max(1, BLOCK_CELLS // len(right)), []
        for a in range(0, len(qids), step):
            least.append(np.partition(greatest(slice(a, a + step)), width - 1, axis=1)[:, :width])
        high = np.concatenate(least).ravel()
        found = np.isfinite(high)
        return pa.Table.from_arrays([pa.array(np.repeat(qids, width)[found]), pa.array(high[found])], ["qid", "high"])

    def score_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "pid", "score", "scored", "met"]
        if not (len(left) and len(right)):
            return pa.Table.from_arrays([pa.array([], pa.float64() if c == "score" else pa.int64()) for c in names], names)
        qids, pids, (least, _) = left.column("qid").to_numpy(), right.column("pid").to_numpy(), bounds(left, right)
        limit = left.column("limit").to_numpy()[:, None]
        asked, docs = matrix(left), matrix(right)
        whole = scorer(asked, docs, "l2")
        scored = np.zeros(len(qids), dtype=np.int64)

        def score(rows):
            low = least(rows)
            near = (low <= limit[rows]) & np.isfinite(low)
            scored[rows] = near.sum(axis=1)
            return np.where(near, whole(rows), -np.inf)

        q, p, distance = best_hits(qids, pids, score, k, exclude_self, None, rounding(asked, docs, "l2"), squares_apart(asked, docs))
        hits = [pa.array(x) for x in (q, p, distance)]
        counts = [pa.array(qids), *(pa.nulls(len(qids), x.type) for x in hits[1:])]  # and a row of counts for each query
        zeros = np.zeros(len(q), dtype=np.int64)
        numbers = [np.r_[zeros, scored], np.r_[zeros, np.full(len(qids), len(pids))]]
        return pa.Table.from_arrays([*(pa.concat_arrays(pair) for pair in zip(hits, counts)), *map(pa.array, numbers)], names)

    probes = stored(nearest_cells(queries.select("qid", "embedding"), centroids, nprobe))
    gaps = residuals(probes, centroids, "qid").select("qid", "cell", "residual")
    asked = probed(codes, probes).select("pid", "cell", "codes", "error")
    bounded = _grid(gaps, asked, query_rows, doc_rows, counts).applyInArrow(limit_block, "qid bigint, high double")
    nearest = Window.partitionBy("qid").orderBy("high")
    limits = bounded.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") == k).select("qid", F.col("high").alias("limit"))
    limits = stored(limits)  # a number a query; the second pass counts its queries before it joins them
    limited = gaps.join(limits, "qid", "left").withColumn("limit", F.coalesce("limit", F.lit(np.finfo(float).max)))
    limited = limited.join(queries.select("qid", "embedding"), "qid")
    placed = asked.join(vectors.select("pid", "embedding"), "pid").select("pid", "cell", "codes", "error", "embedding")
    found = _grid(limited, placed, query_rows, doc_rows, counts).applyInArrow(
        score_block, "qid bigint, pid bigint, score double, scored bigint, met bigint"
    )
    found = stored(found) if rescored else found
    hits = ranked(found.filter(F.col("pid").isNotNull()).select("qid", "pid", "score"), k, "l2")
    if not rescored:
        return hits
    sums = found.groupBy("qid").agg(F.sum("scored").alias("n_scored"), F.sum("met").alias("n_probed"))
    return hits, sums.filter(F.col("n_scored") > 0)


# --- deep lists -------------------------------------------------------------------------


def deep_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    metric: str = "dot",
    exclude_self: bool = False,
    bins: int = 4096,
    sent: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(qid, pid, rank, score): the k best of every query, for lists of thousands.

    A first pass over the documents counts each query's scores in ``bins`` equal bins between the
    least and the greatest score that lengths allow. The counts of all tasks, added up by
    Spark, give the bin in which the k-th score lies; a second pass sends only hits
    from that bin on: about k a query in all, instead of k from each task. Queries are a set
    that fits into every task (its size is checked). With ``sent`` the hits of
    the second pass, before the cut, are returned too.
    """
    spark = docs.sparkSession
    queries, docs = queries.select("qid", "embedding"), docs.select("pid", "embedding")
    table = queries.limit(8193).toArrow()
    if len(table) > 8192 or table.nbytes > BROADCAST_BYTES:
        raise ValueError("deep lists are for up to 8192 queries at a time")
    qids, q = table.column("qid").to_numpy(), matrix(table)
    reach = 1.0
    if metric != "cosine":
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        reach = docs.agg(F.max(length)).first()[0] or 0.0
    lengths = np.linalg.norm(q, axis=1) if len(q) else np.empty(0)
    high = {"dot": lengths * reach, "cosine": np.ones(len(q)), "l2": np.zeros(len(q))}[metric]
    low = {"dot": -high, "cosine": -high, "l2": -((lengths + reach) ** 2)}[metric]
    width = np.maximum((high - low) / (bins - 2), np.finfo(float).tiny)
    shared = spark.sparkContext.broadcast((qids, q, low - width, width))

    def blocks(batches, cells=4_000_000):
        qids, q, low, width = shared.value
        for whole in batches:
            step = max(1, cells // max(1, len(qids)))
            for start in range(0, whole.num_rows if len(qids) else 0, step):
                batch = whole.slice(start, step)
                d, pids = matrix(batch), batch.column("pid").to_numpy()
                if metric == "l2":
                    scores = np.stack([-((d - row) ** 2).sum(axis=1) for row in q])
                else:
                    scores = goodness(q, d, metric)
                own = (qids[:, None] == pids[None, :]) if exclude_self else np.zeros(scores.shape, bool)
                usable = ~own & (scores > -np.inf)
                at = np.where(usable, (scores - low[:, None]) / width[:, None], 0)
                yield qids, pids, scores, usable, np.clip(at, 0, bins - 1).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for qids, _, _, usable, at in blocks(batches):
            flat = (np.arange(len(qids))[:, None] * bins + at)[usable]
            part = np.bincount(flat, minlength=len(qids) * bins)
            total = part if total is None else total + part
        if total is None:
            return
        total = total.reshape(-1, bins)
        above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total  # a task's own k best reach no lower
        i, b = np.nonzero((total > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][i]), pa.array(b, pa.int32()), pa.array(total[i, b])], names=["qid", "bin", "n"])

    counted = docs.mapInArrow(count, "qid bigint, bin int, n bigint").groupBy("qid", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("qid").orderBy(F.col("bin").desc())  # at most ``bins`` rows a query
    above = counted.withColumn("above", F.sum("n").over(down) - F.col("n"))
    least = above.filter(F.col("above") < k).groupBy("qid").agg(F.min("bin").alias("bin")).toArrow()
    known = dict(zip(least.column("qid").to_pylist(), least.column("bin").to_pylist()))
    # a product may differ in its last bits from one block to the next, so the bin below is sent too
    floor = spark.sparkContext.broadcast(np.array([known.get(i, 0) - 1 for i in qids.tolist()], dtype=np.int64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, pids, scores, usable, at in blocks(batches):
            i, j = np.nonzero(usable & (at >= floor.value[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[i]), pa.array(pids[j]), pa.array(scores[i, j])], names=["qid", "pid", "score"]
            )

    hits = docs.mapInArrow(send, HITS)
    return (ranked(hits, k, metric), hits) if sent else ranked(hits, k, metric)


# --- late interaction -------------------------------------------------------------------


def _directions(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cells in order, unit vector of each centre); a centre of length zero has none."""
    table = _table(centroids, ["cell", "embedding"])
    cells = table.column("cell").to_numpy()
    centres = matrix(table)[np.argsort(cells)]
    lengths = np.linalg.norm(centres, axis=1, keepdims=True) if len(centres) else np.ones((0, 1))
    return np.sort(cells), np.divide(centres, lengths, out=np.zeros_like(centres), where=lengths > 0)


def token_signatures(doc_tokens: DataFrame, centroids: DataFrame, doc_max_len: int = 180) -> DataFrame:
    """(pid, cells, along, aside): of each of a document's first tokens its cell, its length along the
    cell's direction and the length of the rest: 12 bytes a token instead of its vector.

    ``doc_tokens`` is (pid, pos, embedding); a document has at most ``doc_max_len`` entries.
    """
    shared = doc_tokens.sparkSession.sparkContext.broadcast(_directions(centroids))
    kept = doc_tokens.filter(F.col("pos") < doc_max_len).select("pid", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, units = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            unit = units[np.searchsorted(cells, batch.column("cell").to_numpy())]
            along = (x * unit).sum(axis=1)
            aside = np.sqrt(((x - along[:, None] * unit) ** 2).sum(axis=1))
            columns = [batch.column("pid"), batch.column("cell"), pa.array(along, pa.float32()), pa.array(aside, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["pid", "cell", "along", "aside"])

    tokens = nearest_cells(kept, centroids).mapInArrow(run, "pid bigint, cell int, along float, aside float")
    entries = tokens.groupBy("pid").agg(F.collect_list(F.struct("cell", "along", "aside")).alias("_t"))
    return entries.select("pid", *[F.col(f"_t.{c}").alias(n) for c, n in (("cell", "cells"), ("along", "along"), ("aside", "aside"))])


def score_bounds(
    candidates: DataFrame, queries: DataFrame, signatures: DataFrame, centroids: DataFrame, doc_max_len: int = 180
) -> DataFrame:
    """(qid, pid, bound): no candidate's late-interaction score is above its bound.

    A query token with part a in a cell's direction and length b beside it meets a token of that cell with
    at most a * along + b * aside. The largest such value over a document's tokens bounds the
    token's maximum, and their sum the score. Products with the cells are formed once for the
    candidates of a query that lie together, then only looked up.
    """
    shared = candidates.sparkSession.sparkContext.broadcast(_directions(centroids))
    met = skewed_join(candidates.select("qid", "pid"), signatures, "pid", [F.col("qid")])
    rows = met.join(queries, "qid")  # a query has a bounded number of candidates

    def flat(batch, name):
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
        cells, units = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                qids = batch.column("qid").to_numpy()
                bound = np.empty(len(qids))
                for qid in np.unique(qids):
                    mine = np.flatnonzero(qids == qid)
                    some = batch.take(pa.array(mine))
                    q = flat(some.slice(0, 1), "query").reshape(some.column("query_n")[0].as_py(), -1)
                    used, place = np.unique(np.searchsorted(cells, flat(some, "cells")), return_inverse=True)
                    part = q @ units[used].T
                    length = np.linalg.norm(q, axis=1, keepdims=True)
                    rest = np.sqrt(np.maximum(0.0, length**2 - part**2))
                    along, aside = flat(some, "along"), flat(some, "aside")
                    # the last term covers rounding, of the stored lengths above all
                    most = part[:, place] * along + rest[:, place] * aside + 1e-6 * length * (np.abs(along) + aside)
                    n = np.diff(some.column("cells").offsets.to_numpy())
                    best = np.maximum.reduceat(most, np.r_[0, n.cumsum()[:-1]], axis=1)
                    bound[mine] = np.where(n < doc_max_len, np.maximum(best, 0.0), best).sum(axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("pid"), pa.array(bound)], names=["qid", "pid", "bound"])

    return rows.mapInArrow(run, "qid bigint, pid bigint, bound double")


def bounded_late_interaction(
    candidates: DataFrame,
    query_tokens: DataFrame,
    docs: DataFrame,
    signatures: DataFrame,
    centroids: DataFrame,
    query_max_len: int = 32,
    doc_max_len: int = 180,
    save_k: int = 1000,
    scored: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The rows of ``ranking.late_interaction``, with matrices only for candidates that could be among
    the ``save_k`` best.

    ``docs`` are ``ranking.document_rows`` kept by ``storage.bucketed`` on ``pid``, ``signatures`` those of
    :func:`token_signatures`. A query's candidates are taken by falling bound, ``save_k`` at first
    and then in waves of twice as many; the save_k-th score so far is a floor, and the
    query is done when no bound left reaches it. Candidates carry their query's matrix to the
    documents, which don't move. With ``scored`` a table (qid, n_scored, n_candidates) is returned too.

    A candidate given twice counts once. A document without tokens or a query without tokens
    has no row, as in ``late_interaction``.
    """
    queries = stored(query_rows(query_tokens, query_max_len))
    pairs = candidates.select("qid", "pid").distinct()
    down = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "pid")
    bounds = score_bounds(pairs, queries, signatures, centroids, doc_max_len)
    bounds = stored(bounds.withColumn("place", F.row_number().over(down)))
    done, width, hits, parts = 0, save_k, None, []
    left = bounds
    while True:
        wave = left.filter(F.col("place") <= done + width).select("qid", "pid")
        part = stored(score_pairs(wave, queries, docs, doc_max_len, stored_join))
        parts.append(part)
        hits = stored(ranked_pairs(part if hits is None else hits.drop("rank").unionByName(part), save_k))
        done, width = done + width, 2 * width
        floor = hits.filter(F.col("rank") == save_k).select("qid", F.col("score").alias("floor"))
        left = bounds.filter(F.col("place") > done).join(floor, "qid").filter(F.col("bound") >= F.col("floor"))
        if left.isEmpty():
            break
    if not scored:
        return hits
    met = parts[0]
    for more in parts[1:]:
        met = met.unionByName(more)
    known = bounds.groupBy("qid").agg(F.count("*").alias("n_candidates"))
    return hits, met.groupBy("qid").agg(F.count("*").alias("n_scored")).join(known, "qid")
