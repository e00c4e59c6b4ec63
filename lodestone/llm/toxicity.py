"""Toxic spans by a linear-chain conditional random field, and document scores from them.

The labels mark documents, so tokens are labelled first: in documents marked
toxic, a token counts as toxic when its word, or its first letters, occur
almost only in such documents. A two-state chain model learns from these
tokens; forward-backward marginals give the spans, and two summaries of the
marginals give the document's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import column_bytes, map_arrow, stored
from .words import Hashes, blocks, lower_table, mixed, word_spans, word_table

CHAIN = 32  # tokens of a chain; a longer text is several chains
BITS = 20  # weights are kept in a table of 2**BITS places
HEADS = (4, 5, 6)  # bytes of a word's beginning that are features
SUMMARY = "array<double>"


@dataclass
class Model:
    """Weights of the chain and of the document score. ``prior`` is set, and the
    rest unused, when the labels have one class only."""

    weights: np.ndarray
    transition: np.ndarray  # into the toxic state minus out of it, from either state
    calibration: np.ndarray
    prior: float | None = None


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents, by the checksum of the id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def token_table(data: np.ndarray, starts: np.ndarray, count: int):
    """(document, start, end, strong, all) of the tokens of a block. ``strong``
    has a hash per token for the word and its beginnings (0 for a beginning
    longer than the word); ``all`` adds the neighbours."""
    data = lower_table()[data]
    begin, end = word_spans(data, word_table())
    doc = np.searchsorted(starts, begin, side="right") - 1
    hashes = Hashes(data)
    word = hashes.of(begin, end)
    strong = [word]
    for k in HEADS:
        cut = np.minimum(begin + k, end)
        head = mixed(hashes.of(begin, cut) + np.uint64(k))
        strong.append(np.where(end - begin >= k, head, np.uint64(0)))
    before, after = np.zeros_like(word), np.zeros_like(word)
    if len(word) > 1:
        same = doc[1:] == doc[:-1]
        before[1:] = np.where(same, mixed(word[:-1] + np.uint64(11)), 0)
        after[:-1] = np.where(same, mixed(word[1:] + np.uint64(13)), 0)
    size = mixed(np.minimum(end - begin, 12).astype(np.uint64) + np.uint64(1))
    return doc, begin, end, strong, [*strong, before, after, size]


def chains(doc: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Place of each token in a table of chains: CHAIN columns, a document's
    chains in consecutive rows. Also the number of rows and each row's document."""
    if not len(doc):
        return np.empty(0, np.int64), 0, np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.r_[first, len(doc)])
    rows = -(-sizes // CHAIN)
    row_start = np.cumsum(rows) - rows
    within = np.arange(len(doc)) - np.repeat(first, sizes)
    return np.repeat(row_start, sizes) * CHAIN + within, int(rows.sum()), np.repeat(doc[first], rows)


def marginals(emission: np.ndarray, present: np.ndarray, transition: np.ndarray):
    """Probability of the toxic state for every place, and of each pair of
    neighbouring states. ``emission`` is the score of the toxic state; the other
    state scores 0. ``transition[a]`` is the score of going to the toxic state
    from state a. Absent places are at the end of a row."""
    rows, width = emission.shape
    gate = np.exp(np.clip(transition, -30, 30))
    local = np.exp(np.clip(emission, -30, 30))
    forward = np.empty((width, 2, rows))
    backward = np.ones((width, 2, rows))
    for t in range(width):
        if t == 0:
            stay, toxic = np.ones(rows), local[:, 0] * gate[0]
        else:
            stay = forward[t - 1, 0] + forward[t - 1, 1]
            toxic = (forward[t - 1, 0] * gate[0] + forward[t - 1, 1] * gate[1]) * local[:, t]
        total = stay + toxic
        forward[t, 0], forward[t, 1] = stay / total, toxic / total
    for t in range(width - 2, -1, -1):
        on = present[:, t + 1]
        toxic = local[:, t + 1] * backward[t + 1, 1]
        from_clean = backward[t + 1, 0] + gate[0] * toxic
        from_toxic = backward[t + 1, 0] + gate[1] * toxic
        total = from_clean + from_toxic
        backward[t, 0] = np.where(on, from_clean / total, 1.0)
        backward[t, 1] = np.where(on, from_toxic / total, 1.0)
    both = forward * backward
    return both[:, 1] / (both[:, 0] + both[:, 1]), forward, backward, gate, local


def summaries(probability: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """Two numbers per document: the log-odds of its likeliest token, and the
    logarithm of the expected number of toxic tokens (as a noisy or)."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    out = np.empty((count, 2))
    top = np.full(count, 1e-6)
    np.maximum.at(top, doc, p)
    out[:, 0] = np.log(top / (1 - top))
    out[:, 1] = np.log(1e-6 + np.bincount(doc, -np.log1p(-p), minlength=count))
    return out


def places(hashes: list[np.ndarray]) -> np.ndarray:
    """Weight places of the features of each token."""
    keep = np.uint64(2**BITS - 1)
    return np.stack([(mixed(h + np.uint64(97 * i)) & keep).astype(np.int32) for i, h in enumerate(hashes)], axis=1)


def token_probabilities(model: Model, features: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    at, rows, _ = chains(doc)
    emission = np.zeros(rows * CHAIN)
    present = np.zeros(rows * CHAIN, dtype=bool)
    emission[at] = model.weights[places(features)].sum(axis=1)
    present[at] = True
    p = marginals(emission.reshape(rows, CHAIN), present.reshape(rows, CHAIN), model.transition)[0]
    return p.T.reshape(-1)[at]


# --- training -----------------------------------------------------------------------------


def train(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = 8_000,
    clean_rows: int = 16_000,
    chain_rows: int = 6_000,
    strong_words: int = 20_000,
    steps: int = 80,
) -> Model:
    """Learn from the labelled documents outside the held-out fifth.

    Bounded sample, as parameters: ``toxic_rows`` and ``clean_rows`` labelled
    documents (by the hash of their id), of which exact copies count once;
    ``chain_rows`` chains with and as many without a toxic token;
    ``strong_words`` words and beginnings. A document with several label rows
    counts as toxic if one of them says so; labels without a document, and null
    labels or ids, are ignored.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
    )
    mark = F.xxhash64("doc_id")
    chosen = (
        known.filter("_toxic = 1").orderBy(mark, "doc_id").limit(toxic_rows)
        .unionByName(known.filter("_toxic = 0").orderBy(mark, "doc_id").limit(clean_rows))
    )
    sample = stored(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most toxic_rows + clean_rows numbers
        .dropDuplicates(["text", "_toxic"])
        .select("text", F.col("_toxic").cast("int").alias("toxic"))
    )
    found = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = np.zeros(2**BITS, dtype=np.float32)
    if not found.get(0) or not found.get(1):
        return Model(empty, np.zeros(2), np.zeros(3), prior=float(bool(found.get(1))))

    strong = _strong_features(sample, strong_words)
    weights, transition = _fit_chain(*_training_chains(sample, strong, chain_rows), steps)
    model = Model(weights, transition, np.zeros(3))
    rows = map_arrow(sample, _summaries_of(model), "toxic int, summary array<double>").collect()
    x = np.array([r["summary"] for r in rows])
    model.calibration = _fit_logistic(x, np.array([r["toxic"] for r in rows], dtype=float))
    return model


def _strong_features(sample: DataFrame, limit: int) -> np.ndarray:
    """Words and beginnings found almost only in toxic documents."""

    def each(batch):
        toxic = np.array(batch.column("toxic").to_pylist())
        keys, values = [], []
        for first, last, data, starts in blocks(column_bytes(batch, "text")):
            doc, _, _, strong, _ = token_table(data, starts, last - first)
            for h in strong:
                once = np.unique(np.stack([h, doc.astype(np.uint64)], axis=1)[h != 0], axis=0)
                keys.append(once[:, 0])
                values.append(toxic[first + once[:, 1].astype(np.int64)])
        if keys:
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            marks = np.concatenate(values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.view(np.int64)),
                    pa.array(np.bincount(at)),
                    pa.array(np.bincount(at, marks).astype(np.int64)),
                ],
                names=["h", "n", "toxic"],
            )

    counted = map_arrow(sample, each, "h long, n long, toxic long").groupBy("h")
    counted = counted.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    least = 5
    best = counted.filter((F.col("toxic") >= least) & (F.col("toxic") >= 0.95 * F.col("n")))
    top = best.orderBy(F.col("toxic").desc(), "h").limit(limit).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64))


def _training_chains(sample: DataFrame, strong: np.ndarray, limit: int):
    """Feature places and labels of the sampled chains, CHAIN tokens a row (-1: absent)."""

    def each(batch):
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=bool)
        for first, last, data, starts in blocks(column_bytes(batch, "text")):
            doc, _, _, hashes, features = token_table(data, starts, last - first)
            if not len(doc):
                continue
            hit = np.zeros(len(doc), dtype=bool)
            for h in hashes:
                hit |= np.isin(h, strong)
            hit &= toxic[first + doc]
            at, rows, owner = chains(doc)
            width = len(features)
            table = np.full((rows * CHAIN, width), -1, dtype=np.int32)
            table[at] = places(features)
            label = np.full(rows * CHAIN, -1, dtype=np.int8)
            label[at] = hit
            label = label.reshape(rows, CHAIN)
            has = (label == 1).any(axis=1)
            # a toxic document without a known token says nothing about its chains
            told = np.zeros(last - first, dtype=bool)
            np.logical_or.at(told, doc, hit)
            use = has | ~toxic[first + owner] | told[owner]
            # by the text and the chain's number in it: the same sample on any partitioning
            ends = np.r_[starts[1:] - 1, len(data)]
            number = np.arange(rows) - np.searchsorted(owner, owner)
            mark = mixed(Hashes(data).of(starts, ends)[owner] + number.astype(np.uint64) * np.uint64(7919))
            keep = np.flatnonzero(use)
            keep = keep[np.lexsort((mark[keep], ~has[keep]))]
            keep = np.concatenate([keep[has[keep]][:limit], keep[~has[keep]][:limit]])
            wide = table.reshape(rows, CHAIN * width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([wide[i].tobytes() for i in keep], pa.binary()),
                    pa.array([label[i].tobytes() for i in keep], pa.binary()),
                    pa.array(has[keep]),
                    pa.array((mark[keep] >> np.uint64(1)).astype(np.int64)),
                ],
                names=["features", "labels", "has", "mark"],
            )

    rows = stored(map_arrow(sample, each, "features binary, labels binary, has boolean, mark long"))
    taken = [
        r
        for value in (True, False)
        for r in rows.filter(F.col("has") == value).orderBy("mark", "features").limit(limit).collect()
    ]
    labels = np.stack([np.frombuffer(r["labels"], dtype=np.int8) for r in taken])
    features = np.stack([np.frombuffer(r["features"], dtype=np.int32) for r in taken])
    return features.reshape(len(taken), CHAIN, -1), labels


def _fit_chain(features: np.ndarray, labels: np.ndarray, steps: int, l2: float = 1e-4):
    """Gradient ascent (Adam) on the conditional likelihood of the chains."""
    rows, width, kinds = features.shape
    present = labels >= 0
    used, index = np.unique(features[present], return_inverse=True)
    index = index.reshape(-1, kinds)
    truth = labels[present].astype(float)
    wanted = (labels == 1).astype(float)
    weights, transition = np.zeros(len(used)), np.zeros(2)
    state = [np.zeros(len(used) + 2), np.zeros(len(used) + 2)]
    flat = index.T.reshape(-1)
    previous_clean = np.concatenate([np.ones((rows, 1)), 1 - wanted[:, :-1]], axis=1)
    previous_toxic = np.concatenate([np.zeros((rows, 1)), wanted[:, :-1]], axis=1)
    seen = np.array([(wanted * previous_clean)[present].sum(), (wanted * previous_toxic)[present].sum()])
    for step in range(1, steps + 1):
        emission = np.zeros((rows, width))
        emission[present] = weights[index].sum(axis=1)
        p, forward, backward, gate, local = marginals(emission, present, transition)
        into = np.zeros(2)
        into[0] += p[0].sum()
        for t in range(1, width):
            on = present[:, t]
            toxic = local[:, t] * backward[t, 1]
            clean = backward[t, 0]
            mass = [forward[t - 1, a] * gate[a] * toxic for a in (0, 1)]
            total = mass[0] + mass[1] + (forward[t - 1, 0] + forward[t - 1, 1]) * clean
            for a in (0, 1):
                into[a] += (mass[a] / total)[on].sum()
        gap = truth - p.T[present]
        slope = np.bincount(flat, np.tile(gap, kinds), minlength=len(used)) - l2 * rows * weights
        gradient = np.concatenate([slope, seen - into]) / rows
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights, transition = weights + move[:-2], transition + move[-2:]
    table = np.zeros(2**BITS, dtype=np.float32)
    table[used] = weights
    return table, transition


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of the summaries and a constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
    return w


def _summaries_of(model: Model):
    def each(batch):
        texts = column_bytes(batch, "text")
        out = np.empty((len(texts), 2))
        for first, last, data, starts in blocks(texts):
            doc, _, _, _, features = token_table(data, starts, last - first)
            p = token_probabilities(model, features, doc) if len(doc) else np.empty(0)
            out[first:last] = summaries(p, doc, last - first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["toxic", "summary"]
        )

    return each


# --- scoring ------------------------------------------------------------------------------


def scores(model: Model, texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
    """Score and spans of each text."""
    value = np.full(len(texts), model.prior if model.prior is not None else 0.0)
    spans = [""] * len(texts)
    if model.prior is not None:
        return value, spans
    for first, last, data, starts in blocks(texts):
        doc, begin, end, _, features = token_table(data, starts, last - first)
        p = token_probabilities(model, features, doc) if len(doc) else np.empty(0)
        x = np.column_stack([summaries(p, doc, last - first), np.ones(last - first)])
        value[first:last] = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
        for i in np.flatnonzero(p > 0.5):
            d = int(doc[i])
            mark = f"{begin[i] - starts[d]}:{end[i] - starts[d]}"
            spans[first + d] += f",{mark}" if spans[first + d] else mark
    return value, spans


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``.
    Null and empty texts score as texts without tokens; rows that repeat are
    judged each by itself; no rows give no rows."""

    def each(batch):
        yield batch.filter(pa.array(scores(model, column_bytes(batch, "text"))[0] < threshold))

    return map_arrow(docs, each, docs.schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) and
    spans: "start:end" byte offsets of tokens likelier toxic than not, joined by
    commas. One row per row of ``docs``; null and empty texts are scored as
    texts without tokens; only the text enters the score. A null id counts as
    the empty text and is held out."""

    def each(batch):
        value, spans = scores(model, column_bytes(batch, "text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(value),
             pa.array((value >= threshold).astype(np.int32)), pa.array(spans)],
            names=["doc_id", "held_out", "score", "predicted", "spans"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_arrow(rows, each, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")
