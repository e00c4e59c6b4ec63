"""Repeated byte strings across a corpus, by run-compressed Burrows-Wheeler indexes.

Any two equal windows of ``length`` bytes choose the same anchor (the least
hash of a shorter gram), so windows can only be equal to windows of the same
anchor. Anchors that occur once are done with. For the others, the text around
each is sent to the bucket of its anchor, exact copies are merged on the way,
and each bucket builds a run-compressed Burrows-Wheeler transform of what is
left: only the suffixes at the heads of its runs are sampled, with their
predecessors in suffix order and the length they share. One pass over the
texts then streams, from sample to sample, the matching statistics of every
position; positions that match for ``length`` bytes or more are chained, and all
but the earliest of a chain are repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import map_arrow, stored, utf8
from .words import Hashes, blocks, mixed

LEAST = -(2**63)  # stands for a null id, which comes first
DOC = [("id", "<i8"), ("mark", "<i4")]
KEYED = np.dtype([("hash", "<u8"), *DOC, ("at", "<i4"), ("low", "<i4"), ("high", "<i4")])
SPAN = np.dtype([*DOC, ("first", "<i4"), ("last", "<i4")])
BY_BUCKET = "bucket long, group long, payload binary"  # of anchors; groups are of documents
BY_GROUP = "group long, payload binary"
BY_DOC = "_id long, _mark int, payload binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one payload. Larger ones are compressed, their fields stored one
    after another."""
    if sum(a.nbytes for a in arrays) < 4096:
        return b"\0" + b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays)
    parts = []
    for a in arrays:
        fields = [np.ascontiguousarray(a[f]) for f in a.dtype.names] if a.dtype.names else [a]
        parts.append(np.int64(len(a)).tobytes())
        parts += [np.ascontiguousarray(f.view(np.uint8).reshape(len(a), f.itemsize).T).tobytes() for f in fields]
    raw = b"".join(parts)
    return b"\1" + np.int64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(payload: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    at, out = 1, []
    if payload[0] == 0:
        for kind in map(np.dtype, kinds):
            n = int.from_bytes(payload[at : at + 8], "little")
            out.append(np.frombuffer(payload, kind, n, at + 8))
            at += 8 + n * kind.itemsize
        return out
    size = int(np.frombuffer(payload, np.int64, 1, at)[0])
    raw = pa.Codec("zstd", 1).decompress(payload[9:], decompressed_size=size, asbytes=True)
    at = 0
    for kind in map(np.dtype, kinds):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        at += 8
        a = np.empty(n, kind)
        for f in kind.names or [None]:
            width = kind[f].itemsize if f else kind.itemsize
            plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            values = np.ascontiguousarray(plane).view(kind[f] if f else kind).reshape(n)
            if f:
                a[f] = values
            else:
                a = values
            at += n * width
        out.append(a)
    return out


# --- anchors ------------------------------------------------------------------------------


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each window of ``length`` bytes inside a text of the block, the gram
    with the least hash (the last of equals). Gives per anchor: its place, the
    first and last start of the windows that chose it, its text and its hash."""
    n, width = len(data), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, np.empty(0, np.uint64)
    hashes = Hashes(data)
    value = mixed((hashes.prefix[gram:] - hashes.prefix[:-gram]) * hashes.inverse[: n - gram + 1])
    whole, place, have = value, np.arange(len(value), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = value[: len(value) - step], value[step:]
        later = right <= left
        value = np.where(later, right, left)
        place = np.where(later, place[step:], place[: len(place) - step])
        have += step
    inside = np.zeros(n + 1, dtype=np.int32)
    fits = sizes >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, starts[fits] + sizes[fits] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: len(place)]))
    if not len(windows):
        return none, none, none, none, np.empty(0, np.uint64)
    chosen = place[windows]
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    at, low = chosen[first].astype(np.int64), windows[first]
    high = windows[np.r_[first[1:], len(windows)] - 1]
    return at, low, high, np.searchsorted(starts, at, side="right") - 1, whole[at]


def _anchor_rows(length: int, gram: int, buckets: int):
    """Anchors of a batch. Those that repeat inside the batch are known to, so
    they go past the buckets, and one row tells the bucket of their hash."""

    def each(batch):
        ids = np.array(batch.column("_id").to_numpy(zero_copy_only=False), dtype=np.int64)
        marks = np.array(batch.column("_mark").to_numpy(zero_copy_only=False), dtype=np.int32)
        texts = [x or b"" for x in batch.column("text").to_pylist()]
        once = np.zeros(len(ids), bool)  # rows that repeat a document add nothing
        once[np.unique(np.stack([ids, marks], axis=1), axis=0, return_index=True)[1]] = True
        texts = [t if new else b"" for t, new in zip(texts, once)]
        found = []
        for first, last, data, starts in blocks(texts):
            sizes = np.array([len(t) for t in texts[first:last]], dtype=np.int64)
            at, low, high, doc, hashed = anchors(data, starts, sizes, length, gram)
            rows = np.empty(len(at), KEYED)
            rows["hash"], rows["id"], rows["mark"] = hashed, ids[first + doc], marks[first + doc]
            rows["at"], rows["low"], rows["high"] = at - starts[doc], low - starts[doc], high - starts[doc]
            found.append(rows)
        rows = np.concatenate(found) if found else np.empty(0, KEYED)
        if not len(rows):
            return
        keys, inverse, counts = np.unique(rows["hash"], return_inverse=True, return_counts=True)
        known = counts[inverse] > 1
        own, out = rows[~known], []
        many = counts > 1
        for group, part in _by_group(rows[known], buckets):
            out.append((buckets + group, group, packed(part)))
        bucket = (own["hash"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, bucket = own[order], bucket[order]
        told = np.empty(int(many.sum()), np.dtype([("hash", "<u8"), ("n", "<i8")]))
        told["hash"], told["n"] = keys[many], counts[many]
        told_bucket = (told["hash"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(told_bucket, kind="stable")
        told, told_bucket = told[order], told_bucket[order]
        for b in np.union1d(bucket, told_bucket):
            a, z = np.searchsorted(bucket, [b, b + 1])
            c, d = np.searchsorted(told_bucket, [b, b + 1])
            out.append((int(b), -1, packed(own[a:z], told[c:d])))
        yield _batch(out, BY_BUCKET)

    return each


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _by_group(rows: np.ndarray, groups: int):
    """(group of documents, its rows)."""
    key = rows["id"].view(np.uint64) if rows["id"].flags.c_contiguous else np.ascontiguousarray(rows["id"]).view(np.uint64)
    group = (mixed(key + rows["mark"].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(part):
            yield int(group[part[0]]), rows[part]


def _documents(kind: np.dtype):
    """The rows of a group of documents, a payload for each document."""

    def each(table: pa.Table) -> pa.Table:
        rows = np.unique(np.concatenate([unpacked(p, kind)[0] for p in table.column("payload").to_pylist()]))
        rows = rows[np.lexsort((rows["mark"], rows["id"]))]
        cut = np.flatnonzero((np.diff(rows["id"]) != 0) | (np.diff(rows["mark"]) != 0)) + 1
        out = [(int(p["id"][0]), int(p["mark"][0]), packed(p)) for p in np.split(rows, cut) if len(p)]
        return pa.Table.from_batches([_batch(out, BY_DOC)])

    return each


def _repeated_anchors(buckets: int):
    """The anchors of a bucket that occur more than once in the corpus."""
    told_kind = np.dtype([("hash", "<u8"), ("n", "<i8")])

    def each(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:  # known already
            return table.select(["group", "payload"]).append_column("hot", pa.nulls(len(table), pa.binary()))
        parts = [unpacked(p, KEYED, told_kind) for p in table.column("payload").to_pylist()]
        rows, told = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keys, inverse = np.unique(np.concatenate([rows["hash"], told["hash"]]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([np.ones(len(rows)), told["n"]]), minlength=len(keys)).astype(np.int64)
        again = rows[counts[inverse[: len(rows)]] > 1]
        out = [(group, packed(part), None) for group, part in _by_group(again, buckets)]
        most = np.empty(int((counts >= HOT_LEAST).sum()), told_kind)
        most["hash"], most["n"] = keys[counts >= HOT_LEAST], counts[counts >= HOT_LEAST]
        if len(most):
            out.append((None, None, most.tobytes()))
        return pa.Table.from_batches([_batch(out, BY_GROUP + ", hot binary")])

    return each


HOT_LEAST = 64  # anchors below this number are never hot


# --- contexts -----------------------------------------------------------------------------


def _context_rows(length: int, buckets: int, hot: np.ndarray):
    """The text around each repeated anchor. Exact copies within the batch are
    merged: all but the earliest are repeats as a whole. Anchors in ``hot``
    give a row for every window instead, under the hash of the window, so no
    bucket holds many different texts for one anchor."""

    def each(batch):
        seen: dict[tuple, tuple] = {}
        known: list[tuple[int, int, int, int]] = []
        columns = [batch.column(c).to_pylist() for c in ("_id", "_mark", "text", "payload")]
        for doc, mark, text, payload in zip(*columns):
            rows = unpacked(payload, KEYED)[0]
            if len(hot):
                rows = _split_hot(rows, hot, text, length)
            for key, at, low, high in zip(rows["hash"].tolist(), rows["at"].tolist(), rows["low"].tolist(), rows["high"].tolist()):
                same = (key, at - low, text[low : high + length])
                place = (doc, mark, low)
                other = seen.get(same)
                if other is None or place < other:
                    seen[same], place = place, other
                    other = seen[same]
                if place is not None and place != other:
                    known.append((*place, place[2] + high - low))
        out = [(buckets + group, group, packed(part)) for group, part in _by_group(np.array(known, SPAN), buckets)]
        if seen:
            rows = np.empty(len(seen), KEYED)
            sizes = np.empty(len(seen), np.int32)
            contexts = []
            for i, ((key, offset, context), (doc, mark, low)) in enumerate(seen.items()):
                rows[i] = (key, doc, mark, low + offset, low, low + len(context) - length)
                sizes[i] = len(context)
                contexts.append(context)
            bucket = (rows["hash"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, cuts):
                text = np.frombuffer(b"".join([contexts[i] for i in part]), np.uint8)
                out.append((int(bucket[part[0]]), -1, packed(rows[part], text)))
        yield _batch(out, BY_BUCKET)

    return each


def _split_hot(rows: np.ndarray, hot: np.ndarray, text: bytes, length: int) -> np.ndarray:
    is_hot = hot[np.minimum(np.searchsorted(hot, rows["hash"]), len(hot) - 1)] == rows["hash"]
    if not is_hot.any():
        return rows
    many = rows[is_hot]
    count = many["high"] - many["low"] + 1
    split = np.repeat(many, count)
    split["low"] = split["high"] = np.repeat(many["low"], count) + (np.arange(len(split)) - np.repeat(np.cumsum(count) - count, count))
    split["at"] = split["low"]
    starts = split["low"].astype(np.int64)
    split["hash"] = mixed(Hashes(np.frombuffer(text, np.uint8)).of(starts, starts + length) + np.uint64(1))
    return np.concatenate([rows[~is_hot], split])


def _marks_of_bucket(length: int, buckets: int, chunk: int = 1 << 20):
    """Windows of a bucket's contexts that also start earlier."""

    def each(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return table.select(["group", "payload"])
        groups: dict[int, dict[tuple, list]] = {}
        spans: list[tuple[int, int, int, int]] = []
        for payload in table.column("payload").to_pylist():
            rows, text = unpacked(payload, KEYED, np.dtype(np.uint8))
            text, end = text.tobytes(), 0
            for key, doc, mark, at, low, high in rows.tolist():
                begin, end = end, end + high - low + length
                same = groups.setdefault(key, {})
                variant = (at - low, text[begin:end])
                place, other = (doc, mark, low), same.get(variant)
                if other is None or place < other:
                    same[variant], place, other = place, other, place
                if place is not None and place != other:
                    spans.append((*place, place[2] + high - low))
        contexts, total = [], 0
        for same in groups.values():
            if len(same) < 2:
                continue
            # in order of the anchors' places: equal windows then come in the order of the corpus
            for (offset, context), place in sorted(same.items(), key=lambda x: (x[1][:2], x[1][2] + x[0][0])):
                contexts.append((context, place))
                total += len(context)
            if total >= chunk:
                _mark_contexts(contexts, length, spans)
                contexts, total = [], 0
        _mark_contexts(contexts, length, spans)
        out = [(group, packed(part)) for group, part in _by_group(np.array(spans, SPAN), buckets)]
        return pa.Table.from_batches([_batch(out, BY_GROUP)])

    return each


def _mark_contexts(contexts, length: int, spans) -> None:
    if not contexts:
        return
    index = RunIndex([c for c, _ in contexts])
    repeated = index.repeats(length)
    if not len(repeated):
        return
    number = index.text_of[repeated]
    within = repeated - index.starts[number]
    cut = np.flatnonzero((np.diff(repeated) != 1) | (np.diff(number) != 0)) + 1
    for a, z in zip(np.r_[0, cut], np.r_[cut, len(repeated)]):
        doc, mark, low = contexts[number[a]][1]
        spans.append((doc, mark, low + int(within[a]), low + int(within[z - 1])))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a list of texts, with the
    suffixes at the heads of its runs, their predecessors and shared lengths."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.text_of = np.repeat(np.arange(len(texts)), sizes)
        self.ends = (self.starts + sizes - 1)[self.text_of]  # place of the end mark of each place's text
        self.data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        order = self._suffixes()
        before = np.where(order == self.starts[self.text_of[order]], -1, self.data[order - 1].astype(np.int16))
        heads = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (before[1:] < 0)])
        place = order[heads]
        self.runs = len(heads)
        earlier = order[np.maximum(heads - 1, 0)]
        shared = self._shared(place, earlier)
        shared[heads == 0] = 0
        by_place = np.argsort(place)
        self.sample, self.earlier, self.shared = place[by_place], earlier[by_place], shared[by_place]

    def _suffixes(self) -> np.ndarray:
        """All suffixes in order, by prefix doubling; texts end in marks that
        are smaller than any byte and ordered among themselves."""
        n = len(self.data)
        place = np.arange(n)
        symbol = np.where(place == self.ends, np.uint64(0), self.data.astype(np.uint64) + np.uint64(1))
        key, reach = np.zeros(n, np.uint64), self.ends
        for i in range(7):
            at = place + i
            key = key * np.uint64(257) + np.where(at < reach, symbol[np.minimum(at, n - 1)], np.uint64(0))
        mark = place == self.ends
        key[mark] = self.text_of[mark].astype(np.uint64)
        known = 7
        while True:
            order = np.argsort(key)
            sorted_keys = key[order]
            fresh = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(fresh).astype(np.uint64)
            if fresh.all():
                return order
            following = rank[np.minimum(place + known, self.ends)]
            key = (rank << np.uint64(32)) | following
            known *= 2

    def _shared(self, a: np.ndarray, b: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``."""
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        out = np.zeros(len(a), np.int64)
        width = 32
        left = np.flatnonzero(most > 0)
        while len(left):
            again = []
            for i in range(0, len(left), step):
                part = left[i : i + step]
                at = out[part][:, None] + np.arange(width)
                inside = at < most[part][:, None]
                x = self.data[np.minimum(a[part][:, None] + at, len(self.data) - 1)]
                y = self.data[np.minimum(b[part][:, None] + at, len(self.data) - 1)]
                differs = (x != y) | ~inside
                stop = differs.any(axis=1)
                out[part] += np.where(stop, differs.argmax(axis=1), width)
                again.append(part[~stop])
            left = np.concatenate(again)
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place: how long its suffix agrees with the suffix before it
        in order, and where that one is. Streamed from sample to sample: between
        two samples the match moves on by one and gets one shorter."""
        n = len(self.data)
        last = np.repeat(np.arange(len(self.sample)), np.diff(np.r_[self.sample, n]))
        passed = np.arange(n) - self.sample[last]
        return self.shared[last] - passed, self.earlier[last] + passed

    def repeats(self, length: int) -> np.ndarray:
        """Places whose next ``length`` bytes also start at an earlier place."""
        matched, earlier = self.statistics()
        long = matched >= length
        root = np.where(long, earlier, np.arange(len(matched)))
        if not long.any():
            return np.empty(0, np.int64)
        while True:
            following = root[root]
            if np.array_equal(following, root):
                break
            root = following
        places = np.flatnonzero(long)
        first = np.arange(len(root))
        np.minimum.at(first, root[places], places)
        # a chain's root starts it in suffix order, and may itself be a repeat
        ends = np.unique(root[places])
        every = np.union1d(places, ends)
        return every[every > first[root[every]]]


# --- whole corpus -------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, length: int, gram: int, bucket_bytes: int, hot_share: int) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents as (doc_id, _id, _mark, text) dealt by their
    key, and per document the compressed (first, last) starts of windows that
    also start earlier."""
    source = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_id"),
        F.hash("text").alias("_mark"),
        utf8("text").alias("text"),
    )
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // bucket_bytes) + 1

    rows = map_arrow(source.select("_id", "_mark", "text"), _anchor_rows(length, gram, buckets), BY_BUCKET)
    again = stored(rows.groupBy("bucket").applyInArrow(_repeated_anchors(buckets), BY_GROUP + ", hot binary"))
    hot = _hot_anchors(again, max(HOT_LEAST, total // hot_share))
    by_doc = again.filter("payload is not null").select("group", "payload").groupBy("group").applyInArrow(_documents(KEYED), BY_DOC)

    # used twice with the same columns, so that Spark deals the texts out once
    dealt = source.repartition("_id", "_mark").select("doc_id", "_id", "_mark", "text")
    around = dealt.join(by_doc, ["_id", "_mark"]).select("doc_id", "_id", "_mark", "text", "payload")
    contexts = map_arrow(around, _context_rows(length, buckets, hot), BY_BUCKET)
    marks = contexts.groupBy("bucket").applyInArrow(_marks_of_bucket(length, buckets), BY_GROUP)
    return dealt, marks.groupBy("group").applyInArrow(_documents(SPAN), BY_DOC)


def _hot_anchors(again: DataFrame, least: int) -> np.ndarray:
    """Hashes of anchors with at least ``least`` occurrences. An anchor takes a
    few bytes of text at least, so their number is bounded by ``hot_share``."""
    kind = np.dtype([("hash", "<u8"), ("n", "<i8")])

    def each(batch):
        parts = [np.frombuffer(p, kind) for p in batch.column("hot").to_pylist()]
        rows = np.concatenate(parts) if parts else np.empty(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(rows["hash"][rows["n"] >= least].view(np.int64))], names=["hash"])

    found = map_arrow(again.filter("hot is not null").select("hot"), each, "hash long").collect()
    return np.sort(np.array([r["hash"] for r in found], dtype=np.int64).view(np.uint64))


def without_repeats(
    docs: DataFrame, length: int = 100, gram: int = 32, bucket_bytes: int = 8 << 20, hot_share: int = 2_000_000
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) per row of ``docs``.

    Removes each byte covered by a string of ``length`` bytes that also starts
    earlier: in a document with a smaller doc_id, or in the same one further up.
    Judged on the input. Matches never cross documents.

    ``gram`` bytes make an anchor. Buckets of anchors, and groups of documents, hold the anchors, and the differing
    texts around repeated ones, of about ``bucket_bytes`` of corpus. An anchor
    with an occurrence in every ``hot_share`` bytes or more is hot: its windows
    are dealt out one by one, by their own hashes.

    Null texts are empty; a null doc_id comes first. Rows of the same doc_id
    come in the order of a hash of their texts; rows that agree in both are one
    document, and each gets its result. An empty table gives no rows.
    """
    dealt, spans = repeated_spans(docs, length, gram, bucket_bytes, hot_share)

    def each(batch):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, payload in zip(batch.column("text").to_pylist(), batch.column("payload").to_pylist()):
            n_bytes.append(len(text))
            if not payload:
                n_removed.append(0), n_spans.append(0), kept.append(text)
                continue
            rows = unpacked(payload, SPAN)[0]
            covered = np.zeros(len(text) + 1, np.int32)
            np.add.at(covered, rows["first"], 1)
            np.add.at(covered, rows["last"].astype(np.int64) + length, -1)
            gone = np.cumsum(covered[:-1]) > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    whole = dealt.join(spans, ["_id", "_mark"], "left").select("doc_id", "_id", "_mark", "text", "payload")
    return map_arrow(whole, each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
