"""Near copies by SimHash fingerprints, found with multi-index hashing.

Fingerprints are cut into segments. Two that differ in few bits agree, or
nearly agree, in at least one segment, so each looks up the small Hamming ball
around its own segments, and whole distances are checked where two meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .tables import balanced_lookup, column_bytes, map_arrow, stored

SEED = 42
BITS = 64


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint (as a signed number) of
    every row.

    Words are runs of other bytes than space and \\x09-\\x0D, after lower-casing
    A-Z; ``shingle`` consecutive words, joined by a space, are hashed (XXH64 of
    the UTF-8 bytes, seed 42), each as often as it occurs; a shorter text is one
    shingle. A bit is set if it is set in more than half the hashes. Texts
    without words, and null, get zero.
    """

    def each(batch):
        out = np.zeros(batch.num_rows, dtype=np.uint64)
        for i, text in enumerate(column_bytes(batch, "text")):
            words = text.lower().split()
            if words:
                out[i] = _fingerprint(words, shingle)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_mark"), pa.array(out.view(np.int64))],
            names=["doc_id", "_mark", "fingerprint"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("_mark"), "text")
    return map_arrow(rows, each, f"doc_id {kind}, _mark long, fingerprint long")


def _fingerprint(words: list[bytes], shingle: int) -> int:
    text, count = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:count].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts, ends)), dtype=np.uint64, count=count)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def segments(count: int, level: int = 0) -> list[list[int]]:
    """Per path, the bits of its ``count`` segments of nearly equal width, as
    masks. There is one path at first; each segment of a path is a path of the
    next level, and there the bits outside the segments taken are cut anew."""
    left = [(1 << BITS) - 1]
    for _ in range(level + 1):
        paths = []
        for free in left:
            bits = [1 << b for b in range(BITS) if free >> b & 1]
            paths.append([sum(bits[len(bits) * i // count : len(bits) * (i + 1) // count]) for i in range(count)])
        left = [free & ~mask for free, masks in zip(left, paths) for mask in masks]
    return paths


class Places:
    """Where the rows (place, path, fingerprint) of one level meet at the next."""

    def __init__(self, distance: int, count: int, level: int):
        self.radius, self.count, self.paths = distance // count, count, segments(count, level)
        if self.radius > 1:
            raise ValueError("use more than distance / 2 segments")
        self.widest = max(mask.bit_count() for masks in self.paths for mask in masks)

    def _of_path(self, entries) -> Column:
        """The fixed (number, mask, bit) structs of a row's path."""

        def fixed(number, mask, bit):
            return f"named_struct('number', {number}, 'mask', {_signed(mask)}L, 'bit', {_signed(bit)}L)"

        paths = ", ".join(f"array({', '.join(fixed(*e) for e in entries(masks))})" for masks in self.paths)
        return F.element_at(F.expr(f"array({paths})"), F.col("path") + 1)

    def _place(self, number: Column, value: Column, own: bool) -> Column:
        # texts whose places collide are compared needlessly, nothing else
        return F.struct(
            F.xxhash64("place", number, value).alias("place"),
            (F.col("path") * self.count + number).alias("path"),
            F.lit(own).alias("own"),
        )

    def parts(self) -> Column:
        """(number, value) of each segment."""
        every = self._of_path(lambda masks: [(n, mask, 0) for n, mask in enumerate(masks)])
        return F.transform(
            every, lambda e: F.struct(e["number"].alias("number"), F.col("fingerprint").bitwiseAND(e["mask"]).alias("value"))
        )

    def own(self, part: Column) -> Column:
        return self._place(part["number"], part["value"], True)

    def around(self, value: Column, number: Column | None = None) -> Column:
        """The places one bit below the segments of ``value`` (below segment ``number``)."""
        bits = self._of_path(
            lambda masks: [(n, mask, 1 << b) for n, mask in enumerate(masks) for b in range(BITS) if mask >> b & 1]
        )
        has = F.filter(
            bits, lambda e: (value.bitwiseAND(e["bit"]) != 0) & (F.lit(True) if number is None else e["number"] == number)
        )
        return F.transform(has, lambda e: self._place(e["number"], value.bitwiseAND(e["mask"]).bitwiseXOR(e["bit"]), False))

    def lookups(self, rows: DataFrame) -> DataFrame:
        """(place, path, own, fingerprint): every fingerprint in the places of its
        segments and of their Hamming balls of radius ``distance // count``. Of two
        segments that differ only the larger one looks up the smaller: both would
        find the same pair."""
        found = F.transform(self.parts(), self.own)
        if self.radius:
            found = F.concat(found, self.around(F.col("fingerprint")))
        return rows.select(F.explode(found).alias("k"), "fingerprint").select("k.*", "fingerprint")

    def hot(self, rows: DataFrame, most: int, list_rows: int) -> DataFrame:
        """Places that may get more than ``most`` fingerprints: those that a segment
        held by many looks up. A place is looked up by at most ``widest + 1``
        segments, so without such a one it stays below ``most``. The list never
        has more than ``list_rows`` rows: in very large tables the bound rises."""
        spread = self.widest + 1 if self.radius else 1
        least = max(most // spread, rows.count() * self.count * spread // list_rows + 1)
        parts = rows.select("place", "path", F.explode(self.parts()).alias("part"))
        heavy = parts.groupBy("place", "path", "part").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        found = F.array(self.own(F.col("part")))
        if self.radius:
            found = F.concat(found, self.around(F.col("part.value"), F.col("part.number")))
        return heavy.select(F.explode(found).alias("k")).select("k.place").distinct()


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(
    prints: DataFrame, distance: int = 4, count: int = 3, most: int = 1 << 14, levels: int = 4, list_rows: int = 1_000_000
) -> DataFrame:
    """Links that connect every two fingerprints at ``distance`` or fewer bits.

    ``prints`` has one row per fingerprint. Fingerprints meet where one's ball
    has the other's segment; a meeting place of n gives at most n - 1 links (a
    spanning forest of the pairs found there), never all pairs.

    Places that may hold more than ``most`` fingerprints are not compared in one
    task: their bits outside the segment are cut into segments anew, and their
    fingerprints meet in the places of these, up to ``levels`` cuts deep. Two
    that differ in ``distance`` bits differ in no more of the bits left, so no
    pair is lost. The list of such places has at most ``list_rows`` rows and is
    broadcast.
    """
    rows = prints.select(F.lit(0).cast("long").alias("place"), F.lit(0).alias("path"), "fingerprint")
    found = None
    for level in range(levels):
        places = Places(distance, count, level)
        sent = places.lookups(rows)
        hot = stored(places.hot(rows, most, list_rows)) if level + 1 < levels else None
        deeper = hot is not None and not hot.isEmpty()
        if deeper:
            rows = stored(sent.join(F.broadcast(hot), "place", "left_semi").select("place", "path", "fingerprint"))
            sent = sent.join(F.broadcast(hot), "place", "left_anti")
        part = _forests(sent, distance)
        found = part if found is None else found.unionByName(part)
        if not deeper:
            break
    return found


def _forests(sent: DataFrame, distance: int) -> DataFrame:
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = sent.select("place", "fingerprint", "own").repartition(parts, "place").sortWithinPartitions("place")

    def forest(part, last):
        return _forest(part[0][:last], part[1][:last].view(np.uint64), part[2][:last], distance)

    def run(batches):
        held = []  # pieces of one place that may go on
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(part[0]):
                continue
            held.append(part)
            if part[0][-1] == held[0][0][0]:
                continue
            part = [np.concatenate(p) for p in zip(*held)]
            cut = int(np.searchsorted(part[0], part[0][-1]))
            yield forest(part, cut)
            held = [[p[cut:] for p in part]]
        if held:
            part = [np.concatenate(p) for p in zip(*held)]
            yield forest(part, len(part[0]))

    return sorted_rows.mapInArrow(run, "a long, b long")


def _forest(keys: np.ndarray, prints: np.ndarray, own: np.ndarray, distance: int) -> pa.RecordBatch:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    place = np.repeat(np.arange(len(first)), sizes)
    small = np.flatnonzero(sizes[place] <= 16)
    x, at, o = prints[small], place[small], own[small]
    none = np.empty(0, np.int64)
    lefts, rights, places = [none.view(np.uint64)], [none.view(np.uint64)], [none]
    for lag in range(1, 16):
        if len(x) <= lag:
            break
        near = (at[lag:] == at[:-lag]) & (o[lag:] | o[:-lag]) & (np.bitwise_count(x[lag:] ^ x[:-lag]) <= distance)
        lefts.append(x[lag:][near])
        rights.append(x[:-lag][near])
        places.append(at[lag:][near])
    a, b, at = np.concatenate(lefts), np.concatenate(rights), np.concatenate(places)
    # places with more pairs than a forest has, and large places
    full = (np.bincount(at, minlength=len(first)) >= sizes) | (sizes > 16)
    keep = ~full[at]
    a, b = [a[keep]], [b[keep]]
    for i in np.flatnonzero(full):
        p, q = spanning(np.unique(prints[first[i] : first[i] + sizes[i]]), distance)
        a.append(p)
        b.append(q)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"]
    )


def spanning(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of near fingerprints among ``prints``. A
    fingerprint that is reached leaves the list, so in a dense group few
    comparisons are made."""
    left, froms, tos = prints, [], []
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            step = waiting.pop()
            near = np.bitwise_count(left ^ step) <= distance
            if near.any():
                reached, left = left[near], left[~near]
                froms.append(np.full(len(reached), step))
                tos.append(reached)
                waiting.extend(reached)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *froms]), np.concatenate([empty, *tos])


def near_copies(docs: DataFrame, distance: int = 4, shingle: int = 4, count: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id per row.

    Documents whose fingerprints differ in ``distance`` or fewer bits are
    linked; a component's id is its smallest doc_id (null ids are ignored for
    that, and a component of null ids only has a null id). Texts that share a
    fingerprint, also empty and null ones, are one node from the start. Rows
    that repeat keep their own rows; an empty table gives none.
    """
    prints = stored(fingerprints(docs, shingle).drop("_mark"))
    rooted = _rooted(prints, distance, count)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return balanced_lookup(prints, table, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(prints: DataFrame, distance: int, count: int) -> DataFrame:
    """(fingerprint, least, root): per fingerprint, the smallest doc_id that has
    it and the smallest fingerprint it reaches."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fingerprint"), distance, count))
    rooted = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return stored(rooted.withColumn("root", F.coalesce("root", "fingerprint")))


def one_of_each(docs: DataFrame, distance: int = 4, shingle: int = 4, count: int = 3) -> DataFrame:
    """One row of each component of near copies, with all its columns: the one
    with the smallest doc_id (a null id is the largest); among rows of that id the one with
    the smallest hash of its text, and one of rows that agree in both."""
    prints = stored(fingerprints(docs, shingle))
    table = _rooted(prints, distance, count).select("fingerprint", "root")
    return first_of_each(docs, balanced_lookup(prints, table, "fingerprint"))


def first_of_each(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first of their component, as ``one_of_each``
    chooses; ``placed`` has doc_id, a hash of the text and the root of every row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark")).alias("first")
    chosen = placed.groupBy("root").agg(first).select("first.doc_id", "first._mark")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    chosen = chosen.distinct().select(F.col("doc_id").alias("_own"), F.col("_mark").alias("_own_mark"))
    kept = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_text") == F.col("_own_mark")), "left_semi")
    return kept.groupBy("_id", "_text").agg(F.first("row").alias("row")).select("row.*")
