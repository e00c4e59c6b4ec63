"""Passages of a benchmark inside documents, by winnowed word-gram fingerprints.

Of every window of word grams the least hash is kept, on both sides by the same
rule, so any shared window has a kept hash in common. Kept hashes that meet are
extended word by word on the texts themselves: no result rests on a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import column_bytes, map_arrow, stored
from .words import Hashes, blocks, lower_table, mixed, sliding_min, word_spans, word_table

STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    count = max(0, len(words) - size + 1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        total = total * STEP + words[i : i + count]
    return mixed(total)


def winnowed(hashes: np.ndarray, width: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Places kept: those that hold the least hash of some window of ``width``
    hashes. ``whole`` marks, per window start, the windows that count."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.int64)
    least = sliding_min(hashes, width)
    if whole is not None:
        least = np.where(whole[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = ~sliding_min(~padded, width)  # the largest of the least hashes of the windows over a place
    return np.flatnonzero(most == hashes)


class Index:
    """Fingerprints and words of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = [i for i, _ in items]
        self.words: list[list[bytes]] = []
        found: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for number, (_, text) in enumerate(items):
            data = lower_table()[np.frombuffer(text, dtype=np.uint8)]
            begin, end = word_spans(data, word_table())
            hashes = Hashes(data).of(begin, end) if len(begin) else np.empty(0, np.uint64)
            self.words.append([data[a:b].tobytes() for a, b in zip(begin, end)])
            n = len(begin)
            if n >= window:
                grams = gram_hashes(hashes, gram)
                at = winnowed(grams, window - gram + 1)
                found.setdefault(0, []).append((grams[at], number, at))
            elif n:  # one window, looked for at every place
                found.setdefault(n, []).append((gram_hashes(hashes, n), number, np.zeros(1, np.int64)))
        # by kind (0: kept grams; n: whole items of n words): hashes in order, items, places
        self.tables = {}
        for kind, parts in found.items():
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys, kind="stable")
            items_of = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])[order]
            places = np.concatenate([p[2] for p in parts])[order]
            self.tables[kind] = (keys[order], items_of, places)

    def meetings(self, kind: int, hashes: np.ndarray, at: np.ndarray):
        """(place in the block of words, item, place in the item) of equal hashes."""
        keys, items, places = self.tables[kind]
        low = np.searchsorted(keys, hashes[at], side="left")
        high = np.searchsorted(keys, hashes[at], side="right")
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                yield int(at[i]), int(items[j]), int(places[j])


def _hits(index: Index, data: np.ndarray, starts: np.ndarray, count: int):
    """Per document of a block: number of words, hit words, numbers of the items."""
    data = lower_table()[data]
    begin, end = word_spans(data, word_table())
    doc = np.searchsorted(starts, begin, side="right") - 1
    first = np.searchsorted(doc, np.arange(count + 1))  # words of document d: first[d] to first[d + 1]
    hit = np.zeros(len(begin), dtype=bool)
    items: dict[int, set[int]] = {}
    if len(begin):
        words = Hashes(data).of(begin, end)
        text = data.tobytes()

        def same(i, word):
            return text[begin[i] : end[i]] == word

        done: dict[tuple[int, int], int] = {}
        for kind in index.tables:
            least = kind or index.window
            if len(words) < least:
                continue
            whole = doc[: len(doc) - least + 1] == doc[least - 1 :]
            if kind:
                grams = gram_hashes(words, kind)
                at = np.flatnonzero(whole)
            else:
                grams = gram_hashes(words, index.gram)
                at = winnowed(grams, index.window - index.gram + 1, whole)
            for place, item, inside in index.meetings(kind, grams, at):
                line = (item, place - inside)
                if done.get(line, -1) > place:
                    continue  # within a run that has been extended already
                own = index.words[item]
                low, high = first[doc[place]], first[doc[place] + 1]
                a, b, n = place, place, inside
                while b < high and n < len(own) and same(b, own[n]):
                    b, n = b + 1, n + 1
                n = inside - 1
                while a > low and n >= 0 and same(a - 1, own[n]):
                    a, n = a - 1, n - 1
                done[line] = max(b, place + 1)
                if b - a >= least:
                    hit[a:b] = True
                    items.setdefault(int(doc[place]), set()).add(item)
    return np.diff(first), hit, first, items


def item_blocks(items: DataFrame, window: int, gram: int, block_bytes: int):
    """Number of blocks of items, and a function that gives a block's index.
    Items that repeat are taken once, so blocks keep near their size."""
    texts = stored(
        items.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).distinct()
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // block_bytes))

    def index_of(block: int) -> Index:
        chosen = texts.filter(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == block).collect()
        return Index([(r["item"], r["text"].encode()) for r in chosen], window, gram)

    return number, index_of


def without_contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, block_bytes: int = 32 << 20
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have no window of an
    item. Blocks of items are taken one after another, without a shuffle. Null and
    empty texts stay, rows that repeat are judged each by itself, and without
    rows or without items nothing goes."""
    number, index_of = item_blocks(items, window, gram, block_bytes)

    def of_block(rows: DataFrame, index: Index) -> DataFrame:
        def each(batch):
            clean = np.ones(batch.num_rows, dtype=bool)
            for first, last, data, starts in blocks(column_bytes(batch, "text")):
                clean[[first + d for d in _hits(index, data, starts, last - first)[3]]] = False
            yield batch.filter(pa.array(clean))

        return map_arrow(rows, each, docs.schema)

    for block in range(number):
        docs = of_block(docs, index_of(block))
    return docs


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, block_bytes: int = 32 << 20
) -> DataFrame:
    """Words of documents that lie inside a window of an item.

    Words are runs of 0-9, a-z and characters beyond ASCII, after lower-casing
    A-Z. A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. Returns per row of ``docs``: doc_id,
    n_words, hits (places of the hit words), items (ids of the items with a
    window in the text, as sorted text, each once).

    The items are taken in blocks of about ``block_bytes`` text, so what a task
    holds is bounded; every block meets all documents where they lie, without a
    shuffle, and a very common passage costs each document its own extension
    only. Null texts have no words; items without words have no windows; a
    null item_id reads as the empty text. Rows of the same doc_id are separate
    documents, and equal rows have equal results. Without items nothing is hit.
    """
    number, index_of = item_blocks(items, window, gram, block_bytes)
    rows = docs.select("doc_id", "text")

    def of_block(block: int) -> DataFrame:
        index = index_of(block)

        def each(batch):
            found = column_bytes(batch, "text")
            for first, last, data, starts in blocks(found):
                n_words, hit, begin, by_doc = _hits(index, data, starts, last - first)
                places = [np.flatnonzero(hit[begin[d] : begin[d + 1]]) if d in by_doc else [] for d in range(last - first)]
                names = [sorted({index.ids[i] for i in by_doc.get(d, ())}) for d in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.array([hash_of(found[i]) for i in range(first, last)], pa.int64()) if number > 1 else pa.nulls(last - first, pa.int64()),
                        pa.array(n_words, pa.int64()),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "_mark", "n_words", "hits", "items"],
                )

        kind = dict(docs.dtypes)["doc_id"]
        return map_arrow(rows, each, f"doc_id {kind}, _mark long, n_words long, hits array<int>, items array<string>")

    if number == 1:
        return of_block(0).drop("_mark")
    some = [of_block(i) for i in range(number)]
    found = some[0].filter(F.size("hits") > 0)
    for part in some[1:]:
        found = found.unionByName(part.filter(F.size("hits") > 0))
    found = (
        found.dropDuplicates()
        .groupBy("doc_id", "_mark")
        .agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    )
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._mark") == F.col("b._mark"))
    none = F.array().cast("array<int>")
    return some[0].alias("a").join(found.alias("b"), same, "left").select(
        "a.doc_id",
        "a.n_words",
        F.coalesce(F.array_sort(F.array_distinct("b.hits")), none).alias("hits"),
        F.coalesce(F.array_sort(F.array_distinct("b.items")), F.array().cast("array<string>")).alias("items"),
    )


def hash_of(text: bytes) -> int:
    """A signed 64-bit hash of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    return int(Hashes(data).of(np.zeros(1, np.int64), np.array([len(data)])).view(np.int64)[0])
