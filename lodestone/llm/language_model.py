"""Word-pair language models: interpolated modified Kneser-Ney smoothing.

Pairs are counted in Spark and stored as sorted arrays of 64-bit hashes, cut into
shards; workers memory-map one shard after another to score texts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .tables import column_bytes, shared_folder
from .words import BASE, Hashes, blocks, lower_table, mixed, word_spans

#: Hashes of the beginning and the end of a text.
START, END = np.uint64(1), np.uint64(2)
#: Pairs that a counting task holds, and tokens that are scored at a time.
MOST_PAIRS, MOST_TOKENS = 1 << 22, 1 << 20

_SPACES = np.ones(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = False


@dataclass(frozen=True)
class Model:
    """Arrays in ``folder``, in ``shards`` shards, and what is known of all of them:
    tokens, distinct tokens, distinct pairs, and the discounts of pairs and of words."""

    folder: str
    shards: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float


def token_pairs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, text): hashes of every token and of the one before it, in
    blocks of texts. Tokens are the words (other bytes than space and \\x09-\\x0D,
    after lower-casing A-Z) and one end; before the first is a start."""
    lower = lower_table()
    for first, last, data, starts in blocks(texts):
        data = lower[data]
        begins, ends = word_spans(data, _SPACES)
        text = np.searchsorted(starts, begins, "right") - 1
        sizes = np.bincount(text, minlength=last - first)
        row = np.full(len(begins) + 2 * (last - first), END, dtype=np.uint64)
        row[np.arange(len(begins)) + 2 * text + 1] = Hashes(data).of(begins, ends) if len(begins) else 0
        heads = np.cumsum(sizes + 2) - sizes - 2
        row[heads] = START
        right = np.delete(np.arange(len(row)), heads)
        yield row[right - 1], row[right], np.repeat(np.arange(first, last), sizes + 1)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left) + right * BASE)


def _packed(x: np.ndarray) -> bytes:
    """Counts in a byte each; those from 255 on follow in eight bytes each."""
    small = np.minimum(x, 255).astype(np.uint8)
    return small.tobytes() + x[small == 255].astype("<i8").tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    small = np.frombuffer(raw, np.uint8, size)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(raw, "<i8", offset=size)
    return out


def _merged(left, right, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, left, right, count) of each pair once, by key."""
    keys = pair_keys(left, right)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    at = order[first]
    return keys[first], left[at], right[at], np.add.reduceat(counts[order], first) if len(first) else counts


def _pair_rows(keys, left, right, counts, shards) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its pairs by their left words, each of them once."""
    lefts, of = np.unique(left, return_inverse=True)
    cells = (keys % np.uint64(shards)).astype(np.int64) * len(lefts) + of
    order = np.argsort(cells)
    cells, right, counts = cells[order], right[order], counts[order]
    begins = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[begins, len(cells)])
    shard, of = cells[begins] // len(lefts), cells[begins] % len(lefts)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
        c, d = begins[a], begins[b] if b < len(begins) else len(cells)
        parts = [lefts[of[a:b]].tobytes(), _packed(sizes[a:b]), right[c:d].tobytes(), _packed(counts[c:d])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(shard[a])], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]],
            names=["shard", "lefts", "sizes", "rights", "counts"],
        )


def pair_counts(docs: DataFrame, shards: int) -> DataFrame:
    """Pairs counted by each task, in a row per shard; merged by the shard."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for left, right, _ in token_pairs(column_bytes(batch, "text")):
                found = _merged(left, right, np.ones(len(left), np.int64))[1:]
                held.append(found)
                size += len(found[0])
                if size > MOST_PAIRS:
                    keys, *found = _merged(*map(np.concatenate, zip(*held)))
                    held, size = [tuple(found)], len(keys)
                    if size > MOST_PAIRS // 2:
                        yield from _pair_rows(keys, *found, shards)
                        held, size = [], 0
        if held:
            yield from _pair_rows(*_merged(*map(np.concatenate, zip(*held))), shards)

    return docs.select("text").mapInArrow(run, "shard int, lefts binary, sizes binary, rights binary, counts binary")


def _by_shard(rows: DataFrame, shards: int, each, schema: str) -> DataFrame:
    """``each(shard, rows)`` for all rows of every shard; rows are dictionaries."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != at:
                    if held:
                        yield from each(at, held)
                    at, held = row["shard"], []
                held.append(row)
        if held:
            yield from each(at, held)

    return rows.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _write(folder: str, name: str, values: np.ndarray) -> None:
    """An array as a file; a repeated task replaces it by the same."""
    system, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(values.tobytes())
    system.move(part, f"{path}/{name}")


_COPIES: dict[str, np.ndarray] = {}


def mapped(system: fs.FileSystem, path: str, kind) -> np.ndarray:
    """An array memory-mapped from its file; none where there is no file. From
    storage that can't be mapped a worker copies it once to a nameless file."""
    if path in _COPIES:
        return _COPIES[path]
    info = system.get_file_info(path)
    if info.type != fs.FileType.File or not info.size:
        return np.empty(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with tempfile.TemporaryFile() as copy, system.open_input_stream(path) as stream:
        while piece := stream.read(1 << 22):
            copy.write(piece)
        copy.flush()
        _COPIES[path] = np.memmap(copy, kind, "r")
    return _COPIES[path]


#: Of a word: tokens, distinct words before it, and of the words after it those
#: seen once, twice, three times, four times, and all.
_COLUMNS = 7


def _merge_pairs(folder: str, shards: int):
    """Writes the arrays of a shard of pairs; gives rows with what they say of words."""

    def each(shard, rows):
        lefts, rights, counts = [], [], []
        for row in rows:
            right = np.frombuffer(row["rights"], np.uint64)
            left = np.frombuffer(row["lefts"], np.uint64)
            lefts.append(np.repeat(left, _unpacked(row["sizes"], len(left))))
            rights.append(right)
            counts.append(_unpacked(row["counts"], len(right)))
        keys, left, right, count = _merged(*map(np.concatenate, (lefts, rights, counts)))
        once = count == 1
        _write(folder, f"pairs-{shard}-once", keys[once])
        _write(folder, f"pairs-{shard}-keys", keys[~once])
        _write(folder, f"pairs-{shard}-counts", count[~once])
        words, of = np.unique(np.concatenate([left, right]), return_inverse=True)
        before, after = of[: len(left)], of[len(left) :]

        def total(at, weights):
            return np.bincount(at, weights, len(words)).astype(np.int64)

        columns = [total(after, count), total(after, np.ones(len(after)))]
        columns += [total(before, count == n) for n in (1, 2, 3, 4)] + [total(before, np.ones(len(before)))]
        columns[0] += np.where(words == START, total(before, count), 0)  # the start is no token; its texts are counted
        yield from _word_rows(words, columns, shards)

    return each


def _word_rows(words, columns, shards) -> Iterator[pa.RecordBatch]:
    shard = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        at = order[cuts[s] : cuts[s + 1]]
        if len(at):
            values = _packed(np.concatenate([x[at] for x in columns]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([words[at].tobytes()], pa.binary()), pa.array([values], pa.binary())],
                names=["shard", "words", "values"],
            )


def _merge_words(folder: str):
    """Writes the arrays of a shard of words; gives a row with their totals."""

    def each(shard, rows):
        found = [np.frombuffer(row["words"], np.uint64) for row in rows]
        values = [_unpacked(row["values"], _COLUMNS * len(w)).reshape(_COLUMNS, -1) for row, w in zip(rows, found)]
        words, of = np.unique(np.concatenate(found), return_inverse=True)
        tokens, before, n1, n2, n3, n4, n = (
            np.bincount(of, x, len(words)).astype(np.int64) for x in np.concatenate(values, axis=1)
        )
        _write(folder, f"words-{shard}-keys", words)
        _write(folder, f"words-{shard}-tokens", tokens)
        _write(folder, f"words-{shard}-before", before)
        _write(folder, f"words-{shard}-after", np.column_stack([n1, n2, n - n1 - n2]).astype(np.uint32))
        real = words != START
        totals = [tokens[real].sum(), real.sum(), before.sum(), n1.sum(), n2.sum(), n3.sum(), n4.sum()]
        totals += [(before == k).sum() for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in totals], names=_TOTALS)

    return each


_TOTALS = ["tokens", "words", "pairs", "p1", "p2", "p3", "p4", "w1", "w2", "w3", "w4"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and three or more, from how many
    counts are 1, 2, 3 and 4. Where these don't give a number above 0 and at most the
    count, half the count is taken off."""
    n = (n1, n2, n3, n4)
    share = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = []
    for k in (1, 2, 3):
        value = k - (k + 1) * share * n[k] / n[k - 1] if n[k - 1] else 0.0
        found.append(value if 0 < value <= k else k / 2)
    return tuple(found)


def train(docs: DataFrame) -> Model:
    """A model of all texts of ``docs``.

    Counts of pairs are merged in two shuffles, of pairs by the hash of the pair and of words by
    theirs, so a frequent word is in every shard of pairs and no shard is larger for it; each
    task sends a pair once. Words are known by their 64-bit hashes. Null and empty texts are
    the end alone; rows that repeat count as often; an empty table gives a model that knows
    no word, for which every token has probability 1. Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "language-model")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    words = _by_shard(pair_counts(docs, shards), shards, _merge_pairs(folder, shards), "shard int, words binary, values binary")
    totals = _by_shard(words, shards, _merge_words(folder), ", ".join(f"{x} long" for x in _TOTALS))
    row = totals.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in _TOTALS]).first().asDict()
    of_words = discounts(*[row[f"w{k}"] for k in (1, 2, 3, 4)])
    many = row["words"] - row["w1"] - row["w2"]
    mass = np.dot(of_words, [row["w1"], row["w2"], many]) / row["pairs"] if row["pairs"] else 1.0
    return Model(
        folder,
        shards,
        row["tokens"],
        row["words"],
        row["pairs"],
        discounts(*[row[f"p{k}"] for k in (1, 2, 3, 4)]),
        of_words,
        float(mass),
    )


class Reader:
    """Looks up words and pairs of a model, a shard at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.system, self.path = fs.FileSystem.from_uri(model.folder)

    def _array(self, name: str, kind) -> np.ndarray:
        return mapped(self.system, f"{self.path}/{name}", kind)

    def _shards(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = (keys % np.uint64(self.model.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in range(self.model.shards):
            if cuts[s] < cuts[s + 1]:
                yield s, order[cuts[s] : cuts[s + 1]]

    @staticmethod
    def _places(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``keys`` are in the sorted array, and where)."""
        if not len(array):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(array, keys), len(array) - 1)
        there = np.flatnonzero(array[at] == keys)
        return there, at[there]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """How often pairs (sorted keys) were seen."""
        out = np.zeros(len(keys), np.int64)
        for s, at in self._shards(keys):
            there, _ = self._places(self._array(f"pairs-{s}-once", np.uint64), keys[at])
            out[at[there]] = 1
            there, where = self._places(self._array(f"pairs-{s}-keys", np.uint64), keys[at])
            if len(there):
                out[at[there]] = self._array(f"pairs-{s}-counts", np.int64)[where]
        return out

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words (sorted hashes): tokens, distinct words before, and words after
        that were seen once, twice, and more often with it."""
        tokens, before = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        after = np.zeros((len(keys), 3))
        for s, at in self._shards(keys):
            there, where = self._places(self._array(f"words-{s}-keys", np.uint64), keys[at])
            if len(there):
                tokens[at[there]] = self._array(f"words-{s}-tokens", np.int64)[where]
                before[at[there]] = self._array(f"words-{s}-before", np.int64)[where]
                after[at[there]] = self._array(f"words-{s}-after", np.uint32).reshape(-1, 3)[where]
        return tokens, before, after

    def logs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 base probability, token was seen) of each token."""
        model = self.model
        words, of = np.unique(np.concatenate([left, right]), return_inverse=True)
        tokens, before, after = self.words(words)
        keys, first, back = np.unique(pair_keys(left, right), return_index=True, return_inverse=True)
        v, w = of[: len(left)][first], of[len(left) :][first]
        seen = self.counts(keys)
        alone = model.word_mass / (model.words + 1) + _discounted(before, model.word_discounts) / max(1, model.pairs)
        total = np.maximum(1, tokens[v])
        rest = np.where(tokens[v] > 0, after[v] @ np.array(model.pair_discounts) / total, 1.0)
        chance = _discounted(seen, model.pair_discounts) / total + rest * alone[w]
        base = np.log10((tokens + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
        w = of[len(left) :]
        return np.log10(chance)[back], base[w], tokens[w] > 0


def _discounted(counts: np.ndarray, taken: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(0.0, counts - np.array([0.0, *taken])[np.minimum(counts, 3)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity per row.

    ``score`` is the log10 probability of the text's words and its end, each after the one
    before it; ``base_score`` is that of single tokens, 0.1 added to their counts.
    ``n_known`` tokens were seen in training. Null and empty texts have one token,
    the end. Rows that repeat and null doc_ids keep their rows, an empty table gives none; other
    columns are ignored. A worker maps one shard of the model at a time and looks up the
    distinct pairs of about a million tokens in it.
    """

    def run(batches):
        reader = Reader(model)
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((4, n))
            held, size = [], 0

            def flush():
                left, right, text = map(np.concatenate, zip(*held))
                logs, base, known = reader.logs(left, right)
                for i, x in enumerate((logs, base, known, np.ones(len(text)))):
                    sums[i] += np.bincount(text, x, n)

            for part in token_pairs(column_bytes(batch, "text")):
                held.append(part)
                size += len(part[0])
                if size >= MOST_TOKENS:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            logs, base, known, tokens = sums
            longs = [pa.array(x.astype(np.int64)) for x in (tokens, known)]
            doubles = [pa.array(x) for x in (base, logs, 10.0 ** np.minimum(300, -logs / np.maximum(1, tokens)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *longs, pa.array(np.full(n, model.tokens)), *doubles],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double",
    )
