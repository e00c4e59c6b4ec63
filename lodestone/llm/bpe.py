"""Byte-pair encoding of whole documents with a given vocabulary.

A text is cut before every space that follows something else than white space:
no token crosses such a place, so the pieces can be encoded one by one, and
frequent pieces once. Text that stays unsplit for long is cut into leaves that
tasks encode in parallel; neighbours are then joined pairwise, up a tree, by
encoding a growing window around each join anew until its first and last token
agree with both sides. (A sequence of tokens is the encoding of its text if and
only if each two neighbours are, so agreement at both ends is proof.)
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import map_arrow

LEAF = 1 << 14  # characters or bytes; text that stays unsplit for longer is encoded in parallel
KEPT = 150_000  # pieces whose tokens a worker remembers
ROWS = 256  # documents of a batch on its way out
AFTER_SPACE = re.compile(r"\s ")


class Bytes:
    """The bytes that each token of a vocabulary stands for."""

    def __init__(self, path: str):
        tokenizer = load(path)
        special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.byte_of, self.char_of = byte_characters()
        self.bytes_of: list[bytes] = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = token.encode() if i in special else bytes(self.byte_of[c] for c in token)

    def text(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: bytes) -> bytes:
        text = self.text(np.frombuffer(ids, "<u4").tolist())
        try:
            text.decode()
            return text
        except UnicodeDecodeError:
            return text.decode(errors="replace").encode()


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> tuple[dict[str, int], dict[int, str]]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return byte_of, {b: c for c, b in byte_of.items()}


def held(kind, path: str):
    """One object of ``kind`` for a vocabulary, loaded once a worker, also across tasks."""
    kept = sys.modules.setdefault("_lodestone_vocabularies", types.ModuleType("_lodestone_vocabularies"))
    name = f"{kind.__name__} {path}"
    if name not in kept.__dict__:
        kept.__dict__[name] = kind(path)
    return kept.__dict__[name]


class Codec:
    """Encoding with one vocabulary."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = load(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.any_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}

    def segments(self, text: str):
        """Stretches of ordinary text, and the special tokens between them."""
        if self.any_special is None:
            return [text]
        return self.any_special.split(text)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit numbers."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        out = []
        for part in self.segments(text):
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
            elif part:
                found = pieces(part)
                self.learn(found)
                out += map(self.kept.__getitem__, found)
        return b"".join(out)

    def learn(self, found: list[str]) -> None:
        new = [p for p in set(found) if p not in self.kept]
        if new:
            for piece, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self.kept[piece] = np.array(e.ids, dtype="<u4").tobytes()

    def encode_raw(self, mapped: str) -> list[int]:
        """Tokens of a stretch of one unsplit text, given in characters that
        stand for bytes, without splitting it."""
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def join(self, left: list[int], right: list[int], width: int = 8) -> list[int]:
        """Tokens of two neighbouring stretches as one."""
        while left and right:
            a, b = left[-width:], right[:width]
            table = held(Bytes, self.path)
            whole = self.encode_raw("".join(map(table.char_of.__getitem__, table.text(a + b))))
            if (len(a) == len(left) or whole[0] == a[0]) and (len(b) == len(right) or whole[-1] == b[-1]):
                return left[: -len(a)] + whole + right[len(b) :]
            width *= 2
        return left + right

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Leaves joined pairwise, up a tree."""
        while len(parts) > 1:
            paired = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = paired + parts[2 * len(paired) :]
        return parts[0] if parts else []


def pieces(text: str) -> list[str]:
    """Cut before each space that follows something else than white space."""
    cut = text.split(" ")
    if text[0] != " " and not AFTER_SPACE.search(text):
        return [cut[0], *[f" {x}" for x in cut[1:]]]
    out, current = [], cut[0]
    for x in cut[1:]:
        if current and not current[-1].isspace():
            out.append(current)
            current = f" {x}"
        else:
            current = f"{current} {x}"
    out.append(current)
    return out


# --- documents ----------------------------------------------------------------------------


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (binary: little-endian 32-bit numbers) per row of ``docs``.

    ``path`` is a byte-level vocabulary file of the tokenizers library; ids are
    those of its ``encode(text, add_special_tokens=False)`` without truncation
    and padding, so special tokens written in a text get their ids. Null and
    empty texts have no ids. Documents with ``leaf`` characters without a cut
    are taken apart, their parts encoded in parallel and put together per
    document; all others are encoded where they lie. Rows that repeat are
    encoded each; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    unsplit = F.coalesce(
        (F.length("text") >= leaf) & F.col("text").rlike(f"[^ ]{{{leaf}}}|\\s{{{leaf}}}"), F.lit(False)
    )

    def short(batch):
        codec = held(Codec, path)
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            ids = [codec.encode(t) if t else b"" for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    def apart(batch):
        codec = held(Codec, path)
        for doc, row, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "_row", "text")]):
            found = list(parts_of(codec, text, leaf))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([doc] * len(found), batch.column("doc_id").type),
                    "_row": pa.array([row] * len(found), pa.int64()),
                    "part": pa.array(range(len(found)), pa.int64()),
                    "run": pa.array([p[0] for p in found], pa.int64()),
                    "kind": pa.array([p[1] for p in found]),
                    "text": pa.array([p[2] for p in found]),
                }
            )

    def each_part(batch):
        codec = held(Codec, path)
        ids = [encode_part(codec, k, t) for k, t in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist())]
        columns = [batch.column(c) for c in ("doc_id", "_row", "part", "run")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=["doc_id", "_row", "part", "run", "ids"])

    def together(batch):
        codec = held(Codec, path)
        out = [join_parts(codec, [(p["run"], p["ids"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    parts = map_arrow(
        rows.filter(unsplit).withColumn("_row", F.monotonically_increasing_id()),
        apart,
        f"doc_id {kind}, _row long, part long, run long, kind string, text string",
    )
    encoded = map_arrow(
        parts.repartition("_row", "part"), each_part, f"doc_id {kind}, _row long, part long, run long, ids binary"
    )
    # the parts of one document only, whose ids are one value anyway
    gathered = encoded.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "run", "ids"))).alias("parts")
    )
    schema = f"doc_id {kind}, ids binary"
    return map_arrow(rows.filter(~unsplit), short, schema).unionByName(
        map_arrow(gathered.select("doc_id", "parts"), together, schema)
    )


def parts_of(codec: Codec, text: str, leaf: int):
    """(run, kind, text) of the parts of a long document, in order: "plain" text
    between cuts, "words" (unsplit texts, a line each, as byte characters), and
    "leaf": a stretch of one unsplit text. Leaves of a run belong together."""
    run, plain, size = 0, [], 0
    for part in codec.segments(text):
        if part in codec.special:
            plain.append(part)
            continue
        for piece in pieces(part) if part else ():
            if len(piece) <= leaf:
                plain.append(piece)
                size += len(piece)
                if size >= leaf:
                    yield -1, "plain", "".join(plain)
                    plain, size = [], 0
                continue
            if plain:
                yield -1, "plain", "".join(plain)
                plain, size = [], 0
            words, held = [], 0
            for word, _ in codec.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
                if len(word) <= leaf:
                    words.append(word)
                    held += len(word)
                if words and (held >= leaf or len(word) > leaf):
                    yield -1, "words", "\n".join(words)
                    words, held = [], 0
                if len(word) > leaf:
                    for at in range(0, len(word), leaf):
                        yield run, "leaf", word[at : at + leaf]
                    run += 1
            if words:
                yield -1, "words", "\n".join(words)
    if plain:
        yield -1, "plain", "".join(plain)


def encode_part(codec: Codec, kind: str, text: str) -> bytes:
    if kind == "plain":
        return codec.encode(text)
    ids = [i for word in text.split("\n") for i in codec.encode_raw(word)]
    return np.array(ids, dtype="<u4").tobytes()


def join_parts(codec: Codec, parts: list[tuple[int, bytes]]) -> bytes:
    out, at = [], 0
    while at < len(parts):
        run, ids = parts[at]
        end = at + 1
        if run >= 0:
            while end < len(parts) and parts[end][0] == run:
                end += 1
            leaves = [np.frombuffer(p, "<u4").tolist() for _, p in parts[at:end]]
            ids = np.array(codec.join_all(leaves), dtype="<u4").tobytes()
        out.append(ids)
        at = end
    return b"".join(out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (UTF-8 bytes) per row: the text of the library's
    ``decode(ids, skip_special_tokens=False)``. Null and empty ids give empty bytes;
    rows that repeat keep their own rows, an empty table gives none; other
    columns are ignored."""
    kind = dict(encoded.dtypes)["doc_id"]

    def each(batch):
        table = held(Bytes, path)
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            text = [table.decode(x or b"") for x in rows.column("ids").to_pylist()]
            columns = [rows.column("doc_id"), rows.column("ids"), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), each, f"doc_id {kind}, ids binary, decoded binary")
