"""Ids and texts against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC, BYTES = bpe.Codec(PATH), bpe.Bytes(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids(payload):
    return np.frombuffer(payload, "<u4").tolist()


WORDS = st.sampled_from(
    [" ", "  ", "\n", "\t ", "'s", "'", "re", "the", "é", "日本", "12", "!?", " ", "　", "\x1c", "<|endoftext|>",
     "<|endo", "a", "\r\n", "😀", "é", " ", "ſ", "​"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(WORDS, max_size=25).map("".join))
def test_short_texts(text):
    assert ids(CODEC.encode(text)) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(CODEC.encode(text)) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids(found):
    payload = np.array(found, dtype="<u4").tobytes()
    assert BYTES.decode(payload).decode() == LIBRARY.decode(found, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["a", "ab", "é", "the", "日本語", "=-", "0123456789", " ", "\n ", "aé1 ,", "etaoinshr"])
@pytest.mark.parametrize("leaf", [5, 64])
def test_tree_concatenation(alphabet, leaf):
    rng = random.Random(len(alphabet) + leaf)
    for n in (leaf + 1, 3 * leaf, 1500):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        text = "head of <|endoftext|>" + text + rng.choice(["", " tail", "\n"])
        parts = list(bpe.parts_of(CODEC, text, leaf))
        found = bpe.join_parts(CODEC, [(run, bpe.encode_part(CODEC, kind, t)) for run, kind, t in parts])
        assert ids(found) == library(text)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(None, "x"), (1000, None), (1000, ""), (1001, "ab" * 40_000), (1002, " " * 20_000 + "x" + "=" * 20_000)]
    rows += [(1003, "".join(rng.choice("etaoin,1") for _ in range(50_000)))] * 2
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, ids int").repartition(4)
    got = bpe.decode(bpe.encode(df, PATH, leaf=4096), PATH).collect()
    want = sorted(((d, library(t or ""), (t or "").encode()) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], ids(r["ids"]), bytes(r["decoded"])) for r in got), key=repr) == want
    assert bpe.encode(df.limit(0), PATH).count() == 0
