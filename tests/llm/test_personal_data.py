"""Spans against the patterns of the contract, run as plain regular expressions."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

from lodestone.llm import personal_data as pd

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    def digits(s):
        return "".join(c for c in s if c in "0123456789")

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [
        ("card", *m.span())
        for m in CARD.finditer(text)
        if 16 <= len(digits(m.group())) <= 19 and pd.luhn(digits(m.group()))
    ]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def found(text):
    return pd.written(pd.spans_of(text, pd.automaton()), pd.BASE)


PIECES = st.sampled_from(
    ["a@b.c", "@", ".", "1.2.3.4", "255", "256", "+1 (555) 555-1234", "4111 1111 1111 1111", "4111111111111111", " ", "-",
     "+", "x", "é", "9", "00", "a.b-c@d-e.f.g", "1.2.3.4.5.6.7.8", "(", ")", "\n", "0999.1.1.1", "%", "4111-1111-1111-1111"]
)


@settings(max_examples=800, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_base_kinds_are_the_patterns(text):
    assert found(text) == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.-+@ a(", max_size=60))
def test_base_kinds_on_dense_text(text):
    assert found(text) == brute(text)


def test_added_kinds():
    text = "see https://user:pw@host.example/x?y and IBAN: DE89 3704 0044 0532 0130 00, password=abcdef1234; https://plain.example"
    spans = pd.spans_of(text, pd.automaton())
    named = {k: [text[a:b] for a, b in v] for k, v in spans.items() if v}
    assert named["url"] == ["https://user:pw@host.example/x?y"]
    assert named["account"] == ["DE89 3704 0044 0532 0130 00"]
    assert named["secret"] == ["abcdef1234"]


def test_addresses_start_at_their_scheme():
    def urls(text):
        return [text[a:b] for a, b in pd.spans_of(text, pd.automaton())["url"]]

    for scheme in ("http://", "https://", "ftp://", "mailto:"):
        for form in (scheme, scheme.upper(), scheme.capitalize()):
            assert urls(f"at {form}bob@host.example/y.") == [f"{form}bob@host.example/y."]
    text = "see http://a.example/x and long text ftp://bob@host.example/y"
    assert pd.spans_of(text, pd.automaton())["url"] == [(37, len(text))]
    assert pd.redact(text, pd.spans_of(text, pd.automaton())) == "see http://a.example/x and long text [url]"
    two = "HTTP://ann@a.example/x then Ftp://bob:pw@b.example:21/y"
    assert urls(two) == ["HTTP://ann@a.example/x", "Ftp://bob:pw@b.example:21/y"]


def test_redact_merges_overlaps():
    text = "https://bob@mail.example/x then +1 555 123 4567"
    assert pd.redact(text, pd.spans_of(text, pd.automaton())) == "[url] then [phone]"


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in pd.find(docs).collect()}
    for row in docs.collect():
        want = brute(row["text"] or "")
        assert got[row["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_edges(spark):
    long = "word " * 200_000 + "a@b.cd"
    rows = [(None, "a@b.cd", "x"), (1, None, "x"), (1, "", "x"), (2, long, "x"), (2, long, "x")]
    got = pd.find(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert sum(r["redacted"] is None for r in got) == 1
    assert pd.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
