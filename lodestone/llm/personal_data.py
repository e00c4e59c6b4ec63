"""Personal data by anchors: an Aho-Corasick automaton finds at-signs, digits,
plus signs, schemes and cue words in one pass; from each anchor a local parser
expands and validates the span."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import map_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "api_key", "apikey", "secret", "token")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:%!$&'()*+,;=-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9-]+(?::[0-9]+)?(?:[/?#][^\s<>\"]*)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_AFTER_CUE = re.compile(r"(?i:(?: ?(?:no|nr|number|nummer))?)[ .:#=]{0,4}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_SECRET = re.compile(r"[ ]?[=:][ ]?([A-Za-z0-9_+/.-]{8,})")


def automaton():
    """Anchors, what they stand for and their length."""
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34:
        return False
    turned = bare[4:] + bare[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def spans_of(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order; within a kind they don't overlap."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_next = card_end = phone_end = 0
    for last, (kind, size) in anchors.iter(text):
        if kind == "digit":
            if last >= card_end:
                m = _CARD.match(text, last)
                card_end = m.end() if m else last + 1
                if m and m.end() - last >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
            if last >= ip_next:
                m = _IP.match(text, last)
                if m:
                    ip_next = m.end()
                    if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m.groups()):
                        found["ip"].append(m.span())
                else:
                    ip_next = _DIGITS.match(text, last).end()
        elif kind == "at":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, last + 1) if start < last else None
            if m:
                email_end = m.end()
                found["email"].append((start, email_end))
        elif kind == "plus":
            m = _PHONE.match(text, last) if last >= phone_end else None
            if m:
                phone_end = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "scheme":  # an address counts where it names a user
            m = _URL.match(text, last + 1)
            if m:
                _add(found["url"], last - size + 1, m.end(), last)
        elif kind == "account":
            m = _AFTER_CUE.match(text, last + 1)
            number = _IBAN.match(text, m.end()) or _ACCOUNT.match(text, m.end())
            if number and (number.re is _ACCOUNT or iban(number.group())):
                _add(found["account"], number.start(), number.end(), last)
        else:
            m = _SECRET.match(text, last + 1)
            if m:
                _add(found["secret"], *m.span(1), last)
    return found


def _add(spans: list[tuple[int, int]], start: int, end: int, anchor: int) -> None:
    if start < 0 or start > anchor + 40:
        return
    if not spans or start >= spans[-1][1]:
        spans.append((start, end))


def written(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans are one,
    named by the first."""
    merged: list[list] = []
    for start, end, kind in sorted((s, e, k) for k, spans in found.items() for s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted per
    row of ``docs``.

    Kinds of the base: email, ip, card, phone. Added: url (an address that names
    a user), account (a number after a cue word, or a valid IBAN there), secret
    (a value after a cue word). ``spans`` lists "kind:start:end" in code points,
    by kind, then start. Null texts read as empty and stay null in ``redacted``;
    no two rows are compared, so repeated rows have equal results.
    """

    def each(batch):
        anchors = automaton()
        counts = {k: [] for k in BASE}
        hashes, spans, clean = [], [], []
        for text in batch.column("text").to_pylist():
            found = spans_of(text or "", anchors)
            for k in BASE:
                counts[k].append(len(found[k]))
            hashes.append(hashlib.sha256(written(found, BASE).encode()).hexdigest())
            spans.append(written(found, KINDS))
            clean.append(redact(text, found) if spans[-1] else text)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[pa.array(counts[k], pa.int64()) for k in BASE],
                pa.array(hashes, pa.string()),
                pa.array(spans, pa.string()),
                pa.array(clean, pa.string()),
            ],
            names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "redacted"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    return map_arrow(docs.select("doc_id", "text"), each, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, spans of every kind replaced in ``text``, and
    ``n_chars``, where there is such a column, counted anew."""

    def each(batch):
        anchors = automaton()
        texts = batch.column("text").to_pylist()
        clean = [t and redact(t, spans_of(t, anchors)) for t in texts]
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns["text"] = pa.array(clean, batch.column("text").type)
        if "n_chars" in columns:
            counts = [n if new == old else len(new) for n, new, old in zip(columns["n_chars"].to_pylist(), clean, texts)]
            columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_arrow(docs, each, docs.schema)
