"""String and token expressions. All but :func:`nfd` stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .binding import let

# A run of letters, digits and marks, or one visible symbol.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
# Words of two or more word characters, as TF-IDF counts them.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
# What counts as white space when a string is split or stripped.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = f"[{SPACES}]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Control character that no token can contain; frames token runs.
FRAME = "\u0001"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def quoted(literal: str) -> str:
    """A regular expression that matches ``literal`` itself."""
    return r"\Q" + literal + r"\E"


def tokenize(text: Column, uncased: bool = False, specials: list[str] | None = None) -> Column:
    """Tokens of ``text`` in order; each of ``specials`` is kept as one token."""
    pattern = "|".join([*map(quoted, specials or []), TOKEN_PATTERN])
    source = F.lower(text) if uncased else text
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(0))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words; an empty or blank text has none."""
    return F.filter(F.split(text, SPACE_RUN), lambda word: word != "")


def _mapped(values: pa.Array, each, kind: pa.DataType, rows: int = 256) -> pa.Array:
    """``each`` of every value that is not null; a few rows at a time become Python objects."""
    parts = [
        pa.array([None if v is None else each(v) for v in values.slice(start, rows).to_pylist()], kind)
        for start in range(0, len(values), rows)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StringType())
def _decompose(texts: pa.Array) -> pa.Array:
    return _mapped(texts, lambda s: unicodedata.normalize("NFD", s), pa.string())


def nfd(text: Column) -> Column:
    """Canonical decomposition. Only non-ASCII values travel to Python."""
    foreign = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_decompose(foreign), text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decompose_all(lists: pa.Array) -> pa.Array:
    def each(items):
        return [None if s is None else unicodedata.normalize("NFD", s) for s in items]

    return _mapped(lists, each, pa.list_(pa.string()))


def nfd_all(texts: Column) -> Column:
    """:func:`nfd` for every entry of an array."""
    foreign = F.when(F.exists(texts, lambda s: s.rlike(r"[^\x00-\x7F]")), texts)
    return F.coalesce(_decompose_all(foreign), texts)


def normalize_answer(text: Column) -> Column:
    """Lower-case, drop ASCII punctuation, blank out articles, collapse spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    no_articles = F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")
    return strip(F.regexp_replace(no_articles, SPACE_RUN, " "))


def framed(tokens: Column) -> Column:
    """Tokens joined and surrounded by a control character.

    A token list is a contiguous run of another one exactly when its framed
    form is a substring, which turns list matching into string search.
    """
    return F.concat(F.lit(FRAME), F.array_join(tokens, FRAME), F.lit(FRAME))


def contains_run(text_tokens: Column, run_tokens: Column) -> Column:
    """True when ``run_tokens`` occurs contiguously; an empty run always does."""
    return (F.size(run_tokens) == 0) | F.contains(framed(text_tokens), framed(run_tokens))


def last_subsequence(main: Column, sub: Column) -> Column:
    """0-based start of the last occurrence of ``sub`` in ``main``, -1 if none.

    Empty inputs are an error. Linear in the text: both lists are framed,
    reversed and searched once, and the frames before the hit are counted.
    """

    def start(v):
        hit = F.call_function("locate", F.reverse(v["needle"]), F.reverse(v["haystack"]))
        before = F.length(v["haystack"]) - (hit + F.length(v["needle"]) - 1)
        prefix = F.substr(v["haystack"], F.lit(1), before)
        frames = F.length(prefix) - F.length(F.replace(prefix, F.lit(FRAME), F.lit("")))
        return F.when(hit == 0, F.lit(-1)).otherwise(frames)

    return F.when(
        (F.size(main) == 0) | (F.size(sub) == 0),
        F.raise_error(F.lit("last_subsequence needs two non-empty lists")).cast("int"),
    ).otherwise(let(start, haystack=framed(main), needle=framed(sub)))


def stop_truncate(text: Column, stops: str = "\n.,") -> Column:
    """Text up to and including the first stop character."""
    return F.regexp_extract(text, f"^[^{stops}]*[{stops}]?", 0)


def has_answer(answers: Column, text: Column, decompose: bool = True) -> Column:
    """True when any answer's tokens are a contiguous run of the text's tokens.

    ``answers`` is an array of strings. Tokens are decomposed and lower-cased.
    """
    if decompose:
        text, answers = nfd(text), nfd_all(answers)

    def found(v):
        def occurs(answer):
            run = tokenize(answer, uncased=True)
            return (F.size(run) == 0) | F.contains(v["haystack"], framed(run))

        return F.exists(v["answers"], occurs)

    return let(found, haystack=framed(tokenize(text, uncased=True)), answers=answers)


def ngrams(tokens: Column, n: int) -> Column:
    """All contiguous n-grams, each joined into one string."""
    if n == 1:
        return tokens

    def grams(v):
        return F.transform(
            F.sequence(F.lit(1), F.size(v["tokens"]) - (n - 1)),
            lambda i: F.array_join(F.slice(v["tokens"], i, F.lit(n)), FRAME),
        )

    none = F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, let(grams, tokens=tokens)).otherwise(none)
