import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text


def lit_array(items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def test_tokenize_keeps_or_lowers_case(value):
    sample = F.lit("Ab-c  d́e!\n\t9")
    assert value(text.tokenize(sample)) == ["Ab", "-", "c", "d́e", "!", "9"]
    assert value(text.tokenize(sample, uncased=True))[0] == "ab"


def test_specials_are_one_token(value):
    tokens = value(text.tokenize(F.lit("a<DOC> </s>b"), specials=["</s>", "<DOC>"]))
    assert tokens == ["a", "<DOC>", "</s>", "b"]


def test_strip_takes_unicode_spaces(value):
    assert value(text.strip(F.lit("　\x1f a b \n"))) == "a b"


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("The  Cat, a hat!", "cat hat"),
        ("an apple-the", "applethe"),
        ("A", ""),
        ("Éa the é", "éa é"),
        ("a  the an b", "b"),
    ],
)
def test_normalize_answer(value, raw, wanted):
    assert value(text.normalize_answer(F.lit(raw))) == wanted


def test_nfd_only_changes_foreign_text(value):
    assert value(text.nfd(F.lit("café"))) == unicodedata.normalize("NFD", "café")
    assert value(text.nfd(F.lit("cafe"))) == "cafe"
    assert value(text.nfd(F.lit(None).cast("string"))) is None


def test_last_subsequence(value):
    find = lambda a, b: value(text.last_subsequence(lit_array(a), lit_array(b)))
    assert find("abcab", "ab") == 3
    assert find("aaaa", "aa") == 2
    assert find("abc", "x") == -1
    assert find("ab", "abc") == -1
    assert find(["ab", "c"], ["b"]) == -1
    with pytest.raises(Exception, match="non-empty"):
        find("abc", "")


def test_last_subsequence_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        main = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
        sub = [rng.choice("ab") for _ in range(rng.randint(1, 4))]
        places = [i for i in range(len(main) - len(sub) + 1) if main[i : i + len(sub)] == sub]
        rows.append((main, sub, places[-1] if places else -1))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want int")
    wrong = df.filter(text.last_subsequence(F.col("a"), F.col("b")) != F.col("want"))
    assert wrong.count() == 0


def test_has_answer(value):
    found = lambda answers, t: value(text.has_answer(lit_array(answers), F.lit(t)))
    assert found(["New York"], "in NEW   york.")
    assert not found(["New York"], "new yorker")
    assert found(["x", "york"], "new york")
    assert found([""], "anything")  # an empty answer always matches
    assert found(["..."], "wait... ok") and not found(["...."], "wait...")
    assert found(["café"], "le café")
    assert not found([], "anything")
    assert found(["e\u0301t\u0002x", "café"], "un cafe\u0301")


def test_stop_truncate(value):
    cut = lambda t: value(text.stop_truncate(F.lit(t)))
    assert cut("yes, it is") == "yes,"
    assert cut("no stop") == "no stop"
    assert cut("a\nb.") == "a\n"
    assert cut("") == ""


def test_ngrams(value):
    grams = value(text.ngrams(lit_array("abcd"), 3))
    assert [g.split(text.FRAME) for g in grams] == [list("abc"), list("bcd")]
    assert value(text.ngrams(lit_array("ab"), 3)) == []
    assert value(text.ngrams(lit_array("ab"), 1)) == ["a", "b"]


def test_words_drops_blank_pieces(value):
    assert value(text.words(F.lit("  a \n b c "))) == ["a", "b", "c"]
    assert value(text.words(F.lit("  "))) == []


def test_decomposition_takes_few_rows_at_a_time():
    values = pa.array(["é", None, "a"] * 300)
    found = text._mapped(values, lambda s: unicodedata.normalize("NFD", s), pa.string(), rows=7)
    assert found.to_pylist() == ["e\u0301", None, "a"] * 300
    assert text._mapped(pa.array([], pa.string()), len, pa.string()).to_pylist() == []
