"""Answer metrics: substring and exact match, F1, ROUGE, BLEU, fact checks."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import wording
from ..functions.text import (
    framed,
    has_answer,
    nfd,
    normalize_answer,
    tokenize,
    words,
)
from .joins import small_copy


def as_list(answer: Column) -> Column:
    """A single answer as a list of one."""
    return F.array(answer)


def exact_match(prediction: Column, answers: Column) -> Column:
    """True when any normalised answer equals the normalised prediction."""
    return F.exists(answers, lambda a: normalize_answer(a) == normalize_answer(prediction))


def context_hits(rows: DataFrame, keys: list[str], contexts: str, answers: str) -> DataFrame:
    """(keys, pos, hit) per retrieved text; a missing text is no hit."""
    flat = rows.select(*keys, answers, F.posexplode(contexts).alias("pos", "text"))
    hit = F.when(F.col("text").isNull(), F.lit(False)).otherwise(has_answer(F.col(answers), F.col("text")))
    return flat.select(*keys, "pos", hit.alias("hit"))


def score(flags: DataFrame, flag: Column, name: str) -> DataFrame:
    """Mean of a boolean or numeric flag, one row."""
    return flags.agg(F.avg(flag.cast("double")).alias(name))


def mean_words(text: Column) -> Column:
    """Mean number of words, as an aggregate."""
    return F.avg(F.size(words(text)))


def verdict_answers(verdict: Column) -> Column:
    """The accepted words for a True or False verdict; anything else is an error."""
    case = None
    for name, accepted in wording.VERDICT_WORDS.items():
        value = F.array(*[F.lit(word) for word in accepted])
        case = F.when(verdict == name, value) if case is None else case.when(verdict == name, value)
    return case.otherwise(
        F.raise_error(F.concat(F.lit("unknown verdict: "), verdict)).cast("array<string>")
    )


def find_answers(docs: DataFrame, answers: DataFrame, small_rows: int = 20_000, salts: int = 64) -> DataFrame:
    """(item_id, doc_id): documents that hold an answer as a token run.

    ``docs`` is (doc_id, text), ``answers`` is (item_id, answer), both large.
    An answer without tokens is found in every document; it has one row here,
    with a null doc_id that stands for all of them.

    Answers that fit into a task (their number and size are checked) become one automaton, which runs
    along each document's tokens once. More of them are looked up by the token
    that the fewest documents have, so no document meets an answer it shares no
    rare word with: (document, token) pairs without the text are joined with the answers,
    salted against common tokens, and only documents with a hit get their text for the check.
    """
    lists = answers.select("item_id", tokenize(nfd(F.col("answer")), uncased=True).alias("_run"))
    runs = lists.filter(F.size("_run") > 0).select(
        "item_id", framed(F.col("_run")).alias("_needle"), F.array_distinct("_run").alias("_words")
    )
    everywhere = lists.filter(F.size("_run") <= 0).select("item_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    parsed = docs.select("doc_id", tokenize(nfd(F.col("text")), uncased=True).alias("_tokens"))
    framed_docs = parsed.select("doc_id", framed(F.col("_tokens")).alias("_haystack"))
    local = small_copy(runs.select("item_id", "_needle"), small_rows)
    if local is not None:
        found = _run_automaton(framed_docs, local)
    else:
        spread = runs.select("item_id", "_needle", F.explode("_words").alias("token"))
        asked = spread.select("token").distinct()
        exploded = parsed.select("doc_id", F.explode(F.array_distinct("_tokens")).alias("token"))
        # partial counts come first, so a common word is no hot key
        known = exploded.join(asked, "token", "left_semi")
        counts = known.groupBy("token").agg(F.count("*").alias("_df"))
        rarity = F.struct(F.coalesce("_df", F.lit(0)), "token")
        keyed = (
            spread.join(counts, "token", "left")
            .groupBy("item_id", "_needle")
            .agg(F.min_by("token", rarity).alias("token"), F.min(F.coalesce("_df", F.lit(0))).alias("_least"))
            .filter("_least > 0")  # a word of the answer that no document has
            .drop("_least")
        )
        salted_docs = exploded.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        salted_keys = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = salted_docs.join(salted_keys, ["token", "_salt"]).select("item_id", "_needle", "doc_id")
        held = pairs.join(framed_docs, "doc_id")
        found = held.filter(F.contains(F.col("_haystack"), F.col("_needle"))).select("item_id", "doc_id")
    return found.distinct().unionByName(everywhere)


def _run_automaton(framed_docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(item_id, doc_id) of framed needles inside framed documents. ``needles`` is local and
    of bounded size; its automaton is built once a task."""
    table = needles.toArrow()
    shared = framed_docs.sparkSession.sparkContext.broadcast((table.column("item_id").combine_chunks(), table.column("_needle").to_pylist()))

    def run(batches):
        import ahocorasick

        items, texts = shared.value
        owners: dict[str, list[int]] = {}
        for place, text in enumerate(texts):
            owners.setdefault(text, []).append(place)
        automaton = ahocorasick.Automaton()
        for text, places in owners.items():
            automaton.add_word(text, tuple(places))
        automaton.make_automaton()
        for batch in batches:
            hits, rows = [], []
            for row, text in enumerate(batch.column("_haystack").to_pylist()):
                if text is not None and owners:
                    found = {place for _, places in automaton.iter(text) for place in places}
                    hits.extend(found)
                    rows.extend([row] * len(found))
            yield pa.RecordBatch.from_arrays(
                [items.take(pa.array(hits, pa.int64())), batch.column("doc_id").take(pa.array(rows, pa.int64()))], names=["item_id", "doc_id"]
            )

    schema = T.StructType([needles.schema["item_id"], framed_docs.schema["doc_id"]])
    return framed_docs.mapInArrow(run, schema)


# --- overlap of token bags ------------------------------------------------------------


OVERLAP = "array<struct<common:bigint,n_left:bigint,n_right:bigint>>"


def bag_overlap(left: Column, right: Column, orders: int = 1) -> Column:
    """For the items, and the runs of 2 to ``orders`` items, of two lists in one
    row: how many they share, counting repeats, and how many each has. Rows
    are counted where they lie."""

    @F.pandas_udf(OVERLAP)
    def overlap(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        from collections import Counter

        def runs(items, n):
            return Counter(items if n == 1 else zip(*[items[i:] for i in range(n)]))

        def both(a, b):
            a, b = [] if a is None else list(a), [] if b is None else list(b)
            out = []
            for n in range(1, orders + 1):
                common = (runs(a, n) & runs(b, n)).total()
                out.append((common, max(0, len(a) - n + 1), max(0, len(b) - n + 1)))
            return out

        return pd.Series([both(a, b) for a, b in zip(lefts, rights)])

    return overlap(left, right)


def f_measure(common: Column, n_left: Column, n_right: Column) -> Column:
    precision, rec = common / n_left, common / n_right
    return F.when(common == 0, F.lit(0.0)).otherwise(2 * precision * rec / (precision + rec))


def _bag_f1(bag: Column) -> Column:
    return f_measure(bag["common"], bag["n_left"], bag["n_right"])


def _best_f1(rows: DataFrame, key: str, prediction: str, answers: str, split, name: str) -> DataFrame:
    """A row without answers scores 0."""
    flat = rows.select(key, prediction, F.posexplode_outer(answers).alias("_answer", "_gold"))
    bag = F.get(bag_overlap(split(F.col(prediction)), split(F.col("_gold"))), F.lit(0))
    scored = flat.select(key, F.when(F.col("_gold").isNull(), F.lit(0.0)).otherwise(_bag_f1(bag)).alias("_f1"))
    return scored.groupBy(key).agg(F.max("_f1").alias(name))


def token_f1(rows: DataFrame, key: str, prediction: str, answers: str) -> DataFrame:
    """(key, f1): best F1 over the answers, on words of normalised text."""
    return _best_f1(rows, key, prediction, answers, lambda c: words(normalize_answer(c)), "f1")


def char_f1(rows: DataFrame, key: str, prediction: str, answers: str) -> DataFrame:
    """(key, f1): the same on single characters, spaces included."""

    def characters(c):
        return F.filter(F.split(normalize_answer(c), ""), lambda x: x != "")

    return _best_f1(rows, key, prediction, answers, characters, "f1")


# --- longest common subsequences ------------------------------------------------------


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict = {}
    for i, item in enumerate(a):
        places[item] = places.get(item, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for item in b:
        hit = free & places.get(item, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - bin(free).count("1")


def lcs_places(a: list, b: list) -> set[int]:
    """Positions in ``a`` of one longest common subsequence. Keeps a bit row per
    item of ``b`` and walks back over them."""
    places: dict = {}
    for i, item in enumerate(a):
        places[item] = places.get(item, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = [full]
    for item in b:
        free = rows[-1]
        hit = free & places.get(item, 0)
        rows.append(((free + hit) | (free - hit)) & full)

    def longest(i, j):  # of the first i and the first j items
        return i - (rows[j] & ((1 << i) - 1)).bit_count()

    found, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif longest(i, j - 1) > longest(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


def _f(common: int, n_left: int, n_right: int) -> float:
    if not common:
        return 0.0
    precision, rec = common / n_left, common / n_right
    return 2 * precision * rec / (precision + rec)


@F.pandas_udf(T.DoubleType())
def _rouge_l(predictions: pd.Series, answers: pd.Series) -> pd.Series:
    def best(prediction, golds):
        left = prediction.split()
        return max((_f(lcs_length(left, g.split()), len(left), len(g.split())) for g in golds), default=0.0)

    return pd.Series([best(p, g) for p, g in zip(predictions, answers)])


def rouge_l(prediction: Column, answers: Column) -> Column:
    """Best F1 of the longest common subsequence of words over the answers.

    The text is not normalised; an empty prediction scores 0.
    """
    return _rouge_l(prediction, answers)


@F.pandas_udf(T.DoubleType())
def _rouge_lsum(predictions: pd.Series, references: pd.Series) -> pd.Series:
    from collections import Counter

    def score_pair(predicted, reference):
        left = [list(s) for s in predicted if len(s)]
        right = [list(s) for s in reference if len(s)]
        n_left, n_right = sum(map(len, left)), sum(map(len, right))
        left_bag = Counter(t for s in left for t in s)
        right_bag = Counter(t for s in right for t in s)
        common = 0
        for sentence in right:
            places = set().union(*[lcs_places(sentence, other) for other in left]) if left else set()
            for place in sorted(places):
                token = sentence[place]
                if left_bag[token] > 0 and right_bag[token] > 0:
                    common += 1
                    left_bag[token] -= 1
                    right_bag[token] -= 1
        return _f(common, n_left, n_right)

    return pd.Series([score_pair(p, r) for p, r in zip(predictions, references)])


def rouge_lsum(prediction: Column, reference: Column) -> Column:
    """F of the summary-level LCS: per reference line, the union of its common
    subsequences with every predicted line; each token counts at most as often
    as it occurs on both sides."""

    def lines(c):
        return F.transform(F.split(c, "\n"), lambda line: tokenize(line, uncased=True))

    return _rouge_lsum(lines(prediction), lines(reference))


def truthful_scores(rows: DataFrame, key: str, prediction: str, answers: str) -> DataFrame:
    """One row: mean token F1 and mean ROUGE-L."""
    f1 = token_f1(rows, key, prediction, answers)
    rl = rows.select(key, rouge_l(F.col(prediction), F.col(answers)).alias("rl"))
    return f1.join(rl, key).agg(F.avg("f1").alias("f1"), F.avg("rl").alias("rl"))


# --- n-gram overlap -------------------------------------------------------------------


def rouge_n(pairs: DataFrame, key: str, prediction: str, reference: str, n: int) -> DataFrame:
    """(key, f): n-gram F of lower-cased tokens, without stemming."""
    left, right = (tokenize(F.col(c), uncased=True) for c in (prediction, reference))
    bags = pairs.select(key, F.get(bag_overlap(left, right, n), F.lit(n - 1)).alias("bag"))
    return bags.select(key, _bag_f1(F.col("bag")).alias("f"))


def corpus_bleu(pairs: DataFrame, key: str, prediction: str, reference: str, order: int = 4) -> DataFrame:
    """One row (bleu, brevity, ratio parts): clipped n-gram matches summed over
    the corpus, brevity penalty, one reference per prediction.

    Orders without any match are smoothed by halving: the first such order
    counts 1/2 match, the next 1/4, and so on. The score is out of 100.
    """
    bags = pairs.select(bag_overlap(tokenize(F.col(prediction)), tokenize(F.col(reference)), order).alias("bags"))
    sums = bags.agg(
        *[
            F.sum(F.col("bags")[n - 1][column]).alias(f"{column}_{n}")
            for n in range(1, order + 1)
            for column in ("common", "n_left", "n_right")
        ]
    )
    zeros, logs = F.lit(0), F.lit(0.0)
    for n in range(1, order + 1):
        common, total = F.col(f"common_{n}").cast("double"), F.col(f"n_left_{n}").cast("double")
        zeros = zeros + (common == 0).cast("int")
        logs = logs + F.log(F.when(common == 0, F.pow(F.lit(2.0), -zeros)).otherwise(common) / total)
    brevity = F.when(F.col("n_left_1") >= F.col("n_right_1"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("n_right_1") / F.col("n_left_1"))
    )
    bleu = F.when(F.least(*[F.col(f"n_left_{n}") for n in range(1, order + 1)]) == 0, F.lit(0.0)).otherwise(
        100.0 * brevity * F.exp(logs / order)
    )
    return sums.select(
        bleu.alias("bleu"),
        brevity.alias("brevity"),
        *[F.col(f"common_{n}").alias(f"matches_{n}") for n in range(1, order + 1)],
        *[F.col(f"n_left_{n}").alias(f"ngrams_{n}") for n in range(1, order + 1)],
    )
