"""A vocabulary with stable ids, and texts encoded with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import wording
from ..functions.binding import let
from ..functions.choice import leading_bits
from ..storage import stored
from .ordering import with_position

SPECIAL_IDS = {token: number for number, token in enumerate(wording.SPECIAL_TOKENS)}
FIRST_WORD_ID = len(SPECIAL_IDS)


def build_vocabulary(texts: DataFrame, tokens: Column) -> DataFrame:
    """(token, n, token_id) over all tokens of ``texts``.

    Ids follow falling frequency, ties broken by the md5 of the token. The rank
    buckets are steps of the logarithm of the frequency; the crowded low
    frequencies, where each step holds a single value, are split further by
    md5, so no bucket holds a large part of the vocabulary.
    """
    counted = (
        texts.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    )
    marked = counted.withColumn("_mark", F.md5("token"))
    step = F.floor(F.log2(F.col("n")) * 64).cast("bigint")
    fine = F.when(F.col("n") <= 64, leading_bits(F.col("_mark"), 3)).otherwise(F.lit(0))
    placed = with_position(marked, [F.col("n").desc(), F.col("_mark")], -step * 4096 + fine)
    return placed.select("token", "n", (F.col("position") + FIRST_WORD_ID).cast("int").alias("token_id"))


#: Words that are looked up where a text lies, and the slots they share.
SLOT_WORDS, SLOTS = 16_384, 65_536


def _slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


def _slot_table(vocabulary: DataFrame) -> tuple[Column, Column]:
    """(words, ids) of SLOTS places: the special tokens and the most frequent words,
    each in the place its hash names. Of two words for one place the more frequent has it,
    a special token before any. Both arrays are literals: they travel with the task,
    not with a row."""
    spark = vocabulary.sparkSession
    special = spark.createDataFrame([(t, i, 2**62) for t, i in SPECIAL_IDS.items()], "token string, token_id int, n bigint")
    frequent = vocabulary.filter(F.col("token").isNotNull()).orderBy(F.col("n").desc(), "token").limit(SLOT_WORDS)
    both = special.unionByName(frequent.select("token", "token_id", "n"))
    rows = both.select("token", "token_id", "n", _slot(F.col("token"))).collect()
    words, ids = [""] * SLOTS, [-1] * SLOTS
    for token, number, _, slot in sorted(rows, key=lambda r: (-r[2], r[0])):
        if ids[slot] < 0:
            words[slot], ids[slot] = token, number
    # constant expressions: the optimiser makes each of them one literal
    return F.split(F.lit("\u0001".join(words)), "\u0001"), F.split(F.lit(" ".join(map(str, ids))), " ").cast("array<int>")


def encode(
    df: DataFrame,
    keys: list[str],
    tokens: Column,
    vocabulary: DataFrame,
    max_len: int | None = None,
    name: str = "ids",
) -> DataFrame:
    """(keys, ids): the ids of each row's tokens, cut at ``max_len`` tokens.

    Words missing from the vocabulary become the unknown id. Special tokens in
    the list keep their fixed ids. A null list has no ids, a null token none.

    Frequent words are looked up inside the row, in a table of slots. Only the other words
    become rows: they are joined with the vocabulary, where none of them is a hot key, and
    put back into the rows they came from.
    """
    kept = F.slice(tokens, 1, max_len) if max_len else tokens
    vocabulary = stored(vocabulary)  # read twice by the look-up
    words, numbers = _slot_table(vocabulary)

    def split(v):
        ids = F.transform(v["tokens"], lambda x: F.when(F.get(words, _slot(x)) == x, F.get(numbers, _slot(x))))

        def parts(w):
            missing = F.transform(
                w["tokens"], lambda x, i: F.when(F.get(w["ids"], i).isNull(), F.struct(i.alias("pos"), x.alias("token")))
            )
            return F.struct(w["ids"].alias("ids"), F.array_compact(missing).alias("rare"))

        return let(parts, tokens=v["tokens"], ids=ids)

    none = F.array().cast("array<string>")
    rows = df.select(*keys, F.inline(F.array(let(split, tokens=F.coalesce(kept, none)))))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    whole = rows.filter(F.size("rare") == 0).select(*keys, F.col("ids").alias(name))
    partly = rows.filter(F.size("rare") > 0)
    asked = partly.select("_row", F.inline("rare")).filter(F.col("token").isNotNull())
    special = F.create_map(*[x for t, i in SPECIAL_IDS.items() for x in (F.lit(t), F.lit(i))])
    number = F.coalesce(F.try_element_at(special, "token"), "token_id", F.lit(SPECIAL_IDS[wording.UNK]))
    found = asked.join(vocabulary.select("token", "token_id"), "token", "left")
    found = found.groupBy("_row").agg(F.collect_list(F.struct("pos", number.alias("id"))).alias("_found"))
    entries = F.filter(F.transform("ids", lambda x, i: F.struct(i.alias("pos"), x.alias("id"))), lambda e: e["id"].isNotNull())
    nothing = F.array().cast("array<struct<pos:int,id:int>>")
    together = F.transform(F.array_sort(F.concat(entries, F.coalesce("_found", nothing))), lambda e: e["id"])
    return whole.unionByName(partly.join(found, "_row", "left").select(*keys, together.alias(name)))


def fit_width(ids: Column, width: int, filler: int) -> Column:
    """``ids`` cut or filled on the right to exactly ``width`` entries."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(filler), width)), 1, width)


def query_input(ids: Column, width: int = 32) -> Column:
    """Query mark, ids, then mask ids up to ``width`` (query augmentation)."""
    marked = F.concat(F.array(F.lit(SPECIAL_IDS[wording.QUERY_MARK])), ids)
    return fit_width(marked, width, SPECIAL_IDS[wording.MASK])


def document_input(ids: Column, width: int = 180) -> Column:
    """Document mark, ids, then pad ids up to ``width``."""
    marked = F.concat(F.array(F.lit(SPECIAL_IDS[wording.DOC_MARK])), ids)
    return fit_width(marked, width, SPECIAL_IDS[wording.PAD])


def attention(ids: Column, filler: int) -> Column:
    """1 where an id is not the filler, else 0."""
    return F.transform(ids, lambda i: (i != filler).cast("int"))

