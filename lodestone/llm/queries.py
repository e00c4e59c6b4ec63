"""The named queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.binding import let
from . import (
    bpe,
    decontamination,
    language_model,
    page_text,
    periodic,
    personal_data,
    ranked_search,
    repeats,
    sharding,
    simhash,
    toxicity,
    warc,
    whitening,
)
from .tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(read) -> DataFrame``; ``read(table)`` gives a whole table."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(lambda t: spark.read.parquet(f"{folder}/{t}.parquet"))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op8_shards")
def op8_shards(read):
    """All documents in 16 contiguous shards of nearly equal bytes."""
    return sharding.shard_by_bytes(read("documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_toxicity")
def op7_toxicity(read):
    """Every document scored by a chain model learned from the labels."""
    docs = read("documents")
    model = toxicity.train(docs, read("labels"))
    return toxicity.score(docs, model)


@query("op5_personal_data")
def op5_personal_data(read):
    """Personal data in every document, by anchors."""
    return personal_data.find(read("documents")).drop("redacted")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BENCHMARK_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op6_decontamination",
    f"""
    WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {BENCHMARK_WORDS} AS ws FROM benchmark),
    sized AS (SELECT item, ws, least(10, len(ws))::BIGINT AS n FROM item WHERE len(ws) > 0),
    pattern AS (
      SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS words
      FROM (SELECT item, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
    doc AS (
      SELECT row_number() OVER () AS r, doc_id, {BENCHMARK_WORDS} AS ws FROM documents),
    place AS (
      SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS words
      FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
            FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(ws) >= n)),
    found AS (SELECT r, item, i, n FROM place JOIN pattern USING (n, words)),
    hits AS (SELECT r, count(DISTINCT w) AS n_hit
             FROM (SELECT r, unnest(range(i, i + n)) AS w FROM found) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
              FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
    """,
)
def op6_decontamination(read):
    """Words of every document that lie in a window of a benchmark item."""
    found = decontamination.contamination(read("documents"), read("benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query("op10_page_text")
def op10_page_text(read):
    """The main text of every page."""
    return page_text.extract(read("pages"))


@query("op4_near_copies")
def op4_near_copies(read):
    """Every document's fingerprint and the component of near copies it is in."""
    return simhash.near_copies(read("documents"))


@query("op1_repeats")
def op1_repeats(read):
    """What is left of every document without strings of 100 bytes seen before."""
    found = repeats.without_repeats(read("documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_bpe")
def op3_bpe(read):
    """Every document as tokens of a byte-level vocabulary, and back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(read("documents"), path), path)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op2_warc",
    f"""
    WITH page AS (
      SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
    digest AS (
      SELECT page_id, payload, strlen(payload) AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i:
          '{warc.ALPHABET}'[(((('0x' || hex[5 * (i // 4) + 1:5 * (i // 4) + 5])::BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1]),
          '') AS payload_digest
      FROM page),
    first AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS largest FROM digest)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
      CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
    FROM first
    """,
)
def op2_warc(read):
    """Every page written to archives, in segments, and read back."""
    pages = read("pages")
    path = shared_folder(pages.sparkSession)
    warc.write(pages, path)
    return warc.read(pages.sparkSession, path).drop("payload", "complete")


@query("op9_search")
def op9_search(read):
    """The ten best documents for every document whose id is divisible by 50."""
    docs = read("documents")
    queries = docs.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return ranked_search.search(docs, queries)


def _text_with_run():
    """The text of a tenth of the documents from some word on a repetition of the
    words there, by the checksum of doc_id; all others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(b):
        def placed(c):
            period = c["period"]
            places = F.sequence(F.lit(0), F.size(c["words"]) - 1)
            return F.array_join(
                F.transform(
                    places,
                    lambda i: F.get(c["words"], F.when(i < c["a"], i).otherwise(c["a"] + F.pmod(i - c["a"], period))),
                ),
                " ",
            )

        n = F.size(b["words"])
        a = F.pmod(b["g"], n).cast("int")
        period = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(b["g"], F.lit(8))))).cast("int")
        return F.when(n > 0, let(placed, words=b["words"], a=a, period=period)).otherwise("")

    return F.when(h % 10 == 0, let(repeated, words=words, g=F.floor(h / 10))).otherwise(F.col("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(read):
    """The periodic runs of words in every document, and its text without their repeats."""
    found = periodic.periodic_runs(read("documents").select("doc_id", _text_with_run().alias("text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_whitening")
def op12_whitening(read):
    """Every vector on the leading components of all, with unit spread."""
    return whitening.whiten(read("embeddings"))


@query("op13_lm_scores")
def op13_lm_scores(read):
    """Every document scored by a model of word pairs, learned from nine tenths of them."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held_out = F.crc32(doc_id.cast("binary")) % 10 == 0
    docs = read("documents")
    found = language_model.score(docs, language_model.train(docs.filter(~held_out)))
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
