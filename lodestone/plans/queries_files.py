"""File formats: a given table written in each of them, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import has_answer, nfd, tokenize
from ..operators import instructions
from ..sources import files, schemas, shards
from .queries_text import scratch
from .registry import query, tok, trimmed

#: A text on one line, without tabs and without white space at its ends.
LINE = r"trim(regexp_replace(text, '[\n\r\t]', ' ', 'g'), ' ')"


def line(column="text"):
    return F.trim(F.regexp_replace(column, r"[\n\r\t]", " "))


@query(
    "train_dev_splits",
    "SELECT doc_id::VARCHAR AS id, text, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents",
)
def train_dev_splits(t):
    rows = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("id"), "text")
    root = scratch(t, "splits")
    for name, part in (("train", "doc_id % 3 <> 0"), ("dev", "doc_id % 3 = 0")):
        files.write_jsonl(rows.filter(part).drop("doc_id"), f"{root}/{name}")
    return files.read_splits(t.spark, f"{root}/train", f"{root}/dev", schemas.PRETRAIN_DOCUMENT)


@query("passage_file", f"SELECT doc_id AS pid, source || ' | ' || {LINE} AS passage FROM documents WHERE length({LINE}) >= 1")
def passage_file(t):
    path = scratch(t, "passages")
    t.documents.select(F.concat_ws("\t", "doc_id", line(), "source")).write.text(path)
    return files.usable_passages(files.read_passages(t.spark, path))


@query("wiki_file", rf"""SELECT doc_id::VARCHAR AS id, source || ' ' || trim({LINE}, '"') AS passage FROM documents""")
def wiki_file(t):
    path = scratch(t, "wiki")
    rows = t.documents.select(F.col("doc_id").alias("id"), line().alias("text"), F.col("source").alias("title"))
    rows.write.options(sep="\t", header=True, quote='"', escape='"').csv(path)
    return files.read_wiki(t.spark, path)


@query("queries_file", f"SELECT doc_id AS qid, {LINE} AS query FROM documents")
def queries_file(t):
    path = scratch(t, "queries")
    files.write_tsv(t.documents.select("doc_id", line()), path)
    return files.read_queries(t.spark, path)


@query("triplets_file", f"SELECT {LINE} AS query, source AS pos, lang AS neg FROM documents")
def triplets_file(t):
    path = scratch(t, "triplets")
    files.write_tsv(t.documents.select(line(), "source", "lang"), path)
    return files.read_triplets(t.spark, path)


@query("candidates_file", f"SELECT doc_id AS qid, doc_id + 1 AS pid, source AS query, {LINE} AS passage FROM documents")
def candidates_file(t):
    path = scratch(t, "candidates")
    files.write_tsv(t.documents.select("doc_id", F.col("doc_id") + 1, "source", line()), path)
    return files.read_candidates(t.spark, path)


@query("qrels_file", "SELECT vec_id AS qid, vec_id + 1 AS pid, 1 AS label FROM embeddings")
def qrels_file(t):
    path = scratch(t, "qrels")
    fields = [F.col("vec_id"), F.lit(0), F.col("vec_id") + 1, F.lit(1)]
    t.embeddings.select(F.concat_ws("\t", *fields)).write.text(path)
    return files.read_qrels(t.spark, path)


@query("shard_files", "SELECT doc_id, text, true AS fits FROM documents")
def shard_files(t):
    path = scratch(t, "shards")
    files.write_shards(t.documents.select("doc_id", "text"), path, rows_per_shard=50)
    found = t.spark.read.parquet(path).withColumn("file", F.input_file_name())
    sizes = found.groupBy("file").agg((F.count("*") <= 50).alias("fits"))
    return found.join(sizes, "file").select("doc_id", "text", "fits")


@query(
    "shard_lengths",
    f"""SELECT doc_id, len({tok('text')}) AS length, (SELECT count(*) FROM documents) AS listed,
      (SELECT sum(len({tok('text')}))::BIGINT FROM documents) AS total FROM documents""",
)
def shard_lengths(t):
    """The lengths committed with the shards, beside the totals their manifest lists."""
    path = scratch(t, "listed")
    docs = t.documents.select("doc_id", "text")
    shards.write_listed_shards(docs, path, "doc_id", F.size(tokenize(F.col("text"))), rows_per_shard=50)
    rows, total = shards.shard_manifest(t.spark, path).agg(F.sum("rows"), F.sum("length")).first()
    lengths = shards.read_shard_lengths(t.spark, path, "doc_id")
    return lengths.withColumn("listed", F.lit(rows).cast("bigint")).withColumn("total", F.lit(total).cast("bigint"))


@query("token_array_file", "SELECT doc_id, n_chars AS first, lang = 'en' AS second FROM documents")
def token_array_file(t):
    path = scratch(t, "arrays")
    rows = t.documents.select("doc_id", F.array("n_chars", (F.col("lang") == "en").cast("long")).alias("ids"))
    files.write_token_arrays(rows, path, expected=t.documents.count())
    found = t.spark.read.parquet(path)
    return found.select("doc_id", F.col("ids")[0].alias("first"), (F.col("ids")[1] == 1).alias("second"))


EXAM = rf"""{trimmed('text')} || E'\nA. ' || source || E'\nB. ' || lang || E'\nC. ' || n_chars || E'\nD. ' || doc_id
  || E'\nAnswer: B'"""


@query("exam_files", f"SELECT 'lang ' || lang AS subject, {EXAM} AS question FROM documents")
def exam_files(t):
    """Documents as exam questions, a file name for each language."""
    root = scratch(t, "exams")
    columns = ["text", "source", "lang", F.col("n_chars").cast("string"), F.col("doc_id").cast("string"), F.lit("B")]
    for r in t.documents.select("lang").distinct().collect():  # four languages
        part = t.documents.filter(F.col("lang") == r["lang"]).select(*columns)
        part.write.options(quote='"', escape='"', quoteAll=True).csv(f"{root}/lang_{r['lang']}_dev.csv")
    rows = files.read_exams(t.spark, f"{root}/*_dev.csv", "dev")
    choices = [F.col(c) for c in "ABCD"]
    return rows.select("subject", instructions.exam_question(F.col("question"), choices, F.col("answer")).alias("question"))


@query("knowledge_task", "SELECT source AS question, text AS answer FROM documents")
def knowledge_task(t):
    rows = t.documents.select(F.col("source").alias("input"), F.array(F.struct(F.col("text").alias("answer"))).alias("output"))
    return instructions.knowledge_task(rows)


@query(
    "decomposed_match",
    """SELECT doc_id, length(text) + length(regexp_replace(text, '[^àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ]', '', 'g')) AS points,
      true AS found FROM documents""",
)
def decomposed_match(t):
    """Texts in decomposed letters, searched for the text as it was written."""
    rows = t.documents.select("doc_id", "text", nfd(F.col("text")).alias("apart"))
    return rows.select("doc_id", F.length("apart").alias("points"), has_answer(F.array("text"), F.col("apart")).alias("found"))
