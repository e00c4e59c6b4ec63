"""A corpus made ready for training: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with
their columns; the last gives tokens. Between stages the documents are written
to shared storage and read again.

In every stage null texts are treated as empty ones and stay (near copies of each other,
without a passage, personal data or words), rows that repeat are judged each by
itself, but for near copies, of which one stays, and no rows give no rows. Other columns
are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import bpe, decontamination, personal_data, simhash, toxicity
from lodestone.llm.tables import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels, doesn't call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of four-word shingles that
    differ in four bits or fewer."""
    return simhash.one_of_each(docs, distance=4, shingle=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return personal_data.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit numbers) of each document."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("personal data", redact_personal_data),
    ("tokens", tokens),
]

#: Learned models, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
