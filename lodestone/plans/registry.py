"""The named queries: a DataFrame job each, with an SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import small_copy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in ("documents", "conversations") else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores when the files give too few splits to use
    them. A table with enough splits is read as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and fractions at six digits, for comparison."""
    kinds = dict(df.dtypes)

    def column(name):
        if kinds[name] in ("int", "smallint", "tinyint"):
            return F.col(name).cast("bigint").alias(name)
        return F.round(name, 6).alias(name) if kinds[name] in ("double", "float") else F.col(name)

    return df.select(*[column(c) for c in df.columns])


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- SQL pieces shared by the twins -----------------------------------------------------

TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tok(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def prompt_tok(x: str) -> str:
    return f"regexp_extract_all({x}, '</s>|<DOC>|{TOKEN}')"


def joined(x: str) -> str:
    return f"array_to_string({x}::VARCHAR[], ' ')"


def trimmed(x: str) -> str:
    return rf"trim({x}, E' \t\n\r')"


def choice(options: list[str], seed: str, key: str) -> str:
    """One of the options by the md5 of seed and key."""
    listed = ", ".join(quoted(o) for o in options)
    return f"([{listed}])[('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {len(options)} + 1]"


def normalized(x: str) -> str:
    bare = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"
    pieces = rf"regexp_extract_all({bare}, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+')"
    no_articles = (
        f"array_to_string(list_transform({pieces},"
        " lambda w: CASE WHEN w IN ('a','an','the') THEN ' ' ELSE w END), '')"
    )
    return rf"trim(regexp_replace({no_articles}, '\s+', ' ', 'g'))"


def word_list(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


VOCABULARY = """
  SELECT token, n, row_number() OVER (ORDER BY n DESC, md5(token)) + 6 AS token_id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tokens}) AS token FROM {table}) GROUP BY token)
"""
QA = """
  SELECT u.conv_id * 1000000 + u.turn AS key, u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
"""
VECTORS = "SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings"
CENTROIDS = """
  SELECT label AS cell, list(x ORDER BY i) AS e FROM (
    SELECT label, i, avg(x) AS x FROM (
      SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label
"""


def with_(**parts: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in parts.items()) + " "


# --- derived inputs ------------------------------------------------------------------------


def qa_pairs(t: Tables) -> DataFrame:
    """(key, conv_id, turn, question, answer): each user turn and the reply to it."""
    turns = t.conversations
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    key = (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("key")
    return asked.join(replies, ["conv_id", "turn"]).select(key, "conv_id", "turn", "question", "answer")


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("qid"), "embedding")


def as_docs(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("pid"), "embedding")


def token_vectors(vectors: DataFrame, key: str = "pid") -> DataFrame:
    """Vectors read as token vectors: ten consecutive ones make a document."""
    return vectors.select(
        F.expr("vec_id div 10").alias(key), (F.col("vec_id") % 10).cast("int").alias("pos"), "embedding"
    )


def label_means(vectors: DataFrame, key: str = "cell") -> DataFrame:
    """(cell, embedding): the mean vector of every label, one row per label."""
    flat = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    table = means.groupBy("label").agg(ordered.alias("m")).select(
        F.col("label").alias(key), F.transform("m", lambda m: m["x"]).alias("embedding")
    )
    return trained(table)


def trained(table: DataFrame) -> DataFrame:
    """A small table that many steps look things up in, computed once."""
    local = small_copy(table)
    return table if local is None else local
