"""JSON lines, tab-separated and Parquet shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import SPACES, strip
from . import schemas

# quote="" turns quoting off: passages hold lone quotation marks
PLAIN_TSV = {"sep": "\t", "quote": "", "escape": "", "mode": "FAILFAST"}


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def read_splits(spark: SparkSession, train: str, dev: str | None = None, schema: str = schemas.INSTRUCTION) -> DataFrame:
    """Train and, if given, dev rows with a ``split`` column."""
    parts = [read_jsonl(spark, train, schema).withColumn("split", F.lit("train"))]
    if dev is not None:
        parts.append(read_jsonl(spark, dev, schema).withColumn("split", F.lit("dev")))
    return reduce(DataFrame.unionByName, parts)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**PLAIN_TSV).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("quote", "").csv(path)


# --- passages ------------------------------------------------------------------


def passage_text(title: Column, passage: Column) -> Column:
    """``title | passage``, or the passage alone without a title."""
    return F.when(title.isNotNull(), F.concat(title, F.lit(" | "), passage)).otherwise(passage)


def usable_passages(passages: DataFrame) -> DataFrame:
    """(pid, passage) of the rows with a non-empty passage."""
    kept = passages.filter(F.length("passage") >= 1)
    return kept.select("pid", passage_text(F.col("title"), F.col("passage")).alias("passage"))


def rejected_passages(passages: DataFrame) -> DataFrame:
    """Rows without a passage; an importer should find none."""
    return passages.filter(F.col("passage").isNull() | (F.length("passage") < 1))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``pid, passage[, title]`` as raw (pid, passage, title)."""
    parts = F.split(F.btrim("value", F.lit(SPACES)), "\t")
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).cast("bigint").alias("pid"),
        F.get(parts, F.lit(1)).alias("passage"),
        F.get(parts, F.lit(2)).alias("title"),
    )


def wiki_text(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit(" "), F.btrim(text, F.lit('"')))


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, headed lines ``id, text, title`` as (id, passage)."""
    rows = (
        spark.read.schema(schemas.WIKI_PASSAGE)
        .options(sep="\t", header=True, quote='"', escape='"')
        .csv(path)
    )
    return rows.select("id", wiki_text(F.col("title"), F.col("text")).alias("passage"))


# --- queries, judgements, candidates, rankings ------------------------------------


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.QUERY)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.TRIPLET)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.CANDIDATE)


def read_qrels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Lines of four integers ``qid, _, pid, label`` parted by any white space.

    A label other than 1 is an error, or kept as it is without ``strict``.
    """
    parts = F.split(strip(F.col("value")), r"\s+")
    numbers = [F.get(parts, F.lit(i)).cast("bigint") for i in range(4)]
    rows = spark.read.text(path).select(
        numbers[0].alias("qid"), numbers[2].alias("pid"), numbers[3].cast("int").alias("label")
    )
    return rows.withColumn("label", only_positive(F.col("label"))) if strict else rows


def only_positive(label: Column) -> Column:
    problem = F.concat(F.lit("judgement with label "), F.coalesce(label.cast("string"), F.lit("null")))
    return F.when(label == 1, label).otherwise(F.raise_error(problem).cast("int"))


def write_ranking(ranking: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated ``qid, pid, rank`` with ranks from 1."""
    ordered = ranking.select("qid", "pid", "rank").repartition("qid").sortWithinPartitions("qid", "rank")
    write_tsv(ordered, path, mode)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """The ranking as written. The order of rows is the rank column, not the file."""
    return read_tsv(spark, path, schemas.RANKING)


def write_responses(responses: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_jsonl(responses, path, mode)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.RESPONSE)


# --- token arrays and vectors --------------------------------------------------------


def write_shards(df: DataFrame, path: str, rows_per_shard: int = 200_000, mode: str = "errorifexists") -> None:
    """Parquet files of at most ``rows_per_shard`` documents each."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_shard).parquet(path)


def write_token_arrays(df: DataFrame, path: str, expected: int | None = None, mode: str = "errorifexists") -> int:
    """Token arrays as Parquet; with ``expected`` the stored count, which the
    files' footers hold, must match."""
    df.write.mode(mode).parquet(path)
    stored = df.sparkSession.read.parquet(path).count()
    if expected is not None and stored != expected:
        raise ValueError(f"expected {expected} rows, stored {stored}")
    return stored


# --- exam files ------------------------------------------------------------------------


def read_exams(spark: SparkSession, pattern: str, split: str) -> DataFrame:
    """Headerless files, or folders of files, ``<subject>_<split>.csv``; the subject
    is read from the name."""
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+)_{split}\.csv(?:/[^/]+)?$", 1)
    rows = spark.read.schema(schemas.EXAM).options(quote='"', escape='"', multiLine=True).csv(pattern)
    return rows.withColumn("question", strip(F.col("question"))).withColumn(
        "subject", F.replace(F.replace(name, F.lit("%20"), F.lit(" ")), F.lit("_"), F.lit(" "))
    )
