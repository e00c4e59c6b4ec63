import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators.search import exact_topk
from lodestone.sources import files, schemas
from lodestone.storage import checkpoint_root
from lodestone.streaming.retrieve import retrieve_stream


def put(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def test_jsonl_round_trip_and_splits(spark, tmp_path):
    row = {"id": "wiki_qa_5", "messages": [{"role": "user", "content": "a \"b\"\n"}], "task_type": "open_qa"}
    train = put(tmp_path / "train.jsonl", json.dumps(row) + "\n")
    df = files.read_jsonl(spark, train, schemas.INSTRUCTION)
    assert df.first()["background"] is None and df.first()["messages"][0]["content"] == 'a "b"\n'
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), schemas.INSTRUCTION).exceptAll(df).count() == 0
    both = files.read_splits(spark, train, train)
    assert sorted(r["split"] for r in both.collect()) == ["dev", "train"]
    assert files.read_splits(spark, train).count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, put(tmp_path / "bad.jsonl", "{oops\n"), schemas.INSTRUCTION).collect()


def test_passages(spark, tmp_path):
    path = put(tmp_path / "collection.tsv", '7\tsay "hi\ttitle\n8\tplain\n9\t\tx\n')
    raw = files.read_passages(spark, path)
    assert {r["pid"]: r["passage"] for r in files.usable_passages(raw).collect()} == {7: 'title | say "hi', 8: "plain"}
    assert [r["pid"] for r in files.rejected_passages(raw).collect()] == [9]


def test_wiki(spark, tmp_path):
    path = put(tmp_path / "psgs.tsv", 'id\ttext\ttitle\n1\t"a ""b"" c"\tT\n2\tplain\t"U ""v"""\n')
    assert [tuple(r) for r in files.read_wiki(spark, path).orderBy("id").collect()] == [
        ("1", 'T a "b" c'),
        ("2", 'U "v" plain'),
    ]


def test_queries_triplets_candidates(spark, tmp_path):
    assert files.read_queries(spark, put(tmp_path / "q.tsv", '5\twhat is "x\n')).first()["query"] == 'what is "x'
    assert files.read_triplets(spark, put(tmp_path / "t.tsv", "q\tp\tn\n")).columns == ["query", "pos", "neg"]
    assert files.read_candidates(spark, put(tmp_path / "c.tsv", "1\t2\tq\tp\n")).first()["pid"] == 2


def test_qrels(spark, tmp_path):
    path = put(tmp_path / "qrels.tsv", "1\t0\t5\t1\n1 0  6 1\n")
    assert {(r["qid"], r["pid"]) for r in files.read_qrels(spark, path).collect()} == {(1, 5), (1, 6)}
    odd = put(tmp_path / "odd.tsv", "1 0 5 0\n")
    with pytest.raises(Exception, match="label 0"):
        files.read_qrels(spark, odd).collect()
    assert files.read_qrels(spark, odd, strict=False).first()["label"] == 0


def test_ranking_and_responses(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (2, 5, 1)], "qid bigint, pid bigint, rank int")
    files.write_ranking(rows, str(tmp_path / "r"))
    assert files.read_ranking(spark, str(tmp_path / "r")).exceptAll(rows).count() == 0
    answer = spark.createDataFrame([("q", [("t", 5, 1, 0.5, 1.0)])], schemas.RESPONSE)
    files.write_responses(answer, str(tmp_path / "a"))
    assert files.read_responses(spark, str(tmp_path / "a")).exceptAll(answer).count() == 0


def test_shards_and_token_arrays(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("pid"), F.array(F.lit(1), F.lit(-100)).alias("ids")).coalesce(1)
    files.write_shards(df, str(tmp_path / "s"), rows_per_shard=4)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    assert files.write_token_arrays(df, str(tmp_path / "t"), expected=10) == 10
    with pytest.raises(ValueError, match="expected 11"):
        files.write_token_arrays(df, str(tmp_path / "u"), expected=11)


def test_exams_take_the_subject_from_the_name(spark, tmp_path):
    put(tmp_path / "world_history_dev.csv", '" q, ""x"" ",1,2,3,4,B\n')
    row = files.read_exams(spark, str(tmp_path / "*_dev.csv"), "dev").first()
    assert row["subject"] == "world history" and row["question"] == 'q, "x"' and row["answer"] == "B"


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(12)]
    docs = spark.createDataFrame(rows, "pid bigint, embedding array<float>")
    asked = docs.withColumnRenamed("pid", "qid")
    schema = asked.schema
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (asked.filter("qid < 7"), asked.filter("qid >= 7")):
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        retrieve_stream(stream, docs, 3, out, mark).awaitTermination()
    got = spark.read.parquet(out).select("qid", "pid", "rank")
    want = exact_topk(asked, docs, 3).select("qid", "pid", "rank")
    assert got.count() == 36 and got.exceptAll(want).count() == 0


class Stub:
    """A session that names no checkpoint folder."""

    def __init__(self, master):
        self.master, self.conf, self.sparkContext = master, self, self

    def get(self, key, default):
        return default


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_root(spark) and (not named or checkpoint_root(spark) == named)
    assert checkpoint_root(Stub("local[2]")) == checkpoint_root(Stub("local[2]"))
    with pytest.raises(ValueError, match="all executors share"):
        checkpoint_root(Stub("yarn"))
