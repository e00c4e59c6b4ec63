"""A stream with memory gives the answers of a batch, and searches each question once."""

import time

import numpy as np

from lodestone.operators.search import exact_topk
from lodestone.streaming.memory import retrieve_once

SCHEMA = "qid bigint, question string, embedding array<float>"


def run(spark, root, docs, keep, searched):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")

    def search(new):
        searched.extend(r["qid"] for r in new.collect())
        return exact_topk(new, docs, 3)

    retrieve_once(stream, search, f"{root}/hits", f"{root}/memory", f"{root}/checkpoint", keep).awaitTermination()
    return spark.read.parquet(f"{root}/hits")


def test_repeated_questions_are_searched_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "pid bigint, embedding array<float>")
    asked = {name: rng.normal(size=4).tolist() for name in ("a", "b", "", None, "ü\"x")}
    parts = [["a", "a", "b", "a"], ["b", "", None, None], ["a", "ü\"x", "", None]]
    rows, root = [], str(tmp_path)
    for number, names in enumerate(parts):
        new = [(10 * number + i, name, asked[name]) for i, name in enumerate(names)]
        rows += new
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.parquet(f"{root}/in/{number}")
    searched = []
    hits = run(spark, root, docs, 3600, searched)
    every = exact_topk(spark.createDataFrame(rows, SCHEMA).select("qid", "embedding"), docs, 3)
    key = lambda df: sorted((r["qid"], r["pid"], r["rank"], round(r["score"], 6)) for r in df.collect())
    assert key(hits) == key(every)
    assert len(searched) == len(asked)
    # a restart remembers; what came before is not answered again
    spark.createDataFrame([(90, "b", asked["b"]), (91, "new", asked["a"])], SCHEMA).coalesce(1).write.parquet(f"{root}/in/9")
    again = []
    hits = run(spark, root, docs, 3600, again)
    assert again == [91] and hits.filter("qid in (90, 91)").count() == 6 and hits.count() == 3 * 14


def test_answers_are_forgotten(spark, tmp_path):
    docs = spark.createDataFrame([(0, [1.0])], "pid bigint, embedding array<float>")
    root, searched = str(tmp_path), []
    for number in range(2):
        spark.createDataFrame([(number, "a", [2.0])], SCHEMA).coalesce(1).write.parquet(f"{root}/in/{number}")
        hits = run(spark, root, docs, 1, searched)
        time.sleep(2)
    assert searched == [0, 1] and hits.count() == 2
    assert spark.read.parquet(f"{root}/memory").select("asked_at").distinct().count() == 2
