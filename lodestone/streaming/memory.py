"""Answers remembered across micro-batches: a repeated question is not searched again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import skewed_join
from ..storage import stored


def _asked(keep_ms: int):
    """When a question was answered last is its state. Until that is forgotten, its rows pass
    without their vector; else the first one keeps it, which asks for a search."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = state.get[0] if state.exists else None
        known = None
        for part in parts:
            if not len(part):
                continue
            if known is None:
                now = int(part["now"].iloc[0])  # the same for a whole micro-batch
                known = at is not None and now - at < keep_ms
                at = at if known else now
                state.update((at,))
                state.setTimeoutTimestamp(max(at + keep_ms, state.getCurrentWatermarkMs() + 1))
            out = part[["qid", "question"]].assign(asked_at=at, embedding=None)
            if not known:
                out["embedding"] = [part["embedding"].iloc[0]] + [None] * (len(part) - 1)
                known = True
            yield out

    return run


def retrieve_once(
    questions: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    output: str,
    memory: str,
    checkpoint: str,
    keep: int = 24 * 3600,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hits for every question of a stream (qid, question, embedding), each question searched once.

    ``search`` maps (qid, embedding) to (qid, ...hits). Keyed state tells which questions were
    answered in the last ``keep`` seconds; the others are searched, one row for
    each, and their hits stored in ``memory``, a folder for each moment of asking. Rows then get their hits by
    question and moment, so a micro-batch reads the folders its questions name only.
    Folders older than ``keep`` are of no use and may be removed.

    A replayed micro-batch has the state and the time of its first attempt, finds the same questions new
    and replaces what it wrote. Rows of one question meet in one task, which passes them on in chunks and
    holds one of them; a question asked very often is spread again when its hits are attached. A null
    question is one like any other; a question without hits has no rows. ``output`` has
    (qid, question, ...hits, batch_id).
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch)
        if rows.isEmpty():  # only forgets
            return
        found = search(rows.filter(F.col("embedding").isNotNull()).select("qid", "embedding"))
        fields = [c for c in found.columns if c != "qid"]
        hits = found.groupBy("qid").agg(F.collect_list(F.struct(*fields)).alias("hits"))
        new = rows.filter(F.col("embedding").isNotNull()).select("qid", "question", "asked_at")
        new = new.join(hits, "qid", "left").select("question", "hits", "asked_at")
        new = stored(new)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asked_at").parquet(memory)
        name = F.to_json(F.struct("asked_at", "question")).alias("_name")
        known = batch.sparkSession.read.schema(new.schema).parquet(memory)
        moments = rows.select("asked_at").distinct()
        known = known.join(F.broadcast(moments), "asked_at", "left_semi")  # as many as micro-batches within ``keep``
        joined = skewed_join(rows.select("qid", "question", name), known.select(name, "hits"), "_name", [F.col("qid")])
        joined.select("qid", "question", F.inline("hits")).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    schema = "qid bigint, question string, asked_at bigint, embedding " + questions.schema["embedding"].dataType.simpleString()
    # arrival as event time: no row is ever late, and a micro-batch that has nothing to forget is not run
    arrived = questions.select("qid", "question", "embedding", F.current_timestamp().alias("arrived"))
    arrived = arrived.withColumn("now", F.unix_millis("arrived")).withWatermark("arrived", "1 second")
    asked = arrived.groupBy("question")
    timeout = GroupStateTimeout.EventTimeTimeout
    marked = asked.applyInPandasWithState(_asked(keep * 1000), schema, "asked_at bigint", "append", timeout)
    writer = marked.writeStream.outputMode("append").foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
