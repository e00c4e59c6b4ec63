"""Answer a stream of question vectors against a static vector table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import with_probabilities
from ..operators.search import exact_topk, probe_topk


@dataclass
class StoredIndex:
    """Cells as ``search.write_cells`` stored them, and what is needed to probe them."""

    cells: DataFrame
    counts: DataFrame
    centroids: DataFrame
    nprobe: int = 32


def retrieve_stream(
    questions: DataFrame,
    docs: DataFrame | StoredIndex,
    k: int,
    output: str,
    checkpoint: str,
    exclude_self: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Top-k with probabilities for every question of a stream (qid, embedding).

    ``docs`` is a table of vectors, scanned by every micro-batch with the dot
    product, or a stored index, of which a micro-batch reads the probed cells
    only; the score is then the negative squared distance. ``trigger`` holds
    the arguments of Spark's trigger (what is there now, by default).

    Each micro-batch is searched as a batch and written to a folder of its own
    id, so a batch that is replayed after a failure replaces its first attempt.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        if isinstance(docs, StoredIndex):
            found = probe_topk(batch, docs.cells, docs.centroids, k, docs.nprobe, exclude_self, docs.counts)
            found = found.withColumn("score", -F.col("score"))
        else:
            found = exact_topk(batch, docs, k, "dot", exclude_self)
        hits = with_probabilities(found, k)
        hits.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
