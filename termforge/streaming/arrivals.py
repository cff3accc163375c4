"""Papers that arrive as a stream extend a stored lexicon, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termforge.config import TextConfig
from termforge.operators import lexicon, terms


def extend_lexicon(papers: DataFrame, path: str, checkpoint: str, config: TextConfig = TextConfig()) -> StreamingQuery:
    """Each batch writes lexicon version ``path/<batch + 1>`` from version ``path/<batch>``; a repeated batch writes the same.

    ``path/0`` must hold a lexicon (an empty one starts afresh). Later batches must hold later papers.
    """

    def step(batch: DataFrame, n: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/{n}")
        lexicon.extend(old, terms.doc_terms(batch, config)).write.mode("overwrite").parquet(f"{path}/{n + 1}")

    return papers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
