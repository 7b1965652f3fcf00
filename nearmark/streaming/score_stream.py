"""Scoring of a stream of JSON bodies, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import SearchParams
from ..plans.score import score_bodies


def score_stream(bodies: DataFrame, refs: DataFrame, out: str, checkpoint: str, p: SearchParams = SearchParams(kd=True)) -> StreamingQuery:
    """Start scoring a stream of id, body into Parquet under out, a folder a batch.

    Top-k isn't incremental, so each batch is a static plan; a batch that runs again overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        score_bodies(batch, refs, p).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return bodies.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
