"""Incremental tie-out on Structured Streaming: bank credits arrive, settlement batches are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import MatchConfig
from ..operators.tieout import tie_out


def stream_ties(credits: DataFrame, payments: DataFrame, cfg: MatchConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's ties to ``path``, under its batch number so that a repeated one overwrites itself.

    Batches tied in earlier micro-batches are left out. Within a micro-batch credits choose in their order.
    """

    def step(now: DataFrame, number: int) -> None:
        spark = now.sparkSession
        free = payments
        if number:
            try:
                done = spark.read.parquet(path).where(f"step < {number} AND batch_id IS NOT NULL").select("batch_id")
                free = payments.join(done, payments["parent_id"] == done["batch_id"], "left_anti")
            except Exception as e:  # the first batches may have written nothing
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                    raise
        tie_out(now, free, cfg).write.mode("overwrite").parquet(f"{path}/step={number}")

    return credits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
