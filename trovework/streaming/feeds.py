"""Streams: the change feed applied batch by batch, use of models in windows, and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovework.functions.text import stage_of
from trovework.operators.changes import last_state


def state_of_files(spark: SparkSession, feed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps path, alive, changed_at and change_id of all files under target, a folder with a version for each batch, and ends when the feed is read.

    Each batch is reduced to the last change of a path, then merged with the version before. A batch that is run again after a
    failure writes the same version again. The feed is a stream with the columns of file_changes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        now = last_state(batch)
        if number > 0:
            before = s.read.parquet(f"{target}/version={number - 1}")
            # the same order as within a batch, so that the batches' borders don't matter
            newer = F.max(F.struct("changed_at", "change_id", "alive")).alias("r")
            now = before.select("path", "alive", "changed_at", "change_id").unionByName(now).groupBy("path").agg(newer).select("path", "r.*")
        now.write.mode("overwrite").parquet(f"{target}/version={number}")

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(calls: DataFrame, length: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Calls, tokens and cost in windows of completed_at, each call once; rows later than late are dropped by the watermark."""
    one = calls.withWatermark("completed_at", late).dropDuplicatesWithinWatermark(["usage_id"])
    return one.groupBy(F.window("completed_at", length)).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost_estimate").alias("cost"))


def progress(messages: DataFrame) -> DataFrame:
    """The stage of each message and whether it ends its run."""
    return messages.withColumn("stage", stage_of(F.col("message"))).withColumn("terminal", F.col("stage").isin("COMPLETE", "FAILED"))
