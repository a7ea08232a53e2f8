"""Streams: labels appended once per id, vectors kept once per content, comments counted by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulewake.functions import text
from rulewake.operators.labels import Labeler, labelled


def labelling(stream: DataFrame, prompt: str, labeler: Labeler, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Label what arrives and append it to a table, each key once.

    A batch that is run again after a failure finds its rows in the table and appends nothing, so the result is exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        labelled(new, prompt, labeler).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_contents(stream: DataFrame, id_column: str, text_column: str, when: str, delay: str = "7 days") -> DataFrame:
    """Rows whose (id, content hash) has not been seen within the delay; state older than the watermark is dropped."""
    hashed = stream.withColumn("content_hash", text.content_hash(F.col(text_column)))
    return hashed.withWatermark(when, delay).dropDuplicatesWithinWatermark([id_column, "content_hash"])


def counted(stream: DataFrame, key: str, when: str, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(window, key, n): rows by key and window; rows later than the delay are left out."""
    return stream.withWatermark(when, delay).groupBy(F.window(when, width).alias("window"), key).agg(F.count("*").alias("n"))


def polled(stream: DataFrame, collect: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Hand each batch of finished jobs to a function, at an interval; where it stopped is kept in the checkpoint."""
    return stream.writeStream.foreachBatch(collect).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
