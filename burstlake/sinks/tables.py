"""Where results go: logs, reports, spectrograms, spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import SPOT


def write_log(df: DataFrame, path: str) -> None:
    """Append decode or launch records as JSON lines."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same from a stream, exactly once."""
    return (stream.writeStream.format("json").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))


def write_report(df: DataFrame, path: str, run_id: int) -> None:
    """Report rows of one run. Writing a run again replaces it and leaves the others."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def write_spectrogram(df: DataFrame, path: str) -> None:
    """Frames by stream and window: a window is one file, written by one task."""
    (df.repartition("stream_id", "window_id").sortWithinPartitions("stream_id", "window_id", "frame")
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("stream_id", "window_id").parquet(path))


def export_spots(stream: DataFrame, path: str, checkpoint: str, every: str | None = "5 minutes") -> StreamingQuery:
    """All pending spots as one batch every ``every``; ``None`` flushes what is there and stops.

    A failed batch is replayed from the checkpoint, and replaces its own folder,
    so a spot is written at least once and never twice.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        (batch.select(*SPOT.names).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
