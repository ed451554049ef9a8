"""Ingestion jobs as a stream: each batch of submissions is processed and its outcome is logged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The states of a job, in the order in which they follow.
STATES = ("pending", "processing", "completed", "failed")

#: What Spark's messages hold when machines and not rows are at fault.
LOST = ("ExecutorLostFailure", "FetchFailed", "No space left on device", "cancelled because SparkContext was shut down")


def latest_states(log: DataFrame) -> DataFrame:
    """(job_id, status, error, at): the last logged state of each job; at equal times the later state counts."""
    order = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    return log.groupBy("job_id").agg(F.max(F.struct("at", order.alias("o"), "status", "error")).alias("m")).select("job_id", "m.status", "m.error", "m.at")


def run_jobs(submissions: DataFrame, work: Callable[[DataFrame], DataFrame], log_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Process a stream of submissions (job_id, …) with `work`, in micro-batches; one log row for each change of state.

    A failure of the work on its rows is the outcome `failed`; lost executors or disks end the stream, which tries the batch
    again when it is started anew. A batch that is tried again overwrites its own folders, so results and log rows stand once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        def log(status: str, error: str | None = None) -> None:
            states = rows.select("job_id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("at"))
            states.write.mode("overwrite").parquet(f"{log_path}/batch={number}/step={STATES.index(status)}")

        log("pending")
        log("processing")
        try:
            work(rows).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        except Exception as problem:
            if any(x in str(problem) for x in LOST):
                raise  # the stream tries the batch again
            log("failed", str(problem)[:500])
        else:
            log("completed")

    return submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def submitted_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of submissions from JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def event_windows(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of hourly windows; works on streams and on tables. An extension."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )
