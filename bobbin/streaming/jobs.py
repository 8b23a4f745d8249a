"""Streaming forms of the submission and quality jobs. State and results live in the shared folder or the sink named."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import fresh
from ..views import VIEWS


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """The stream of submissions from event files under a path."""
    schema = spark.read.parquet(path).schema
    spark.readStream.schema(schema).parquet(f"{path}*").createOrReplaceTempView("arriving_events")
    return spark.sql(VIEWS["v_submissions"].replace("FROM events", "FROM arriving_events"))


def dedupe(stream: DataFrame) -> DataFrame:
    """event_id, content_key, job_id, runs: a repeat of a key that hasn't failed returns the earlier job; after an error it runs anew.

    The state of a key is its current job. Rows of one batch are taken by time; rows that arrive in a later batch are
    taken as later."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        job = state.get[0] if state.exists else None
        jobs, runs = [], []
        for event, kind in zip(rows["event_id"], rows["state"], strict=True):
            runs.append(job is None)
            job = int(event) if job is None else job
            jobs.append(job)
            if kind == "error":
                job = None
        if job is None:
            state.remove() if state.exists else None
        else:
            state.update((job,))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "content_key": key[0], "job_id": jobs, "runs": runs})

    return stream.groupBy("content_key").applyInPandasWithState(step, "event_id long, content_key string, job_id long, runs boolean", "job long", "append", GroupStateTimeout.NoTimeout)


def hourly_states(stream: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Submissions by tumbling window and state; rows later than `late` no longer count."""
    at = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", width).alias("w"), "state").agg(F.count("*").alias("jobs")).select(F.col("w.start").alias("hour"), "state", "jobs")


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Take all that has arrived, write it to the shared folder and read it back."""
    spark = stream.sparkSession
    out = fresh(spark, label)
    stream.writeStream.outputMode(mode).option("checkpointLocation", fresh(spark, f"{label}-log")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def incremental_qc(spark: SparkSession, arriving: str, reports: str, log: str, report: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Report on newly arrived stitch files, batch by batch; a design's rows arrive in one file. A repeated batch overwrites its own folder."""
    stitches = spark.readStream.schema("design_id long, seq long, cmd string, x_u long, y_u long").parquet(arriving)

    def on_batch(batch: DataFrame, number: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{reports}/batch={number}")

    return stitches.writeStream.foreachBatch(on_batch).option("checkpointLocation", log).trigger(availableNow=True).start()
