"""Structured Streaming: progressive ingestion, event-time windows, job states."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gneiss.runtime import checkpoint_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream of a Parquet table's files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into the shared folder and return the result."""
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def windowed(events: DataFrame, at: str, by: list[str], length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of ``value`` by event-time window; rows later than ``late`` are dropped."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], files: str) -> None:
    """Hand every micro-batch once to ``sink``; ``files`` keeps the progress, so a restart resumes
    after the last finished batch."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", files).trigger(availableNow=True).start()
    q.awaitTermination()


_RANK = {"reserved": 0, "queued": 0, "running": 1, "failed": 2, "cancelled": 2, "completed": 3}


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of every job ``(job, status, at)``: a later event wins, at equal times the
    further status; finished jobs do not go back. Emits every change."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, at, changes = state.get if state.exists else ("", 0, 0)
        for pdf in batches:
            rows = sorted(zip(pdf["at"], pdf["status"].fillna("")), key=lambda r: (r[0], _RANK.get(r[1], -1)))
            for t, s in rows:
                if (t, _RANK.get(s, -1)) > (at, _RANK.get(status, -1)) and status != "completed":
                    changes += s != status
                    status, at = s, int(t)
        state.update((status, int(at), int(changes)))
        yield pd.DataFrame([(key[0], status, int(at), int(changes))], columns=["job", "status", "at", "changes"])

    return events.groupBy("job").applyInPandasWithState(step, "job string, status string, at long, changes long", "status string, at long, changes long", "update", GroupStateTimeout.NoTimeout)
