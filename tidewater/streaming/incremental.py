"""Structured Streaming forms: windows with watermarks, sessions, deduplication, interval joins, incremental postings, and
a stateful work queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.retrieval import postings
from tidewater.workspace import new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder of Parquet files, a few files per trigger; ``ts`` as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and totals per window and type; state of a window goes once the watermark passes it."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, pause: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", pause).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First of equal keys within the watermark; state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, width: str, late: str = "1 hour") -> DataFrame:
    """Pairs of a key with the right event at most ``width`` after the left one; both sides' state is bounded."""
    a = left.select(F.col(key).alias("k1"), F.col("event_id").alias("left_id"), F.col("ts").alias("t1")).withWatermark("t1", late)
    b = right.select(F.col(key).alias("k2"), F.col("event_id").alias("right_id"), F.col("ts").alias("t2")).withWatermark("t2", late)
    return a.join(b, F.expr(f"k1 = k2 and t2 >= t1 and t2 <= t1 + interval {width}")).select("left_id", "right_id")


class IncrementalIndex:
    """Postings kept up to date by micro-batches: each batch's documents replace their earlier postings.

    Batches are appended with their number and idempotent by it; readers take the newest batch of each document.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "postings")

    def apply(self, docs: DataFrame, batch: int) -> None:
        index = postings(docs, "doc_id", "text").withColumn("batch", F.lit(batch).cast("long"))
        index.write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch:09d}")
        docs.select("doc_id", F.lit(batch).cast("long").alias("newest")).distinct().write.mode("overwrite").parquet(f"{self.path}/docs/batch={batch:09d}")

    def start(self, docs: DataFrame):
        return docs.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()

    def current(self) -> DataFrame:
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/postings")
        docs = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/docs").groupBy("doc_id").agg(F.max("newest").alias("newest"))
        return rows.join(docs, "doc_id").where(F.col("batch") == F.col("newest")).select("doc_id", "term", "tf")


QUEUE_OUT = "user_id long, status string, seen long"
QUEUE_STATE = "status string, seen long"


def queue_states(events: DataFrame) -> DataFrame:
    """A work queue as keyed state: signup makes pending, view executing, purchase done, error failed; done stays done."""
    to = {"signup": "pending", "view": "executing", "purchase": "done", "error": "failed"}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, seen = state.get if state.exists else ("new", 0)
        rows = pd.concat(list(parts)).sort_values("event_id")
        for kind in rows["event_type"]:
            status = status if status == "done" else to.get(kind, status)
            seen += 1
        state.update((status, seen))
        yield pd.DataFrame([[key[0], status, seen]], columns=["user_id", "status", "seen"])

    return events.groupBy("user_id").applyInPandasWithState(step, QUEUE_OUT, QUEUE_STATE, "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it put out."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", new_path(spark, f"stream-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
