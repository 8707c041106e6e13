"""Structured Streaming over an event log (an extension): windows, sessions, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.runtime import place

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, directory: str) -> DataFrame:
    """The event files of a folder as a stream; new files are read as they come."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(directory)


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and totals by window and type; rows later than ``late`` are dropped, which bounds the state."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Events by user and session, which ends after ``gap`` without an event."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, kind, n = state.get if state.exists else (-1, "", 0)
    for pdf in batches:
        n += len(pdf)
        top = pdf.loc[pdf["event_id"].idxmax()]
        if top["event_id"] > last:
            last, kind = int(top["event_id"]), str(top["event_type"])
    state.update((last, kind, n))
    yield pd.DataFrame({"user_id": [key[0]], "last_id": [last], "last_event": [kind], "events": [n]})


def latest_state(events: DataFrame) -> DataFrame:
    """The fold of an append-only log: the last event of each user, whatever the order of arrival."""
    return events.groupBy("user_id").applyInPandasWithState(_fold, "user_id long, last_id long, last_event string, events long", "last long, kind string, n long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its output; each batch goes to the shared folder.

    In ``append`` mode a window comes out once the watermark has passed it, so
    those that are still open at the end of the input, and rows that came too
    late, are missing; that is the mode for a stream that goes on.  In
    ``complete`` mode every window of the input comes out, the open ones
    included, and the last batch holds them all.  In ``update`` mode the last
    batch that names a key holds its state.
    """
    spark = stream.sparkSession
    base = place(spark, "stream")
    write = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{base}/out/batch_no={i}")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long").add("batch_no", "long")).parquet(f"{base}/out").drop("batch_no")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == F.lit(last))
    return out.drop("batch")
