"""Structured Streaming over event files: windows, sessions, rate caps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet") -> DataFrame:
    """A stream of event files; times become instants, as watermarks need."""
    source = spark.readStream.format("parquet").schema(EVENTS).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and values per window and type, closed by a watermark."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def _minute(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The window of a minute starts at the first request after the last one ended."""
    begun, used = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    allowed = []
    for t in rows["ts"]:
        now = t.timestamp()
        if begun is None or now - begun >= 60:
            begun, used = now, 0
        used += 1
        allowed.append(used <= 60)
    state.update((begun, used))
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})


def rate_cap(events: DataFrame) -> DataFrame:
    """(user_id, event_id, allowed): at most 60 events in a minute that starts with a user's first event."""
    return events.groupBy("user_id").applyInPandasWithState(_minute, "user_id long, event_id long, allowed boolean", "begun double, used long", "append", "NoTimeout")


def _health(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Three failures in a row or a cooldown make a key unhealthy: 5 minutes after a rate error, else 2 minutes a failure, at most 30."""
    streak, until = state.get if state.exists else (0, 0.0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    healthy = []
    for t, kind in zip(rows["ts"], rows["event_type"], strict=True):
        now = t.timestamp()
        healthy.append(streak < 3 and now >= until)
        if kind in ("error", "rate_error"):
            streak += 1
            until = now + 60 * (5 if kind == "rate_error" else min(2 * streak, 30))
        else:
            streak = 0
    state.update((streak, until))
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "healthy": healthy})


def key_health(events: DataFrame) -> DataFrame:
    """(user_id, event_id, healthy): the state of each key just before each of its events."""
    return events.groupBy("user_id").applyInPandasWithState(_health, "user_id long, event_id long, healthy boolean", "streak int, until double", "append", "NoTimeout")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result table.

    Results and the stream's state lie in the shared folder, a folder a batch, so a batch that is run
    again replaces itself and nothing gathers on the driver. In mode complete the last batch is the result.
    """
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    batches: list[int] = []

    def keep(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{top}/out/{number}")
        batches.append(number)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{top}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{top}/out/{n}" for n in wanted])
