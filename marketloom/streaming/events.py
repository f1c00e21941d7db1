"""Streams of events: hourly counts with late data, and the health of sources as a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators.lifecycle import DEGRADED_AFTER

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATENESS = "1 hour"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parq[u]et*")


def hourly(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events per hour and type; an hour is complete when the watermark has passed it."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 days", step: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", length, step))
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """A user's events with less than ``gap`` between them; a session is given once, when the watermark has passed its end."""
    w = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fan_in(streams: list[DataFrame]) -> DataFrame:
    """One stream of the sources' own, which each keep their place in the checkpoint."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def health(events: DataFrame) -> DataFrame:
    """Running consecutive failures of each source, one update a micro-batch, as a fold over its attempts in order of time.

    The state is three numbers a source; attempts of a micro-batch are folded in order, whatever files they came in.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, total, degraded = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            total += 1
            failures = 0 if ok else failures + 1
            degraded = None if ok else ts.to_pydatetime() if failures == DEGRADED_AFTER else degraded
        state.update((failures, total, degraded))
        yield pd.DataFrame({"source": [key[0]], "consecutive_failures": [failures], "total_cycles": [total], "degraded_since": [degraded]}).astype({"degraded_since": "datetime64[ns]"})

    a = events.select((F.col("user_id") % 30).alias("source"), "ts", "event_id", (~F.col("event_type").isin("error", "click")).alias("ok"))
    return a.groupBy("source").applyInPandasWithState(
        fold, "source long, consecutive_failures long, total_cycles long, degraded_since timestamp", "failures long, total long, degraded timestamp", "update", "NoTimeout"
    )


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, into a table in the shared folder, and returns that table.

    foreachBatch writes each micro-batch under its number, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    place = shared_folder(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{place}/out/n={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{place}/out/n=*")


def latest_updates(table: DataFrame, key: str) -> DataFrame:
    """The last micro-batch's row of each key of an update-mode table."""
    cols = [c for c in table.columns if c not in (key, "batch")]
    return table.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in cols])
