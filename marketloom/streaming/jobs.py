"""Streaming jobs: bounded ingestion of landed files, duplicate suppression, windows with late data, listing states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.operators.sinks import write_new


def landed(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1_000) -> DataFrame:
    """JSON lines as they land. Which files are done is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def ingest(rows: DataFrame, path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Appends new keys of all that has landed, then stops. A batch that runs twice appends once."""
    return (
        rows.writeStream.foreachBatch(lambda batch, _: write_new(batch, path, key))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(events: DataFrame, key: list[str], ts: str = "ts", within: str = "300 seconds") -> DataFrame:
    """Events whose key has not come within the time before; the state is as long as the watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Counts and sums by window and event type; events later than the watermark are left out."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    grouped = events.withWatermark(ts, late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy("user_id", F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


STATE = "status string, misses int, last_run int"
OUT = "source_website string, source_listing_id string, status string, misses int, last_run int"


def lifecycle(sightings: DataFrame, allowed: int = 2) -> DataFrame:
    """States of listings over a stream of (key, run_id, seen, healthy).

    Each key's rows are taken in order of run; a run that was handled is not handled again. One key holds three values.
    """

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, misses, last = state.get if state.exists else (None, 0, -1)
        rows = pd.concat(list(parts)).sort_values("run_id")
        for run, seen, healthy in zip(rows.run_id, rows.seen, rows.healthy, strict=True):
            if run <= last:
                continue
            last = int(run)
            if seen:
                status, misses = "ACTIVE", 0
            elif status is not None and healthy:
                misses += 1
                status = "INACTIVE" if misses >= max(1, allowed) else "POSSIBLY_INACTIVE"
        state.update((status, int(misses), last))
        if status is not None:
            yield pd.DataFrame([(*key, status, int(misses), last)], columns=["source_website", "source_listing_id", "status", "misses", "last_run"])

    return sightings.groupBy("source_website", "source_listing_id").applyInPandasWithState(advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
