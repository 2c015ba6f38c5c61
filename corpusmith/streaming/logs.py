"""Streams of events: rollups and sessions with watermarks, idempotent inboxes, rate limits and change feeds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmith.operators import manifest


def windowed_rollup(events: DataFrame, at: str, keys: list[str], value: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts, sum and greatest value of tumbling windows, once each window is past ``late``; later events are dropped."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("events"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *keys, "events", "total", "most")


def idle_sessions(events: DataFrame, at: str, user: str, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after ``idle``: user, started, ended (the last event and the idle time) and events."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, idle).alias("s"), user)
    return grouped.agg(F.count("*").alias("events")).select(user, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events")


def idempotent(deliveries: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each delivery once: repetitions within ``late`` are dropped, and keys older than that forgotten."""
    return deliveries.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, key: str, at: str, most: int = 60, seconds: int = 600, late: str = "1 hour") -> DataFrame:
    """key, event_id, at and rejected: whether ``most`` accepted or rejected events preceded in the trailing time.

    The state of a key holds at most ``most`` times, as more aren't needed to decide; it is removed
    when no event came for the trailing time. Events count in the order in which batches bring them.
    """
    span = seconds * 1_000_000

    def judge(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for batch in batches:
            batch = batch.sort_values([at, "event_id"])
            out = []
            for event, when in zip(batch["event_id"], batch[at], strict=True):
                now = int(pd.Timestamp(when).value // 1000)
                recent = [t for t in recent if t > now - span]
                out.append((group[0], int(event), when, len(recent) >= most))
                recent = [*recent, now][-most:]
            yield pd.DataFrame(out, columns=[key, "event_id", at, "rejected"])
        state.update((recent,))
        state.setTimeoutTimestamp(max(recent[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    stream = events.withWatermark(at, late).select(key, "event_id", at)
    return stream.groupBy(key).applyInPandasWithState(judge, f"{key} {kind}, event_id long, {at} timestamp, rejected boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def rolling_percentile(events: DataFrame, key: str, at: str, value: str, n: int = 2000, share: float = 0.95, late: str = "1 hour", idle: int = 86_400) -> DataFrame:
    """key, events and p: the nearest-rank percentile of each key's last ``n`` values, after every batch that brings any.

    The state of a key holds ``n`` values at most and goes ``idle`` seconds after its last event.
    """

    def keep(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, values = state.get if state.exists else (0, [])
        values, last = list(values), 0
        for batch in batches:
            batch = batch.dropna(subset=[value]).sort_values([at, value])
            total += len(batch)
            values = (values + batch[value].astype(float).tolist())[-n:]
            last = max(last, *(int(pd.Timestamp(t).value // 1_000_000) for t in batch[at]), 0) if len(batch) else last
        if values:
            yield pd.DataFrame([(group[0], total, sorted(values)[max(0, math.ceil(round(len(values) * share, 9)) - 1)])], columns=[key, "events", "p"])
        state.update((total, values))
        state.setTimeoutTimestamp(max(last + idle * 1000, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    stream = events.withWatermark(at, late).select(key, at, value)
    return stream.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, events long, p double", "total long, values array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def keep_manifest(changes: DataFrame, table: str, keys: list[str], order: str, op: str, checkpoint: str):
    """Keeps a stream of upserts and deletes as parts of a manifest; returns the writer to start.

    Each batch adds the last change by ``order`` of every key it has, deletes included, under its
    own number, so a batch that is run again gives the same part and nothing else is rewritten.
    """

    def add(batch: DataFrame, number: int) -> None:
        last = manifest.newest(batch, keys, [F.col(order).desc_nulls_last(), F.col(op)])
        last.write.mode("overwrite").parquet(f"{table}/part={number}")

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def current_manifest(spark, table: str, keys: list[str], order: str, op: str) -> DataFrame:
    """The manifest that the parts give: of each key the last change over all batches, however late it came; deleted keys don't come out."""
    parts = spark.read.parquet(table).drop("part")
    return manifest.newest(parts, keys, [F.col(order).desc_nulls_last(), F.col(op)]).where(F.col(op) != "delete").drop(op)


def compact_manifest(spark, table: str, target: str, keys: list[str], order: str, op: str) -> None:
    """Writes all parts as one of another folder, with deletes, so that changes that come later still find what is newer."""
    parts = spark.read.parquet(table).drop("part")
    manifest.newest(parts, keys, [F.col(order).desc_nulls_last(), F.col(op)]).write.mode("overwrite").parquet(f"{target}/part=-1")


def watch_folder(spark, folder: str, schema: str, pause: str = "800 milliseconds"):
    """A stream of new JSON files of a folder and the trigger that gathers quick changes: (stream, trigger arguments)."""
    return spark.readStream.schema(schema).json(folder), {"processingTime": pause}
