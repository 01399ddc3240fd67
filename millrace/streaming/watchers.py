"""Stateful alarms on event time, in batch and streaming form (STM-1..11, STM-17, STM-18)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

DEBOUNCE_S, RATE_WINDOW_S = 30.0, 60.0
ALERTS = "tag_id string, ts double, level string, value double"
STATE = "level string, cleared double"


def advance(state: tuple[str, float | None] | None, ts: float, level: str | None) -> tuple[tuple[str, float | None] | None, bool]:
    """The state of a tag's alarm after a sample, and whether it fires.

    An alarm fires when it opens and when its level changes. It re-arms with the first sample inside
    the limits that comes DEBOUNCE_S or more after the first one inside; a breach in between starts anew.
    """
    if level is not None:
        return (level, None), state is None or state[0] != level
    if state is None:
        return None, False
    if state[1] is None:
        return (state[0], ts), False
    return (None, False) if ts - state[1] >= DEBOUNCE_S else (state, False)


def _alerts(frame: pd.DataFrame, state: tuple[str, float | None] | None) -> tuple[list[tuple], tuple[str, float | None] | None]:
    fired = []
    for tag, ts, level, value in frame.sort_values(["ts", "value"])[["tag_id", "ts", "level", "value"]].itertuples(index=False):
        level = level if isinstance(level, str) else None
        state, fire = advance(state, ts, level)
        if fire:
            fired.append((tag, ts, level, value))
    return fired, state


def batch_alerts(samples: DataFrame) -> DataFrame:
    """Alerts of samples(tag_id, ts in seconds, level or null, value), by windows over each tag.

    A breach and the samples inside the limits that follow it are one segment. A breach fires if it is the
    tag's first, has another level than the breach before, or if that one's segment spent DEBOUNCE_S
    inside, from its first sample inside to its last, so that the alarm was re-armed.
    """
    return _breaches(samples).where("fires").select("tag_id", "ts", "level", "value")


def _breaches(samples: DataFrame) -> DataFrame:
    """Each breach with its number and whether it fires."""
    order = Window.partitionBy("tag_id").orderBy("ts", "value")
    segment = F.count("level").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    breach, inside = F.col("level").isNotNull(), F.when(F.col("level").isNull(), F.col("ts"))
    only = lambda c: F.max(F.when(breach, F.col(c))).alias(c)
    segments = samples.withColumn("segment", segment).where("segment > 0").groupBy("tag_id", "segment").agg(only("ts"), only("level"), only("value"), (F.max(inside) - F.min(inside)).alias("spent"))
    before = Window.partitionBy("tag_id").orderBy("segment")
    last, spent = F.lag("level").over(before), F.lag("spent").over(before)
    return segments.withColumn("fires", last.isNull() | (last != F.col("level")) | F.coalesce(spent >= DEBOUNCE_S, F.lit(False)))


def alarm_peaks(samples: DataFrame) -> DataFrame:
    """STM-2: the alarms of ``batch_alerts`` with the furthest value while each was open and when it was last breached.

    Actuators (tags ``MV.``) are no process variables and never alarm. A breach belongs to the alarm that fired last.
    """
    alarm = F.sum(F.col("fires").cast("int")).over(Window.partitionBy("tag_id").orderBy("segment"))
    rows = _breaches(samples.where(~F.startswith("tag_id", F.lit("MV.")))).withColumn("alarm", alarm)
    high = F.col("level").isin("HH", "H")
    by = rows.groupBy("tag_id", "alarm", "level").agg(F.min("ts").alias("ts"), F.min_by("value", "segment").alias("value"), F.max("value").alias("most"), F.min("value").alias("least"), F.max("ts").alias("last_seen"))
    return by.select("tag_id", "ts", "level", "value", F.when(high, F.col("most")).otherwise(F.col("least")).alias("peak"), "last_seen")


def stream_alerts(samples: DataFrame) -> DataFrame:
    """The same over a stream; the state of a tag is its open level and when it first came back inside."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = None
        if state.exists:
            level, cleared = state.get
            now = (level, cleared)
        for frame in frames:
            fired, now = _alerts(frame, now)
            yield pd.DataFrame(fired, columns=["tag_id", "ts", "level", "value"])
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update(now)

    return samples.groupBy("tag_id").applyInPandasWithState(run, ALERTS, STATE, "append", GroupStateTimeout.NoTimeout)


def _scanned(rows: DataFrame, key: str, step: Callable) -> DataFrame:
    """Rows(key, ts, ...) with ``says``: what step(state, ts) = (state, says) makes of each, in order of time; a key's first state is null.

    A key's rows are sorted in one task and go through it batch by batch, with one state at a time and no frame for each key.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in frames:
            says = []
            for k, ts in zip(frame[key].astype(object).where(frame[key].notna(), None), frame["ts"].tolist(), strict=True):
                if k != now:
                    now, state = k, None
                state, said = step(state, ts)
                says.append(said)
            yield frame.assign(says=says)

    ordered = rows.repartition(key).sortWithinPartitions(F.col(key), F.col("ts").asc_nulls_last())
    return ordered.mapInPandas(run, StructType([*rows.schema.fields, StructField("says", BooleanType())]))


def once_per(alerts: DataFrame, ttl_s: float) -> DataFrame:
    """Alerts(fingerprint, ts) that open a claim: the first, and those ttl_s or more after the last that did."""

    def step(last: float | None, ts: float) -> tuple[float, bool]:
        opens = last is None or ts - last >= ttl_s
        return (ts if opens else last), opens

    return _scanned(alerts, "fingerprint", step).where("says").drop("says")


def stream_once_per(alerts: DataFrame, ttl: str) -> DataFrame:
    """The streaming form: duplicates of a fingerprint within the watermark are dropped."""
    return alerts.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["fingerprint"])


def slices(samples: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """One map of tag to its last value (the least of several at one time) for each window of event time."""
    marked = samples.withWatermark("ts", late) if samples.isStreaming else samples
    newest = F.max_by("value", F.struct("ts", -F.col("value"))).alias("value")
    by = marked.groupBy(F.window("ts", width), "tag_id").agg(newest).groupBy("window").agg(F.map_from_entries(F.collect_list(F.struct("tag_id", "value"))).alias("values"))
    return by.select(F.col("window.start").alias("ts"), "values")


def armed_episodes(alarms: DataFrame, wait_s: float = 126.0, cooldown_s: float = 300.0) -> DataFrame:
    """Alarms(slot, ts) that arm an episode: one slot at a time, swallowed while one waits or cools down.

    The rule is sequential within a slot. A plant's slot sees alarms only, never samples.
    """

    def step(free: float | None, ts: float) -> tuple[float, bool]:
        arms = free is None or ts >= free
        return (ts + wait_s + cooldown_s if arms else free), arms

    return _scanned(alarms, "slot", step).where("says").drop("says")


def rate_limited(hits: DataFrame, limit: int, window_s: float = RATE_WINDOW_S) -> DataFrame:
    """hits(bucket, ts) with allowed: windows start at a bucket's first hit after the last window."""

    def step(state: tuple[float, int] | None, ts: float) -> tuple[tuple[float, int], bool]:
        start, n = (ts, 0) if state is None or ts - state[0] >= window_s else state
        return (start, n + 1), n < limit

    return _scanned(hits.select("bucket", "ts"), "bucket", step).withColumnRenamed("says", "allowed")
