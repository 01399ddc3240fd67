"""Historian reads and projections (SRC-1..4, PRJ-1, PRJ-2, PRJ-14, WIN-1, WIN-3, JN-12, JN-13, SNK-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_stream(entries: DataFrame) -> DataFrame:
    """Typed samples of string entries (tag_id, timestamp, value, unit, status, ingested): rows without a
    tag go; a bad number is a null value; a bad time is the time of arrival."""
    ts = F.coalesce(F.try_to_timestamp("timestamp"), F.timestamp_seconds(F.expr("try_cast(timestamp AS double)")), F.col("ingested").cast("timestamp"))
    return entries.where(F.coalesce("tag_id", F.lit("")) != "").select(ts.alias("ts"), "tag_id", F.expr("try_cast(value AS double)").alias("value"), F.coalesce("status", F.lit("GOOD")).alias("quality"), F.coalesce("unit", F.lit("")).alias("unit"))


def published(value: Column) -> Column:
    """struct(value, status) as sent: four decimals; what is not finite is 0.0 and BAD."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.struct(F.when(finite, F.round(value, 4)).otherwise(0.0).alias("value"), F.when(finite, "GOOD").otherwise("BAD").alias("status"))


def window(telemetry: DataFrame, tags: list[str], start: str, end: str, limit: int | None = None) -> DataFrame:
    """Samples of the tags from start to end, both included, in the order of time and tag."""
    rows = telemetry.where(F.col("tag_id").isin(*tags) & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return rows if limit is None else rows.orderBy("ts", "tag_id", "value").limit(limit)


def latest(telemetry: DataFrame) -> DataFrame:
    """The newest sample of each tag: one aggregate with partial maxima, no sort."""
    best = F.max(F.struct("ts", "value", "quality", "unit")).alias("m")
    return telemetry.groupBy("tag_id").agg(best).select("tag_id", "m.ts", "m.value", "m.quality", "m.unit")


def distinct_tags(telemetry: DataFrame, now: str, minutes: int = 1440) -> DataFrame:
    return telemetry.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")).select("tag_id").distinct()


def around(telemetry: DataFrame, moments: DataFrame, before_s: int = 600, after_s: int = 120) -> DataFrame:
    """Samples within before_s and after_s of each moment(episode_id, tag_id, onset).

    The interval join is an equi-join on tag and time bucket: a moment is put into each bucket that
    its window touches, so no pair outside neighbouring buckets is formed.
    """
    width = before_s + after_s
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    buckets = F.sequence(F.floor((seconds("onset") - before_s) / width), F.floor((seconds("onset") + after_s) / width))
    wide = moments.select("episode_id", "tag_id", "onset", F.explode(buckets).alias("bucket"))
    rows = telemetry.withColumn("bucket", F.floor(seconds("ts") / width))
    inside = (F.col("ts") >= F.col("onset") - F.expr(f"INTERVAL {before_s} SECONDS")) & (F.col("ts") <= F.col("onset") + F.expr(f"INTERVAL {after_s} SECONDS"))
    return rows.join(wide, ["tag_id", "bucket"]).where(inside).select("episode_id", "tag_id", "onset", "ts", "value")


def rate_of_change(telemetry: DataFrame) -> DataFrame:
    """Each sample with its change per second since the tag's sample before."""
    order = Window.partitionBy("tag_id").orderBy("ts", "value")
    gap = F.expr("(unix_micros(cast(ts AS timestamp)) - unix_micros(cast(ts0 AS timestamp))) / 1e6")
    rows = telemetry.withColumns({"ts0": F.lag("ts").over(order), "value0": F.lag("value").over(order)})
    return rows.withColumn("rate", F.when(gap > 0, (F.col("value") - F.col("value0")) / gap)).drop("ts0", "value0")


def retained(telemetry: DataFrame, now: str, days: int = 90) -> DataFrame:
    return telemetry.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
