"""Watchers of units with one alarm for each rule, resets, limits that change, and the detector's cooldown (STM-3 to 6, 10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.streaming.watchers import DEBOUNCE_S, once_per

# The rules whose alarm is critical; the others warn.
CRITICAL = ("HH_EXCEEDED", "LL_EXCEEDED", "STATUS_BAD", "RATE_OF_RISE")
DETECTOR_COOLDOWN_S = 300.0
EVENTS = "array<struct<rule:string,value:double,breach:boolean>>"


def severity(rule: Column) -> Column:
    return F.when(rule.isin(*CRITICAL), "critical").otherwise("warning")


def _side(outer: str, inner: str, past: callable) -> Column:
    """Events of one side: the outer limit's breach, else the inner one's, else a clearing of both; a missing limit is none."""
    event = lambda rule, breach: F.struct(F.lit(f"{rule}_EXCEEDED").alias("rule"), F.col("value"), F.lit(breach).alias("breach"))
    beyond = lambda c: F.coalesce(past(F.col("value"), F.col(c)), F.lit(False))
    return F.when(beyond(outer), F.array(event(outer.upper(), True))).when(beyond(inner), F.array(event(inner.upper(), True))).otherwise(F.array(event(outer.upper(), False), event(inner.upper(), False)))


def rule_events(samples: DataFrame) -> DataFrame:
    """What each of samples(tag_id, ts in seconds, value, quality, ll, l, h, hh) says to each rule: (tag_id, ts, rule, value, breach).

    A BAD sample says only that it is bad; an UNCERTAIN one says so and its value counts. A null or NaN value says nothing of limits.
    """
    status = lambda s: F.struct(F.lit(f"STATUS_{s}").alias("rule"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("breach"))
    none = F.array().cast(EVENTS)
    readable = F.col("value").isNotNull() & ~F.isnan("value")
    limits = F.when(readable, F.concat(_side("hh", "h", lambda v, k: v > k), _side("ll", "l", lambda v, k: v < k))).otherwise(none)
    doubtful = F.when(F.col("quality") == "UNCERTAIN", F.array(status("UNCERTAIN"))).otherwise(none)
    said = F.when(F.col("quality") == "BAD", F.array(status("BAD"))).otherwise(F.concat(doubtful, limits))
    return samples.select("tag_id", "ts", F.inline(said)).select("tag_id", "ts", "rule", "value", "breach")


def rise_events(samples: DataFrame, most: float) -> DataFrame:
    """The same for the rate of rise, from each readable sample to the next one that is later; BAD samples are left out."""
    rows = samples.where("value is not null and not isnan(value) and quality <> 'BAD'")
    order = Window.partitionBy("tag_id").orderBy("ts", "value")
    gap, rise = F.col("ts") - F.lag("ts").over(order), F.col("value") - F.lag("value").over(order)
    timed = rows.withColumns({"gap": gap, "rise": rise}).where("gap > 0")
    rate = F.col("rise") / F.col("gap")
    return timed.select("tag_id", "ts", F.lit("RATE_OF_RISE").alias("rule"), rate.alias("value"), (rate > most).alias("breach"))


def rule_alarms(events: DataFrame) -> DataFrame:
    """Alarms of events by windows over each (tag_id, rule, and generation where there is one): (tag_id, rule, opened, last_seen, value, peak).

    A breach opens an alarm if it is the first, or if the rule was clear DEBOUNCE_S or more after the breach before; status
    rules are never clear. The peak is the breach of the largest size while the alarm is open, the earliest of equals.
    """
    key = ["tag_id", "rule", *({"generation"} & set(events.columns))]
    events = events.withColumn("size", F.coalesce(F.abs("value"), F.lit(-1.0)))
    order = Window.partitionBy(*key).orderBy("ts", F.desc("breach"), "size")
    segment = F.sum(F.col("breach").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = F.col("breach")
    by = events.withColumn("segment", segment).where("segment > 0").groupBy(*key, "segment").agg(F.max(F.when(hit, F.col("ts"))).alias("ts"), F.max(F.when(hit, F.col("value"))).alias("value"), F.max(F.when(hit, F.col("size"))).alias("size"), F.max(F.when(~hit, F.col("ts"))).alias("cleared"))
    before = Window.partitionBy(*key).orderBy("segment")
    opens = F.when(F.lag("ts").over(before).isNull(), 1).otherwise(F.coalesce((F.lag("cleared").over(before) - F.lag("ts").over(before) >= DEBOUNCE_S).cast("int"), F.lit(0)))
    alarms = by.withColumn("opens", opens).withColumn("alarm", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shown = alarms.groupBy(*key, "alarm").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_seen"), F.min_by("value", "segment").alias("value"), F.max_by("value", F.struct("size", -F.col("segment"))).alias("peak"))
    return shown.select("tag_id", "rule", "opened", "last_seen", "value", "peak")


def stream_rule_alarms(events: DataFrame) -> DataFrame:
    """The alarms that a stream of events opens: (tag_id, rule, ts, value). A rule's state is its last breach and its last clear sample."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, is_open = state.get if state.exists else (0.0, False)
        for frame in frames:
            rows = []
            ordered = frame.assign(clear=~frame["breach"]).sort_values(["ts", "clear"])
            for ts, value, breach in ordered[["ts", "value", "breach"]].itertuples(index=False):
                if breach:
                    if not is_open:
                        rows.append((*key, ts, value))
                    seen, is_open = ts, True
                elif is_open and ts - seen >= DEBOUNCE_S:
                    is_open = False
            yield pd.DataFrame(rows, columns=["tag_id", "rule", "ts", "value"])
        state.update((seen, is_open))

    return events.groupBy("tag_id", "rule").applyInPandasWithState(run, "tag_id string, rule string, ts double, value double", "seen double, is_open boolean", "append", GroupStateTimeout.NoTimeout)


def with_generation(events: DataFrame, resets: DataFrame, width_s: int = 3600) -> DataFrame:
    """STM-3: events with the number of resets(ts) up to their time; alarms of different generations know nothing of each other.

    Resets are counted by spans of time: one row a span is ordered over the whole table, the rest within its span.
    """
    span = F.floor(F.col("ts") / width_s)
    marks = resets.select("ts").withColumn("reset", F.lit(1))
    both = events.withColumn("reset", F.lit(0)).unionByName(marks, allowMissingColumns=True).withColumn("span", span)
    per_span = both.groupBy("span").agg(F.sum("reset").alias("n"))
    earlier = per_span.select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.sum("reset").over(Window.partitionBy("span").orderBy("ts"))
    counted = both.withColumn("within", within).where("reset = 0").join(earlier, "span")
    return counted.withColumn("generation", F.col("earlier") + F.col("within")).select(*events.columns, "generation")


def with_live_limits(samples: DataFrame, changes: DataFrame) -> DataFrame:
    """STM-4: samples(tag_id, ts, ...) with the limits of the newest of changes(tag_id, ts, ll, l, h, hh) up to their time.

    A change replaces all four limits, missing ones too; samples before a tag's first change are left out, as unknown tags are.
    """
    limits = F.struct("ll", "l", "h", "hh").alias("limits")
    rows = samples.select("tag_id", "ts", F.struct(*(c for c in samples.columns if c not in ("tag_id", "ts"))).alias("sample"))
    both = rows.unionByName(changes.select("tag_id", "ts", limits), allowMissingColumns=True)
    newest = F.last("limits", ignorenulls=True).over(Window.partitionBy("tag_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("newest", newest).where("sample is not null and newest is not null").select("tag_id", "ts", "sample.*", "newest.*")


def detector_events(persistent: DataFrame, cooldown_s: float = DETECTOR_COOLDOWN_S) -> DataFrame:
    """STM-10: persistent anomalies(fingerprint, ts in seconds, ...) that raise an event: none within the cooldown of the last one."""
    return once_per(persistent, cooldown_s)
