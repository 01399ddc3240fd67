"""Alerts of two units paired one to one (UI-7)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def incidents(alerts: DataFrame, seconds: int = 30) -> DataFrame:
    """alerts(alert_id, ts, unit: 'reactor' or 'column') as incidents: (reactor_id, column_id, first_id), one of the two null for a single alert.

    The newest alert comes first, then the lesser id. Each alert in turn takes the first later one of
    the other unit that is free and within the seconds; ``first_id`` is the one that took. Alerts with
    gaps of more than ``seconds`` between them share no session. In a session the waiting alerts are
    always of one unit, so one queue is all that is held: an alert takes the place of the first that waits for it,
    and what has waited longer than the seconds stays single. A session is sorted in one task and goes through
    it batch by batch. A null time takes no part.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = alerts.where("ts is not null").select("alert_id", us.alias("us"), (F.col("unit") == "reactor").alias("reactor"))
    # sessions: a bucket's first alert looks back into the bucket of an earlier alert, so no window spans the table
    wide = rows.withColumn("bucket", F.floor(F.col("us") / (seconds * 1_000_000)))
    per = wide.groupBy("bucket").agg(F.min("us").alias("oldest"), F.max("us").alias("newest"))
    later = per.select((F.col("bucket") - 1).alias("bucket"), F.col("oldest").alias("later"))
    # a bucket goes on with the next one if their nearest alerts are close; a bucket is never longer than the gap
    linked = per.join(later, "bucket", "left").withColumn("breaks", F.coalesce((F.col("later") - F.col("newest") > seconds * 1_000_000).cast("int"), F.lit(1)))
    total = F.sum("breaks").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sessions = linked.select("bucket", total.alias("session"))
    ordered = wide.join(sessions, "bucket").select("session", "alert_id", "us", "reactor").repartition("session").sortWithinPartitions("session", F.desc("us"), "alert_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting = None, deque()  # (alert_id, us, reactor) of one unit, the newest first
        single = lambda w: (w[0], None, w[0]) if w[2] else (None, w[0], w[0])
        for frame in frames:
            out = []
            for session, alert, us, reactor in zip(*(frame[c].tolist() for c in ("session", "alert_id", "us", "reactor")), strict=True):
                while waiting and (session != now or waiting[0][1] - us > seconds * 1_000_000):
                    out.append(single(waiting.popleft()))
                now = session
                if waiting and waiting[0][2] != reactor:
                    first = waiting.popleft()[0]
                    out.append((alert, first, first) if reactor else (first, alert, first))
                else:
                    waiting.append((alert, us, reactor))
            yield pd.DataFrame(out, columns=names, dtype=object)
        yield pd.DataFrame([single(w) for w in waiting], columns=names, dtype=object)

    names, kind = ["reactor_id", "column_id", "first_id"], alerts.schema["alert_id"].dataType
    return ordered.mapInPandas(run, StructType([StructField(n, kind) for n in names]))
