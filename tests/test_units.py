"""Rule alarms: batch by windows and stream by state, both against a plain loop."""

import random

from pyspark.sql import functions as F

from millrace.streaming import units

EVENTS = "tag_id string, rule string, ts double, value double, breach boolean"


def events():
    pick = random.Random(7)
    return [(f"T{i % 3}", pick.choice(["HH_EXCEEDED", "L_EXCEEDED"]), float(9 * (i // 3)), pick.uniform(-5, 5), pick.random() < 0.4) for i in range(600)]


def opened(rows):
    out, state = [], {}
    for tag, rule, ts, value, breach in sorted(rows, key=lambda r: (r[2], not r[4])):
        seen, is_open = state.get((tag, rule), (0.0, False))
        if breach:
            if not is_open:
                out.append([tag, rule, ts, value, value])
            else:
                last = next(a for a in reversed(out) if a[:2] == [tag, rule])
                last[4] = value if abs(value) > abs(last[4]) else last[4]
            state[tag, rule] = ts, True
        elif is_open and ts - seen >= 30:
            state[tag, rule] = seen, False
    return sorted(map(tuple, out))


def test_batch(spark):
    found = units.rule_alarms(spark.createDataFrame(events(), EVENTS)).select("tag_id", "rule", "opened", "value", "peak")
    assert sorted(map(tuple, found.collect())) == opened(events())


def test_stream(spark, tmp_path):
    rows = events()
    for k, part in enumerate((rows[:300], rows[300:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = units.stream_rule_alarms(stream).writeStream.format("memory").queryName("rules").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rules").collect())) == sorted(r[:4] for r in opened(rows))


def test_samples_without_values(spark):
    limits = [5.0, None, None, 9.0]
    rows = [("a", 0.0, 10.0, "GOOD", *limits), ("a", 1.0, None, "UNCERTAIN", *limits), ("a", 2.0, float("nan"), "GOOD", *limits), ("a", 3.0, 10.0, "BAD", *limits)]
    found = units.rule_events(spark.createDataFrame(rows, "tag_id string, ts double, value double, quality string, ll double, l double, h double, hh double"))
    assert sorted((r.ts, r.rule, r.breach) for r in found.collect()) == [(0.0, "HH_EXCEEDED", True), (0.0, "LL_EXCEEDED", False), (0.0, "L_EXCEEDED", False), (1.0, "STATUS_UNCERTAIN", True), (3.0, "STATUS_BAD", True)]
    severities = spark.createDataFrame([("HH_EXCEEDED",), ("H_EXCEEDED",)], "rule string").select(units.severity(F.col("rule")).alias("s"))
    assert [r.s for r in severities.collect()] == ["critical", "warning"]
