"""The alarm rule, its batch form against a plain loop, and its streaming form against the batch form."""

import random

from millrace.streaming import watchers


def samples():
    pick = random.Random(4)
    return [(f"T{i % 4}", float(10 * (i // 4)), pick.choice([None, None, "H", "HH", "L"]), pick.random()) for i in range(400)]


def expected(rows):
    fired, states = [], {}
    for tag, ts, level, value in sorted(rows, key=lambda r: (r[1], r[3])):
        states[tag], fire = watchers.advance(states.get(tag), ts, level)
        if fire:
            fired.append((tag, ts, level, value))
    return sorted(fired)


def test_rule():
    state, fire = watchers.advance(None, 0.0, "H")
    assert fire
    state, fire = watchers.advance(state, 1.0, "H")
    assert not fire
    state, fire = watchers.advance(state, 2.0, "HH")
    assert fire
    state, _ = watchers.advance(state, 3.0, None)
    state, _ = watchers.advance(state, 32.0, None)
    assert state is not None
    state, _ = watchers.advance(state, 33.0, None)
    assert state is None


def test_batch(spark):
    rows = samples()
    found = watchers.batch_alerts(spark.createDataFrame(rows, "tag_id string, ts double, level string, value double"))
    assert sorted(map(tuple, found.collect())) == expected(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows, schema = samples(), "tag_id string, ts double, level string, value double"
    for k, part in enumerate((rows[:200], rows[200:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = watchers.stream_alerts(stream).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = sorted(map(tuple, spark.table("fired").collect()))
    assert found == expected(rows)


def test_claims_and_rates(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 1800.0), ("b", 5.0)], "fingerprint string, ts double")
    assert sorted(map(tuple, watchers.once_per(rows, 1800).collect())) == [("a", 0.0), ("a", 1800.0), ("b", 5.0)]
    hits = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("a", 70.0)], "bucket string, ts double")
    assert [r.allowed for r in watchers.rate_limited(hits, 3).orderBy("ts").collect()] == [True, True, True, False, False, True]
