"""The capped log and its consumers: nothing is lost or repeated over replays, deaths and restarts."""

import pytest

from millrace.streaming.entries import Consumer, EntryLog


def rows(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string").coalesce(1)


def payloads(df):
    return [r.payload for r in df.orderBy("version", "seq").collect()]


def test_cap_and_replay(spark, tmp_path):
    log = EntryLog(spark, f"{tmp_path}/log", most=4)
    for i, texts in enumerate([("a", "b"), ("c",), ("d", "e"), (), ("f", "g", "h")]):
        log.append(rows(spark, *texts), i)
        log.append(rows(spark, "again"), i)
    assert payloads(log.entries()) == ["d", "e", "f", "g", "h"] and log.floor() == 2
    assert [r.payload for r in log.tail(2).collect()] == ["h", "g"]
    whole = EntryLog(spark, f"{tmp_path}/whole")
    whole.append(rows(spark, *"xyz"), 0)
    assert payloads(whole.entries()) == ["x", "y", "z"] and whole.floor() == 0


def test_consumers(spark, tmp_path):
    log, seen = EntryLog(spark, f"{tmp_path}/log"), []
    log.append(rows(spark, "old"), 0)
    at_tail, at_head = Consumer(log, f"{tmp_path}/c1"), Consumer(log, f"{tmp_path}/c2", at_tail=False)
    log.append(rows(spark, "one", "two"), 1)

    def dying(_):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        at_tail.poll(dying)
    log.append(rows(spark, "three"), 2)
    again = Consumer(log, f"{tmp_path}/c1")  # a restart: its cursor stands
    again.poll(lambda df: seen.append(payloads(df)))
    again.poll(lambda df: seen.append(payloads(df)))
    assert seen == [["one", "two", "three"]]
    first = []
    at_head.poll(lambda df: first.extend(payloads(df)))
    assert first == ["old", "one", "two", "three"]


def test_streams(spark, tmp_path):
    """Files in, a log, and a consumer that follows its commits."""
    log, got = EntryLog(spark, f"{tmp_path}/log"), []
    consumer = Consumer(log, f"{tmp_path}/cursor")
    for i in range(3):
        rows(spark, f"r{i}", f"s{i}").write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("payload string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second start has nothing to do
        assert log.start(stream, f"{tmp_path}/ck1").awaitTermination(300)
        assert consumer.start(lambda df: got.extend(payloads(df)), f"{tmp_path}/ck2").awaitTermination(300)
    assert sorted(got) == ["r0", "r1", "r2", "s0", "s1", "s2"] == sorted(payloads(log.entries()))
