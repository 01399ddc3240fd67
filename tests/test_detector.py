"""The control chart against numpy, and the stateful detector against a plain loop."""

import datetime as dt
import random

import numpy as np
import pytest

from millrace.operators import diagnosis
from millrace.streaming import detector

TAGS = [f"T{i}" for i in range(6)]


def nominal(n=200, seed=42):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 2)) @ rng.normal(size=(2, len(TAGS))) + 0.1 * rng.normal(size=(n, len(TAGS))) + 50


@pytest.fixture(scope="module")
def model(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), *map(float, x)) for i, x in enumerate(nominal())]
    rows.append((rows[0][0], None, *rows[0][2:]))  # incomplete: left out
    wide = spark.createDataFrame(rows, "ts timestamp_ntz, " + ", ".join(f"{t} double" for t in TAGS)).repartition(5)
    return diagnosis.fit_detector(wide, TAGS), wide


def test_fit_equals_numpy(model):
    m, _ = model
    x = nominal()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.85) + 1)
    assert m.n == 200 and len(m.eigenvalues) == k and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.std, x.std(axis=0, ddof=1))
    assert np.allclose(m.eigenvalues, values[:k]) and np.isclose(m.variance_explained, values[:k].sum() / values.sum())
    assert np.allclose(np.abs((m.components * vectors[:, :k]).sum(axis=0)), 1)


def test_scores_equal_numpy_and_survive_json(model):
    m, wide = model
    again = diagnosis.DetectorModel.from_json(m.to_json())
    x = nominal()
    z = (x - m.mean) / m.std
    t = z @ m.components
    e = z - t @ m.components.T
    t2, spe, residual = again.statistics(x)
    assert np.allclose(t2, (t**2 / m.eigenvalues).sum(axis=1)) and np.allclose(spe, (e**2).sum(axis=1)) and np.allclose(residual, e**2)
    rows = diagnosis.score_detector(wide.dropna().orderBy("ts"), again).orderBy("ts").collect()
    assert np.allclose([r.t2 for r in rows], t2) and np.allclose([r.spe_ratio for r in rows], spe / m.spe_limit)
    for r, own in zip(rows, e**2, strict=True):
        assert r.lead_tag == TAGS[int(own.argmax())] and np.allclose([r.contributions[t] for t in TAGS], own / own.sum(), atol=1e-4)
        assert r.anomalous == (r.t2_ratio > 1 or r.spe_ratio > 1)
    assert np.mean([r.anomalous for r in rows]) < 0.1
    assert (diagnosis.shares(np.zeros((1, 3))) == 0).all()


def loop(model, entries):
    """The detector of one plant as a loop over seconds: slices, three anomalous in a row, cooldowns, one slot."""
    seconds = {}
    for t, tag, value, level in entries:
        seconds.setdefault(round(t), []).append((t, tag, value, level))
    out, flags, event_free, slot_free, pending = [], [], -1e18, -1e18, None

    def flush(now):
        nonlocal pending, slot_free
        if pending and pending[1] <= now:
            out.append(("episode", *pending))
            slot_free, pending = pending[1] + 300, None

    def arm(now, onset, tag, level):
        nonlocal pending
        flush(now)
        if pending is None and now >= slot_free:
            pending = (onset, onset + 126, tag, level)

    for second in sorted(seconds):
        for t, tag, _, level in sorted((e for e in seconds[second] if e[3]), key=lambda e: (e[0], e[1], e[3])):
            arm(t, t, tag, level)
        values = {}
        for t, tag, value, level in sorted(seconds[second], key=lambda e: (e[0], -(e[2] or 0))):
            if level is None and value is not None:
                values[tag] = value
        if not values:
            continue
        x = np.array([[values.get(t, np.nan) for t in TAGS]])
        t2, spe, residual = model.statistics(x)
        flags = [*flags, (second, t2[0] > model.t2_limit or spe[0] > model.spe_limit)][-3:]
        if second >= event_free and len(flags) == 3 and all(f for _, f in flags):
            event_free, lead = second + 300, TAGS[int(residual[0].argmax())]
            out.append(("event", float(flags[0][0]), float(second), lead, "ML_ANOMALY"))
            arm(second, float(flags[0][0]), lead, "ML_ANOMALY")
    flush(1e18)
    return sorted(out)


def entries(seed):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    base, out = nominal(1500, seed), []
    for s in range(1500):
        if pick.random() < 0.05:
            continue  # a second without readings
        row = base[s] + (8 if pick.random() < 0.02 or (s // 100) % 5 == seed % 5 else 0) * rng.normal(size=len(TAGS))
        for tag, value in zip(TAGS, row.tolist(), strict=True):
            if pick.random() < 0.95:
                out.append((1_700_000_000 + s + pick.uniform(-0.4, 0.4), tag, value, None))
        if pick.random() < 0.01:
            out.append((1_700_000_000 + s + 0.25, pick.choice(TAGS), None, pick.choice(["HH", "LL"])))
    return out


def test_stream_equals_loop(spark, model, tmp_path):
    m, _ = model
    plants = {f"plant{i}": entries(i) for i in range(3)}
    schema = "plant string, ts timestamp, tag_id string, value double, level string"
    at = lambda t: dt.datetime.fromtimestamp(round(t * 1e6) / 1e6, dt.UTC)
    every = sorted((t, p, tag, value, level) for p, own in plants.items() for t, tag, value, level in [(round(e[0] * 1e6) / 1e6, *e[1:]) for e in own] for _ in [0])
    plants = {p: [(t, tag, value, level) for t, q, tag, value, level in every if q == p] for p in plants}
    size = len(every) // 4 + 1
    parts = [every[i : i + size] for i in range(0, len(every), size)]
    end = every[-1][0] + 10_000
    parts += [[(end, p, "none", 1.0, None) for p in plants], [(end + 1000, p, "none", 1.0, None) for p in plants]]
    parts[2] = [*parts[2], (every[0][0] - 5000, "plant0", "T0", None, "HH")]  # far too late: dropped
    for i, part in enumerate(parts):
        spark.createDataFrame([(p, at(t), tag, value, level) for t, p, tag, value, level in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", detector.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        writer = detector.online_detector(stream, m).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
        assert writer.trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    for plant, own in plants.items():
        wanted = loop(m, own)
        got = sorted((r.kind, r.onset, r.at, r.tag_id, r.level) for r in found if r.plant == plant)
        assert len(wanted) > 3 and [(*map(str, g[:1]), *np.round(g[1:3], 3), *g[3:]) for g in got] == [(*map(str, w[:1]), *np.round(w[1:3], 3), *w[3:]) for w in wanted]
    assert all(max(r.t2_ratio, r.spe_ratio) > 1 and set(r.contributions) == set(TAGS) for r in found if r.kind == "event")
