"""The online detector as one stateful stream: slices, scores, persistence, cooldown and the armed slot (STM-9, STM-10, STM-11)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.diagnosis import DetectorModel, shares

# Seconds after an event without another, after a breach until its episode is read, and after an episode.
PERSISTENCE, COOLDOWN_S, AFTER_S, MARGIN_S = 3, 300.0, 120.0, 6.0
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = "plant string, kind string, onset double, at double, tag_id string, level string, t2_ratio double, spe_ratio double, contributions map<string,double>"
_SLOT = "recent array<double>, flags array<boolean>, event_free double, slot_free double, done bigint, onset double, ready double, tag_id string, level string"
_NO_TIME = -1e18


class _Slot:
    """The detector's state of a plant, and what follows from each slice and alarm in order of event time."""

    def __init__(self, values: tuple | None):
        recent, flags, self.event_free, self.slot_free, self.done, self.onset, self.ready, self.tag, self.level = values or ([], [], _NO_TIME, _NO_TIME, -(1 << 62), None, None, None, None)
        self.recent, self.flags, self.out = list(recent), list(flags), []

    def values(self) -> tuple:
        return self.recent, self.flags, self.event_free, self.slot_free, self.done, self.onset, self.ready, self.tag, self.level

    def flush(self, now: float) -> None:
        """Give the armed episode out if its reaction has been recorded by ``now``."""
        if self.ready is not None and self.ready <= now:
            self.out.append(("episode", self.onset, self.ready, self.tag, self.level, None, None, None))
            self.slot_free, self.ready = self.ready + COOLDOWN_S, None

    def arm(self, now: float, onset: float, tag: str, level: str) -> None:
        self.flush(now)
        if self.ready is None and now >= self.slot_free:
            self.onset, self.ready, self.tag, self.level = onset, onset + AFTER_S + MARGIN_S, tag, level

    def slice(self, at: float, t2_ratio: float, spe_ratio: float, tag: str, parts: dict[str, float]) -> None:
        self.recent = [*self.recent, at][-PERSISTENCE:]
        self.flags = [*self.flags, bool(t2_ratio > 1 or spe_ratio > 1)][-PERSISTENCE:]
        if at >= self.event_free and len(self.flags) == PERSISTENCE and all(self.flags):
            self.event_free = at + COOLDOWN_S
            self.out.append(("event", self.recent[0], at, tag, "ML_ANOMALY", round(t2_ratio, 2), round(spe_ratio, 2), parts))
            self.arm(at, self.recent[0], tag, "ML_ANOMALY")


class _Detector(StatefulProcessor):
    def __init__(self, model: DetectorModel):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second bigint", "body string")
        self.slot = handle.getValueState("slot", _SLOT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slot = _Slot(self.slot.get() if self.slot.exists() else None)
        fresh: dict[int, list] = {}
        for frame in rows:
            for t, tag, value, level in zip(frame["epoch"].tolist(), frame["tag_id"], frame["value"], frame["level"], strict=True):
                second = round(t)
                if second > slot.done and isinstance(tag, str):
                    fresh.setdefault(second, []).append([t, tag, float(value) if value is not None and np.isfinite(value) else None, level if isinstance(level, str) else None])
        for second, entries in fresh.items():
            old = json.loads(self.waiting.getValue((second,))[0]) if self.waiting.containsKey((second,)) else []
            self.waiting.updateValue((second,), (json.dumps(old + entries),))
        if fresh:
            self._wake(min(fresh) * 1000 + 500)
        yield pd.DataFrame()

    def _wake(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            if timer <= ms:
                return
        self.handle.registerTimer(int(ms))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All seconds that the watermark has passed, in order; the next timer is for the first that it has not."""
        now = timerValues.getCurrentWatermarkInMs()
        slot = _Slot(self.slot.get() if self.slot.exists() else None)
        seconds = sorted(k[0] for k in self.waiting.keys())  # noqa: SIM118 a state, not a dict
        due = [s for s in seconds if s * 1000 + 500 <= now]
        bodies = [json.loads(self.waiting.getValue((s,))[0]) for s in due]
        x = np.full((len(due), len(self.model.tags)), np.nan)
        place = {t: i for i, t in enumerate(self.model.tags)}
        for row, body in zip(x, bodies, strict=True):
            for _, tag, value, level in sorted(body, key=lambda e: (e[0], -(e[2] or 0.0))):  # the last reading of a tag, the least of several at one time
                if level is None and value is not None and tag in place:
                    row[place[tag]] = value
        t2, spe, residual = self.model.statistics(x)
        t2_ratio, spe_ratio = self.model.ratios(t2, spe)
        parts = shares(residual)
        for i, (second, body) in enumerate(zip(due, bodies, strict=True)):
            for t, tag, _, level in sorted((e for e in body if e[3] is not None), key=lambda e: (e[0], e[1], e[3])):
                slot.arm(t, t, tag, level)
            if any(level is None and value is not None for _, _, value, level in body):
                lead = self.model.tags[int(residual[i].argmax())]
                slot.slice(float(second), float(t2_ratio[i]), float(spe_ratio[i]), lead, dict(zip(self.model.tags, parts[i].tolist(), strict=True)))
            slot.done = second
            self.waiting.removeKey((second,))
        # the rest of what is waiting lies later, so an episode that is ready by the watermark is complete
        slot.flush(now / 1000)
        later = [s * 1000 + 500 for s in seconds[len(due) :]] + ([int(slot.ready * 1000)] if slot.ready is not None else [])
        if later:
            self._wake(max(min(later), now + 1))
        self.slot.update(slot.values())
        if slot.out:
            kind, onset, at, tag, level, a, b, c = zip(*slot.out, strict=True)
            yield pd.DataFrame({"plant": key[0], "kind": kind, "onset": onset, "at": at, "tag_id": tag, "level": level, "t2_ratio": a, "spe_ratio": b, "contributions": c})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def online_detector(entries: DataFrame, model: DetectorModel, late: str = "10 seconds") -> DataFrame:
    """Events and episodes of a stream of entries(plant, ts timestamp, tag_id, value, level): one state for each plant.

    An entry without a level is a reading, one with a level an alarm of that tag. Readings of one rounded
    second are a slice (missing tags count as the mean, of a tag's several readings the last holds);
    it is scored when the watermark has passed it. PERSISTENCE anomalous slices in a row raise an
    event (kind 'event', its onset the first of them) unless one was raised within COOLDOWN_S; seconds
    without readings are no slices. An event, or an alarm, arms the plant's one slot, if that is free;
    AFTER_S + MARGIN_S after the onset a timer gives the episode out (kind 'episode') and the slot stays
    shut for COOLDOWN_S more. Entries of one second go alarms first. Entries older than the watermark, or
    of a second that was scored already, are dropped, and so are those without tag or time. The
    session needs the RocksDB state store (ROCKSDB).
    """
    epoch = (F.unix_micros("ts") / 1e6).alias("epoch")
    rows = entries.where("ts is not null").select("plant", "ts", epoch, "tag_id", "value", "level").withWatermark("ts", late)
    return rows.groupBy("plant").transformWithStateInPandas(_Detector(model), OUTPUT, "Append", "EventTime")
