"""All queries over the driver's tables, with their SQL; names begin with the operator they show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules, tags
from millrace.operators import diagnosis, etl, graph, historian, lanes, paths, reads, retrieval
from millrace.plans import agents, plant  # noqa: F401 their queries are registered too
from millrace.plans.catalog import oracle_sql, queries  # noqa: F401 the entry module's names
from millrace.plans.catalog import query as _query
from millrace.plans.views import NOW, TODAY, Views, with_views
from millrace.streaming import units, watchers

_LEVEL = "CASE WHEN value >= hh THEN 'HH' WHEN value >= h THEN 'H' WHEN value <= ll THEN 'LL' WHEN value <= l THEN 'L' END"


def _levels(v: Views) -> DataFrame:
    return v.telemetry.join(v.envelopes, "tag_id").withColumn("level", rules.level_inclusive(F.col("value"), F.col("ll"), F.col("l"), F.col("h"), F.col("hh")))


# --- historian -------------------------------------------------------------------------------


@_query(f"SELECT tag_id, ts, value, {_LEVEL} AS level FROM (SELECT tag_id, max(ts) AS ts, arg_max(value, ts) AS value FROM telemetry GROUP BY tag_id) JOIN envelopes USING (tag_id)", "telemetry", "envelopes")
def flagship_latest_levels(v: Views) -> DataFrame:
    """PRJ-1, SRC-2, JN-9, MTH-5: the latest reading of each tag and its alarm level."""
    return historian.latest(v.telemetry).join(v.envelopes, "tag_id").select("tag_id", "ts", "value", rules.level_inclusive(F.col("value"), F.col("ll"), F.col("l"), F.col("h"), F.col("hh")).alias("level"))


@_query("SELECT ts, tag_id, value FROM telemetry WHERE tag_id IN ('TAG-1', 'TAG-2', 'TAG-7') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'", "telemetry")
def src01_window(v: Views) -> DataFrame:
    return historian.window(v.telemetry, ["TAG-1", "TAG-2", "TAG-7"], "2024-01-05", "2024-01-20").select("ts", "tag_id", "value")


@_query("SELECT tag_id, ts, value, quality, unit FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY ts DESC, value DESC) AS n FROM telemetry) WHERE n = 1", "telemetry")
def src02_latest(v: Views) -> DataFrame:
    return historian.latest(v.telemetry)


@_query(f"SELECT DISTINCT tag_id FROM telemetry WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE", "telemetry")
def src03_distinct_tags(v: Views) -> DataFrame:
    return historian.distinct_tags(v.telemetry, NOW)


@_query("SELECT m.event_id AS episode_id, t.tag_id, t.ts, t.value FROM telemetry t JOIN events m ON m.event_type = 'error' AND m.value > 150 AND t.tag_id = 'TAG-' || m.user_id AND t.ts BETWEEN m.ts - INTERVAL 86400 SECOND AND m.ts + INTERVAL 43200 SECOND", "telemetry")
def jn12_around(v: Views) -> DataFrame:
    """SRC-4, JN-12: samples around each episode, as a bucketed interval join."""
    moments = v.table("events").where("event_type = 'error' and value > 150").select(F.col("event_id").alias("episode_id"), F.concat(F.lit("TAG-"), "user_id").alias("tag_id"), F.col("ts").cast("timestamp_ntz").alias("onset"))
    return historian.around(v.telemetry, moments, 86_400, 43_200).select("episode_id", "tag_id", "ts", "value")


@_query("SELECT tag_id, ts, value, CASE WHEN gap > 0 THEN round((value - v0) / gap, 4) + 0.0 END AS rate FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, lag(value) OVER w AS v0 FROM telemetry WINDOW w AS (PARTITION BY tag_id ORDER BY ts, value))", "telemetry")
def jn13_rate_of_change(v: Views) -> DataFrame:
    """JN-13, WIN-3."""
    return historian.rate_of_change(v.telemetry).select("tag_id", "ts", "value", (F.round("rate", 4) + 0.0).alias("rate"))


@_query(f"SELECT tag_id, CAST(count(*) AS BIGINT) AS n FROM telemetry WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY tag_id", "telemetry")
def snk02_retention(v: Views) -> DataFrame:
    return historian.retained(v.telemetry, NOW, 7).groupBy("tag_id").agg(F.count("*").alias("n"))


@_query(f"SELECT 'TAG-' || user_id AS tag_id, CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE ts END AS ts, CASE WHEN user_id % 4 > 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS value, CASE WHEN user_id % 3 = 0 THEN 'GOOD' ELSE event_type END AS quality, event_type AS unit FROM events WHERE user_id % 7 <> 0")
def prj01_from_stream(v: Views) -> DataFrame:
    """PRJ-1, PRJ-2, MTH-11: string entries to typed samples; rows without a tag go, bad times are the time of arrival."""
    user = F.col("user_id")
    raw = v.table("events").select(F.when(user % 7 != 0, F.concat(F.lit("TAG-"), "user_id")).alias("tag_id"), F.when(user % 5 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("timestamp"), F.when(user % 4 == 0, "n/a").otherwise(F.get_json_object("props", "$.k")).alias("value"), F.when(user % 3 > 0, F.col("event_type")).alias("status"), F.col("event_type").alias("unit"), F.lit(NOW).alias("ingested"))
    return historian.from_stream(raw).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query("SELECT tag_id, CAST(count(*) AS BIGINT) AS n, round(sum(round(value, 1)), 3) AS total FROM telemetry GROUP BY tag_id", "telemetry")
def prj14_published(v: Views) -> DataFrame:
    sent = v.telemetry.withColumn("p", historian.published(F.col("value")))
    return sent.where("p.status = 'GOOD'").groupBy("tag_id").agg(F.count("*").alias("n"), F.round(F.sum(F.round("p.value", 1)), 3).alias("total"))


# --- alarms ----------------------------------------------------------------------------------


@_query(f"SELECT tag_id, level, CAST(count(*) AS BIGINT) AS n FROM (SELECT tag_id, {_LEVEL} AS level FROM telemetry JOIN envelopes USING (tag_id)) WHERE level IS NOT NULL GROUP BY ALL", "telemetry", "envelopes")
def mth05_levels(v: Views) -> DataFrame:
    return _levels(v).where("level is not null").groupBy("tag_id", "level").agg(F.count("*").alias("n"))


@_query("SELECT tag_id, CAST(count(*) FILTER (WHERE value > hh) AS BIGINT) AS n_hh, CAST(count(*) FILTER (WHERE value < ll) AS BIGINT) AS n_ll FROM telemetry JOIN envelopes USING (tag_id) GROUP BY tag_id", "telemetry", "envelopes")
def mth06_strict_levels(v: Views) -> DataFrame:
    c = F.col
    rows = v.telemetry.join(v.envelopes, "tag_id").withColumn("level", rules.level_strict(c("value"), c("ll"), c("l"), c("h"), c("hh"), c("ll"), c("hh")))
    return rows.groupBy("tag_id").agg(F.count_if(c("level") == "HH").alias("n_hh"), F.count_if(c("level") == "LL").alias("n_ll"))


@_query(f"SELECT tag_id, level, max(ts) AS ts FROM (SELECT tag_id, ts, {_LEVEL} AS level FROM telemetry JOIN envelopes USING (tag_id)) WHERE level IS NOT NULL GROUP BY ALL", "telemetry", "envelopes")
def agg22_newest_per_level(v: Views) -> DataFrame:
    return _levels(v).where("level is not null").groupBy("tag_id", "level").agg(F.max("ts").alias("ts"))


_ALARMS = f", s AS (SELECT tag_id, epoch_us(ts) / 1e6 AS ts, value, {_LEVEL} AS level FROM telemetry JOIN envelopes USING (tag_id))"


def _greedy(rows: str, key: str, gap: int) -> str:
    """SQL of the times that open a claim on each key: the first, and each first one ``gap`` seconds or more after the last."""
    return f"""{rows}, n AS (SELECT a.{key}, a.ts, min(b.ts) AS nxt FROM a LEFT JOIN a b ON a.{key} = b.{key} AND b.ts >= a.ts + {gap} GROUP BY 1, 2),
 r AS (SELECT {key}, min(ts) AS ts FROM a GROUP BY 1 UNION ALL SELECT n.{key}, n.nxt FROM r JOIN n USING ({key}, ts) WHERE n.nxt IS NOT NULL)"""


_STM02 = _ALARMS + """, g AS (SELECT *, count(level) OVER (PARTITION BY tag_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS segment FROM s),
 k AS (SELECT tag_id, segment, max(ts) FILTER (WHERE level IS NOT NULL) AS ts, max(level) AS level, max(value) FILTER (WHERE level IS NOT NULL) AS value, max(ts) FILTER (WHERE level IS NULL) - min(ts) FILTER (WHERE level IS NULL) AS spent FROM g WHERE segment > 0 GROUP BY ALL),
 f AS (SELECT *, lag(level) OVER w AS last, lag(spent) OVER w AS before FROM k WINDOW w AS (PARTITION BY tag_id ORDER BY segment))
 SELECT tag_id, ts, level, value FROM f WHERE last IS NULL OR last <> level OR before >= 30"""


@_query(_STM02, "telemetry", "envelopes")
def stm02_alarms(v: Views) -> DataFrame:
    """STM-2: alarms with levels, debounce and re-arming."""
    rows = _levels(v).select("tag_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "level", "value")
    return watchers.batch_alerts(rows)


_PEAKS = _STM02.split(" SELECT tag_id, ts, level, value FROM f")[0] + """, e AS (SELECT *, sum(CASE WHEN last IS NULL OR last <> level OR before >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY tag_id ORDER BY segment) AS alarm FROM f)
 SELECT tag_id, min(ts) AS ts, level, arg_min(value, segment) AS value, CASE WHEN level IN ('HH', 'H') THEN max(value) ELSE min(value) END AS peak, max(ts) AS last_seen FROM e GROUP BY tag_id, alarm, level"""


@_query(_PEAKS.replace("SELECT tag_id, epoch_us(ts)", "SELECT CASE WHEN tag_id LIKE '%3' THEN 'MV.' || tag_id ELSE tag_id END AS tag_id, epoch_us(ts)").replace(" GROUP BY tag_id, alarm, level", " WHERE tag_id NOT LIKE 'MV.%' GROUP BY tag_id, alarm, level"), "telemetry", "envelopes")
def stm02_peaks(v: Views) -> DataFrame:
    """STM-2: alarms with their peaks; tags that end in 3 are actuators."""
    tag = F.when(F.col("tag_id").endswith("3"), F.concat(F.lit("MV."), "tag_id")).otherwise(F.col("tag_id"))
    return watchers.alarm_peaks(_levels(v).select(tag.alias("tag_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "level", "value"))


@_query(_greedy(_ALARMS + ", a AS (SELECT DISTINCT tag_id || ':' || level AS fingerprint, ts FROM s WHERE level IS NOT NULL)", "fingerprint", 1800) + " SELECT fingerprint, ts FROM r", "telemetry", "envelopes")
def stm08_claims(v: Views) -> DataFrame:
    """STM-7, STM-8, ETL-39: one alert of a fingerprint in 30 minutes."""
    rows = _levels(v).where("level is not null").select(F.concat_ws(":", "tag_id", "level").alias("fingerprint"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return watchers.once_per(rows, 1800)


@_query(_greedy(", p AS (SELECT tag_id, ts, min(CAST(value >= 40 AS INT)) OVER w AS bad, count(*) OVER w AS n FROM telemetry WINDOW w AS (PARTITION BY tag_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), a AS (SELECT DISTINCT tag_id AS fingerprint, epoch_us(ts) / 1e6 AS ts FROM p WHERE bad = 1 AND n = 3)", "fingerprint", 172800) + " SELECT fingerprint, ts FROM r", "telemetry")
def stm10_detector_events(v: Views) -> DataFrame:
    """STM-10: persistent anomalies of a tag that come two days or more after its last event."""
    bad = diagnosis.persistent_anomalies(v.telemetry.withColumn("anomalous", F.col("value") >= 40), ["tag_id"])
    rows = bad.select(F.col("tag_id").alias("fingerprint"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return units.detector_events(rows.distinct(), 172_800.0)


@_query(_greedy(_ALARMS + ", a AS (SELECT DISTINCT tag_id AS slot, ts FROM s WHERE level IN ('HH', 'LL'))", "slot", 426) + " SELECT slot, ts FROM r", "telemetry", "envelopes")
def stm11_episodes(v: Views) -> DataFrame:
    """STM-11: alarms that arm an episode; each asset is a slot of its own."""
    rows = _levels(v).where("level in ('HH', 'LL')").select(F.col("tag_id").alias("slot"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return watchers.armed_episodes(rows.distinct())


@_query(_greedy(", h AS (SELECT event_type || ':' || user_id AS bucket, epoch_us(ts) / 1e6 AS ts FROM events), a AS (SELECT DISTINCT * FROM h)", "bucket", 86400) + " SELECT h.bucket, h.ts, row_number() OVER (PARTITION BY h.bucket, r.ts ORDER BY h.ts) <= 3 AS allowed FROM h JOIN r ON h.bucket = r.bucket AND h.ts >= r.ts AND h.ts - r.ts < 86400", "telemetry")
def stm17_rate_limit(v: Views) -> DataFrame:
    """STM-17: three hits of a user's kind of event in a day's window, which the first hit after the last window opens."""
    rows = v.table("events").select(F.concat_ws(":", "event_type", "user_id").alias("bucket"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return watchers.rate_limited(rows, 3, 86400.0)


@_query("SELECT date_trunc('second', ts) AS ts, CAST(count(DISTINCT tag_id) AS BIGINT) AS n FROM telemetry GROUP BY 1", "telemetry")
def stm09_slices(v: Views) -> DataFrame:
    """STM-9: what tags a second's slice holds."""
    return watchers.slices(v.telemetry).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.size("values").cast("bigint").alias("n"))


@_query("SELECT CAST(floor(epoch(TIMESTAMP '2024-01-30 00:00:00' - ts) / 3600) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' AND ts > TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1")
def ui02_hourly(v: Views) -> DataFrame:
    return retrieval.hourly(v.table("events").where(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz")), NOW).where("n > 0")


@_query("SELECT event_type AS kind, CAST(count(*) FILTER (WHERE value >= 100) AS BIGINT) AS critical, CAST(count(*) FILTER (WHERE value >= 50 AND value < 100) AS BIGINT) AS warning, CAST(count(*) FILTER (WHERE value < 50) AS BIGINT) AS info FROM events GROUP BY 1")
def ui03_matrix(v: Views) -> DataFrame:
    """UI-1, UI-3: a zero-filled matrix of counts."""
    severity = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "warning").otherwise("info")
    return v.table("events").select(F.col("event_type").alias("kind"), severity.alias("severity")).groupBy("kind").pivot("severity", ["critical", "warning", "info"]).count().fillna(0)


@_query("SELECT tag_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY ts DESC, value) AS n FROM telemetry) WHERE n <= 20", "telemetry")
def ui05_rolling_buffer(v: Views) -> DataFrame:
    """UI-5, WIN-5, TOP-8: the newest samples of each tag."""
    return graph.ranked(v.telemetry, ["tag_id"], [F.desc("ts"), "value"], 20).select("tag_id", "ts", "value")


# --- diagnosis -------------------------------------------------------------------------------


def _samples(v: Views) -> DataFrame:
    """Days as episodes: the onset is noon."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return v.telemetry.select(F.date_format(day, "yyyyMMdd").alias("episode_id"), (day + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz").alias("onset"), "ts", F.concat(F.lit("UNIT.T"), F.expr("CAST(substring(tag_id, 5) AS INT) % 6")).alias("tag_id"), "value")


_SIGNATURES = """signatures AS (WITH s AS (SELECT strftime(ts, '%Y%m%d') AS episode_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS onset, ts, 'UNIT.T' || (CAST(substr(tag_id, 5) AS INT) % 6) AS tag_id, value FROM telemetry),
 b AS (SELECT episode_id, tag_id, onset, count(*) FILTER (WHERE ts < onset) AS n_pre, count(*) FILTER (WHERE ts >= onset) AS n_post, avg(value) FILTER (WHERE ts < onset) AS mean, greatest(stddev_pop(value) FILTER (WHERE ts < onset), 1e-6) AS std FROM s GROUP BY ALL),
 p AS (SELECT s.*, b.mean, b.std, b.n_post, abs(value - mean) AS off FROM s JOIN b USING (episode_id, tag_id, onset) WHERE n_pre >= 2 AND n_post >= 1 AND s.ts >= s.onset),
 g AS (SELECT episode_id, tag_id, onset, mean, std, n_post, count(*) FILTER (WHERE off >= 1.5 * std) AS nb, min(ts) FILTER (WHERE off >= 1.5 * std) AS first, arg_max(value, off) AS peak FROM p GROUP BY ALL),
 k AS (SELECT episode_id, tag_id, CASE WHEN peak >= mean THEN 'high' ELSE 'low' END AS direction, round(abs(peak - mean) / std, 3) AS magnitude, round((epoch_us(first) - epoch_us(onset)) / 1e6, 3) AS onset_offset_s FROM g WHERE nb >= greatest(1, floor(n_post * 0.2)))
 SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY onset_offset_s, magnitude DESC, tag_id) - 1 AS BIGINT) AS first_mover_rank FROM k)"""


def _signatures(v: Views) -> DataFrame:
    return diagnosis.signatures(_samples(v), 1.5)


@_query(f", {_SIGNATURES} SELECT episode_id, tag_id, direction, magnitude, onset_offset_s, first_mover_rank FROM signatures", "telemetry")
def agg11_signatures(v: Views) -> DataFrame:
    """AGG-10, AGG-11, WIN-2: deviating tags of each episode and who moved first."""
    return _signatures(v)


@_query("SELECT strftime(ts, '%Y%m%d') AS episode_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS window_s FROM telemetry GROUP BY 1", "telemetry")
def agg12_window_span(v: Views) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return _samples(v).groupBy("episode_id").agg(F.round((us(F.max("ts")) - us(F.min("ts"))) / 1e6, 3).alias("window_s"))


@_query(f", {_SIGNATURES} SELECT episode_id, CASE WHEN max(magnitude) >= 15 THEN 'critical' WHEN max(magnitude) >= 6 THEN 'warning' ELSE 'info' END AS severity FROM signatures GROUP BY 1", "telemetry")
def agg20_severity(v: Views) -> DataFrame:
    return diagnosis.severity(_signatures(v))


@_query(f", {_SIGNATURES} SELECT episode_id, string_agg(area, ',' ORDER BY r) AS unit_areas FROM (SELECT episode_id, split_part(tag_id, '.', 1) AS area, min(first_mover_rank) AS r FROM signatures GROUP BY ALL) GROUP BY 1", "telemetry")
def agg21_unit_areas(v: Views) -> DataFrame:
    return diagnosis.unit_areas(_signatures(v)).select("episode_id", F.array_join("unit_areas", ",").alias("unit_areas"))


@_query(
    f""", {_SIGNATURES}, q AS (SELECT * FROM signatures WHERE episode_id >= '20240110'), c AS (SELECT 'mode-' || episode_id AS mode_id, * EXCLUDE (episode_id) FROM signatures WHERE episode_id < '20240110'),
 sh AS (SELECT q.episode_id, c.mode_id, q.tag_id, q.direction = c.direction AS ok, q.first_mover_rank AS qr, c.first_mover_rank AS cr FROM q JOIN c USING (tag_id)),
 n AS (SELECT episode_id, mode_id, count(*) AS n, count(*) FILTER (WHERE ok) AS na FROM sh GROUP BY ALL),
 pr AS (SELECT a.episode_id, a.mode_id, count(*) FILTER (WHERE sign(a.qr - b.qr) * sign(a.cr - b.cr) <> 0) AS told, count(*) FILTER (WHERE sign(a.qr - b.qr) * sign(a.cr - b.cr) > 0) AS same FROM sh a JOIN sh b ON a.episode_id = b.episode_id AND a.mode_id = b.mode_id AND a.tag_id < b.tag_id AND a.ok AND b.ok GROUP BY ALL),
 sc AS (SELECT n.episode_id, n.mode_id, (2.0 * na - n) / (nq + nc - n) * (0.5 + 0.5 * CASE WHEN coalesce(told, 0) = 0 THEN 1.0 ELSE same / told END) AS raw, (2.0 * na - n) AS o FROM n LEFT JOIN pr USING (episode_id, mode_id) JOIN (SELECT episode_id, count(*) AS nq FROM q GROUP BY 1) USING (episode_id) JOIN (SELECT mode_id, count(*) AS nc FROM c GROUP BY 1) USING (mode_id))
 SELECT episode_id, mode_id, round(raw, 4) AS confidence, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY round(raw, 4) DESC, mode_id) AS BIGINT) AS nth FROM sc WHERE o > 0 AND raw >= 0.05) WHERE nth <= 5""",
    "telemetry",
)
def jn11_match(v: Views) -> DataFrame:
    """JN-11, MTH-3, MTH-4, TOP-2, SET-2: the best fault modes of each signature."""
    s = _signatures(v)
    library = s.where("episode_id < '20240110'").withColumn("mode_id", F.concat(F.lit("mode-"), "episode_id"))
    return diagnosis.match(s.where("episode_id >= '20240110'"), library)


def _wide(v: Views) -> tuple[DataFrame, list[str]]:
    kinds = ["click", "error", "purchase", "signup", "view"]
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return v.table("events").select(day.alias("ts"), "event_type", "value").groupBy("ts").pivot("event_type", kinds).agg(F.avg("value")), kinds


@_query()
def mth02_detector(v: Views) -> DataFrame:
    """AGG-13, MTH-2: a PCA control chart over aligned days, fitted and applied."""
    wide, kinds = _wide(v)
    scored = diagnosis.score_detector(wide, diagnosis.fit_detector(wide, kinds))
    return scored.select("ts", F.round("t2", 6).alias("t2"), F.round("spe", 6).alias("spe"), "anomalous", "lead_tag")


@_query("SELECT tag_id, ts, onset FROM (SELECT tag_id, ts, min(CAST(value >= 40 AS INT)) OVER w AS bad, count(*) OVER w AS n, min(ts) OVER w AS onset FROM telemetry WINDOW w AS (PARTITION BY tag_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE bad = 1 AND n = 3", "telemetry")
def win04_persistence(v: Views) -> DataFrame:
    """WIN-4, STM-10: three anomalous samples in a row."""
    return diagnosis.persistent_anomalies(v.telemetry.withColumn("anomalous", F.col("value") >= 40), ["tag_id"]).select("tag_id", "ts", "onset")


@_query("SELECT tag_id, CAST(count(*) AS BIGINT) AS n, round(var_pop(value), 5) AS variance FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY ts DESC, value) AS k FROM telemetry) WHERE k <= 60 GROUP BY 1 HAVING count(*) >= 30", "telemetry")
def agg19_stall(v: Views) -> DataFrame:
    last = graph.ranked(v.telemetry, ["tag_id"], [F.desc("ts"), "value"], 60)
    return last.groupBy("tag_id").agg(F.count("*").alias("n"), F.round(F.var_pop("value"), 5).alias("variance")).where("n >= 30")


# --- graph -----------------------------------------------------------------------------------


@_query("SELECT id, label, surface_form FROM nodes WHERE (lower(surface_form) = 'supplier#000000007' OR id IN ('equip:Supplier#000000007', 'inst:Supplier#000000007', 'Supplier#000000007')) AND label NOT IN ('Chunk', 'Section', 'Document') ORDER BY id LIMIT 1", "nodes")
def flt01_exact(v: Views) -> DataFrame:
    return graph.entity_by_surface(v.nodes, "Supplier#000000007").select("id", "label", "surface_form")


@_query("SELECT id, surface_form FROM nodes WHERE contains(lower(surface_form), 'mode 1') ORDER BY id LIMIT 5", "nodes")
def flt02_by_name(v: Views) -> DataFrame:
    return graph.entities_by_name(v.nodes, "Mode 1", 5).select("id", "surface_form")


@_query("SELECT n.id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = 'human' AND (e.src = n.id OR e.dst = n.id))", "nodes", "edges")
def flt09_not_human(v: Views) -> DataFrame:
    """FLT-9, ETL-16: nodes that no human edge touches."""
    return graph.not_human_touched(v.nodes, v.edges).select("id")


@_query("SELECT e.src, a.label AS src_label, e.dst, b.label AS dst_label, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'HAS_FAILURE' GROUP BY ALL", "nodes", "edges")
def jn01_one_hop(v: Views) -> DataFrame:
    by = graph.of_types(v.edges, ["HAS_FAILURE"]).groupBy("src", "dst").agg(F.count("*").alias("n"))
    a, b = v.nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label")), v.nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return by.join(a, "src").join(b, "dst").select("src", "src_label", "dst", "dst_label", "n")


@_query("SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM edges WHERE type IN ('PART_OF', 'CONNECTED_TO', 'HAS_FAILURE') UNION ALL SELECT dst FROM edges WHERE type IN ('PART_OF', 'CONNECTED_TO', 'HAS_FAILURE')) GROUP BY 1", "edges")
def gr04_degrees(v: Views) -> DataFrame:
    """GR-4, JN-2, UI-14: undirected degrees."""
    return graph.degrees(v.edges, ["PART_OF", "CONNECTED_TO", "HAS_FAILURE"])


_TRAILS = """, b AS (SELECT edge_id, type, src, dst, confidence, src AS a, dst AS z FROM edges WHERE type IN ('PART_OF', 'CONNECTED_TO') UNION ALL SELECT edge_id, type, src, dst, confidence, dst, src FROM edges WHERE type IN ('PART_OF', 'CONNECTED_TO') AND src <> dst),
 d AS (SELECT a AS node, count(*) AS degree FROM b GROUP BY 1),
 f AS (SELECT b.*, 0.8 * greatest(confidence, 0.3) / greatest(degree - 1, 1) AS w FROM b JOIN d ON d.node = b.src),
 t AS (SELECT 'equip:1' AS s, x.z AS e, 1 AS hops, x.edge_id AS path, x.w AS score FROM f x WHERE x.a = 'equip:1'
 UNION ALL SELECT 'equip:1', y.z, 2, x.edge_id || '>' || y.edge_id, x.w * y.w FROM f x JOIN f y ON x.z = y.a AND y.edge_id <> x.edge_id WHERE x.a = 'equip:1'
 UNION ALL SELECT 'equip:1', w.z, 3, x.edge_id || '>' || y.edge_id || '>' || w.edge_id, x.w * y.w * w.w FROM f x JOIN f y ON x.z = y.a AND y.edge_id <> x.edge_id JOIN f w ON y.z = w.a AND w.edge_id <> x.edge_id AND w.edge_id <> y.edge_id WHERE x.a = 'equip:1')"""


def _scored(v: Views) -> DataFrame:
    types = ["PART_OF", "CONNECTED_TO"]
    seeds = v.nodes.where("id = 'equip:1'")
    return graph.scored_paths(graph.trails(v.edges, seeds, types, 3), graph.degrees(v.edges, types))


@_query(_TRAILS + " SELECT s AS start, e AS \"end\", CAST(hops AS BIGINT) AS hops, path, round(score, 9) AS score FROM t", "edges")
def gr01_trails(v: Views) -> DataFrame:
    """GR-1, GR-2, GR-6: undirected trails of up to three edges with their flow score."""
    return _scored(v).select("start", "end", F.col("hops").cast("bigint").alias("hops"), F.array_join("path", ">").alias("path"), F.round("score", 9).alias("score"))


@_query("SELECT e1.dst AS unit, e2.dst AS next, CAST(count(*) AS BIGINT) AS n FROM edges e1 JOIN edges e2 ON e1.dst = e2.src WHERE e1.type = 'PART_OF' AND e2.type = 'CONNECTED_TO' GROUP BY ALL", "edges")
def gr03_downstream(v: Views) -> DataFrame:
    a = graph.of_types(v.edges, ["PART_OF"]).select(F.col("dst").alias("unit"))
    b = graph.of_types(v.edges, ["CONNECTED_TO"]).select(F.col("src").alias("unit"), F.col("dst").alias("next"))
    return a.join(b, "unit").groupBy("unit", "next").agg(F.count("*").alias("n"))


@_query("SELECT src, dst, CAST(count(*) AS BIGINT) AS n, coalesce(string_agg(DISTINCT CASE WHEN cause <> '' THEN cause END, ',' ORDER BY CASE WHEN cause <> '' THEN cause END), '') AS causes, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM edges WHERE type = 'HAS_FAILURE' GROUP BY src, dst", "edges")
def agg01_failures(v: Views) -> DataFrame:
    """AGG-1, AGG-2, AGG-7, AGG-16."""
    return graph.failures_of(v.edges)


@_query("SELECT dst AS mode, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT src) AS BIGINT) AS n_equipment, min(doc_id) AS first_doc FROM edges WHERE type = 'HAS_FAILURE' GROUP BY 1 ORDER BY n DESC, mode LIMIT 10", "edges")
def agg03_mode_counts(v: Views) -> DataFrame:
    """AGG-3, ETL-21, ETL-36."""
    return graph.mode_counts(v.edges)


@_query("SELECT label, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY 1", "nodes")
def agg08_labels(v: Views) -> DataFrame:
    return v.nodes.groupBy("label").agg(F.count("*").alias("n"))


@_query("SELECT type, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS confidence FROM edges GROUP BY 1", "edges")
def agg08_edge_types(v: Views) -> DataFrame:
    return v.edges.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@_query(", x AS (SELECT DISTINCT 'T-' || (CAST(substr(src, 7) AS INT) % 50 + 100) || CASE WHEN CAST(substr(src, 7) AS INT) % 100 < 50 THEN 'A' ELSE 'B' END AS tag, dst AS mode FROM edges WHERE type = 'HAS_FAILURE') SELECT a.tag, a.mode, b.tag AS sibling FROM x a JOIN x b ON a.mode = b.mode AND a.tag <> b.tag AND regexp_replace(a.tag, '[A-Z]+$', '') = regexp_replace(b.tag, '[A-Z]+$', '')", "edges")
def jn06_siblings(v: Views) -> DataFrame:
    """JN-6, AGG-4, ETL-27, STR-19: other tags of the family with the same failure."""
    n = F.substring("src", 7, 20).cast("int")
    tag = F.concat(F.lit("T-"), n % 50 + 100, F.when(n % 100 < 50, "A").otherwise("B"))
    found = graph.of_types(v.edges, ["HAS_FAILURE"]).select(tag.alias("tag"), F.col("dst").alias("mode")).distinct()
    return graph.siblings(found, found.select("tag", tags.family_of(F.col("tag")).alias("family")).distinct())


@_query("SELECT e.edge_id FROM edges e SEMI JOIN (SELECT * FROM nodes WHERE label <> 'FailureMode' AND id <> 'area:3') a ON a.id = e.src SEMI JOIN (SELECT * FROM nodes WHERE label <> 'FailureMode' AND id <> 'area:3') b ON b.id = e.dst", "nodes", "edges")
def jn08_snapshot(v: Views) -> DataFrame:
    """JN-8, SNK-4, UI-13: edges with both ends in a set of nodes."""
    return graph.induced(v.nodes.where("label <> 'FailureMode' and id <> 'area:3'"), v.edges).select("edge_id")


@_query("SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT src, CASE WHEN dst IN ('fm:1', 'fm:2', 'fm:3') THEN 'fm:0' ELSE dst END AS dst, prov_hash FROM edges WHERE type = 'HAS_FAILURE') GROUP BY ALL", "edges")
def etl17_merge_modes(v: Views) -> DataFrame:
    variants = v.nodes.where("id in ('fm:1', 'fm:2', 'fm:3')").select(F.col("id").alias("variant"), F.lit("fm:0").alias("canonical"))
    return graph.merge_modes(v.edges.where("type = 'HAS_FAILURE'"), variants).groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("SELECT DISTINCT CASE WHEN src IN ('equip:1', 'equip:2') THEN 'equip:0' ELSE src END AS src, 'CAUSES' AS type, dst, 0.7 AS confidence, 'agent' AS source FROM edges WHERE type = 'PART_OF'", "edges")
def etl18_causal_links(v: Views) -> DataFrame:
    merged = v.nodes.where("id in ('equip:1', 'equip:2')").select(F.col("id").alias("variant"), F.lit("equip:0").alias("canonical"))
    return graph.causal_links(v.edges.where("type = 'PART_OF'").select(F.col("src").alias("cause"), F.col("dst").alias("effect")), merged)


@_query("SELECT id, CASE WHEN id LIKE 'area:%' THEN 'changed' ELSE surface_form END AS surface_form, CASE WHEN id LIKE 'area:%' THEN 'a=1,b=2' ELSE 'a=0' END AS props, CAST(1 AS BIGINT) AS created_version, CAST(CASE WHEN id LIKE 'area:%' THEN 2 ELSE 1 END AS BIGINT) AS updated_version FROM nodes", "nodes")
def snk03_upsert_nodes(v: Views) -> DataFrame:
    """SNK-3, ETL-14, PRJ-3: an overlay of properties in which nulls never overwrite."""
    text = lambda c: F.lit(c).cast("string")
    before = v.nodes.select("id", "label", "surface_form", F.create_map(text("a"), text("0")).alias("props"), F.lit(1).cast("bigint").alias("created_version"), F.lit(1).cast("bigint").alias("updated_version"), F.lit(False).alias("superseded"))
    batch = v.nodes.where("id like 'area:%'").select("id", "label", F.lit("changed").alias("surface_form"), F.create_map(text("a"), text("1"), text("b"), text("2"), text("c"), text(None)).alias("props"))
    out = graph.upsert_nodes(before, batch, 2)
    props = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("id", "surface_form", props.alias("props"), "created_version", "updated_version")


@_query("SELECT DISTINCT CAST(7 AS BIGINT) AS graph_version, kind, value FROM (SELECT 'node' AS kind, id AS value FROM nodes UNION ALL SELECT 'edge_type', type FROM edges UNION ALL SELECT 'document', doc_id FROM edges) WHERE value IS NOT NULL", "nodes", "edges")
def agg24_delta(v: Views) -> DataFrame:
    """AGG-24: what a commit touched."""
    return graph.delta(v.nodes, v.edges, 7)


@_query("SELECT wo_id, line, substr(sha1(wo_id || '|' || line || '|||x'), 1, 16) AS prov_hash FROM work_orders", "work_orders")
def str06_provenance(v: Views) -> DataFrame:
    none = F.lit(None)
    return v.work_orders.select("wo_id", "line", graph.provenance_hash(F.col("wo_id"), F.col("line"), none, none, F.lit("x")).alias("prov_hash"))


# --- compliance, work orders, metrics --------------------------------------------------------

_POSITION = f"SELECT 'compliance:' || equipment || ':' || standard || ':' || next_due AS id, equipment, standard, next_due, CASE WHEN next_due < '{TODAY}' THEN 'overdue' WHEN next_due <= '2000-08-30' THEN 'due_soon' ELSE 'compliant' END AS status FROM work_orders WHERE next_due <> ''"


@_query(_POSITION, "work_orders")
def etl23_compliance(v: Views) -> DataFrame:
    """ETL-23, FLT-7, FLT-8, TOP-4."""
    return retrieval.compliance_position(v.work_orders, TODAY)


_INSPECTIONS = "SELECT equipment, standard, CASE WHEN line % 3 > 0 THEN 'type ' || line END AS inspection_type, next_due, date AS last_inspection, CASE WHEN line % 2 = 0 THEN 'rev ' || line END AS revision, 'doc:' || wo_id AS doc_id, line AS page FROM work_orders"


def _inspections(v: Views) -> DataFrame:
    line = F.col("line")
    return v.work_orders.select("equipment", "standard", F.when(line % 3 > 0, F.concat(F.lit("type "), line)).alias("inspection_type"), "next_due", F.col("date").alias("last_inspection"), F.when(line % 2 == 0, F.concat(F.lit("rev "), line)).alias("revision"), F.concat(F.lit("doc:"), "wo_id").alias("doc_id"), line.alias("page"))


@_query(f", i AS ({_INSPECTIONS}) SELECT 'compliance:' || equipment || ':' || standard || ':' || next_due AS id, equipment, standard, coalesce(inspection_type, 'Inspection') AS inspection_type, next_due, last_inspection, coalesce(revision, '') AS revision, doc_id, page, CASE WHEN next_due < '{TODAY}' THEN 'overdue' WHEN next_due <= '2000-08-30' THEN 'due_soon' ELSE 'compliant' END AS status FROM i WHERE next_due <> ''", "work_orders")
def etl23_items(v: Views) -> DataFrame:
    """ETL-23, TOP-4: the items of the compliance position."""
    return retrieval.compliance_items(_inspections(v), TODAY)


@_query(f", i AS ({_INSPECTIONS}) SELECT 'compliance' AS kind, 'warning' AS severity, trim('Overdue inspection: ' || equipment || ' ' || coalesce(inspection_type, '')) AS title, equipment || ' - ' || coalesce(inspection_type, 'inspection') || ' per ' || standard || ' was due ' || next_due || ' and is now overdue.' AS body, equipment, doc_id, page, 'compliance:' || equipment || ':' || standard || ':' || next_due AS fingerprint FROM i WHERE next_due <> '' AND next_due < '{TODAY}'", "work_orders")
def etl24_alerts(v: Views) -> DataFrame:
    """ETL-24: an alert for each overdue inspection."""
    return retrieval.compliance_alerts(_inspections(v), TODAY)


@_query(f"SELECT CAST(count(*) FILTER (WHERE status = 'overdue') AS BIGINT) AS overdue, CAST(count(*) FILTER (WHERE status = 'due_soon') AS BIGINT) AS due_soon, CAST(count(*) FILTER (WHERE status = 'compliant') AS BIGINT) AS compliant FROM ({_POSITION})", "work_orders")
def agg09_status_counts(v: Views) -> DataFrame:
    return retrieval.status_counts(retrieval.compliance_position(v.work_orders, TODAY))


@_query(f"SELECT DISTINCT equipment, standard, next_due FROM work_orders WHERE next_due <> '' AND next_due < '{TODAY}'", "work_orders")
def etl24_overdue(v: Views) -> DataFrame:
    """ETL-24, UI-4, FLT-7: one alert for each overdue inspection."""
    due = retrieval.compliance_position(v.work_orders, TODAY).where("status = 'overdue'")
    return due.select("equipment", "standard", "next_due").distinct()


@_query("SELECT standard, CAST(count(DISTINCT equipment) AS BIGINT) AS n_equipment, max(date) AS last_date, CAST(count(*) AS BIGINT) AS n FROM work_orders GROUP BY 1", "work_orders")
def agg05_standards(v: Views) -> DataFrame:
    """AGG-5, TOP-5."""
    return v.work_orders.groupBy("standard").agg(F.countDistinct("equipment").alias("n_equipment"), F.max("date").alias("last_date"), F.count("*").alias("n"))


@_query("SELECT equipment, wo_id, line, date FROM (SELECT *, row_number() OVER (PARTITION BY equipment ORDER BY date DESC, wo_id, line) AS n FROM work_orders) WHERE n <= 10", "work_orders")
def top03_recent_orders(v: Views) -> DataFrame:
    """TOP-3, WIN-5, ETL-22: the ten newest orders of each equipment."""
    return graph.ranked(v.work_orders, ["equipment"], [F.desc("date"), "wo_id", "line"], 10).select("equipment", "wo_id", "line", "date")


_PRIORITY = "CASE WHEN NOT verified THEN CASE WHEN siblings > 0 AND n >= 2 THEN 'medium' ELSE 'low' END WHEN siblings > 0 AND n >= 2 AND clauses > 0 THEN 'immediate' WHEN (siblings > 0 AND n >= 2) OR clauses > 0 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END"


@_query(f"SELECT l_orderkey, l_linenumber, {_PRIORITY} AS priority FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS siblings, l_partkey % 4 AS n, l_linenumber % 2 AS clauses, l_returnflag <> 'R' AS verified FROM lineitem)")
def mth08_priority(v: Views) -> DataFrame:
    c = F.col
    rows = v.table("lineitem")
    return rows.select("l_orderkey", "l_linenumber", rules.draft_priority(c("l_suppkey") % 3, c("l_partkey") % 4, c("l_linenumber") % 2, c("l_returnflag") != "R").alias("priority"))


_RESULTS = "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'wrong' END AS verdict, doc_id % 3 = 0 AS citation_hit, CASE doc_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'path' ELSE 'vector' END AS mode_expected, CASE doc_id % 2 WHEN 0 THEN 'local' ELSE 'path' END AS mode_actual, doc_id % 20 / 2 AS seconds FROM labels"


def _results(v: Views) -> DataFrame:
    d = F.col("doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "partial").otherwise("wrong")
    return v.table("labels").select("doc_id", verdict.alias("verdict"), (d % 3 == 0).alias("citation_hit"), F.when(d % 3 == 0, "local").when(d % 3 == 1, "path").otherwise("vector").alias("mode_expected"), F.when(d % 2 == 0, "local").otherwise("path").alias("mode_actual"), (d % 20 / 2).alias("seconds"))


@_query(f"SELECT CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE verdict = 'correct') AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE verdict = 'partial') AS BIGINT) AS partial, CAST(count(*) FILTER (WHERE verdict = 'wrong') AS BIGINT) AS wrong, round(avg(CAST(verdict = 'correct' AS INT)), 2) AS accuracy, round(avg(CAST(citation_hit AS INT)), 2) AS citation_hit_rate, round(avg(CAST(mode_expected = mode_actual AS INT)), 2) AS mode_match_rate, round(avg(seconds), 2) AS mean_seconds FROM ({_RESULTS})")
def agg14_eval(v: Views) -> DataFrame:
    return retrieval.eval_summary(_results(v))


@_query(f"SELECT mode_expected, CAST(count(*) AS BIGINT) AS cases, round(avg(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END), 3) AS score FROM ({_RESULTS}) GROUP BY 1")
def agg15_by_mode(v: Views) -> DataFrame:
    return retrieval.weighted_by_mode(_results(v))


@_query("SELECT event_type AS service, CAST(greatest(1, least(12, ceil(count(*) / 400))) AS BIGINT) AS workers FROM events GROUP BY 1")
def agg17_workers(v: Views) -> DataFrame:
    """AGG-17, STM-18: workers for a backlog."""
    return retrieval.desired_workers(v.table("events").select(F.col("event_type").alias("service"), F.lit(1).alias("depth")), 400, 1, 12)


@_query("SELECT user_id AS draft_id, min(ts) AS ts, arg_min(event_type, ts) AS decision FROM events GROUP BY 1")
def stm20_first_decision(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("user_id").alias("draft_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("decision"), F.lit("x").alias("who"))
    return retrieval.first_decisions(rows).select("draft_id", "ts", "decision")


@_query("SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL")
def snk06_latest_wins(v: Views) -> DataFrame:
    """SNK-6, STM-19: the last write of a key wins."""
    rows = v.table("events").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return etl.latest_by(rows, ["user_id", "event_type"], [F.desc("ts")])


# --- scalar rules ----------------------------------------------------------------------------


@_query("SELECT p_partkey, regexp_replace(upper(p_name), '[\\s_]+', '', 'g') AS squeezed, 'P-' || (p_partkey % 900 + 100) || 'A' AS tag, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def str02_tags(v: Views) -> DataFrame:
    """STR-2, STR-4: 'p 101 a' is P-101A."""
    raw = F.concat(F.lit("p "), F.col("p_partkey") % 900 + 100, F.lit(" a"))
    squeezed = F.regexp_replace(F.upper("p_name"), r"[\s_]+", "")
    return v.table("part").select("p_partkey", squeezed.alias("squeezed"), tags.normalize(raw).alias("tag"), tags.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@_query("SELECT id, CASE label WHEN 'Equipment' THEN 'equip:' || upper(trim(surface_form)) WHEN 'Line' THEN 'line:' || upper(trim(surface_form)) WHEN 'FailureMode' THEN 'fm:' ELSE 'reg:' END || CASE WHEN label IN ('FailureMode', 'RegulationClause') THEN trim(regexp_replace(lower(surface_form), '[^a-z0-9]+', '-', 'g'), '-') ELSE '' END AS canonical FROM nodes WHERE NOT regexp_matches(upper(surface_form), '^[A-Z]{1,4}-?[0-9]{2,5}-?[A-Z]?$')", "nodes")
def str05_canonical(v: Views) -> DataFrame:
    """STR-5, ETL-13."""
    rows = v.nodes.where(~F.upper("surface_form").rlike(tags.CLEAN_TAG))
    return rows.select("id", tags.canonical_id(F.col("label"), F.col("surface_form")).alias("canonical"))


_ASKED = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Why did ' || p_name || ' trip?' WHEN 1 THEN 'Which equipment is overdue?' WHEN 2 THEN 'Show ' || p_name WHEN 3 THEN 'Statutory inspection of ' || p_name ELSE 'Explain how pumps work' END AS q, p_size % 3 AS seeds FROM part"


@_query(f"SELECT p_partkey, CASE WHEN seeds = 0 THEN 'vector' WHEN seeds >= 2 OR regexp_matches(lower(q), 'why|cause|lead|led|result|because|affect|impact|downstream|upstream|explain how|could|trigger') THEN 'path' ELSE 'local' END AS mode, regexp_matches(lower(q), 'overdue|statutory|inspection|compliance|most frequent|most common|how many|which equipment') AS digest FROM ({_ASKED})")
def str13_route(v: Views) -> DataFrame:
    """STR-13, STR-14."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    q = F.when(k == 0, F.concat(F.lit("Why did "), name, F.lit(" trip?"))).when(k == 1, "Which equipment is overdue?").when(k == 2, F.concat(F.lit("Show "), name)).when(k == 3, F.concat(F.lit("Statutory inspection of "), name)).otherwise("Explain how pumps work")
    return v.table("part").withColumn("q", q).select("p_partkey", rules.route(F.col("q"), F.col("p_size") % 3).alias("mode"), rules.wants_digest(F.col("q")).alias("digest"))


@_query("SELECT conv_id, turn, role, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n FROM conversations) WHERE n <= 4")
def etl28_transcript(v: Views) -> DataFrame:
    return retrieval.transcript_tail(v.table("conversations"))


@_query("SELECT conv_id, substr(sha1(lower(trim(min(text)))), 1, 16) AS key FROM conversations WHERE turn = 0 GROUP BY 1")
def etl29_cache_key(v: Views) -> DataFrame:
    return v.table("conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text")).select("conv_id", retrieval.cache_key(F.col("text")).alias("key"))


# --- documents and vectors -------------------------------------------------------------------


@_query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def etl01_dedup(v: Views) -> DataFrame:
    """ETL-1, STR-6: one document for each content."""
    return etl.first_by_content(v.table("documents").select("doc_id", F.col("text").alias("content")), "doc_id")


@_query()
def etl05_chunks(v: Views) -> DataFrame:
    """ETL-5, WIN-6: sections and packed paragraphs with their offsets."""
    return etl.chunks(v.table("documents"))


@_query()
def etl06_mentions(v: Views) -> DataFrame:
    """ETL-6, STR-1: tags that documents name."""
    return etl.mentions(v.table("documents"))


_VECTOR = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"


@_query(f"SELECT e.vec_id AS id, round({_VECTOR}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 8")
def top01_vector(v: Views) -> DataFrame:
    """TOP-1, MTH-1: the eight nearest vectors of one."""
    rows = v.table("embeddings")
    query = rows.where("vec_id = 0").select("embedding").first()
    return retrieval.vector_top_k(rows.select(F.col("vec_id").alias("id"), "embedding"), query.embedding if query else [0.0])


@_query()
def str21_hash_embedding(v: Views) -> DataFrame:
    """STR-21, STR-22: deterministic embeddings of benchmark texts."""
    vector = retrieval.hash_embedding(F.col("text"), 16)
    return v.table("benchmark").select("item_id", F.transform(vector, lambda x: F.round(x, 6)).alias("vector"))


@_query("SELECT event_id, CASE WHEN user_id % 13 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k, user_id % 13 = 0 AS parked FROM events")
def snk08_good_rows(v: Views) -> DataFrame:
    """SNK-8: JSON rows that fit, and those that go to a dead-letter table."""
    value = F.when(F.col("user_id") % 13 == 0, "{").otherwise(F.col("props"))
    good, bad = etl.good_and_bad(v.table("events").select("event_id", value.alias("value")), "k bigint")
    return good.select("event_id", "k", F.lit(False).alias("parked")).union(bad.select("event_id", F.lit(-1).cast("bigint"), F.lit(True)))


# --- reads for questions ------------------------------------------------------------------------


@_query("SELECT coalesce(a.id, e.src) AS src, coalesce(b.id, e.dst) AS dst FROM (SELECT s_name AS src, n_name AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'unknown' FROM nation) e LEFT JOIN nodes a ON a.surface_form = e.src LEFT JOIN nodes b ON b.surface_form = e.dst", "nodes")
def jn07_resolved_edges(v: Views) -> DataFrame:
    named = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"))
    found = named.union(v.table("nation").select("n_name", F.lit("unknown")))
    return reads.resolved_edges(found, v.nodes.select(F.col("surface_form").alias("surface"), "id"))


@_query("SELECT DISTINCT wo_id, equipment, date, status, surface_form AS name FROM work_orders JOIN nodes ON id = equipment WHERE label = 'Equipment'", "nodes", "work_orders")
def jn14_equipment_orders(v: Views) -> DataFrame:
    return reads.equipment_orders(v.work_orders, v.nodes)


@_query("SELECT a.src AS start, b.src AS \"end\", CAST(2 AS BIGINT) AS hops, a.edge_id || '>' || b.edge_id AS path FROM edges a JOIN edges b ON a.type = 'PART_OF' AND b.type = 'PART_OF' AND a.dst = b.dst AND CAST(substr(b.src, 7) AS BIGINT) = CAST(substr(a.src, 7) AS BIGINT) + 1", "edges")
def gr05_paths_between(v: Views) -> DataFrame:
    """GR-1, GR-5: paths of up to two edges between each equipment and the next one."""
    key = F.col("s_suppkey")
    pairs = v.table("supplier").select(F.concat(F.lit("equip:"), key).alias("start"), F.concat(F.lit("equip:"), key + 1).alias("end"))
    return paths.paths_between(v.edges, pairs, ["PART_OF"], 2).select("start", "end", "hops", F.array_join("path", ">").alias("path")).withColumn("hops", F.col("hops").cast("bigint"))


@_query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 6")
def flt03_chunks_containing(v: Views) -> DataFrame:
    """FLT-3: a search that gives the first six is the feature."""
    return reads.chunks_containing(v.table("documents").select(F.col("doc_id").alias("id"), "text"), "The")


@_query("SELECT tag_id, (ll <= l AND l <= h AND h <= hh AND l < value AND value < h) AS valid, CAST(count(*) AS BIGINT) AS n FROM telemetry JOIN envelopes USING (tag_id) GROUP BY ALL", "telemetry", "envelopes")
def flt23_limits(v: Views) -> DataFrame:
    """FLT-23: how many readings of a tag would do as its setpoint."""
    valid = reads.valid_limits(*(F.col(c) for c in ("ll", "l", "h", "hh", "value")))
    return v.telemetry.join(v.envelopes, "tag_id").groupBy("tag_id", valid.alias("valid")).agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey AS id, coalesce(decision, 'open') AS decision, due FROM orders LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS decision FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) d ON d.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS due FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) s ON s.l_orderkey = o_orderkey")
def jn10_drafts(v: Views) -> DataFrame:
    lines = v.table("lineitem").withColumnRenamed("l_orderkey", "id")
    decisions = lines.where("l_returnflag <> 'N'").groupBy("id").agg(F.max("l_returnflag").alias("decision"))
    schedules = lines.where("l_linestatus = 'O'").groupBy("id").agg(F.min("l_shipdate").alias("due"))
    return reads.decided(v.table("orders").select(F.col("o_orderkey").alias("id")), decisions, schedules)


@_query("SELECT doc_id AS member, d.lang, coalesce(b.brief, (SELECT min(doc_id) FROM documents WHERE lang = 'en')) AS brief FROM documents d LEFT JOIN (SELECT lang, min(doc_id) AS brief FROM documents WHERE lang IN ('en', 'de') GROUP BY 1) b ON b.lang = d.lang")
def jn18_briefs(v: Views) -> DataFrame:
    docs = v.table("documents")
    briefs = docs.where("lang in ('en', 'de')").groupBy("lang").agg(F.min("doc_id").alias("brief"))
    return reads.briefs_for(docs.select(F.col("doc_id").alias("member"), "lang"), briefs)


@_query("SELECT lang FROM documents WHERE lang IS NOT NULL UNION SELECT 'en'")
def agg23_languages(v: Views) -> DataFrame:
    return reads.crew_languages(v.table("documents"))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'P-' || (100 + o_custkey % 900) END AS unsupported, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n FROM orders")
def set05_unsupported_tags(v: Views) -> DataFrame:
    """SET-5, ETL-30: every third answer's evidence names its tag."""
    tag = F.concat(F.lit("P-"), 100 + F.col("o_custkey") % 900)
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("pump "), tag, F.lit(" and V-12 leak")).alias("claim"), F.concat(F.lit("seen at V-12 "), F.when(F.col("o_orderkey") % 3 == 0, F.lower(tag)).otherwise("")).alias("evidence"))
    return reads.unsupported_tags(rows)


@_query("SELECT ts, tag_id, CASE WHEN value > h THEN 'max' WHEN value < l THEN 'min' END AS level FROM telemetry JOIN envelopes USING (tag_id)", "telemetry", "envelopes")
def mth07_two_level(v: Views) -> DataFrame:
    return v.telemetry.join(v.envelopes, "tag_id").select("ts", "tag_id", reads.level_two(F.col("value"), F.col("l"), F.col("h")).alias("level"))


@_query("SELECT event_id, round(round_even(value / 0.25, 0) * 0.25, 6) AS reading FROM events")
def mth10_quantised(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.round(reads.quantised(F.col("value"), F.lit(0.25)), 6).alias("reading"))


@_query("SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_returnflag) AS source FROM lineitem GROUP BY 1, 2")
def ui16_citations(v: Views) -> DataFrame:
    return reads.citations(v.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("source")))


# --- corrections, outlines, plans -----------------------------------------------------------------

@_query("SELECT id, 'proc:' || p_partkey AS procedure FROM nodes LEFT JOIN part ON id = 'fm:' || (p_partkey % 31) WHERE label = 'FailureMode'", "nodes")
def jn04_procedures(v: Views) -> DataFrame:
    procedures = v.table("part").select(F.concat(F.lit("fm:"), F.col("p_partkey") % 31).alias("mode"), F.concat(F.lit("proc:"), "p_partkey").alias("procedure"))
    return lanes.with_procedures(v.nodes.where("label = 'FailureMode'").select("id"), procedures)


@_query("SELECT DISTINCT 'fm:' || (l_partkey % 25) AS mode, 'equip:' || (l_suppkey * 2) AS area FROM lineitem WHERE 'equip:' || (l_suppkey * 2) IN (SELECT id FROM nodes)", "nodes")
def jn19_deviation_areas(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.concat(F.lit("fm:"), F.col("l_partkey") % 25).alias("mode"), F.concat(F.lit("equip:"), F.col("l_suppkey") * 2).alias("area"))
    return lanes.deviation_edges(rows, v.nodes).select("mode", "area")


@_query("SELECT c.cited, d.filename FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'doc:' ELSE '' END || l_suppkey AS cited, CAST(l_suppkey AS VARCHAR) AS k FROM lineitem) c LEFT JOIN (SELECT CAST(s_suppkey * 2 AS VARCHAR) AS k, s_name AS filename FROM supplier) d ON d.k = c.k")
def prj10_named_citations(v: Views) -> DataFrame:
    cited = v.table("lineitem").select(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "doc:").otherwise(""), "l_suppkey").alias("cited"))
    return lanes.named_citations(cited, v.table("supplier").select((F.col("s_suppkey") * 2).cast("string").alias("doc_id"), F.col("s_name").alias("filename")))


@_query("SELECT event_id AS id, event_type AS tag_id, CAST(user_id AS INTEGER) AS direction, value AS magnitude FROM events WHERE event_id % 4 > 0")
def prj12_library(v: Views) -> DataFrame:
    """PRJ-11, PRJ-12: every fourth signature is no JSON."""
    good = F.to_json(F.array(F.struct(F.col("event_type").alias("tag_id"), F.col("user_id").cast("int").alias("direction"), F.col("value").alias("magnitude"))))
    rows = v.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 > 0, good).otherwise("{oops").alias("signature_json"))
    return lanes.parsed_library(rows).selectExpr("id", "inline(signature)")


@_query("SELECT event_id, 'diag:' || CAST(floor(epoch(ts)) AS BIGINT) || ':TAG-' || user_id AS id FROM events")
def prj15_diagnosis_id(v: Views) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return v.table("events").select("event_id", lanes.diagnosis_id(at, F.concat(F.lit("TAG-"), "user_id")).alias("id"))


_GROUPS = "SELECT 'Mode ' || (l_partkey % 30) AS a, 'mode ' || (l_suppkey % 40) AS b FROM lineitem"


def _proposed(v: Views, a: str, b: str) -> DataFrame:
    return v.table("lineitem").select(F.concat(F.lit("Mode "), F.col("l_partkey") % 30).alias(a), F.concat(F.lit("mode "), F.col("l_suppkey") % 40).alias(b))


@_query(f"WITH g AS ({_GROUPS}), k AS (SELECT DISTINCT upper('mode ' || (l_partkey % 25)) AS x FROM lineitem), s AS (SELECT DISTINCT a, b FROM g WHERE upper(a) IN (FROM k) AND upper(b) IN (FROM k) AND upper(a) <> upper(b)) SELECT a AS canonical, b AS variant FROM s UNION ALL SELECT DISTINCT a, NULL FROM g WHERE upper(a) IN (FROM k) AND a NOT IN (SELECT a FROM s)")
def flt19_valid_groups(v: Views) -> DataFrame:
    return lanes.valid_groups(_proposed(v, "canonical", "variant"), v.nodes.where("label = 'FailureMode'").select(F.col("surface_form").alias("label")))


@_query(f"WITH k AS (SELECT DISTINCT upper('mode ' || (l_partkey % 25)) AS x FROM lineitem) SELECT a AS cause, b AS effect FROM ({_GROUPS}) WHERE upper(a) IN (FROM k) AND upper(b) IN (FROM k) AND upper(a) <> upper(b)")
def flt19_valid_links(v: Views) -> DataFrame:
    return lanes.valid_links(_proposed(v, "cause", "effect"), v.nodes.where("label = 'FailureMode'").select(F.col("surface_form").alias("label")))


@_query("SELECT l_orderkey AS drawing, l_partkey % 9 AS src, l_suppkey % 9 AS dst FROM lineitem l WHERE l_partkey % 9 <> l_suppkey % 9 AND EXISTS (FROM lineitem c WHERE c.l_orderkey = l.l_orderkey AND c.l_linenumber = l.l_partkey % 9) AND EXISTS (FROM lineitem c WHERE c.l_orderkey = l.l_orderkey AND c.l_linenumber = l.l_suppkey % 9)")
def flt20_connections(v: Views) -> DataFrame:
    lines = v.table("lineitem").withColumnRenamed("l_orderkey", "drawing")
    return lanes.connections(lines.select("drawing", (F.col("l_partkey") % 9).alias("src"), (F.col("l_suppkey") % 9).alias("dst")), lines.select("drawing", F.col("l_linenumber").cast("bigint").alias("tag"))).select("drawing", "src", "dst")


@_query("SELECT o_orderkey AS doc_id, o_custkey AS page, CAST(1 AS INTEGER) AS line_no, (o_custkey % 7) || repeat('.2', CAST(o_orderkey % 6 AS INTEGER)) || ' Scope ' || o_orderstatus AS title, CAST(least(o_orderkey % 6 + 1, 4) AS INTEGER) AS level FROM orders")
def str20_outline(v: Views) -> DataFrame:
    """STR-20: pages with one heading between lines that are none."""
    heading = F.concat(F.lit("  "), (F.col("o_custkey") % 7).cast("string"), F.expr("repeat('.2', cast(o_orderkey % 6 as int))"), F.lit(" Scope "), "o_orderstatus")
    text = F.concat_ws("\n", F.lit("Body of 3 lines"), heading, F.concat(F.lit("4 "), F.repeat(F.lit("x"), 95)), F.lit("12."))
    return lanes.outline(v.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("page"), text.alias("text")))


@_query("WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS nth, min(l_partkey) % 4 + 1 AS level, (l_linenumber + 1) // 2 * 3 AS page FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT doc_id, nth, level, page AS page_start, greatest(coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY nth) - 1, 14), page) AS page_end, coalesce(e.doc_id || '#sec' || (SELECT max(p.nth) FROM e p WHERE p.doc_id = e.doc_id AND p.nth < e.nth AND p.level < e.level), CAST(e.doc_id AS VARCHAR)) AS parent FROM e")
def win07_sections(v: Views) -> DataFrame:
    """WIN-7: a line number that an order repeats is one entry."""
    lines = v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    entries = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("nth"), (F.col("l_partkey") % 4 + 1).alias("level"), F.expr("(l_linenumber + 1) div 2 * 3").alias("page"))
    return lanes.sections(entries, v.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(14).alias("n_pages")))


@_query("SELECT DISTINCT l_orderkey AS id, doc FROM (SELECT l_orderkey, 'doc:' || (l_partkey % 50) AS doc FROM lineitem UNION ALL SELECT l_orderkey, 'doc:' || (l_suppkey % 9) FROM lineitem WHERE l_returnflag <> 'N')")
def etl31_trace_documents(v: Views) -> DataFrame:
    named = lambda c, n: F.concat(F.lit("doc:"), F.col(c) % n)
    return lanes.trace_documents(v.table("lineitem").select(F.col("l_orderkey").alias("id"), named("l_partkey", 50).alias("doc_id"), F.when(F.col("l_returnflag") != "N", F.array(named("l_suppkey", 9))).alias("docs")))


@_query("SELECT id, status, first_ts, latest FROM (SELECT user_id AS id, event_type AS status, min(ts) AS first_ts FROM events GROUP BY 1, 2) JOIN (SELECT user_id AS id, arg_max(event_type, (ts, event_type)) AS latest FROM events GROUP BY 1) USING (id)")
def etl34_assignments(v: Views) -> DataFrame:
    return lanes.assignments(v.table("events").select(F.col("user_id").alias("id"), "ts", F.col("event_type").alias("status")))


@_query("SELECT o_orderkey AS id, coalesce(m, 0.0) AS coverage, coalesce(d, false) AS all_covered, o_custkey - o_orderkey % 5 AS undigested FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS m, bool_and(l_linestatus = 'F') AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def etl35_coverage(v: Views) -> DataFrame:
    topics = v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("coverage"), F.when(F.col("l_linestatus") == "F", "covered").otherwise("open").alias("status"))
    return lanes.coverage(topics, v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("n_turns"), (F.col("o_orderkey") % 5).alias("cursor")))


@_query("SELECT coalesce(CASE WHEN user_id % 2 = 0 THEN 'a' || user_id END, event_type) AS key, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY 1")
def ui06_upserted(v: Views) -> DataFrame:
    return lanes.upserted(v.table("events").select(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("a"), "user_id")).alias("id"), F.col("event_type").alias("fingerprint"), "ts", F.col("event_type").alias("status")))


@_query("SELECT c_custkey AS alert_id, min(o_orderkey) AS investigation FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def ui08_investigations(v: Views) -> DataFrame:
    return lanes.with_investigation(v.table("customer").select(F.col("c_custkey").alias("alert_id")), v.table("orders").select(F.col("o_custkey").alias("alert_ref"), F.col("o_orderkey").alias("id")))
