"""Queries of unit watchers, answers and agents over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import answers
from millrace.plans.catalog import query
from millrace.plans.views import NOW, Views
from millrace.streaming import units


def _key(prefix: str, column: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.col(column) if isinstance(column, str) else column)


def _seconds(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


# --- unit watchers ---------------------------------------------------------------------------

_QUALITY = "CASE user_id % 11 WHEN 0 THEN 'BAD' WHEN 1 THEN 'UNCERTAIN' ELSE 'GOOD' END"
_SAID = f"""e AS (SELECT 'U' || (user_id % 40) AS tag_id, epoch_us(ts) / 1e6 AS ts, value, {_QUALITY} AS quality FROM events),
 x AS (SELECT tag_id, ts, 'STATUS_' || quality AS rule, CAST(NULL AS DOUBLE) AS value, true AS breach FROM e WHERE quality <> 'GOOD'
  UNION ALL SELECT tag_id, ts, 'HH_EXCEEDED', value, value > 120 FROM e WHERE quality <> 'BAD' AND (value > 120 OR value <= 70)
  UNION ALL SELECT tag_id, ts, 'H_EXCEEDED', value, value > 70 FROM e WHERE quality <> 'BAD' AND value <= 120
  UNION ALL SELECT tag_id, ts, 'LL_EXCEEDED', value, value < 5 FROM e WHERE quality <> 'BAD' AND (value < 5 OR value >= 12)
  UNION ALL SELECT tag_id, ts, 'L_EXCEEDED', value, value < 12 FROM e WHERE quality <> 'BAD' AND value >= 5)"""


def _opened(events: str, key: str = "tag_id, rule") -> str:
    """SQL of alarms: each breach with the newest clear sample before the next one."""
    return f"""WITH {events}, s AS (SELECT *, count(*) FILTER (WHERE breach) OVER (PARTITION BY {key} ORDER BY ts, NOT breach, coalesce(abs(value), -1) ROWS UNBOUNDED PRECEDING) AS n FROM x),
 b AS (SELECT {key}, n, max(ts) FILTER (WHERE breach) AS ts, max(value) FILTER (WHERE breach) AS value, max(ts) FILTER (WHERE NOT breach) AS clear FROM s WHERE n > 0 GROUP BY ALL),
 f AS (SELECT *, CASE WHEN n = 1 OR lag(clear - ts) OVER (PARTITION BY {key} ORDER BY n) >= 30 THEN 1 ELSE 0 END AS opens FROM b),
 a AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY n) AS alarm FROM f)
 SELECT tag_id, rule, min(ts) AS opened, max(ts) AS last_seen, arg_min(value, n) AS value, max(value) AS peak FROM a GROUP BY {key}, alarm"""


def _unit_samples(v: Views) -> DataFrame:
    quality = F.when(F.col("user_id") % 11 == 0, "BAD").when(F.col("user_id") % 11 == 1, "UNCERTAIN").otherwise("GOOD")
    return v.table("events").select(_key("U", F.col("user_id") % 40).alias("tag_id"), _seconds("ts").alias("ts"), "value", quality.alias("quality"))


def _unit_events(v: Views) -> DataFrame:
    return units.rule_events(_unit_samples(v).withColumns({"ll": F.lit(5.0), "l": F.lit(12.0), "h": F.lit(70.0), "hh": F.lit(120.0)}))


@query(_opened(_SAID))
def stm06_column_alarms(v: Views) -> DataFrame:
    """STM-6: four strict levels and the quality of samples, each rule with its own alarm."""
    return units.rule_alarms(_unit_events(v))


_RISES = ", d AS (SELECT *, ts - lag(ts) OVER w AS gap, value - lag(value) OVER w AS rise FROM e WHERE quality <> 'BAD' WINDOW w AS (PARTITION BY tag_id ORDER BY ts, value))"


@query(_opened(_SAID.replace(" x AS (", " x0 AS (") + _RISES + ", x AS (FROM x0 UNION ALL SELECT tag_id, ts, 'RATE_OF_RISE', rise / gap, rise / gap > 0.001 FROM d WHERE gap > 0)"))
def stm05_reactor_alarms(v: Views) -> DataFrame:
    """STM-5: the same with the rate of rise."""
    return units.rule_alarms(_unit_events(v).unionByName(units.rise_events(_unit_samples(v), 0.001)))


_RESETS = "z AS (SELECT epoch_us(ts) / 1e6 AS ts FROM events WHERE event_id % 97 = 0)"


@query(_opened(_SAID.replace(" x AS (", " x0 AS (") + f", {_RESETS}, zz AS (SELECT DISTINCT x0.ts, (SELECT count(*) FROM z WHERE z.ts <= x0.ts) AS generation FROM x0), x AS (SELECT x0.*, generation FROM x0 JOIN zz USING (ts))", "tag_id, rule, generation"))
def stm03_reset_alarms(v: Views) -> DataFrame:
    """STM-3: every reset closes all alarms."""
    resets = v.table("events").where("event_id % 97 = 0").select(_seconds("ts").alias("ts"))
    return units.rule_alarms(units.with_generation(_unit_events(v), resets))


@query("SELECT e.event_id, e.value > c.h AS high, c.ts AS since FROM (SELECT event_id, 'U' || (user_id % 40) AS tag_id, epoch_us(ts) / 1e6 AS ts, value FROM events) e ASOF JOIN (SELECT 'U' || (user_id % 40) AS tag_id, epoch_us(ts) / 1e6 AS ts, max(value) AS h FROM events WHERE event_type = 'signup' GROUP BY ALL) c ON e.tag_id = c.tag_id AND e.ts >= c.ts")
def stm04_live_limits(v: Views) -> DataFrame:
    """STM-4: each sample against the newest limits of its time; a limit's ll holds its time here."""
    rows = v.table("events").select("event_id", "event_type", _key("U", F.col("user_id") % 40).alias("tag_id"), _seconds("ts").alias("ts"), "value")
    changes = rows.where("event_type = 'signup'").groupBy("tag_id", "ts").agg(F.max("value").alias("h"))
    limits = changes.select("tag_id", "ts", F.col("ts").alias("ll"), F.lit(None).cast("double").alias("l"), "h", F.lit(None).cast("double").alias("hh"))
    return units.with_live_limits(rows.drop("event_type"), limits).select("event_id", (F.col("value") > F.col("h")).alias("high"), F.col("ll").alias("since"))


# --- reads for answers -----------------------------------------------------------------------


@query(
    """, k AS (SELECT * FROM nodes), q AS (SELECT c_custkey AS question_id, c_custkey % 4 AS form, c_custkey % 30 AS n FROM customer),
 p AS (SELECT question_id, 'area:' || n AS id FROM q WHERE form < 2 AND n < 25 UNION ALL
 SELECT question_id, id FROM (SELECT question_id, k.id, row_number() OVER (PARTITION BY question_id ORDER BY k.id) AS r FROM q JOIN k ON form = 1 AND contains(lower(k.surface_form), 'is-1' || (100 + n))) WHERE r <= 3 UNION ALL
 SELECT question_id, id FROM (SELECT question_id, k.id, row_number() OVER (PARTITION BY question_id ORDER BY k.id) AS r FROM q JOIN k ON contains(lower(k.surface_form), 'tank farm') AND form = 2) WHERE r <= 2) SELECT DISTINCT question_id, id FROM p""".replace("SELECT * FROM nodes", "SELECT id, label, CASE WHEN label = 'Line' THEN 'P-1' || (100 + CAST(substr(id, 6) AS INT)) ELSE surface_form END AS surface_form FROM nodes UNION ALL SELECT DISTINCT 'reg:c' || o_custkey, 'RegulationClause', 'IS-1' || (100 + o_custkey % 30) || ' part' FROM orders UNION ALL SELECT 'line:' || n_nationkey, 'Line', 'North tank farm ' || n_nationkey FROM nation"),
    "nodes",
)
def str12_linked(v: Views) -> DataFrame:
    """STR-12: questions that name a tag, a tag and a standard, a title-case phrase only, or nothing."""
    n, form = F.col("c_custkey") % 30, F.col("c_custkey") % 4
    tag, code = _key("P-1", 100 + n), _key("IS 1", 100 + n)
    text = F.when(form == 0, F.concat(F.lit("why did "), tag, F.lit(" trip"))).when(form == 1, F.concat(F.lit("is "), tag, F.lit(" inspected to "), code, F.lit("?"))).when(form == 2, "tell me of the Tank Farm please").otherwise("what is overdue")
    surface = F.when(F.col("label") == "Line", _key("P-1", 100 + F.expr("cast(substring(id, 6) as int)"))).otherwise(F.col("surface_form"))
    clauses = v.table("orders").select(_key("reg:c", "o_custkey").alias("id"), F.lit("RegulationClause").alias("label"), F.concat(F.lit("IS-1"), 100 + F.col("o_custkey") % 30, F.lit(" part")).alias("surface_form"))
    places = v.table("nation").select(_key("line:", "n_nationkey").alias("id"), F.lit("Line").alias("label"), _key("North tank farm ", "n_nationkey").alias("surface_form"))
    nodes = v.nodes.select("id", "label", surface.alias("surface_form")).union(clauses.distinct()).union(places)
    return answers.linked(v.table("customer").select(F.col("c_custkey").alias("question_id"), text.alias("text")), nodes)


_WORDS = ["gasket leak", "Seal wear", "FIRE", "overpressure", "vibration", "cavitation", "overheating", "corrosion", "electrical", "nothing"]
_HAZARD_SQL = ", ".join(f"('{w}', '{h}')" for w, h in answers.HAZARDS.items())


@query(f"SELECT DISTINCT id, hazard FROM (SELECT l_suppkey AS id, lower(list_extract({_WORDS}, l_partkey % 10 + 1) || '/' || list_extract({_WORDS}, l_orderkey % 10 + 1)) AS text FROM lineitem) JOIN (VALUES {_HAZARD_SQL}) h(word, hazard) ON contains(text, word)")
def str17_hazards(v: Views) -> DataFrame:
    words = F.array(*(F.lit(w) for w in _WORDS))
    of = lambda c: F.element_at(words, (F.col(c) % 10 + 1).cast("int"))
    return answers.hazards(v.table("lineitem").select(F.col("l_suppkey").alias("id"), of("l_partkey").alias("mode"), of("l_orderkey").alias("cause")))


@query("SELECT id, CASE tool WHEN 0 THEN 'isolation_points' WHEN 1 THEN 'governing_clauses' ELSE 'procedures_to_follow' END AS field, min(nth) AS nth, value FROM (SELECT l_orderkey AS id, l_partkey % 4 AS tool, l_linenumber AS nth, 'v' || (l_suppkey % 5) AS value FROM lineitem) WHERE tool < 3 AND value <> 'v0' GROUP BY ALL")
def jn20_harvested(v: Views) -> DataFrame:
    """JN-20: every fourth row is of another tool, every fifth value is empty."""
    names = F.array(*(F.lit(t) for t in ("get_connected_equipment", "get_governing_clauses", "get_fix_procedures", "get_failure_history")))
    value = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(_key("v", F.col("l_suppkey") % 5))
    return answers.harvested(v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(names, (F.col("l_partkey") % 4 + 1).cast("int")).alias("tool"), F.col("l_linenumber").alias("nth"), value.alias("value")))


@query("""WITH s AS (SELECT l_suppkey AS q, l_discount AS score, l_orderkey AS path, l_linenumber AS nth, CASE WHEN l_returnflag <> 'R' THEN 'doc:' || (l_partkey % 60) END AS doc_id, l_partkey % 7 AS page FROM lineitem),
 k AS (SELECT 'doc:' || (o_custkey % 50) AS doc_id, o_orderkey AS seq, o_orderkey % 5 AS page FROM orders),
 c AS (SELECT q, score, path, nth, coalesce('c' || (SELECT min(seq) FROM k WHERE k.doc_id = s.doc_id AND k.page = s.page), 'c' || (SELECT min(seq) FROM k WHERE k.doc_id = s.doc_id), 'edge:' || doc_id || ':' || page || ':HAS_FAILURE') AS chunk_id FROM s WHERE doc_id IS NOT NULL),
 o AS (SELECT q, chunk_id, min((score, path, nth)) AS place FROM c GROUP BY ALL)
 SELECT q AS question_id, CAST(r AS INTEGER) AS rank, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, chunk_id) AS r FROM o) WHERE r <= 8""")
def gr08_evidence(v: Views) -> DataFrame:
    steps = v.table("lineitem").select(F.col("l_suppkey").alias("question_id"), F.col("l_discount").alias("score"), F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("nth"), F.lit("HAS_FAILURE").alias("type"), F.when(F.col("l_returnflag") != "R", _key("doc:", F.col("l_partkey") % 60)).alias("doc_id"), (F.col("l_partkey") % 7).alias("page"))
    chunks = v.table("orders").select(_key("doc:", F.col("o_custkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 5).alias("page"), _key("c", "o_orderkey").alias("chunk_id"))
    return answers.evidence(steps, chunks)


@query(f"SELECT tag_id, level, ts, value, diagnosis FROM (SELECT 'U' || (user_id % 40) AS tag_id, user_id % 3 AS level, max(ts) AS ts, arg_max(value, (ts, value)) AS value FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND GROUP BY ALL) LEFT JOIN (SELECT 'U' || (user_id % 50) AS tag_id, arg_max(event_id, (ts, event_id)) AS diagnosis FROM events WHERE event_type = 'error' GROUP BY 1) USING (tag_id)")
def etl26_asset_context(v: Views) -> DataFrame:
    tag = lambda n: _key("U", F.col("user_id") % n).alias("tag_id")
    kind = F.when(F.col("event_type") == "view", "compliance").otherwise("process_limit").alias("kind")
    alarms = v.table("events").select(tag(40), kind, (F.col("user_id") % 3).alias("level"), "value", F.col("ts").cast("timestamp_ntz").alias("ts"))
    found = v.table("events").where("event_type = 'error'").select(tag(50), F.col("event_id").alias("diagnosis"), "ts")
    return answers.asset_context(alarms, found, F.lit(NOW).cast("timestamp_ntz"), 86_400)


@query("SELECT 'P-' || s AS tag, 'failure:P-' || s || ':Mode ' || m || ':' || n AS claim, unnest(['what should I do about P-' || s || ' mode ' || m || '?', 'P-' || s || ' failure history and recommendation', 'is the P-' || s || ' failure related to its sibling equipment?']) AS question FROM (SELECT l_suppkey AS s, l_partkey % 25 AS m, count(*) AS n FROM lineitem GROUP BY ALL)")
def etl32_speculative_questions(v: Views) -> DataFrame:
    """ETL-32, STM-14."""
    counted = v.table("lineitem").groupBy(_key("P-", "l_suppkey").alias("tag"), _key("Mode ", F.col("l_partkey") % 25).alias("mode")).agg(F.count("*").alias("count"))
    return answers.speculative_questions(counted.union(counted))


def _mentions(v: Views) -> DataFrame:
    """Customers and their orders as people and documents, orders and their suppliers as documents and equipment."""
    people = v.table("orders").select(_key("m", "o_orderkey").alias("edge_id"), _key("person:", "o_custkey").alias("src"), F.lit("MENTIONED_IN").alias("type"), _key("wo:", "o_orderkey").alias("dst"))
    lines = v.table("lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("edge_id"), _key("equip:", "l_suppkey").alias("src"), F.lit("MENTIONED_IN").alias("type"), _key("wo:", "l_orderkey").alias("dst"))
    return people.union(lines)


@query("SELECT DISTINCT 'order ' || o_orderkey AS doc FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(lower(c_name), '#00000001') ORDER BY doc LIMIT 10")
def flt11_person_documents(v: Views) -> DataFrame:
    people = v.table("customer").select(_key("person:", "c_custkey").alias("id"), F.lit("Person").alias("label"), F.col("c_name").alias("surface_form"))
    papers = v.table("orders").select(_key("wo:", "o_orderkey").alias("id"), F.lit("Document").alias("label"), _key("order ", "o_orderkey").alias("surface_form"))
    return answers.person_documents(people.union(papers), _mentions(v), "CUSTOMER#00000001")


@query("SELECT 'wo:' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, coalesce(e, '') AS equipment FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS e FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) ON l_orderkey = o_orderkey")
def jn16_order_details(v: Views) -> DataFrame:
    """JN-16: equipment one mention away; what is two away are other orders."""
    orders = v.table("orders").select(_key("wo:", "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return answers.order_details(orders, _mentions(v).where("src like 'equip:%'"), v.table("supplier").select(_key("equip:", "s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(", f AS (SELECT src, dst FROM edges WHERE type IN ('PART_OF', 'CONNECTED_TO')) SELECT tag, unit, CAST(count(*) AS BIGINT) AS n FROM (SELECT src AS tag, dst AS unit FROM f UNION ALL SELECT a.src, b.dst FROM f a JOIN f b ON a.dst = b.src) GROUP BY ALL", "edges")
def gr03_feeds(v: Views) -> DataFrame:
    """GR-3: units fed in one or two steps."""
    return answers.downstream(v.edges.where("type in ('PART_OF', 'CONNECTED_TO')").withColumn("type", F.lit("FEEDS"))).groupBy("tag", "unit").agg(F.count("*").alias("n"))


_DRAFTS = "SELECT equipment, standard, CASE WHEN line % 3 = 0 THEN '' ELSE 'Thickness Check' END AS kind, next_due, CASE WHEN line % 2 = 0 THEN date END AS last, CASE WHEN line = 5 THEN '2019' ELSE '' END AS rev, line % 4 = 0 AS over FROM work_orders"


@query(f""", d AS (SELECT *, CASE WHEN kind = '' THEN 'Inspection' ELSE kind END AS k FROM ({_DRAFTS})) SELECT equipment, standard, 'PM02' AS order_type, CASE WHEN over THEN 'high' ELSE 'medium' END AS priority,
 k || ' of ' || equipment || ' required by ' || standard || CASE WHEN over THEN ' was due ' ELSE ' falls due ' END || next_due || coalesce('; last carried out ' || last, '') || '.' AS root_cause,
 'Carry out the ' || lower(k) || ' of ' || equipment || ' to ' || standard || CASE WHEN rev <> '' THEN ' (revision ' || rev || ')' ELSE '' END || '. Record the result against the asset so the next due date rolls forward.' AS recommended_fix FROM d""", "work_orders")
def prj16_inspection_draft(v: Views) -> DataFrame:
    line = F.col("line")
    return answers.inspection_draft(v.work_orders.select("equipment", "standard", F.when(line % 3 == 0, "").otherwise("Thickness Check").alias("inspection_type"), "next_due", F.when(line % 2 == 0, F.col("date")).alias("last_inspection"), F.when(line == 5, "2019").otherwise("").alias("revision"), F.when(line % 4 == 0, "overdue").otherwise("scheduled").alias("status")))


# --- writes ----------------------------------------------------------------------------------


@query("""SELECT 'equip:P-' || (100 + l_suppkey % 900) AS src, 'GOVERNED_BY' AS type, 'reg:is-' || (l_partkey % 30) AS dst, l_linenumber AS page, l_returnflag AS result, l_linestatus AS next_due FROM lineitem WHERE l_suppkey % 5 > 0 AND l_partkey % 3 > 0
 UNION ALL SELECT 'equip:P-' || (100 + l_suppkey % 900), 'MENTIONED_IN', 'doc:' || l_orderkey, l_linenumber, NULL, NULL FROM lineitem WHERE l_suppkey % 5 > 0""")
def etl03_inspection_edges(v: Views) -> DataFrame:
    tag = F.when(F.col("l_suppkey") % 5 > 0, _key("p ", 100 + F.col("l_suppkey") % 900)).otherwise("")
    standard = F.when(F.col("l_partkey") % 3 > 0, _key("IS ", F.col("l_partkey") % 30)).otherwise("")
    return answers.inspection_edges(v.table("lineitem").select(F.col("l_linenumber").alias("row"), _key("doc:", "l_orderkey").alias("doc_id"), tag.alias("equipment_tag"), standard.alias("standard"), F.col("l_returnflag").alias("result"), F.col("l_linestatus").alias("next_due")))


@query("SELECT 'equip:P-' || (100 + l_suppkey % 900) AS src, ['HAS_FAILURE', 'FIXED_BY', 'GOVERNED_BY'][l_partkey % 4 + 1] AS type, ['fm', 'proc', 'reg'][l_partkey % 4 + 1] || ':item-' || (l_partkey % 30) AS dst, CASE WHEN l_partkey % 4 = 0 AND l_returnflag <> 'N' THEN l_returnflag END AS cause, l_discount AS confidence FROM lineitem WHERE l_suppkey % 5 > 0 AND l_partkey % 4 < 3")
def etl09_finding_edges(v: Views) -> DataFrame:
    """ETL-9: every fifth tag is none, every fourth kind unknown."""
    kinds = F.array(*(F.lit(k) for k in ("failure", "procedure", "regulation", "rumour")))
    tag = F.when(F.col("l_suppkey") % 5 > 0, _key("p", 100 + F.col("l_suppkey") % 900)).otherwise("the pump")
    cause = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    return answers.finding_edges(v.table("lineitem").select(F.element_at(kinds, (F.col("l_partkey") % 4 + 1).cast("int")).alias("kind"), tag.alias("equipment_tag"), _key(" Item ", F.col("l_partkey") % 30).alias("name"), cause.alias("cause"), F.col("l_discount").alias("confidence")))


def _with_references(v: Views) -> DataFrame:
    surface = F.when((F.col("label") == "Equipment") & F.expr("substring(id, 7) % 3 = 0"), _key("IR-2024-0", F.substring("id", 7, 9))).otherwise(F.col("surface_form"))
    return v.nodes.withColumn("surface_form", surface)


_GONE = ", g AS (SELECT 'equip:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0 AND NOT EXISTS (FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = 7 AND l_suppkey % 2 = 0))"
_HUMAN = "type = 'PART_OF' OR source <> 'human' OR substring(src, 7) % 2 = 0"


@query(f"{_GONE} SELECT 'node' AS kind, id FROM nodes WHERE id NOT IN (FROM g) UNION ALL SELECT 'edge', edge_id FROM edges WHERE ({_HUMAN.replace('substring(src, 7)', 'CAST(substr(src, 7) AS INT)')}) AND src NOT IN (FROM g) AND dst NOT IN (FROM g)", "nodes", "edges")
def etl16_pruned_graph(v: Views) -> DataFrame:
    """ETL-16: a third of the equipment are references; a human touched some of even number."""
    nodes, edges = answers.pruned_graph(_with_references(v), v.edges.where(_HUMAN))
    return nodes.select(F.lit("node").alias("kind"), "id").union(edges.select(F.lit("edge"), "edge_id"))


@query("SELECT id AS src, CASE WHEN id IN ('fm:1', 'fm:2') THEN 'fm:0' END AS dst, label = 'FailureMode' AND id IN ('fm:1', 'fm:2') AS superseded FROM nodes", "nodes")
def etl17_superseded_modes(v: Views) -> DataFrame:
    """ETL-17: two known variants, named twice, and one that is unknown."""
    pairs = v.nodes.where("id in ('fm:1', 'fm:2')").select(F.col("id").alias("variant"), F.lit("fm:0").alias("canonical"))
    unknown = v.table("region").select(_key("fm:new", "r_regionkey").alias("variant"), F.lit("fm:0").alias("canonical"))
    nodes, into = answers.superseded_modes(v.nodes, pairs.union(pairs).union(unknown))
    return nodes.select(F.col("id").alias("src"), "superseded").join(into.select("src", "dst"), "src", "left").select("src", "dst", "superseded")


# --- projections and filters -----------------------------------------------------------------


@query("SELECT id, label, surface_form AS name, CASE WHEN label = 'Line' THEN 'note=x' ELSE '' END AS props FROM nodes", "nodes")
def prj06_light_nodes(v: Views) -> DataFrame:
    """PRJ-4, PRJ-6, PRJ-7."""
    text = lambda c: F.lit(c).cast("string")
    props = F.when(F.col("label") == "Line", F.create_map(text("note"), text("x"), text("embedding"), text("y"))).otherwise(F.create_map(text("text"), text("z")))
    full = v.nodes.select("id", F.array(F.lit("Entity"), "label").alias("labels"), F.when(F.col("label") != "Line", F.col("surface_form")).alias("surface_form"), F.col("surface_form").alias("name"), props.alias("props"))
    return answers.light_nodes(full).select("id", "label", "name", F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("props"))


@query("SELECT 'doc:' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN lang || doc_id ELSE source END AS filename FROM documents")
def src19_documents(v: Views) -> DataFrame:
    filename = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", "doc_id"))
    papers = v.table("documents").select(_key("doc:", "doc_id").alias("id"), F.lit("Document").alias("label"), filename.alias("filename"), F.col("source").alias("surface_form"))
    return answers.documents(papers.unionByName(v.nodes, allowMissingColumns=True))


@query("SELECT 'dlq:' || user_id AS fingerprint, 'system' AS kind, 'error' AS severity, 'Background Task Failed: ' || arg_min(event_type, (ts, event_type, props)) AS title, arg_min(props, (ts, event_type, props)) AS error FROM events GROUP BY user_id")
def etl38_failed_tasks(v: Views) -> DataFrame:
    return answers.failed_task_alerts(v.table("events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("task"), F.col("props").alias("error"), "ts"))


@query("SELECT 'TAG-' || c_custkey AS tag_id, coalesce(x, 0.5) AS value FROM customer LEFT JOIN (SELECT tag_id, arg_max(value, (ts, value)) AS x FROM telemetry GROUP BY 1) ON tag_id = 'TAG-' || c_custkey", "telemetry")
def etl37_latest_or(v: Views) -> DataFrame:
    return answers.latest_or(v.telemetry, v.table("customer").select(_key("TAG-", "c_custkey").alias("tag_id"), F.lit(0.5).alias("fallback")))


@query("SELECT event_id AS entry_id, CASE WHEN user_id % 3 = 0 THEN 'process_limit' ELSE 'tep_alarm' END AS handler FROM events WHERE event_type NOT IN ('view', 'click') AND user_id % 3 < 2 AND user_id % 5 > 0")
def stm15_routed(v: Views) -> DataFrame:
    """STM-15: some payloads are of another kind, investigations, without rule and tag, or no JSON."""
    user = F.col("user_id")
    kind = F.when(F.col("event_type") == "view", "compliance").otherwise("process_limit")
    payload = F.to_json(F.struct(kind.alias("kind"), F.when(F.col("event_type") == "click", "investigation").alias("type"), F.when(user % 3 == 0, "HH").alias("rule"), F.when(user % 3 == 1, "T").otherwise("").alias("tag_id")))
    return answers.routed(v.table("events").select(F.col("event_id").alias("entry_id"), F.when(user % 5 == 0, "{").otherwise(payload).alias("payload")))


@query("SELECT tag_id, CAST(count(*) AS BIGINT) AS n FROM telemetry WHERE tag_id LIKE 'TAG-1%' OR tag_id LIKE 'TAG-25%' GROUP BY 1", "telemetry")
def flt21_units(v: Views) -> DataFrame:
    return v.telemetry.where(answers.in_units(F.col("tag_id"), "TAG-1", "TAG-25")).groupBy("tag_id").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN user_id % 4 = 0 THEN 'Unknown' WHEN user_id % 4 = 1 THEN 'E' || (user_id % 7) ELSE 'T' || (user_id % 9) END AS lane, CAST(count(*) AS BIGINT) AS n, min(epoch_us(date_trunc('second', ts)) / 1e6) AS first FROM events GROUP BY 1")
def ui09_swimlanes(v: Views) -> DataFrame:
    """UI-9: times as seconds, milliseconds and ISO text."""
    user, second = F.col("user_id"), F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = F.when(user % 3 == 0, second.cast("string")).when(user % 3 == 1, (second * 1000).cast("string")).otherwise(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"))
    tag = F.when(user % 4 > 1, _key("T", user % 9)).otherwise("")
    return answers.swimlanes(v.table("events").select(tag.alias("tag_id"), F.lit("").alias("unit"), F.when(user % 4 == 1, _key("E", user % 7)).alias("equipment"), raw.alias("ts")))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY ts DESC, value) AS nth FROM telemetry) SELECT x.tag_id AS x_tag, y.tag_id AS y_tag, CAST(x.nth AS INTEGER) AS nth, x.value AS x, y.value AS y FROM nation JOIN r x ON x.tag_id = 'TAG-' || n_nationkey JOIN r y ON y.tag_id = 'TAG-' || (n_nationkey + 1) AND x.nth = y.nth WHERE x.nth <= 50", "telemetry")
def ui10_portrait(v: Views) -> DataFrame:
    pairs = v.table("nation").select(_key("TAG-", "n_nationkey").alias("x_tag"), _key("TAG-", F.col("n_nationkey") + 1).alias("y_tag"))
    return answers.portrait(v.telemetry, pairs, 50)


@query("SELECT event_id FROM events WHERE event_type = 'error' AND (contains('u' || user_id, 'u1') OR contains('area ' || (user_id % 8), 'a 5'))")
def ui15_searched(v: Views) -> DataFrame:
    """UI-15: a text in a column or in an element of an array."""
    rows = v.table("events").select("event_id", F.col("event_type").alias("status"), F.concat(F.lit("U"), "user_id").alias("equipment"), F.array(F.lit("Plant"), F.concat(F.lit("Area "), F.col("user_id") % 8)).alias("unit_areas"))
    one = answers.searched(rows, ["equipment", "unit_areas"], "u1", status="error")
    return one.union(answers.searched(rows, ["equipment", "unit_areas"], "A 5", status="error")).select("event_id").distinct()


@query("SELECT event_id, user_id % 3 > 0 AND user_id % 5 IN (0, 1, 4) AS cacheable FROM events")
def flt22_cacheable(v: Views) -> DataFrame:
    personas = F.array(*(F.lit(p).cast("string") for p in (None, "Engineer", "Shift-Supervisor", "field operator", "Design Engg")))
    user = F.col("user_id")
    return v.table("events").select("event_id", answers.is_cacheable(F.when(user % 3 == 0, "alert"), F.element_at(personas, (user % 5 + 1).cast("int"))).alias("cacheable"))


@query("SELECT l_orderkey AS id, string_agg(CASE WHEN l_partkey % 60 < 50 THEN 'file ' || (l_partkey % 60) ELSE 'hash' END, ',' ORDER BY l_linenumber, l_partkey) AS names FROM lineitem GROUP BY 1")
def snk10_renamed_citations(v: Views) -> DataFrame:
    """SNK-10: citations in their order; a sixth of the documents have no name."""
    one = F.struct("l_linenumber", "l_partkey")
    lists = v.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("lines"))
    cited = lists.select("id", F.transform("lines", lambda x: F.struct((x["l_partkey"] % 60).alias("doc_id"), F.lit("hash").alias("filename"))).alias("citations"))
    names = v.table("lineitem").select((F.col("l_partkey") % 60).alias("doc_id")).where("doc_id < 50").distinct().select("doc_id", _key("file ", "doc_id").alias("filename"))
    return answers.renamed_citations(cited, names).select("id", F.array_join(F.transform("citations", lambda c: c["filename"]), ",").alias("names"))


@query("SELECT tag_id, band, low, high FROM (SELECT tag_id, unnest(['high', 'above', 'below', 'low']) AS band, unnest([h, l + 1, l, ll]) AS low, unnest([hh, h, l + 1, l]) AS high FROM envelopes)", "telemetry", "envelopes")
def ui11_limit_bands(v: Views) -> DataFrame:
    """UI-11: a setpoint one above the lower limit."""
    return answers.limit_bands(v.envelopes.withColumn("setpoint", F.col("l") + 1))
