"""Queries over the plant's graph and its alerts, with their SQL written from the rules of the data model."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import shared_folder, written
from millrace.operators import alerts, diagnosis, graph, lanes, mail, manuals, paths, reads, retrieval
from millrace.plans.catalog import query as _query
from millrace.plans.views import Views
from millrace.streaming import detector
from millrace.streaming.answers import AnswerCache
from millrace.streaming.entries import EntryLog
from millrace.streaming.writer import GraphWriter

# All trails of up to four edges from each seed, under causal (c false) and compliance types, with flow scores.
_ALL_TRAILS = """, u AS (SELECT edge_id, type, src, dst, confidence, src AS a, dst AS z FROM plant_edges UNION ALL SELECT edge_id, type, src, dst, confidence, dst, src FROM plant_edges WHERE src <> dst),
 ct AS (SELECT c, type FROM (SELECT unnest([false, true]) AS c), (SELECT unnest(['CONNECTED_TO', 'HAS_FAILURE', 'FIXED_BY', 'GOVERNED_BY', 'MENTIONED_IN']) AS type) WHERE c OR type IN ('CONNECTED_TO', 'HAS_FAILURE', 'FIXED_BY')),
 d AS (SELECT c, a AS node, count(*) AS degree FROM u JOIN ct USING (type) GROUP BY ALL),
 uw AS (SELECT ct.c, u.*, 0.8::DOUBLE * greatest(confidence, 0.3::DOUBLE) / greatest(degree - 1, 1) AS w, type || '|' || least(src, dst) || '|' || greatest(src, dst) AS k FROM u JOIN ct USING (type) JOIN d ON d.c = ct.c AND d.node = u.src),
 t AS (SELECT c, id AS s, id AS e, 0 AS hops, []::VARCHAR[] AS p, []::VARCHAR[] AS ks, true AS near, 1.0::DOUBLE AS score FROM (SELECT DISTINCT id FROM seeds), (SELECT unnest([false, true]) AS c)
  UNION ALL SELECT t.c, s, z, hops + 1, list_append(p, edge_id), list_append(ks, k), near AND type = 'CONNECTED_TO', score * w FROM t JOIN uw ON uw.c = t.c AND e = a AND NOT list_contains(p, edge_id) WHERE hops < 4),
 k AS (SELECT c, s, e, hops, array_to_string(p, '>') AS path, ks, near, score, label FROM t LEFT JOIN plant_nodes ON id = e WHERE hops > 0),
 q AS (SELECT question, text LIKE '%standard%' AS c, id, row_number() OVER (PARTITION BY question ORDER BY nth) AS place, count(*) OVER (PARTITION BY question) AS n FROM seeds),
 found AS (
  SELECT x.question, x.c, s, e, hops, path, ks, score FROM q x JOIN q y ON y.question = x.question AND x.place < y.place
   JOIN (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c, s, e ORDER BY hops, path) <= 100) k ON k.c = x.c AND s = x.id AND e = y.id
  UNION SELECT question, q.c, s, e, hops, path, ks, score FROM q
   JOIN (SELECT * FROM k WHERE label IN ('FailureMode', 'Procedure', 'RegulationClause') QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY hops, path) <= 100) k ON k.c = q.c AND s = id WHERE n = 1
  UNION SELECT question, q.c, k.s, k.e, k.hops, k.path, k.ks, o.score FROM q
   JOIN (SELECT * FROM k WHERE near AND NOT c AND hops <= 2 AND label IN ('Equipment', 'Instrument') QUALIFY row_number() OVER (PARTITION BY s ORDER BY hops, path) <= 100) k ON k.s = id
   JOIN k o ON o.c = q.c AND o.s = k.s AND o.path = k.path WHERE place <= 4)"""


def _found(v: Views, edges: DataFrame | None = None) -> DataFrame:
    return paths.find_paths(v.plant_edges if edges is None else edges, v.plant_nodes, v.seeds.select("question", "text").distinct(), v.seeds.select("question", "nth", "id"))


@_query(_ALL_TRAILS + " SELECT question, s AS start, e AS \"end\", hops::BIGINT AS hops, path FROM found", "plant_nodes", "plant_edges", "seeds")
def gr05_found_paths(v: Views) -> DataFrame:
    """GR-1, GR-2, GR-5, SET-1: candidate paths of every question, by half-trails from both ends."""
    return _found(v).select("question", "start", "end", F.col("hops").cast("bigint").alias("hops"), F.array_join("path", ">").alias("path"))


_CHOSEN = _ALL_TRAILS + """, r AS (SELECT question, s || '|' || path AS path_id, list_distinct(ks) AS ks, row_number() OVER (PARTITION BY question ORDER BY score DESC, s || '|' || path) AS i FROM found),
 g AS (SELECT question, 0::BIGINT AS i, []::VARCHAR[] AS ids, []::VARCHAR[][] AS sets FROM (SELECT DISTINCT question FROM r)
  UNION ALL SELECT question, r.i, CASE WHEN take THEN list_append(ids, path_id) ELSE ids END, CASE WHEN take THEN list_append(sets, r.ks) ELSE sets END
  FROM (SELECT g.question, g.ids, g.sets, r.i, r.path_id, r.ks, len(g.ids) < 15 AND len(list_filter(g.sets, lambda o: len(list_intersect(o, r.ks)) / least(len(o), len(r.ks)) > 0.7)) = 0 AS take FROM g JOIN r ON r.question = g.question AND r.i = g.i + 1) r)
 SELECT question, unnest(ids) AS path_id, generate_subscripts(ids, 1) AS nth FROM g QUALIFY i = max(i) OVER (PARTITION BY question)"""


@_query(_CHOSEN, "plant_nodes", "plant_edges", "seeds")
def gr07_pruned(v: Views) -> DataFrame:
    """GR-6, GR-7, SET-3: the greedy choice among the paths of all questions at once, in rounds."""
    kinds = v.seeds.select("question", paths.is_compliance(F.col("text")).alias("compliance")).distinct()
    edges = written(graph.weighted(v.plant_edges, weight=paths.CAUSAL_TYPES, compliance_weight=paths.COMPLIANCE_TYPES + paths.CAUSAL_TYPES), "edges")
    weight = lambda s: F.when(F.col("compliance"), s["compliance_weight"]).otherwise(s["weight"])
    score = F.aggregate("steps", F.lit(1.0), lambda p, s: p * weight(s))
    scored = _found(v, edges).join(kinds, "question").withColumn("score", score)
    return paths.choose_paths(scored.withColumn("path_id", F.concat_ws("|", "start", F.array_join("path", ">"))))


_PAIRED = """WITH RECURSIVE a AS (SELECT event_id AS id, event_type = 'error' AS cstr, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts DESC, event_id) AS i FROM events WHERE event_type IN ('error', 'signup')),
 near AS (SELECT x.i, y.i AS j FROM a x JOIN a y ON y.i > x.i AND x.cstr <> y.cstr AND abs(x.us - y.us) <= 300000000),
 loop AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS j, []::BIGINT[] AS taken
  UNION ALL SELECT i, j, CASE WHEN j IS NULL THEN taken ELSE list_append(list_filter(taken, lambda t: t > i), j) END
  FROM (SELECT a.i, min(near.j) FILTER (WHERE NOT list_contains(loop.taken, a.i) AND NOT list_contains(loop.taken, near.j)) AS j, any_value(loop.taken) AS taken FROM loop JOIN a ON a.i = loop.i + 1 LEFT JOIN near ON near.i = a.i GROUP BY a.i))
 SELECT CASE WHEN x.cstr THEN x.id ELSE y.id END AS reactor_id, CASE WHEN x.cstr THEN y.id ELSE x.id END AS column_id, x.id AS first_id FROM loop JOIN a x ON x.i = loop.i JOIN a y ON y.i = loop.j"""


@_query(_PAIRED)
def ui07_correlated(v: Views) -> DataFrame:
    """UI-7: alerts of two units within the seconds, one to one, newest first."""
    unit = F.when(F.col("event_type") == "error", "reactor").when(F.col("event_type") == "signup", "column")
    rows = v.table("events").select(F.col("event_id").alias("alert_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), unit.alias("unit"))
    return alerts.incidents(rows.where("unit is not null"), 300).where("reactor_id is not null and column_id is not null")


# --- context of equipment --------------------------------------------------------------------


def _joined(column: str, by: str = "|") -> Column:
    return F.array_join(column, by).alias(column)


_CONTEXT = """, more AS (SELECT src, dst, type, cause FROM edges
  UNION ALL SELECT 'equip:' || a.s_suppkey, 'equip:' || b.s_suppkey, 'CONNECTED_TO', NULL FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
  UNION ALL SELECT 'equip:' || s_suppkey, 'proc:' || s_nationkey, 'FIXED_BY', NULL FROM supplier WHERE s_suppkey % 3 > 0),
 named AS (SELECT id, label, surface_form FROM nodes UNION ALL SELECT 'proc:' || n_nationkey, 'Procedure', 'procedure ' || n_name FROM nation),
 fail AS (SELECT src, string_agg(mode || ':' || n || ':' || causes, ';' ORDER BY mode) AS failures FROM (
   SELECT src, surface_form AS mode, count(*) AS n, coalesce(string_agg(DISTINCT cause, '+' ORDER BY cause) FILTER (WHERE trim(cause) <> ''), '') AS causes FROM more JOIN named ON id = dst AND label = 'FailureMode' WHERE type = 'HAS_FAILURE' GROUP BY ALL) GROUP BY src),
 work AS (SELECT equipment AS src, string_agg(wo_id || ' ' || date, ';' ORDER BY date DESC, wo_id) AS work_orders FROM (SELECT DISTINCT equipment, wo_id, date FROM work_orders QUALIFY dense_rank() OVER (PARTITION BY equipment ORDER BY date DESC, wo_id) <= 8) GROUP BY ALL),
 proc AS (SELECT src, string_agg(DISTINCT surface_form, '|' ORDER BY surface_form) AS procedures FROM more JOIN named ON id = dst AND label = 'Procedure' WHERE type = 'FIXED_BY' GROUP BY src),
 conn AS (SELECT a AS src, string_agg(DISTINCT surface_form, '|' ORDER BY surface_form) AS connected FROM (SELECT src AS a, dst AS z FROM more WHERE type = 'CONNECTED_TO' UNION SELECT dst, src FROM more WHERE type = 'CONNECTED_TO') JOIN named ON id = z GROUP BY a)
 SELECT surface_form AS tag, coalesce(failures, '') AS failures, coalesce(work_orders, '') AS work_orders, coalesce(procedures, '') AS procedures, coalesce(connected, '') AS connected
 FROM nodes LEFT JOIN fail ON fail.src = id LEFT JOIN work ON work.src = id LEFT JOIN proc ON proc.src = id LEFT JOIN conn ON conn.src = id WHERE label = 'Equipment'"""


@_query(_CONTEXT, "nodes", "edges", "work_orders")
def jn17_equipment_context(v: Views) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c) if isinstance(c, str) else c)
    supplier, none = v.table("supplier"), F.lit(None).cast("string")
    beside = supplier.join(supplier.select((F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey").select(key("equip:", "s_suppkey").alias("src"), key("equip:", F.col("s_suppkey") + 1).alias("dst"), F.lit("CONNECTED_TO").alias("type"), none.alias("cause"))
    fixes = supplier.where("s_suppkey % 3 > 0").select(key("equip:", "s_suppkey"), key("proc:", "s_nationkey"), F.lit("FIXED_BY"), none)
    nodes = v.nodes.union(v.table("nation").select(key("proc:", "n_nationkey"), F.lit("Procedure"), key("procedure ", "n_name")))
    found = reads.equipment_context(v.nodes.select(F.col("surface_form").alias("tag")), v.edges.select("src", "dst", "type", "cause").union(beside).union(fixes), nodes, v.work_orders)
    failures = F.transform("failures", lambda f: F.concat_ws(":", f["mode"], f["count"].cast("string"), F.array_join(f["causes"], "+")))
    orders = F.transform("work_orders", lambda w: F.concat_ws(" ", w["wo_id"], w["date"]))
    return found.select("tag", F.array_join(failures, ";").alias("failures"), F.array_join(orders, ";").alias("work_orders"), _joined("procedures"), _joined("connected"))


@_query("""SELECT a.surface_form AS tag, p.surface_form AS procedure, string_agg(DISTINCT doc_id, '|' ORDER BY doc_id) AS docs FROM plant_edges JOIN plant_nodes a ON a.id = src AND a.label = 'Equipment'
 JOIN plant_nodes p ON p.id = dst AND p.label = 'Procedure' WHERE type = 'FIXED_BY' GROUP BY ALL""", "plant_nodes", "plant_edges")  # fmt: skip
def agg06_procedures(v: Views) -> DataFrame:
    return reads.procedures_for(v.plant_edges, v.plant_nodes).select("tag", "procedure", _joined("docs"))


@_query("""SELECT DISTINCT a.surface_form AS tag, b.surface_form AS shared_with, 'Equipment' AS label FROM (SELECT src AS x, dst AS y FROM plant_edges WHERE type = 'SHARES_HEADER' UNION SELECT dst, src FROM plant_edges WHERE type = 'SHARES_HEADER')
 JOIN plant_nodes a ON a.id = x AND a.label = 'Equipment' JOIN plant_nodes b ON b.id = y AND b.label = 'Equipment'""", "plant_nodes", "plant_edges")  # fmt: skip
def gr10_shared(v: Views) -> DataFrame:
    return reads.shared_utilities(v.plant_edges, v.plant_nodes).distinct()


@_query("""SELECT node, edge_id, type, src, dst, confidence, other, surface_form AS other_surface, label AS other_label FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, type, other, edge_id) AS nth FROM (SELECT *, src AS node, dst AS other FROM plant_edges UNION ALL SELECT *, dst, src FROM plant_edges WHERE src <> dst) WHERE type IN ('CONNECTED_TO', 'HAS_FAILURE', 'GOVERNED_BY'))
 JOIN plant_nodes ON id = other WHERE nth <= 40""", "plant_nodes", "plant_edges")  # fmt: skip
def gr09_relations(v: Views) -> DataFrame:
    return reads.relations(v.plant_edges, v.plant_nodes, ["CONNECTED_TO", "HAS_FAILURE", "GOVERNED_BY"])


@_query("SELECT id, surface_form FROM nodes WHERE contains(lower(surface_form), 'united') OR contains(lower(surface_form), 'mode 1') OR contains(lower(surface_form), '#000000001')", "nodes")
def flt10_terms(v: Views) -> DataFrame:
    """FLT-10: every node that one of the terms names."""
    return reads.named_by_any(v.nodes, ["United", "mode 1", "#000000001"]).select("id", "surface_form")


@_query("SELECT event_id, coalesce(epoch(TIMESTAMP '2024-01-20') - TRY_CAST(CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE epoch(ts)::VARCHAR END AS DOUBLE) <= 86400, true) AS fresh FROM events")
def flt16_fresh(v: Views) -> DataFrame:
    """FLT-16: times as strings, some missing or unreadable, some after now."""
    user = F.col("user_id") % 4
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("string")
    at = F.when(user == 0, F.lit(None)).when(user == 1, "soon").otherwise(seconds)
    now = F.unix_seconds(F.lit("2024-01-20").cast("timestamp"))
    return v.table("events").select("event_id", reads.is_fresh(now - at.try_cast("double"), 86_400).alias("fresh"))


@_query("SELECT string_split(tag, '.')[1] AS unit, tag, setpoint, units FROM (SELECT CASE WHEN substr(tag_id, 5)::BIGINT % 3 > 0 THEN 'UNIT' || (substr(tag_id, 5)::BIGINT % 5) || '.' || tag_id ELSE tag_id END AS tag, h AS setpoint, CASE WHEN substr(tag_id, 5)::BIGINT % 2 = 0 THEN 'kPa' END AS units FROM envelopes)", "envelopes")
def prj13_assets(v: Views) -> DataFrame:
    n = F.substring("tag_id", 5, 20).cast("bigint")
    tag = F.when(n % 3 > 0, F.concat(F.lit("UNIT"), n % 5, F.lit("."), "tag_id")).otherwise(F.col("tag_id"))
    return reads.assets(v.envelopes.select(tag.alias("tag_id"), F.col("h").alias("setpoint"), F.when(n % 2 == 0, "kPa").alias("units")))


_CORRECTIONS = """SELECT 'doc:' || (c_custkey % 700) AS doc_id, 'fix:' || c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS author, CASE WHEN c_custkey % 5 = 0 THEN 'a reviewer' END AS corrected_by, 'not ' || c_mktsegment AS text FROM customer"""


def _corrections(v: Views) -> DataFrame:
    key = F.col("c_custkey")
    return v.table("customer").select(F.concat(F.lit("doc:"), key % 700).alias("doc_id"), F.concat(F.lit("fix:"), key).alias("id"), F.when(key % 3 > 0, F.col("c_name")).alias("author"), F.when(key % 5 == 0, "a reviewer").alias("corrected_by"), F.concat(F.lit("not "), "c_mktsegment").alias("text"))


_LISTS = ", ".join(f"coalesce(string_agg(DISTINCT {c}, '|' ORDER BY {c}), '') AS {name}" for c, name in (("author", "corrected_by"), ("text", "corrections"), ("fix.id", "correction_ids")))


@_query(f""", h AS (SELECT e.surface_form AS tag, f.surface_form AS mode, edges.* FROM edges JOIN nodes e ON e.id = src AND e.label = 'Equipment' JOIN nodes f ON f.id = dst AND f.label = 'FailureMode' WHERE type = 'HAS_FAILURE')
 SELECT tag, mode, count(DISTINCT edge_id) AS count, coalesce(string_agg(DISTINCT cause, '|' ORDER BY cause) FILTER (WHERE cause <> ''), '') AS causes, string_agg(DISTINCT h.doc_id, '|' ORDER BY h.doc_id) AS docs, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, {_LISTS}
 FROM h LEFT JOIN ({_CORRECTIONS}) fix ON fix.doc_id = h.doc_id GROUP BY ALL""", "nodes", "edges")  # fmt: skip
def jn03_corrected_failures(v: Views) -> DataFrame:
    """JN-3, AGG-2."""
    found = lanes.failures_with_corrections(v.edges, v.nodes, _corrections(v), "|")
    return found.select("tag", "mode", "count", *map(_joined, ("causes", "docs", "sources")), *lanes.LISTS)


@_query(f"SELECT doc_id, id AS correction_id, text AS correction, coalesce(author, corrected_by, 'an engineer') AS author FROM ({_CORRECTIONS}) WHERE doc_id IN (SELECT doc_id FROM edges)", "edges")
def jn05_corrections_of(v: Views) -> DataFrame:
    return lanes.corrections_of(_corrections(v), v.edges.select("doc_id"))


_SOP = """, e2 AS (SELECT 'm' || l_orderkey || '-' || l_linenumber AS edge_id, 'equip:' || l_partkey AS src, 'MENTIONED_IN' AS type, 'wo:' || l_orderkey AS dst FROM lineitem
  UNION ALL SELECT 's' || a.o_orderkey, 'wo:' || a.o_orderkey, 'MENTIONS', 'wo:' || b.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 7 = 0
  UNION ALL SELECT 'd' || o_orderkey, 'wo:' || o_orderkey, 'FOLLOWS_SOP', 'proc:' || (o_orderkey % 60) FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT edge_id, src, type, dst FROM plant_edges WHERE type = 'FIXED_BY'),
 st AS (SELECT id AS sop_id, surface_form AS sop_name, i AS step_index, 'step ' || i || ' of ' || surface_form AS step_text FROM plant_nodes, (SELECT unnest([0, 1, 2]) AS i) WHERE label = 'Procedure' AND i < substr(id, 6)::BIGINT % 4),
 direct AS (SELECT src AS id, st.* FROM e2 JOIN st ON sop_id = dst WHERE type = 'FOLLOWS_SOP'),
 near AS (SELECT edge_id, src AS a, dst AS z FROM e2 WHERE type LIKE 'MENTION%' UNION ALL SELECT edge_id, dst, src FROM e2 WHERE type LIKE 'MENTION%'),
 hop AS (SELECT a AS id, z FROM near UNION SELECT x.a, y.z FROM near x JOIN near y ON y.a = x.z AND y.edge_id <> x.edge_id),
 other AS (SELECT DISTINCT hop.id, f.dst AS sop_id FROM hop JOIN plant_nodes n ON n.id = z AND label = 'Equipment' JOIN e2 f ON f.src = z AND f.type = 'FIXED_BY' WHERE hop.id LIKE 'wo:%' AND hop.id NOT IN (SELECT id FROM direct))
 SELECT id, step_index, step_text, sop_id, sop_name FROM direct UNION ALL
 SELECT id, step_index, step_text, sop_id, sop_name FROM other JOIN st USING (sop_id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY step_index, sop_id) <= 50"""


@_query(_SOP, "plant_nodes", "plant_edges")
def jn15_steps(v: Views) -> DataFrame:
    """JN-15: every fifth order follows a procedure; the others go by the equipment that mentions them."""
    order, wo = v.table("orders").select("o_orderkey"), lambda c: F.concat(F.lit("wo:"), c)
    edge = lambda rows, key, src, kind, dst: rows.select(key.alias("edge_id"), src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    key = F.col("o_orderkey")
    mentioned = edge(v.table("lineitem"), F.concat(F.lit("m"), "l_orderkey", F.lit("-"), "l_linenumber"), F.concat(F.lit("equip:"), "l_partkey"), "MENTIONED_IN", wo("l_orderkey"))
    mentions = edge(order.where("o_orderkey % 7 = 0").join(order.select((key - 1).alias("o_orderkey")), "o_orderkey"), F.concat(F.lit("s"), key), wo(key), "MENTIONS", wo(key + 1))
    follows = edge(order.where("o_orderkey % 5 = 0"), F.concat(F.lit("d"), key), wo(key), "FOLLOWS_SOP", F.concat(F.lit("proc:"), key % 60))
    edges = mentioned.union(mentions).union(follows).union(v.plant_edges.where("type = 'FIXED_BY'").select("edge_id", "src", "type", "dst"))
    name, n = F.col("surface_form"), F.substring("id", 6, 9).cast("bigint") % 4
    texts = F.transform(F.slice(F.array(*map(F.lit, range(3))), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("step "), i.cast("string"), F.lit(" of "), name))
    procedures = v.plant_nodes.where("label = 'Procedure'").select("id", name.alias("name"), texts.alias("steps"))
    return lanes.steps(order.select(wo(key).alias("id")), edges, v.plant_nodes, procedures)


@_query("SELECT id, min(source) AS source, arg_min(rank, source) AS rank FROM (SELECT doc_id AS id, 0 AS source, n_chars AS rank FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT vec_id, 1, label FROM embeddings) GROUP BY id")
def set04_hybrid(v: Views) -> DataFrame:
    """SET-1, SET-4, SET-7: chunks that hold the text, then those near by their vectors; an exact hit wins over a vector hit of the same id."""
    text = v.table("documents").where(F.contains(F.lower("text"), F.lit("the"))).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("rank"))
    return retrieval.hybrid(text, v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("rank")))


# --- commits and what follows them -----------------------------------------------------------


def _subgraphs(v: Views) -> DataFrame:
    """A subgraph for each closed or partly closed order, as JSON: its suppliers with their failure modes."""
    lines = v.table("lineitem").join(v.table("orders").where("o_orderstatus in ('F', 'P')"), F.col("l_orderkey") == F.col("o_orderkey"))
    tag, mode = F.concat(F.lit("P-"), "l_suppkey"), F.concat(F.lit("mode "), F.col("l_partkey") % 25)
    name = lambda kind, surface, key, props: F.struct(F.lit(kind).alias("type"), surface.alias("surface_form"), key.alias("resolved_id"), props.alias("props"))
    equipment = name("Equipment", tag, F.concat(F.lit("equip:P-"), "l_suppkey"), F.create_map(F.lit("status"), F.col("o_orderstatus")))
    failure = name("FailureMode", mode, F.concat(F.lit("fm:"), F.col("l_partkey") % 25), F.create_map(F.lit("status"), F.lit(None).cast("string")))
    provenance = F.struct(F.concat(F.lit("doc:"), "l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(0.9).alias("confidence"))
    edge = F.struct(F.lit("HAS_FAILURE").alias("type"), tag.alias("src"), mode.alias("dst"), provenance.alias("provenance"))
    doc = F.struct(F.first("doc").alias("doc_id"), F.flatten(F.collect_list("nodes")).alias("nodes"), F.collect_list("edge").alias("edges"))
    rows = lines.select("l_orderkey", "o_orderstatus", F.concat(F.lit("doc:"), "l_orderkey").alias("doc"), F.array(equipment, failure).alias("nodes"), edge.alias("edge"))
    return rows.groupBy("l_orderkey", "o_orderstatus").agg(F.to_json(doc).alias("raw"))


def _committed(v: Views) -> GraphWriter:
    """Two commits: the closed orders, then the partly closed ones with a line that is no subgraph."""
    rows, graph_tables = written(_subgraphs(v), "raw"), GraphWriter(v.spark, f"{shared_folder(v.spark)}/graph-{uuid.uuid4().hex}")
    graph_tables.commit(rows.where("o_orderstatus = 'F'").select("raw"), 0)
    graph_tables.commit(rows.where("o_orderstatus = 'P'").select("raw").union(v.spark.sql("SELECT '[]' AS raw")), 1)
    return graph_tables


_COMMITTED = """WITH h AS (SELECT DISTINCT 'equip:P-' || l_suppkey AS src, 'P-' || l_suppkey AS tag, 'fm:' || (l_partkey % 25) AS dst, 'mode ' || (l_partkey % 25) AS mode, l_orderkey, l_linenumber, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS version
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P'))"""


@_query(_COMMITTED + """ SELECT src AS id, 'Equipment' AS label, tag AS surface_form, CASE max(version) WHEN 1 THEN 'F' ELSE 'P' END AS status, min(version)::BIGINT AS created_version, max(version)::BIGINT AS updated_version, count(*) AS n_edges FROM h GROUP BY ALL
 UNION ALL SELECT dst, 'FailureMode', mode, NULL, min(version), max(version), count(*) FROM h GROUP BY ALL""")  # fmt: skip
def etl15_committed_graph(v: Views) -> DataFrame:
    """ETL-14, ETL-15, SNK-3, SNK-4: the graph after two commits, with each node's edges."""
    tables = _committed(v)
    ends = tables.edges().select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n_edges"))
    return tables.nodes().join(ends, "id").select("id", "label", "surface_form", F.col("props")["status"].alias("status"), "created_version", "updated_version", "n_edges")


_STANDING = _COMMITTED + """, f AS (SELECT src, tag, mode, count(*) AS n FROM h GROUP BY ALL),
 mine AS (SELECT f.* FROM f WHERE src IN (SELECT src FROM h WHERE version = 2)),
 alerts AS (SELECT * FROM mine WHERE n >= 2)
 SELECT 'about P-' || s_suppkey AS question, 1::BIGINT AS version, 1::BIGINT AS n_cited FROM supplier WHERE 'equip:P-' || s_suppkey NOT IN (SELECT src FROM h WHERE version = 2)
 UNION ALL SELECT q, 2, 1 FROM alerts, (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT CASE k WHEN 1 THEN 'what should I do about ' || tag || ' ' || mode || '?' WHEN 2 THEN tag || ' failure history and recommendation' ELSE 'is the ' || tag || ' failure related to its sibling equipment?' END AS q) GROUP BY q"""


@_query(_STANDING)
def stm14_standing_answers(v: Views) -> DataFrame:
    """STM-14, ETL-27, ETL-29, ETL-32, SET-6: an answer for each supplier is cached between two commits; the second takes out those that it touched, and answers its failures ahead."""
    tables, cache = _committed(v), AnswerCache(v.spark, f"{shared_folder(v.spark)}/answers-{uuid.uuid4().hex}")
    own = v.table("supplier").select(F.concat(F.lit("about P-"), "s_suppkey").alias("question"), F.lit("pump").alias("answer"), F.array(F.concat(F.lit("equip:P-"), "s_suppkey")).alias("cited"))
    cache.follow(tables.deltas().where("kind <> 'edge_type'"), tables, 1)
    cache.put(own, 1)
    cache.follow(tables.deltas(), tables, 2)
    return cache.answers().select("question", "version", F.size("cited").cast("bigint").alias("n_cited"))


@_query()
def stm10_online_detector(v: Views) -> DataFrame:
    """STM-9, STM-10, STM-11: events and episodes of the stateful stream, an hour of the table as a second; each third of the users is a plant, kinds of events its tags."""
    spark, folder = v.spark, shared_folder(v.spark)
    second = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    plant = F.concat(F.lit("plant "), F.col("user_id") % 3)
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = v.table("events").groupBy(second.alias("ts")).pivot("event_type", kinds).agg(F.avg("value"))
    model = diagnosis.fit_detector(wide.fillna(0.0), kinds, alpha=0.6)  # hours with few kinds lie near the mean
    rows = v.table("events").select(plant.alias("plant"), F.timestamp_seconds(second).alias("ts"), F.col("event_type").alias("tag_id"), "value", F.when((F.col("event_type") == "error") & (F.col("value") > 150), "HH").alias("level"))
    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run = f"{folder}/detector-{uuid.uuid4().hex}"
    rows.write.parquet(f"{run}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{run}/in")
    spark.conf.set(key, detector.ROCKSDB)
    try:
        query = detector.online_detector(stream, model).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, old)
    return spark.read.schema(detector.OUTPUT).parquet(f"{run}/out").drop("contributions")


# --- manuals ---------------------------------------------------------------------------------

_PAGES = r"""WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
 pages AS (SELECT doc_id, CAST(i // 4 + 1 AS INTEGER) AS page, 'Plant manual 7' || chr(10) || CASE WHEN (doc_id + i // 4) % 3 = 0 THEN (doc_id % 5 + 1) || repeat('.1', CAST((i // 4) % 4 AS INTEGER)) || ' Scope ' || (i // 4) || chr(10) ELSE '' END
   || string_agg(line, chr(10) || ' ' || chr(10) ORDER BY i) || chr(10) || 'Page ' || (i // 4 + 1) AS text FROM lines GROUP BY doc_id, i // 4)"""


def _pages(v: Views) -> DataFrame:
    """Each document as pages of four lines, with a head and a foot on each and a heading on some."""
    rows = v.table("documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("p", F.expr("i div 4"))
    body = rows.groupBy("doc_id", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n \n").alias("body"))
    number = F.concat((F.col("doc_id") % 5 + 1).cast("string"), F.expr("repeat('.1', cast(p % 4 as int))"))
    heading = F.when((F.col("doc_id") + F.col("p")) % 3 == 0, F.concat(number, F.lit(" Scope "), F.col("p").cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("Plant manual 7\n"), heading, "body", F.lit("\nPage "), (F.col("p") + 1).cast("string"))
    return body.select("doc_id", (F.col("p") + 1).cast("int").alias("page"), text.alias("text"))


_TREE = (
    _PAGES
    + r""", n AS (SELECT doc_id, max(page) AS n_pages FROM pages GROUP BY 1),
 pl AS (SELECT doc_id, page, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, page, string_split(text, chr(10)) AS ls FROM pages)),
 full_lines AS (SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) AS down FROM pl WHERE trim(line) <> ''),
 furniture AS (SELECT doc_id, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS pattern FROM (SELECT DISTINCT doc_id, page, line FROM full_lines WHERE up <= 2 OR down <= 2) JOIN n USING (doc_id) WHERE n_pages >= 4 GROUP BY doc_id, n_pages, 2 HAVING count(*) >= greatest(4, floor(0.6 * n_pages))),
 cl AS (SELECT pl.* FROM pl ANTI JOIN furniture f ON f.doc_id = pl.doc_id AND f.pattern = regexp_replace(regexp_replace(pl.line, '^\s+|\s+$', '', 'g'), '[0-9]+', '#', 'g')),
 clean AS (SELECT pages.doc_id, pages.page, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM pages LEFT JOIN cl ON cl.doc_id = pages.doc_id AND cl.page = pages.page GROUP BY 1, 2),
 hd AS (SELECT doc_id, page, i, trim(line) AS title, least(len(regexp_extract(line, '^\s*(\d+(?:\.\d+)*)[.)]?\s+\S', 1)) - len(replace(regexp_extract(line, '^\s*(\d+(?:\.\d+)*)[.)]?\s+\S', 1), '.', '')) + 1, 4) AS level FROM cl WHERE regexp_matches(line, '^\s*(\d+(?:\.\d+)*)[.)]?\s+\S') AND len(trim(line)) < 90),
 en AS (SELECT doc_id, page, title, level, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS nth FROM (SELECT * FROM hd UNION ALL SELECT doc_id, 1, 0, 'Manual', 1 FROM n ANTI JOIN hd USING (doc_id))),
 up AS (SELECT e.doc_id, e.nth, max(p.nth) AS over FROM en e LEFT JOIN en p ON p.doc_id = e.doc_id AND p.nth < e.nth AND p.level < e.level GROUP BY 1, 2),
 way AS (SELECT doc_id, nth, over, title AS path FROM en JOIN up USING (doc_id, nth) UNION ALL SELECT w.doc_id, w.nth, u.over, e.title || ' > ' || w.path FROM way w JOIN en e ON e.doc_id = w.doc_id AND e.nth = w.over JOIN up u ON u.doc_id = w.doc_id AND u.nth = w.over),
 sec AS (SELECT e.doc_id, e.nth, e.title, e.level, w.path, coalesce(e.doc_id || '#sec' || u.over, e.doc_id::VARCHAR) AS parent, e.page AS page_start,
   greatest(coalesce(lead(e.page) OVER (PARTITION BY e.doc_id ORDER BY e.nth) - 1, n_pages), e.page) AS page_end FROM en e JOIN up u USING (doc_id, nth) JOIN way w ON w.doc_id = e.doc_id AND w.nth = e.nth AND w.over IS NULL JOIN n ON n.doc_id = e.doc_id)"""
)


def _tree(v: Views) -> tuple[DataFrame, DataFrame]:
    pages = written(manuals.without_furniture(_pages(v)), "pages")
    return pages, written(manuals.section_tree(pages), "sections")


@_query(_TREE + " SELECT doc_id, nth::INTEGER AS nth, title, level::INTEGER AS level, path, parent, page_start, page_end FROM sec")
def etl07_manual_tree(v: Views) -> DataFrame:
    """ETL-7, WIN-7, STR-20, AGG-18: the sections of every document."""
    return _tree(v)[1]


_PACKED = (
    _TREE
    + r""", body AS (SELECT s.doc_id, s.nth, s.page_start, s.path, string_agg(c.text, chr(10) ORDER BY c.page) AS body FROM sec s JOIN clean c ON c.doc_id = s.doc_id AND c.page BETWEEN s.page_start AND s.page_end GROUP BY ALL),
 para AS (SELECT doc_id, nth, row_number() OVER (PARTITION BY doc_id, nth ORDER BY k) AS k, p FROM (SELECT doc_id, nth, generate_subscripts(ps, 1) AS k, regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') AS p FROM (SELECT doc_id, nth, regexp_split_to_array(body, '\n\s*\n') AS ps FROM body)) WHERE p <> ''),
 run AS (SELECT doc_id, nth, k, len(p) AS size, 0 AS piece FROM para WHERE k = 1
  UNION ALL SELECT r.doc_id, r.nth, p.k, CASE WHEN r.size + len(p.p) > 600 THEN len(p.p) ELSE r.size + len(p.p) END, r.piece + CASE WHEN r.size + len(p.p) > 600 THEN 1 ELSE 0 END FROM run r JOIN para p ON p.doc_id = r.doc_id AND p.nth = r.nth AND p.k = r.k + 1),
 pieces AS (SELECT doc_id, nth, piece, string_agg(p, chr(10) || chr(10) ORDER BY k) AS text FROM run JOIN para USING (doc_id, nth, k) GROUP BY ALL)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY nth, piece) - 1)::INTEGER AS idx, doc_id || '#sec' || nth AS section, page_start AS page, 'From doc-' || doc_id || '.pdf, ' || path || ': ' AS context, text FROM pieces JOIN body USING (doc_id, nth)"""
)


@_query(_PACKED)
def etl07_manual_chunks(v: Views) -> DataFrame:
    """ETL-7, WIN-6: the packed chunks of all sections, in one plan from the pages."""
    pages, sections = _tree(v)
    files = v.table("documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("filename"))
    return manuals.manual_chunks(pages, sections, files, 600)


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') WHEN doc_id % 3 = 1 THEN ' ' || regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g') || ' ' ELSE 'see below' END AS body FROM documents")
def src07_mail_bodies(v: Views) -> DataFrame:
    """SRC-7, ETL-8: documents as mails: plain and coded beside HTML, HTML alone beside an attachment, and plain ones."""
    text = F.coalesce("text", F.lit(""))
    part = lambda head, body: F.concat(F.lit(f"\n--cut here\n{head}\n\n"), body)
    inner = F.concat(F.lit("Content-Type: multipart/alternative; boundary=two\n\n--two\nContent-Type: text/html\n\n<p>no</p>\n--two\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(text, "UTF-8")), F.lit("\n--two--"))
    head, end = F.lit('Subject: s\nContent-Type: multipart/mixed; boundary="cut here"\n\n'), F.lit("\n--cut here--\n")
    both = F.concat(head, F.lit("\n--cut here\n"), inner, part("Content-Disposition: attachment", F.lit("not this")), end)
    # quoted-printable: each byte as =XX, in a line of its own
    coded = F.regexp_replace(F.hex(F.encode(F.concat(F.lit("<p>"), text, F.lit("</p>")), "UTF-8")), "(..)", "=$1")
    html = F.concat(head, part("Content-Type: text/plain\nContent-Disposition: attachment; filename=a", F.lit("nor this")), part("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable", coded), end)
    raw = F.when(F.col("doc_id") % 3 == 0, both).when(F.col("doc_id") % 3 == 1, html).otherwise("Subject: x\n\nsee below")
    return v.table("documents").select("doc_id", mail.mail_body(raw).alias("body"))


_ALIGNED = """WITH s AS (SELECT ts, event_type AS tag, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
 g AS (SELECT k, TIMESTAMP '2024-01-02' + to_hours(CAST(k AS INTEGER)) AS ts, tag FROM range(0, 24 * 26 + 1) t(k), (SELECT DISTINCT tag FROM s)),
 a AS (SELECT g.k, g.ts, g.tag, s.value FROM g ASOF JOIN s ON g.tag = s.tag AND g.ts >= s.ts WHERE epoch(g.ts) - epoch(s.ts) <= 6 * 3600),
 w AS (PIVOT a ON tag IN ('click', 'error', 'purchase', 'signup', 'view') USING max(value) GROUP BY k, ts)
 SELECT ts, click, error, purchase, signup, view FROM w WHERE click + error + purchase + signup + view IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k // 4) = 4"""


@_query(_ALIGNED)
def etl20_training_input(v: Views) -> DataFrame:
    """ETL-20: kinds of events on a grid of hours, each carried for six, in whole windows of four hours."""
    samples = v.table("events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("tag_id"), "value")
    return diagnosis.aligned_input(samples, ["click", "error", "purchase", "signup", "view"], "2024-01-02 00:00:00", "2024-01-28 00:00:00", 3600, 6 * 3600, 4)


@_query("""WITH b AS (SELECT CAST(floor(day(ts) / 8) AS BIGINT) AS week, event_id, event_type || ':' || event_id AS payload FROM events WHERE event_type IN ('error', 'signup')),
 n AS (SELECT week, count(*) AS n FROM b GROUP BY 1), s AS (SELECT week, sum(n) OVER (ORDER BY week DESC) - n AS newer FROM n)
 SELECT payload, row_number() OVER (ORDER BY week) > 0 AS stands FROM b WHERE week IN (SELECT week FROM s WHERE newer < (SELECT count(*) FROM b) // 2)""")  # fmt: skip
def snk05_capped_log(v: Views) -> DataFrame:
    """SNK-5, SRC-18: alerts of four weeks appended one after another to a log that keeps half of them, by whole batches."""
    week, kinds = F.floor(F.dayofmonth("ts") / 8), v.table("events").where("event_type in ('error', 'signup')")
    log = EntryLog(v.spark, f"{shared_folder(v.spark)}/log-{uuid.uuid4().hex}", most=kinds.count() // 2)
    for i in range(4):
        log.append(kinds.where(week == i).select(F.concat_ws(":", "event_type", "event_id").alias("payload")), i)
    return log.entries().select("payload", F.lit(True).alias("stands"))
