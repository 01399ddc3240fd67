"""What answers and agents take from the graph: linking, evidence, hazards, details, drafts and filters, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules, tags
from millrace.operators.graph import both_ways, not_human_touched, of_types, ranked
from millrace.operators.reads import is_fresh

# Patterns of questions, hazard words and their labels, tools and the field each fills, words of personas that are not the engineer.
TITLE_PHRASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
STANDARD = r"(?i)\b(OISD[-\s]?STD[-\s]?\d+|IS\s?\d{3,5}|IBR)\b"
HAZARDS = {
    "leak": "Fluid leak / release hazard",
    "seal": "Seal failure — potential liquid / vapour release",
    "fire": "Fire / ignition hazard",
    "overpressure": "Overpressure hazard",
    "vibration": "Mechanical vibration — structural fatigue risk",
    "cavitation": "Cavitation — impeller / casing damage risk",
    "overheating": "Overheating — thermal burn / fire risk",
    "corrosion": "Corrosion — material thinning / leak risk",
    "electrical": "Electrical hazard",
    "gas": "Toxic / flammable gas release hazard",
}
TOOL_FIELDS = {"get_connected_equipment": "isolation_points", "get_governing_clauses": "governing_clauses", "get_fix_procedures": "procedures_to_follow"}
PERSONA_WORDS = ("worker", "field_oper", "technician", "fitter", "mechanic", "electrician", "operator", "control_room", "supervisor", "shift", "instrument", "electrical", "control", "reliability", "asset", "process", "chemical", "plan", "schedul", "inspect", "integrity", "ndt", "hse", "safety", "env", "manager", "director", "admin", "lead")
HEAVY_PROPERTIES = ("embedding", "text", "context")
UNNAMED_LABELS = ("Chunk", "Section", "Document")
MOST_EVIDENCE = 8


def _grams(text: Column) -> Column:
    """The distinct three-character pieces of a string."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, 3)))


def named(phrases: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` nodes, by id, whose surface holds each of phrases(phrase), in any case: (phrase, id).

    Candidates share the phrase's rarest three characters, so the search is an equi-join; phrases have three characters or more.
    """
    wanted = phrases.select("phrase").distinct().withColumn("low", F.lower("phrase"))
    held = nodes.where(~F.col("label").isin(*UNNAMED_LABELS)).select("id", F.lower("surface_form").alias("surface"))
    pieces = held.select("id", "surface", F.explode(_grams(F.col("surface"))).alias("gram"))
    asked = wanted.select("phrase", "low", F.explode(_grams(F.col("low"))).alias("gram"))
    sizes = pieces.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(sizes, "gram").groupBy("phrase", "low").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    found = rarest.join(pieces, "gram").where(F.contains("surface", "low"))
    return ranked(found, ["phrase"], ["id"], limit).select("phrase", "id")


def linked(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """STR-12: the seed nodes of questions(question_id, text): (question_id, id), each once.

    Tags link to one entity by surface or id. Codes of standards link by name; title-case phrases do where nothing else was found.
    """
    entities = nodes.where(~F.col("label").isin(*UNNAMED_LABELS))
    names = F.array(F.concat(F.lit("s:"), F.lower("surface_form")), F.concat(F.lit("i:"), "id"))
    known = entities.select("id", F.explode(names).alias("name"))
    tagged = questions.select("question_id", F.explode(tags.find_tags(F.col("text"))).alias("tag")).distinct()
    keys = F.array(F.concat(F.lit("s:"), F.lower("tag")), *(F.concat(F.lit(f"i:{p}"), "tag") for p in ("equip:", "inst:", "")))
    by_tag = tagged.select("question_id", "tag", F.explode(keys).alias("name")).join(known, "name").groupBy("question_id", "tag").agg(F.min("id").alias("id"))
    codes = questions.select("question_id", F.explode(F.regexp_extract_all("text", F.lit(STANDARD), F.lit(1))).alias("code"))
    codes = codes.select("question_id", F.replace("code", F.lit(" "), F.lit("-")).alias("phrase")).distinct()
    sure = by_tag.select("question_id", "id").union(codes.join(named(codes, nodes, 3), "phrase").select("question_id", "id")).distinct()
    titles = questions.join(sure.select("question_id").distinct(), "question_id", "left_anti").select("question_id", F.explode(F.regexp_extract_all("text", F.lit(TITLE_PHRASE), F.lit(1))).alias("phrase")).distinct()
    return sure.union(titles.join(named(titles, nodes, 2), "phrase").select("question_id", "id").distinct())


def hazards(failures: DataFrame) -> DataFrame:
    """STR-17: the hazards that the modes and causes of failures(id, mode, cause) name: (id, hazard), each once."""
    text = F.lower(F.concat_ws("\n", "mode", "cause"))
    hits = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(word)), F.lit(label)) for word, label in HAZARDS.items())))
    return failures.select("id", F.explode(hits).alias("hazard")).distinct()


def harvested(trace: DataFrame) -> DataFrame:
    """JN-20: trace(id, tool, nth, value) as the distinct values of each field, in order of first mention: (id, field, nth, value)."""
    field = reduce(lambda so_far, pair: so_far.when(F.col("tool") == pair[0], pair[1]), TOOL_FIELDS.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    rows = trace.select("id", field.alias("field"), "nth", "value").where("field is not null and value <> ''")
    return rows.groupBy("id", "field", "value").agg(F.min("nth").alias("nth")).select("id", "field", "nth", "value")


def evidence(steps: DataFrame, chunks: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """GR-8: what to cite for the steps(question_id, score, path_id, nth, type, doc_id, page) of a question's paths, weakest path first.

    A step cites the first of chunks(doc_id, seq, page, chunk_id) on its page, else the document's first, else its own edge.
    Chunks are reduced to one a page and one a document before the joins. Returns (question_id, rank, chunk_id).
    """
    first = F.min_by("chunk_id", "seq")
    paged = chunks.where("page is not null").groupBy("doc_id", "page").agg(first.alias("same_page"))
    opening = chunks.groupBy("doc_id").agg(first.alias("opening"))
    own = F.concat(F.lit("edge:"), "doc_id", F.lit(":"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(":"), "type")
    cited = steps.where("doc_id is not null").join(paged, ["doc_id", "page"], "left").join(opening, "doc_id", "left").withColumn("chunk_id", F.coalesce("same_page", "opening", own))
    once = cited.groupBy("question_id", "chunk_id").agg(F.min(F.struct("score", "path_id", "nth")).alias("place"))
    return ranked(once, ["question_id"], ["place", "chunk_id"], most).select("question_id", F.col("nth").alias("rank"), "chunk_id")


def asset_context(alarms: DataFrame, diagnoses: DataFrame, now: Column, active_s: int = 1800) -> DataFrame:
    """ETL-26: the standing alarm of each level of alarms(tag_id, kind, level, value, ts), with the id of the tag's newest of diagnoses(tag_id, diagnosis, ts).

    Standing: a process limit of the last ``active_s`` seconds, or one without a time; a timed one is newer than one without.
    """
    fresh = is_fresh((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6, active_s)
    standing = alarms.where((F.col("kind") == "process_limit") & fresh).groupBy("tag_id", "level").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "value")).alias("value"))
    latest = diagnoses.groupBy("tag_id").agg(F.max_by("diagnosis", F.struct("ts", "diagnosis")).alias("diagnosis"))
    return standing.join(latest, "tag_id", "left").select("tag_id", "level", "ts", "value", "diagnosis")


def speculative_questions(triggers: DataFrame) -> DataFrame:
    """ETL-32, STM-14: three questions for each distinct one of triggers(tag, mode, count): (tag, claim, question)."""
    claim = F.concat_ws(":", F.lit("failure"), "tag", "mode", F.col("count").cast("string"))
    asked = F.array(F.format_string("what should I do about %s %s?", "tag", F.lower("mode")), F.format_string("%s failure history and recommendation", "tag"), F.format_string("is the %s failure related to its sibling equipment?", "tag"))
    return triggers.select("tag", "mode", "count").distinct().select("tag", claim.alias("claim"), F.explode(asked).alias("question"))


def person_documents(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """FLT-11: the first documents that mention a person whose name holds the given one, in any case."""
    people = nodes.where((F.col("label") == "Person") & F.contains(F.lower("surface_form"), F.lit(name.lower()))).select(F.col("id").alias("src"))
    documents = nodes.where("label = 'Document'").select(F.col("id").alias("dst"), F.coalesce("surface_form", "id").alias("doc"))
    return of_types(edges, ["MENTIONED_IN"]).join(people, "src", "left_semi").join(documents, "dst").select("doc").distinct().orderBy("doc").limit(limit)


def order_details(orders: DataFrame, edges: DataFrame, equipment: DataFrame) -> DataFrame:
    """JN-16: orders(id, date) with the distinct equipment(id, name) one or two mentions away, sorted; none is an empty string."""
    hop = both_ways(of_types(edges, ["MENTIONED_IN"]).select("edge_id", "src", "dst")).select("edge_id", "node", "other")
    # names join the hops that end at equipment before the orders do; the sets need no distinct pairs of ids before them
    named = hop.join(equipment.select(F.col("id").alias("other"), "name"), "other").select("node", "edge_id", "name")
    ids = orders.select("id").distinct()
    first = ids.join(hop, F.col("id") == F.col("node")).select("id", F.col("other").alias("at"), F.col("edge_id").alias("first"))
    two = first.join(named, F.col("at") == F.col("node")).where("edge_id <> first").select("id", "name")
    ends = ids.join(named, F.col("id") == F.col("node")).select("id", "name").union(two)
    listed = ends.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("equipment"))
    return orders.join(listed, "id", "left").select("id", "date", F.coalesce("equipment", F.lit("")).alias("equipment"))


def downstream(edges: DataFrame, kind: str = "FEEDS") -> DataFrame:
    """GR-3: what every node feeds in one or two steps, a row for each way there: (tag, unit)."""
    one = of_types(edges, [kind]).select("edge_id", F.col("src").alias("tag"), F.col("dst").alias("unit"))
    more = one.select(F.col("edge_id").alias("second"), F.col("tag").alias("via"), F.col("unit").alias("far"))
    two = one.join(more, F.col("unit") == F.col("via")).where("edge_id <> second").select("tag", F.col("far").alias("unit"))
    return one.select("tag", "unit").union(two)


def inspection_draft(items: DataFrame) -> DataFrame:
    """PRJ-16: a preventive work order for each of items(equipment, standard, inspection_type, next_due, last_inspection, revision, status)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    kind = F.when(text("inspection_type") == "", "Inspection").otherwise(F.col("inspection_type"))
    overdue = text("status") == "overdue"
    last = F.when(text("last_inspection") != "", F.concat(F.lit("; last carried out "), "last_inspection", F.lit("."))).otherwise(".")
    revision = F.when(text("revision") != "", F.concat(F.lit(" (revision "), "revision", F.lit(")"))).otherwise("")
    cause = F.concat(kind, F.lit(" of "), text("equipment"), F.lit(" required by "), text("standard"), F.when(overdue, " was due ").otherwise(" falls due "), text("next_due"), last)
    fix = F.concat(F.lit("Carry out the "), F.lower(kind), F.lit(" of "), text("equipment"), F.lit(" to "), text("standard"), revision, F.lit(". Record the result against the asset so the next due date rolls forward."))
    return items.select(text("equipment").alias("equipment"), text("standard").alias("standard"), F.lit("PM02").alias("order_type"), F.when(overdue, "high").otherwise("medium").alias("priority"), cause.alias("root_cause"), fix.alias("recommended_fix"))


def inspection_edges(rows: DataFrame) -> DataFrame:
    """ETL-3: GOVERNED_BY and MENTIONED_IN edges of inspections(row, doc_id, equipment_tag, standard, result, next_due); rows without equipment go."""
    good = rows.where("equipment_tag <> ''").withColumns({"equip": tags.canonical_id(F.lit("Equipment"), F.col("equipment_tag")), "clause": tags.canonical_id(F.lit("RegulationClause"), F.col("standard"))})
    none = F.lit(None).cast("string")
    governed = good.where("standard <> ''").select(F.col("equip").alias("src"), F.lit("GOVERNED_BY").alias("type"), F.col("clause").alias("dst"), F.col("row").alias("page"), "result", "next_due")
    return governed.union(good.select("equip", F.lit("MENTIONED_IN"), "doc_id", "row", none, none))


def finding_edges(findings: DataFrame) -> DataFrame:
    """ETL-9: edges of findings(kind, equipment_tag, name, cause, confidence); a finding whose tag is none goes, as does an unknown kind."""
    tag = tags.canonical_id(F.lit("Equipment"), F.col("equipment_tag"))
    kinds = {"failure": ("HAS_FAILURE", tags.canonical_id(F.lit("FailureMode"), tags.failure_mode(F.col("name")))), "procedure": ("FIXED_BY", tags.canonical_id(F.lit("Procedure"), F.trim("name"))), "regulation": ("GOVERNED_BY", tags.canonical_id(F.lit("RegulationClause"), F.upper(F.trim("name"))))}
    pick = lambda of: reduce(lambda so_far, k: so_far.when(F.col("kind") == k, of(kinds[k])), kinds, F.when(F.lit(False), F.lit(None).cast("string")))
    cause = F.when((F.col("kind") == "failure") & (F.col("cause") != ""), F.col("cause"))
    return findings.where(tags.looks_like_tag(F.col("equipment_tag"))).select(tag.alias("src"), pick(lambda k: F.lit(k[0])).alias("type"), pick(lambda k: k[1]).alias("dst"), cause.alias("cause"), "confidence").where("type is not null")


def pruned_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ETL-16: nodes and edges without equipment and instruments that are references to documents; what a human touched stays."""
    suspects = nodes.where(F.col("label").isin("Equipment", "Instrument") & rules.is_doc_reference(F.col("surface_form")))
    gone = not_human_touched(suspects, edges).select("id")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return nodes.join(gone, "id", "left_anti"), edges


def superseded_modes(nodes: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ETL-17: nodes with a superseded flag for each variant of merged(variant, canonical), and the MERGED_INTO edges of the modes that exist."""
    known = nodes.select("id")
    pairs = merged.distinct().join(known.withColumnRenamed("id", "variant"), "variant", "left_semi").join(known.withColumnRenamed("id", "canonical"), "canonical", "left_semi")
    flagged = nodes.join(pairs.select(F.col("variant").alias("id"), F.lit(True).alias("superseded")).distinct(), "id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    return flagged, pairs.select(F.col("variant").alias("src"), F.lit("MERGED_INTO").alias("type"), F.col("canonical").alias("dst"), F.lit("agent").alias("source"))


def light_nodes(nodes: DataFrame) -> DataFrame:
    """PRJ-4, PRJ-6, PRJ-7: nodes(id, labels, surface_form, name, props) with their first label but Entity, one name and no heavy properties."""
    label = F.try_element_at(F.array_remove("labels", "Entity"), F.lit(1))
    return nodes.select("id", label.alias("label"), F.coalesce("surface_form", "name").alias("name"), F.map_filter("props", lambda k, _: ~k.isin(*HEAVY_PROPERTIES)).alias("props"))


def documents(nodes: DataFrame) -> DataFrame:
    """SRC-19: the documents of a graph with their file names."""
    return nodes.where("label = 'Document'").select("id", F.coalesce("filename", "surface_form").alias("filename"))


def failed_task_alerts(failures: DataFrame) -> DataFrame:
    """ETL-38: one alert for each task of failures(task_id, task, error, ts) that failed for good, from its first failure."""
    first = failures.groupBy("task_id").agg(F.min(F.struct("ts", "task", "error")).alias("f"))
    return first.select(F.concat(F.lit("dlq:"), "task_id").alias("fingerprint"), F.lit("system").alias("kind"), F.lit("error").alias("severity"), F.concat(F.lit("Background Task Failed: "), "f.task").alias("title"), F.col("f.error").alias("error"))


def latest_or(samples: DataFrame, defaults: DataFrame) -> DataFrame:
    """ETL-37: the latest value of each of defaults(tag_id, fallback) in samples(tag_id, ts, value), or its fallback."""
    wanted = samples.join(defaults.select("tag_id").distinct(), "tag_id", "left_semi")
    latest = wanted.groupBy("tag_id").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    return defaults.join(latest, "tag_id", "left").select("tag_id", F.coalesce("value", "fallback").alias("value"))


def routed(alerts: DataFrame) -> DataFrame:
    """STM-15: the handler of each entry of alerts(entry_id, payload); investigations, other kinds and unreadable payloads have none."""
    read = lambda path: F.get_json_object("payload", f"$.{path}")
    filled = lambda path: F.coalesce(read(path) != "", F.lit(False))
    asks = (read("kind") == "process_limit") & F.coalesce(read("type") != "investigation", F.lit(True))
    return alerts.where(asks).select("entry_id", F.when(filled("rule"), "process_limit").when(filled("tag_id"), "tep_alarm").alias("handler")).where("handler is not null").dropDuplicates(["entry_id"])


def in_units(tag: Column, *units: str) -> Column:
    """FLT-21: whether a tag is of one of the units, by its beginning."""
    return reduce(lambda a, b: a | b, (F.startswith(tag, F.lit(u)) for u in units), F.lit(False))


def event_time(raw: Column) -> Column:
    """UI-9: seconds of a time given as seconds (below 1e11), milliseconds or ISO text; null where it is none of them."""
    number = raw.try_cast("double")
    return F.when(number < 1e11, number).when(number.isNotNull(), number / 1000).otherwise(F.unix_micros(F.try_to_timestamp(raw)) / 1e6)


def swimlanes(events: DataFrame) -> DataFrame:
    """UI-9: the lanes of events(tag_id, unit, equipment, ts): the first non-empty name or Unknown, the number of events and the first readable time."""
    lane = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("tag_id", "unit", "equipment")), F.lit("Unknown"))
    return events.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"), F.min(event_time(F.col("ts"))).alias("first"))


def portrait(samples: DataFrame, pairs: DataFrame, n: int = 600) -> DataFrame:
    """UI-10: the last n of samples(tag_id, ts, value) of both tags of pairs(x_tag, y_tag), aligned from the newest back."""
    wanted = pairs.select(F.col("x_tag").alias("tag_id")).union(pairs.select("y_tag")).distinct()
    last = ranked(samples.join(wanted, "tag_id", "left_semi"), ["tag_id"], [F.desc("ts"), "value"], n)
    x, y = (last.select(F.col("tag_id").alias(f"{a}_tag"), "nth", F.col("value").alias(a)) for a in ("x", "y"))
    return pairs.distinct().join(x, "x_tag").join(y, ["y_tag", "nth"]).select("x_tag", "y_tag", "nth", "x", "y")


def searched(rows: DataFrame, columns: list[str], text: str, **equal: str) -> DataFrame:
    """UI-15: rows whose given columns have the given values and any of ``columns``, or an element of it, holds a text, in any case."""
    low = text.lower()
    arrays = {f.name for f in rows.schema if f.dataType.typeName() == "array"}
    held = [F.exists(c, lambda v: F.contains(F.lower(v), F.lit(low))) if c in arrays else F.contains(F.lower(c), F.lit(low)) for c in columns]
    kept = reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in held), F.lit(False)) if low else F.lit(True)
    return rows.where(reduce(lambda a, k: a & (F.col(k) == equal[k]), equal, kept))


def is_cacheable(alert_context: Column, persona: Column) -> Column:
    """FLT-22: whether an answer may be cached: no alert is asked about and the persona is none or resolves to the engineer."""
    name = F.translate(F.lower(F.trim(F.coalesce(persona, F.lit("")))), " -", "__")
    return (F.coalesce(alert_context, F.lit("")) == "") & ~rules.contains_any(name, PERSONA_WORDS)


def renamed_citations(alerts: DataFrame, documents: DataFrame) -> DataFrame:
    """SNK-10: alerts(id, citations of doc_id and filename) with the names that documents(doc_id, filename) give, in their order.

    A citation of an unknown document keeps its name; alerts without citations stay as they are.
    """
    cited = alerts.select("id", F.posexplode("citations").alias("nth", "c"))
    known = documents.groupBy("doc_id").agg(F.min("filename").alias("known"))
    named_ones = cited.select("id", "nth", "c.doc_id", "c.filename").join(known, "doc_id", "left")
    one = F.struct("nth", F.struct("doc_id", F.coalesce("known", "filename").alias("filename")).alias("c"))
    listed = named_ones.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("renamed"))
    return alerts.join(listed, "id", "left").withColumn("citations", F.coalesce("renamed", "citations")).drop("renamed")


def limit_bands(envelopes: DataFrame) -> DataFrame:
    """UI-11: the bands of envelopes(tag_id, ll, l, setpoint, h, hh) whose two ends are given: (tag_id, band, low, high)."""
    ends = (("high", "h", "hh"), ("above", "setpoint", "h"), ("below", "l", "setpoint"), ("low", "ll", "l"))
    bands = F.array(*(F.struct(F.lit(name).alias("band"), F.col(a).alias("low"), F.col(b).alias("high")) for name, a, b in ends))
    return envelopes.select("tag_id", F.inline(bands)).where("low is not null and high is not null")
