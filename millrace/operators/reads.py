"""Reads over nodes, edges, chunks and readings that serve questions: resolution, context, paths between seeds, search and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import tags
from millrace.operators.graph import both_ways, of_types, ranked


def resolved_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """JN-7: edges(src, dst, ...) with both ends looked up in ids(surface, id); an unknown end stays as it is."""
    for end in ("src", "dst"):
        known = ids.select(F.col("surface").alias(end), F.col("id").alias(f"{end}_id"))
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce(f"{end}_id", end)).drop(f"{end}_id")
    return edges


def equipment_orders(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-14: work orders(wo_id, equipment, date, status) of equipment nodes, with the equipment's name, once each."""
    names = nodes.where("label = 'Equipment'").select(F.col("id").alias("equipment"), F.col("surface_form").alias("name"))
    return orders.select("wo_id", "equipment", "date", "status").distinct().join(names, "equipment")


def equipment_context(tags_: DataFrame, edges: DataFrame, nodes: DataFrame, orders: DataFrame, recent: int = 8) -> DataFrame:
    """JN-17: for each of tags_(tag) that is an equipment's surface: its failures, newest work orders, procedures and connections.

    failures: (mode, count, causes) by mode, blank causes left out; work_orders: the ``recent`` newest of
    orders(equipment, wo_id, date), a missing date last; procedures and connected (either direction): names, distinct
    and sorted. Four grouped lists meet on the equipment, so none multiplies another. Without any of a kind its list is empty.
    """
    own = nodes.where("label = 'Equipment'").join(tags_.select(F.col("tag").alias("surface_form")).distinct(), "surface_form").select(F.col("id").alias("node"), F.col("surface_form").alias("tag"))
    names = nodes.select(F.col("id").alias("other"), F.col("surface_form").alias("name"), "label")
    ends = both_ways(edges.select("src", "dst", "type", "cause").where(F.col("type") == "CONNECTED_TO")).select("node", "other")
    to = lambda kind, label: edges.where(F.col("type") == kind).select(F.col("src").alias("node"), F.col("dst").alias("other"), "cause").join(names.where(F.col("label") == label), "other")
    listed = lambda rows, c: rows.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias(c))
    cause = F.trim("cause")
    modes = to("HAS_FAILURE", "FailureMode").join(own.select("node"), "node", "left_semi").groupBy("node", "name").agg(F.count("*").alias("count"), F.array_sort(F.collect_set(F.when(cause != "", cause))).alias("causes"))
    failures = modes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("mode"), "count", "causes"))).alias("failures"))
    newest = ranked(orders.select(F.col("equipment").alias("node"), "wo_id", "date").distinct().join(own.select("node"), "node", "left_semi"), ["node"], [F.desc_nulls_last("date"), "wo_id"], recent)
    work = newest.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nth", "wo_id", "date"))).alias("work_orders"))
    out = own
    for part in (failures, work, listed(to("FIXED_BY", "Procedure"), "procedures"), listed(ends.join(names, "other"), "connected")):
        out = out.join(part, "node", "left")
    filled = [F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("failures", "work_orders", "procedures", "connected")]
    return out.select("tag", *filled)


def relations(edges: DataFrame, nodes: DataFrame, types: list[str], limit: int = 40) -> DataFrame:
    """GR-9: up to ``limit`` edges of every node, the surest first: (node, type, src, dst, confidence, other, other_surface, other_label)."""
    ends = both_ways(of_types(edges, types).withColumns({"a": F.col("src"), "z": F.col("dst")}).select("edge_id", "src", "dst", "a", "z", "type", "confidence"))
    best = ranked(ends, ["node"], [F.desc("confidence"), "type", "other", "edge_id"], limit)
    known = nodes.select(F.col("id").alias("other"), F.col("surface_form").alias("other_surface"), F.col("label").alias("other_label"))
    return best.join(known, "other").select("node", "edge_id", "type", F.col("a").alias("src"), F.col("z").alias("dst"), "confidence", "other", "other_surface", "other_label")


def shared_utilities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR-10: the equipment on a common header with each equipment, one hop in either direction: (tag, other, label), once each."""
    equipment = nodes.where("label = 'Equipment'")
    own, other = (equipment.select(F.col("id").alias(key), F.col("surface_form").alias(name)) for key, name in (("node", "tag"), ("other", "shared_with")))
    ends = both_ways(edges.where("type = 'SHARES_HEADER'").select("src", "dst", "type")).select("node", "other").distinct()
    return ends.join(own, "node").join(other, "other").select("tag", "shared_with", F.lit("Equipment").alias("label"))


def chunks_containing(chunks: DataFrame, needle: str, limit: int = 6) -> DataFrame:
    """FLT-3: the first chunks(id, text) that hold a string, in any case."""
    return chunks.where(F.contains(F.lower("text"), F.lit(needle.lower()))).orderBy("id").limit(limit).select("id")


def chunks_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """FLT-4: chunks(chunk_id) of documents(doc_id), by the id's prefix 'chunk:<doc>#'."""
    keyed = chunks.withColumn("doc_id", tags.doc_of_chunk(F.col("chunk_id")))
    return keyed.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def named_by_any(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """FLT-10: all nodes whose surface holds one of the terms, in any case; without terms none."""
    held = F.lit(False)
    for term in terms:
        held = held | F.contains(F.lower("surface_form"), F.lit(term.lower()))
    return nodes.where(held)


def valid_limits(ll: Column, l: Column, h: Column, hh: Column, setpoint: Column) -> Column:  # noqa: E741
    """FLT-23: an update of limits is taken if they are in order and the setpoint lies inside l and h; a missing one is no obstacle."""
    ordered = lambda a, b: F.coalesce(a <= b, F.lit(True))
    return ordered(ll, l) & ordered(l, h) & ordered(h, hh) & F.coalesce((l < setpoint) & (setpoint < h), F.lit(True))


def is_fresh(age_s: Column, active_s: int) -> Column:
    """FLT-16: whether an alarm stands: no more than ``active_s`` seconds old, a time after now or an unknown or unreadable one (null) included."""
    return F.coalesce(age_s <= active_s, F.lit(True))


def decided(drafts: DataFrame, decisions: DataFrame, schedules: DataFrame) -> DataFrame:
    """JN-10: drafts(id) with their decision(id, decision) and schedule(id, due), where there are any."""
    return drafts.join(decisions, "id", "left").join(schedules, "id", "left").select("id", F.coalesce("decision", F.lit("open")).alias("decision"), "due")


def briefs_for(crew: DataFrame, briefs: DataFrame) -> DataFrame:
    """JN-18: crew(member, lang) with the brief(lang, brief) of their language, or else the English one."""
    own = crew.join(briefs.withColumnRenamed("brief", "own"), "lang", "left")
    english = briefs.where("lang = 'en'").select(F.col("brief").alias("english"))  # one row at most
    return own.join(F.broadcast(english), F.lit(True), "left").select("member", "lang", F.coalesce("own", "english").alias("brief"))


def procedures_for(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-6: the procedures that fix each equipment, with their distinct documents, sorted: (tag, procedure, docs)."""
    of = lambda label, key, name: nodes.where(F.col("label") == label).select(F.col("id").alias(key), F.col("surface_form").alias(name))
    fixes = edges.where("type = 'FIXED_BY'").select("src", "dst", "doc_id").join(of("Equipment", "src", "tag"), "src").join(of("Procedure", "dst", "procedure"), "dst")
    return fixes.groupBy("tag", "procedure").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def crew_languages(crew: DataFrame) -> DataFrame:
    """AGG-23: the languages of a crew(lang), English always, one a row."""
    return crew.select("lang").where("lang is not null").union(crew.sparkSession.sql("SELECT 'en' AS lang")).distinct()


def unsupported_tags(answers: DataFrame) -> DataFrame:
    """SET-5, ETL-30: answers(id, claim, evidence) with the tags that a claim names and its evidence does not, sorted."""
    extra = F.array_sort(F.array_except(tags.find_tags(F.coalesce("claim", F.lit(""))), tags.find_tags(F.coalesce("evidence", F.lit("")))))
    return answers.select("id", F.array_join(extra, ",").alias("unsupported"), F.size(extra).cast("bigint").alias("n"))


def assets(envelopes: DataFrame) -> DataFrame:
    """PRJ-13: envelopes(tag_id, setpoint, units) as (unit, tag, setpoint, units), by unit and tag; a tag without a dot is its own unit."""
    return envelopes.select(tags.unit_area(F.col("tag_id")).alias("unit"), F.col("tag_id").alias("tag"), "setpoint", "units").orderBy("unit", "tag")


def level_two(value: Column, low: Column, high: Column) -> Column:
    """MTH-7: 'max' above the upper limit, 'min' below the lower one, strictly; missing limits never fire."""
    return F.when(value > high, "max").when(value < low, "min")


def quantised(value: Column, step: Column) -> Column:
    """MTH-10: a sensor's reading in whole steps, halves to the even step."""
    return F.when(step > 0, F.bround(value / step) * step).otherwise(value)


def citations(rows: DataFrame) -> DataFrame:
    """UI-16: one citation of rows(doc_id, page, source) for each document and page, with the least source."""
    return rows.groupBy("doc_id", "page").agg(F.min("source").alias("source"))
