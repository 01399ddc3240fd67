"""Property-graph reads, paths and writes over node and edge tables (JN-1, 2, 6, 8, GR-1 to 4, 6, 7, AGG-1 to 8, 24, SNK-3, SNK-4, ETL-14, 16 to 18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The edge types of the data model.
EDGE_TYPES = ("CONNECTED_TO", "PART_OF", "MENTIONED_IN", "HAS_FAILURE", "FIXED_BY", "GOVERNED_BY", "PRECEDES", "SUPERSEDES", "CAUSES", "MERGED_INTO", "FAILED_FIX", "CONTRADICTS", "CORRECTED_BY", "SHARES_HEADER", "FEEDS", "EXHIBITS_FAULT", "RESPONDS_WITH")
DECAY, LEAST_CONFIDENCE, KEPT_PATHS, OVERLAP = 0.8, 0.3, 15, 0.7


def of_types(edges: DataFrame, types: list[str]) -> DataFrame:
    """Edges of the types; an unknown type is an error."""
    if unknown := set(types) - set(EDGE_TYPES):
        raise ValueError(f"unknown edge types: {sorted(unknown)}")
    return edges.where(F.col("type").isin(*types))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end (a self-loop once), as (node, other, type, ...)."""
    there = edges.withColumnsRenamed({"src": "node", "dst": "other"})
    back = edges.where("src <> dst").withColumnsRenamed({"src": "other", "dst": "node"})
    return there.unionByName(back)


def entity_by_surface(nodes: DataFrame, surface: str) -> DataFrame:
    """At most one entity by surface (any case) or id; the least id, where several fit."""
    fits = (F.lower("surface_form") == surface.lower()) | F.col("id").isin(f"equip:{surface}", f"inst:{surface}", surface)
    return nodes.where(fits & ~F.col("label").isin("Chunk", "Section", "Document")).orderBy("id").limit(1)


def entities_by_name(nodes: DataFrame, phrase: str, limit: int = 3) -> DataFrame:
    return nodes.where(F.lower("surface_form").contains(phrase.lower()) & ~F.col("label").isin("Chunk", "Section", "Document")).orderBy("id").limit(limit)


def current(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.coalesce("superseded", F.lit(False)))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def not_human_touched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    touched = both_ways(edges.where("source = 'human'")).select(F.col("node").alias("id")).distinct()
    return nodes.join(touched, "id", "left_anti")


def failures_of(edges: DataFrame) -> DataFrame:
    """Failures of each equipment by mode: count, distinct non-empty causes and documents (joined, sorted)."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return edges.where("type = 'HAS_FAILURE'").groupBy("src", "dst").agg(F.count("*").alias("n"), joined(F.when(F.col("cause") != "", F.col("cause"))).alias("causes"), F.countDistinct("doc_id").alias("n_docs"))


def mode_counts(edges: DataFrame, limit: int = 10) -> DataFrame:
    by = edges.where("type = 'HAS_FAILURE'").groupBy(F.col("dst").alias("mode")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_equipment"), F.min("doc_id").alias("first_doc"))
    return by.orderBy(F.desc("n"), "mode").limit(limit)


def degrees(edges: DataFrame, types: list[str]) -> DataFrame:
    """Undirected degree by type of edge; nodes without edges are absent."""
    return both_ways(of_types(edges, types)).groupBy("node").agg(F.count("*").alias("degree"))


def trails(edges: DataFrame, seeds: DataFrame, types: list[str], max_hops: int) -> DataFrame:
    """Undirected trails of 1..max_hops edges from seeds(id): no edge twice, nodes may repeat.

    Columns: start, end, hops, path (edge ids), nodes, steps (type, src, dst, confidence of the stored
    edges). Each hop is one equi-join of the frontier with the edges.
    """
    step = F.struct("type", "src", "dst", "confidence")
    one_way = of_types(edges, types).select("edge_id", step.alias("step"), "src", "dst")
    hop = both_ways(one_way.withColumn("type", F.col("step.type"))).select("edge_id", "step", "node", "other")
    frontier = seeds.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array().cast("array<string>").alias("path"), F.array("id").alias("nodes"), F.array().cast("array<struct<type:string,src:string,dst:string,confidence:double>>").alias("steps"))
    found = None
    for hops in range(1, max_hops + 1):
        more = frontier.join(hop, frontier.end == hop.node).where(~F.array_contains("path", F.col("edge_id")))
        frontier = more.select("start", F.col("other").alias("end"), F.concat("path", F.array("edge_id")).alias("path"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("steps", F.array("step")).alias("steps"))
        level = frontier.withColumn("hops", F.lit(hops))
        found = level if found is None else found.union(level)
    return found.select("start", "end", "hops", "path", "nodes", "steps")


def flow_score(steps: Column, degree_of: Column) -> Column:
    """Product over steps of decay * max(confidence, 0.3) / max(degree of the stored source - 1, 1);
    ``degree_of``: map of degrees. A missing confidence counts 1, a missing degree 1."""
    factor = lambda s: DECAY * F.greatest(F.coalesce(s["confidence"], F.lit(1.0)), F.lit(LEAST_CONFIDENCE)) / F.greatest(F.coalesce(F.try_element_at(degree_of, s["src"]), F.lit(1)) - 1, F.lit(1))
    return F.aggregate(steps, F.lit(1.0), lambda p, s: p * factor(s))


def scored_paths(paths: DataFrame, degree: DataFrame) -> DataFrame:
    """Trails with their flow score: degrees join the sources of the steps."""
    keyed = paths.withColumn("path_id", F.array_join("path", ">")).withColumn("path_id", F.concat_ws("|", "start", "path_id"))
    sources = keyed.select("path_id", F.explode(F.array_distinct(F.transform("steps", lambda s: s["src"]))).alias("node")).distinct()
    maps = sources.join(degree, "node").groupBy("path_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "degree"))).alias("degree_of"))
    return keyed.join(maps, "path_id", "left").withColumn("score", flow_score(F.col("steps"), F.coalesce("degree_of", F.create_map().cast("map<string,bigint>")))).drop("degree_of")


def weighted(edges: DataFrame, **types: list[str]) -> DataFrame:
    """Edges with the factor that each gives to a flow score, a column for each list of types whose degrees count."""
    for name, kinds in types.items():
        degree = degrees(edges, kinds).withColumnsRenamed({"node": "src", "degree": name})
        weight = DECAY * F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(LEAST_CONFIDENCE)) / F.greatest(F.coalesce(name, F.lit(1)) - 1, F.lit(1))
        edges = edges.join(degree, "src", "left").withColumn(name, weight)
    return edges


def upsert_nodes(nodes: DataFrame, rows: DataFrame, version: int) -> DataFrame:
    """Nodes after a batch: properties overlay key by key (null values never overwrite), new ids are
    stamped with created_version, all in the batch with updated_version."""
    clean = rows.withColumn("props", F.map_filter("props", lambda _, v: v.isNotNull())).select(F.col("id"), F.col("label").alias("new_label"), F.col("surface_form").alias("new_surface"), F.col("props").alias("new_props"))
    j = nodes.join(clean, "id", "full_outer")
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("props", none), F.coalesce("new_props", none)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    hit = F.col("new_label").isNotNull()
    return j.select("id", F.coalesce("label", "new_label").alias("label"), F.coalesce("new_surface", "surface_form").alias("surface_form"), merged.alias("props"), F.coalesce("created_version", F.lit(version)).cast("bigint").alias("created_version"), F.when(hit, F.lit(version)).otherwise(F.col("updated_version")).cast("bigint").alias("updated_version"), F.coalesce("superseded", F.lit(False)).alias("superseded"))


def upsert_edges(edges: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges after a batch: rows with a missing end are dropped, equal (src, type, dst, prov_hash) are one, the batch wins."""
    key = ["src", "type", "dst", "prov_hash"]
    fresh = induced(nodes, rows).dropDuplicates(key)
    return edges.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def provenance_hash(doc: Column, page: Column, span: Column, box: Column, extractor: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts, joined by '|'; a null part is empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc, page, span, box, extractor)]
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def merge_modes(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """HAS_FAILURE edges moved from variant to canonical modes of merged(variant, canonical); duplicates collapse."""
    moved = edges.join(merged, (F.col("dst") == F.col("variant")) & (F.col("type") == "HAS_FAILURE"), "left")
    return moved.withColumn("dst", F.coalesce("canonical", "dst")).drop("variant", "canonical").dropDuplicates(["src", "type", "dst", "prov_hash"])


def causal_links(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """CAUSES edges (confidence 0.7, by agent) of pairs(cause, effect), on surviving modes, without self-links."""
    cause, effect = merged.select(F.col("variant").alias("cause"), F.col("canonical").alias("c2")), merged.select(F.col("variant").alias("effect"), F.col("canonical").alias("e2"))
    j = pairs.join(cause, "cause", "left").join(effect, "effect", "left")
    ends = j.select(F.coalesce("c2", "cause").alias("src"), F.coalesce("e2", "effect").alias("dst")).where("src <> dst").distinct()
    return ends.select("src", F.lit("CAUSES").alias("type"), "dst", F.lit(0.7).alias("confidence"), F.lit("agent").alias("source"))


def delta(nodes: DataFrame, edges: DataFrame, version: int) -> DataFrame:
    """What a commit touched, a row each: (graph_version, kind, value) of node ids, edge types and documents."""
    of = lambda rows, c, kind: rows.select(F.lit(version).cast("bigint").alias("graph_version"), F.lit(kind).alias("kind"), F.col(c).alias("value")).where("value is not null")
    return of(nodes, "id", "node").union(of(edges, "type", "edge_type")).union(of(edges, "doc_id", "document")).distinct()


def siblings(failures: DataFrame, tags: DataFrame) -> DataFrame:
    """Other tags of a family with the same mode: an equi-join on (family, mode). failures(tag, mode), tags(tag, family)."""
    have = failures.join(tags.where("family is not null"), "tag").distinct()
    other = have.withColumnRenamed("tag", "sibling")
    return have.join(other, ["family", "mode"]).where("tag <> sibling").select("tag", "mode", "sibling")


def ranked(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n)


