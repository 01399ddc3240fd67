"""The graph's single writer as a stream: parsed subgraphs, grouped upserts, versions and deltas (ETL-14, ETL-15, SNK-3, SNK-4, SNK-8, AGG-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.lineage import written
from millrace.operators.graph import EDGE_TYPES, provenance_hash
from millrace.streaming.ledger import BatchTables

SUBGRAPH = """doc_id string, nodes array<struct<type: string, surface_form: string, resolved_id: string, props: map<string,string>>>,
 edges array<struct<type: string, src: string, dst: string, props: map<string,string>,
  provenance: struct<doc_id: string, page: int, span: string, bbox: string, extractor_version: string, confidence: double, source: string>>>"""
TABLES = {
    "nodes": "version bigint, id string, label string, surface_form string, props map<string,string>",
    "edges": "version bigint, src string, type string, dst string, prov_hash string, doc_id string, page int, confidence double, source string, props map<string,string>",
    "parked": "raw string, reason string",
    "deltas": "version bigint, kind string, value string",
}


def parsed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(raw) as (subgraphs(doc_id, at, nodes, edges), parked(raw, reason)).

    What is no JSON object with a document, holds a node without a resolved id or an edge of an unknown
    type is parked whole, with its reason; the other subgraphs of a batch are not held up. Two equal texts are two subgraphs.
    """
    rows = raw.select("raw", F.from_json("raw", SUBGRAPH).alias("s"))
    unresolved = F.exists(F.coalesce("s.nodes", F.array()), lambda n: n["resolved_id"].isNull() | (n["resolved_id"] == ""))
    unknown = F.exists(F.coalesce("s.edges", F.array()), lambda e: e["type"].isNull() | ~e["type"].isin(*EDGE_TYPES))
    reason = F.when(F.col("s").isNull() | F.col("s.doc_id").isNull(), "not a subgraph").when(unresolved, "unresolved node").when(unknown, "unknown edge type")
    # a good subgraph's text is not written beside its parts
    rows = rows.select(F.when(reason.isNotNull(), F.col("raw")).alias("raw"), F.when(reason.isNull(), F.col("s")).alias("s"), reason.alias("reason"), F.struct("s.doc_id", F.xxhash64("raw"), F.monotonically_increasing_id()).alias("at"))
    rows = written(rows, "subgraphs")
    return rows.where("reason is null").select("s.doc_id", "at", "s.nodes", "s.edges"), rows.where("reason is not null").select("raw", "reason")


def grouped_nodes(subgraphs: DataFrame) -> DataFrame:
    """One row a node: the label of the first mention; of the surface and of each property the last value that is not null."""
    each = subgraphs.select("at", F.posexplode("nodes").alias("nth", "node")).select(F.struct("at", "nth").alias("at"), "node.*")
    last = each.groupBy(F.col("resolved_id").alias("id")).agg(F.min_by("type", "at").alias("label"), F.max_by("surface_form", F.when(F.col("surface_form").isNotNull(), F.col("at"))).alias("surface_form"))
    values = each.select(F.col("resolved_id").alias("id"), "at", F.explode("props").alias("key", "value")).where("value is not null").groupBy("id", "key").agg(F.max_by("value", "at").alias("value"))
    props = values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))
    return last.join(props, "id", "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))


def resolved_edges(subgraphs: DataFrame) -> DataFrame:
    """All edges of subgraphs; ends named by a surface of their own subgraph become its id, others stay."""
    keyed = subgraphs.select("at", F.coalesce("nodes", F.array()).alias("nodes"), F.posexplode("edges").alias("nth", "e"))

    def end(name: str):
        # the last node of that surface, as a later one overrides an earlier one
        found = F.filter("nodes", lambda n: n["surface_form"] == F.col("e")[name])
        return F.coalesce(F.try_element_at(found, F.lit(-1))["resolved_id"], F.col("e")[name]).alias(name)

    p = "e.provenance."
    prov = provenance_hash(*(F.col(p + c) for c in ("doc_id", "page", "span", "bbox", "extractor_version")))
    return keyed.select(F.struct("at", "nth").alias("at"), end("src"), F.col("e.type").alias("type"), end("dst"), prov.alias("prov_hash"), F.col(p + "doc_id").alias("doc_id"), F.col(p + "page").alias("page"), F.col(p + "confidence").alias("confidence"), F.col(p + "source").alias("source"), F.map_filter(F.coalesce("e.props", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull()).alias("props"))


def grouped_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, type, dst, prov_hash) of resolved edges, the last."""
    newest = Window.partitionBy("src", "type", "dst", "prov_hash").orderBy(F.desc("at"))
    return edges.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "at")


class GraphWriter:
    """Tables of a graph that batches of subgraphs are committed to.

    A batch is one transaction: nodes, edges and delta carry its version, and nothing of it is read
    before its ledger row stands, which also announces it. A replay of a committed batch changes nothing; of
    one that was killed, it writes the same again. Batches without a good subgraph take no version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.tables = BatchTables(spark, path, TABLES)

    def nodes(self) -> DataFrame:
        """The graph's nodes: (id, label, surface_form, props, created_version, updated_version); later versions overlay key by key."""
        rows = self.tables.read("nodes")
        named = F.when(F.col("surface_form").isNotNull(), F.col("version"))
        one = rows.groupBy("id").agg(F.min_by("label", "version").alias("label"), F.max_by("surface_form", named).alias("surface_form"), F.min("version").alias("created_version"), F.max("version").alias("updated_version"))
        values = rows.select("id", "version", F.explode("props").alias("key", "value")).groupBy("id", "key").agg(F.max_by("value", "version").alias("value"))
        props = values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))
        return one.join(props, "id", "left").select("id", "label", "surface_form", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "created_version", "updated_version")

    def edges(self) -> DataFrame:
        """The graph's edges; of one (src, type, dst, prov_hash) the newest version."""
        newest = Window.partitionBy("src", "type", "dst", "prov_hash").orderBy(F.desc("version"))
        return self.tables.read("edges").withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "batch_id")

    def deltas(self) -> DataFrame:
        """(version, kind, value): the nodes, edge types and documents of each commit, a row each."""
        return self.tables.read("deltas").drop("batch_id")

    def commit(self, raw: DataFrame, batch_id: int) -> int | None:
        """Commit raw(raw) as one batch and give its version, null if it has none; edges whose ends are no nodes by then are left out."""
        last, version = self.tables.last()
        if batch_id <= last:
            return self.tables.ledger().where(F.col("batch_id") == batch_id).first().version
        good, parked = parsed(raw)
        self.tables.begin(batch_id)
        self.tables.write("parked", parked)
        some = bool(good.limit(1).count())
        if some:
            version += 1
            stamp = F.lit(version).cast("bigint").alias("version")
            nodes, edges = written(grouped_nodes(good), "nodes"), resolved_edges(good)
            known = self.tables.read("nodes").select("id").union(nodes.select("id"))
            # the few ends that are no nodes, so that not every edge is shuffled for each end
            missing = written(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(known, "id", "left_anti"), "missing")
            whole = edges.where("src is not null and dst is not null")
            for end in ("src", "dst"):
                whole = whole.join(missing.withColumnRenamed("id", end), end, "left_anti")
            whole = grouped_edges(whole)
            touched = lambda rows, c, kind: rows.select(stamp, F.lit(kind).alias("kind"), F.col(c).alias("value"))
            delta = touched(nodes, "id", "node").union(touched(edges, "type", "edge_type")).union(touched(good, "doc_id", "document")).distinct()
            for name, rows in (("nodes", nodes.select(stamp, "*")), ("edges", whole.select(stamp, "*")), ("deltas", delta)):
                self.tables.write(name, rows)
        self.tables.commit(version if some else None)
        return version if some else None

    def announcements(self) -> DataFrame:
        """A stream of (batch_id, version), a row for each commit once it stands; a replay announces nothing again."""
        return self.tables.stream_ledger()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Commit a stream of raw(raw), batch by batch, until what is there has been read."""

        def commit(batch: DataFrame, batch_id: int) -> None:
            self.commit(batch, batch_id)

        return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
