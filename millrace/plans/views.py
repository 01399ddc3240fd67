"""Canonical views over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW, TODAY = "2024-01-30 00:00:00", "2000-06-01"

SQL = {
    "telemetry": "SELECT ts, 'TAG-' || user_id AS tag_id, value, CASE WHEN event_type = 'error' THEN 'BAD' ELSE 'GOOD' END AS quality, event_type AS unit FROM events",
    "envelopes": "SELECT tag_id, round(avg(value) - 0.9 * stddev_pop(value), 6) AS ll, round(avg(value) - 0.6 * stddev_pop(value), 6) AS l, round(avg(value) + 1.5 * stddev_pop(value), 6) AS h, round(avg(value) + 2.5 * stddev_pop(value), 6) AS hh FROM telemetry GROUP BY tag_id",
    "edges": """SELECT md5(l_orderkey || '|' || l_linenumber) AS edge_id, 'equip:' || l_suppkey AS src, 'HAS_FAILURE' AS type, 'fm:' || (l_partkey % 25) AS dst, md5(l_orderkey || '|' || l_linenumber) AS prov_hash, 'doc:' || (l_orderkey % 500) AS doc_id, round(1 - l_discount, 2) AS confidence, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'cause-' || l_returnflag END AS cause, CASE WHEN l_linenumber = 7 THEN 'human' ELSE 'document' END AS source FROM lineitem
      UNION ALL SELECT 'p' || s_suppkey, 'equip:' || s_suppkey, 'PART_OF', 'area:' || s_nationkey, 'p' || s_suppkey, NULL, 0.9, NULL, 'document' FROM supplier
      UNION ALL SELECT 'c' || n_nationkey, 'area:' || n_nationkey, 'CONNECTED_TO', 'reg:' || n_regionkey, 'c' || n_nationkey, NULL, 0.2, NULL, 'document' FROM nation""",
    "nodes": """SELECT 'equip:' || s_suppkey AS id, 'Equipment' AS label, s_name AS surface_form FROM supplier
      UNION ALL SELECT 'area:' || n_nationkey, 'Line', n_name FROM nation UNION ALL SELECT 'reg:' || r_regionkey, 'RegulationClause', r_name FROM region
      UNION ALL SELECT DISTINCT 'fm:' || (l_partkey % 25), 'FailureMode', 'mode ' || (l_partkey % 25) FROM lineitem""",
    "plant_nodes": """SELECT 'equip:' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Instrument' ELSE 'Equipment' END AS label, p_name AS surface_form FROM part
      UNION ALL SELECT DISTINCT 'fm:' || p_brand || '-' || p_size, 'FailureMode', p_brand || ' ' || p_size FROM part
      UNION ALL SELECT DISTINCT 'proc:' || p_size, 'Procedure', 'procedure ' || p_size FROM part UNION ALL SELECT DISTINCT 'clause:' || p_type, 'RegulationClause', p_type FROM part""",
    "plant_edges": """SELECT 'n' || a.p_partkey AS edge_id, 'equip:' || a.p_partkey AS src, 'CONNECTED_TO' AS type, 'equip:' || b.p_partkey AS dst, CAST(NULL AS VARCHAR) AS doc_id, CAST(0.9 AS DOUBLE) AS confidence FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
      UNION ALL SELECT 'j' || a.p_partkey, 'equip:' || a.p_partkey, 'CONNECTED_TO', 'equip:' || b.p_partkey, NULL, CAST(0.6 AS DOUBLE) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size
      UNION ALL SELECT 'h' || a.p_partkey, 'equip:' || a.p_partkey, 'SHARES_HEADER', 'equip:' || b.p_partkey, NULL, CAST(0.8 AS DOUBLE) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 2 * a.p_size
      UNION ALL SELECT 'f' || p_partkey, 'equip:' || p_partkey, 'HAS_FAILURE', 'fm:' || p_brand || '-' || p_size, 'doc:' || p_size, CAST(0.2 AS DOUBLE) FROM part
      UNION ALL SELECT 'x' || p_partkey, 'equip:' || p_partkey, 'FIXED_BY', 'proc:' || p_size, 'doc:' || p_brand, CAST(1.0 AS DOUBLE) FROM part
      UNION ALL SELECT 'g' || p_partkey, 'equip:' || p_partkey, 'GOVERNED_BY', 'clause:' || p_type, 'doc:' || p_type, CAST(1.0 AS DOUBLE) FROM part""",
    "seeds": """SELECT s_suppkey AS question, CASE WHEN s_suppkey % 2 = 0 THEN 'Which standard governs it?' ELSE 'Why did it fail?' END AS text, nth, 'equip:' || (s_suppkey * 7 + 2 * nth + nth % 2) AS id
      FROM supplier, (SELECT unnest([0, 1, 2]) AS nth) WHERE nth = 0 OR (s_suppkey % 5 > 0 AND (nth = 1 OR s_suppkey % 3 = 0))""",
    "work_orders": "SELECT 'WO-' || o_orderkey AS wo_id, 'equip:' || l_suppkey AS equipment, 'IS-' || (l_partkey % 30) AS standard, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS next_due, o_orderstatus AS status, l_linenumber AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
}


def with_views(query: str, *names: str) -> str:
    """SQL with the named views before it."""
    wanted = [n for n in SQL if n in names or (n == "telemetry" and "envelopes" in names)]
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({SQL[n]})' for n in wanted)} {query}"


class Views:
    """Tables and views of one folder; each is read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def telemetry(self) -> DataFrame:
        quality = F.when(F.col("event_type") == "error", "BAD").otherwise("GOOD")
        return self.table("events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("TAG-"), "user_id").alias("tag_id"), "value", quality.alias("quality"), F.col("event_type").alias("unit"))

    @cached_property
    def envelopes(self) -> DataFrame:
        """One row a tag, so small beside the samples."""
        limit = lambda k: F.round(F.avg("value") + k * F.stddev_pop("value"), 6)
        return self.telemetry.groupBy("tag_id").agg(limit(-0.9).alias("ll"), limit(-0.6).alias("l"), limit(1.5).alias("h"), limit(2.5).alias("hh"))

    @cached_property
    def edges(self) -> DataFrame:
        key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c) if isinstance(c, str) else c)
        hashed = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber").cast("binary"))
        cause = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("cause-"), "l_returnflag"))
        failures = self.table("lineitem").select(hashed.alias("edge_id"), key("equip:", "l_suppkey").alias("src"), F.lit("HAS_FAILURE").alias("type"), key("fm:", F.col("l_partkey") % 25).alias("dst"), hashed.alias("prov_hash"), key("doc:", F.col("l_orderkey") % 500).alias("doc_id"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), cause.alias("cause"), F.when(F.col("l_linenumber") == 7, "human").otherwise("document").alias("source"))

        def plain(table: str, kind: str, edge: str, src: tuple, dst: tuple, confidence: float) -> DataFrame:
            none = F.lit(None).cast("string")
            return self.table(table).select(key(edge, src[1]).alias("edge_id"), key(*src).alias("src"), F.lit(kind).alias("type"), key(*dst).alias("dst"), key(edge, src[1]).alias("prov_hash"), none.alias("doc_id"), F.lit(confidence).alias("confidence"), none.alias("cause"), F.lit("document").alias("source"))

        parts = plain("supplier", "PART_OF", "p", ("equip:", "s_suppkey"), ("area:", "s_nationkey"), 0.9)
        return failures.union(parts).union(plain("nation", "CONNECTED_TO", "c", ("area:", "n_nationkey"), ("reg:", "n_regionkey"), 0.2))

    @cached_property
    def nodes(self) -> DataFrame:
        def of(table: str, prefix: str, column: str, label: str, surface: str) -> DataFrame:
            return self.table(table).select(F.concat(F.lit(prefix), column).alias("id"), F.lit(label).alias("label"), F.col(surface).alias("surface_form"))

        mode = F.col("l_partkey") % 25
        modes = self.table("lineitem").select(F.concat(F.lit("fm:"), mode).alias("id"), F.lit("FailureMode").alias("label"), F.concat(F.lit("mode "), mode).alias("surface_form")).distinct()
        return of("supplier", "equip:", "s_suppkey", "Equipment", "s_name").union(of("nation", "area:", "n_nationkey", "Line", "n_name")).union(of("region", "reg:", "r_regionkey", "RegulationClause", "r_name")).union(modes)

    @cached_property
    def plant_nodes(self) -> DataFrame:
        """A plant of pieces (each part), their failure modes, procedures and clauses."""
        part = self.table("part")

        def of(key: Column, label: str, surface: Column) -> DataFrame:
            return part.select(key.alias("id"), F.lit(label).alias("label"), surface.alias("surface_form")).distinct()

        mode = F.concat(F.lit("fm:"), "p_brand", F.lit("-"), F.col("p_size").cast("string"))
        kind = F.when(F.col("p_partkey") % 4 == 0, "Instrument").otherwise("Equipment")
        pieces = part.select(F.concat(F.lit("equip:"), "p_partkey").alias("id"), kind.alias("label"), F.col("p_name").alias("surface_form"))
        modes = of(mode, "FailureMode", F.concat_ws(" ", "p_brand", "p_size"))
        procedures = of(F.concat(F.lit("proc:"), "p_size"), "Procedure", F.concat(F.lit("procedure "), "p_size"))
        return pieces.union(modes).union(procedures).union(of(F.concat(F.lit("clause:"), "p_type"), "RegulationClause", F.col("p_type")))

    @cached_property
    def plant_edges(self) -> DataFrame:
        part = self.table("part")
        key, size = F.col("p_partkey"), F.col("p_size")
        known = part.select(F.col("p_partkey").alias("other"))

        def rows(prefix: str, kind: str, dst: Column, doc: Column, confidence: float, source: DataFrame = part) -> DataFrame:
            return source.select(F.concat(F.lit(prefix), "p_partkey").alias("edge_id"), F.concat(F.lit("equip:"), "p_partkey").alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), doc.cast("string").alias("doc_id"), F.lit(confidence).alias("confidence"))

        def beside(prefix: str, kind: str, other: Column, confidence: float) -> DataFrame:
            return rows(prefix, kind, F.concat(F.lit("equip:"), "other"), F.lit(None), confidence, part.withColumn("other", other).join(known, "other"))

        out = beside("n", "CONNECTED_TO", key + 1, 0.9).union(beside("j", "CONNECTED_TO", key + size, 0.6)).union(beside("h", "SHARES_HEADER", key + 2 * size, 0.8))
        for prefix, kind, dst, doc, confidence in (("f", "HAS_FAILURE", F.concat(F.lit("fm:"), "p_brand", F.lit("-"), "p_size"), "p_size", 0.2), ("x", "FIXED_BY", F.concat(F.lit("proc:"), "p_size"), "p_brand", 1.0), ("g", "GOVERNED_BY", F.concat(F.lit("clause:"), "p_type"), "p_type", 1.0)):
            out = out.union(rows(prefix, kind, dst, F.concat(F.lit("doc:"), doc), confidence))
        return out

    @cached_property
    def seeds(self) -> DataFrame:
        """A question for each supplier, with one to three pieces as seeds."""
        key = F.col("s_suppkey")
        text = F.when(key % 2 == 0, "Which standard governs it?").otherwise("Why did it fail?")
        rows = self.table("supplier").select(key.alias("question"), text.alias("text"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("nth"))
        rows = rows.where("nth = 0 or (question % 5 > 0 and (nth = 1 or question % 3 = 0))")
        return rows.withColumn("id", F.concat(F.lit("equip:"), F.col("question") * 7 + 2 * F.col("nth") + F.col("nth") % 2))

    @cached_property
    def work_orders(self) -> DataFrame:
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        rows = self.table("orders").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        return rows.select(F.concat(F.lit("WO-"), "o_orderkey").alias("wo_id"), F.concat(F.lit("equip:"), "l_suppkey").alias("equipment"), F.concat(F.lit("IS-"), F.col("l_partkey") % 30).alias("standard"), day("o_orderdate").alias("date"), F.when(F.col("l_linestatus") == "O", day("l_shipdate")).otherwise("").alias("next_due"), F.col("o_orderstatus").alias("status"), F.col("l_linenumber").alias("line"))
