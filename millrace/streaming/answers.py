"""Cached answers that follow the graph: deltas take stale ones out, and new failures put speculative ones in (STM-14, ETL-27, ETL-29, ETL-32, SET-6, STM-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import tags
from millrace.functions.lineage import written
from millrace.operators.answers import speculative_questions
from millrace.operators.retrieval import cache_key
from millrace.streaming.ledger import BatchTables
from millrace.streaming.writer import GraphWriter

TABLES = {
    "answers": "key string, question string, answer string, cited array<string>, version bigint",
    "gone": "key string, version bigint",
    "alerts": "claim string, tag string, mode string, count bigint, family string, siblings array<string>, version bigint",
}


def failure_triggers(touched: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ETL-27: failures of touched(id) equipment that are worth a look: (tag, mode, count, family, siblings).

    Worth a look: two failures of one mode or more, or one that other equipment of the family (the tag
    without its trailing capitals) has had too. Siblings come by an equi-join on family and mode.
    """
    equipment = nodes.where("label = 'Equipment'").select(F.col("id").alias("src"), F.col("surface_form").alias("tag"))
    modes = nodes.where("label = 'FailureMode'").select(F.col("id").alias("dst"), F.col("surface_form").alias("mode"))
    failed = edges.where("type = 'HAS_FAILURE'").select("src", "dst").join(equipment, "src").join(modes, "dst")
    counted = failed.groupBy("src", "tag", "mode").agg(F.count("*").alias("count")).withColumn("family", tags.family_of(F.col("tag")))
    mine = counted.join(touched.select(F.col("id").alias("src")).distinct(), "src", "left_semi").drop("src")
    others = counted.select("family", "mode", F.col("tag").alias("sibling")).distinct()
    near = mine.join(others, ["family", "mode"]).where("sibling <> tag").groupBy("tag", "mode").agg(F.array_sort(F.collect_set("sibling")).alias("siblings"))
    rows = mine.join(near, ["tag", "mode"], "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>")))
    return rows.where((F.size("siblings") > 0) | (F.col("count") >= 2))


class AnswerCache:
    """Answers by key, with what took them out and the failures that were claimed; batches append, and readers see committed ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = BatchTables(spark, path, TABLES)

    def answers(self) -> DataFrame:
        """The answers that stand: the newest of each key, unless a later delta touched one of its cited nodes."""
        newest = Window.partitionBy("key").orderBy(F.desc("version"), F.desc("batch_id"))
        own = self.tables.read("answers").withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "batch_id")
        gone = self.tables.read("gone").groupBy("key").agg(F.max("version").alias("gone"))
        return own.join(gone, "key", "left").where("gone is null or gone <= version").drop("gone")

    def alerts(self) -> DataFrame:
        return self.tables.read("alerts").drop("batch_id")

    def put(self, answers: DataFrame, version: int) -> None:
        """Add answers(question, answer, cited) that were given at a version of the graph, as a batch of their own."""
        self.tables.begin(self.tables.last()[0] + 1)
        keyed = answers.select(cache_key(F.col("question")).alias("key"), "question", "answer", "cited", F.lit(version).cast("bigint").alias("version"))
        self.tables.write("answers", keyed)
        self.tables.commit(None)

    def follow(self, deltas: DataFrame, graph: GraphWriter, upto: int) -> None:
        """Apply deltas(version, kind, value) up to a version: stale answers go, new failures are claimed and answered ahead.

        Touched nodes meet the cited nodes of all standing answers in one equi-join. Failures are looked for
        if a delta has HAS_FAILURE edges, each (tag, mode, count) is claimed once for ever, and its three questions are
        answered under the equipment and its siblings. Deltas that were applied before are left out, so a replay changes nothing.
        """
        last, seen = self.tables.last()
        self.tables.begin(last + 1)
        fresh = written(deltas.where((F.col("version") > seen) & (F.col("version") <= upto)), "deltas")
        nodes = fresh.where("kind = 'node'").select(F.col("value").alias("id"), "version")
        cited = self.answers().select("key", "version", F.explode("cited").alias("id")).withColumnRenamed("version", "given")
        hit = cited.join(nodes, "id").where("version > given").groupBy("key").agg(F.max("version").alias("version"))
        self.tables.write("gone", hit)
        failing = fresh.where("kind = 'edge_type' and value = 'HAS_FAILURE'").select("version").distinct()
        touched = nodes.join(failing, "version", "left_semi").where("id like 'equip:%'")
        found = failure_triggers(touched, graph.nodes(), graph.edges())
        claim = F.concat_ws(":", F.lit("failure"), "tag", "mode", F.col("count").cast("string"))
        stamp = F.lit(upto).cast("bigint").alias("version")
        new = written(found.withColumn("claim", claim).join(self.tables.read("alerts").select("claim"), "claim", "left_anti").select("*", stamp), "triggers")
        self.tables.write("alerts", new)
        asked = speculative_questions(new).join(new.select("claim", "mode", "count", "siblings"), "claim")
        cites = F.transform(F.concat(F.array("tag"), "siblings"), lambda t: F.concat(F.lit("equip:"), t))
        text = F.format_string("%s had %s %d times", "tag", F.lower("mode"), F.col("count"))
        self.tables.write("answers", asked.select(cache_key(F.col("question")).alias("key"), "question", text.alias("answer"), cites.alias("cited"), stamp))
        self.tables.commit(upto)

    def start(self, graph: GraphWriter, checkpoint: str) -> StreamingQuery:
        """Follow a graph's commits as a stream, until what is announced has been applied."""

        def apply(batch: DataFrame, _: int) -> None:
            upto = batch.agg(F.max("version")).first()[0]
            if upto is not None:
                self.follow(graph.deltas(), graph, upto)

        return graph.announcements().writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
