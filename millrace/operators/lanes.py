"""Corrections, procedures, outlines, plans and conversations as joins and windows over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from millrace.functions.lineage import written
from millrace.operators.graph import both_ways, ranked

# A numbered heading, the deepest level and the longest heading of an outline.
HEADING = r"^\s*(\d+(?:\.\d+)*)[.)]?\s+\S"
DEEPEST, LONGEST_HEADING = 4, 90
LISTS = {"corrected_by": "author", "corrections": "text", "correction_ids": "id"}
LISTED = 1 << 18  # values of lists that a batch holds, but for those of its last row
SIGNATURE = "array<struct<tag_id:string,direction:int,magnitude:double>>"


def failures_with_corrections(edges: DataFrame, nodes: DataFrame, corrections: DataFrame, glue: str | None = None) -> DataFrame:
    """JN-3, AGG-2: the failures of each equipment by mode, with what engineers said of their documents.

    Columns: tag, mode, count (distinct edges), causes (not blank), docs, sources, corrected_by, corrections and
    correction_ids, each list distinct and sorted, the last three joined by ``glue`` if it is given. corrections(doc_id, id,
    author, text) meet the distinct documents of a mode and not its edges, so a document that is corrected twice counts its
    failures once. A mode's lists are as long as the result asks for, so they are made where they are returned: every task has
    each document's corrections once, and neither lists nor pairs of modes and documents are shuffled or sorted.
    """
    names = written(nodes.where(F.col("label").isin("Equipment", "FailureMode")).select("id", "label", "surface_form"), "names")
    of = lambda label, key, name: names.where(F.col("label") == label).select(F.col("id").alias(key), F.col("surface_form").alias(name))
    rows = edges.where("type = 'HAS_FAILURE'").select("src", "dst", "edge_id", "doc_id", "cause", "source").join(of("Equipment", "src", "tag"), "src").join(of("FailureMode", "dst", "mode"), "dst")
    rows = rows.select("tag", "mode", "edge_id", "doc_id", "cause", "source").repartition("tag", "mode")
    listed = lambda c: F.sort_array(F.collect_set(c))
    counted = rows.groupBy("tag", "mode").agg(F.countDistinct("edge_id").alias("count"), listed(F.when(F.col("cause") != "", F.col("cause"))).alias("causes"), listed("doc_id").alias("docs"), listed("source").alias("sources"))
    counted = written(counted, "failures")
    said = written(corrections.where("doc_id is not null").groupBy("doc_id").agg(*(listed(c).alias(name) for name, c in LISTS.items())), "corrections")
    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism
    told = said.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    asked = counted.withColumn("task", F.pmod(F.xxhash64("tag", "mode"), F.lit(tasks)).cast("int"))
    ordered = told.unionByName(asked, allowMissingColumns=True).repartitionById(tasks, F.col("task")).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    kind = StringType() if glue is not None else ArrayType(StringType())
    return ordered.drop("task").mapInArrow(_told(counted.columns, glue), StructType([*counted.schema.fields, *(StructField(c, kind) for c in LISTS)]))


def _told(columns: list[str], glue: str | None) -> Callable:
    """A task's rows: first those of documents with their lists of corrections, then, without a doc_id, those of modes, which get the lists of their docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, told = [], None
        for batch in batches:
            n = len(batch) - batch.column("doc_id").null_count
            if n:
                said.append(batch.slice(0, n).select(["doc_id", *LISTS]))
            modes = batch.slice(n).select(columns)
            if not len(modes):
                continue
            if told is None:
                told, said = _numbered(said), []
            first, size, found = 0, 0, []
            for i, docs in enumerate(modes.column("docs").to_pylist()):
                found.append(_numbers(told, docs))
                size += sum(map(len, found[-1]))
                if size >= LISTED or i + 1 == len(modes):
                    lists = [_lists(values, [row[k] for row in found], glue) for k, (values, _) in enumerate(told[1])]
                    yield pa.RecordBatch.from_arrays([*modes.slice(first, len(found)).columns, *lists], [*columns, *LISTS])
                    first, size, found = i + 1, 0, []

    return run


def _numbered(said: list[pa.RecordBatch]) -> tuple[dict, list]:
    """The place of each document, and for each kind of list its values in order and the numbers of those that each place has."""
    if not said:
        return {}, [(pa.array([], pa.large_string()), []) for _ in LISTS]
    table, out = pa.Table.from_batches(said), []
    for name in LISTS:
        parts = table[name].chunks
        coded = pa.chunked_array([p.flatten().cast(pa.large_string()) for p in parts]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        ends = np.cumsum(np.concatenate([pc.list_value_length(p).to_numpy(zero_copy_only=False) for p in parts]))
        out.append((coded.dictionary.take(order), np.split(rank[coded.indices.to_numpy()], ends[:-1])))
    return {doc: i for i, doc in enumerate(table["doc_id"].to_pylist())}, out


def _numbers(told: tuple[dict, list], docs: list[str]) -> list[np.ndarray]:
    """The numbers of the values that the documents have, for each kind of list: each once, in order."""
    at = [told[0][d] for d in docs if d in told[0]]
    return [np.unique(np.concatenate([parts[i] for i in at])) if at else np.empty(0, np.int32) for _, parts in told[1]]


def _lists(values: pa.Array, rows: list[np.ndarray], glue: str | None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(np.concatenate(rows))).cast(pa.string()))
    return lists if glue is None else pc.binary_join(lists, glue)


def with_procedures(modes: DataFrame, procedures: DataFrame) -> DataFrame:
    """JN-4: fault modes(id) with each procedure(mode, procedure); one row with null where there is none."""
    return modes.join(procedures.withColumnRenamed("mode", "id"), "id", "left").select("id", "procedure")


def corrections_of(corrections: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-5: corrections(doc_id, id, author, corrected_by, text) of documents(doc_id): (doc_id, correction_id, correction, author).

    The author is the correction's, else the one named on the edge, else 'an engineer'.
    """
    found = corrections.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.select("doc_id", F.col("id").alias("correction_id"), F.col("text").alias("correction"), F.coalesce("author", "corrected_by", F.lit("an engineer")).alias("author"))


def deviation_edges(deviations: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-19, SNK-7: rows(mode, area) whose area is a node that exists, once each."""
    return deviations.select("mode", "area").distinct().join(nodes.select(F.col("id").alias("area")), "area", "left_semi")


def named_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """PRJ-10: citations(cited) with the file name of documents(doc_id, filename), cited with or without 'doc:'."""
    bare = F.regexp_replace("cited", "^doc:", "").alias("doc_id")
    return citations.select("cited", bare).join(documents, "doc_id", "left").select("cited", "filename")


def parsed_library(rows: DataFrame) -> DataFrame:
    """PRJ-11, PRJ-12: library rows(id, signature_json) with the signature as structs; rows without a readable one go."""
    return rows.withColumn("signature", F.from_json("signature_json", SIGNATURE)).where("signature is not null").drop("signature_json")


def diagnosis_id(at: Column, tag: Column) -> Column:
    """PRJ-15: the id of a diagnosis: its whole second and the tag."""
    return F.concat_ws(":", F.lit("diag"), F.floor(at).cast("string"), tag)


def valid_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """FLT-19: proposed groups(canonical, variant) of which both labels(label) are known, in any case.

    A group whose canonical label was invented goes; a known one with no variant left keeps a row with null.
    """
    known = labels.select(F.upper("label").alias("known")).distinct()
    kept = groups.join(known, F.upper("canonical") == F.col("known"), "left_semi")
    variants = known.select("known", F.lit(True).alias("ok"))
    seen = kept.join(variants, F.upper("variant") == F.col("known"), "left")
    use = F.col("ok") & (F.upper("variant") != F.upper("canonical"))
    listed = seen.select("canonical", F.when(use, F.col("variant")).alias("variant")).distinct()
    some = listed.where("variant is not null")
    return some.union(listed.where("variant is null").join(some.select("canonical").distinct(), "canonical", "left_anti"))


def valid_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """FLT-19: proposed links(cause, effect) between two different known labels."""
    known = labels.select(F.upper("label").alias("known")).distinct()
    kept = links.where(F.upper("cause") != F.upper("effect"))
    for end in ("cause", "effect"):
        kept = kept.join(known, F.upper(end) == F.col("known"), "left_semi")
    return kept


def connections(found: DataFrame, components: DataFrame) -> DataFrame:
    """FLT-20: drawn connections(src, dst) between two different components(tag) of the same drawing."""
    kept = found.where("src <> dst")
    for end in ("src", "dst"):
        kept = kept.join(components.select("drawing", F.col("tag").alias(end)).distinct(), ["drawing", end], "left_semi")
    return kept


def outline(pages: DataFrame) -> DataFrame:
    """STR-20: the numbered headings of pages(doc_id, page, text): one row with its level and place in the page."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    number = F.regexp_extract("line", HEADING, 1)
    title = F.regexp_replace("line", r"^\s+|\s+$", "")
    level = F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(DEEPEST))
    return lines.where((number != "") & (F.length(title) < LONGEST_HEADING)).select("doc_id", "page", "line_no", title.alias("title"), level.alias("level"))


def sections(entries: DataFrame, lengths: DataFrame) -> DataFrame:
    """WIN-7: entries(doc_id, nth, level, page) with their last page and parent, the nearest earlier entry of a lower level
    as ``doc_id#secN``, or else the document.

    A section ends before the next one's page, never before its own; the last ends with the document (doc_id, n_pages).
    """
    w = Window.partitionBy("doc_id").orderBy("nth")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.when(F.col("level") == k, F.last(F.when(F.col("level") < k, F.col("nth")), ignorenulls=True).over(before)) for k in range(2, DEEPEST + 1)]
    rows = entries.withColumn("next_page", F.lead("page").over(w)).withColumn("parent", F.coalesce(F.concat("doc_id", F.lit("#sec"), F.coalesce(*nearest)), F.col("doc_id").cast("string"))).join(lengths, "doc_id")
    last = F.greatest(F.coalesce(F.col("next_page") - 1, F.col("n_pages")), F.col("page"))
    return rows.select("doc_id", "nth", "level", F.col("page").alias("page_start"), last.alias("page_end"), "parent")


def steps(orders: DataFrame, edges: DataFrame, nodes: DataFrame, procedures: DataFrame, limit: int = 50) -> DataFrame:
    """JN-15: the procedure steps of orders(id): (id, step_index, step_text, sop_id, sop_name).

    By FOLLOWS_SOP edges; for an order without steps that way, by the FIXED_BY procedures of equipment one or two hops of
    MENTIONED_IN or MENTIONS away in either direction, the first ``limit`` steps by index, then procedure. procedures(id,
    name, steps) hold arrays; one without steps gives none. An order that reaches a procedure twice has its steps once.
    """
    arrays = procedures.select(F.col("id").alias("sop_id"), F.col("name").alias("sop_name"), F.posexplode("steps").alias("step_index", "step_text"))
    columns = ["id", "step_index", "step_text", "sop_id", "sop_name"]
    follows = edges.where("type = 'FOLLOWS_SOP'").select(F.col("src").alias("id"), F.col("dst").alias("sop_id")).distinct()
    direct = orders.select("id").distinct().join(follows, "id").join(arrays, "sop_id").select(*columns)
    rest = orders.select("id").distinct().join(direct.select("id").distinct(), "id", "left_anti")
    near = both_ways(edges.where(F.col("type").isin("MENTIONED_IN", "MENTIONS")).select("edge_id", "src", "dst")).select("edge_id", "node", "other")
    equipment = nodes.where("label = 'Equipment'").select(F.col("id").alias("at"))
    fixed = edges.where("type = 'FIXED_BY'").select(F.col("src").alias("at"), F.col("dst").alias("sop_id")).join(equipment, "at", "left_semi").distinct()
    # only hops that end at such equipment lead to a procedure, so no first hop is joined with all that mentions the same equipment
    ending = near.join(fixed, F.col("other") == F.col("at")).select("node", "edge_id", "sop_id")
    one = rest.join(ending, F.col("id") == F.col("node")).select("id", "sop_id")
    first = rest.join(near, F.col("id") == F.col("node")).select("id", F.col("other").alias("at"), F.col("edge_id").alias("first"))
    two = first.join(ending, F.col("at") == F.col("node")).where("edge_id <> first").select("id", "sop_id")
    reached = one.union(two).distinct()
    return direct.union(ranked(reached.join(arrays, "sop_id"), ["id"], ["step_index", "sop_id"], limit).select(*columns))


def trace_documents(trace: DataFrame) -> DataFrame:
    """ETL-31: the distinct documents that each answer's tool rows(id, doc_id, docs) name."""
    named = F.concat(F.coalesce("docs", F.array().cast("array<string>")), F.array("doc_id"))
    return trace.select("id", F.explode(named).alias("doc")).where("doc is not null and doc <> ''").distinct()


def assignments(updates: DataFrame) -> DataFrame:
    """ETL-34: updates(id, ts, status) as the latest status and when each status was reached first."""
    first = updates.groupBy("id", "status").agg(F.min("ts").alias("first_ts"))
    latest = updates.groupBy("id").agg(F.max_by("status", F.struct("ts", "status")).alias("latest"))
    return first.join(latest, "id")


def coverage(topics: DataFrame, sessions: DataFrame) -> DataFrame:
    """ETL-35: for each session(id, n_turns, cursor): mean coverage of topics(id, status, coverage), all covered, turns not yet digested."""
    per = topics.groupBy("id").agg(F.avg("coverage").alias("mean"), F.every(F.col("status") == "covered").alias("done"))
    return sessions.join(per, "id", "left").select("id", F.coalesce("mean", F.lit(0.0)).alias("coverage"), F.coalesce("done", F.lit(False)).alias("all_covered"), (F.col("n_turns") - F.col("cursor")).alias("undigested"))


def upserted(alerts: DataFrame) -> DataFrame:
    """UI-6: the newest of alerts(id, fingerprint, ts, status) under each id or, without one, fingerprint."""
    key = F.coalesce("id", "fingerprint")
    return alerts.groupBy(key.alias("key")).agg(F.max("ts").alias("ts"), F.max_by("status", F.struct("ts", "status")).alias("status"))


def with_investigation(alerts: DataFrame, investigations: DataFrame) -> DataFrame:
    """UI-8: alerts(alert_id) with the first investigation(alert_ref, id) that refers to them, if any."""
    first = investigations.groupBy(F.col("alert_ref").alias("alert_id")).agg(F.min("id").alias("investigation"))
    return alerts.join(first, "alert_id", "left")
