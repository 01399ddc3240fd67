"""Exact dedup by a heavy-hitter split: Misra-Gries finds frequent digests, their winners are broadcast."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import materialize

#: Counters of a summary: every digest of more than 1 / (COUNTERS + 1) of the rows is among them, so
#: this bounds both the broadcast (rows of 60 bytes) and the share of rows that an ordinary group may have.
COUNTERS = 1024
#: Summaries that one task merges.
FAN = 64

_SUMMARY = "part bigint, digest binary, n bigint"


def normalised(text: Column) -> Column:
    """The text (null: empty) with one space for each run of white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def trim(held: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """At most ``counters`` entries: all counts go down by the largest count that finds no counter (Misra-Gries, merged)."""
    if len(held) <= counters:
        return held
    cut = heapq.nlargest(counters + 1, held.values())[-1]
    return {digest: n - cut for digest, n in held.items() if n > cut}


def _summary(part: int, held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["part", "digest", "n"])


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest): at most ``counters`` of them, among which is every one of more than 1 / (counters + 1) of all rows.

    Each partition is summarised in one pass; summaries are merged FAN at a time, so no task and no
    driver holds more than FAN of them. Nulls are not counted; an empty table has no frequent digest.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for entry in pc.value_counts(batch.column(0).drop_null()).to_pylist():
                held[entry["values"]] = held.get(entry["values"], 0) + entry["counts"]
            held = trim(held, counters)
        yield _summary(TaskContext.get().partitionId(), held)

    def merge(table: pa.Table) -> pa.Table:
        held: dict[bytes, int] = {}
        for digest, n in zip(table.column("digest").to_pylist(), table.column("n").to_pylist(), strict=True):
            held[digest] = held.get(digest, 0) + n
        return pa.Table.from_batches([_summary(table.column("part")[0].as_py(), trim(held, counters))])

    found = materialize(digests.mapInArrow(summarise, _SUMMARY), "summaries")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        dealt = found.select(F.floor(F.col("part") / FAN).alias("part"), "digest", "n")
        found = materialize(dealt.groupBy("part").applyInArrow(merge, _SUMMARY), "summaries")
    return found.select("digest")


def _decided(keyed: DataFrame, counters: int) -> DataFrame:
    """``keyed(doc_id, digest, row)``, written already, with keep_id, group_size and kept."""
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    seen = keyed.join(F.broadcast(frequent(keyed.select("digest"), counters)), "digest", "left_semi")
    counted = seen.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(rank).alias("first")).where("group_size > 1")
    winners = materialize(counted.select("digest", F.col("first.doc_id").alias("keep_id"), "group_size", F.col("first.row").alias("keep_row")), "winners")
    own = ["doc_id", "digest", "row"]
    heavy = keyed.join(F.broadcast(winners), "digest").select(*own, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    same = Window.partitionBy("digest")
    first = F.row_number().over(same.orderBy(F.asc_nulls_last("doc_id"), "row")) == 1
    light = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return heavy.union(light.select(*own, F.min("doc_id").over(same), F.count("*").over(same), first))


def find_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after each run of white space has become one space; SHA-256 of the
    normalised UTF-8 stands for the text. A null text counts as empty, and so equals other empty texts.
    Of equal texts the row with the least doc_id stays; a null doc_id comes after all others, and of
    rows with the same doc_id one stays. keep_id is null only where all ids of a group are.

    Texts are read once and never shuffled: what is written and grouped is (doc_id, digest, row). Rows
    of frequent digests find their verified winner by a broadcast of at most ``counters`` rows; the rest
    are grouped by a shuffle, in which no digest holds more than 1 / (counters + 1) of all rows.
    An empty table gives an empty result.
    """
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    keyed = materialize(docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    return _decided(keyed, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; nulls, ties and empty tables as in ``find_copies``.

    Copies under frequent digests go where they stand, by the broadcast; only the places of other dropped rows are joined.
    """
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    stamped = materialize(docs.select(F.struct("*").alias("doc"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "stamped")
    dropped = _decided(stamped.select("doc.doc_id", "digest", "row"), counters).where("not kept").select("row")
    return stamped.join(dropped, "row", "left_anti").select("doc.*")
