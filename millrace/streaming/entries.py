"""Entry logs: capped sinks with ordered ids, and consumers that take pending entries first (SRC-18, SNK-5, STM-1, STM-12, TOP-8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.streaming.ledger import BatchTables


class EntryLog:
    """A log of entries(payload) under ids (version, seq), capped to about ``most`` of the newest.

    An append is a batch of its own: its version is the next number, seq the place within it, so ids
    ascend without one task that numbers all rows. The cap drops whole batches: the oldest go as
    long as the rest holds ``most`` entries, so at least that many stay. A replayed batch adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, most: int | None = None):
        self.most = most
        self.tables = BatchTables(spark, path, {"entries": "version bigint, seq bigint, payload string", "sizes": "version bigint, n bigint, floor bigint"})

    def append(self, rows: DataFrame, batch_id: int) -> None:
        last, version = self.tables.last()
        if batch_id <= last:
            return
        self.tables.begin(batch_id)
        version += 1
        stamp = F.lit(version).cast("bigint").alias("version")
        self.tables.write("entries", rows.select(stamp, F.monotonically_increasing_id().alias("seq"), F.col("payload").cast("string").alias("payload")))
        n = self.tables.written("entries").count()
        self.tables.write("sizes", self.tables.spark.sql(f"SELECT {version}L AS version, {n}L AS n, {self._floor(version, n)}L AS floor"))
        self.tables.commit(version)

    def _floor(self, version: int, n: int) -> int:
        """The newest version that is no more needed to keep ``most`` entries; 0 if there is none."""
        sizes = self.tables.read("sizes").select("version", "n", "floor")
        before = sizes.agg(F.max("floor")).first()[0] or 0
        if self.most is None:
            return before
        # one row a batch; those under the last floor are not looked at again
        later = F.sum("n").over(Window.orderBy(F.desc("version")).rowsBetween(Window.unboundedPreceding, -1))
        rows = sizes.where(F.col("version") > before).withColumn("newer", F.coalesce(later, F.lit(0)) + n)
        return max(before, rows.where(F.col("newer") >= self.most).agg(F.max("version")).first()[0] or 0)

    def floor(self) -> int:
        return self.tables.read("sizes").agg(F.max("floor")).first()[0] or 0

    def entries(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """The entries that stand, of versions after one and up to another."""
        rows = self.tables.read("entries").where(F.col("version") > max(after, self.floor()))
        return (rows if upto is None else rows.where(F.col("version") <= upto)).select("version", "seq", "payload")

    def tail(self, n: int) -> DataFrame:
        """TOP-8: the n newest entries, newest first."""
        return self.entries().orderBy(F.desc("version"), F.desc("seq")).limit(n)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Append a stream of rows(payload), until what is there has been read."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Consumer:
    """A named reader of a log with a cursor of its own, which moves over whole batches once they are handled.

    The first start is at the tail ("$"), or at the head. What was being handled when the last run died
    is pending: the cursor has not moved, so it is handled first when the consumer starts again, then what came
    since. Entries that the cap took meanwhile are lost, as the log says how many it keeps.
    """

    def __init__(self, log: EntryLog, path: str, at_tail: bool = True):
        self.log, self.cursor = log, BatchTables(log.tables.spark, path, {})
        if self.cursor.last()[0] < 0:
            self._move(log.tables.last()[1] if at_tail else 0)

    def _move(self, version: int) -> None:
        self.cursor.begin(self.cursor.last()[0] + 1)
        self.cursor.commit(version)

    def poll(self, handle: Callable[[DataFrame], None]) -> int:
        """Handle what is past the cursor and give the version reached; nothing new handles nothing."""
        at, upto = self.cursor.last()[1], self.log.tables.last()[1]
        if upto > at:
            handle(self.log.entries(at, upto))
            self._move(upto)
        return upto

    def start(self, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
        """Poll at each announcement of the log, as a stream; a replayed announcement finds the cursor moved."""

        def poll(_: DataFrame, __: int) -> None:
            self.poll(handle)

        return self.log.tables.stream_ledger().writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
