"""Tables that a stream's batches append to, with a ledger of the batches that are complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEDGER = "batch_id bigint, version bigint, attempt string"
_OWN = "attempt string, batch_id bigint"


class BatchTables:
    """Tables under a folder; each attempt at a batch writes new folders, and counts once its ledger row is there.

    Nothing is overwritten: a replay is another attempt, what a killed one left behind is never read,
    and readers are not disturbed. Batches come one after another, in order of their ids.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), {**schemas, "ledger": _LEDGER}
        for name, schema in self.schemas.items():
            own = schema if name == "ledger" else f"{_OWN}, {schema}"
            spark.createDataFrame([], own).write.mode("ignore").parquet(f"{self.path}/{name}/none")

    def _all(self, name: str) -> DataFrame:
        schema = self.schemas[name] if name == "ledger" else f"{_OWN}, {self.schemas[name]}"
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    def ledger(self) -> DataFrame:
        return self._all("ledger")

    def stream_ledger(self) -> DataFrame:
        return self.spark.readStream.schema(_LEDGER).option("recursiveFileLookup", True).parquet(f"{self.path}/ledger")

    def last(self) -> tuple[int, int]:
        """The last committed batch and the highest version, -1 and 0 at first."""
        row = self.ledger().agg(F.max("batch_id").alias("batch_id"), F.max("version").alias("version")).first()
        return (-1 if row.batch_id is None else row.batch_id), (row.version or 0)

    def read(self, name: str) -> DataFrame:
        """The rows of committed attempts, with their batch_id."""
        return self._all(name).join(self.ledger().select("attempt"), "attempt", "left_semi").drop("attempt")

    def written(self, name: str) -> DataFrame:
        """What the batch that was begun has added to a table so far."""
        return self._all(name).where(F.col("attempt") == self._attempt)

    def begin(self, batch_id: int) -> None:
        self._now, self._attempt = batch_id, uuid.uuid4().hex

    def write(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table as part of the batch that was begun."""
        columns = [c.split()[0] for c in _split(self.schemas[name])]
        own = (F.lit(self._attempt).alias("attempt"), F.lit(self._now).cast("bigint").alias("batch_id"))
        rows.select(*own, *columns).write.parquet(f"{self.path}/{name}/{self._attempt}")

    def commit(self, version: int | None) -> None:
        """One row in one file, which its rename makes visible at once."""
        self.spark.createDataFrame([(self._now, version, self._attempt)], _LEDGER).coalesce(1).write.parquet(f"{self.path}/ledger/{self._attempt}")


def _split(schema: str) -> list[str]:
    """The fields of a schema text, of which some may have commas in brackets."""
    fields, depth, begin = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append(schema[begin:i].strip())
            begin = i + 1
    return [*fields, schema[begin:].strip()]
