"""Files as incremental sources and append sinks (SRC-5..8, SRC-10..17, SNK-1, SNK-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All-string rows of CSV files; Spark drops a byte order mark; rows without any value go."""
    from millrace.operators.etl import non_empty

    return non_empty(spark.read.csv(path, header=True, inferSchema=False, multiLine=True))


def changed_files(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """path, modified and content of files under a folder, hidden ones apart, that changed after ``since``.

    The cursor test is on the listing, so unchanged files are not opened."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*")
    files = (read.option("modifiedAfter", since) if since else read).load(path)
    rows = files.select("path", F.col("modificationTime").alias("modified"), "content")
    return rows.where(F.col("modified") > F.lit(since).cast("timestamp")) if since else rows


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def from_config(spark: SparkSession, entries: list[dict]) -> DataFrame | None:
    """The union of configured sources ({format, path, options}); entries without a format or path are skipped."""
    found = [changed_files(spark, e["path"], e.get("since")) for e in entries if e.get("format") == "folder" and e.get("path")]
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out


def append_stream(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None):
    """Append a stream to Parquet with offsets in a checkpoint: restarts neither lose nor repeat a batch."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(partition_by) if partition_by else writer).start()
