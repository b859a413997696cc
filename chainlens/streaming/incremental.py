"""Incremental ingestion of newly arriving transaction CSV files.

The batch loader (``sources.csv_ingest``) reads a whole folder; when new
files keep arriving, a Structured Streaming file source picks up only the
files it has not seen (tracked in the checkpoint), and the Parquet file
sink commits each micro-batch exactly once.  ``availableNow`` processes
the backlog and stops, so the same job runs on a schedule without a
long-lived cluster.

Rows are never dropped: lines with surplus fields or an open quote go to a quarantine table
written by a second query over the same source (own checkpoint, also
exactly-once).  A streaming source has one fixed schema, so every file in
the folder must share one header order; files with another header order
belong in the batch loader, which realigns them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainlens.config import TRANSACTION_SCHEMA
from chainlens.sources.csv_ingest import READ, _group_schema, _quarantined, _typed, rejected


def start_ingest(spark: SparkSession, in_dir: str, table_path: str, quarantine_path: str,
                 checkpoint_dir: str, header: Sequence[str] | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 encoding: str = "UTF-8", multi_line: bool = False
                 ) -> tuple[StreamingQuery, StreamingQuery]:
    """Start the two streaming queries (data, quarantine).  Data lands in
    ``table_path`` partitioned by month, canonical column order."""
    expected = [f.name for f in TRANSACTION_SCHEMA.fields]
    cols = list(header or expected)
    # enforceSchema off: a file whose header has other names or another order stops the query
    reader = spark.readStream.schema(_group_schema(cols)).options(**READ).option("enforceSchema", False).option("multiLine", multi_line).option("encoding", encoding)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.csv(in_dir)
    good = (src.where(~rejected(cols)).select(*_typed(TRANSACTION_SCHEMA))
            .withColumn("month", F.date_format("created_at", "yyyy-MM")))
    bad = _quarantined(src.withColumn("file_path", F.col("_metadata.file_path")), cols)

    def sink(df, path, name, parts=()):
        w = (df.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", f"{checkpoint_dir.rstrip('/')}/{name}")
             .outputMode("append"))
        if parts:
            w = w.partitionBy(*parts)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
        return w.start()

    return sink(good, table_path, "data", ["month"]), sink(bad, quarantine_path, "quarantine")


def run_once(spark: SparkSession, in_dir: str, table_path: str, quarantine_path: str,
             checkpoint_dir: str, header: Sequence[str] | None = None) -> None:
    """Process every file not yet ingested, then return."""
    for q in start_ingest(spark, in_dir, table_path, quarantine_path, checkpoint_dir, header):
        q.awaitTermination()
