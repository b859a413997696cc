"""Table sinks and staged tables.

Spark has no indexes; the physical layout of a written table stands in
for them: month partitions prune date ranges, sorted files give tight
Parquet min/max statistics for wallet lookups, and bucketing co-locates
wallet-keyed tables for joins without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.session import ensure_checkpoint_dir

_STAGED: dict[tuple, str] = {}
_SCRATCH: list[str] = []
#: Bytes of a row group of a staged table.
ROW_GROUP = 16 << 20
#: Rows of a file of narrow rows that are dealt next.  A reading task takes 128 MB, each file counted
#: 4 MB larger: some 24 such files, 2.4 million rows; in large files it would hold ten million and more.
ROWS_PER_FILE = 100_000


def _fingerprint(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Files, bytes and newest change of each path, from the file system that Spark reads it with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf).listFiles(path, True)
        n = size = newest = 0
        while files.hasNext():
            f = files.next()
            n, size, newest = n + 1, size + f.getLen(), max(newest, f.getModificationTime())
        out.append((p, n, size, newest))
    return tuple(out)


def staged(spark: SparkSession, name: str, build: Callable[[], DataFrame],
           sources: Sequence[str] = (), partitions: int | None = None,
           bucket_by: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write ``build()`` once per session as Parquet under the checkpoint
    folder and return a reader over it.

    Rows are written as the last stage has them, with no shuffle of their
    own; row groups of ``ROW_GROUP`` bytes let readers split the files.
    Source files are fingerprinted: changed inputs give a new table."""
    key = (spark.sparkContext.applicationId, name, _fingerprint(spark, sources), bucket_by)
    path = _STAGED.get(key)
    if path is None and bucket_by:
        # one row per key (wallet grain): hash buckets are balanced; bucket
        # count = shuffle partitions so freshly aggregated wallet-keyed
        # frames join these tables without shuffling either side
        base = ensure_checkpoint_dir(spark)
        table = f"chainlens_{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
        path = f"{base.rstrip('/')}/tables/{table}"
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        write_bucketed(build(), table, path, bucket_by, n)
        path = _STAGED[key] = "table:" + table
    if path is not None and path.startswith("table:"):
        return spark.table(path[6:])
    if path is None:
        base = ensure_checkpoint_dir(spark)
        path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
        (build().write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
         .option("maxRecordsPerFile", rows_per_file).parquet(path))
        _STAGED[key] = path
    return spark.read.parquet(path)


def is_staged(spark: SparkSession, name: str, sources: Sequence[str] = ()) -> bool:
    """Whether ``staged`` has written this table in this session."""
    return (spark.sparkContext.applicationId, name, _fingerprint(spark, sources), None) in _STAGED


def materialize(df: DataFrame, name: str = "table", rows_per_file: int = 0) -> DataFrame:
    """Write a table as Parquet under the checkpoint folder and read it back.

    For tables that several later steps read: the input is computed a single
    time, the lineage is cut, a lost executor costs one task, and readers
    prune columns.  ``drop_scratch`` deletes what was written."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote; results that still read them must be stored before."""
    for path in _SCRATCH:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _SCRATCH.clear()


def forget_staged(spark: SparkSession | None = None) -> None:
    """Forget the session's staged tables (next use rebuilds); with a
    session, their files under the checkpoint folder go as well."""
    for path in _STAGED.values() if spark is not None else ():
        if path.startswith("table:"):
            spark.sql(f"DROP TABLE IF EXISTS {path[6:]}")
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{path[6:]}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STAGED.clear()


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Replace (``overwrite``) or extend (``append``) a table in one
    distributed write; optional partition columns and per-file sort."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    w = out.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_transactions(tx: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The transaction table laid out for its queries: one directory per
    month (date-range pruning) and files sorted by wallet then time (Parquet
    statistics skip row groups on wallet lookups).  Rows are ranged over
    (month, wallet, time), so a task writes few months and a wallet or month
    with a third of the rows is spread over many files."""
    order = ["month", "wallet", "created_at"]
    laid = tx.withColumn("month", F.date_format("created_at", "yyyy-MM")).repartitionByRange(*order)
    write_table(laid, path, mode, partition_by=["month"], sort_by=order)


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "wallet",
                   buckets: int = 64) -> None:
    """Wallet-keyed table bucketed and sorted by ``key`` (external table at
    ``path``): joins and aggregations on ``key`` between tables with the
    same bucket count read co-located data without a shuffle."""
    (df.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))


#: Quotes are doubled, as CSV readers expect; values may hold line breaks.
CSV_TEXT = {"header": "true", "quote": '"', "escape": '"'}


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV export, in the parts the last stage has (one for small results)."""
    df.write.mode("overwrite").options(**CSV_TEXT).csv(path)


def read_csv_result(spark: SparkSession, path: str, schema) -> DataFrame:
    """Re-read an exported result with its declared schema (no inference)."""
    return spark.read.schema(schema).options(**CSV_TEXT).option("multiLine", True).csv(path)
