"""Exact dedup as a stateful stream.

Documents arrive as a file stream.  Each row is reduced to its digest
(SHA-256 of the whole text), its stable identifier (doc_id) and a content
locator (file and row it was read from); the text goes no further.  The
keyed state, in RocksDB on the executors' disks with its checkpoints in
the shared folder, holds for each digest the largest identifier, its
locator and the number of rows; it has no watermark, so nothing expires
and a copy that arrives a year later still hits.  Rows are combined before
the shuffle, so a text that a third of the corpus repeats is one row per
task.  A restarted stream (same ``state`` folder) reads only new files.

A digest alone does not drop a row: every row of a digest with more than
one row is a hit, the text at the state's locator is fetched, and the full
bytes are compared.  Rows whose bytes differ (a collision) are grouped by
their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from chainlens.llm.common import fresh_path, settings, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # no disk set aside ahead of need: a state partition is small, and there are many
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200"}
#: Rows whose digest is not repeated leave at the scan by a Bloom filter of at most 8 MB, before their text is shuffled.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
         "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
         "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t"}


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_rows(reader, path: str, schema: T.StructType, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text, digest, locator) of a Parquet folder, as a batch or a stream."""
    return reader.schema(schema).parquet(path).select(
        F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), digest(F.col(text_col)).alias("digest"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def run_stream(spark: SparkSession, path: str, schema: T.StructType, state: str, id_col: str = "doc_id", text_col: str = "text",
               digest: Callable[[Column], Column] = sha256, max_files: int = 100_000) -> DataFrame:
    """Bring the state in ``state`` up to date with the files in ``path`` and
    return it: (digest, best = (doc_id, locator), n).

    Each micro-batch of at most ``max_files`` files writes the digests it
    changed to a folder of its own, so a repeated batch replaces itself; the
    newest version of a digest is its state."""
    path = path.rstrip("/")
    with settings(spark, CONF):
        # as a pattern, since a file stream takes a single file only by pattern
        rows = read_rows(spark.readStream.option("maxFilesPerTrigger", max_files), f"{path[:-1]}[{path[-1]}]", schema, id_col, text_col, digest)
        # a null id is smaller than any id: it stays only where all ids are null
        best = F.max(F.struct("doc_id", "locator")).alias("best")
        seen = rows.groupBy("digest").agg(best, F.count("*").alias("n"))

        def sink(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{state}/changed/batch={batch}")

        q = (seen.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint")
             .trigger(availableNow=True).foreachBatch(sink).start())
        q.awaitTermination()
    locator = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
    kept = T.StructType([
        T.StructField("digest", T.StringType()), T.StructField("n", T.LongType()), T.StructField("batch", T.LongType()),
        T.StructField("best", T.StructType([T.StructField("doc_id", schema[id_col].dataType), T.StructField("locator", locator)]))])
    try:
        changed = spark.read.schema(kept).parquet(f"{state}/changed")
    except Exception as e:  # no file has arrived yet, so no batch ran
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kept).select("digest", "best", "n")
    return changed.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.best", "s.n")


def dedup_path(spark: SparkSession, path: str, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text",
               digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """Every row of the Parquet folder ``path`` with the row that stays for it.

    Returns doc_id, digest, keep_id, group_size, kept, locator.  Texts are
    equal byte for byte; null counts as empty.  Of equal texts the row with
    the largest doc_id stays; among rows that also repeat the doc_id, the
    one at the largest locator.  Null ids are smallest.  An empty folder
    table gives an empty result.
    """
    st = stage(run_stream(spark, path, schema, state or fresh_path(spark, "dedup-state"), id_col, text_col, digest), "dedup-digests")
    rows = read_rows(spark.read, path, schema, id_col, text_col, digest)
    # hits: compare full bytes with the text at the state's locator
    heads = st.filter("n > 1").select("digest", F.col("best.locator").alias("at"))
    with settings(spark, BLOOM):
        hits = stage(rows.join(heads, "digest"), "dedup-hits")
        held = hits.filter(F.col("locator") == F.col("at")).select("digest", F.col("text").alias("held"))
        other = stage(hits.join(held, "digest").filter(F.col("text") != F.col("held")).drop("held"), "dedup-strays")
    by_text = Window.partitionBy("digest", "text")  # rows of digests that collide only
    strays = other.select("doc_id", "digest", "locator",
                          F.max(F.struct("doc_id", "locator")).over(by_text).alias("best"), F.count("*").over(by_text).alias("n"))
    stray_n = other.groupBy("digest").agg(F.count("*").alias("strays"))
    true_st = st.join(stray_n, "digest", "left").select("digest", "best", (F.col("n") - F.coalesce("strays", F.lit(0))).alias("n"))
    light = rows.drop("text")
    own = light.join(true_st, "digest").join(strays.select("locator"), "locator", "left_anti").select(*strays.columns)
    return own.unionByName(strays).select(
        "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("locator") == F.col("best.locator")).alias("kept"), "locator")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: it is written to the shared folder,
    streamed from there, and the rows at the kept locators are read back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "dedup-input")
    docs.write.parquet(path)
    gone = dedup_path(spark, path, docs.schema, id_col, text_col).filter(~F.col("kept")).select(F.col("locator").alias("__at"))
    back = spark.read.schema(docs.schema).parquet(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return back.withColumn("__at", at).join(gone, "__at", "left_anti").select(*docs.columns)
