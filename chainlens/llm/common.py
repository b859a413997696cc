"""Small helpers the operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.session import ensure_checkpoint_dir

#: ASCII white space, the separators of words in every contract.
WS_CLASS = r"[\x20\x09-\x0D]"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    start from files that any executor can read, so a lost executor costs
    one task and not the lineage."""
    path = fresh_path(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for what runs inside the block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def most_frequent(counts: DataFrame, key: str, count: str, most: int) -> list:
    """Rows of at most ``most`` keys: all from the lowest level of counts
    (sixteenths of a power of two) that keeps within it.  Levels are counted
    first, so no task sends more than its share of these."""
    level = F.floor(F.log2(count) * 16).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(key).alias("n")).collect()), reverse=True)
    kept, least = 0, None
    for k, n in sizes:
        if kept + n > most:
            break
        kept, least = kept + n, k
    return [] if least is None else counts.filter(level >= least).collect()


def signed(h: int) -> int:
    """An unsigned 64-bit hash as Spark's long."""
    return h - (1 << 64) if h >> 63 else h


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
              for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


Batches = Iterator[pa.RecordBatch]
