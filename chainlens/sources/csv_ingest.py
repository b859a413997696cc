"""Ingest many transaction CSV files.

The files share one logical schema but drift: columns come in another
order, some files miss or add columns, some lines are too long or too
short, some files are Latin-1 instead of UTF-8.  Spark's CSV reader
applies an explicit schema by position and silently replaces invalid
UTF-8, so the steps are:

1. one distributed pass over the files' lines gives, per file, its header,
   whether all of its lines are valid UTF-8 and whether its quotes pair up.
   It is stored; the drift report and all later steps read it;
2. files are grouped by (header, encoding, line breaks inside quotes) - a
   handful of groups; each group is read once, in parallel, all fields as
   text in its own column order, then parsed, projected to the canonical
   order and stored with what was wrong with the line.  Only files with a
   quoted line break are read whole (such files cannot be split).  A file
   whose quotes do not pair up has a stray one: it is read line by line;
3. Spark marks lines whose number of fields differs from the header and
   keeps their source text.  Those with too many fields, empty ones
   included, or with a quote that is never closed go to a quarantine frame
   as they were; short lines keep NULLs; a field that does not parse as its
   type becomes NULL.  Quotes inside quoted fields are doubled.

The paths of each group reach the driver, which hands them to the reader;
Spark's own file index holds the same list there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.config import TRANSACTION_SCHEMA
from chainlens.sources.tables import materialize

#: Source text of a line whose number of fields is not the header's.
RAW_COL = "_source_line"
LATIN1 = "ISO-8859-1"
#: All fields are parsed whatever columns a query takes, so that the same lines are marked each time.
READ = {"header": "true", "mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": RAW_COL,
        "columnPruning": "false", "maxColumns": "500000"}
#: Stands for a comma outside quotes while a line is split.
_CUT = "\x1f"


def _pieces(line) -> F.Column:
    """A line cut at its quotes: every second piece, from the first on, lies outside quotes."""
    return F.split(line, '"', -1)


def fields_of(line) -> F.Column:
    """Fields of a CSV line, without their quotes."""
    line = F.col(line) if isinstance(line, str) else line
    marked = F.transform(_pieces(line), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit(_CUT))).otherwise(x))
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')
    return F.transform(F.split(F.array_join(marked, '"'), _CUT, -1), bare)


def n_fields(line) -> F.Column:
    """Number of fields of a CSV line: one more than its commas outside quotes, in one pass over the line."""
    outside = F.filter(_pieces(line), lambda x, i: i % 2 == 0)
    commas = F.aggregate(outside, F.lit(0), lambda n, x: n + F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit(""))))
    return commas + 1


def quotes(line) -> F.Column:
    line = F.col(line) if isinstance(line, str) else line
    return F.char_length(line) - F.char_length(F.replace(line, F.lit('"'), F.lit("")))


def source_line(columns: Sequence[str]) -> F.Column:
    """The marked line; Spark wants a field named beside it, so none of the first one is added."""
    return F.concat(F.col(RAW_COL), F.substring(F.coalesce(F.col(columns[0]), F.lit("")), 1, 0))


def rejected(columns: Sequence[str]) -> F.Column:
    """Whether a line has more fields than ``columns`` or leaves a quote open."""
    line = source_line(columns)
    return F.coalesce((n_fields(line) > len(columns)) | (quotes(line) % 2 == 1), F.lit(False))


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def file_headers(spark: SparkSession, paths: str | Sequence[str],
                 exclude_prefix: str | None = None) -> DataFrame:
    """One row per file: path, name, header line, header columns, whether
    every line is valid UTF-8 and whether quoted fields hold line breaks.

    The header is the first line of the split starting at byte 0 (row
    order within a split is read order).  The UTF-8 flag needs every line,
    so it is an aggregate over the whole text read."""
    lines = spark.read.text(_paths(paths)).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"),
        "value")
    if exclude_prefix:
        lines = lines.where(~F.col("file_name").startswith(exclude_prefix))
    return (lines.groupBy("file_path", "file_name").agg(
                F.min_by(F.when(F.col("block_start") == 0, F.col("value")),
                         F.when(F.col("block_start") == 0, F.col("pos"))).alias("header"),
                F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
                # a line with an odd number of quotes opens a field that goes on in the next,
                # unless the file's quotes do not pair up: then one of them is stray
                (F.bool_or(quotes("value") % 2 == 1) & (F.sum(quotes("value")) % 2 == 0)).alias("breaks"))
            .withColumn("header", F.regexp_replace("header", "^﻿", ""))
            .withColumn("columns", fields_of("header")))


def schema_drift(headers: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """Per file: column count, columns missing / extra against the
    reference set (``expected``, default: the first file by name), same
    order flag, and an overall ``consistent`` flag on every row."""
    if expected is None:
        ref = headers.orderBy("file_path").limit(1).select("columns").scalar()
    else:
        ref = F.array(*[F.lit(c) for c in expected])
    d = headers.select(
        "file_path", "file_name", "utf8", "breaks", "columns",
        F.size("columns").alias("n_columns"),
        F.array_except(ref, F.col("columns")).alias("missing"),
        F.array_except(F.col("columns"), ref).alias("extra"),
        (F.col("columns") == ref).alias("same_order"))
    d = d.withColumn("matches", (F.size("missing") == 0) & (F.size("extra") == 0))
    all_ok = d.select(F.bool_and("matches")).scalar()
    return d.withColumn("consistent", all_ok)


@dataclass
class Ingested:
    data: DataFrame          # canonical columns, typed
    quarantine: DataFrame    # file_path, raw line of rejected rows
    drift: DataFrame         # per-file report (schema_drift)
    skipped: list[str]       # files whose column set does not match
    bad_times: DataFrame     # file_path, column, text of times that did not parse (rows kept)


# Spellings read as boolean true / false (case-insensitive).
TRUE_WORDS = ["true", "t", "1", "yes", "y"]
FALSE_WORDS = ["false", "f", "0", "no", "n"]


def parse_bool(c) -> F.Column:
    """Text -> boolean; unknown spellings -> NULL."""
    v = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(v.isin(TRUE_WORDS), F.lit(True)).when(v.isin(FALSE_WORDS), F.lit(False))


def parse_time(c, fmt: str | None = None) -> F.Column:
    """Text -> timestamp, once, at ingest; text that does not parse -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def _typed(schema: T.StructType, fmt: str | None = None) -> list[F.Column]:
    """Canonical projection of the text fields; empty text is NULL."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            c = parse_bool(f.name)
        elif isinstance(f.dataType, T.TimestampType):
            c = parse_time(f.name, fmt)
        else:
            c = F.col(f.name).try_cast(f.dataType)
        out.append(c.alias(f.name))
    return out


def _group_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, RAW_COL]])


def _quarantined(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(rejected(columns)).select("file_path", source_line(columns).alias("line"))


def _groups(headers: DataFrame) -> dict[tuple, list[str]]:
    """(columns, utf8, breaks) -> paths, grouped on the cluster."""
    found = headers.groupBy("columns", "utf8", "breaks").agg(F.sort_array(F.collect_list("file_path")).alias("paths")).collect()
    return dict(sorted(((tuple(r.columns), bool(r.utf8), bool(r.breaks)), r.paths) for r in found))


def read_transactions(spark: SparkSession, paths: str | Sequence[str],
                      exclude_prefix: str | None = None,
                      schema: T.StructType = TRANSACTION_SCHEMA, strict: bool = False,
                      timestamp_format: str | None = None) -> Ingested:
    """Read all transaction CSVs into one typed frame (canonical order).

    Files with the expected column set in another order are realigned;
    files missing or adding columns are skipped (or raise with
    ``strict``).  Latin-1 files are read with their encoding.  Rows are
    parsed and stored once, in the shared folder; data, quarantine and
    unparsed times are read from there."""
    expected = [f.name for f in schema.fields]
    headers = materialize(file_headers(spark, paths, exclude_prefix), "csv-headers")
    drift = schema_drift(headers, expected)
    skipped = [r.file_path for r in drift.where(~F.col("matches")).select("file_path").collect()]
    if skipped and strict:
        raise ValueError(f"column schema mismatch in {len(skipped)} file(s): {skipped[:5]}")
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    rows = None
    for (cols, utf8, breaks), files in _groups(drift.where("matches")).items():
        reader = spark.read.schema(_group_schema(cols)).options(**READ).option("multiLine", breaks)
        df = reader.option("encoding", "UTF-8" if utf8 else LATIN1).csv(files)
        bad = F.when(rejected(cols), source_line(cols))
        unparsed = [F.when(F.col(c).isNotNull() & parse_time(c, timestamp_format).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("text")))
                    for c in times]
        part = df.select(F.col("_metadata.file_path").alias("_file"), bad.alias("_line"), F.array_compact(F.array(*unparsed)).alias("_times"),
                         *_typed(schema, timestamp_format))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], T.StructType([*T._parse_datatype_string(
            "_file string, _line string, _times array<struct<column: string, text: string>>").fields, *schema.fields]))
    else:
        rows = materialize(rows, "csv-rows")
    good = rows.where(F.col("_line").isNull())
    return Ingested(good.select(*expected), rows.where(F.col("_line").isNotNull()).select(F.col("_file").alias("file_path"), F.col("_line").alias("line")),
                    drift, skipped, good.select(F.col("_file").alias("file_path"), F.explode("_times").alias("t")).select("file_path", "t.*"))


def sample_per_file(spark: SparkSession, paths: str | Sequence[str], n: int = 5,
                    exclude_prefix: str | None = None) -> DataFrame:
    """First n data rows of every file, all as text, columns united by name
    across header variants (missing columns NULL).

    ``row_number() <= n`` over each file is a WindowGroupLimit, so every
    task forwards at most n rows per file."""
    headers = materialize(file_headers(spark, paths, exclude_prefix), "csv-headers")
    out = None
    for (cols, utf8, breaks), files in _groups(headers).items():
        reader = spark.read.schema(_group_schema(cols)).options(**READ).option("multiLine", breaks)
        df = (reader.option("encoding", "UTF-8" if utf8 else LATIN1).csv(files).where(~rejected(cols)).select(
              *cols, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("__path"),
              F.monotonically_increasing_id().alias("__pos")))
        w = F.row_number().over(Window.partitionBy("__path").orderBy("__pos"))
        df = df.withColumn("__rn", w).where(F.col("__rn") <= n).drop("__pos", "__rn", "__path")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "source_file string")
