"""Quality rules: cross-document line frequency.

Normalised lines are hashed; per host and line, Spark counts the distinct
documents that hold it (exact copies of one document count once).  A line
above the limits is boilerplate of its host and is removed; a document
that keeps too few of its words is rejected.

Work per document (statistics, line hashes) is done once and written to
the shared folder without the text; both the count and the verdict read
that small table.  The verdict joins the documents' line hashes with the
frequent lines only, whose number per host is at most lines per document
over ``max_share``; a line that a third of the corpus holds is one key of
a plain two-sided join, which adaptive execution splits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, record, signed, stage, texts_of

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Limits: a line goes when more than this many distinct documents of its host hold it ...
MIN_DOCS = 20
#: ... and more than this share of the host's distinct documents.
MAX_SHARE = 0.02
#: A document is depleted when less than this share of its words stays.
MIN_KEPT_SHARE = 0.3

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def normalised(line: bytes) -> bytes:
    """A-Z lower-cased, white space runs as one space, stripped."""
    return b" ".join(line.lower().split())


def normalised_sql(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more, first finds included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    code = np.zeros(n, np.int64)
    for k in range(window):
        # numbers stay below the words of the text squared, so a pair fits
        code = np.unique(code * len(number) + w[k:n + k], return_inverse=True)[1] if k else w[:n]
    often = np.bincount(code)[code] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += often
    cover[window:] -= often[: len(words) + 1 - window]
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


def measure(docs: DataFrame, host_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """Per row: uid, host, statistics, a 128-bit text hash, line hashes with their words, and ``carry``."""
    fields = [T.StructField("host", docs.schema[host_col].dataType), *T._parse_datatype_string(STATS).fields,
              T.StructField("text_hash", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType())),
              T.StructField("line_words", T.ArrayType(T.IntegerType())),
              *(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry))]

    def per_batch(batches: Batches) -> Batches:
        for b in batches:
            stats, digests, hashes, counts = [], [], [], []
            for t in texts_of(b):
                stats.append(text_stats(t))
                raw = t.encode()
                digests.append(xxhash.xxh3_128_digest(raw))
                hs, ns = [], []
                for line in raw.split(b"\n"):
                    words = line.lower().split()
                    if words:
                        hs.append(signed(xxhash.xxh64_intdigest(b" ".join(words), 42)))
                        ns.append(len(words))
                hashes.append(hs)
                counts.append(ns)
            columns = [b.column(0), *(pa.array(x, pa.int64()) for x in (zip(*stats) if stats else [[]] * 5)),
                       pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64())),
                       pa.array(counts, pa.list_(pa.int32())), *b.columns[2:]]
            schema = pa.schema([(f.name, c.type) for f, c in zip(fields, columns, strict=True)])
            yield record(schema, columns)

    cols = [F.col(host_col).alias("host"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))]
    return (docs.select(*cols).mapInArrow(per_batch, T.StructType(fields))
            .withColumn("uid", F.monotonically_increasing_id()))


def frequent_lines(measured: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(host, h): lines above both limits; copies of one text count once."""
    one = (measured.select("host", "text_hash", F.explode(F.array_distinct("hashes")).alias("h"))
           .groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one"))
           .groupBy("host", "h").agg(F.count("*").alias("n")))
    hosts = (measured.groupBy("host", "text_hash").agg(F.lit(1).alias("one"))
             .groupBy("host").agg(F.count("*").alias("host_docs")))
    often = one.filter(F.col("n") > min_docs).alias("o")
    return (often.join(hosts.alias("t"), F.col("o.host").eqNullSafe(F.col("t.host")))
            .filter(F.col("n") > max_share * F.col("host_docs")).select("o.host", "o.h"))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
          min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """Statistics and verdict of every row.

    Returns the ``carry`` columns, the statistics, n_removed_words,
    removed (hashes of the removed lines), base_failed and kept.  A null
    text has no words (and fails the base rule); a null host is a host of
    its own; repeated rows are judged alike; an empty table gives an empty
    result.  Column names of ``docs`` cannot clash: only the named ones
    are read, under private names.
    """
    m = stage(measure(docs, host_col, text_col, carry), "quality-lines")
    often = frequent_lines(m, min_docs, max_share)
    lines = m.select("uid", "host", F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("line_words").alias("w"))).alias("x"))
    hit = (lines.select("uid", "host", F.col("x.h").alias("h"), F.col("x.w").alias("w")).alias("l")
           .join(often.alias("f"), (F.col("l.h") == F.col("f.h")) & F.col("l.host").eqNullSafe(F.col("f.host")))
           .groupBy("l.uid").agg(F.sum("l.w").alias("n_removed_words"), F.collect_set("l.h").alias("removed")))
    j = m.join(hit, "uid", "left")
    gone = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - gone) < min_kept_share * F.col("n_words")
    return j.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)),
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    gone.alias("n_removed_words"), F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
                    failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hash is in ``removed``."""
    stay = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(removed, F.xxhash64(normalised_sql(x))))
    return F.when(F.size(removed) > 0, F.array_join(stay, "\n")).otherwise(text)


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", **limits) -> DataFrame:
    """``docs`` with the rejected documents gone and the frequent lines of
    the others removed from their texts (``chars_col``, where there is
    one, follows); same columns, same order."""
    names = docs.columns
    j = judge(docs, host_col, text_col, tuple(names), **limits).filter("kept")
    new = {text_col: without_lines(F.col(text_col), F.col("removed"))}
    if chars_col in names:
        new[chars_col] = F.when(F.size("removed") > 0, F.char_length(new[text_col])).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in names))
