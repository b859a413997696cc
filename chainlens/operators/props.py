"""Semi-structured columns: JSON text typed once.

``typed`` parses a JSON column into VARIANT a single time and takes every
wanted path from it with its type; a value that is there but does not fit
its type is counted and kept as text, never silently NULL.  ``elements``
unfolds nested arrays, ``key_report`` shows what keys hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What became of a path of a row.
OK, MISSING, MISMATCH, BAD_JSON, NO_JSON = "ok", "missing", "mismatch", "bad json", "no json"


def typed(rows: DataFrame, column: str, fields: Mapping[str, tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and, per name in ``fields`` (its path and type), the typed
    value, ``<name>_text`` where it does not fit and ``<name>_status``."""
    v = rows.select(*keep, F.col(column).alias("_json"), F.try_parse_json(column).alias("_v"))
    out = []
    for name, (path, kind) in fields.items():
        text, value = F.try_variant_get("_v", path, "string"), F.try_variant_get("_v", path, kind)
        status = (F.when(F.col("_json").isNull(), NO_JSON).when(F.col("_v").isNull(), BAD_JSON)
                  .when(text.isNull(), MISSING).when(value.isNull(), MISMATCH).otherwise(OK))
        out += [value.alias(name), F.when(status == MISMATCH, text).alias(f"{name}_text"), status.alias(f"{name}_status")]
    return v.select(*keep, *out)


def elements(rows: DataFrame, column: str, path: str, kind: str, keep: Sequence[str]) -> DataFrame:
    """(keep, place, element): one row per element of the array at ``path``; none where there is no array."""
    found = rows.select(*keep, F.try_variant_get(F.try_parse_json(column), path, "array<variant>").alias("_a"))
    return found.select(*keep, F.posexplode("_a").alias("place", "_e")).select(*keep, "place", F.try_variant_get("_e", "$", kind).alias("element"))


def status_counts(done: DataFrame, name: str) -> DataFrame:
    return done.groupBy(F.col(f"{name}_status").alias("status")).agg(F.count("*").alias("n"))


def key_report(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Per ``by`` and top-level key: rows that hold it, whole numbers among its values, distinct texts, least and greatest number."""
    pairs = rows.select(by, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    number = F.col("value").try_cast("long")
    return pairs.groupBy(by, "key").agg(F.count("*").alias("n"), F.count(number).alias("n_whole"), F.countDistinct("value").alias("n_values"),
                                        F.min(number).alias("least"), F.max(number).alias("greatest"))
