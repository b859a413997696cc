"""Corpus pipeline: quality rules, exact dedup, near-dedup, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before
it kept and returns rows with the columns of ``documents``; the last one
returns the packed pieces.  Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor never reaches back
beyond one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainlens.llm import exact_dedup, packing, quality_rules, simhash, source_mix
from chainlens.llm.common import stage
from chainlens.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejected documents go; lines above the limits leave the texts of the others."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row of each text stays, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component one document stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle_words=3, radius=2)


#: Wanted tokens of each domain, as multiples of what the documents that do not speak for toxic hold: good and poor
#: text stays as it is, of their expected toxic tokens a quarter goes as well.
MIX_KEEP = {"good": 1.0, "poor": 1.0, "toxic": 0.75}


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rates of at most one, so that no copies come back; a document with a rate under a half goes."""
    labels = source_mix.domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = source_mix.mix(docs, labels, keep=MIX_KEEP, carry=tuple(docs.columns), nearest=True, without=("toxic",), most=1.0)
    return rated.filter("copies > 0").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of sequences of up to 1,024 ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, window=1024, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mixed), ("packing", packed)]

#: SQL has no SimHash, classifier or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
