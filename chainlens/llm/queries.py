"""The registered queries: thin callers that derive the contract's columns
from the operators' results over the whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm import (exact_dedup, gated_lm, language_id, line_dedup, packing, pu_quality, quality_rules, rans_tokens, secret_scan, simhash,
                           source_mix, spelling_variants, token_alignment)
from chainlens.llm.common import fresh_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-file")
    rans_tokens.write(documents(spark, sf_dir), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return rans_tokens.read(spark, path, with_ids=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0, window=1024, with_ids=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(documents(spark, sf_dir), shingle_words=3, radius=2)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judge(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "n_removed_words")


def op6_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    d = exact_dedup.dedup_path(spark, path, spark.read.parquet(path).schema)
    return d.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secret_scan.scan(documents(spark, sf_dir))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*(k.name for k in secret_scan.BASE))
    return d.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "copied", "live")),
                    F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


#: Shares of all tokens that the mix aims at.
MIX_SHARES = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = source_mix.domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = source_mix.mix(documents(spark, sf_dir), labels, shares=MIX_SHARES)
    return d.select("row.doc_id", F.col("tokens").alias("n_tokens"),
                    *(F.col(f"p{k}").alias(f"p_{name}") for k, name in enumerate(MIX_SHARES)), "rate", "copies")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = pu_quality.features(documents(spark, sf_dir), carry=(held_out.alias("held_out"),))
    # rows held out are neither trusted nor unlabelled: the fit never sees them
    model = pu_quality.learn(found.filter(~held_out), labels.filter(~held_out & (F.col("quality") == 1)), labels)
    d = pu_quality.score(found, model, boundary=0.3)
    return d.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(documents(spark, sf_dir), min_chars=5, min_count=3, ratio=2, typo_every=97)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs.filter(~held_out))
    return language_id.identify(docs, model, carry=(held_out.alias("held_out"),))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
