"""The operators' queries, one for each, over whole tables; digests are derived from the operators' outputs here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import common
from folioflow.llm.oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import warc

    files = warc.write_archives(table(spark, sf_dir, "pages"), common.new_folder(spark, "warc"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import pii

    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import tokenbin

    files = tokenbin.write_tokens(table(spark, sf_dir, "documents"), common.new_folder(spark, "tokens"))
    return tokenbin.read_tokens(files)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import toxicity

    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import substring

    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import decontam

    found = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return decontam.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import sitestyle

    return sitestyle.extract(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import ngramjoin

    return ngramjoin.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), 100)


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_token_binary": op3_token_binary,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_site_style_tree": op8_site_style_tree,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_additive_quantisation": op10_additive_quantisation,
}
