"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread as the next one's input.

1. toxicity: documents that the Kneser-Ney classifier predicts toxic go;
2. n-gram Jaccard join: of each group of near copies the document with the smallest id stays;
3. benchmark decontamination: documents contaminated by the contract's rule go;
4. PII: spans are masked in the texts, n_chars follows;
5. packing: what is left becomes pieces of packed sequences.

Every stage takes nulls in any column, empty and very long texts, ties and repeated rows, an empty table, and columns besides
those of `documents` (names that a stage uses for its own results included: they come out as they went in). A null text counts
as empty; it is never toxic, has no near copies, is not contaminated, has no spans, and packs as its end id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import common, decontam, ngramjoin, packing, pii, toxicity


#: Words that a worker's tokenizer remembers: half of tokens.CACHE, as executors have run all stages before.
WORDS = 400_000


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs under names that no operator uses (doc_id and text stay), and these names."""
    names = [c if c in ("doc_id", "text") else f"_own_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic; each row is judged on its own text, repeated rows alike."""
    own, names = numbered(docs)
    scored = toxicity.score(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col("predicted") == 0).select(names).toDF(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row whose doc_id names its component; of rows that repeat it with the same text one stays (any of them).

    Rows without a doc_id that are in no named component all stay (nothing says which are copies of which but their text:
    exact repeats of a text among them go).
    """
    component = ngramjoin.components(docs).filter(F.col("doc_id").isNotNull()).select("doc_id", (F.col("doc_id") != F.col("component_id")).alias("copy"))
    gone = component.groupBy("doc_id").agg(F.min("copy").alias("copy")).filter("copy").select("doc_id")
    named = docs.filter(F.col("doc_id").isNotNull()).join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    # a doc_id that occurs once needs no sorting out; repeated ones keep one row of each text
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id")
    repeated = common.materialise(repeated, "repeated-ids")
    if repeated.limit(1).count():
        once = named.join(repeated, "doc_id", "left_anti").select(docs.columns)
        again = named.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
        named = once.unionByName(again)
    nameless = docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return named.select(docs.columns).unionByName(nameless.select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the contract's rule; an empty benchmark removes nothing."""
    own, names = numbered(docs)
    found = decontam.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.judged(found).filter(~F.col("contaminated")).select(names).toDF(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its spans masked and n_chars (where there is such a column) following; a null text becomes empty."""
    own, names = numbered(docs)
    masked = pii.find(own).withColumn("text", pii.mask(F.coalesce("text", F.lit("")), F.col("pii")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn(names[docs.columns.index("n_chars")], F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(names).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of every row (see packing.SCHEMA); other columns end here."""
    return packing.pack(docs, cache=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
