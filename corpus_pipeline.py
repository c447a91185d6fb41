"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but
the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.llm.decontaminate import contamination
from chainscope.llm.jaccard_join import jaccard_components
from chainscope.llm.packing import pack
from chainscope.llm.quality_classifier import score, train
from chainscope.llm.queries import held_out
from chainscope.llm.secrets import scan_secrets
from chainscope.llm.store import apart, checkpointed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, accepts.
    Null and empty texts are scored like others; rows that repeat are judged each."""
    (told,) = apart(docs.columns, "_score")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = train(docs, labels)
    return score(docs, model, score_col=told).where(F.col(told) >= model.at).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates (five-word shingles,
    similarity 0.8 or more).  Equal rows count once.  Rows without id are told apart
    by their texts, under numbers beyond all ids, so one with an id stays before them."""
    (key,) = apart(docs.columns, "_key")
    beyond = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), beyond))
    groups = jaccard_components(keyed.select(key, "text"), shingle=5, num=80, den=100, id_col=key)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = keyed.join(first, key, "left_semi").dropDuplicates([key, "text"])
    return kept.select(*[f"`{c}`" for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; null and empty texts overlap with none."""
    own = [f"`{c}`" for c in docs.columns]
    clash = [c for c in docs.columns if c.lower() == "hits"]  # contamination's own column takes its place
    (spare,) = apart(docs.columns, "_spare")
    held = docs.withColumnRenamed(clash[0], spare) if clash else docs
    found = contamination(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("hits") == 0)
    return (found.drop("hits").withColumnRenamed(spare, clash[0]) if clash else found).select(*own)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts, and n_chars to match;
    null texts stay null, rows that repeat stay."""
    (key, *spare) = apart(docs.columns, "_clean", "_a", "_b", "_c")
    clash = {c: s for c, s in zip([c for c in docs.columns if c.lower() in ("spans", "base", "redacted")], spare)}
    clean = scan_secrets(docs.withColumnsRenamed(clash)).withColumnRenamed("redacted", key)
    clean = clean.drop("spans", "base").withColumn("text", F.col(key))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.withColumnsRenamed({s: c for c, s in clash.items()}).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens; a null text is its end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, length=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL cannot state the classifier, the links' components or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return docs
