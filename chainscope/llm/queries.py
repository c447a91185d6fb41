"""Queries of the training-data operators, one for each, and their oracles.

Each query reads its whole table, calls its operator with production
parameters and returns one row for each input row (or piece).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.llm import source_divergence, warc
from chainscope.llm.decontaminate import contamination
from chainscope.llm.html_text import extract_text
from chainscope.llm.jaccard_join import jaccard_components
from chainscope.llm.lexicon_bpe import decode, encode
from chainscope.llm.packing import pack
from chainscope.llm.quality_classifier import score, train
from chainscope.llm.quality_rules import judge
from chainscope.llm.secrets import scan_secrets
from chainscope.llm.spelling import variants
from chainscope.llm.store import shared_folder
from chainscope.llm.substring_dedup import remove_repeats
from chainscope.llm.token_files import token_files
from chainscope.llm.warc import archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100, lower=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), window=35, keep_text=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=1, length=2048)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(_table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.transform("hits", lambda h: F.concat_ws(":", F.coalesce(h.item_id.cast("string"), F.lit("")), h.start, h.length, h.agreeing))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.array_join(hit, ",").alias("hits"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def held_out(doc_id: Column) -> Column:
    """The rows whose labels a model may not learn from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.at).cast("int").alias("predicted"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "text", "n_chars", "n_lines")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_redacted=False)
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(_table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_jaccard_join, op2_warc, op3_decontamination, op4_substring_dedup, op5_quality_rules, op6_quality_classifier, op7_packing,
    op8_html_text, op9_token_files, op10_secrets, op11_source_divergence, op12_bpe_lexicon, op13_spelling_variants)}

ORACLES: dict[str, str] = {"op2_warc": warc.SQL, "op11_source_divergence": source_divergence.SQL}
