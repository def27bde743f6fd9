"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, metric_join, mixing, near_dedup, packing, pii, progressive_jpeg, quality, source_divergence, substring_dedup, toxicity, turn_repair
from .common import documents, shared_dir

#: The mixture that the query and the pipeline use: at most one and a half passes.
TARGET = mixing.Target(max_repetition=1.5)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), TARGET)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


#: Instruction data: long answers fill the loss limit, short turns that of segments.
CONVERSATION_LIMITS = packing.Limits(4096, 16, 1536)


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a segment of which only the assistant's bear loss."""
    turns = documents(spark, sf_dir, "conversations")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", (F.col("role") == "assistant").alias("answer"))
    return packing.pack(rows, tokenizer_path(), CONVERSATION_LIMITS, trained="answer")


def exact_dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of even ids as one batch, those of odd ids as the next against its index."""
    docs = documents(spark, sf_dir)
    place = f"{shared_dir(spark)}/index"
    odd = F.col("doc_id") % 2
    first = exact_dedup.exact_dedup(docs.where(odd == 0), place).withColumn("batch", F.lit(0))
    return first.unionByName(exact_dedup.exact_dedup(docs.where(odd != 0), place).withColumn("batch", F.lit(1)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def op12_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(documents(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(documents(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_source_mixing, op3_exact_dedup, op4_pii, op5_toxicity, op6_media, op7_licenses, op8_near_dedup,
        op9_packing, op10_quality, op11_source_divergence, op12_metric_join, op13_turn_repair, pipeline, exact_dedup_batches, pack_conversations,
    )}
