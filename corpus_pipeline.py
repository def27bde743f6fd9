"""Corpus preparation: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's documents. All but the last return the columns of
documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, mixing, near_dedup, packing, quality
from strandlake.llm.common import clean, documents, id_key, materialize, named, unused, written
from strandlake.llm.queries import TARGET, tokenizer_path

#: Near duplicates have this similarity at least; the query op8 has a contract of its own.
NEAR_PERCENT = 80
#: Misses a link of exactly that similarity with a probability of 5.7e-6 (of 1.0e-4 with op8's 10).
NEAR_SIDE = 13


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as empty, very long ones whole; equal rows are judged alike.
    An empty table stays empty; other columns are kept as they are."""
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id.

    Null and empty texts are one group. Rows that repeat id, text and length leave one. An empty
    table stays empty; other columns are kept as they are."""
    return exact_dedup.keep_first(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words are near to nothing and stay, as do very short ones that differ. Rows that
    repeat an id (null too) are one document here: they stay or go together. Very long texts are
    compared whole. An empty table stays empty; other columns are kept as they are."""
    on = unused(docs, "_k")
    found = near_dedup.near_dedup(docs, side=NEAR_SIDE, percent=NEAR_PERCENT).groupBy(id_key().alias(on)).agg(F.max("kept").alias("kept"))
    # those to drop are far fewer than those to keep, so their list is the smaller side
    dropped = materialize(found.where("not kept").select(on), "dropped")
    return docs.withColumn(on, id_key()).join(dropped, on, "left_anti").select(*named(docs))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources has them, each at least once.

    A null source is a source of its own. Null and empty texts have one token, their end. Repeated
    rows are each a document. An empty table stays empty; other columns are kept as they are."""
    return mixing.mixed_documents(docs, TARGET)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences.

    Null and empty texts are their end token; very long ones are cut into full sequences; repeated
    rows are packed each for itself. An empty table gives no pieces; other columns are ignored."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", good_documents),
    ("exact", distinct_documents),
    ("near", unlike_documents),
    ("mix", mixed_documents),
    ("pack", packed_sequences),
]

#: SQL cannot express the classifier, so there is none for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents. What a stage wrote for itself goes once its result is there."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        since = written(spark)
        docs = materialize(stage(spark, docs, sf_dir), name)
        clean(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
