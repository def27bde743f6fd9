"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

The index is a table of distinct digests. A new batch is summed by digest, whatever is in the
index already leaves by a sort-merge anti-join (the index side is read bucket by bucket, without
a shuffle), and the rest is appended with the same buckets. Only digests travel: texts are read
once, to be hashed.

The index stores its number of buckets beside the digests and the name of the batch that brought
each digest. A batch that is added again under its name, after a failure at any point, finds its
own digests, appends only what is missing and gets the same decisions.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, id_back, id_key, materialize, named, shared_dir, unused

BUCKETS = 64
#: A digest with over a thousandth of the rows counts as hot; by counting there are at most
#: that many hot ones, so the list of them has a fixed bound.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text without its separators; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS + "+", "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A persistent table (digest, batch, keep_id, keep_points, group_size)."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        """Open the index at ``location``, or begin one there (by default in the shared folder).

        A new index gets ``buckets`` (BUCKETS by default). An old one has its own number; asking
        for another is an error, since files would not be where their digests are looked for."""
        self.spark = spark
        self.location = (location or f"{shared_dir(spark)}/digest_index").rstrip("/")
        found = self._layout()
        if found is None:
            found = buckets or BUCKETS
            spark.createDataFrame([(found,)], "buckets int").coalesce(1).write.json(f"{self.location}/layout")
        elif buckets not in (None, found):
            raise ValueError(f"the index at {self.location} has {found} buckets, not {buckets}")
        self.buckets = found
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, batch STRING, keep_id BIGINT, keep_points BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/digests'"
        )

    def _layout(self) -> int | None:
        try:
            row = self.spark.read.schema("buckets int").json(f"{self.location}/layout").first()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return row["buckets"] if row else None

    def close(self) -> None:
        """Take the table out of the catalog; the index stays where it is. Results that were not
        written yet need the table."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def signatures(self, docs: DataFrame) -> DataFrame:
        """(r, k, points, digest) of every row, written to the shared folder; r tells rows apart."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        return materialize(
            docs.select(
                F.monotonically_increasing_id().alias("r"),
                id_key().alias("k"),
                F.char_length(text).cast("long").alias("points"),
                digest(F.col("text")).alias("digest"),
            ),
            "digests",
        )

    def _groups(self, signed: DataFrame) -> DataFrame:
        """One row per digest of a batch: the row that stays, and how many there are."""
        best = F.min(F.struct((-F.col("points")).alias("p"), "k", "r")).alias("best")
        groups = signed.groupBy("digest").agg(best, F.count("*").alias("group_size"))
        return groups.select("digest", F.col("best.r").alias("keep_row"), F.col("best.k").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "group_size")

    def _append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests that are not in the index, one file a bucket and batch."""
        fresh = groups.join(self.read().hint("merge").select("digest"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        fresh = materialize(fresh.select("digest", "batch", "keep_id", "keep_points", "group_size"), "fresh").repartition(self.buckets, "digest")
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def _looked_up(self, signed: DataFrame, decided: DataFrame) -> DataFrame:
        """``signed`` with the columns of ``decided``, which has each digest once."""
        hot_size = signed.count() // HOT_SHARE
        counted = decided.where(F.col("size_here") > hot_size)
        hot = F.broadcast(materialize(counted, "hot"))
        cold = signed.join(hot.select("digest"), "digest", "left_anti").join(decided.hint("merge"), "digest")
        return cold.unionByName(signed.join(hot, "digest"))

    def _decisions(self, docs: DataFrame, batch: str | None) -> DataFrame:
        """``signatures`` with keep_id, group_size and kept."""
        batch = batch or uuid.uuid4().hex
        signed = self.signatures(docs)
        groups = materialize(self._groups(signed), "groups")
        # only what other batches brought counts as old, so a batch may be added again
        old = self.read().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
        decided = groups.join(old.hint("merge"), "digest", "left").select(
            "digest",
            F.coalesce("old_id", "keep_id").alias("keep_id"),
            F.when(F.col("old_size").isNull(), F.col("keep_row")).alias("keep_row"),
            F.coalesce("old_size", "group_size").alias("group_size"),
            F.col("group_size").alias("size_here"),
        )
        decided = materialize(decided, "decided")
        self._append(groups, batch)
        return self._looked_up(signed, decided).withColumn("kept", F.coalesce(F.col("r") == F.col("keep_row"), F.lit(False)))

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch and append what is new.

        Per row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts in a batch the
        row with the most code points of original text stays, then the smallest doc_id, then
        any one of repeated rows. A text that is in the index from another batch keeps its
        row there: all its rows here have kept = false. group_size counts rows of the batch
        that brought the text. ``batch`` names the batch, so that it can be added again.

        Null text counts as empty; null doc_id sorts first. Very long texts are hashed whole.
        Empty batch: empty result. Other columns are ignored."""
        return self._decisions(docs, batch).select(
            id_back(F.col("k")).alias("doc_id"),
            id_back(F.col("keep_id")).alias("keep_id"),
            "group_size",
            "kept",
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, location: str | None = None, buckets: int | None = None, batch: str | None = None) -> DataFrame:
    """The decisions of one batch against the index at ``location`` (a new one by default).

    The result no longer needs the index's table, which is closed. Nulls, ties, long texts and
    empty tables as in ``DigestIndex.add``."""
    with DigestIndex(docs.sparkSession, location, buckets) as index:
        return index.add(docs, batch)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the
    most code points, then the smallest doc_id.

    Rows leave by their identifier, against the list of those to drop, so text isn't shuffled
    while that list is small enough to be broadcast. Identifiers that have both rows to keep and
    rows to drop (repeated or null ones) are few; their rows are told apart by digest and length,
    and of rows alike in both any one stays. Null text counts as empty. Very long texts are hashed
    whole. Empty table: empty result. Helper columns avoid the names in ``docs``."""
    with DigestIndex(docs.sparkSession) as index:
        found = materialize(index._decisions(docs, None).select("k", "digest", "points", "kept"), "kept")
    key, body, size = (unused(docs, name) for name in ("_k", "_digest", "_points"))
    per_id = found.groupBy(F.col("k").alias(key)).agg(F.max("kept").alias("any"), F.min("kept").alias("all"))
    touched = materialize(per_id.where("not all"), "touched")
    marked = docs.withColumn(key, id_key())
    mixed = touched.where("any").select(key)
    single = marked.join(touched.select(key), key, "left_anti").select(*named(docs))
    stay = found.where("kept").select(F.col("k").alias(key), F.col("digest").alias(body), F.col("points").alias(size))
    stay = stay.join(mixed, key, "left_semi")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = marked.join(mixed, key, "left_semi").withColumns({body: digest(F.col("text")), size: F.char_length(text).cast("long")})
    rest = told.join(stay, [key, body, size], "left_semi").dropDuplicates([key, body, size]).select(*named(docs))
    return single.unionByName(rest)
