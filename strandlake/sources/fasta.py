"""FASTA and raw text sources, plain or gzipped.

Large plain files, and large records in them, are read by many tasks (see ``splits``); gzip cannot
be split and is read by one task per file. seq_id numbers records by file name, then place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from . import splits

NO_HEADER = splits.NO_HEADER
#: Files of a folder whose names say that they hold sequences, for ``records``.
GLOB = "*.{fa,fasta,fna,faa,fas,txt,gz}"


def records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(seq_id, file, header, seq): headers and sequences as they are written, lines stripped
    and joined. What stands before a file's first header is dropped. ``glob`` (as ``GLOB``)
    chooses files of a folder by name."""
    return splits.joined(splits.pieces(spark, path, splits.RECORDS, glob))


def statistics_records(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, file, header, seq) for the statistics scan: upper-cased, white space removed;
    symbols before the first header count for the first record, and a file without any header
    is one record "(no header)"."""
    return splits.joined(statistics_pieces(spark, path))


def statistics_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The records of the statistics scan in pieces (see ``splits.pieces``), headers shortened."""
    found = splits.pieces(spark, path, splits.STATISTICS)
    return found.withColumn("header", S.short_header(F.col("header")))


def concatenated(parts: DataFrame, by: tuple[str, ...] = (), column: str = "seq", order: str = "seq_id") -> DataFrame:
    """(*by, seq): the sequences of a group in order, without a separator, so that windows and
    reading frames may span records. A group becomes one value; analyse records by themselves
    (the default everywhere else) where groups are large."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("s")))), lambda x: x["s"]), "")
    return parts.groupBy(*by).agg(joined.alias("seq"))


def acgt(spark: SparkSession, path: str) -> DataFrame:
    """(seq): the A, C, G, T of all lines that are no headers, concatenated into one value."""
    out = concatenated(base_pieces(spark, path), order="_at")
    if out.where(F.length("seq") > 0).isEmpty():
        raise ValueError("no A, C, G or T in the file")
    return out


def raw_or_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq): all lines but headers and blank ones, stripped, upper-cased and joined into one value."""
    return concatenated(raw_pieces(spark, path), order="_at")


def single(spark: SparkSession, path: str) -> DataFrame:
    """(seq) as ``raw_or_fasta``, bases only."""
    return raw_or_fasta(spark, path).select(S.acgt_only(F.col("seq")).alias("seq"))


def base_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(_at, seq): the bases of all lines that are no headers, in pieces, with a key in their order
    (``operators.concat`` analyses them as one sequence without joining them)."""
    return _all_pieces(spark, path, splits.BASES)


def raw_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(_at, seq): all lines that are no headers, stripped and upper-cased, as ``base_pieces``."""
    return _all_pieces(spark, path, splits.RECORDS).withColumn("seq", F.upper("seq"))


def _all_pieces(spark: SparkSession, path: str, style: splits.Style) -> DataFrame:
    found = splits.ranges(spark, path, style)
    return found.where(F.length("part") > 0).select(F.struct("file", "block", "rel", "off").alias("_at"), F.col("part").alias("seq"))


def sniffed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(seq_id, file, header, seq) as ``records``, for files that are gzip by name or by their first
    two bytes."""
    return splits.joined(splits.pieces(spark, path, splits.RECORDS, glob, sniff=True))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_size) on disk."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("file_size"))


def labelled(parts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``parts`` with the group whose prefix its header has; others are dropped. A group without
    records is an error."""
    label = F.coalesce(*(F.when(F.col("header").startswith(p), F.lit(name)) for name, p in prefixes.items()))
    out = parts.withColumn("genome", label).where("genome is not null")
    there = {r[0] for r in out.select("genome").distinct().collect()}  # at most one row per prefix
    if missing := set(prefixes) - there:
        raise ValueError(f"no records for {sorted(missing)}")
    return out


def paired(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Records of one file per group, with the column ``genome``."""
    frames = [records(spark, path).withColumn("genome", F.lit(name)) for name, path in paths.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
