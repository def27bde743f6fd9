"""Whole analyses, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import orfs, reads, symbols, windows
from ..sources import fasta, splits


def fasta_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Symbol table, record table and summary of a FASTA file."""
    found = fasta.statistics_pieces(spark, path)
    records = splits.lengths(found).select("seq_id", "header", F.col("n").alias("len"))
    named = F.when(F.col("header") != "", F.struct("seq_id", "header"))
    summary = records.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"), F.count("*").alias("record_count"), F.min(named)["header"].alias("header_preview"))
    return {"symbols": symbols.symbol_table(found), "records": records, "summary": summary, "files": fasta.file_sizes(spark, path)}


def symbol_lines(symbols_: DataFrame) -> DataFrame:
    """(ord, line): the symbol table as the lines of a list: symbol, count, percentage."""
    line = F.format_string("%-2s %d %s", F.col("symbol"), F.col("n"), S.percent_text(F.col("pct")))
    return symbols_.select("ord", line.alias("line"))


def kmer_lines(frequencies: DataFrame) -> DataFrame:
    """(kmer, line): a k-mer frequency table as lines."""
    return frequencies.select("kmer", F.format_string("%s: %d (%s)", F.col("kmer"), F.col("n"), S.share_text(F.col("freq"))).alias("line"))


def sliding_view(sequences: DataFrame, window: int = 5, step: int = 1) -> DataFrame:
    """The composition series of each sequence, full or reduced by its number of windows."""
    return windows.series(sequences, window, step)


def tm_view(
    sequences: DataFrame,
    k: int = windows.K,
    windows_per_bin: int = windows.BIN_WINDOWS,
    target: int = windows.CHART_BINS,
    sodium: float | None = None,
    limits: list[float] | None = None,
) -> dict[str, DataFrame]:
    """Merged temperature bins, their summary, chart points and thresholds."""
    if windows_per_bin < 256 or target < 32:
        raise ValueError("a bin has at least 256 windows and a chart 32 bins")
    bins = windows.merge_bins(windows.tm_bins(sequences, k, windows_per_bin, sodium), target)
    return {"bins": bins, "summary": windows.tm_summary(bins), "chart": windows.chart(bins), "thresholds": windows.thresholds(bins, limits), "layers": windows.chart_layers(bins, limits)}


def codon_comparison(labelled: DataFrame, first: str, second: str, min_len: int = orfs.MIN_ORF) -> dict[str, DataFrame]:
    """Codon usage of two genomes (``labelled``: genome, seq_id, seq), each read as one sequence: the ten most frequent
    codons of each, those common to both, and the three most frequent amino acids."""
    usage = orfs.joined_codons_used(labelled, ("genome",), ("seq_id",), min_len)
    top = orfs.top_codons(usage, 10, ("genome",))
    acids = orfs.top_amino_acids(orfs.amino_acids(usage, ("genome",)), 3, ("genome",))
    a, b = (top.where(F.col("genome") == g) for g in (first, second))
    found = orfs.joined_reading_frames(labelled, ("genome",), ("seq_id",), min_len)
    return {"orfs": found, "usage": usage, "top_codons": top, "common": orfs.common(a, b), "top_amino_acids": acids}


def assembly(reference: DataFrame, n: int = 2000, min_len: int = 100, max_len: int = 150, k: int = reads.MIN_OVERLAP, seed: int = 42, overlap: str = "exact_k") -> DataFrame:
    """One row about sampling a reference and assembling it again."""
    sampled = reads.sample_reads(reads.checked_reference(reference), n, min_len, max_len, seed)
    unique = reads.unique_reads(sampled).withColumn("assembly_id", F.lit(0))
    contig = reads.assemble(unique, k, overlap)
    one = reference.select(F.col("seq").alias("a"))
    pair = contig.crossJoin(F.broadcast(one)).select(F.lit(0).alias("pair_id"), "a", F.col("contig").alias("b"), "contig", "reads_used")
    inside = reads.containment(pair)
    best = reads.best_shift(reads.identity_profile(pair))
    out = pair.join(inside, "pair_id").join(best, "pair_id", "left")
    return out.select(
        F.length("a").alias("ref_len"),
        F.lit(n).alias("reads"),
        F.lit(min_len).alias("min_len"),
        F.lit(max_len).alias("max_len"),
        F.lit(k).alias("k"),
        F.length("contig").alias("contig_len"),
        "reads_used",
        F.col("a_in_b").alias("ref_in_contig"),
        F.col("b_in_a").alias("contig_in_ref"),
        F.coalesce("shift", F.lit(0)).alias("shift"),
        F.coalesce("identity", F.lit(0.0)).alias("identity"),
        "contig",
    )
