"""The queries on the given tables, each over the whole of its table.

A document is a record: doc_id is its place, source its header, text its sequence. Results are
integers, or doubles that both sides compute by the same operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.genetic_code import with_nutrition
from ..operators import concat, kmers, orfs, reads, symbols, windows
from ..operators.tiles import spread
from ..sources import fasta, sinks, splits
from ..sources.shared import shared_folder
from . import reports

#: Prose leaves short runs of bases, so reading frames are accepted from here on.
MIN_LEN = 30
READ_K = 12
#: How often reads cover a symbol on average.
COVERAGE = 4.0


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text", "lang"))
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("source").alias("header"), F.col("text").alias("seq"), "lang")


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("seq_id", "lang", S.acgt_only(F.col("seq")).alias("seq"))


def symbol_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbol_frequencies(_docs(spark, sf_dir))


def symbol_freq_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbol_frequencies(_docs(spark, sf_dir), by=("lang",))


def alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.alphabets(_docs(spark, sf_dir))


def alphabet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.alphabet_order(_docs(spark, sf_dir))


def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbol_table(_docs(spark, sf_dir))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.histogram(_docs(spark, sf_dir)).select("code", "n")


def record_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.record_lengths(_docs(spark, sf_dir))


def fasta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.fasta_summary(_docs(spark, sf_dir))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.base_counts(_docs(spark, sf_dir))


def melting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.melting(_docs(spark, sf_dir))


def validate_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.validate(_docs(spark, sf_dir))


def kmer_freq_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_frequencies(_docs(spark, sf_dir), 2, clean=True)


def kmer_freq_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_frequencies(_docs(spark, sf_dir), 3, clean=True)


def kmer_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_presence(_bases(spark, sf_dir), 3)


def distinct_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.distinct_kmers(_bases(spark, sf_dir), 2)


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_counts(_docs(spark, sf_dir), 50, 10)


def sliding_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_counts(_docs(spark, sf_dir), 50, 10)


def sliding_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.downsampled(_docs(spark, sf_dir), 50, 10, 8)


def tm_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256).select(
        "seq_id", "bin", *(F.col(c).cast("long").alias(c) for c in ("sum_tm", "min_tm", "max_tm")), "n"
    )


def tm_bins_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = windows.merge_bins(windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256), 4)
    return bins.select("seq_id", "bin", *(F.col(c).cast("long").alias(c) for c in ("sum_tm", "min_tm", "max_tm")), "n")


def tm_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256)
    return windows.thresholds(bins, [22.0, 24.5, 27.0]).select("seq_id", "bin", "ord", "threshold", "above")


def tm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256)
    return windows.tm_summary(bins).select("seq_id", "windows", "bins", F.col("min_tm").cast("long").alias("min_tm"), F.col("max_tm").cast("long").alias("max_tm"))


def _rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.rna_of(_bases(spark, sf_dir), keep=("seq_id", "lang"))


def orf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.open_reading_frames(_rna(spark, sf_dir), MIN_LEN)


def codon_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.codons_used(_rna(spark, sf_dir), MIN_LEN).select("codon", "n")


def top_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.top_codons(orfs.codons_used(_rna(spark, sf_dir), MIN_LEN, ("lang",)), 10, ("lang",))


def common_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_codons(spark, sf_dir)
    return orfs.common(top.where("lang = 'en'"), top.where("lang = 'fr'")).select("rank", "codon", "n")


def aa_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.amino_acids(orfs.codons_used(_rna(spark, sf_dir), MIN_LEN)).select("aa", "n")


def top_aa(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = orfs.codons_used(_rna(spark, sf_dir), MIN_LEN, ("lang",))
    return orfs.top_amino_acids(orfs.amino_acids(usage, ("lang",)), 3, ("lang",))


def aa_nutrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_nutrition(aa_usage(spark, sf_dir))
    return found.select("aa", "n", "name", F.array_join("low_foods", "; ").alias("low_foods"), F.array_join("rich_foods", "; ").alias("rich_foods"))


def top_aa_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_aa(spark, sf_dir)
    return orfs.union_in_order(top.where("lang = 'en'"), top.where("lang = 'fr'"))


def first_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.first_orf(_rna(spark, sf_dir))


def translate_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.translate_orf(_rna(spark, sf_dir))


def translate_frame1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.translate_frame(_rna(spark, sf_dir), 1)


def translate_frame2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.translate_frame(_rna(spark, sf_dir), 2)


def translate_frame3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.translate_frame(_rna(spark, sf_dir), 3)


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's bases as a read of its conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    read = S.acgt_only(F.coalesce(F.col("text"), F.lit("")))
    return turns.select(F.col("conv_id").alias("assembly_id"), F.col("turn").alias("read_id"), read.alias("seq"))


def unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.unique_reads(_reads(spark, sf_dir), ("assembly_id",))


def seed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.seed_read(unique_reads(spark, sf_dir), ("assembly_id",)).select("assembly_id", "uid", "seq")


def read_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.overlaps(unique_reads(spark, sf_dir), 2, ("assembly_id",))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.sample_reads_at_scale(_bases(spark, sf_dir), 6, 40, 60)


def sample_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)


def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = _sampled(spark, sf_dir).withColumnRenamed("seq_id", "assembly_id")
    return reads.assemble(reads.unique_reads(sampled, ("assembly_id",)), READ_K)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn against each other turn, in bases."""
    turns = _reads(spark, sf_dir)
    first = turns.where("read_id = 0").select("assembly_id", F.col("seq").alias("a"))
    others = turns.where("read_id > 0").select("assembly_id", "read_id", F.col("seq").alias("b"))
    return others.join(first, "assembly_id").select((F.col("assembly_id") * 1000 + F.col("read_id")).alias("pair_id"), "a", "b")


def identity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.identity_profile(_pairs(spark, sf_dir), 5).select("pair_id", "off", "matches", "total")


def best_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.best_shift(reads.identity_profile(_pairs(spark, sf_dir)))


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.containment(_pairs(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a folder of FASTA files, in the order of doc_id."""
    docs = _docs(spark, sf_dir).select(
        "seq_id", F.concat_ws("|", "seq_id", F.coalesce("header", F.lit(""))).alias("header"), F.translate(F.coalesce("seq", F.lit("")), " \t\r\n\x0b\x0c>", "").alias("seq")
    )
    folder = shared_folder(spark)
    sinks.write_fasta(docs, folder, order="seq_id")
    return folder


def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as FASTA and read back."""
    found = fasta.records(spark, _written(spark, sf_dir))
    return found.select("seq_id", "header", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


def fasta_scan_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the statistics scan, none of which is put together."""
    return splits.lengths(fasta.statistics_pieces(spark, _written(spark, sf_dir))).select("seq_id", "header", F.col("n").alias("len"))


def fasta_scan_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbol_table(fasta.statistics_pieces(spark, _written(spark, sf_dir)))


def fasta_scan_tm_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the files as one sequence of bases, as the temperature programs read them."""
    bases = fasta.base_pieces(spark, _written(spark, sf_dir))
    bins = windows.temperatures(windows.joined_gc_bins(bases, (), ("_at",)), by=())
    return bins.select("bin", *(F.col(c).cast("long").alias(c) for c in ("sum_tm", "min_tm", "max_tm")), "n", "mean_tm")


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as wrapped text."""
    docs = _docs(spark, sf_dir).select("seq_id", F.coalesce("header", F.lit("")).alias("header"), S.acgt_only(F.coalesce("seq", F.lit(""))).alias("seq"))
    return sinks.fasta_text(docs, sinks.PROTEIN_WIDTH, keep=("seq_id",))


def joined_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's bases begin in the sequence that its language makes."""
    sizes = _bases(spark, sf_dir).select("lang", "seq_id", F.length("seq").alias("n"))
    return concat.places(sizes, ("lang",), ("seq_id",))


def joined_tm_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = windows.temperatures(windows.joined_gc_bins(_docs(spark, sf_dir), ("lang",), ("seq_id",), windows_per_bin=1_000), by=("lang",))
    return bins.select("lang", "bin", *(F.col(c).cast("long").alias(c) for c in ("sum_tm", "min_tm", "max_tm")), "n")


def joined_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.joined_sliding_counts(_docs(spark, sf_dir), ("lang",), ("seq_id",), 50, 10)


def joined_orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.joined_reading_frames(_docs(spark, sf_dir), ("lang",), ("seq_id",), MIN_LEN)


def joined_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.joined_codons_used(_docs(spark, sf_dir), ("lang",), ("seq_id",), MIN_LEN).select("lang", "codon", "n", *(F.col(f"first_ord.{c}").alias(f"first_{c}") for c in ("frame", "start", "i")))


def genome_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages as two genomes: codons that are frequent in both, in the order of the first."""
    labelled = _docs(spark, sf_dir).withColumn("genome", F.col("lang"))
    return reports.codon_comparison(labelled.where("lang in ('en', 'fr')"), "en", "fr", MIN_LEN)["common"].select("rank", "codon", "n")


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the prefix of their header; others are left out."""
    return fasta.labelled(_docs(spark, sf_dir), {"one": "src1", "two": "src2"}).select("seq_id", "genome", "header")


def tm_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of merged bins."""
    bins = windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256)
    return windows.merge_bins(bins, 4).select("seq_id", "bin", "mean_tm", "n")


def tm_mean_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tm_summary(windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256)).select("seq_id", "low_mean", "high_mean")


def tm_default_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold that holds where none is given: the mean of a sequence's bin means."""
    bins = windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256)
    return windows.thresholds(bins).select("seq_id", "bin", "ord", F.round("threshold", 6).alias("threshold"))


def tm_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and axis limits of the temperature chart."""
    return windows.chart(windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256)).select("seq_id", "x", "y", F.col("y_low").cast("long").alias("y_low"), F.col("y_high").cast("long").alias("y_high"))


def tm_chart_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole temperature chart as one table, with two thresholds."""
    return windows.chart_layers(windows.tm_bins(_docs(spark, sf_dir), windows_per_bin=256), [22.0, 24.5])


def series_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.series_layers(sliding_series(spark, sf_dir))


def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.symbol_lines(symbol_table(spark, sf_dir))


def kmer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kmer_lines(kmer_freq_k2(spark, sf_dir))


def sliding_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_frequencies(_docs(spark, sf_dir), 50, 10)


def sliding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole series of sequences with up to 20 windows, 8 averages of longer ones."""
    return windows.series(_docs(spark, sf_dir), 50, 10, 20, 8)


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shares of A of each sequence, as text."""
    shares = windows.sliding_counts(_docs(spark, sf_dir), 50, 10).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("win_idx", "a"))).alias("s"))
    values = F.transform("s", lambda x: S.clamp01(x["a"] / F.lit(50)))
    return shares.select("seq_id", S.preview(values).alias("shown"))


def symbol_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each symbol of the documents is as a base."""
    found = symbols.alphabet_order(_docs(spark, sf_dir))
    return found.select("symbol", S.gc_flag(F.col("symbol")).alias("gc"), S.base_index(S.ascii_upper(F.col("symbol"))).cast("int").alias("base"))


def kmer_counts_k21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.base_kmer_counts(_docs(spark, sf_dir), 21, clean=True)


def kmer_freq_k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too many possible k-mers to list those that are absent."""
    return kmers.kmer_frequencies(_docs(spark, sf_dir), 13, clean=True)


def read_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest overlaps of at least three bases between the turns of a conversation."""
    return reads.overlap_graph(unique_reads(spark, sf_dir), 3, ("assembly_id",))


def read_graph_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = unique_reads(spark, sf_dir)
    return reads.reduced_graph(reads.overlap_graph(unique, 3, ("assembly_id",)), unique, ("assembly_id",))


def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of every document that cover it four times."""
    return reads.sample_reads_by_coverage(_bases(spark, sf_dir), COVERAGE, 40, 60)


def assemble_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = sample_coverage(spark, sf_dir).withColumnRenamed("seq_id", "assembly_id")
    return reads.assemble(reads.unique_reads(sampled, ("assembly_id",)), READ_K)


def assemble_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = sample_coverage(spark, sf_dir).withColumnRenamed("seq_id", "assembly_id")
    return reads.assemble(reads.unique_reads(sampled, ("assembly_id",)), READ_K, "longest")


def overlap_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest overlap of at least three bases of a first turn's end with another turn."""
    return _pairs(spark, sf_dir).select("pair_id", reads.overlap_length(F.col("a"), F.col("b"), 3).cast("long").alias("overlap"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        symbol_freq, symbol_freq_by_lang, alphabet, alphabet_order, symbol_table, byte_histogram, record_stats, fasta_summary,
        base_counts, melting, validate_sequence, kmer_freq_k2, kmer_freq_k3, kmer_presence, distinct_kmers, window_counts,
        sliding_freqs, sliding_downsampled, tm_bins, tm_bins_merged, tm_threshold, tm_summary, orf_scan, codon_usage, top_codons,
        common_codons, aa_usage, top_aa, aa_nutrition, top_aa_union, first_orf, translate_orf, translate_frame1, translate_frame2,
        translate_frame3, fasta_scan, fasta_scan_lengths, fasta_scan_symbols, fasta_scan_tm_bins, fasta_lines, joined_places, joined_tm_bins,
        joined_sliding, joined_orfs, joined_codons, genome_comparison, labelled_records, tm_means, tm_mean_range, tm_default_threshold, tm_chart,
        sliding_shares, sliding_series, previews, symbol_flags, tm_chart_layers, series_layers, symbol_lines, kmer_lines, overlap_lengths, kmer_counts_k21, kmer_freq_k13, read_graph, read_graph_reduced, sample_coverage, assemble_coverage, assemble_longest, unique_reads, seed_reads, read_overlaps, sample_reads, assemble, identity_profile, best_shift, containment,
    )
    return {f.__name__: f for f in names}
