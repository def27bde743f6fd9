"""Symbol statistics: frequencies, alphabets, base counts, melting temperatures, record tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import sequences as S
from . import arrays


def _letters(column: Column) -> Column:
    """The distinct symbols of a text, in order of appearance."""
    return F.filter(F.array_distinct(F.split(column, "")), lambda c: c != "")


def symbol_counts(sequences: DataFrame, column: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, symbol, n, first): one row per text and distinct symbol, with its number and first
    place. A symbol is a code point. Texts count their own symbols, so no row per place exists."""

    def kernel(text: bytes) -> tuple:
        letters, first, n = np.unique(arrays.code_points(text), return_index=True, return_counts=True)
        return [chr(x) for x in letters.tolist()], n, first

    return arrays.apply(sequences.select(*keep, column), column, keep, "symbol string, n long, first long", kernel)


def symbol_frequencies(sequences: DataFrame, column: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, symbol, n, total, freq): counts and shares of all symbols of a group.

    Counts are summed before anything is joined; the total comes from the counts."""
    counts = symbol_counts(sequences, column, by).groupBy(*by, "symbol").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by)).alias("total") if by else F.sum("n").over(W.partitionBy(F.lit(1))).alias("total")
    return counts.select(*by, "symbol", "n", total).withColumn("freq", S.relative(F.col("n"), F.col("total")))


def alphabets(sequences: DataFrame, column: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keep, alphabet, size): distinct symbols of each sequence in order of appearance."""
    letters = _letters(F.col(column))
    return sequences.select(*keep, F.array_join(letters, "").alias("alphabet"), F.size(letters).cast("long").alias("size"))


def alphabet_order(sequences: DataFrame, column: str = "seq", order: str = "seq_id") -> DataFrame:
    """(symbol, n, first_seq, first_pos): the alphabet of a whole table; by the last two columns
    it is in order of first appearance."""
    counts = symbol_counts(sequences.select(F.col(order).alias("_o"), F.col(column).alias("seq")), keep=("_o",))
    return counts.groupBy("symbol").agg(F.sum("n").alias("n"), F.min(F.struct("_o", "first")).alias("f")).select(
        "symbol", "n", F.col("f._o").alias("first_seq"), F.col("f.first").alias("first_pos")
    )


def symbol_table(sequences: DataFrame, column: str = "seq") -> DataFrame:
    """(symbol, n, pct, ord): printable ASCII symbols of the upper-cased text without white
    space, letters A-Z first. The percentage is of all symbols, shown or not."""
    clean = sequences.select(S.without_whitespace(S.ascii_upper(F.col(column))).alias("seq"))
    counts = symbol_frequencies(clean)
    shown = counts.where(F.col("symbol").rlike("^[!-~]$"))
    order = W.partitionBy(F.lit(1)).orderBy(F.when(F.col("symbol").between("A", "Z"), 0).otherwise(1), F.ascii("symbol"))
    return shown.select("symbol", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), F.row_number().over(order).cast("long").alias("ord"))


def histogram(sequences: DataFrame, column: str = "seq") -> DataFrame:
    """(code, n): how often each of the 256 bytes occurs in the UTF-8 form of the upper-cased text
    without white space, zero where it doesn't. The bytes of a symbol count with it."""
    clean = sequences.select(S.without_whitespace(S.ascii_upper(F.col(column))).alias("seq"))
    counts = symbol_counts(clean).groupBy("symbol").agg(F.sum("n").alias("n"))
    pairs = F.regexp_extract_all(F.hex(F.encode("symbol", "UTF-8")), F.lit("(..)"), 1)
    found = counts.select(F.explode(pairs).alias("hex"), "n").groupBy(F.conv("hex", 16, 10).cast("int").alias("code")).agg(F.sum("n").alias("n"))
    codes = sequences.sparkSession.range(256).select(F.col("id").cast("int").alias("code"))
    return codes.join(found, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def record_lengths(records: DataFrame, header: str = "header", column: str = "seq", order: str = "seq_id") -> DataFrame:
    """(seq_id, header, len): symbols of each record without white space."""
    return records.select(
        F.col(order).alias("seq_id"),
        S.short_header(F.coalesce(F.col(header), F.lit("(no header)"))).alias("header"),
        F.coalesce(F.length(S.without_whitespace(F.col(column))), F.lit(0)).cast("long").alias("len"),
    )


def fasta_summary(records: DataFrame, header: str = "header", column: str = "seq", order: str = "seq_id") -> DataFrame:
    """One row: total_len, record_count, header_preview (the first header that isn't empty)."""
    lengths = record_lengths(records, header, column, order)
    named = F.when(F.col("header") != "", F.struct("seq_id", "header"))
    return lengths.agg(
        F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"), F.count("*").alias("record_count"), F.min(named)["header"].alias("header_preview")
    )


def base_counts(sequences: DataFrame, column: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keep, n, a, c, g, t) of the bases in each sequence, without exploding it."""
    clean = sequences.select(*keep, S.acgt_only(F.coalesce(F.col(column), F.lit(""))).alias("q"))
    return clean.select(*keep, F.length("q").cast("long").alias("n"), *(S.count_base(F.col("q"), b).alias(b.lower()) for b in S.BASES))


def melting(sequences: DataFrame, sodium: float = 0.05, column: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keep, n, gc_pct, tm_wallace, tm_salt) of each sequence's bases."""
    counts = base_counts(sequences, column, keep)
    gc = F.col("g") + F.col("c")
    return counts.select(
        *keep,
        "n",
        S.gc_percent(gc, F.col("n")).alias("gc_pct"),
        S.tm_wallace(gc, F.col("n")).alias("tm_wallace"),
        S.tm_salt(gc, F.col("n"), S.checked_sodium(sodium, 0.05)).alias("tm_salt"),
    )


def validate(sequences: DataFrame, column: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keep, valid, bad): empty sequences are invalid; bad is the first symbol that is no base."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    bad = S.first_invalid(text)
    return sequences.select(*keep, ((F.length(text) > 0) & bad.isNull()).alias("valid"), bad.alias("bad"))
