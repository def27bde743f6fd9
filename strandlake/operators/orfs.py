"""Open reading frames, codon usage and translation.

A record finds its own reading frames in one numpy pass: the stops of a frame cut it into runs,
and the first start of a run opens its only reading frame. Records that are read as one sequence
do the same over blocks, see ``joined_reading_frames``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import sequences as S
from ..functions.genetic_code import code_map, code_table
from ..sources.shared import fixed
from . import arrays, concat

MIN_ORF = 90


def rna_of(records: DataFrame, column: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keep, rna): upper case, no spaces, U for T. Other symbols stay."""
    return records.select(*keep, S.to_rna(F.coalesce(F.col(column), F.lit(""))).alias("rna"))


_FRAMES = "frame int, start long, end long, terminated boolean"


def open_reading_frames(rna: DataFrame, min_len: int = MIN_ORF, column: str = "rna", keep: str = "seq_id") -> DataFrame:
    """(seq_id, frame, start, end, terminated): reading frames of at least ``min_len`` symbols.

    From the first AUG after a stop (or the frame's beginning) to the next stop of the frame,
    exclusive; start codons in between belong to it. Without a stop it runs to the end, cut to
    whole codons; the length is tested before that cut, so such a tail may be a symbol or two
    shorter than ``min_len``."""
    rows = rna.select(F.col(keep).alias("seq_id"), F.col(column).alias("rna"))
    return arrays.apply(rows, "rna", ("seq_id",), _FRAMES, lambda text: arrays.reading_frames(arrays.code_points(text), min_len))


def orf_sequences(rna: DataFrame, min_len: int = MIN_ORF, column: str = "rna", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """The reading frames with the columns ``keep`` and their symbols (``orf``)."""

    def kernel(text: bytes) -> tuple:
        frame, start, end, terminated = arrays.reading_frames(arrays.code_points(text), min_len)
        symbols = text.decode() if len(start) else ""
        return frame, start, end, terminated, [symbols[a:b] for a, b in zip(start.tolist(), end.tolist())]

    return arrays.apply(rna, column, keep, f"{_FRAMES}, orf string", kernel)


def codon_usage(orfs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, codon, n, first_ord): codons of the reading frames without those that have an N.

    first_ord orders codons by first appearance: frame, then start, then place, within the
    smallest sequence that has them."""

    def kernel(text: bytes, frame: int, start: int) -> tuple:
        symbols = arrays.code_points(text)
        one = [np.array([x], np.int64) for x in (0, 0, len(symbols) // 3 * 3)]
        codons, n, _, _, i = arrays.counted_codons(symbols, *one)
        return [arrays.codon_text(c) for c in codons.tolist()], n, i

    rows = orfs.select(*by, "seq_id", "frame", "start", "orf")
    return _used(arrays.apply(rows, "orf", (*by, "seq_id", "frame", "start"), "codon string, n long, i long", kernel, ("frame", "start")), by)


def _used(counts: DataFrame, by: tuple[str, ...], order: tuple[str, ...] = ("seq_id", "frame", "start", "i")) -> DataFrame:
    kept = counts.where(~F.contains("codon", F.lit("N")))
    # few distinct codons: the partial sums are all that moves
    return kept.groupBy(*by, "codon").agg(F.sum("n").alias("n"), F.min(F.struct(*order)).alias("first_ord"))


_CODONS = "codon string, n long, frame int, start long, i long"


def codons_used(rna: DataFrame, min_len: int = MIN_ORF, by: tuple[str, ...] = (), column: str = "rna") -> DataFrame:
    """``codon_usage`` of the reading frames of sequences (*by, seq_id, column), in one pass."""

    def kernel(text: bytes) -> tuple:
        symbols = arrays.code_points(text)
        frame, start, end, _ = arrays.reading_frames(symbols, min_len)
        codons, *rest = arrays.counted_codons(symbols, frame, start, end)
        return [arrays.codon_text(c) for c in codons.tolist()], *rest

    return _used(arrays.apply(rna.select(*by, "seq_id", column), column, (*by, "seq_id"), _CODONS, kernel), by)


#: Symbols of a stretch of a long sequence whose stops one task counts.
STRETCH = 1 << 21


def joined_reading_frames(parts: DataFrame, by: tuple[str, ...], order: tuple[str, ...], min_len: int = MIN_ORF, block: int = concat.BLOCK, column: str = "seq", stretch: int = STRETCH) -> DataFrame:
    """(*by, frame, start, end, terminated): as ``open_reading_frames``, of the bases of each
    group's records as one sequence, so reading frames span them.

    Blocks find start and stop codons; only these, a few in a hundred positions, go on.
    Within one frame the stops cut the codons into islands, and an island's first start opens
    its only reading frame. Islands are numbered by stretches whose stops are summed first."""
    return _islands(concat.blocks(_joined_rna(parts, by, order, column), by, order, 2, block, "rna"), by, min_len, block, stretch)


def _joined_rna(parts: DataFrame, by: tuple[str, ...], order: tuple[str, ...], column: str) -> DataFrame:
    return parts.select(*by, *order, F.translate(S.acgt_only(F.col(column)), "T", "U").alias("rna"))


def _islands(cut: DataFrame, by: tuple[str, ...], min_len: int, block: int, stretch: int) -> DataFrame:
    def marks(tile: bytes, at: int) -> tuple | None:
        symbols = arrays.code_points(tile)
        if len(symbols) < 3:
            return None
        start, stop = (x[:block] for x in arrays.starts_and_stops(symbols))
        place = np.flatnonzero(start | stop)
        return at + place, stop[place]

    codon = arrays.apply(cut, "tile", (*by, "n"), "pos long, stop boolean", marks, ("tile_off",))
    codon = codon.withColumns({"frame": (F.col("pos") % 3).cast("int"), "_stretch": F.floor(F.col("pos") / F.lit(stretch))})
    of = (*by, "frame")
    stops = codon.groupBy(*of, "_stretch").agg(F.sum(F.col("stop").cast("int")).alias("_stops"))
    before = W.partitionBy(*of).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    ahead = stops.select(*of, "_stretch", F.coalesce(F.sum("_stops").over(before), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy(*of, "_stretch").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    island = F.col("_ahead") + F.coalesce(F.sum(F.col("stop").cast("int")).over(inside), F.lit(0))
    found = (
        concat.same(codon, ahead, (*of, "_stretch"))
        .withColumn("_island", island)
        .groupBy(*of, "_island")
        .agg(F.min(F.when(~F.col("stop"), F.col("pos"))).alias("start"), F.max(F.when(F.col("stop"), F.col("pos"))).alias("at"), F.max("n").alias("n"))
        .where("start is not null")
    )
    tail = F.col("n") - F.col("start")
    length = F.when(F.col("at").isNotNull(), F.col("at") - F.col("start")).otherwise(tail)
    return found.where(length >= min_len).select(*of, "start", F.coalesce("at", F.col("n") - tail % 3).alias("end"), F.col("at").isNotNull().alias("terminated"))


def joined_codons_used(parts: DataFrame, by: tuple[str, ...], order: tuple[str, ...], min_len: int = MIN_ORF, block: int = concat.BLOCK, column: str = "seq") -> DataFrame:
    """(*by, codon, n, first_ord): ``codons_used`` of each group's records as one sequence.

    The reading frames go to the blocks that they cross, and each block counts its own codons."""
    cut = fixed(concat.blocks(_joined_rna(parts, by, order, column), by, order, 2, block, "rna"))
    found = _islands(cut, by, min_len, block, STRETCH).where(F.col("end") > F.col("start"))
    crossed = F.sequence(F.floor(F.col("start") / F.lit(block)), F.floor((F.col("end") - 1) / F.lit(block)))
    at = found.select(*by, "frame", "start", "end", F.explode(F.transform(crossed, lambda b: b * block)).alias("tile_off"))
    listed = at.groupBy(*by, "tile_off").agg(F.collect_list(F.struct("frame", "start", "end")).alias("frames"))

    def kernel(tile: bytes, off: int, frames: list[dict]) -> tuple:
        order_ = sorted((f["frame"], f["start"], f["end"]) for f in frames)
        frame, start, end = (np.array(x, np.int64) for x in zip(*order_))
        codons, *rest = arrays.counted_codons(arrays.code_points(tile), frame, start, end, off, off + block, off)
        return [arrays.codon_text(c) for c in codons.tolist()], *rest

    counted = arrays.apply(concat.same(cut, listed, (*by, "tile_off")), "tile", by, _CODONS, kernel, ("tile_off", "frames"))
    return _used(counted, by, ("frame", "start", "i"))


def top_codons(usage: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, rank, codon, n): the most frequent, ties by first appearance."""
    order = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    rank = F.row_number().over(order.orderBy(F.desc("n"), "first_ord")).cast("long")
    return usage.select(*by, rank.alias("rank"), "codon", "n").where(F.col("rank") <= k)


def amino_acids(usage: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, aa, n, first_ord) by the genetic code, without stops and unknown codons."""
    code = F.broadcast(code_table(usage.sparkSession))
    joined = usage.join(code, "codon", "left").withColumn("aa", F.coalesce("aa", F.lit("X"))).where(~F.col("aa").isin("*", "X"))
    return joined.groupBy(*by, "aa").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))


def top_amino_acids(counts: DataFrame, k: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, rank, aa, n)."""
    order = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    rank = F.row_number().over(order.orderBy(F.desc("n"), "first_ord")).cast("long")
    return counts.select(*by, rank.alias("rank"), "aa", "n").where(F.col("rank") <= k)


def common(left: DataFrame, right: DataFrame, column: str = "codon") -> DataFrame:
    """Rows of the left list whose ``column`` is in the right one too, in the left order."""
    return left.join(right.select(column), column, "left_semi").orderBy("rank")


def union_in_order(left: DataFrame, right: DataFrame, column: str = "aa") -> DataFrame:
    """(column, ord): distinct values of two ranked lists, those of the left one first."""
    both = left.select(column, F.struct(F.lit(0).alias("s"), "rank").alias("o")).unionByName(right.select(column, F.struct(F.lit(1).alias("s"), "rank").alias("o")))
    first = both.groupBy(column).agg(F.min("o").alias("o"))
    return first.select(column, F.row_number().over(W.partitionBy(F.lit(1)).orderBy("o")).cast("long").alias("ord"))


def _first_bounds(r: Column) -> tuple[Column, Column]:
    start = F.locate(S.START, r)
    body = S.codons(F.substr(r, F.greatest(start, F.lit(1))))
    stops = [F.array_position(body, s) for s in S.STOPS]
    stop = F.least(*(F.nullif(s, F.lit(0).cast("long")) for s in stops))
    end = F.when((start > 0) & stop.isNotNull(), start - 1 + 3 * (stop - 1)).otherwise(F.length(r).cast("long"))
    return F.greatest(start - 1, F.lit(0)).cast("long"), end.cast("long")


def first_orf(rna: DataFrame, column: str = "rna", keep: str = "seq_id") -> DataFrame:
    """(seq_id, start, end): from the first AUG anywhere to the first stop of its frame; to the
    end without one, and the whole sequence without a start."""
    start, end = _first_bounds(F.col(column))
    return rna.select(F.col(keep).alias("seq_id"), start.alias("start"), end.alias("end"))


def translate_orf(rna: DataFrame, column: str = "rna", keep: str = "seq_id") -> DataFrame:
    """(seq_id, protein) of the first reading frame."""
    start, end = _first_bounds(F.col(column))
    region = F.substr(F.col(column), start.cast("int") + 1, (end - start).cast("int"))
    return rna.select(F.col(keep).alias("seq_id"), S.protein(S.codons(region), code_map()).alias("protein"))


def translate_frame(rna: DataFrame, number: int = 1, column: str = "rna", keep: str = "seq_id") -> DataFrame:
    """(seq_id, protein) of a whole frame; stops appear as * and do not end it."""
    region = S.whole_codons(S.frame(F.col(column), number))
    return rna.select(F.col(keep).alias("seq_id"), S.protein(S.codons(region), code_map()).alias("protein"))
