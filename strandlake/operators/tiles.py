"""Tiles: long sequences cut into pieces that overlap by a halo.

Everything positional works on tiles, so no expression costs the square of a sequence's length:
within a tile, a position costs at most the tile's size. The tiles of a record stay in the task
that cut them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it has fewer partitions than there are cores, as a table of one
    small file has; a table of many splits is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tiles(sequences: DataFrame, halo: int, size: int = TILE, column: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keep, n, tile_off, tile): pieces of ``size`` symbols and up to ``halo`` of the next.

    n is the length of the whole sequence. Null and empty sequences have no tiles. The pieces
    come from one regular pass over the sequence and not from a substring each."""
    seq = F.col(column)
    # a look-ahead keeps the halo for the next match
    pattern = f"(?s)(?=(.{{1,{size + halo}}}))(?:.{{{size}}}|.+)"
    pieces = F.regexp_extract_all(seq, F.lit(pattern), 1)
    out = sequences.where(F.length(seq) > 0).select(*keep, F.length(seq).cast("long").alias("n"), F.posexplode(pieces).alias("_no", "tile"))
    return out.select(*keep, "n", (F.col("_no").cast("long") * size).alias("tile_off"), "tile")


def grams_in(tile: Column, width: int, size: int = TILE, step: int = 1) -> Column:
    """An array of (i, gram) for the starts i < ``size`` in a tile that have ``width`` symbols."""
    last = F.least(F.length(tile) - width, F.lit(size - 1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.substr(tile, i + 1, F.lit(width)).alias("gram")))


def grams(sequences: DataFrame, width: int, size: int = TILE, column: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keep, n, pos, gram): every run of ``width`` symbols with its position."""
    cut = tiles(sequences, width - 1, size, column, keep)
    found = cut.select(*keep, "n", "tile_off", F.explode(grams_in(F.col("tile"), width, size)).alias("_g"))
    return found.select(*keep, "n", (F.col("tile_off") + F.col("_g.i")).alias("pos"), F.col("_g.gram").alias("gram"))
