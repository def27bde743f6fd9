"""Sliding windows over bases: compositions, melting temperatures, bins and thresholds.

Bases are upper-cased A, C, G, T; other symbols are skipped, windows run over the rest. Counts
stay integers until the last projection, so sums do not depend on the order of rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import sequences as S
from ..sources.shared import fixed
from . import arrays, concat

#: Windows up to which a full series is given, and the points of a reduced one.
FULL_WINDOWS = 2_000_000
CHART_POINTS = 4800
BIN_WINDOWS = 10_000
CHART_BINS = 1200
K = 9


def _bases(sequences: DataFrame, column: str, keep: str) -> DataFrame:
    return sequences.select(F.col(keep).alias("seq_id"), S.acgt_only(F.coalesce(F.col(column), F.lit(""))).alias("seq"))


def window_counts(sequences: DataFrame, window: int, step: int, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, windows): how many full windows each sequence has."""
    clean = _bases(sequences, column, keep)
    return clean.select("seq_id", S.window_count(F.length("seq"), window, step).alias("windows"))


def _counted(bases: bytes, begin: np.ndarray, window: int) -> list[np.ndarray]:
    """A, C, G and T in the windows that start at ``begin``, by differences of running counts."""
    symbols = np.frombuffer(bases, np.uint8)
    running = (np.concatenate([[0], np.cumsum(symbols == ord(b))]) for b in S.BASES)
    return [r[begin + window] - r[begin] for r in running]


def sliding_counts(sequences: DataFrame, window: int, step: int, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, win_idx, a, c, g, t): base counts of the full windows that start every ``step``."""
    if window < 1 or step < 1:
        raise ValueError("window and step must be positive")

    def kernel(text: bytes) -> tuple:
        bases = arrays.bases_of(text)
        begin = np.arange(0, len(bases) - window + 1, step)
        return begin // step, *_counted(bases, begin, window)

    rows = sequences.select(F.col(keep).alias("seq_id"), F.col(column).alias("seq"))
    return arrays.apply(rows, "seq", ("seq_id",), "win_idx long, a long, c long, g long, t long", kernel)


def sliding_frequencies(sequences: DataFrame, window: int, step: int, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """As ``sliding_counts``, as single-precision shares of the window."""
    share = lambda c: (F.col(c).cast("double") / window).cast("float").alias(c)
    return sliding_counts(sequences, window, step, column, keep).select("seq_id", "win_idx", *map(share, "acgt"))


def _neighbours(bases: bytes, begin: np.ndarray, window: int, per: int) -> tuple | None:
    """(place, windows, a, c, g, t): sums over ``per`` neighbouring windows each."""
    if not len(begin):
        return None
    cuts = np.arange(0, len(begin), per)
    sums = (np.add.reduceat(c, cuts) for c in _counted(bases, begin, window))
    return np.arange(len(cuts)), np.diff(np.append(cuts, len(begin))), *sums


def downsampled(sequences: DataFrame, window: int, step: int, width: int, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, bucket, windows, a, c, g, t): sums of base counts over ceil(windows / width)
    neighbouring windows. Shares are sums over windows * window."""
    if min(width, window, step) < 1:
        raise ValueError("window, step and width must be positive")

    def kernel(text: bytes) -> tuple | None:
        bases = arrays.bases_of(text)
        begin = np.arange(0, len(bases) - window + 1, step)
        return _neighbours(bases, begin, window, -(-len(begin) // width))

    rows = sequences.select(F.col(keep).alias("seq_id"), F.col(column).alias("seq"))
    return arrays.apply(rows, "seq", ("seq_id",), "bucket long, windows long, a long, c long, g long, t long", kernel)


def series(sequences: DataFrame, window: int, step: int, full: int = FULL_WINDOWS, points: int = CHART_POINTS, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, x, a, c, g, t) shares in [0, 1]: all windows of a sequence that has up to
    ``full``, or ``points`` averages of one that has more."""
    if min(points, window, step) < 1:
        raise ValueError("window, step and points must be positive")

    def kernel(text: bytes) -> tuple | None:
        bases = arrays.bases_of(text)
        begin = np.arange(0, len(bases) - window + 1, step)
        return _neighbours(bases, begin, window, 1 if len(begin) <= full else -(-len(begin) // points))

    rows = sequences.select(F.col(keep).alias("seq_id"), F.col(column).alias("seq"))
    sums = arrays.apply(rows, "seq", ("seq_id",), "x long, windows long, a long, c long, g long, t long", kernel)
    return sums.select("seq_id", "x", *(S.clamp01(F.col(b) / (F.col("windows") * window)).cast("float").alias(b) for b in "acgt"))


def reduce_series(values: DataFrame, width: int, by: str = "seq_id", x: str = "x", columns: tuple[str, ...] = ("a", "c", "g", "t")) -> DataFrame:
    """Averages of neighbouring points so that at most ``width`` are left, clamped to [0, 1]."""
    per = F.ceil((F.max(x).over(W.partitionBy(by)) + 1) / F.lit(width))
    bucket = F.floor(F.col(x) / F.greatest(per, F.lit(1)))
    return values.withColumn("_b", bucket).groupBy(by, F.col("_b").alias(x)).agg(*(S.clamp01(F.avg(c)).alias(c) for c in columns))


def rolling_gc(sequences: DataFrame, k: int = K, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, win_idx, gc): G and C in each window of k bases, stride 1."""

    def kernel(text: bytes) -> tuple:
        gc = arrays.window_gc(arrays.bases_of(text), k)
        return np.arange(len(gc)), gc

    rows = sequences.select(F.col(keep).alias("seq_id"), F.col(column).alias("seq"))
    return arrays.apply(rows, "seq", ("seq_id",), "win_idx long, gc long", kernel)


_BINS = "bin long, sum_gc long, min_gc long, max_gc long, n long"


def gc_bins(sequences: DataFrame, k: int = K, windows_per_bin: int = BIN_WINDOWS, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, bin, sum_gc, min_gc, max_gc, n) over consecutive windows; the last may be short.

    A record sums its own windows, by differences of running counts, so nothing is shuffled. Rows
    are records of their own, also those that repeat a seq_id."""

    def kernel(text: bytes) -> tuple:
        return arrays.binned(arrays.window_gc(arrays.bases_of(text), k), 0, windows_per_bin)

    rows = sequences.select(F.col(keep).alias("seq_id"), F.col(column).alias("seq"))
    return arrays.apply(rows, "seq", ("seq_id",), _BINS, kernel)


def joined_gc_bins(parts: DataFrame, by: tuple[str, ...], order: tuple[str, ...], k: int = K, windows_per_bin: int = BIN_WINDOWS, block: int = concat.BLOCK, column: str = "seq") -> DataFrame:
    """(*by, bin, sum_gc, min_gc, max_gc, n): as ``gc_bins``, of each group's records as one
    sequence, so windows span them. Blocks sum their own windows."""

    def kernel(tile: bytes, at: int) -> tuple:
        return arrays.binned(arrays.window_gc(tile, k)[:block], at, windows_per_bin)

    cut = concat.base_blocks(parts, by, order, k - 1, block, column)
    shares = arrays.apply(cut, "tile", by, _BINS, kernel, ("tile_off",))
    return shares.groupBy(*by, "bin").agg(*(f(c).alias(c) for f, c in ((F.sum, "sum_gc"), (F.min, "min_gc"), (F.max, "max_gc"), (F.sum, "n"))))


def joined_sliding_counts(parts: DataFrame, by: tuple[str, ...], order: tuple[str, ...], window: int, step: int, block: int = concat.BLOCK, column: str = "seq") -> DataFrame:
    """(*by, win_idx, a, c, g, t): as ``sliding_counts``, of each group's records as one sequence."""
    if window < 1 or step < 1:
        raise ValueError("window and step must be positive")

    def kernel(tile: bytes, at: int) -> tuple:
        begin = np.arange((-at) % step, min(len(tile) - window + 1, block), step)
        return (at + begin) // step, *_counted(tile, begin, window)

    cut = concat.base_blocks(parts, by, order, window - 1, block, column)
    return arrays.apply(cut, "tile", by, "win_idx long, a long, c long, g long, t long", kernel, ("tile_off",))


def _linear(k: int, sodium: float | None) -> tuple[float, float]:
    """Constant and slope of the temperature in the count of G and C; Wallace without sodium."""
    return (2.0 * k, 2.0) if sodium is None else (S.salt_constant(sodium) - 600.0 / k, 41.0 / k)


def temperatures(bins: DataFrame, k: int = K, sodium: float | None = None, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*by, bin, sum_tm, min_tm, max_tm, n, mean_tm) of bins of G and C counts.

    The temperature is linear and rising in the count, so it is taken of the sums."""
    constant, slope = _linear(k, sodium)
    total = F.lit(constant) * F.col("n") + F.lit(slope) * F.col("sum_gc")
    return bins.select(
        *by,
        "bin",
        total.alias("sum_tm"),
        (F.lit(constant) + F.lit(slope) * F.col("min_gc")).alias("min_tm"),
        (F.lit(constant) + F.lit(slope) * F.col("max_gc")).alias("max_tm"),
        "n",
        (total / F.col("n")).alias("mean_tm"),
    )


def tm_bins(sequences: DataFrame, k: int = K, windows_per_bin: int = BIN_WINDOWS, sodium: float | None = None, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, bin, sum_tm, min_tm, max_tm, n, mean_tm) of the windows' melting temperatures."""
    return temperatures(gc_bins(sequences, k, windows_per_bin, column, keep), k, sodium)


def merge_bins(bins: DataFrame, target: int = CHART_BINS) -> DataFrame:
    """Bins merged by neighbours so that a sequence has at most ``target``; fewer stay as they are."""
    if target < 1:
        raise ValueError("target must be positive")
    group = F.ceil((F.max("bin").over(W.partitionBy("seq_id")) + 1) / F.lit(target))
    joined = bins.withColumn("_group", group).withColumn("bin", F.floor(F.col("bin") / F.col("_group")))
    merged = joined.groupBy("seq_id", "bin").agg(F.sum("sum_tm").alias("sum_tm"), F.min("min_tm").alias("min_tm"), F.max("max_tm").alias("max_tm"), F.sum("n").alias("n"))
    return merged.withColumn("mean_tm", F.coalesce(F.try_divide("sum_tm", "n"), F.lit(0.0)))


def tm_summary(bins: DataFrame) -> DataFrame:
    """(seq_id, windows, bins, min_tm, max_tm, low_mean, high_mean): extremes over windows, and
    over the bins' means."""
    return bins.groupBy("seq_id").agg(
        F.sum("n").alias("windows"),
        F.count("*").alias("bins"),
        F.min("min_tm").alias("min_tm"),
        F.max("max_tm").alias("max_tm"),
        F.min("mean_tm").alias("low_mean"),
        F.max("mean_tm").alias("high_mean"),
    )


def parsed_thresholds(text: str) -> list[float]:
    """The numbers in a list separated by commas; what is no number is ignored."""
    out = []
    for part in text.split(","):
        try:
            value = float(part.strip())
        except ValueError:
            continue
        if math.isfinite(value):
            out.append(value)
    return out


def thresholds(bins: DataFrame, values: list[float] | None = None) -> DataFrame:
    """(seq_id, bin, mean_tm, ord, threshold, above): every bin with every threshold; by default
    the one threshold is the mean of the sequence's bin means."""
    if values:
        listed = bins.sparkSession.createDataFrame(list(enumerate(map(float, values))), "ord int, threshold double")
        joined = bins.crossJoin(F.broadcast(listed))  # a handful of values given by the caller
    else:
        mean = bins.groupBy("seq_id").agg(F.avg("mean_tm").alias("threshold"))
        joined = bins.join(mean, "seq_id").withColumn("ord", F.lit(0))
    return joined.select("seq_id", "bin", "mean_tm", "ord", "threshold", (F.col("mean_tm") >= F.col("threshold")).alias("above"))


def y_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Axis limits: a margin of a twentieth of the range, at least 1, to whole numbers."""
    margin = F.greatest((high - low) * 0.05, F.lit(1.0))
    return F.floor(low - margin), F.ceil(high + margin)


def chart(bins: DataFrame) -> DataFrame:
    """(seq_id, x, y, y_low, y_high): the points of a temperature chart and its limits."""
    whole = W.partitionBy("seq_id")
    low, high = y_range(F.min("mean_tm").over(whole), F.max("mean_tm").over(whole))
    return bins.select("seq_id", F.col("bin").alias("x"), F.col("mean_tm").alias("y"), low.alias("y_low"), high.alias("y_high"))


#: Colours that threshold bars go through.
COLOURS = 5


def _layer(rows: DataFrame, layer: Column, series: Column, x: Column, y: Column, colour: Column) -> DataFrame:
    return rows.select("seq_id", layer.alias("layer"), series.cast("string").alias("series"), x.cast("long").alias("x"), y.cast("double").alias("y"), colour.cast("int").alias("colour"))


def chart_layers(bins: DataFrame, values: list[float] | None = None) -> DataFrame:
    """(seq_id, layer, series, x, y, colour): a temperature chart with its thresholds as one table,
    from which an image is drawn without further decisions.

    Layers: ``line`` has a point for each bin; ``limit`` the lower and the upper end of the axis
    (series low and high); ``bar`` a point over each bin for each threshold, which is its series, in
    one of ``COLOURS`` colours. Without ``values`` the threshold is the mean of the bin means."""
    bins = fixed(bins)  # read for each layer
    points = chart(bins)
    ends = points.groupBy("seq_id").agg(F.min("y_low").alias("low"), F.max("y_high").alias("high"))
    none = F.lit(None)
    bars = thresholds(bins, values)
    out = _layer(points, F.lit("line"), F.lit("mean_tm"), F.col("x"), F.col("y"), F.lit(0))
    for end in ("low", "high"):
        out = out.unionByName(_layer(ends, F.lit("limit"), F.lit(end), none, F.col(end), none))
    return out.unionByName(_layer(bars, F.lit("bar"), F.col("ord"), F.col("bin"), F.col("threshold"), F.col("ord") % COLOURS + 1))


def series_layers(shares: DataFrame) -> DataFrame:
    """(seq_id, layer, series, x, y, colour) of a composition chart: a ``line`` for each base, ``grid``
    lines at the quarters, and the ``limit`` 0 and 1.

    The shares are written once, and each is read as the points of its four lines."""
    shares = fixed(shares)
    points = F.array(*(F.struct(F.lit(b).alias("series"), F.col(b).cast("double").alias("y"), F.lit(i).alias("colour")) for i, b in enumerate("acgt")))
    lines = shares.select("seq_id", "x", F.explode(points).alias("p"))
    ends = [*(("grid", str(q / 4), q / 4) for q in range(5)), ("limit", "low", 0.0), ("limit", "high", 1.0)]
    around = F.array(*(F.struct(F.lit(a).alias("layer"), F.lit(b).alias("series"), F.lit(y).alias("y")) for a, b, y in ends))
    edges = shares.select("seq_id").distinct().select("seq_id", F.explode(around).alias("p"))
    out = _layer(edges, F.col("p.layer"), F.col("p.series"), F.lit(None), F.col("p.y"), F.lit(None))
    return out.unionByName(_layer(lines, F.lit("line"), F.col("p.series"), F.col("x"), F.col("p.y"), F.col("p.colour")))
