"""Records analysed as one sequence, without ever putting them together.

A group's records follow each other without a separator, so windows and reading frames may span
them. Each record gets its place in the group by prefix sums of lengths: keys and lengths are
sorted over ranges, a task sums its own, and the sums of whole ranges, one row each, are summed
before they are added. Records are then cut at fixed places of the group into blocks, and the
first symbols of the next block are added to each (its halo), from however many records they come.
Blocks have the form of ``tiles.tiles``: nothing is larger than a block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import sequences as S
from ..sources.shared import fixed, ship

#: Symbols of a block.
BLOCK = 1 << 16


def same(left: DataFrame, right: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal and the keys come once."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # one row, by contract
    named = {c: f"_of_{c}" for c in on}
    other = right.select(*(F.col(c).alias(named.get(c, c)) for c in right.columns))
    return left.join(other, reduce(Column.__and__, (left[c].eqNullSafe(other[n]) for c, n in named.items())), how).drop(*named.values())


def places(lengths: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """(*by, *order, start, total) for rows (*by, *order, n): how many symbols of the group come
    before each row, and how many it has. ``order`` has to be unique within a group."""
    keys = [*by, *order]
    kinds = dict(lengths.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            rows = zip(*(batch.column(c).to_pylist() for c in keys), batch.column("n").to_pylist())
            for *key, n in rows:
                if last is not None and key == last:
                    raise ValueError(f"two rows of a group have the same place: {key}")
                if last is None or key[: len(by)] != last[: len(by)]:
                    upto = 0
                local.append(upto)
                upto += n
                last = key
            if local:
                arrays = [*(batch.column(c) for c in keys), batch.column("n"), pa.array(local, pa.int64()), pa.array([task] * len(local), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "n", "_local", "_task"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "n long, _local long, _task int"])
    ranged = lengths.select(*keys, F.col("n").cast("long").alias("n")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ship(lengths.sparkSession)
    # the ranges are chosen by samples, so they are chosen once
    local = fixed(ranged.mapInArrow(run, schema))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    sums = local.groupBy(*by, "_task").agg(F.sum("n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(group.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select(*by, "_task", before.alias("_before"), F.sum("_sum").over(group).alias("total"))
    return same(local, ahead, (*by, "_task")).select(*keys, (F.col("_before") + F.col("_local")).alias("start"), "total")


def blocks(parts: DataFrame, by: tuple[str, ...], order: tuple[str, ...], halo: int, size: int = BLOCK, column: str = "seq") -> DataFrame:
    """(*by, n, tile_off, tile): each group's records (*by, *order, column) in order, as blocks of
    ``size`` symbols and up to ``halo`` of what follows; n is the length of the whole group.

    Null sequences are empty. A group without symbols has no block."""
    if size < 1 or halo < 0:
        raise ValueError("a block has at least one symbol and no negative halo")
    rows = parts.select(*by, *order, F.coalesce(F.col(column), F.lit("")).alias("_s"))
    placed = same(rows, places(rows.select(*by, *order, F.length("_s").alias("n")), by, order), (*by, *order)).where(F.length("_s") > 0)
    start, end = F.col("start"), F.col("start") + F.length("_s")
    lowest = F.greatest(F.floor((start - halo) / F.lit(size)), F.lit(0).cast("long"))
    touched = placed.select(*by, "total", "start", "_s", end.alias("_end"), F.explode(F.sequence(lowest, F.floor((end - 1) / F.lit(size)))).alias("_b"))
    low, high = F.greatest(F.col("_b") * size, F.col("start")), F.least((F.col("_b") + 1) * size + halo, F.col("_end"))
    cut = touched.select(*by, "total", "_b", low.alias("_low"), F.substr("_s", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("_t"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_low", "_t"))), lambda x: x["_t"]), "")
    return cut.groupBy(*by, "_b").agg(F.max("total").alias("n"), together.alias("tile")).select(*by, "n", (F.col("_b") * size).alias("tile_off"), "tile")


def base_blocks(parts: DataFrame, by: tuple[str, ...], order: tuple[str, ...], halo: int, size: int = BLOCK, column: str = "seq") -> DataFrame:
    """``blocks`` of the bases in the records; other symbols are skipped, over record ends too."""
    return blocks(parts.select(*by, *order, S.acgt_only(F.col(column)).alias(column)), by, order, halo, size, column)
