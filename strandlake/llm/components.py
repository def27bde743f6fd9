"""Connected components of an edge table by alternating large-star and small-star steps.

Each partition first contracts its own edges, which leaves at most one per node.
Neighbourhood minima come from map-side partial sums and a join with a unique side, so a hub
never meets in one task. Each round's edges are written to the shared folder. Up to ``EDGES``
edges are one task's share anyway, and are contracted at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, ship, tasks

#: Edges a task has at most on average.
EDGES = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """u -> the smallest of u and its neighbours; ``edges`` are partitioned by u."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(n, "u")
    return both.join(_least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition(n, "u")
    least = _least(down)
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the least node it reaches there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in up]
    stars = [s for s in stars if s[0] != s[1]]
    for lo in range(0, len(stars), 50_000):
        part = stars[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in part], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge in ``edges`` (x, y): root is the least reachable id.

    Loops and repeated edges are harmless; without edges the result is empty."""
    ship(edges.sparkSession)
    linked = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).where("u <> v")
    n = tasks(linked, EDGES)
    if n == 1:
        # one task's share of edges: contracting them leaves the stars of whole components
        now = materialize(linked.repartition(1).mapInArrow(released(_contracted), "u long, v long"), "links")
        return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    now = materialize(linked.mapInArrow(released(_contracted), "u long, v long").repartition(n, "u").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        now = materialize(_small_star(_large_star(now, n), n).repartition(n, "u").distinct(), "links")
    roots = now.repartition(n, "u").groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("id")).repartition(n, "id").distinct().select("id", F.col("id").alias("root")))
