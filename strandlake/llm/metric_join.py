"""Near duplicates of vectors: an exact range join in a metric space.

Vectors of one label are linked if their cosine is at least a limit. For unit vectors that is a
distance of at most ``r = sqrt(2 - 2 limit)``, and distances obey the triangle inequality:

* **Pivots** part a cell: a vector is at home in the cell of its nearest pivot.
* **Boundaries.** A vector is also a guest of every other cell in which a home vector can be within
  r of it: not if it is further than r plus the cell's radius from the pivot, nor if it is
  further than r beyond the plane between its own pivot and that one. A home vector so meets
  all of its partners in its cell, and **cells join independently**.
* **Cores.** Home vectors within r / 2 of the pivot are all linked with each other, so
  however many near copies there are, they are not compared with each other.

A cell that costs too much is parted again, by pivots from a sample of its vectors, if the sample
shows that this pays; the sample decides about the cost only. What is left is compared in blocks,
a pair of blocks a task's work, so no cell has to fit into one. Equal vectors count once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_back, id_key, materialize, released, ship
from .components import components

LIMIT = 0.98
#: Vectors of a block; a cell of more than two blocks is worth parting.
BLOCK = 2048
#: Pivots of a cell, vectors that they are chosen from, and how often cells are parted.
PIVOTS, SAMPLE, LEVELS = 16, 512, 6
#: Rounding of distances, on the safe side.
SLACK = 1e-9
#: Share of a cell's cost that may be left for a parting to be worth it.
WORTH = 0.6
#: Cosines this close to the limit are computed again without rounding of their sums.
CLOSE = 1e-10


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of two vectors, from sums that are rounded once."""
    dot, one, two = (math.fsum((x * y).tolist()) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (math.sqrt(one) * math.sqrt(two))


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if dims is None else dims)


def _classes(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """(id, label, vec, same): rows whose vector links with nothing have a null ``same``. Vectors
    are scaled by a power of two, which changes no cosine, so that squares don't overflow."""
    names = ["id", "label", "vec", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, same = [], []
            for v, lab in zip(batch.column("vec"), batch.column("label")):
                found = None
                if v.is_valid and lab.is_valid and v.values.null_count == 0:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                    if len(x) and np.isfinite(x).all() and x.any():
                        found = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
                vecs.append(found)
                same.append(None if found is None else found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(vecs, pa.list_(pa.float64())), pa.array(same, pa.binary())], names)

    ship(vectors.sparkSession)
    rows = vectors.select(id_key("`vec_id`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    found = rows.mapInArrow(released(run), "id long, label string, vec array<double>, same binary")
    # two digests of all bytes of the vector name it; so does its length
    return found.withColumn("same", F.when(F.col("same").isNotNull(), F.concat(F.sha2("same", 256), F.lit("/"), F.length("same").cast("string"))))


def _chosen(rows: pd.DataFrame, r: float) -> pd.DataFrame:
    """Pivots of a cell from its sample, or none if they would not pay."""
    cell = rows["cell"].iloc[0]
    none = pd.DataFrame({"cell": [], "pivots": []}, dtype=object)
    rows = rows.sort_values("u")
    x = _unit(np.stack(rows["vec"].to_numpy()))
    home, near = rows["home"].to_numpy(), rows["near"].to_numpy()
    own = x[home]
    if len(own) < 4:
        return none
    picked = [0]
    far = np.linalg.norm(own - own[0], axis=1)
    while len(picked) < PIVOTS and far.max() > r:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(own - own[picked[-1]], axis=1))
    pivots = own[picked]
    for _ in range(3):
        nearest = (own @ pivots.T).argmax(axis=1)
        means = np.stack([own[nearest == i].mean(axis=0) if (nearest == i).any() else pivots[i] for i in range(len(pivots))])
        norms = np.linalg.norm(means, axis=1)
        pivots = np.where(norms[:, None] > 1e-6, means / np.maximum(norms, 1e-6)[:, None], pivots)
    weight = rows["weight"].to_numpy(dtype=np.float64)
    place, d, guests = _assigned(x, pivots, r)
    cost = lambda h, m, c: (weight * h).sum() * (weight * m).sum() - (weight * c).sum() ** 2
    before = cost(home, np.ones(len(x)), home & near)
    after = 0.0
    for j in range(len(pivots)):
        h = home & (place == j)
        after += cost(h, (place == j) | guests[:, j], h & (d[np.arange(len(x)), place] <= r / 2 - SLACK))
    return pd.DataFrame({"cell": [cell], "pivots": [pivots.ravel()]}) if after < WORTH * before else none


def _assigned(x: np.ndarray, pivots: np.ndarray, r: float, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of each unit vector, its distances from the pivots, and in which other cells a vector
    at home there can be within r of it."""
    d2 = np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0)
    d = np.sqrt(d2)
    place = d2.argmin(axis=1)
    apart = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0.0))
    # distance beyond the plane between the own pivot and each other
    beyond = (d2 - d2[np.arange(len(x)), place][:, None]) / np.maximum(2.0 * apart[place], 1e-12)
    guests = ((beyond <= r + SLACK) | (apart[place] < 1e-3)) & (d <= d[np.arange(len(x)), place][:, None] + 2 * r + SLACK)
    if radius is not None:
        guests &= d <= radius[None, :] + r + SLACK
    guests[np.arange(len(x)), place] = False
    return place, d, guests


_STATE = "u long, vec array<double>, weight long, cell string, home boolean, near boolean"
_NAMES = [f.split(" ")[0] for f in _STATE.split(", ")]


def _parted(r: float):
    """Rows with the pivots of their cell go to the cells of its parts: homes once, guests to all
    that may need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, part, x, pivots in _by_cell(batch):
                inside = np.array([f"{cell}.{j}" for j in range(len(pivots))], dtype=object)
                radius = np.asarray(part.column("radius")[0].values.to_numpy(zero_copy_only=False))
                was = part.column("home").to_numpy(zero_copy_only=False)
                place, d, guests = _assigned(x, pivots, r, radius)
                to = guests.copy()
                # a guest here is at home elsewhere: it is a guest of its nearest cell too
                to[np.arange(len(x)), place] = d[np.arange(len(x)), place] <= radius[place] + r + SLACK
                to[was, place[was]] = True
                i, j = np.nonzero(to)
                home = was[i] & (place[i] == j)
                near = home & (d[i, j] <= r / 2 - SLACK)
                for lo in range(0, len(i), 1_000):
                    at = slice(lo, lo + 1_000)
                    rows = part.take(pa.array(i[at]))
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c) for c in _NAMES[:3]), pa.array(inside[j[at]], pa.string()), pa.array(home[at]), pa.array(near[at])], _NAMES
                    )

    return run


def _by_cell(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The cells of a batch: their rows, unit vectors and pivots."""
    coded = batch.column("cell").dictionary_encode()
    codes = coded.indices.to_numpy()
    for code, cell in enumerate(coded.dictionary.to_pylist()):
        part = batch.filter(pa.array(codes == code))
        x = _unit(_matrix(part.column("vec")))
        yield cell, part, x, part.column("pivots")[0].values.to_numpy(zero_copy_only=False).reshape(-1, x.shape[1])


def _radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far the home vectors of each part are from its pivot at most, by batch. Vectors next to
    a boundary count on both sides."""
    for batch in batches:
        for cell, _, x, pivots in _by_cell(batch):
            d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))
            most = np.where(d <= d.min(axis=1)[:, None] + SLACK, d, -1.0).max(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(pivots)), pa.array(range(len(pivots)), pa.int32()), pa.array(most)], ["cell", "j", "most"])


def _linked(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which vectors of a and b have a cosine of at least ``limit``."""
    s = _unit(a) @ _unit(b).T
    out = s >= limit
    for i, j in zip(*np.nonzero(np.abs(s - limit) < CLOSE)):
        out[i, j] = cosine(a[i], b[j]) >= limit
    return out


def _unit_of_work(limit: float):
    """One pair of blocks: how many vectors each home vector is linked with, by weight, and
    enough links to connect what is connected in it."""

    def run(table: pa.Table) -> pa.Table:
        u, weight, side, home = (table.column(c).to_numpy() for c in ("u", "weight", "side", "home"))
        vec = table.column("vec").combine_chunks()
        x = _matrix(vec)
        one = np.flatnonzero(side != 1)
        two = one if (side == 2).all() else np.flatnonzero(side == 1)
        n = np.zeros(len(u), np.int64)
        up = np.arange(len(u))
        strips = []
        for lo in range(0, len(one), 256):
            rows = one[lo : lo + 256]
            hit = _linked(x[rows], x[two], limit)
            hit &= u[rows][:, None] != u[two][None, :]
            n[rows] += hit @ weight[two]
            if two is not one:
                n[two] += weight[rows] @ hit
            strips.append(np.packbits(hit, axis=1))
        # least reachable place, by passing minima along the links and following pointers
        while True:
            before = up.copy()
            for k, lo in enumerate(range(0, len(one), 256)):
                rows = one[lo : lo + 256]
                hit = np.unpackbits(strips[k], axis=1, count=len(two)).astype(bool)
                if len(two):
                    least = np.where(hit, up[two][None, :], len(u)).min(axis=1)
                    up[rows] = np.minimum(up[rows], least)
                    back = np.where(hit, up[rows][:, None], len(u)).min(axis=0)
                    up[two] = np.minimum(up[two], back)
            while (up[up] != up).any():
                up = up[up]
            if (up == before).all():
                break
        counted = home & (n > 0)
        joined = up != np.arange(len(u))
        return pa.table(
            {
                "u": pa.array(np.concatenate([u[counted], u[joined]])),
                "n": pa.array(np.concatenate([n[counted], np.zeros(joined.sum(), np.int64)])),
                "v": pa.array([*[None] * int(counted.sum()), *u[up[joined]].tolist()], pa.int64()),
            }
        )

    return run


def near_vectors(vectors: DataFrame, limit: float = LIMIT, vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    n_links counts the other rows of its label whose cosine with it, in double precision, is at
    least ``limit``; component_id is the smallest vec_id reachable by links. Rows with a null
    label, or with a vector that is null, empty, zero or has a null or non-finite component, link
    with nothing, nor do vectors of different lengths. Rows that repeat an id (null too) are
    counted one by one and are one node of the links. Equal vectors are linked. Cosines next to the
    limit are settled by exactly rounded sums. An empty table gives none; other columns are
    ignored."""
    if not 0 < limit <= 1:
        raise ValueError("the limit must be above 0 and at most 1")
    r = math.sqrt(max(2 - 2 * limit, 0.0))
    rows = materialize(_classes(vectors, vector, label), "vectors")
    there = rows.where("same is not null")
    by = ["label", "same"]
    grouped = there.groupBy(*by).agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("id").alias("least"))
    # a class is numbered once, in a table that is written
    classes = materialize(grouped.withColumn("u", F.monotonically_increasing_id()), "classes")
    # a cell is a label and a length, and the numbers of its parts
    root = F.concat_ws(":", F.base64(F.encode("label", "UTF-8")), F.size("vec").cast("string"))
    state = classes.select("u", "vec", "weight", root.alias("cell"), F.lit(True).alias("home"), F.lit(False).alias("near"))
    done: list[DataFrame] = []
    for _ in range(LEVELS):
        sizes = state.groupBy("cell").agg(F.sum(F.col("home").cast("double")).alias("h"), F.count("*").alias("m"), F.sum(F.col("near").cast("double")).alias("c"))
        big = materialize(sizes.where(F.col("h") * F.col("m") - F.col("c") * F.col("c") > float(2 * block) ** 2), "big")
        if big.isEmpty():
            break
        rank = F.row_number().over(W.partitionBy("cell", "home").orderBy(F.xxhash64("u", "cell")))
        of = state.join(big, "cell")
        share = F.when(F.col("home"), F.col("h")).otherwise(F.col("m") - F.col("h")) / F.lit(float(SAMPLE))
        sample = of.withColumn("_r", rank).where(F.col("_r") <= SAMPLE).select("cell", "u", "vec", "home", "near", F.greatest(share, F.lit(1.0)).alias("weight"))
        pivots = materialize(sample.groupBy("cell").applyInPandas(lambda rows: _chosen(rows, r), "cell string, pivots array<double>"), "pivots")
        if pivots.isEmpty():
            break
        seen = state.where("home").join(pivots, "cell").select("cell", "vec", "pivots")
        radii = seen.mapInArrow(released(_radii), "cell string, j int, most double").groupBy("cell", "j").agg(F.max("most").alias("most"))
        radii = radii.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "most"))), lambda x: x["most"]).alias("radius"))
        known = materialize(pivots.join(radii, "cell"), "parts")
        moved = state.join(known, "cell").select("u", "vec", "weight", "cell", "home", "pivots", "radius").mapInArrow(released(_parted(r)), _STATE)
        done.append(state.join(known, "cell", "left_anti"))
        state = materialize(moved, "cells")
    for part in done:
        state = state.unionByName(part)
    state = materialize(state, "joined")

    # blocks: cores first, other homes, guests; core blocks are not compared with each other
    kind = F.when(F.col("near"), 0).when(F.col("home"), 1).otherwise(2)
    state = state.withColumn("kind", kind)
    sizes = state.groupBy("cell").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"n{k}") for k in range(3)))
    blocks = [F.ceil(F.col(f"n{k}") / F.lit(float(block))) for k in range(3)]
    lot = F.xxhash64("u")
    within = F.when(F.col("kind") == 0, F.pmod(lot, F.greatest(blocks[0], F.lit(1))))
    within = within.when(F.col("kind") == 1, blocks[0] + F.pmod(lot, F.greatest(blocks[1], F.lit(1))))
    within = within.otherwise(blocks[0] + blocks[1] + F.pmod(lot, F.greatest(blocks[2], F.lit(1))))
    placed = state.join(sizes, "cell").withColumn("k", within.cast("int"))
    homes, cores = (blocks[0] + blocks[1]).cast("int"), blocks[0].cast("int")
    whole = F.sequence(F.lit(0), F.greatest((blocks[0] + blocks[1] + blocks[2]).cast("int") - 1, F.lit(0)))
    others = F.filter(
        F.transform(whole, lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j"))),
        # one side at least is at home, and not both are cores
        lambda p: (p["i"] < homes) & (p["j"] >= cores),
    )
    work = placed.select("cell", "u", "vec", "weight", "home", "k", F.explode(others).alias("_p"))
    side = F.when(F.col("_p.i") == F.col("_p.j"), 2).when(F.col("k") == F.col("_p.i"), 0).otherwise(1)
    work = work.select("cell", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "u", "vec", "weight", "home", side.alias("side"))
    found = materialize(work.groupBy("cell", "i", "j").applyInArrow(_unit_of_work(limit), "u long, n long, v long"), "found")

    core = state.where("near").select("cell", "u", "weight")
    together = core.groupBy("cell").agg(F.sum("weight").alias("all"), F.min("u").alias("v"))
    cored = core.join(together, "cell")
    links = found.where("v is not null").select("u", "v").unionByName(cored.where("u <> v").select("u", "v"))
    counted = found.where("v is null").select("u", "n").unionByName(cored.select("u", (F.col("all") - F.col("weight")).alias("n")))
    counted = counted.groupBy("u").agg(F.sum("n").alias("n"))

    # nodes are ids: a class links its rows by their least id
    least = classes.select("u", "least")
    across = links.join(least, "u").select("v", F.col("least").alias("x")).join(least.withColumnRenamed("u", "v"), "v").select("x", F.col("least").alias("y"))
    inside = there.join(classes.select(*by, "least"), by).where("id <> least").select(F.col("id").alias("x"), F.col("least").alias("y"))
    roots = components(materialize(across.unionByName(inside), "edges"))
    per_class = classes.join(counted, "u", "left").select(*by, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    linked = there.select("id", *by).join(per_class, by).select("id", "n")
    alone = rows.where("same is null").select("id", F.lit(0).cast("long").alias("n"))
    out = linked.unionByName(alone).join(roots.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    component = F.coalesce("root", "id")
    return out.select(id_back(F.col("id")).alias("vec_id"), F.col("n").alias("n_links"), id_back(component).alias("component_id"), (F.col("id") == component).alias("kept"))
