"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of a document's form are standardised and mapped to cosine features whose inner
products approximate a Gaussian kernel. Every partition of the labelled rows sums its share of
the normal equations; the driver adds the few matrices and solves them. Scores are calibrated
on rows that the fit has not seen, by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, in_fold, map_arrow, materialize, released, sampled, ship
from .document_stats import STATS, stats_batches

#: The fit takes about this many labelled rows at most, those with small hashes of their ids.
MAX_LABELS = 60_000
FEATURES = 256
WIDTH = 8.0
RIDGE = 1e-2
PARTITIONS = 8
THRESHOLD = 0.3


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: raw scores and the calibrated scores they stand for, both ascending
    raw: np.ndarray
    calibrated: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(_design(stats, self.mean, self.scale) @ self.weights, self.raw, self.calibrated)


def _projection() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(2007)
    return random.normal(size=(STATS, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES)


def _design(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    turn, phase = _projection()
    z = np.clip((stats - mean) / scale, -6, 6)
    # einsum keeps a row's sums independent of the other rows of its batch
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(np.einsum("ij,jk->ik", z, turn) + phase), np.ones(len(z))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, STATS).astype(np.float64)


def _sums(rows: DataFrame, function, size: int) -> np.ndarray:
    """The sum over partitions of a function of (stats, labels), a vector of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += function(_matrix(batch.column("stats")), batch.column("y").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    ship(rows.sparkSession)
    parts = rows.mapInArrow(released(run), "sums binary").toArrow().column("sums").to_pylist()
    return sum((np.frombuffer(p) for p in parts), np.zeros(size))


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw, calibrated), at the mean raw score of each pool.

    Pools are shrunk towards one half by one row, so that scores stay inside (0, 1)."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # rows, sum of labels, sum of raw
    for x, y in zip(raw[order], label[order]):
        pools.append([1.0, float(y), float(x)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    n, ones, total = np.array(pools).T
    return total / n, np.maximum.accumulate((ones + 0.5) / (n + 1))


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Fit on the labelled rows outside fold 0; fold 1 calibrates. None if a class is missing."""
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (in_fold() != 0))
        .groupBy(id_key().alias("k"))
        .agg(F.max("quality").alias("y"), F.first(in_fold()).alias("fold"))
    )
    # bounded by MAX_LABELS, so only the texts that have a label are measured for the fit
    marked = F.broadcast(materialize(sampled(marked, MAX_LABELS), "marked"))
    base = docs.select(id_key().alias("k"), F.col("text").cast("string").alias("text")).join(marked.select("k"), "k", "left_semi")
    measured = map_arrow(base, stats_batches, "k long, stats binary")
    rows = materialize(measured.join(marked, "k").repartition(PARTITIONS, "k"), "labelled")
    found = {r["y"] for r in rows.where("fold > 1").select("y").distinct().collect()}
    if len(found) < 2:
        return None
    fitting = rows.where("fold > 1").select("stats", "y")
    moments = _sums(fitting, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 1 + 2 * STATS)
    n = moments[0]
    mean = moments[1 : 1 + STATS] / n
    scale = np.sqrt(np.maximum(moments[1 + STATS :] / n - mean**2, 0)) + 1e-6
    side = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = _design(x, mean, scale)
        return np.concatenate([(a.T @ a).ravel(), a.T @ y])

    sums = _sums(fitting, normal, side * side + side)
    weights = np.linalg.solve(sums[: side * side].reshape(side, side) + RIDGE * np.eye(side), sums[side * side :])
    held = rows.where("fold = 1").select("stats", "y").toArrow()
    if not held.num_rows:
        held = fitting.toArrow()
    raw = _design(_matrix(held.column("stats")), mean, scale) @ weights
    return QualityModel(mean, scale, weights, *isotonic(raw, held.column("y").to_numpy().astype(float)))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_back(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _scores(model: QualityModel | None, text: pa.Array) -> np.ndarray:
    """The score of each text, null counting as empty."""
    if model is None:
        return np.full(len(text), 0.5)
    keys = pa.array(np.arange(len(text)))
    parts = stats_batches(pa.RecordBatch.from_arrays([keys, text], ["k", "text"]))
    return np.concatenate([model.score(_matrix(p.column("stats"))) for p in parts])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality): null labels are ignored, of repeated ones the largest counts.
    Null text counts as empty; an empty text has the score of its (zero) statistics. Very long
    texts are measured whole. Without labels of both classes every score is 0.5. Null doc_id:
    held out, as the empty string would be. Ties and repeated rows: equal scores. Empty table:
    empty result. Other columns of either table are ignored."""
    model = fit(docs, labels)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(_scores(model, batch.column("text")))], ["k", "score"])

    base = docs.select(id_key().alias("k"), F.col("text").cast("string").alias("text"))
    return map_arrow(base, run, "k long, score double").select(
        id_back(F.col("k")).alias("doc_id"),
        held_out(F.col("k")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns.

    Nulls, empty and long texts, ties and empty tables as in ``classify``; without labels of both
    classes every row stays. Scoring is a map over the rows, so nothing but the labelled rows'
    statistics is shuffled."""
    model = fit(docs, labels)
    # columns go by number, as names may hold any signs
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = plain.columns[[c.lower() for c in docs.columns].index("text")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch if model is None else batch.filter(pa.array(_scores(model, batch.column(text)) >= threshold))

    return map_arrow(plain, run, plain.schema).toDF(*docs.columns)
