"""Toxicity by non-negative positive-unlabelled learning.

Features are letter runs and their prefixes, hashed, each in two grades: present at all, and
frequent (at least twice, and at least once in ``RARE`` letter runs). The confirmed toxic texts
propose features; those clearly more frequent there than in all text are selected.

The classifier is linear and minimises the non-negative risk with squared loss:
prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)). The prior is the share of toxic rows among all
training labels. Where a step finds the bracket negative it goes against the bracket instead, so
the risk of unlabelled text can't fall below zero. With squared loss each of the three risks
depends on its texts only by their first and second moments. So the unlabelled side is all text:
tasks sum moments of the few selected features, and numpy trains on the sums, exactly.

The cut is where the F1 that prior, recall and the share of all texts over it imply is largest,
from histograms of scores of all texts and of the confirmed toxic ones; score 0.5 lies there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, in_fold, map_arrow, materialize, sampled
from .quality import held_out
from .texthash import NO_LETTER, Chunk, chunks, distinct, mix, spans_of_bytes

#: The fit takes about so many confirmed toxic rows at most, those with small hashes of their
#: ids. Unlabelled text has no limit.
MAX_TOXIC = 4_000
BITS = 22
PREFIXES = (4, 5, 6, 7, 8, 9)
RARE = 128
#: The size of the model: the features that differ most surely.
SELECTED = 512
STEPS = 600
RATE = 0.05
DECAY = 1e-3
#: Raw scores are counted in so many steps between -2 and 2.
LEVELS = 4096
SHARPNESS = 8.0


@dataclass
class ToxicityModel:
    bins: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    cut: float = 0.0

    def raw(self, members: list[np.ndarray]) -> np.ndarray:
        """The linear score of rows that have the features of these numbers."""
        return np.array([self.weights[m].sum() for m in members]) + self.bias

    def score(self, members: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(SHARPNESS * (self.raw(members) - self.cut), -30, 30)))


def _grade() -> np.ndarray:
    """The bin of each bin's second grade."""
    return (mix(np.arange(1 << BITS, dtype=np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _mask(known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Which bins are known, and which are needed to find those in either grade."""
    if known is None:
        return None
    mask = np.zeros(1 << BITS, dtype=bool)
    mask[known] = True
    return mask, mask | mask[_grade()]


def features(chunk: Chunk, grade: np.ndarray, mask: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) of every distinct feature (of those in ``mask``), by document and bin."""
    data, owner = chunk.data, chunk.owner()
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    length = chunk.ends - chunk.starts
    shift = np.uint64(64 - BITS)
    docs, bins = [owner], [spans_of_bytes(low, chunk.starts, chunk.ends) >> shift]
    stops = []
    for size in PREFIXES:
        has = np.flatnonzero(length > size)
        stops.append((has, chunk.starts[has] + size))
    which = np.concatenate([w for w, _ in stops])
    hashed = spans_of_bytes(low, chunk.starts[which], np.concatenate([s for _, s in stops]))
    sizes = np.repeat(np.array(PREFIXES, dtype=np.uint64), [len(w) for w, _ in stops])
    docs.append(owner[which])
    bins.append(mix(hashed + sizes) >> shift)
    doc, value = np.concatenate(docs), np.concatenate(bins).astype(np.int64)
    if mask is not None:
        needed = mask[1][value]
        doc, value = doc[needed], value[needed]
    pair = np.sort((doc << BITS) | value)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    present, count = pair[first], np.diff(np.append(first, len(pair)))
    often = present[(count >= 2) & (RARE * count >= chunk.word_counts()[present >> BITS])]
    graded = (often >> BITS << BITS) | grade[often & ((1 << BITS) - 1)]
    pair = distinct(np.concatenate([present, graded]))
    doc, value = pair >> BITS, pair & ((1 << BITS) - 1)
    return (doc, value) if mask is None else (doc[mask[0][value]], value[mask[0][value]])


def _counted(known: np.ndarray | None):
    """(bin, n): how many texts of a batch have each bin, of those that are ``known``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        grade, mask = _grade(), _mask(known)
        total = np.zeros(1 << BITS, dtype=np.int64)
        for _, _, chunk in chunks(batch.column("text"), separator=NO_LETTER):
            total += np.bincount(features(chunk, grade, mask)[1], minlength=1 << BITS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bin", "n"])

    return run


def document_frequencies(texts: DataFrame, known: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins that at least ``least`` of ``texts`` (text) have, and their numbers, by bin."""
    counts = map_arrow(texts.select("text"), _counted(known), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy("bin").toArrow()
    return rows.column("bin").to_numpy(), rows.column("n").to_numpy()


def selected(bins: np.ndarray, in_toxic: np.ndarray, in_all: np.ndarray, n: int, m: int) -> np.ndarray:
    """Bins of a clearly higher document frequency in ``n`` toxic texts than in all ``m``."""
    p, q = (in_toxic + 0.5) / (n + 1), (in_all + 0.5) / (m + 1)
    z = (p - q) / np.sqrt(q * (1 - np.minimum(q, 0.999)) / n)
    good = np.flatnonzero((z >= 4) & (p >= 2 * q))
    return np.sort(bins[good[np.argsort(-z[good], kind="stable")][:SELECTED]])


def _described(bins: np.ndarray):
    """(k, members): for each row the numbers of its selected features, as two-byte integers."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        grade, mask = _grade(), _mask(bins)
        for lo, hi, chunk in chunks(batch.column("text"), separator=NO_LETTER):
            doc, value = features(chunk, grade, mask)
            number = np.searchsorted(bins, value).astype("<u2")
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            rows = [number[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), pa.array(rows, pa.binary())], ["k", "members"])

    return run


def _members(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def moments(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of ``rows`` (members) and how many have both features i and j: a matrix whose
    size is the model's. Tasks sum pairs, so what moves doesn't grow with the rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for m in _members(batch.column("members")):
            if len(m):
                np.add.at(total, (m.astype(np.int64)[:, None] * size + m).ravel(), 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["pair", "n"])

    found = map_arrow(rows.select("members"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return rows.count(), out.reshape(size, size)


def _quadratic(n: int, pairs: np.ndarray) -> np.ndarray:
    """The mean outer product of rows with a constant 1 as the last feature."""
    size = len(pairs)
    out = np.empty((size + 1, size + 1))
    out[:size, :size] = pairs / n
    out[:size, size] = out[size, :size] = np.diag(pairs) / n
    out[size, size] = 1.0
    return out


def risks(w: np.ndarray, toxic: np.ndarray, every: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R_P(+), R_U(-) - prior * R_P(-)) with squared loss (1 -+ score)**2 / 4, from the
    mean outer products of toxic and of all rows."""
    positive = prior * (1 - 2 * w @ toxic[-1] + w @ toxic @ w) / 4
    negative = lambda s: (1 + 2 * w @ s[-1] + w @ s @ w) / 4
    return positive, negative(every) - prior * negative(toxic)


def train(toxic: np.ndarray, every: np.ndarray, prior: float) -> np.ndarray:
    """Adam on the non-negative risk; the last weight is the constant's."""
    w = np.zeros(len(toxic))
    w[-1] = 2 * prior - 1
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        up = prior * (toxic @ w - toxic[-1]) / 2
        bracket = (every @ w + every[-1]) / 2 - prior * (toxic @ w + toxic[-1]) / 2
        slope = up + bracket if risks(w, toxic, every, prior)[1] >= 0 else -bracket
        slope[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        rate = RATE * (1 - step / (STEPS + 1))
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def _histogram(rows: DataFrame, model: ToxicityModel) -> np.ndarray:
    """How many of ``rows`` (members) have a raw score in each of LEVELS steps."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        level = np.clip((model.raw(_members(batch.column("members"))) + 2) / 4 * LEVELS, 0, LEVELS - 1).astype(np.int64)
        there, n = np.unique(level, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n)], ["level", "n"])

    found = map_arrow(rows.select("members"), run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LEVELS)
    out[found.column("level").to_numpy()] = found.column("n").to_numpy()
    return out


def best_cut(toxic: np.ndarray, every: np.ndarray, prior: float) -> float:
    """The raw score between two steps of the histograms where the implied F1 is largest; of
    equal ones the middle."""
    recall = toxic[::-1].cumsum()[::-1] / toxic.sum()
    share = every[::-1].cumsum()[::-1] / every.sum()
    # a cut that calls everything toxic is none
    gain = np.where(share < 1, recall / (prior + share), -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / LEVELS * 4 - 2)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[ToxicityModel, DataFrame] | None:
    """The model, learnt outside fold 0, and (k, members) of all rows; None if there is no
    confirmed toxic text, or no feature tells it apart."""
    base = docs.select(id_key().alias("k"), F.col("text").cast("string").alias("text"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (in_fold() != 0))
    known = known.groupBy(id_key().alias("k")).agg(F.max("toxic").alias("toxic"))
    n, ones = known.agg(F.count("*"), F.sum("toxic")).first()
    if not ones:
        return None
    # bounded by MAX_TOXIC
    confirmed = F.broadcast(materialize(sampled(known.where("toxic = 1").select("k"), MAX_TOXIC), "toxic"))
    toxic = materialize(base.join(confirmed, "k", "left_semi"), "toxic_texts")
    n_toxic, n_all = toxic.count(), base.count()
    if not n_toxic:
        return None
    bins, in_toxic = document_frequencies(toxic, None, max(2, min(8, n_toxic // 20)))
    there, found = document_frequencies(base, bins, 1)
    in_all = np.zeros(len(bins))
    in_all[np.searchsorted(bins, there)] = found
    chosen = selected(bins, in_toxic, in_all, n_toxic, n_all)
    if not len(chosen):
        return None
    prior = float(np.clip(ones / n, 0.001, 0.9))
    rows = materialize(map_arrow(base, _described(chosen), "k long, members binary"), "members")
    positive = rows.join(confirmed, "k", "left_semi")
    weights = train(_quadratic(*moments(positive, len(chosen))), _quadratic(*moments(rows, len(chosen))), prior)
    model = ToxicityModel(chosen, weights[:-1], float(weights[-1]))
    model.cut = best_cut(_histogram(positive, model), _histogram(rows, model), prior)
    return model, rows


def _scored(model: ToxicityModel):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(model.score(_members(batch.column("members"))))], ["k", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (score >= 0.5).

    ``labels`` (doc_id, toxic): null labels are ignored, of repeated ones the largest counts.
    Null or empty text: the score of a text without features. Very long texts are read whole.
    Without toxic training labels, or without a feature that tells them apart, every score is 0.
    Null doc_id: held out, as the empty string would be. Ties and repeated rows: equal scores.
    Empty table: empty result. Other columns of either table are ignored."""
    found = fit(docs, labels)
    if found is None:
        scored = docs.select(id_key().alias("k"), F.lit(0.0).alias("score"))
    else:
        model, rows = found
        scored = map_arrow(rows, _scored(model), "k long, score double")
    return scored.select(
        id_back(F.col("k")).alias("doc_id"),
        held_out(F.col("k")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
