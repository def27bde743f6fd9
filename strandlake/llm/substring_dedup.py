"""Exact removal of repeated 20-word passages by compaction of a sparse De Bruijn graph.

The edges of the graph are windows of ``width`` words, its nodes the (width - 1)-word overlaps.
Consecutive edges of a document that share their *anchor* (the smallest hash among the
``anchor``-word grams within the window) form one *super-edge*: an anchor, and a label that
hashes its edges in order. Equal windows have equal anchors, so everything that can decide a
window meets at its anchor:

1. Super-edges are summed per anchor: smallest and largest document, smallest and largest
   label. An anchor of one document only decides nothing and goes.
2. A join brings the rest back to the documents. Where all labels of an anchor agree, the
   path does not branch and stays compacted as one span; where they differ the path branches
   and is expanded into its single edges.
3. Hashes only found these candidates. Each document goes to the coordinates of its spans and
   edges and digests the words that stand there (128-bit BLAKE2 over the words joined by
   spaces); spans of equal words are summed, joined back, and every document but the first has
   to drop its own, by coordinates. A wrong agreement of hashes therefore removes nothing.
4. Dropped coordinates cover words, and what is uncovered is kept. Repeats inside one document
   never leave it; they are compared word by word.

Sums have map-side partials and joins a unique right side, which adaptive execution can split
for a frequent anchor: no group of copies meets in one task. What a document collects is a set
of its own anchors, so it is bounded by its text, however many rows share an identifier. Text is
shuffled once (both uses read the same exchange).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, map_arrow, materialize
from .texthash import Chunk, chunks, grams, mix, sliding_min

WIDTH = 20
ANCHOR = 6


class Edges:
    """The edges (windows) of a chunk's documents and the super-edges they form."""

    def __init__(self, chunk: Chunk, width: int, anchor: int):
        lanes = chunk.digests()
        owner = chunk.owner()
        n = len(owner) - width + 1
        self.at = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
        self.owner, self.width = owner[self.at], width
        # anchors and windows come from different lanes: one confirms the other
        self.anchor = sliding_min(grams(lanes[0], anchor), width - anchor + 1)[self.at] if n > 0 else np.zeros(0, np.uint64)
        self.windows = grams(lanes[1], width)[self.at] if n > 0 else np.zeros(0, np.uint64)
        new = np.ones(len(self.at), dtype=bool)
        if len(self.at):
            new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        #: the first edge of each super-edge, and how many it has
        self.heads = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.heads, len(self.at)))

    def labels(self) -> np.ndarray:
        if not len(self.heads):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.at)) - np.repeat(self.heads, self.sizes)
        return mix(np.add.reduceat(mix(self.windows + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), self.heads))


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Indices of the first row of each distinct combination."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order[new]


def _super_edges(width: int, anchor: int, labels: bool):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, _, chunk in chunks(batch.column("text")):
            edges = Edges(chunk, width, anchor)
            owner, low = edges.owner[edges.heads], edges.anchor[edges.heads]
            if labels:
                label = edges.labels()
                pick = _distinct(owner, low, label)
                more = [pa.array(label[pick].view(np.int64))]
            else:
                pick = _distinct(owner, low)
                more = [batch.column("t").take(pa.array(lo + owner[pick]))]
            k = batch.column("k").take(pa.array(lo + owner[pick]))
            yield pa.RecordBatch.from_arrays([pa.array(low[pick].view(np.int64)), k, *more], ["h", "k", "label" if labels else "t"])

    return run


def _longs(column: pa.Array, row: int) -> np.ndarray:
    """The array of longs in one row of a list column, as unsigned; none for null."""
    values = column[row].values
    return np.zeros(0, np.uint64) if values is None else values.to_numpy(zero_copy_only=False).view(np.uint64)


def _gather(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(document within the chunk, value) of the list column's rows lo .. hi - 1."""
    parts = [_longs(column, i) for i in range(lo, hi)]
    sizes = [len(p) for p in parts]
    return np.repeat(np.arange(hi - lo), sizes), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _member(owner: np.ndarray, value: np.ndarray, of_owner: np.ndarray, of_value: np.ndarray) -> np.ndarray:
    """Whether each (owner, value) is among the (of_owner, of_value) pairs, exactly."""
    if not len(of_value) or not len(value):
        return np.zeros(len(value), dtype=bool)
    order = np.lexsort((of_value, of_owner))
    so, sv = of_owner[order], of_value[order]
    # numbers of distinct values keep the pair in one integer
    values, code = np.unique(sv, return_inverse=True)
    at = np.searchsorted(values, value)
    at[at == len(values)] = 0
    known = values[at] == value
    wanted = so.astype(np.int64) * len(values) + code
    mine = owner.astype(np.int64) * len(values) + at
    return known & np.isin(mine, wanted)


def _spans_of(edges: Edges, whole: np.ndarray, branch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, number of edges) of the spans to confirm, each at its first place in a document:
    the compacted super-edges in ``whole`` and the single edges in ``branch`` (masks)."""
    heads, sizes = edges.heads[whole], edges.sizes[whole]
    pick = _distinct(edges.owner[heads], edges.anchor[heads], sizes)
    singles = np.flatnonzero(branch)
    first = singles[_distinct(edges.owner[singles], edges.windows[singles])]
    return np.concatenate([heads[pick], first]), np.concatenate([sizes[pick], np.ones(len(first), np.int64)])


def _confirmed(width: int, anchor: int):
    """(s1, s2, k, t, at): digests of the words of every candidate span and where it stands."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        whole, branch = batch.column("whole"), batch.column("branch")
        for lo, hi, chunk in chunks(batch.column("text")):
            edges = Edges(chunk, width, anchor)
            compact = _member(edges.owner[edges.heads], edges.anchor[edges.heads], *_gather(whole, lo, hi))
            single = _member(edges.owner, edges.anchor, *_gather(branch, lo, hi))
            edge, size = _spans_of(edges, compact, single)
            body, begins = chunk.joined()
            a, b = begins[edges.at[edge]].tolist(), (begins[edges.at[edge] + size + width - 1] - 1).tolist()
            digests = b"".join([hashlib.blake2b(body[x:y], digest_size=16).digest() for x, y in zip(a, b)])
            two = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
            owner = edges.owner[edge]
            row = pa.array(lo + owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(two[:, 0])),
                    pa.array(np.ascontiguousarray(two[:, 1])),
                    batch.column("k").take(row),
                    batch.column("t").take(row),
                    # the first word within the document, and the number of edges
                    pa.array(((edges.at[edge] - chunk.first[owner]) << 32) | size),
                ],
                ["s1", "s2", "k", "t", "at"],
            )

    return run


def _repeats_inside(chunk: Chunk, at: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Windows (their first words) whose words occur earlier in their own document."""
    if not len(at):
        return at
    windows = grams(chunk.digests()[1], width)[at]
    # most chunks have no repeat at all, which one sort of mixed keys shows
    keys = np.sort(windows ^ mix(owner.astype(np.uint64)))
    if not (keys[1:] == keys[:-1]).any():
        return at[:0]
    order = np.lexsort((windows, owner))  # stable: the first start stays
    same = np.flatnonzero((windows[order[1:]] == windows[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]))
    x, y = at[order[same]], at[order[same + 1]]
    body, begins = chunk.joined()
    words = lambda i: body[begins[i] : begins[i + width] - 1]
    return np.array([j for i, j in zip(x.tolist(), y.tolist()) if words(i) == words(j)], dtype=np.int64)


def _cut(width: int, texts: bool):
    """Apply the decisions: (row columns, n_words, n_removed, kept_sha256[, kept_text])."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        drops = batch.column("drops")
        for lo, hi, chunk in chunks(batch.column("text")):
            owner = chunk.owner()
            n = len(owner)
            at = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :]) if n >= width else np.zeros(0, np.int64)
            inside = _repeats_inside(chunk, at, owner[at], width)
            doc, packed = _gather(drops, lo, hi)
            first = chunk.first[doc] + (packed >> np.uint64(32)).astype(np.int64)
            last = first + (packed & np.uint64(0xFFFFFFFF)).astype(np.int64) + width - 1
            if (last > chunk.first[doc] + chunk.word_counts()[doc]).any():
                raise AssertionError("a decision is about words that its document does not have")
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, np.concatenate([inside, first]), 1)
            np.add.at(cover, np.concatenate([inside + width, last]), -1)
            kept = np.cumsum(cover[:n]) == 0
            removed = np.concatenate([[0], np.cumsum(~kept)])[chunk.first]
            out = _joined(chunk, kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").slice(lo, hi - lo),
                    pa.array(chunk.word_counts().astype(np.int64)),
                    pa.array(np.diff(removed).astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()),
                    *([pa.array([x.tobytes() for x in out], pa.binary()).cast(pa.string())] if texts else []),
                ],
                ["k", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts],
            )

    return run


def _joined(chunk: Chunk, kept: np.ndarray) -> list[np.ndarray]:
    """Each document's kept words, joined by single spaces, as bytes."""
    n = len(chunk.data)
    mark = np.zeros(n + 1, dtype=np.int8)
    np.add.at(mark, chunk.starts[kept], 1)
    np.add.at(mark, chunk.ends[kept], -1)
    take = np.cumsum(mark[:n], dtype=np.int8) > 0
    # after each kept word but a document's last comes one separator byte, made a space
    owner = chunk.owner()[kept]
    ends = chunk.ends[kept]
    follows = ends[:-1][owner[1:] == owner[:-1]]
    data = chunk.data.copy()
    data[follows] = 0x20
    take[follows] = True
    cuts = np.concatenate([[0], np.cumsum(take)])[chunk.offsets]
    body = data[take]
    return [body[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def substring_dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``width`` words over it also starts earlier: in a smaller
    doc_id, or earlier in the same row. With ``texts`` the kept text comes too.

    Null or empty text: no words, nothing removed. Null doc_id: before every other doc_id.
    Ties, that is rows that share a doc_id (null ones too), never remove each other's words;
    each gets its own output row. Fewer than ``width`` words: all kept. Very long texts are
    processed whole, one to a chunk. An empty table gives an empty result. Other columns are
    ignored, whatever their names."""
    text = F.col("text").cast("string")
    ids = docs.select(id_key().alias("k"))
    repeated = materialize(ids.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.lit(True).alias("again")), "repeated")
    # t, half of a digest, splits rows that share an id, so none of their lists meet; it is empty where the id is one row's
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)
    base = docs.select(id_key().alias("k"), text.alias("text")).join(repeated, "k", "left")
    base = base.select("k", F.when(F.col("again"), digest).otherwise(F.lit(bytearray())).alias("t"), "text")
    supers = map_arrow(base.select("k", "text"), _super_edges(width, anchor, True), "h long, k long, label long")
    nodes = (
        supers.groupBy("h")
        .agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("label").alias("a"), F.max("label").alias("b"))
        .where("hi > lo")
        .select("h", (F.col("a") != F.col("b")).alias("branches"))
    )
    mine = map_arrow(base, _super_edges(width, anchor, False), "h long, k long, t binary")
    # equal rows bring equal anchors, which a set holds once
    listed = mine.join(nodes, "h").groupBy("k", "t").agg(
        F.collect_set(F.when(~F.col("branches"), F.col("h"))).alias("whole"), F.collect_set(F.when(F.col("branches"), F.col("h"))).alias("branch")
    )
    decided = materialize(listed, "anchors")
    spans = map_arrow(base.join(decided.hint("merge"), ["k", "t"]), _confirmed(width, anchor), "s1 long, s2 long, k long, t binary, at long")
    first = spans.groupBy("s1", "s2").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("hi > lo").select("s1", "s2", "lo")
    again = spans.join(first, ["s1", "s2"]).where("k > lo").groupBy("k", "t").agg(F.collect_set("at").alias("drops"))
    ready = base.join(again.hint("merge"), ["k", "t"], "left").select("k", "text", "drops")
    schema = "k long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    out = map_arrow(ready, _cut(width, texts), schema)
    return out.select(id_back(F.col("k")).alias("doc_id"), *out.columns[1:])
