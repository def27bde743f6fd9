"""Statistics of a document's form: sizes, shares of byte classes, repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .texthash import Chunk, chunks, grams

#: Byte classes: lower case, upper case, other scripts, digits, blanks, line ends, then signs.
_SIGNS = "*%$#&|!.,@<>{}=/"
_CLASSES = 7 + len(_SIGNS)
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
for _i, _sign in enumerate(_SIGNS):
    _CLASS[ord(_sign)] = 7 + _i

STATS = 7 + _CLASSES + 6


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(owner: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Of each document's values, how many occurred earlier in it."""
    if not len(value):
        return np.zeros(rows)
    order = np.lexsort((value, owner))
    same = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return np.bincount(owner[order[1:]][same], minlength=rows)


def statistics(chunk: Chunk) -> np.ndarray:
    """A row of STATS numbers for each document; zeros for an empty one."""
    rows = len(chunk)
    sizes = np.diff(chunk.offsets)
    doc = np.repeat(np.arange(rows, dtype=np.int64), sizes)
    kinds = np.bincount(doc * _CLASSES + _CLASS[chunk.data], minlength=rows * _CLASSES).reshape(rows, _CLASSES)
    hashes, owner = chunk.digests(lower=True)[0], chunk.owner()
    n = chunk.word_counts()
    length = chunk.ends - chunk.starts
    sums = np.bincount(owner, weights=length, minlength=rows)
    squares = np.bincount(owner, weights=length.astype(float) ** 2, minlength=rows)
    mean = _share(sums, n)
    deviation = np.sqrt(np.maximum(_share(squares, n) - mean**2, 0))
    short = np.bincount(owner[length <= 3], minlength=rows)
    long_ = np.bincount(owner[length >= 15], minlength=rows)
    first, last = chunk.data[chunk.starts], chunk.data[chunk.ends - 1]
    odd_last = np.bincount(owner[(_CLASS[last] >= 6)], minlength=rows)
    capital = np.bincount(owner[_CLASS[first] == 1], minlength=rows)
    # lines by their words: a line's identity is the hash of its words
    threes = grams(hashes, 3)
    inside = np.flatnonzero(owner[: len(threes)] == owner[2:]) if len(threes) else np.zeros(0, np.int64)
    again = _repeats(owner[inside], threes[inside], rows)
    out = np.column_stack(
        [
            np.log1p(sizes),
            np.log1p(n),
            np.log1p(kinds[:, 5]),
            mean,
            deviation,
            _share(short, n),
            _share(long_, n),
            kinds / np.maximum(sizes, 1)[:, None],
            _share(odd_last, n),
            _share(capital, n),
            _share(_repeats(owner, hashes, rows), n),
            _share(again, n),
            _share(kinds[:, 1], kinds[:, 0] + kinds[:, 1]),
            _share(kinds[:, 5], n),
        ]
    )
    return out.astype(np.float32)


def stats_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(k, stats as little-endian floats) for each row."""
    for lo, hi, chunk in chunks(batch.column("text")):
        body = np.ascontiguousarray(statistics(chunk))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k").slice(lo, hi - lo), pa.array([r.tobytes() for r in body], pa.binary())], ["k", "stats"]
        )
