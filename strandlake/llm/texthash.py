"""Word splitting and hashing over the raw UTF-8 bytes of an Arrow string column.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; all of these separators are
ASCII, so cutting bytes cuts exactly where cutting code points would. Everything works on a
*chunk*: the concatenated bytes of some whole documents plus their offsets. Chunks hold a few
megabytes (or one longer document), so memory does not follow the partition.

A word has two hashes of 64 bits (lanes), and runs of words have hashes built from a lane. All
steps stir in a way that isn't linear, so no pattern of letters or words cancels out. Hashes find
candidates; whatever is decided is confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import remembered

CHUNK_BYTES = 1_000_000

_U = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Odd bases have inverses modulo 2**64; those equal to 5 modulo 8 have the longest period.
_BASES = tuple(int(x) * 8 + 5 for x in _SEED.integers(2**40, 2**60, 4, dtype=np.uint64))

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters and the bytes of other scripts separates letter runs.
NO_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables stay for the task's next chunk."""
    powers = remembered("powers")
    have = powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            powers[base] = have
    return have[:n]


def _ranges(values: np.ndarray, base: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The mixed polynomial hash of values[lo:hi] for each pair, from one prefix sum."""
    n = len(values)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * _power(base, n), out=total[1:])
    inverse = pow(base, -1, 2**64)
    return mix((total[hi] - total[lo]) * _power(inverse, n + 1)[lo])


#: Longer words are digested one by one.
LONG_WORD = 64
#: How many bytes of a block belong to a word.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def _word_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two lanes of 64 bits for each word, as the rows of an array.

    A word's blocks of eight bytes go through a state of 128 bits, whose halves stir each other
    after each block; all words take a step at once."""
    # eight bytes from any position
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    length = ends - starts
    x = mix(length.astype(np.uint64) ^ _U(0x9E3779B97F4A7C15))
    y = mix(x + _U(0xC2B2AE3D27D4EB4F))
    left, at, who = length, starts, slice(None)
    for _ in range(LONG_WORD // 8):
        block = blocks[at] & _MASKS[np.minimum(left, 8)]
        p = mix(x[who] ^ block) + y[who]
        y[who] = mix((y[who] ^ (p >> _U(23))) + block * _U(0xD6E8FEB86659FD93))
        x[who] = p * _U(0xA0761D6478BD642F) ^ y[who]
        more = left > 8
        if not more.any():
            break
        who = np.flatnonzero(more) if isinstance(who, slice) else who[more]
        left, at = left[more] - 8, at[more] + 8
    lanes = np.stack([mix(x + (y ^ (y >> _U(31))) * _U(0x9FB21C651E98DF25)), mix(y + (x ^ (x >> _U(33))) * _U(0xE7037ED1A0B428DB))])
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        lanes[:, i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")
    return lanes


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, ascending; by sorting, which is faster here than a hash table."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


class Chunk:
    """Whole documents: ``data`` bytes, ``offsets`` of documents, and their words by index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        else:
            gap = separator[data]
            before = np.empty(n, dtype=bool)
            before[0] = True
            before[1:] = gap[:-1]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = True
            after = np.empty(n, dtype=bool)
            after[-1] = True
            after[:-1] = gap[1:]
            after[inner - 1] = True
            solid = ~gap
            self.starts = np.flatnonzero(solid & before)
            self.ends = np.flatnonzero(solid & after) + 1
        #: words of document i are first[i] .. first[i + 1] - 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_counts(self) -> np.ndarray:
        return np.diff(self.first)

    def digests(self, lower: bool = False) -> np.ndarray:
        """Two lanes of 64 bits for each word, as the rows of an array; with ``lower``, of the
        words with a-z for A-Z."""
        data = np.frombuffer(self.data.tobytes().lower(), np.uint8) if lower else self.data
        return _word_lanes(data, self.starts, self.ends)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, parted by one space each, and where each begins (and one more, the end).
        bytes.split cuts at the six separators."""
        body = self.data.tobytes()
        offsets = self.offsets.tolist()
        parts = (b" ".join(body[a:b].split()) for a, b in zip(offsets[:-1], offsets[1:]))
        return b" ".join([p for p in parts if p]), np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])

    def owner(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self)), self.word_counts())


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _U(0x9E3779B97F4A7C15) + (right ^ (right >> _U(29))))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len - k + 1 runs of k words, put together from runs of powers of two."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    size, part, out, done = 1, hashes, None, 0
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - done)
                out = _joined(out[:n], part[done : done + n])
            done += size
        if done == k:
            return mix(out[: len(hashes) - k + 1] ^ _U(k))
        part = _joined(part[:-size], part[size:])
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[:-rest], out[rest:])
    return out


def chunks(column: pa.Array, size: int = CHUNK_BYTES, separator: np.ndarray = SEPARATOR) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, row after the last, chunk) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, rows)
        yield lo, hi, Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separator)
        lo = hi


def spans_of_bytes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of bytes lo .. hi - 1, for each pair."""
    return _ranges(_BYTE[data], _BASES[0], lo, hi)
