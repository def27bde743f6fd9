"""Numpy kernels for one sequence each, and the Arrow pass that applies them to many."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import ship

_UPPER = bytes.maketrans(string.ascii_lowercase.encode(), string.ascii_uppercase.encode())
_NO_BASE = bytes(b for b in range(256) if b not in b"ACGTacgt")
#: Rows that leave a pass together.
OUT = 20_000

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def bases_of(text: bytes) -> bytes:
    """The A, C, G, T of a text, upper-cased."""
    return text.translate(_UPPER, _NO_BASE)


def code_points(text: bytes) -> np.ndarray:
    """The symbols of a UTF-8 text as numbers."""
    if text.isascii():
        return np.frombuffer(text, np.uint8)
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


def window_gc(bases: bytes, k: int) -> np.ndarray:
    """G and C in each window of k bases."""
    symbols = np.frombuffer(bases, np.uint8)
    total = np.concatenate([[0], np.cumsum((symbols == 71) | (symbols == 67))])
    return total[k:] - total[:-k] if len(symbols) >= k else np.zeros(0, np.int64)


def binned(values: np.ndarray, at: int, per_bin: int) -> tuple[np.ndarray, ...]:
    """(bin, sum, min, max, count) of values whose first has the place ``at``."""
    if not len(values):
        return (values,) * 5
    first = (-at) % per_bin
    cuts = np.arange(first, len(values), per_bin)
    if first:
        cuts = np.concatenate([[0], cuts])
    bins = (at + cuts) // per_bin
    return bins, np.add.reduceat(values, cuts), np.minimum.reduceat(values, cuts), np.maximum.reduceat(values, cuts), np.diff(np.append(cuts, len(values)))


def starts_and_stops(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an AUG, and whether a UAA, UAG or UGA, begins at each place."""
    x, y, z = symbols[:-2], symbols[1:-1], symbols[2:]
    u = x == 85
    return (x == 65) & (y == 85) & (z == 71), u & (((y == 65) & ((z == 65) | (z == 71))) | ((y == 71) & (z == 65)))


def reading_frames(symbols: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(frame, start, end, terminated) of the reading frames, by frame, then start. In a frame the
    first start of each run between stops opens one."""
    n = len(symbols)
    if n < 3:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    is_start, is_stop = starts_and_stops(symbols)
    found = []
    for frame in range(3):
        start, stop = np.flatnonzero(is_start[frame::3]), np.flatnonzero(is_stop[frame::3])
        island = np.searchsorted(stop, start)
        opens = np.ones(len(start), dtype=bool)
        opens[1:] = island[1:] != island[:-1]
        start, island = frame + 3 * start[opens], island[opens]
        ended = island < len(stop)
        end = np.full(len(start), frame + 3 * ((n - frame) // 3))
        end[ended] = frame + 3 * stop[island[ended]]
        long_ = np.where(ended, end - start, n - start) >= min_len
        found.append((np.full(long_.sum(), frame), start[long_], end[long_], ended[long_]))
    return tuple(np.concatenate(x) for x in zip(*found))


def codons_at(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each codon as one number."""
    wide = symbols.astype(np.int64)
    return (wide[places] << 42) | (wide[places + 1] << 21) | wide[places + 2]


def codon_text(number: int) -> str:
    return "".join(chr((number >> shift) & 0x1FFFFF) for shift in (42, 21, 0))


def counted_codons(symbols: np.ndarray, frame: np.ndarray, start: np.ndarray, end: np.ndarray, low: int = 0, high: int | None = None, at: int = 0) -> tuple[np.ndarray, ...]:
    """(codon, n, frame, start, i): the codons of reading frames that begin in low .. high - 1, and
    for each the reading frame and the place in it where it comes first. ``symbols`` begin at ``at``."""
    high = at + len(symbols) if high is None else high
    begin = np.maximum(start, low + (start - low) % 3)
    stop = np.minimum(end, high)
    sizes = np.maximum(-(-(stop - begin) // 3), 0)
    of = np.repeat(np.arange(len(start)), sizes)
    step = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = begin[of] + 3 * step
    codons, first, counts = np.unique(codons_at(symbols, places - at), return_index=True, return_counts=True)
    owner = of[first]
    return codons, counts, frame[owner], start[owner], (places[first] - start[owner]) // 3


#: Products of lengths up to which all pairs of symbols are compared, which is less work then.
_SMALL = 4096


def matches_by_shift(short: np.ndarray, long_: np.ndarray) -> np.ndarray:
    """For each shift from 1 - len(short) to len(long_) - 1, at how many places of ``short`` the
    symbol equals that of ``long_`` at the place plus the shift.

    One correlation per symbol, by Fourier transforms of the places that have it: n log n, and
    exact, as the numbers are integers and far larger than the rounding."""
    m, n = len(short), len(long_)
    if m * n <= _SMALL:
        i, j = np.nonzero(short[:, None] == long_[None, :])
        return np.bincount(j - i + m - 1, minlength=m + n - 1)
    size = 1 << (m + n - 2).bit_length()
    total = np.zeros(m + n - 1)
    for symbol in np.intersect1d(short, long_):
        one, other = (np.fft.rfft(x == symbol, size) for x in (short[::-1], long_))
        total += np.rint(np.fft.irfft(one * other, size)[: m + n - 1])
    return total.astype(np.int64)


def apply(rows: DataFrame, column: str, keep: tuple[str, ...], schema: str, kernel: Callable[..., tuple | None], extra: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, *schema): the rows that ``kernel`` makes of the text in ``column``, given as bytes,
    and the values of ``extra``. A kernel returns one array per field, or None."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {name: kind for name, kind in rows.dtypes}
    names = [*keep, *(f[0] for f in fields)]
    if len(set(names)) < len(names):
        raise ValueError(f"a column that is kept has the name of one that is made: {names}")
    types = [_ARROW[kind.replace("long", "bigint")] for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            parts: list[tuple] = []
            size = 0

            def made() -> pa.RecordBatch:
                row = pa.array(np.repeat(owners, [len(p[0]) for p in parts]), pa.int64())
                columns = []
                for i, kind in enumerate(types):
                    values = [p[i] for p in parts]
                    flat = [v for x in values for v in x] if kind == pa.string() else np.concatenate(values)
                    columns.append(pa.array(flat, kind))
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keep), *columns], names)

            texts = batch.column(column).cast(pa.binary()).to_pylist()
            others = [batch.column(c).to_pylist() for c in extra]
            for i, text in enumerate(texts):
                found = kernel(text or b"", *(o[i] for o in others))
                if found is not None and len(found[0]):
                    owners.append(i)
                    parts.append(found)
                    size += len(found[0])
                    if size >= OUT:
                        yield made()
                        owners.clear()
                        parts.clear()
                        size = 0
            if parts:
                yield made()

    ship(rows.sparkSession)
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{n} {k}" for n, k in fields)])
    return rows.select(*dict.fromkeys([*keep, column, *extra])).mapInArrow(run, out)
