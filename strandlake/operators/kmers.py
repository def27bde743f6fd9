"""k-mer counts over all possible k-mers, and k-mers in order of discovery.

``kmer_counts`` and ``kmer_presence`` take any symbols: texts count their own k-mers in one numpy
pass. k-mers of bases are counted as numbers: a task counts those of many texts together and deals
them to ``BUCKETS`` by a hash, and what is shuffled is a row per such count and bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..sources.shared import fixed, ship
from . import arrays

#: Up to here a table of all k-mers is made; of longer ones only those that occur are listed.
MAX_DOMAIN = 12


def domain(spark: SparkSession, k: int) -> DataFrame:
    """(kmer): all 4**k in lexicographic order, from the digits of a range."""
    if not 1 <= k <= 31:
        raise ValueError("k must be between 1 and 31, as the k-mers are numbered in 64 bits")
    digits = F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0")
    return spark.range(4**k).select(F.translate(digits, "0123", S.BASES).alias("kmer"))


def counted(text: bytes, k: int) -> tuple:
    """(kmers, n, first place) of the distinct k-mers of a text, as it is written."""
    if len(text) < k:
        return (np.zeros(0, np.int64),) * 3
    places, n = _distinct(arrays.code_points(text), k)
    symbols = text.decode()
    return [symbols[i : i + k] for i in places.tolist()], n, places


def _distinct(symbols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of distinct k-mers. Symbols are numbered by the few that occur, and
    runs of them by pairs of shorter runs where the numbers would grow beyond 64 bits."""
    many = len(symbols) - k + 1
    if many < 1:
        return (np.zeros(0, np.int64),) * 2
    letters, code = np.unique(symbols, return_inverse=True)
    run, width = code.astype(np.int64), len(letters)
    for i in range(1, k):
        if width > (1 << 62) // len(letters):
            values, run = np.unique(run, return_inverse=True)
            width = len(values)
        run = run[: len(symbols) - i] * len(letters) + code[i:]
        width *= len(letters)
    _, first, n = np.unique(run, return_index=True, return_counts=True)
    return first, n


def kmer_counts(sequences: DataFrame, k: int, column: str = "seq") -> DataFrame:
    """(kmer, n): overlapping k-mers inside the sequences, as they are written."""

    def kernel(text: bytes) -> tuple:
        return counted(text, k)[:2]

    return arrays.apply(sequences.select(column), column, (), "kmer string, n long", kernel).groupBy("kmer").agg(F.sum("n").alias("n"))


#: Parts that the k-mers of bases are dealt to by a hash; a task holds one part at a time.
BUCKETS = 4096
#: Windows that a task counts together before they are shuffled.
WINDOWS = 2_000_000
#: Bases that are written in one number.
WORD = 31

_NUMBER = np.full(256, 4, np.uint8)
_NUMBER[[65, 67, 71, 84]] = range(4)
_LETTER = np.frombuffer(S.BASES.encode(), np.uint8)


def base_windows(texts: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """The k-mers of A, C, G, T inside each text as columns of numbers of up to ``WORD`` bases, and
    how many windows hold another symbol."""
    symbols = np.concatenate([part for t in texts for part in (arrays.code_points(t).astype(np.uint32), _END)])
    count = len(symbols) - k + 1
    words = [min(WORD, k - at) for at in range(0, k, WORD)]
    if count < 1:
        return np.zeros((len(words), 0), np.int64), 0
    letters = np.where(symbols < 256, _NUMBER[symbols & 255], 4).astype(np.int64)
    ends, odd = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (symbols == _END[0], letters == 4))
    within = ends[k:] == ends[:-k]
    pure = odd[k:] == odd[:-k]
    out = np.stack([_grams(letters, width)[w * WORD :][:count][pure] for w, width in enumerate(words)])
    return out, int(within.sum() - pure.sum())


def _grams(letters: np.ndarray, width: int) -> np.ndarray:
    """The number that ``width`` letters make from each place on, of the numbers of their halves."""
    if width == 1:
        return letters
    half = _grams(letters, width // 2)
    two = (half[: -(width // 2)] << (2 * (width // 2))) | half[width // 2 :]
    return (two[:-1] << 2) | letters[width - 1 :] if width % 2 else two


#: After each text; no symbol has this number.
_END = np.array([0xFFFFFFFF], np.uint32)


def _added(words: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in order, and the sum of ``n`` (1 each if not given) over their repeats."""
    order = np.argsort(words[0]) if len(words) == 1 else np.lexsort(words[::-1])
    words = words[:, order]
    first = np.flatnonzero(np.concatenate([[True], (words[:, 1:] != words[:, :-1]).any(axis=0)])) if words.shape[1] else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, words.shape[1])) if n is None else np.add.reduceat(n[order], first) if len(first) else first
    return words[:, first], sums


def _dealt(words: np.ndarray, other: int) -> Iterator[pa.RecordBatch]:
    """(bucket, kmers, n): the distinct k-mers of some windows and their counts, as the bytes of
    64-bit numbers. The bucket -1 counts windows with other symbols."""
    words, n = _added(words)
    mixed = np.zeros(words.shape[1], np.uint64)
    for word in words.view(np.uint64):
        mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    bucket = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    words, n, bucket = words[:, order], n[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]))
    buckets, kmers, sums = bucket[cuts].tolist(), [words[:, a:b].tobytes() for a, b in spans], [n[a:b].tobytes() for a, b in spans]
    if other:
        buckets, kmers, sums = [*buckets, -1], [*kmers, b""], [*sums, np.array([other], np.int64).tobytes()]
    for lo in range(0, len(buckets), 1024):
        hi = lo + 1024
        yield pa.RecordBatch.from_arrays([pa.array(buckets[lo:hi], pa.int32()), pa.array(kmers[lo:hi], pa.binary()), pa.array(sums[lo:hi], pa.binary())], _DEALT)


_DEALT = ["bucket", "kmers", "n"]


def _pieces(text: bytes, k: int, size: int) -> Iterator[bytes]:
    """A text in pieces of ``size`` windows, each of whose windows is in one piece."""
    if len(text) < size + k:
        yield text
        return
    symbols = text.decode()
    for at in range(0, max(1, len(symbols) - k + 1), size):
        yield symbols[at : at + size + k - 1].encode()


def _written(words: np.ndarray, k: int) -> pa.Array:
    """The texts of k-mers."""
    count = words.shape[1]
    text = np.empty((count, k), np.uint8)
    for i in range(k):
        w, at = divmod(i, WORD)
        width = min(WORD, k - w * WORD)
        text[:, i] = _LETTER[(words[w] >> (2 * (width - 1 - at))) & 3]
    return pa.StringArray.from_buffers(count, pa.py_buffer((np.arange(count + 1) * k).astype(np.int32)), pa.py_buffer(text))


def base_kmer_counts(sequences: DataFrame, k: int, column: str = "seq", clean: bool = False, windows: int = WINDOWS) -> DataFrame:
    """(kmer, n): the k-mers of A, C, G, T inside the sequences; a row with a null kmer counts the
    windows with another symbol, if there are any. ``clean`` takes a sequence's bases only, upper-cased.

    Counts of ``windows`` windows are added up by bucket, so neither a frequent k-mer nor a long
    sequence is more work for one task, and a task holds the windows of one count or one bucket."""
    if k < 1:
        raise ValueError("k must be positive")
    many, part = -(-k // WORD), max(1, windows // 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        parts: list[np.ndarray] = []
        size = held = other = 0

        def taken() -> None:
            nonlocal size, held, other
            found, rest = base_windows(texts, k)
            parts.append(found)
            other += rest
            held += found.shape[1]
            size = 0
            texts.clear()

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                text = value.as_py() or b""
                for piece in _pieces(arrays.bases_of(text) if clean else text, k, part):
                    texts.append(piece)
                    size += len(piece)
                    if size >= part:
                        taken()
                        if held >= windows:
                            yield from _dealt(np.concatenate(parts, axis=1), other)
                            parts.clear()
                            held = other = 0
        if texts:
            taken()
        if held or other:
            yield from _dealt(np.concatenate(parts, axis=1), other)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        at = None

        def made() -> Iterator[pa.RecordBatch]:
            n = np.concatenate(sums)
            if at == -1:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n.sum()], pa.int64())], ["kmer", "n"])
                return
            words, n = _added(np.concatenate(kmers, axis=1), n)
            for lo in range(0, len(n), arrays.OUT):
                yield pa.RecordBatch.from_arrays([_written(words[:, lo : lo + arrays.OUT], k), pa.array(n[lo : lo + arrays.OUT], pa.int64())], ["kmer", "n"])

        for batch in batches:
            for bucket, kmer, n in zip(*(batch.column(c).to_pylist() for c in _DEALT)):
                if bucket != at and sums:
                    yield from made()
                    kmers.clear()
                    sums.clear()
                at = bucket
                kmers.append(np.frombuffer(kmer, np.int64).reshape(many, -1))
                sums.append(np.frombuffer(n, np.int64))
        if sums:
            yield from made()

    ship(sequences.sparkSession)
    counts = sequences.select(column).mapInArrow(count, "bucket int, kmers binary, n binary")
    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "kmer string, n long")


def kmer_frequencies(sequences: DataFrame, k: int, column: str = "seq", clean: bool = False) -> DataFrame:
    """(kmer, n, total, freq): every k-mer over A, C, G, T, with zeros for absent ones; above
    ``MAX_DOMAIN`` only those that occur. ``clean`` takes a sequence's bases only, upper-cased.

    total is the number of windows of any content; sequences shorter than k have none."""
    every = fixed(base_kmer_counts(sequences, k, column, clean))  # read for the total too
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    counts = every.where("kmer is not null")
    if k <= MAX_DOMAIN:
        # the domain has a fixed size
        counts = domain(sequences.sparkSession, k).join(counts, "kmer", "left")
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.select("kmer", F.coalesce("n", F.lit(0)).alias("n"), "total").withColumn("freq", S.relative(F.col("n"), F.col("total")))


#: Length of the minimizers that deal long k-mers to tasks.
MINIMIZER = 9


def runs_of_kmers(text: bytes, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, begin, end) of the longest runs of windows of ``k`` bases with one minimizer, the
    m-mer whose mixed number is the least."""
    letters = np.frombuffer(text.translate(_TWO_BITS), np.uint8).astype(np.uint64)
    n = len(letters) - k + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    gram = np.zeros(len(letters) - m + 1, np.uint64)
    for i in range(m):
        gram = (gram << np.uint64(2)) | letters[i : i + len(gram)]
    # runs of one base would attract most windows if the plain numbers were compared
    mixed = (gram * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
    least = np.lib.stride_tricks.sliding_window_view(mixed, k - m + 1).min(axis=1)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(begin[1:], n) + k - 1
    return least[begin].view(np.int64), begin, end


_TWO_BITS = bytes({65: 0, 67: 1, 71: 2, 84: 3}.get(b, 0) for b in range(256))


def long_kmer_counts(sequences: DataFrame, k: int, m: int = MINIMIZER, column: str = "seq") -> DataFrame:
    """(kmer, n): as ``kmer_counts`` of the bases in the sequences, for large k.

    Neighbouring k-mers mostly have the same minimizer, so runs of them are sent as one text, some
    times k bytes less than one by one. All occurrences of a k-mer have its minimizer, so each
    is counted where its run arrives, and equal runs once. Runs of one minimizer meet in one task,
    which then holds their k-mers; ``base_kmer_counts`` has no such part that grows."""
    if not 0 < m <= min(k, 31):
        raise ValueError("minimizers are shorter than k-mers")

    def kernel(text: bytes) -> tuple:
        bases = arrays.bases_of(text)
        minimizer, begin, end = runs_of_kmers(bases, k, m)
        symbols = bases.decode()
        return minimizer, [symbols[a:b] for a, b in zip(begin.tolist(), end.tolist())]

    runs = arrays.apply(sequences.select(column), column, (), "minimizer long, run string", kernel)
    equal = runs.repartition("minimizer").groupBy("minimizer", "run").agg(F.count("*").alias("times"))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substr("run", i, F.lit(k)))).alias("kmer")
    # grouped by minimizer too, which the rows are dealt by already
    return equal.select("minimizer", "times", each).groupBy("minimizer", "kmer").agg(F.sum("times").alias("n")).select("kmer", "n")


def kmer_presence(sequences: DataFrame, k: int, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, kmer, n, first_pos): distinct k-mers of each sequence; by first_pos they are in
    order of discovery. Rows that repeat a seq_id are sequences of their own."""
    rows = sequences.select(F.col(keep).alias("seq_id"), F.col(column).alias("seq"))
    return arrays.apply(rows, "seq", ("seq_id",), "kmer string, n long, first_pos long", lambda text: counted(text, k))


def distinct_kmers(sequences: DataFrame, k: int, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, n_distinct) for every sequence, 0 where it is shorter than k."""
    rows = sequences.select(F.col(keep).alias("seq_id"), F.col(column).alias("seq"))
    return arrays.apply(rows, "seq", ("seq_id",), "n_distinct long", lambda text: (np.array([len(_distinct(arrays.code_points(text), k)[0])]),))
