"""Packing token pieces under vector limits, by the dot-product heuristic.

Each open sequence has what is left of three limits: tokens, segments and loss-bearing tokens.
The next piece is the one whose demand has the largest dot product with that remainder (both
in units of the limits), among pieces that fit. Once none fits, a piece is cut to fill the
sequence. Pieces of equal demand are alike to the heuristic, so it scores distinct demands only
and places as many of the best one as it stays the best. A partition packs its own documents:
nothing is shuffled, and the pieces held are bounded in number and by ``window`` tokens. What is left at a
partition's end, or is closed by another limit than that of tokens, is cut at powers of two,
which need no padding.

Tokens of whole texts come from a public word tokenizer. Its pieces never cross white space, so
the ids of a text are those of its words, and the words of a task meet in a bounded cache.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_key, released, remembered, ship

#: The id that ends each document.
END = 2
_END = np.array([END], dtype="<u4").tobytes()
CACHE_WORDS = 250_000
#: Words that one call of the tokenizer gets; its own results take far more memory than ids.
LEARNT_AT_ONCE = 4_096
#: Pieces that wait at most, however short they are.
HELD_PIECES = 100_000
GROUP_BYTES = 1_000_000
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("a sequence has room for a token, a segment and a loss-bearing token at least")

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], dtype=np.float64)


class WordIds:
    """Ids of texts by words; two generations of at most CACHE_WORDS words are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self.young) + len(words) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        miss = []
        for word in words.difference(self.young):
            ids = self.old.get(word)
            if ids is None:
                miss.append(word)
            else:
                self.young[word] = ids
        for at in range(0, len(miss), LEARNT_AT_ONCE):
            self._tokenize(miss[at : at + LEARNT_AT_ONCE])

    def _tokenize(self, miss: list[bytes]) -> None:
        simple, parts, other = [], [], []
        for word in miss:
            text = word.decode("utf-8")
            core = text.rstrip(_PUNCTUATION)
            if core.isalpha():
                # letters, or letters and a run of signs: as many parts, each with one word end
                simple.append(text)
                parts.append(1 + (len(core) < len(text)))
            else:
                other.append(text)
        if simple:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            last = np.concatenate([[0], np.cumsum(parts)])
            if last[-1] == len(cuts) - 1:
                cuts, body = (4 * cuts[last]).tolist(), ids.tobytes()
                self.young.update((w.encode(), body[x:y]) for w, x, y in zip(simple, cuts[:-1], cuts[1:]))
            else:
                other += simple
        for word, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self.young[word.encode()] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text and the end id. bytes.split cuts at ``[\\x20\\x09-\\x0D]`` only."""
        # the tokenizer lowers case itself, but for its special tokens, which have "<|"
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        self._learn(set().union(*split))
        get = self.young.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + _END, dtype="<u4") for words in split]


#: The kind of task that remembers words; see ``common.released``.
KIND = "packing"


def word_ids(path: str) -> WordIds:
    """One cache for all tasks of a worker process, as long as it packs."""
    known = remembered(KIND)
    if path not in known:
        known[path] = WordIds(path)
    return known[path]


class Packer:
    """Collects documents and gives out pieces with their places in closed sequences.

    A piece is (key, start, stop, ids, bears, document tokens); all its tokens bear loss, or none.
    Pieces wait in a stack for each demand, numbered 2 * tokens + bears."""

    def __init__(self, limits: Limits, window: int, first_sequence: int):
        self.limits, self.window, self.next = limits, window, first_sequence
        self.full = limits.vector()
        number = np.arange(2 * (limits.tokens + 1))
        self.demand = np.stack([number // 2, np.ones(len(number)), number // 2 * (number % 2)], axis=1).astype(np.float64)
        self.scaled = self.demand / self.full
        self.count = np.zeros(len(number), dtype=np.int64)
        self.stacks: dict[int, list[tuple]] = {}
        self.held = self.pieces = 0
        self.out: list[tuple] = []

    def add(self, key: int, ids: np.ndarray, bears: bool) -> None:
        # no piece may exceed a limit by itself
        most = min(self.limits.tokens, self.limits.loss_tokens) if bears else self.limits.tokens
        for start in range(0, len(ids), most):
            piece = (key, start, min(len(ids), start + most), ids, int(bears))
            if piece[2] - start == self.limits.tokens:
                self._close([piece])
            else:
                self._hold(piece)
        if self.held >= self.window or self.pieces >= HELD_PIECES:
            self._pack(final=False)

    def _hold(self, piece: tuple) -> None:
        size = piece[2] - piece[1]
        number = 2 * size + piece[4]
        self.stacks.setdefault(number, []).append(piece)
        self.count[number] += 1
        self.held += size
        self.pieces += 1

    def _take(self, number: int) -> tuple:
        self.count[number] -= 1
        self.held -= number // 2
        self.pieces -= 1
        return self.stacks[number].pop()

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, stop, ids, bears in pieces:
            part = ids[start:stop]
            size = stop - start
            self.out.append((key, start, size, zlib.crc32(part.tobytes()), len(ids), self.next, offset, size * bears))
            offset += size
        self.next += 1

    def _best(self, left: np.ndarray) -> tuple[int, int] | None:
        """The demand that fits and has the largest dot product with what is left, and how often
        it is placed before another one is better."""
        live = np.flatnonzero(self.count)
        live = live[(self.demand[live] <= left).all(axis=1)]
        if not len(live):
            return None
        score = self.scaled[live] @ (left / self.full)
        i = int(np.argmax(score))
        number = int(live[i])
        # after n placements the scores have fallen by n times these
        fall = self.scaled[live] @ self.scaled[number]
        lead, speed = score[i] - score, fall[i] - fall
        overtakes = speed > 1e-12
        times = int((lead[overtakes] / speed[overtakes]).min()) + 1 if overtakes.any() else int(self.count[number])
        need = self.demand[number]
        room = int((left[need > 0] // need[need > 0]).min())
        return number, min(times, room, int(self.count[number]))

    def _longest(self, left: np.ndarray) -> int | None:
        """The longest piece that can be cut: where no loss is left, one that bears none."""
        live = np.flatnonzero(self.count)
        if left[2] < 1:
            live = live[live % 2 == 0]
        return int(live[-1]) if len(live) else None

    def _pack(self, final: bool) -> None:
        """Fill sequences while a full one's worth of tokens, or too many pieces, are held; at the
        end, all."""
        while self.held >= self.limits.tokens or self.pieces >= HELD_PIECES or (final and self.held > 0):
            left, bin_ = self.full.copy(), []
            while left[0] > 0 and left[1] > 0 and (found := self._best(left)) is not None:
                number, times = found
                bin_ += [self._take(number) for _ in range(times)]
                left -= times * self.demand[number]
            while left[0] > 0 and left[1] > 0 and (number := self._longest(left)) is not None:
                # nothing fits whole
                key, start, stop, ids, bears = self._take(number)
                cut = min(stop, start + int(min(left[0], left[2] if bears else left[0])))
                bin_.append((key, start, cut, ids, bears))
                left -= [cut - start, 1, (cut - start) * bears]
                if cut < stop:
                    self._hold((key, cut, stop, ids, bears))
            self._emit(bin_)

    def _emit(self, bin_: list[tuple]) -> None:
        """Close a sequence; one that is not full is cut at powers of two."""
        room = sum(p[2] - p[1] for p in bin_)
        while room:
            want = self.limits.tokens if room >= self.limits.tokens else 1 << (room.bit_length() - 1)
            now, rest, size = [], [], 0
            for key, a, b, ids, bears in bin_:
                cut = min(b, a + want - size)
                if cut > a:
                    now.append((key, a, cut, ids, bears))
                    size += cut - a
                if cut < b:
                    rest.append((key, max(a, cut), b, ids, bears))
            self._close(now)
            bin_, room = rest, room - size

    def finish(self) -> None:
        self._pack(final=True)
        self.stacks.clear()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _groups(rows) -> Iterator[list[tuple]]:
    """Rows in lists of about GROUP_BYTES of text, or of one longer text."""
    group, size = [], 0
    for key, text, bears in rows:
        body = text.as_py() or b""
        group.append((key, body, bears))
        size += len(body)
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


_FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("loss_tokens", pa.int64()),
]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), window: int = 1_000_000, trained: str | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): its place in its document and sequence, and
    how many of its tokens bear loss.

    A sequence has at most ``limits.tokens`` tokens, ``limits.segments`` pieces and
    ``limits.loss_tokens`` loss-bearing tokens; it is full, or its length is a power of two.
    ``trained`` names a boolean column that says whether a row's tokens bear loss (as answers
    do and prompts do not); without it all do. Null in it counts as false.

    Null or empty text: the end id alone. Very long texts are cut into full sequences. Null
    doc_id: pieces with null doc_id. Ties (pieces of equal demand) go in any order. Repeated rows
    are packed each for itself. Empty table: empty result. Other columns are ignored. Limits below
    one are an error."""
    names = [name for name, _ in _FIELDS]
    types = [kind for _, kind in _FIELDS]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*pieces), types)]
        ids = columns[0].to_numpy()
        columns[0] = pa.array(ids, pa.int64(), mask=ids == NO_ID)
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(limits, window, (context.partitionId() if context else 0) << 40)
        words: WordIds | None = None
        for batch in batches:
            words = words or word_ids(tokenizer)
            rows_ = zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("bears").to_pylist())
            for group in _groups(rows_):
                for (key, _, bears), ids in zip(group, words.encode([text for _, text, _ in group])):
                    packer.add(key, ids, bears)
                if len(packer.out) >= 20_000:
                    yield rows(packer.taken())
        packer.finish()
        if packer.out:
            yield rows(packer.taken())
        if words:
            words.old.clear()  # the worker may stay for other work

    ship(docs.sparkSession)
    bears = F.lit(True) if trained is None else F.coalesce(F.col(trained).cast("boolean"), F.lit(False))
    return docs.select(id_key().alias("k"), F.col("text").cast("string").alias("text"), bears.alias("bears")).mapInArrow(released(run, KIND), SCHEMA)


def padding(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row about the sequences of ``pieces``: sequences, tokens, padding (to the limit, for
    those whose length is no power of two), most_segments, most_loss. Nulls in keys don't matter;
    without pieces the counts are 0 and the rest is null."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"))
    even = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return each.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(even, 0).otherwise(limits.tokens - F.col("n"))), F.lit(0)).alias("padding"),
        F.max("segments").alias("most_segments"),
        F.max("loss").alias("most_loss"),
    )
