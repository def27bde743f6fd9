"""Near-duplicate documents by MinHash with tensored banding, confirmed on whole shingle sets.

Plain banding needs minhashes of its own for each table. Tensoring draws two collections of
``side`` keys, each a pair of minhashes (``4 * side`` in all), and forms table (i, j) from key i
of the first and key j of the second. Two sets of similarity 0.85 hardly miss unless they agree
in no key of one collection, which has a probability of ``2 * (1 - 0.85**2)**side``, 6e-6 for
ten keys a side. A few partners j = i + offset for each i come within a tenth of that (by
summing over the numbers of keys that agree), so 40 of the 100 tables are formed.

1. One scan of the text: shingle count, a 128-bit digest of the set (of 128-bit shingles), the keys, and a *parity
   sketch* (bit p is the parity of the shingles that hash to p). The sketches of two sets
   differ in no more bits than the sets differ in members, so a threshold on bits never loses
   a link; pairs that fail it need no look at the sets.
2. Documents with equal sets form a class; only its smallest doc_id goes on.
3. Table keys with one class only are dropped, and of keys with the same members all but one.
   Buckets of over ``block`` members that overlap are a *family*, which near copies fill in nearly
   every table. Where all pairs of a family are fewer than those of its buckets, it takes their
   place, as one bucket that is sliced in ``SLICINGS`` ways: all pairs that met still meet.
4. Buckets are cut into slices of ``block`` members. In each slice every pair is screened by
   sketch. A survivor is taken to link its two sides for the rest of that slice, so a group of
   copies yields a spanning tree and not all its pairs.
5. Survivors are confirmed on the words of both texts and components built from confirmed
   links. Where a guess of step 4 proves wrong, it may have hidden another link: that group is
   screened again without guesses, which finds the members near to one of another component, and
   their texts go to one task, which compares them all word by word. No further round is needed.
6. Each bucket and slicing has slices of its own, so those of a large group of copies are joined
   by then at linear cost. Only buckets that still have several
   components are compared across slices, in pairs of slices, each a unit of bounded size; the
   largest component's slices meet only those of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, map_arrow, materialize, released, ship, tasks
from .components import components
from .texthash import Chunk, chunks, grams, mix

SHINGLE = 5
SIDE = 10
#: Key i of the first collection meets keys i + offset of the second.
OFFSETS = (0, 1, 3, 6)
BLOCK = 512
#: Ways in which a family is sliced. It has that many rows a member within slices.
SLICINGS = 3
#: Pairs to confirm, and members of reopened groups, that a task has on average.
PAIRS = 5_000
#: Pairs of one text that are confirmed together; a text with more is copied.
PARTNERS = 256
MEMBERS = 2_000
#: Bytes of text whose shingles are numbered at once when a group is compared whole.
TEXT_BYTES = 4_000_000
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85

_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, 256, dtype=np.uint64)


def shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, two lanes of hashes) of every shingle occurrence, by document; short documents
    have one."""
    lanes, owner = chunk.digests(lower=True), chunk.owner()
    n = len(owner) - width + 1
    long_ = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
    counts = chunk.word_counts()
    doc, value = [owner[long_]], [np.stack([grams(lane, width)[long_] for lane in lanes])]
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            doc.append(short)
            value.append(np.stack([grams(lane, size)[chunk.first[short]] for lane in lanes]))
    docs, values = np.concatenate(doc), np.concatenate(value, axis=1)
    order = np.argsort(docs, kind="stable")
    return docs[order], values[:, order]


def _signatures(width: int, side: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, chunk in chunks(batch.column("text")):
            doc, lanes = shingles(chunk, width)
            value, rows = lanes[0], hi - lo
            cuts = np.searchsorted(doc, np.arange(rows + 1))
            full = np.flatnonzero(np.diff(cuts))
            keys = np.zeros((rows, 2 * side), np.uint64)
            if len(full):
                for i in range(2 * side):
                    two = [np.minimum.reduceat((value * _MUL[x] + _ADD[x]) >> np.uint64(32), cuts[full]) for x in (2 * i, 2 * i + 1)]
                    keys[full, i] = mix((two[0] << np.uint64(32)) | two[1])
            sets, digests = [], np.empty((rows, 2), np.int64)
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                members, place = np.unique(value[a:b], return_index=True)
                sets.append(members)
                whole = hashlib.blake2b(members.tobytes() + lanes[1, a:b][place].tobytes(), digest_size=16)
                digests[i] = np.frombuffer(whole.digest(), np.int64)
            flat = keys.view(np.int64)
            offsets = np.arange(rows + 1, dtype=np.int32) * side
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").slice(lo, rows),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                    pa.ListArray.from_arrays(offsets, np.ascontiguousarray(flat[:, :side]).ravel()),
                    pa.ListArray.from_arrays(offsets, np.ascontiguousarray(flat[:, side:]).ravel()),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                ],
                ["k", "n", "d1", "d2", "a", "b", "sketch"],
            )

    return run


def sketch(members: np.ndarray) -> bytes:
    """Parities of the members that hash to each of at least 2 * len(members) positions."""
    width = max(512, 1 << int(2 * len(members) - 1).bit_length()) if len(members) else 512
    at = (mix(members ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(bool), bitorder="little").tobytes()


def numbered(bodies: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles of each list of words, by document, exactly:
    words are numbered, and runs of words by the pairs of numbers they are made of, so no hash is
    involved. A short text's one shingle is its whole sequence."""
    names: dict[bytes, int] = {}
    words = np.array([names.setdefault(w, len(names)) for body in bodies for w in body], dtype=np.int64)
    owner = np.repeat(np.arange(len(bodies)), [len(body) for body in bodies])
    runs = words
    for i in range(1, width):
        runs = np.unique(runs[: len(words) - i] * len(names) + words[i:], return_inverse=True)[1]
    n = max(0, len(words) - width + 1)
    whole = np.flatnonzero(owner[:n] == owner[len(owner) - n :])
    doc, shingle = [owner[whole]], [runs[whole]]
    short: dict[tuple, int] = {}
    for i, body in enumerate(bodies):
        if 0 < len(body) < width:
            doc.append(np.array([i]))
            shingle.append(np.array([len(words) + short.setdefault(tuple(body), len(short))]))
    span = 2 * len(words) + 1
    both = np.unique(np.concatenate(doc) * span + np.concatenate(shingle))
    return both // span, both % span


def common_shingles(a: list[bytes], b: list[bytes], width: int) -> tuple[int, int, int]:
    """(distinct shingles of a, of b, of both), exactly."""
    doc, shingle = numbered([a, b], width)
    left, right = shingle[doc == 0], shingle[doc == 1]
    return len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))


def linked_members(ids: list[int], labels: np.ndarray, bodies: list[list[bytes]], width: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of ids) of the links between members of different components.

    Every pair is compared exactly; texts are numbered in blocks of TEXT_BYTES, two at a time."""
    label, out = labels.copy(), []
    size = np.cumsum([sum(map(len, body)) + 2 * len(body) for body in bodies])
    block = (size - size[0]) // TEXT_BYTES
    blocks = [np.flatnonzero(block == x) for x in np.unique(block)]
    for p, first in enumerate(blocks):
        for second in blocks[p:]:
            rows = first if first is second else np.concatenate([first, second])
            if (label[rows] == label[rows[0]]).all():
                continue
            doc, shingle = numbered([bodies[r] for r in rows], width)
            n = np.bincount(doc, minlength=len(rows))
            cuts = np.concatenate([[0], np.cumsum(n)])
            mine = np.zeros(shingle.max() + 1, dtype=bool)
            for i in range(len(first)):
                apart = label[rows] != label[rows[i]]
                apart[: i + 1 if first is second else len(first)] = False
                if not apart.any():
                    continue
                mine[shingle[cuts[i] : cuts[i + 1]]] = True
                both = np.bincount(doc[mine[shingle]], minlength=len(rows))
                mine[shingle[cuts[i] : cuts[i + 1]]] = False
                for j in np.flatnonzero(apart & (both > 0) & (100 * both >= percent * (n[i] + n - both))).tolist():
                    x, y = rows[i], rows[j]
                    if label[x] != label[y]:
                        out.append((ids[x], ids[y]))
                        label[label == label[y]] = label[x]
    return out


def _compared(width: int, percent: int):
    """(x, y, linked) of pairs of texts (x, y, tx, ty), by their words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        linked = []
        for one, other in zip(batch.column("tx"), batch.column("ty")):
            a, b, both = common_shingles(*((t.as_py() or "").encode().lower().split() for t in (one, other)), width)
            linked.append(100 * both >= percent * (a + b - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    return run


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer positions: halves are added modulo 2."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _screened(
    ids: np.ndarray, label: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], halves: np.ndarray | None, percent: int
) -> Iterator[tuple[int, list[int]]]:
    """(i, later members of another label that may be linked to it) for each member of a bucket.

    ``halves``: if given, only pairs from different halves count. The caller may change ``label``
    between members."""
    words = np.array([len(b) for b in bits])
    at_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def matrix(width: int) -> tuple[np.ndarray, np.ndarray]:
        """The members with sketches of at least this width (by position) and their sketches."""
        if width not in at_width:
            rows = np.flatnonzero((words >= width) & (words <= 2 * width))
            place = np.full(len(ids), -1)
            place[rows] = np.arange(len(rows))
            at_width[width] = (place, np.stack([_folded(bits[r], width) for r in rows]))
        return at_width[width]

    for i in range(len(ids) - 1):
        other = np.arange(i + 1, len(ids))
        keep = label[other] != label[i]
        if halves is not None:
            keep &= halves[other] != halves[i]
        small, large = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
        other = other[keep & (100 * small >= percent * large)]
        found = []
        for width in {int(w) for w in np.minimum(words[other], words[i])}:
            mine = other[np.minimum(words[other], words[i]) == width]
            place, table = matrix(width)
            far = np.bitwise_count(table[place[mine]] ^ _folded(bits[i], width)).sum(axis=1, dtype=np.int64)
            # difference <= (100 - percent) / (100 + percent) * (both sizes) exactly where linked
            found.append(mine[(100 + percent) * far <= (100 - percent) * (sizes[mine] + sizes[i])])
        if found:
            yield i, np.sort(np.concatenate(found)).tolist()


def survivors(
    ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], halves: np.ndarray | None, percent: int
) -> list[tuple[int, int, int]]:
    """(i, j, component) of pairs of one bucket that may be links: a spanning tree of each
    component, if all are. Components are -1 where their two members leave no other pair."""
    out: list[tuple[int, int]] = []
    label = labels.copy()
    for i, near in _screened(ids, label, sizes, bits, halves, percent):
        for j in near:
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    root, size = np.unique(label, return_counts=True)
    big = set(root[size > 2].tolist())
    return [(i, j, int(label[i]) if label[i] in big else -1) for i, j in out]


_UNIT = ("key", "p", "q")


def _by_unit(function: Callable[[pa.Table], pa.RecordBatch], unit: tuple[str, ...] = _UNIT):
    """``function`` over whole units, of partitions that are sorted by them. Only the unit at hand
    is held; its size is bounded by two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in unit)
            same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in zip(unit, last)])
            # rows of the last unit start here
            start = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                yield function(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            elif held and tuple(held[-1].column(c)[0].as_py() for c in unit) != last:
                yield function(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(start))
        if held:
            yield function(pa.Table.from_batches(held))

    return run


def _units(table: pa.Table, unit: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """The first row of each unit and the row after its last, of units of several components."""
    key = np.stack([table.column(c).to_numpy() for c in unit])
    labels = table.column("label").to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [key.shape[1]]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo > 1 and (labels[lo:hi] != labels[lo]).any():
            yield lo, hi


def _longs_of(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))


def _guessed(percent: int):
    """(x, y, g) of each unit's survivors; g numbers the guessed component, null where it can hide
    no pair."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table.column(c).to_numpy() for c in _UNIT])
        ids, labels, sizes, half = (table.column(c).to_numpy() for c in ("id", "label", "n", "half"))
        bits = table.column("sketch").to_pylist()
        out: dict[str, list] = {"x": [], "y": [], "g": []}
        for lo, hi in _units(table, _UNIT):
            each = [np.frombuffer(b, np.uint64) for b in bits[lo:hi]]
            split = half[lo:hi] if key[1, lo] != key[2, lo] else None
            for i, j, part in survivors(ids[lo:hi], labels[lo:hi], sizes[lo:hi], each, split, percent):
                out["x"].append(ids[lo + i])
                out["y"].append(ids[lo + j])
                out["g"].append(None if part == -1 else hash((*key[:, lo].tolist(), part)))
        return _longs_of(out)

    return _by_unit(pairs)


def _unsettled(percent: int):
    """(g, id) of the members of reopened groups that may be linked to another component."""

    def members(table: pa.Table) -> pa.RecordBatch:
        group, ids, labels, sizes = (table.column(c).to_numpy() for c in ("g", "id", "label", "n"))
        bits = table.column("sketch").to_pylist()
        out: dict[str, list] = {"g": [], "id": []}
        for lo, hi in _units(table, ("g",)):
            each = [np.frombuffer(b, np.uint64) for b in bits[lo:hi]]
            near: set[int] = set()
            for i, others in _screened(ids[lo:hi], labels[lo:hi], sizes[lo:hi], each, None, percent):
                if others:
                    near.update((i, *others))
            for i in sorted(near):
                out["g"].append(group[lo])
                out["id"].append(ids[lo + i])
        return _longs_of(out)

    return _by_unit(members, ("g",))


def _settled(width: int, percent: int):
    """(x, y) of the links between the components of each group, by the words of its texts."""

    def links(table: pa.Table) -> pa.RecordBatch:
        ids, labels = table.column("id").to_pylist(), table.column("label").to_numpy()
        out: list[tuple[int, int]] = []
        for lo, hi in _units(table, ("g",)):
            bodies = [(t or "").encode().lower().split() for t in table.column("text").slice(lo, hi - lo).to_pylist()]
            out += linked_members(ids[lo:hi], labels[lo:hi], bodies, width, percent)
        return _longs_of({"x": [x for x, _ in out], "y": [y for _, y in out]})

    return _by_unit(links, ("g",))


def _buckets(reps: DataFrame, side: int, block: int) -> DataFrame:
    """(key, id, half, across): the members of buckets with several classes, each in a slice.
    ``across``: members of other slices are to be met, and this key is the one for that."""
    partners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit((i + d) % side).alias("j")) for i in range(side) for d in OFFSETS))
    keyed = reps.select("id", "a", "b", F.explode(partners).alias("t")).select(
        F.xxhash64("t", F.col("a")[F.col("t.i")], F.col("b")[F.col("t.j")]).alias("key"), "id"
    )
    counted = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("who"))
        .where("lo < hi")
    )
    # buckets with the same members need one look
    kept = materialize(counted.groupBy("size", "lo", "hi", "who").agg(F.min("key").alias("key")).select("key", "size", "lo"), "buckets")
    # the key's members are unique, so only its hot side needs splitting, which AQE does
    found = materialize(keyed.join(kept, "key").select("key", "id", "size", "lo"), "members")
    large = found.where(F.col("size") > block)
    if large.isEmpty():
        return _sliced(found, block)
    return _sliced(found.where(F.col("size") <= block), block).unionByName(materialize(_families(large, block), "large"))


def _families(large: DataFrame, block: int) -> DataFrame:
    """(key, id, half, across) for ``large`` (key, id, size, lo), whole buckets with their smallest
    ids: the members of families, and of the buckets that are better left alone."""
    roots = materialize(components(large.select(F.col("lo").alias("x"), F.col("id").alias("y"))), "families")
    buckets = large.where("id = lo").join(roots, "id").select("key", "size", "root")
    pairs = buckets.groupBy("root").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    # each family also has fewer rows than its buckets then: none of them is larger than it
    fewer = roots.groupBy("root").agg(F.count("*").alias("size")).join(pairs, "root").where(F.col("pairs") >= SLICINGS * F.col("size") * F.col("size"))
    worth = materialize(fewer.select("root", "size"), "worth")
    # lists of families and of large buckets are broadcast: they have less than a row for ``block``
    # of their members, who stay where they are and don't meet in one task
    slicing = F.explode(F.array(*(F.lit(i) for i in range(SLICINGS)))).alias("slicing")
    each = roots.join(F.broadcast(worth), "root").select("root", "id", "size", slicing).withColumn("key", F.xxhash64("root", "slicing"))
    alone = large.join(F.broadcast(buckets.join(worth, "root", "left_anti").select("key")), "key", "left_semi")
    return _sliced(alone, block).unionByName(_sliced(each, block, F.col("slicing") == 0))


def _sliced(members: DataFrame, block: int, once: Column | None = None) -> DataFrame:
    """(key, id, half, across) of ``members`` (key, id, size, ...)."""
    slices = F.ceil(F.col("size") / F.lit(block)).cast("long")
    # buckets with much the same members are sliced differently, so what one slice parts another joins
    return members.select("key", "id", F.pmod(F.xxhash64("id", "key"), slices).alias("half"), ((slices > 1) & (F.lit(True) if once is None else once)).alias("across"))


def _within(members: DataFrame) -> DataFrame:
    """Units of one slice each."""
    return members.select("key", F.col("half").alias("p"), F.col("half").alias("q"), "half", "id")


def _across(members: DataFrame, block: int) -> DataFrame:
    """Units of two slices each, for ``members`` (key, id, label, ...) of buckets of several components.

    The largest component of a bucket needs no look inside itself, so its slices meet those of the
    others only: each of its members goes along once where the others fill one slice."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"))
    own, others = (F.ceil(n / F.lit(block)).cast("long") for n in (F.col("top.n"), F.col("size") - F.col("top.n")))
    inside = F.col("label") == F.col("top.label")
    mine = members.join(F.broadcast(largest), "key").select("key", "id", inside.alias("inside"), own.alias("own"), others.alias("others"))
    mine = mine.withColumn("at", F.pmod(F.xxhash64("id", "key"), F.when(F.col("inside"), F.col("own")).otherwise(F.col("others"))))

    def unit(p: Column, q: Column, half: Column) -> Column:
        return F.struct(p.alias("p"), q.alias("q"), half.alias("half"))

    def each(n: str, make: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), make)

    at, one, zero = F.col("at"), F.lit(1).cast("long"), F.lit(0).cast("long")
    # slices of the largest component count down from -1
    larger = each("others", lambda j: unit(-one - at, j, zero))
    rest = F.concat(each("own", lambda m: unit(-one - m, at, one)), each("others", lambda j: unit(F.least(at, j), F.greatest(at, j), at)))
    return mine.select("key", "id", F.explode(F.when(F.col("inside"), larger).otherwise(rest)).alias("u")).select("key", "u.p", "u.q", "u.half", "id")


def _with_text(pairs: DataFrame, texts: DataFrame, hubs: DataFrame, end: str, other: str, n: int) -> DataFrame:
    """``pairs`` with the text of one end. The texts of ``hubs`` (end, k, _parts) are copied, so that
    no task has more than PARTNERS pairs of one on average."""
    mine = hubs.where(F.col("end") == end).select(F.col("k").alias(end), "_parts")
    part = F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = pairs.join(mine, end, "left").withColumn("_part", part).drop("_parts").repartition(n, end, "_part")
    copies = texts.withColumnRenamed("k", end).join(mine, end, "left")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    copies = copies.select(end, F.col("text").alias(f"t{end}"), every).repartition(n, end, "_part")
    return dealt.join(copies, [end, "_part"]).drop("_part")


class _Links:
    """Confirmed links so far, and the components that they make."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, width: int, percent: int):
        self.texts, self.sketches, self.width, self.percent = texts, sketches, width, percent
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def labelled(self, members: DataFrame) -> DataFrame:
        """``members`` (id, ...) with the component of each (``label``)."""
        if self.roots is None:
            return members.withColumn("label", F.col("id"))
        return members.join(self.roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")

    def _judged(self, found: DataFrame) -> DataFrame:
        """(x, y, linked) of the pairs, by the words of their texts."""
        n = tasks(found, PAIRS)
        pairs = materialize(found.select("x", "y").repartition(n, "x", "y").distinct(), "distinct")
        both_ends = F.explode(F.array(*(F.struct(F.lit(c).alias("end"), F.col(c).alias("k")) for c in "xy"))).alias("e")
        degrees = materialize(pairs.select(both_ends).groupBy("e.end", "e.k").agg(F.count("*").alias("n")), "degrees")
        texts = materialize(self.texts.join(degrees.select("k"), "k", "left_semi"), "compared")
        hubs = degrees.where(F.col("n") > PARTNERS).select("end", "k", F.ceil(F.col("n") / F.lit(PARTNERS)).cast("int").alias("_parts"))
        both = _with_text(_with_text(pairs, texts, hubs, "x", "y", n), texts, hubs, "y", "x", n)
        each = map_arrow(both.select("x", "y", "tx", "ty"), _compared(self.width, self.percent), "x long, y long, linked boolean")
        return materialize(each.repartition(n, "x", "y").groupBy("x", "y").agg(F.max("linked").alias("linked")), "judged")

    def _add(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.unionByName(links)
        self.roots = materialize(components(self.links), "roots")

    def search(self, units: DataFrame) -> None:
        """Add the links inside ``units`` (key, p, q, half, id) that components don't imply."""
        ship(units.sparkSession)
        ready = self.labelled(units).join(self.sketches, "id").select(*_UNIT, "id", "half", "label", "n", "sketch")
        dealt = ready.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "id")
        found = materialize(dealt.mapInArrow(released(_guessed(self.percent)), "x long, y long, g long"), "pairs")
        if found.isEmpty():
            return
        judged = self._judged(found)
        self._add(judged.where("linked").select("x", "y"))
        wrong = found.where("g is not null").join(judged.where("not linked"), ["x", "y"]).select("g").distinct()
        ends = found.join(wrong, "g").select("g", F.explode(F.array("x", "y")).alias("id")).distinct()
        groups = materialize(self.labelled(ends), "groups")
        if not groups.isEmpty():
            self._settle(groups)

    def _settle(self, groups: DataFrame) -> None:
        """Add the links between different components inside ``groups`` (g, id, label)."""
        n = tasks(groups, MEMBERS)
        several = groups.repartition(n, "g").groupBy("g").agg(
            F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("who"),
            F.min("label").alias("a"), F.max("label").alias("b"),
        )
        # groups with the same members need one look
        once = several.where("a < b").groupBy("size", "lo", "hi", "who").agg(F.min("g").alias("g")).select("g")
        again = groups.join(once, "g").join(self.sketches, "id").select("g", "id", "label", "n", "sketch")
        again = again.repartition(n, "g").sortWithinPartitions("g", "id")
        near = materialize(again.mapInArrow(released(_unsettled(self.percent)), "g long, id long").distinct(), "near")
        if near.isEmpty():
            return
        n = tasks(near, MEMBERS)
        texts = self.labelled(near).join(self.texts.withColumnRenamed("k", "id"), "id").select("g", "id", "label", "text")
        whole = texts.repartition(n, "g").sortWithinPartitions("g", "id")
        self._add(materialize(whole.mapInArrow(released(_settled(self.width, self.percent)), "x long, y long"), "settled"))

    def several(self, members: DataFrame) -> DataFrame:
        """``members`` with labels, of the buckets that still have several components."""
        now = self.labelled(members)
        more = now.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
        return materialize(now.join(F.broadcast(more), "key", "left_semi"), "apart")


def near_dedup(
    docs: DataFrame, width: int = SHINGLE, side: int = SIDE, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Linked: 100 * common shingles >= percent * all shingles of both, over sets of distinct
    ``width``-word shingles of A-Z lower-cased words. component_id is the smallest doc_id that
    links reach; kept marks the row that has it.

    Null or empty text: no shingles, linked with nothing. Fewer words than ``width``: the whole
    sequence is the one shingle. Very long texts are compared whole. Null doc_id: before every
    other doc_id; its component_id is null too. Rows that repeat a doc_id are rows of one document
    if their texts have equal sets (each is kept or not alike); else the doc_id links them. Empty
    table: empty result. Other columns are ignored."""
    base = docs.select(id_key().alias("k"), F.col("text").cast("string").alias("text"))
    signed = materialize(
        map_arrow(base, _signatures(width, side), "k long, n long, d1 long, d2 long, a array<long>, b array<long>, sketch binary"), "signatures"
    )
    filled = signed.where("n > 0")
    classes = materialize(filled.groupBy("d1", "d2").agg(F.min("k").alias("id")), "classes")
    reps = materialize(
        filled.join(classes.withColumnRenamed("id", "k"), ["k", "d1", "d2"], "left_semi").dropDuplicates(["k", "d1", "d2"]).withColumnRenamed("k", "id"), "representatives"
    )
    members = _buckets(reps, side, block)
    # whatever may be compared, read from the documents once; the list of ids grows with them
    texts = materialize(base.join(members.select(F.col("id").alias("k")).distinct().hint("merge"), "k", "left_semi"), "texts")
    links = _Links(texts, reps.select("id", "n", "sketch"), width, percent)
    links.search(_within(members))
    apart = links.several(members.where("across"))
    if not apart.isEmpty():
        links.search(_across(apart, block))
    out = signed.select("k", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    if links.roots is not None:
        out = out.join(links.roots, "id", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    own = F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("k"))
    out = out.withColumn("c", own)
    return out.select(id_back(F.col("k")).alias("doc_id"), F.col("n").alias("n_shingles"), id_back(F.col("c")).alias("component_id"), (F.col("k") == F.col("c")).alias("kept"))
