"""Reads: sampling, duplicates, overlaps, greedy assembly, placement by identity."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import ship
from . import arrays
from .tiles import grams

MIN_OVERLAP = 30


def sample_plan(length: int, reads: int = 2000, min_len: int = 100, max_len: int = 150, seed: int = 42) -> list[tuple[int, int, int]]:
    """(read_id, start, len) from the Mersenne Twister: a length, then a start, for each read."""
    if not 0 < min_len <= max_len <= length:
        raise ValueError("read lengths must be positive and within the sequence")
    rng = random.Random(seed)
    plan = []
    for i in range(reads):
        size = rng.randint(min_len, max_len)
        plan.append((i, rng.randint(0, length - size), size))
    return plan


def sample_reads(reference: DataFrame, reads: int = 2000, min_len: int = 100, max_len: int = 150, seed: int = 42, column: str = "seq") -> DataFrame:
    """(read_id, start, len, seq) of one sequence, with the stream of draws that ``seed`` fixes.

    ``reference`` has one row. The draws are a sequential stream and so made on the driver, a
    few numbers per read; ``sample_reads_at_scale`` has none."""
    length = reference.select(F.length(column)).first()[0]
    plan = reference.sparkSession.createDataFrame(sample_plan(length, reads, min_len, max_len, seed), "read_id int, start int, len int")
    one = F.broadcast(reference.select(F.col(column).alias("_seq")))  # one row, by contract
    return plan.crossJoin(one).select("read_id", "start", "len", F.substr("_seq", F.col("start") + 1, F.col("len")).alias("seq"))


def _draw(seed: int, what: str, room: F.Column) -> F.Column:
    """A number below ``room`` from 60 bits of a hash of (seed, sequence, read, what)."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("seq_id").cast("string"), F.col("read_id").cast("string"), F.lit(what)))
    return F.pmod(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), room.cast("long")).cast("int")


def sample_reads_at_scale(sequences: DataFrame, reads: int, min_len: int = 100, max_len: int = 150, seed: int = 42, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, read_id, start, len, seq): ``reads`` of every sequence that is long enough.

    Draws are hashes of (seed, sequence, read), so any task can make its own; this is another
    stream than that of ``sample_reads``."""
    n = F.length(column)
    drawn = sequences.where(n >= max_len).select(F.col(keep).alias("seq_id"), F.col(column).alias("_seq"), F.explode(F.sequence(F.lit(0), F.lit(reads - 1))).alias("read_id"))
    drawn = drawn.withColumn("len", min_len + _draw(seed, "len", F.lit(max_len - min_len + 1)))
    drawn = drawn.withColumn("start", _draw(seed, "start", F.length("_seq") - F.col("len") + 1))
    return drawn.select("seq_id", "read_id", "start", "len", F.substr("_seq", F.col("start") + 1, F.col("len")).alias("seq"))


def sample_reads_by_coverage(sequences: DataFrame, coverage: float, min_len: int = 100, max_len: int = 150, seed: int = 42, column: str = "seq", keep: str = "seq_id") -> DataFrame:
    """(seq_id, read_id, start, len, seq): as many reads of every sequence as cover each symbol
    ``coverage`` times on average. Sequences shorter than a read's length give reads of their own
    length; null and empty ones give none."""
    if not coverage > 0 or not 0 < min_len <= max_len:
        raise ValueError("coverage and lengths must be positive")
    n = F.length(column)
    many = F.ceil(n * F.lit(2 * float(coverage)) / F.lit(min_len + max_len)).cast("int")
    drawn = sequences.where(n > 0).select(F.col(keep).alias("seq_id"), F.col(column).alias("_seq"), F.explode(F.sequence(F.lit(0), many - 1)).alias("read_id"))
    low, high = F.least(F.lit(min_len), F.length("_seq")), F.least(F.lit(max_len), F.length("_seq"))
    drawn = drawn.withColumn("len", low + _draw(seed, "len", high - low + 1))
    drawn = drawn.withColumn("start", _draw(seed, "start", F.length("_seq") - F.col("len") + 1))
    return drawn.select("seq_id", "read_id", "start", "len", F.substr("_seq", F.col("start") + 1, F.col("len")).alias("seq"))


def unique_reads(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, uid, seq, copies, first_id): equal reads once, uid counting from 0 in order of
    first appearance."""
    groups = reads.groupBy(*by, "seq").agg(F.count("*").alias("copies"), F.min("read_id").alias("first_id"))
    order = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy("first_id")
    return groups.select(*by, (F.row_number().over(order) - 1).cast("long").alias("uid"), "seq", "copies", "first_id")


def seed_read(unique: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The longest read, the first of several."""
    order = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(F.length("seq").desc(), "uid")
    return unique.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def overlap_length(left: F.Column, right: F.Column, min_len: int) -> F.Column:
    """The shortest overlap of at least ``min_len`` of an end of ``left`` with a beginning of
    ``right``; 0 if there is none. (A search that goes down from the end finds that one first.)"""
    most = F.length(left)
    sizes = F.when(most >= min_len, F.sequence(F.lit(min_len), F.greatest(most, F.lit(min_len)))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda n: (n <= F.length(right)) & (F.right(left, n) == F.left(right, n)))
    return F.coalesce(F.array_min(fits), F.lit(0))


def overlaps(unique: DataFrame, k: int = MIN_OVERLAP, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, left_uid, right_uid): reads whose last k symbols are another's first k."""
    long_ = unique.where(F.length("seq") >= k)
    ends = long_.select(*by, F.col("uid").alias("left_uid"), F.right("seq", F.lit(k)).alias("mer"))
    starts = long_.select(*by, F.col("uid").alias("right_uid"), F.left("seq", F.lit(k)).alias("mer"))
    return ends.join(starts, [*by, "mer"]).where("left_uid <> right_uid").select(*by, "left_uid", "right_uid")


def _walk(seqs: list[str], k: int, longest: bool) -> tuple[str, list[int]]:
    """The greedy contig of unique reads in order, and the reads in it from left to right.

    With overlaps of exactly k the contig's ends are its end reads' ends, so this is one walk
    to the right and one to the left on the graph of ``overlaps``."""
    seed = max(range(len(seqs)), key=lambda i: len(seqs[i]))
    contig, used, chain = seqs[seed], {seed}, [seed]
    if len(contig) < k:
        return contig, chain
    if longest:
        return _longest(seqs, k, contig, used, chain)
    first: dict[str, list[int]] = {}
    last: dict[str, list[int]] = {}
    for i, s in enumerate(seqs):
        if len(s) >= k:
            first.setdefault(s[:k], []).append(i)
            last.setdefault(s[-k:], []).append(i)

    def unused(waiting: dict[str, list[int]], end: str) -> int | None:
        """The first unused read; used ones leave the list, so none is looked at twice."""
        rest = waiting.get(end, [])
        while rest and rest[-1] in used:
            rest.pop()
        return rest[-1] if rest else None

    for waiting in (*first.values(), *last.values()):
        waiting.reverse()
    parts, now = [contig], contig
    while (step := unused(first, now[-k:])) is not None:
        used.add(step)
        chain.append(step)
        now = seqs[step]
        parts.append(now[k:])
    head, ahead, now = [], [], contig
    while (step := unused(last, now[:k])) is not None:
        used.add(step)
        ahead.append(step)
        now = seqs[step]
        head.append(now[: len(now) - k])
    return "".join(head[::-1]) + "".join(parts), ahead[::-1] + chain


def _longest(seqs: list[str], k: int, contig: str, used: set[int], chain: list[int]) -> tuple[str, list[int]]:
    """Always the read with the longest overlap, on the right until none is left, then on the left.

    A read that overlaps the contig's end by k or more has its first k symbols near that end: reads
    are found by them, from the place that leaves the longest overlap on."""
    most = max(map(len, seqs))

    def grown(end: str, first: dict[str, list[int]], text: list[str]) -> list[tuple[int, int]]:
        """(read, overlap) of the reads that extend the text ``end`` to the right."""
        steps = []
        while True:
            end = end[-most:]
            for place in range(len(end) - k + 1):
                tail = end[place:]
                found = next((i for i in first.get(tail[:k], ()) if i not in used and text[i].startswith(tail)), None)
                if found is not None:
                    break
            else:
                return steps
            used.add(found)
            steps.append((found, len(tail)))
            end += text[found][len(tail) :]

    def indexed(text: list[str]) -> dict[str, list[int]]:
        first: dict[str, list[int]] = {}
        for i, s in enumerate(text):
            if len(s) >= k:
                first.setdefault(s[:k], []).append(i)
        return first

    right = grown(contig, indexed(seqs), seqs)
    contig += "".join(seqs[i][n:] for i, n in right)
    # to the left, everything is read backwards
    turned = [s[::-1] for s in seqs]
    left = grown(contig[::-1], indexed(turned), turned)
    contig = "".join(seqs[i][: len(seqs[i]) - n] for i, n in reversed(left)) + contig
    return contig, [i for i, _ in reversed(left)] + chain + [i for i, _ in right]


def assemble(unique: DataFrame, k: int = MIN_OVERLAP, overlap: str = "exact_k", by: str = "assembly_id") -> DataFrame:
    """(by, contig, reads_used, reads) of each group of unique reads, greedily from the longest.

    A walk is sequential, so a group is one task's; groups are independent, and a task holds one
    at a time. ``overlap`` is 'exact_k' (reads whose k end symbols match, first unused one) or
    'longest'."""
    if overlap not in ("exact_k", "longest"):
        raise ValueError("overlap is 'exact_k' or 'longest'")
    kind = unique.select(by).schema[0].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (by, "seq"))))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            seqs = [r[1] for r in group]
            contig, chain = _walk(seqs, k, overlap == "longest")
            out.append((key, contig, len(chain), len(seqs)))
            if len(out) == 500:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        types = (arrow, pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [by, "contig", "reads_used", "reads"])

    ship(unique.sparkSession)
    dealt = unique.select(by, "uid", "seq").repartition(by).sortWithinPartitions(by, "uid")
    return dealt.mapInArrow(run, f"`{by}` {kind.simpleString()}, contig string, reads_used long, reads long")


def overlap_graph(unique: DataFrame, k: int = MIN_OVERLAP, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, left_uid, right_uid, overlap): the longest overlap of at least ``k`` symbols of an end
    of one read with a beginning of another, shorter than both.

    A read's first k symbols are its seed; it overlaps where another read has the seed and
    what follows agrees to the end."""
    ends = unique.where(F.length("seq") > k).select(*by, F.col("uid").alias("left_uid"), "seq")
    found = grams(ends, k, column="seq", keep=(*by, "left_uid", "seq")).where("pos > 0")
    seeds = unique.where(F.length("seq") > k).select(*by, F.col("uid").alias("right_uid"), F.left("seq", F.lit(k)).alias("gram"), F.col("seq").alias("right_seq"))
    met = found.join(seeds, [*by, "gram"]).where("left_uid <> right_uid")
    tail = F.substr("seq", F.col("pos").cast("int") + 1)
    fits = met.where((F.length(tail) < F.length("right_seq")) & F.startswith("right_seq", tail))
    return fits.groupBy(*by, "left_uid", "right_uid").agg(F.max(F.length(tail)).cast("long").alias("overlap"))


def reduced_graph(graph: DataFrame, unique: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``graph`` without the overlaps that two others imply: where a read is met by way of a third
    one at the same distance."""
    sizes = unique.select(*by, F.col("uid").alias("left_uid"), F.length("seq").alias("_n"))
    edges = graph.join(sizes, [*by, "left_uid"]).withColumn("far", F.col("_n") - F.col("overlap")).select(*by, "left_uid", "right_uid", "overlap", "far")
    one = edges.select(*by, "left_uid", F.col("right_uid").alias("mid"), F.col("far").alias("_a"))
    two = edges.select(*by, F.col("left_uid").alias("mid"), "right_uid", F.col("far").alias("_b"))
    implied = one.join(two, [*by, "mid"]).select(*by, "left_uid", "right_uid", (F.col("_a") + F.col("_b")).alias("far")).distinct()
    return edges.join(implied, [*by, "left_uid", "right_uid", "far"], "left_anti").select(*by, "left_uid", "right_uid", "overlap")


def identity_profile(pairs: DataFrame, min_overlap: int = 1, keep: str = "pair_id") -> DataFrame:
    """(pair_id, off, sign, matches, total, identity) of every shift of the shorter sequence ``a`` or
    ``b`` along the longer one that overlaps by at least ``min_overlap``.

    A pair correlates its own sequences (see ``arrays.matches_by_shift``); shifts without a match
    are kept. Pairs with a null or empty sequence have no shifts."""

    def kernel(a: bytes, b: str) -> tuple | None:
        one, other = arrays.code_points(a), arrays.code_points(b.encode())
        sign = -1 if len(one) < len(other) else 1
        short, long_ = (one, other) if sign < 0 else (other, one)
        if not len(short):
            return None
        off = np.arange(1 - len(short), len(long_))
        total = np.minimum(len(short), len(long_) - off) - np.maximum(0, -off)
        keep_ = total >= min_overlap
        return off[keep_], np.full(keep_.sum(), sign), arrays.matches_by_shift(short, long_)[keep_], total[keep_]

    rows = pairs.where("a is not null and b is not null").select(F.col(keep).alias("pair_id"), "a", "b")
    shifts = arrays.apply(rows, "a", ("pair_id",), "off int, sign int, matches long, total long", kernel, ("b",))
    return shifts.withColumn("identity", F.col("matches") / F.col("total"))


def best_shift(profile: DataFrame) -> DataFrame:
    """(pair_id, shift, identity): the first shift of the highest identity; 0 where none matches."""
    order = W.partitionBy("pair_id").orderBy(F.desc("identity"), "off")
    top = profile.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    shift = F.when(F.col("identity") > 0, F.col("off") * F.col("sign")).otherwise(0)
    return top.select("pair_id", shift.cast("long").alias("shift"), "identity")


def containment(pairs: DataFrame, keep: str = "pair_id") -> DataFrame:
    """(pair_id, a_in_b, b_in_a)."""
    return pairs.select(F.col(keep).alias("pair_id"), F.contains("b", "a").alias("a_in_b"), F.contains("a", "b").alias("b_in_a"))


def checked_reference(reference: DataFrame, low: int = 1000, high: int = 3000, column: str = "seq") -> DataFrame:
    """The one reference sequence, if its length is within limits."""
    length = reference.select(F.length(column)).first()[0]
    if not low <= length <= high:
        raise ValueError(f"the reference has {length} symbols, not {low} to {high}")
    return reference


def inline(spark: SparkSession, sequence: str, name: str = "inline_sequence") -> DataFrame:
    """(seq_id, header, seq) of a sequence given in code."""
    return spark.createDataFrame([(0, name, sequence)], "seq_id long, header string, seq string")
