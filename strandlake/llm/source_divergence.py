"""How the sources of a language differ in their words: an exact chi-square audit.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents. A group (language and
source) gives a kept term the smoothed share p = 1 + floor(10**9 (n + 1) / (N + V)); the
distance of a group with shares p from shares q sums floor((p - q)**2 / q) over all kept terms.

The sum over a pair of groups is split by how many groups have a term:

* *heavy* terms, of more than ``HEAVY`` groups, fill dense numpy tiles of shares, terms by
  groups, one for each block of terms and pair of blocks of groups, and add what differs from it;
* if all counts were zero, each term would add the same number, so the number of kept terms times
  it is the base, and terms that both groups lack are done with;
* *light* terms are never spread over the groups that lack them. A group's
  counts change it alike for all terms of the same count, so a histogram of counts stands for
  them. Only where two groups share a light term is something left: the pairs of a posting
  list, at most ``HEAVY`` long, correct it.

All partial sums are integers, so the split changes nothing."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, released, ship

#: Documents of a language that must have a term.
MIN_DOCS = 3
#: Terms of more groups than this are dense.
HEAVY = 8
#: Groups along a side of a tile, and terms in it on average.
SIDE = 64
TERMS = 1024
#: Ranks of the part ``term``.
TOP = 200
#: Distinct (language, source, term) that a task holds before it hands them on.
HELD = 200_000

SCALE = 1_000_000_000
#: Bytes that belong to terms stay (upper case lowered), others become blanks. Letters beyond
#: ASCII are bytes from 128 on in UTF-8, so this is the term rule on code points.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group; a
    group has one more row, whose term is null."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, texts) in held.items():
                terms = list(n)
                for lo in range(0, len(terms), 20_000):
                    part = terms[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part)),
                            pa.array([source] * len(part)),
                            pa.array(part, pa.binary()).cast(pa.string()),
                            pa.array([n[t] for t in part], pa.int64()),
                            pa.array([texts[t] for t in part], pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                group = (lang, source)
                seen.add(group)
                own = Counter(text.as_py().translate(_FOLD).split())
                n, found = held[group]
                size -= len(n)
                n.update(own)
                found.update(own.keys())
                size += len(n)
                if size > most:
                    yield from handed_on()
                    size = 0
        yield from handed_on()
        groups = sorted(seen)
        if groups:
            null = pa.nulls(len(groups), pa.string())
            zero = pa.array([0] * len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups]), pa.array([g[1] for g in groups]), null, zero, zero], ["lang", "source", "term", "n", "docs"])

    ship(docs.sparkSession)
    schema = "lang string, source string, term string, n long, docs long"
    return rows.mapInArrow(released(run), schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, of: Column) -> Column:
    """1 + floor(10**9 (n + 1) / of) by long division in thousands, which no count overflows."""
    whole, rest = F.lit(0).cast("long"), (n + 1).cast("long")
    of = F.greatest(of, F.lit(1)).cast("long")
    for _ in range(3):
        whole, rest = whole * 1000 + _div(rest * 1000, of), (rest * 1000) % of
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(n: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """``_share`` in numpy."""
    whole, rest = np.zeros_like(n), n + 1
    of = np.maximum(of, 1)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + more
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _light_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of the pairs in the posting lists of light terms, summed by pair."""
    names = ["lang", "g", "h", "value"]
    held: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            keys = np.fromiter(found, np.int64, len(found))
            values = np.fromiter(found.values(), np.int64, len(found))
            for lo in range(0, len(keys), 50_000):
                k = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k >> 31), pa.array(k & 0x7FFFFFFF), pa.array(values[lo : lo + 50_000])], names)
        held.clear()

    for batch in batches:
        postings = batch.column("postings")
        ends = postings.offsets.to_numpy()
        flat = postings.flatten()
        g, n, of = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "n", "of"))
        coded = batch.column("lang").dictionary_encode()
        codes, names_of = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        sizes = np.diff(ends)
        starts = ends[:-1] - ends[0]
        for size in np.unique(sizes[sizes > 1]):
            at = np.flatnonzero(sizes == size)
            places = starts[at][:, None] + np.arange(size)
            p, zero = shares(n[places], of[places]), shares(np.zeros_like(n[places]), of[places])
            px, py, zx, zy = p[:, :, None], p[:, None, :], zero[:, :, None], zero[:, None, :]
            change = apart(px, py) - apart(px, zy) - apart(zx, py) + apart(zx, zy)
            pair = (g[places][:, :, None] << 31) | g[places][:, None, :]
            other = ~np.eye(size, dtype=bool)
            for code in np.unique(codes[at]):
                mine = codes[at] == code
                keys, back = np.unique(pair[mine][:, other], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, back.ravel(), change[mine][:, other].ravel())
                found = held[names_of[code]]
                for k, v in zip(keys.tolist(), sums.tolist()):
                    found[k] += v
        if sum(map(len, held.values())) > HELD:
            yield from handed_on()
    yield from handed_on()


def _tile(table: pa.Table, side: int) -> pa.Table:
    """One tile: groups (kind 0), and either heavy terms (kind 1) or, in part -1, histograms of the
    counts of light terms (kind 2), of both of its blocks of groups."""
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    light_part = table.column("part")[0].as_py() < 0
    kind, g, n, many, of = (table.column(c).to_numpy() for c in ("kind", "g", "n", "many", "of"))
    here = kind == 0
    order = np.argsort(g[here])
    groups, totals, kept = g[here][order], of[here][order], int(many[here].max())
    ia, ib = np.flatnonzero(groups // side == a), np.flatnonzero(groups // side == b)
    zero = shares(np.zeros(len(groups), np.int64), totals)
    sums = np.zeros((len(groups), len(groups)), np.int64)

    def both_ways(one: np.ndarray, two: np.ndarray, added) -> None:
        for x, y in ((one, two), (two, one)) if a != b else ((one, two),):
            added(x, y)

    if not light_part:
        dense = kind == 1
        coded = table.column("term").combine_chunks().filter(pa.array(dense)).dictionary_encode()
        row = coded.indices.to_numpy()
        counts = np.zeros((len(coded.dictionary), len(groups)), np.int64)
        counts[row, np.searchsorted(groups, g[dense])] = n[dense]
        p = shares(counts, totals[None, :])

        def terms_of(x: np.ndarray, y: np.ndarray) -> None:
            for i in x:
                sums[i, y] += (apart(p[:, i : i + 1], p[:, y]) - apart(zero[i], zero[y])[None, :]).sum(axis=0)

        both_ways(ia, ib, terms_of)
    else:
        where = kind == 2
        own = np.searchsorted(groups, g[where])
        p, times = shares(n[where], of[where]), many[where]

        def base(x: np.ndarray, y: np.ndarray) -> None:
            sums[np.ix_(x, y)] += kept * apart(zero[x][:, None], zero[y][None, :])

        def outgoing(x: np.ndarray, y: np.ndarray) -> None:
            """The counts of the groups x against the zeros of y, and the zeros of x against the counts of y."""
            for i in x:
                mine = own == i
                sums[i, y] += (times[mine][:, None] * (apart(p[mine][:, None], zero[y][None, :]) - apart(zero[i], zero[y])[None, :])).sum(axis=0)
            for j in y:
                theirs = own == j
                sums[x, j] += (times[theirs][None, :] * (apart(zero[x][:, None], p[theirs][None, :]) - apart(zero[x], zero[j])[:, None])).sum(axis=1)

        both_ways(ia, ib, base)
        both_ways(ia, ib, outgoing)
    x, y = np.nonzero(~np.eye(len(groups), dtype=bool))
    wanted = ((groups[x] // side == a) & (groups[y] // side == b)) | ((groups[x] // side == b) & (groups[y] // side == a))
    x, y = x[wanted], y[wanted]
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "g": pa.array(groups[x], pa.int64()), "h": pa.array(groups[y], pa.int64()), "value": pa.array(sums[x, y], pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, heavy: int = HEAVY, top: int = TOP, side: int = SIDE, tile_terms: int = TERMS, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language and the group's distance from it. Part
    ``term``: the kept terms that the group has more often than its language, by how much, up to
    rank ``top``. Ranks count from 1, by value descending, then item ascending by code point.

    Null language, source and text are read as empty; an empty text or language adds a group
    without terms. A language without kept terms has distances of 0 and no terms. Very long texts
    are counted whole; repeated rows count each. No two items of a part are equal, so ties in value
    have an order. An empty table gives an empty result; other columns are ignored."""
    if min(heavy, side, tile_terms, held) < 1:
        raise ValueError("limits must be positive")
    found = materialize(term_counts(docs, held), "terms")
    per_term = W.partitionBy("lang", "term")
    whole = {"docs": F.sum("docs"), "lang_n": F.sum("n"), "groups": F.count("*")}
    no = F.row_number().over(per_term.orderBy("source"))
    kept = found.where("term is not null").select("lang", "source", "term", "n", *(f.over(per_term).alias(c) for c, f in whole.items()), no.alias("no"))
    kept = materialize(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # what holds for a term is in each of its rows, so its first one stands for it
    vocabulary = kept.where("no = 1").groupBy("lang").agg(
        F.count("*").alias("v"), F.sum((F.col("groups") > heavy).cast("long")).alias("dense"), F.sum("lang_n").alias("lang_total")
    )
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = found.where("term is null").select("lang", "source", number.alias("g")).join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", "g", *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "dense", "lang_total")))
    groups = materialize(groups.withColumn("of", F.col("total") + F.col("v")), "groups")

    postings = kept.join(groups, ["lang", "source"])
    light = postings.where(F.col("groups") <= heavy)
    lists = light.where("groups > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("g", "n", "of")).alias("postings"))
    ship(docs.sparkSession)
    result = "lang string, g long, h long, value long"
    shared = lists.select("lang", "postings").mapInArrow(released(_light_pairs), result)

    # blocks of groups are counted from 0; a tile holds the blocks a <= b
    block = _div(F.col("g"), F.lit(side))
    blocks = groups.groupBy("lang").agg(F.max(block).alias("last"))
    tile_of = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda o: F.struct(F.least(block, o).alias("a"), F.greatest(block, o).alias("b")))).alias("_t")
    rows = ["lang", "kind", "g", "n", "many", "of", "part", "term"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(blocks, "lang").select(*rows, tile_of).select(*rows, "_t.a", "_t.b")

    parts = F.greatest(_div(F.col("dense") + tile_terms - 1, F.lit(tile_terms)), F.lit(1)).cast("long")
    dense = postings.where(F.col("groups") > heavy).select("lang", F.lit(1).alias("kind"), "g", "n", zero.alias("many"), "of", F.pmod(F.xxhash64("term"), parts).alias("part"), "term")
    counts = light.groupBy("lang", "g", "n", "of").agg(F.count("*").alias("many"))
    histogram = counts.select("lang", F.lit(2).alias("kind"), "g", "n", "many", "of", F.lit(-1).cast("long").alias("part"), F.lit("").alias("term"))
    numbered = F.explode(F.sequence(F.lit(-1).cast("long"), F.when(F.col("dense") > 0, parts - 1).otherwise(-1))).alias("part")
    heads = groups.select("lang", F.lit(0).alias("kind"), "g", zero.alias("n"), F.col("v").alias("many"), "of", numbered, F.lit("").alias("term"))
    tiles = dealt(heads.unionByName(dense).unionByName(histogram)).groupBy("lang", "a", "b", "part").applyInArrow(lambda table: _tile(table, side), result)

    sums = tiles.unionByName(shared).groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    named = lambda on, name: groups.select("lang", F.col("g").alias(on), F.col("source").alias(name))
    pairs = sums.join(named("g", "source"), ["lang", "g"]).join(named("h", "item"), ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = _share(F.col("n"), F.col("of")), _share(F.col("lang_n"), F.col("lang_total") + F.col("v"))
    more = postings.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    above = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.withColumn("rank", rank)
    return ranked(pairs).unionByName(ranked(above).where(F.col("rank") <= top))
