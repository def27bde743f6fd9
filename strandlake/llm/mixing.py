"""Mixing sources to target weights by temperature, in DataFrame and SQL functions only.

A source with the share p of all tokens gets the weight p**a, normalised. The exponent a is
bisected between 1 (as found) and 0 (all alike), to the first value that meets a target entropy
or a limit on repetition. Weights become token budgets; a budget is realised as whole passes
over the source and a part of one more. In each pass the source's documents are dealt into
blocks by hash and permuted inside them, so no ordering ever spans a source: a part of a pass
is whole blocks up to one boundary block, which alone is cut by document.

Only sums and the sources' plan (a row each) are joined back to documents; the text is read
once to count and is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_back, id_key, materialize, named

#: Points of one bisection pass: 2**4 - 1, so a pass halves the interval four times.
_POINTS = 15
_PASSES = 7
#: Exponents are rounded to so many digits.
_DIGITS = 6
_NULL = "\x00"


@dataclass(frozen=True)
class Target:
    """Reach ``entropy`` (in nats) of the weights, or keep to ``max_repetition`` passes.

    Without ``budget`` (in tokens) the budget is the smallest that gives every source at least
    one whole pass, and repetition counts against the least repeated source."""

    entropy: float | None = None
    max_repetition: float | None = None
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: int = 1


def measure(docs: DataFrame) -> DataFrame:
    """(k, s, tokens): words of the whole text, and one more for the document's end."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.select(id_key().alias("k"), _source().alias("s"), (words.cast("long") + 1).alias("tokens"))


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(_NULL))


def _meets(target: Target, a: float, total: int) -> Column:
    """An aggregate over sources (column ``p``): whether exponent ``a`` meets the target."""
    weight = F.pow("p", F.lit(a))
    if target.entropy is not None:
        # H(w) = ln(sum) - sum(w ln w) / sum, unnormalised
        return F.log(F.sum(weight)) - F.sum(weight * F.log(weight)) / F.sum(weight) >= target.entropy - 1e-9
    passes = F.pow("p", F.lit(a - 1))
    most = F.max(passes)
    if target.budget is None:
        return most / F.min(passes) <= target.max_repetition + 1e-9
    return most / F.sum(weight) * target.budget / total <= target.max_repetition + 1e-9


def exponent(totals: DataFrame, target: Target) -> float:
    """Bisect the exponent over ``totals`` (s, total), an aggregate job per four halvings.

    For an entropy the largest exponent that reaches it; for a repetition limit the smallest
    that keeps it. If no exponent does, the nearer end of [0, 1]."""
    if target.entropy is None and target.max_repetition is None:
        return 1.0
    total = totals.agg(F.sum("total")).first()[0]
    if not total:
        return 1.0
    shares = totals.select((F.col("total") / F.lit(total)).alias("p"))
    falling = target.entropy is not None  # met for small exponents, not for large ones
    low, high = 0.0, 1.0
    for _ in range(_PASSES):
        points = [low + (high - low) * i / (_POINTS + 1) for i in range(_POINTS + 2)]
        met = shares.agg(*(_meets(target, a, total).alias(f"m{i}") for i, a in enumerate(points))).first()
        # the interval where the answer changes
        change = next((i for i in range(1, len(points)) if met[i] != met[i - 1]), None)
        if change is None:
            end = 0.0 if met[0] != falling else 1.0
            return round(points[-1] if end else points[0], _DIGITS)
        low, high = points[change - 1], points[change]
    return round(low if falling else high, _DIGITS)


def _hash(seed: int, epoch: Column) -> Column:
    """The hash that places a document in a pass."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_back(F.col("k")).cast("string"), F.lit(""))))


def _block(hashed: Column, blocks: Column) -> Column:
    """A block number below ``blocks`` from the first seven hex digits."""
    value = F.conv(F.substring(hashed, 1, 7), 16, 10).cast("long")
    return F.pmod(value, blocks)


def plan(measured: DataFrame, target: Target) -> DataFrame:
    """One row per source: s, total, weight, tokens_wanted, passes, blocks, and the place where
    the last, partial pass ends: (cut_block, cut_hash, cut_k)."""
    totals = materialize(measured.groupBy("s").agg(F.sum("tokens").alias("total")), "totals")
    a = exponent(totals, target)
    # sums over all sources are one row each, so the cross joins add columns and no rows
    sums = totals.agg(F.sum("total").alias("all"))
    weights = totals.crossJoin(F.broadcast(sums)).withColumn("raw", F.pow(F.col("total") / F.col("all"), F.lit(a)))
    norm = weights.agg(F.sum("raw").alias("norm"), F.max(F.col("total") / F.col("raw")).alias("cover"))
    weights = weights.crossJoin(F.broadcast(norm)).withColumn("weight", F.col("raw") / F.col("norm"))
    wanted = F.col("raw") * F.col("cover") if target.budget is None else F.col("weight") * target.budget
    weights = weights.withColumn("wanted", F.round(wanted).cast("long")).select(
        "s",
        "total",
        "weight",
        "wanted",
        F.expr("wanted div total").alias("passes"),
        F.expr("wanted % total").alias("rest"),
        F.ceil(F.col("total") / F.lit(target.block_tokens)).cast("long").alias("blocks"),
    )
    weights = materialize(weights, "weights")
    dealt = measured.join(weights.where("rest > 0"), "s").withColumn("h", _hash(target.seed, F.col("passes")))
    dealt = dealt.withColumn("block", _block(F.col("h"), F.col("blocks"))).select("s", "k", "tokens", "h", "block", "rest")
    sums_ = dealt.groupBy("s", "block", "rest").agg(F.sum("tokens").alias("size"))
    upto = W.partitionBy("s").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = sums_.withColumn("upto", F.sum("size").over(upto)).where("upto > rest and upto - size <= rest")
    edge = materialize(edge.select("s", "block", (F.col("rest") - F.col("upto") + F.col("size")).alias("room")), "edges")
    # one block per source is cut by document
    order = W.partitionBy("s").orderBy("h", "k").rangeBetween(W.unboundedPreceding, W.currentRow)
    cut = dealt.join(edge, ["s", "block"]).withColumn("upto", F.sum("tokens").over(order)).where("upto <= room")
    last = cut.groupBy("s").agg(F.max(F.struct("h", "k")).alias("last"))
    return (
        weights.join(edge.select("s", F.col("block").alias("cut_block")), "s", "left")
        .join(last, "s", "left")
        .select("s", "total", "weight", "wanted", "passes", "blocks", "cut_block", F.col("last.h").alias("cut_hash"), F.col("last.k").alias("cut_k"))
    )


def _copies(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with k and s) once per pass that has them, with epoch, h and block."""
    joined = rows.join(planned.select("s", "passes", "blocks", "cut_block", "cut_hash", "cut_k"), "s")
    h, block = F.col("h_part"), F.col("block_part")
    joined = joined.withColumn("h_part", _hash(seed, F.col("passes"))).withColumn("block_part", _block(F.col("h_part"), F.col("blocks")))
    before = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (F.col("k") <= F.col("cut_k")))
    partial = F.coalesce((block < F.col("cut_block")) | ((block == F.col("cut_block")) & before), F.lit(False))
    count = F.col("passes") + partial.cast("long")
    epochs = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))
    out = joined.withColumn("epoch", F.explode(epochs)).withColumn("h", _hash(seed, F.col("epoch")))
    return out.withColumn("block", _block(F.col("h"), F.col("blocks"))).drop("h_part", "block_part", "passes", "blocks", "cut_block", "cut_hash", "cut_k")


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """The mixture's order: doc_id, source, tokens, epoch, block, position.

    A document comes once per pass of its source that has it; (epoch, block, position) is its
    place in the source's block permutation. A partial pass ends before the document that
    would exceed the budget.

    Null source: a source of its own. Null or empty text: one token, its end. Null doc_id:
    hashed as the empty string. Repeated rows: placed side by side and kept or cut together.
    Empty table: empty result. Other columns are ignored."""
    measured = materialize(measure(docs), "measured")
    planned = materialize(plan(measured, target), "plan")
    place = W.partitionBy("s", "epoch", "block").orderBy("h", "k")
    return _copies(measured, planned, target.seed).select(
        id_back(F.col("k")).alias("doc_id"),
        F.nullif(F.col("s"), F.lit(_NULL)).alias("source"),
        "tokens",
        "epoch",
        "block",
        F.row_number().over(place).cast("long").alias("position"),
    )


def mixed_documents(docs: DataFrame, target: Target) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it, with all columns unchanged.

    Nulls, empty and very long texts, repeated rows and ties as in ``mix``; an empty table stays
    empty."""
    planned = materialize(plan(materialize(measure(docs), "measured"), target), "plan")
    whole = docs.select(F.struct(*named(docs)).alias("row"), id_key().alias("k"), _source().alias("s"))
    return _copies(whole, planned, target.seed).select("row.*")
