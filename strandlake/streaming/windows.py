"""Rolling melting temperature over sequences that arrive in parts.

State per sequence is the last k - 1 bases, the number of windows so far, the part that comes next
and the parts that came before their turn, so parts of any size, in any order, give the windows
that the whole sequence would."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import sequences as S
from ..operators.windows import BIN_WINDOWS, K

OUTPUT = "seq_id long, bin long, sum_gc long, min_gc long, max_gc long, n long"
#: waiting holds early parts, as JSON of their bases by number.
STATE = "tail string, windows long, next_part long, waiting string"


def rolling_bins(parts: DataFrame, k: int = K, windows_per_bin: int = BIN_WINDOWS, first_part: int = 0) -> DataFrame:
    """A stream (seq_id, part_no, seq) to partial bins (seq_id, bin, sum_gc, min_gc, max_gc, n).

    Parts are numbered from ``first_part`` without gaps. A part that comes early waits until those
    before it have come, over any number of batches; one that comes again is ignored. Each batch adds
    its share of a bin; ``merged`` sums the shares."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, seen, turn, held = state.get if state.exists else ("", 0, first_part, "{}")
        waiting = {int(no): bases for no, bases in json.loads(held).items()}
        rows = pd.concat(list(frames))
        for no, bases in zip(rows["part_no"].tolist(), rows["seq"].fillna("").tolist()):
            if no >= turn:
                waiting.setdefault(no, bases)
        ready = []
        while turn in waiting:
            ready.append(waiting.pop(turn))
            turn += 1
        bases = tail + "".join(ready)
        count = len(bases) - k + 1
        if count > 0:
            flags = pd.Series([c in "GC" for c in bases], dtype="int64")
            gc = flags.rolling(k).sum().iloc[k - 1 :].astype("int64").reset_index(drop=True)
            grouped = gc.groupby((gc.index + seen) // windows_per_bin)
            out = grouped.agg(["sum", "min", "max", "count"]).reset_index()
            out.columns = ["bin", "sum_gc", "min_gc", "max_gc", "n"]
            out.insert(0, "seq_id", key[0])
            seen += count
            yield out
        state.update((bases[-(k - 1) :] if k > 1 else "", seen, turn, json.dumps(waiting)))

    clean = parts.select("seq_id", "part_no", S.acgt_only(F.col("seq")).alias("seq"))
    return clean.groupBy("seq_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def merged(shares: DataFrame) -> DataFrame:
    """Whole bins from the shares of all batches."""
    return shares.groupBy("seq_id", "bin").agg(F.sum("sum_gc").alias("sum_gc"), F.min("min_gc").alias("min_gc"), F.max("max_gc").alias("max_gc"), F.sum("n").alias("n"))


def symbol_counts(parts: DataFrame) -> DataFrame:
    """A stream (seq) to running counts (symbol, n), for complete or update mode."""
    letters = F.explode(F.filter(F.split(S.ascii_upper(F.col("seq")), ""), lambda c: c != ""))
    return parts.select(letters.alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
