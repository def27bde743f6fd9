import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.functions.genetic_code import GENETIC_CODE
from strandlake.operators import kmers, symbols, tiles

SHORT = "ATTGTCCCAATCTGTTG"


def test_alphabet_and_frequencies(sequences):
    df = sequences("ATTTCG*CCGATA")
    assert symbols.alphabets(df).first()[1:] == ("ATCG*", 5)
    got = {r.symbol: (r.n, r.freq) for r in symbols.symbol_frequencies(df).collect()}
    assert got == {"A": (3, 3 / 13), "T": (4, 4 / 13), "C": (3, 3 / 13), "G": (2, 2 / 13), "*": (1, 1 / 13)}


def test_alphabet_order_over_rows(sequences):
    got = symbols.alphabet_order(sequences("BA", "CAB")).orderBy("first_seq", "first_pos").collect()
    assert [(r.symbol, r.n) for r in got] == [("B", 2), ("A", 2), ("C", 1)]


def test_symbol_table_counts_hidden_symbols(sequences):
    got = symbols.symbol_table(sequences("ac é\t-A")).orderBy("ord").collect()
    assert [(r.symbol, r.n, r.pct) for r in got] == [("A", 2, 40.0), ("C", 1, 20.0), ("-", 1, 20.0)]


def test_histogram_has_all_codes(sequences):
    rows = {r.code: r.n for r in symbols.histogram(sequences("aAz")).collect()}
    assert len(rows) == 256 and rows[65] == 2 and rows[90] == 1 and sum(rows.values()) == 3


def test_records_and_summary(spark):
    rows = [(0, "", "AC G"), (1, "x" * 130, "A"), (2, None, None)]
    df = spark.createDataFrame(rows, "seq_id long, header string, seq string")
    got = symbols.record_lengths(df).orderBy("seq_id").collect()
    assert [r.len for r in got] == [3, 1, 0]
    assert got[1].header == "x" * 120 + "…" and got[2].header == "(no header)"
    assert symbols.fasta_summary(df).first()[:2] == (4, 3)
    assert symbols.fasta_summary(df).first().header_preview == got[1].header


def test_melting_temperatures(sequences):
    row = symbols.melting(sequences("ACGTACGTACGTACGTACGT")).first()
    assert (row.n, row.gc_pct, row.tm_wallace) == (20, 50.0, 60)
    assert math.isclose(row.tm_salt, 50.402902, abs_tol=1e-5)
    empty = symbols.melting(sequences("", None)).collect()
    assert all(r.n == 0 and r.tm_salt is None and r.gc_pct is None for r in empty)
    assert symbols.melting(sequences("ACGT"), sodium=-1).first().tm_salt is not None
    with pytest.raises(ValueError):
        S.salt_constant(0)


def test_validate(sequences):
    got = symbols.validate(sequences("acgt", "ACXT", "", None)).orderBy("seq_id").collect()
    assert [(r.valid, r.bad) for r in got] == [(True, None), (False, "X"), (False, None), (False, None)]


@pytest.mark.parametrize("k, windows, distinct", [(2, 16, 9), (3, 15, 13)])
def test_kmers(sequences, k, windows, distinct):
    df = sequences(SHORT)
    rows = kmers.kmer_frequencies(df, k).orderBy("kmer").collect()
    assert len(rows) == 4**k and rows[0].kmer == "A" * k
    assert sum(r.n for r in rows) == windows and math.isclose(sum(r.freq for r in rows), 1.0)
    assert kmers.distinct_kmers(df, k).first().n_distinct == distinct
    order = [r.kmer for r in kmers.kmer_presence(df, k).orderBy("first_pos").collect()]
    assert order == list(dict.fromkeys(SHORT[i : i + k] for i in range(windows)))


def test_kmers_of_short_sequences(sequences):
    df = sequences("A", "", None)
    assert all(r.n == 0 and r.freq == 0.0 for r in kmers.kmer_frequencies(df, 2).collect())
    assert kmers.distinct_kmers(df, 2).count() == 3
    assert [r.kmer for r in kmers.kmer_presence(sequences("ABAA"), 2).orderBy("first_pos").collect()] == ["AB", "BA", "AA"]


def test_tiles_equal_whole(sequences):
    text = "".join(random.Random(1).choice("ACGT\n") for _ in range(5000))
    df = sequences(text, "AC")
    for size in (7, 64, 2048):
        got = {(r.seq_id, r.pos): r.gram for r in tiles.grams(df, 5, size).collect()}
        assert got == {(0, i): text[i : i + 5] for i in range(len(text) - 4)}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("aß cT\t",)], "s string")
    row = df.select(
        S.ascii_upper(F.col("s")).alias("u"),
        S.to_rna(F.col("s")).alias("r"),
        S.wrapped(F.lit("abcdef"), 3).alias("w"),
        S.wrapped(F.lit("abcdefg"), 3).alias("v"),
        S.preview(F.array([F.lit(float(i)) for i in range(3)]), 2).alias("p"),
        S.base_index(F.lit("G")).alias("g"),
        S.gc_flag(F.lit("c")).alias("f"),
        S.gc_flag(F.lit("N")).alias("x"),
    ).first()
    assert tuple(row) == ("Aß CT\t", "AßCU\t", "abc\ndef", "abc\ndef\ng", "0.000, 1.000 … (+1 more)", 2, 1, None)


def test_genetic_code():
    assert len(GENETIC_CODE) == 64 and GENETIC_CODE["AUG"] == "M" and [GENETIC_CODE[s] for s in S.STOPS] == ["*"] * 3


@pytest.mark.parametrize("k", [1, 3, 15, 40])
def test_kmers_of_any_text(sequences, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("ACGT", 200), ("AÄß漢😀 ", 90), ("A", 70), ("ACGT", k), ("", 0))]
    texts.append("".join(chr(97 + rng.randrange(500)) for _ in range(150)))
    found = kmers.kmer_presence(sequences(*texts, None), k).collect()
    want = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - k + 1):
            n, first = want.get((i, t[p : p + k]), (0, p))
            want[i, t[p : p + k]] = (n + 1, first)
    assert {(r.seq_id, r.kmer): (r.n, r.first_pos) for r in found} == want
    counts = Counter()
    for (_, kmer), (n, _) in want.items():
        counts[kmer] += n
    assert {r.kmer: r.n for r in kmers.kmer_counts(sequences(*texts), k).collect()} == counts


@pytest.mark.parametrize("k,m", [(5, 5), (12, 4), (21, 9), (33, 20)])
def test_long_kmers_by_runs(sequences, k, m):
    rng = random.Random(k)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    texts = [base, base[50:300] + "nn" + base[:90].lower(), "A" * 200, "ACGT" * 30, base[:k], base[: k - 1], ""]
    clean = ["".join(c for c in t.upper() if c in "ACGT") for t in texts]
    want = Counter(t[i : i + k] for t in clean for i in range(len(t) - k + 1))
    df = kmers.long_kmer_counts(sequences(*texts, None), k, m)
    assert {r.kmer: r.n for r in df.collect()} == want
    # runs say of every window which it is, and are far fewer than windows
    _, begin, end = kmers.runs_of_kmers(clean[0].encode(), k, m)
    assert [i for a, b in zip(begin, end) for i in range(a, b - k + 1)] == list(range(len(base) - k + 1))


def test_long_kmers_are_listed_only_where_they_occur(sequences):
    got = kmers.kmer_frequencies(sequences("ACGT" * 10, "N" * 30), 14).collect()
    assert {r.kmer for r in got} == {("ACGT" * 5)[i : i + 14] for i in range(4)} and {r.total for r in got} == {27 + 17}


@pytest.mark.parametrize("k,windows", [(1, 8), (13, 100), (21, 7), (31, 1000), (70, 50)])
def test_base_kmers_by_numbers(sequences, k, windows):
    rng = random.Random(k)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    texts = [base, base[50:250] + "nß" + base[:90].lower() + "\U0001f600" + base[:80], "A" * 400, "ACGT" * 30, base[:k], base[: k - 1], "", "N" * 90]
    for clean in (False, True):
        want = Counter()
        for t in ("".join(c for c in t.upper() if c in "ACGT") if clean else t for t in texts):
            for i in range(len(t) - k + 1):
                want[t[i : i + k] if set(t[i : i + k]) <= set("ACGT") else None] += 1
        rows = kmers.base_kmer_counts(sequences(*texts, None), k, clean=clean, windows=windows).collect()
        assert len(rows) == len(want) and {r.kmer: r.n for r in rows} == want


def test_a_frequent_kmer_is_a_row_a_count(spark, sequences):
    """What meets in one task does not grow with how often a k-mer occurs, and no part has them all."""
    one, two = (kmers.base_kmer_counts(sequences("ACGT" * 2000 * n), 21) for n in (1, 2))
    for df, n in ((one, 7980), (two, 15980)):
        assert {r.n for r in df.collect()} <= {n // 4, n // 4 + 1} and df.count() == 4
    words, _ = kmers.base_windows(["".join(random.Random(1).choices("ACGT", k=50_000)).encode(), b"AT" * 9000], 21)
    parts = [(b, len(v) // 8) for batch in kmers._dealt(words, 0) for b, v in zip(batch.column("bucket").to_pylist(), batch.column("kmers").to_pylist())]
    assert len(parts) > 4000 and max(n for _, n in parts) < 50 and sum(n for _, n in parts) == len(np.unique(words))


def test_frequencies_of_the_bases_in_any_text(spark, sequences, capsys):
    """One pass over the texts, which is read for the total too; equal to cleaning them first."""
    df = sequences("ACGTnnACGT acgt", "hello GATTACA", "", None)
    for k in (2, 14):
        found = kmers.kmer_frequencies(df, k, clean=True)
        found.explain()
        assert "MapInArrow" not in capsys.readouterr().out
        before = kmers.kmer_frequencies(df.withColumn("seq", S.acgt_only(F.col("seq"))), k)
        assert sorted(found.collect()) == sorted(before.collect())
