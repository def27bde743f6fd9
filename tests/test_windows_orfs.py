import random

import pytest

from pyspark.sql import functions as F

from strandlake.functions.genetic_code import GENETIC_CODE, with_nutrition
from strandlake.operators import orfs, windows

SHORT = "ATTGTCCCAATCTGTTG"


def noise(n, seed=3, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_sliding_counts(sequences):
    rows = windows.sliding_counts(sequences(SHORT), 5, 1).orderBy("win_idx").collect()
    assert len(rows) == 13
    assert [(r.a, r.c, r.g, r.t) for r in rows[:3]] == [(1, 0, 1, 3), (0, 1, 1, 3), (0, 2, 1, 2)]


@pytest.mark.parametrize("window, step", [(3, 1), (50, 7), (3000, 11), (10, 30)])
def test_sliding_counts_of_long_sequences(sequences, window, step):
    text = noise(9000)
    rows = windows.sliding_counts(sequences(text, "AC"), window, step).orderBy("win_idx").collect()
    starts = range(0, len(text) - window + 1, step)
    assert [r.g for r in rows] == [text[i : i + window].count("G") for i in starts]
    assert [r.windows for r in windows.window_counts(sequences(text, "AC"), window, step).orderBy("seq_id").collect()] == [len(starts), 0]


def test_downsampling(sequences):
    df = sequences(noise(400))
    full = windows.sliding_counts(df, 10, 1).orderBy("win_idx").collect()
    rows = windows.downsampled(df, 10, 1, 50).orderBy("bucket").collect()
    per = -(-len(full) // 50)
    assert [r.windows for r in rows] == [len(full[i : i + per]) for i in range(0, len(full), per)]
    assert [r.a for r in rows] == [sum(x.a for x in full[i : i + per]) for i in range(0, len(full), per)]
    assert windows.downsampled(df, 10, 1, 10_000).count() == len(full)
    reduced = windows.series(df, 10, 1, full=100, points=50)
    assert reduced.count() == len(rows)
    assert windows.series(df, 10, 1).count() == len(full)
    assert windows.reduce_series(windows.series(df, 10, 1), 20).count() <= 20


def test_tm_bins_and_merge(sequences):
    text = noise(3000, 5, "ACGTN")
    bases = text.replace("N", "")
    gc = [sum(c in "GC" for c in bases[i : i + 9]) for i in range(len(bases) - 8)]
    df = sequences(text, "ACG")
    rows = windows.tm_bins(df, windows_per_bin=256).orderBy("bin").collect()
    parts = [gc[i : i + 256] for i in range(0, len(gc), 256)]
    assert [r.n for r in rows] == [len(p) for p in parts]
    assert [r.sum_tm for r in rows] == [sum(18 + 2 * g for g in p) for p in parts]
    assert [r.max_tm for r in rows] == [18 + 2 * max(p) for p in parts]
    merged = windows.merge_bins(windows.tm_bins(df, windows_per_bin=256), 3)
    assert merged.count() <= 3 and merged.agg(F.sum("n")).first()[0] == len(gc)
    assert windows.merge_bins(windows.tm_bins(df, windows_per_bin=256), 1000).count() == len(parts)
    summary = windows.tm_summary(windows.tm_bins(df, windows_per_bin=256)).first()
    assert (summary.windows, summary.bins, summary.min_tm) == (len(gc), len(parts), 18 + 2 * min(gc))
    salt = windows.tm_bins(df, windows_per_bin=256, sodium=0.05).orderBy("bin").first()
    assert abs(salt.mean_tm - (windows.S.salt_constant(0.05) - 600 / 9 + 41 / 9 * sum(parts[0]) / len(parts[0]))) < 1e-9


def test_thresholds_and_chart(sequences):
    bins = windows.tm_bins(sequences(noise(2000)), windows_per_bin=256)
    means = [r.mean_tm for r in bins.collect()]
    default = windows.thresholds(bins).collect()
    assert abs(default[0].threshold - sum(means) / len(means)) < 1e-9
    assert windows.thresholds(bins, [20.0, 40.0]).count() == 2 * len(means)
    assert windows.parsed_thresholds(" 20, x,,3.5e1 ") == [20.0, 35.0]
    point = windows.chart(bins).first()
    assert point.y_low <= min(means) - 1 and point.y_high >= max(means) + 1


def loop_orfs(rna, min_len):
    """Reading frames by a plain walk."""
    out = []
    for frame in range(3):
        at = None
        for p in range(frame, len(rna) - 2, 3):
            codon = rna[p : p + 3]
            if at is None and codon == "AUG":
                at = p
            elif codon in ("UAA", "UAG", "UGA"):
                if at is not None and p - at >= min_len:
                    out.append((frame, at, p, True))
                at = None
        if at is not None and len(rna) - at >= min_len:
            out.append((frame, at, len(rna) - (len(rna) - at) % 3, False))
    return sorted(out)


def test_orfs_against_a_walk(sequences):
    texts = [noise(n, n) for n in (0, 1, 2, 3, 50, 700, 6000)] + ["ATGAAATAG", "ATG" + "AAA" * 40]
    rna = orfs.rna_of(sequences(*texts))
    got = {}
    for r in orfs.open_reading_frames(rna, 9).collect():
        got.setdefault(r.seq_id, []).append((r.frame, r.start, r.end, r.terminated))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == loop_orfs(text.replace("T", "U"), 9), i


def test_codon_usage_and_amino_acids(sequences):
    rna = orfs.rna_of(sequences("ATGGCCGCCNNNTAA", "ATGGCC"))
    found = orfs.orf_sequences(rna, 3)
    usage = orfs.codon_usage(found)
    assert {r.codon: r.n for r in usage.collect()} == {"AUG": 2, "GCC": 3}
    top = orfs.top_codons(usage, 1).collect()
    assert [(r.rank, r.codon, r.n) for r in top] == [(1, "GCC", 3)]
    acids = orfs.amino_acids(usage)
    assert {r.aa: r.n for r in acids.collect()} == {"M": 2, "A": 3}
    ranked = orfs.top_amino_acids(acids)
    assert [r.aa for r in orfs.union_in_order(ranked, ranked).orderBy("ord").collect()] == ["A", "M"]
    assert [r.codon for r in orfs.common(orfs.top_codons(usage), orfs.top_codons(usage)).collect()] == ["GCC", "AUG"]
    food = {r.aa: r for r in with_nutrition(acids).collect()}
    assert food["A"].name == "A" and food["A"].low_foods == ["Fruits", "Oils/fats"]


def test_translation(sequences):
    df = orfs.rna_of(sequences("ATGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG", "CCC", "CATGNN", ""))
    by_orf = [r.protein for r in orfs.translate_orf(df).orderBy("seq_id").collect()]
    assert by_orf == ["MAIVMGR", "P", "M", ""]
    by_frame = [r.protein for r in orfs.translate_frame(df, 1).orderBy("seq_id").collect()]
    assert by_frame[0] == "MAIVMGR*KGAR*" and by_frame[2] == "HX"
    second = orfs.translate_frame(df, 2).orderBy("seq_id").first().protein
    rna = "AUGGCCAUUGUAAUGGGCCGCUGAAAGGGUGCCCGAUAG"[1:]
    assert second == "".join(GENETIC_CODE[rna[i : i + 3]] for i in range(0, len(rna) - 2, 3))
    with pytest.raises(ValueError):
        orfs.translate_frame(df, 4)
