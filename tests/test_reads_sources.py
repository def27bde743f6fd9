import gzip
import json
import random

import pytest

from pyspark.sql import functions as F

from strandlake.operators import reads
from strandlake.plans import reports
from strandlake.sources import fasta, sinks
from strandlake.streaming import windows as streaming

FILE = ">one first\nACGT\n acg t\n\n>two\r\nTTNN\r\nGG\n>three\n"


@pytest.fixture()
def path(tmp_path):
    file = tmp_path / "a.fa"
    file.write_bytes(FILE.encode())
    return str(file)


def test_records(spark, path):
    got = fasta.records(spark, path).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == [("one first", "ACGTacg t"), ("two", "TTNNGG"), ("three", "")]


def test_leading_lines_and_missing_headers(spark, tmp_path):
    (tmp_path / "lead.fa").write_text("AC\n>x\nGG\n")
    (tmp_path / "bare.fa").write_text("acgt\nac\n")
    lead, bare = str(tmp_path / "lead.fa"), str(tmp_path / "bare.fa")
    assert [(r.header, r.seq) for r in fasta.records(spark, lead).collect()] == [("x", "GG")]
    assert fasta.records(spark, bare).count() == 0
    assert [(r.header, r.seq) for r in fasta.statistics_records(spark, lead).collect()] == [("x", "ACGG")]
    assert [(r.header, r.seq) for r in fasta.statistics_records(spark, bare).collect()] == [("(no header)", "ACGTAC")]


def test_concatenating_readers(spark, path, tmp_path):
    assert fasta.acgt(spark, path).first().seq == "ACGTACGTTTGG"
    assert fasta.raw_or_fasta(spark, path).first().seq == "ACGTACG TTTNNGG"
    assert fasta.single(spark, path).first().seq == "ACGTACGTTTGG"
    empty = tmp_path / "none.fa"
    empty.write_text(">x\nNNN\n")
    with pytest.raises(ValueError):
        fasta.acgt(spark, str(empty))


def test_gzip_by_name_and_by_content(spark, tmp_path):
    data = gzip.compress(FILE.encode())
    (tmp_path / "b.fa.gz").write_bytes(data)
    (tmp_path / "c.bin").write_bytes(data)
    assert fasta.records(spark, str(tmp_path / "b.fa.gz")).count() == 3
    got = fasta.sniffed(spark, str(tmp_path / "c.bin")).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == [("one first", "ACGTacg t"), ("two", "TTNNGG"), ("three", "")]
    assert fasta.file_sizes(spark, str(tmp_path / "c.bin")).first().file_size == len(data)


def test_labels(spark, path):
    records = fasta.records(spark, path)
    got = fasta.labelled(records, {"a": "one", "b": "two"}).orderBy("seq_id").collect()
    assert [r.genome for r in got] == ["a", "b"]
    with pytest.raises(ValueError):
        fasta.labelled(records, {"a": "none"})
    assert fasta.paired(spark, {"x": path, "y": path}).count() == 6


def test_report(spark, path):
    report = reports.fasta_report(spark, path)
    assert report["summary"].first()[:2] == (14, 3)
    assert {r.symbol: r.n for r in report["symbols"].collect()}["T"] == 4


def test_sinks(spark, path, tmp_path):
    sinks.write_fasta(fasta.records(spark, path), str(tmp_path / "out"), 5, order="seq_id")
    again = fasta.records(spark, str(tmp_path / "out")).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in again] == [("one first", "ACGTacg t"), ("two", "TTNNGG"), ("three", "")]
    told = json.loads(sinks.nutrition_json(["L", "A"], ["S"]))
    assert told["amino_acids"]["A"]["low_foods"] == ["Fruits", "Oils/fats"] and told["top_amino_acids"]["influenza"] == ["S"]
    assert "- Low in: Fruits, Oils\n" in sinks.nutrition_markdown(["A"], [])
    facts = dict(ref_len=9, reads=2, min_len=1, max_len=3, k=2, contig_len=5, ref_in_contig=False, contig_in_ref=True, shift=1, identity=0.5)
    assert sinks.assembly_report(facts).startswith("=== Assembly Report (Exercise 1) ===\nReference length: ")
    assert "Contig ⊂ Reference? YES" in sinks.assembly_report(facts) and "0.5000" in sinks.assembly_report(facts)


def grow(seqs, k):
    """Greedy assembly on the contig's text."""
    contig = max(seqs, key=len)
    left = [s for s in seqs if s is not contig]
    changed = True
    while changed:
        changed = False
        for end in ("right", "left"):
            while len(contig) >= k:
                fits = [s for s in left if len(s) >= k and (contig[-k:] == s[:k] if end == "right" else contig[:k] == s[-k:])]
                if not fits:
                    break
                left.remove(fits[0])
                contig = contig + fits[0][k:] if end == "right" else fits[0][: len(fits[0]) - k] + contig
                changed = True
    return contig


@pytest.mark.parametrize("seed", range(4))
def test_assembly_against_text_growth(spark, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    rows = [(0, i, text[s : s + n]) for i, s, n in reads.sample_plan(300, 60, 20, 40, seed)]
    df = spark.createDataFrame(rows, "assembly_id int, read_id int, seq string")
    unique = reads.unique_reads(df, ("assembly_id",))
    listed = list(dict.fromkeys(r[2] for r in rows))
    assert [r.seq for r in unique.orderBy("uid").collect()] == listed
    assert reads.assemble(unique, 8).first().contig == grow(listed, 8)
    longest = reads.assemble(unique, 8, "longest").first()
    # a read that is joined by its longest overlap stays whole in the contig
    assert sum(r in longest.contig for r in listed) >= longest.reads_used > 1
    assert len(longest.contig) >= max(map(len, listed))


def test_read_sampling(spark, sequences):
    assert [p[1:] for p in reads.sample_plan(1541)[:3]] == [(228, 140), (563, 101), (457, 115)]
    df = sequences("ACGT" * 50)
    got = reads.sample_reads(df, 20, 10, 15, 1).collect()
    assert all(r.seq == ("ACGT" * 50)[r.start : r.start + r.len] for r in got) and len(got) == 20
    many = reads.sample_reads_at_scale(df, 20, 10, 15).collect()
    assert all(r.seq == ("ACGT" * 50)[r.start : r.start + r.len] and 10 <= r.len <= 15 for r in many)
    with pytest.raises(ValueError):
        reads.checked_reference(df)


def test_overlaps_and_seed(spark):
    df = spark.createDataFrame([(0, 0, "ACGT"), (0, 1, "GTCC"), (0, 2, "GTCC"), (0, 3, "A")], "assembly_id int, read_id int, seq string")
    unique = reads.unique_reads(df, ("assembly_id",))
    assert [(r.left_uid, r.right_uid) for r in reads.overlaps(unique, 2, ("assembly_id",)).collect()] == [(0, 1)]
    assert reads.seed_read(unique, ("assembly_id",)).first().seq == "ACGT"
    pair = spark.createDataFrame([("AAGAG", "AGAGC")], "a string, b string")
    assert pair.select(reads.overlap_length(F.col("a"), F.col("b"), 2)).first()[0] == 2
    assert pair.select(reads.overlap_length(F.col("b"), F.col("a"), 2)).first()[0] == 0


def aligned(a, b):
    """The best shift from its definition: pad the longer sequence and compare every window of it.
    A shift is positive if ``b`` is the shorter one or both are equally long."""
    short, long_, sign = (a, b, -1) if len(a) < len(b) else (b, a, 1)
    m = len(short)
    padded = "-" * (m - 1) + long_ + "-" * (m - 1)
    scores = {}
    for begin in range(len(padded) - m + 1):
        pairs = [(x, y) for x, y in zip(short, padded[begin : begin + m]) if y != "-"]
        scores[begin - m + 1] = sum(x == y for x, y in pairs) / len(pairs)
    top = max(scores.values())
    return (min(k for k, v in scores.items() if v == top) * sign, top) if top else (0, 0.0)


def test_identity(spark):
    rng = random.Random(2)
    pairs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 12)))) for i in range(20)]
    pairs.append((20, "AA", "CC"))
    df = spark.createDataFrame(pairs, "pair_id long, a string, b string")
    got = {r.pair_id: (r.shift, r.identity) for r in reads.best_shift(reads.identity_profile(df)).collect()}
    for i, a, b in pairs:
        assert got[i] == aligned(a, b)
    inside = {r.pair_id: (r.a_in_b, r.b_in_a) for r in reads.containment(df).collect()}
    assert inside == {i: (a in b, b in a) for i, a, b in pairs}


def test_placement_of_long_sequences(spark):
    rng = random.Random(12)
    whole = "".join(rng.choice("ACGTN") for _ in range(20_000))
    pairs = [(0, whole, whole[7_000:9_000]), (1, whole[150:700], whole), (2, whole, whole[::-1]), (3, "Äß" * 100, "ßÄ" * 90), (4, None, "A"), (5, "", "A")]
    profile = reads.identity_profile(spark.createDataFrame(pairs, "pair_id long, a string, b string"), 50)
    best = {r.pair_id: (r.shift, r.identity) for r in reads.best_shift(profile).collect()}
    assert best[0] == (7_000, 1.0) and best[1] == (-150, 1.0) and best[3][1] == 1.0 and not {4, 5} & set(best)
    some = {(r.pair_id, r.off): r.matches for r in profile.where("pair_id = 2 and off % 997 = 0").collect()}
    assert some and all(n == sum(x == y for x, y in zip(whole[::-1][max(0, -off) :], whole[max(0, off) :])) for (_, off), n in some.items())


def longest_by_text(seqs, k):
    """Greedy assembly that looks at every read and every overlap in each step."""
    contig = max(seqs, key=len)
    left = list(range(len(seqs)))
    left.remove(seqs.index(contig))
    for turn in (False, True):
        flip = (lambda t: t[::-1]) if turn else (lambda t: t)
        now = flip(contig)
        while len(contig) >= k:
            fits = [(n, -i) for i in left for n in range(k, min(len(seqs[i]), len(now)) + 1) if now.endswith(flip(seqs[i])[:n])]
            if not fits:
                break
            n, i = max(fits)
            now += flip(seqs[-i])[n:]
            left.remove(-i)
        contig = flip(now)
    return contig


@pytest.mark.parametrize("seed", range(3))
def test_longest_assembly_equals_a_search_of_all_overlaps(spark, seed):
    rng = random.Random(seed)
    rows = []
    for a in range(12):
        text = "".join(rng.choice("ACGT"[: 2 + a % 3]) for _ in range(150))
        rows += [(a, i, text[s : s + n]) for i, s, n in reads.sample_plan(150, 25, 5, 30, seed + a)]
    unique = reads.unique_reads(spark.createDataFrame(rows, "assembly_id int, read_id int, seq string"), ("assembly_id",))
    got = {r.assembly_id: r.contig for r in reads.assemble(unique, 6, "longest").collect()}
    for a in range(12):
        assert got[a] == longest_by_text(list(dict.fromkeys(r[2] for r in rows if r[0] == a)), 6)
    exact = {r.assembly_id: r.contig for r in reads.assemble(unique, 6).collect()}
    assert exact == {a: grow(list(dict.fromkeys(r[2] for r in rows if r[0] == a)), 6) for a in range(12)}


def test_overlap_graph_and_its_reduction(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACG") for _ in range(120))
    rows = [(i // 30, i, text[s : s + n]) for i, s, n in reads.sample_plan(120, 60, 8, 30, 3)]
    unique = reads.unique_reads(spark.createDataFrame(rows, "g int, read_id int, seq string"), ("g",))
    seqs = {(r.g, r.uid): r.seq for r in unique.collect()}
    graph = reads.overlap_graph(unique, 5, ("g",))
    want = {}
    for (g, u), a in seqs.items():
        for (h, v), b in seqs.items():
            fits = [n for n in range(5, min(len(a), len(b))) if a.endswith(b[:n])] if g == h and u != v else []
            if fits:
                want[g, u, v] = max(fits)
    assert {tuple(r)[:3]: r.overlap for r in graph.collect()} == want and want
    far = {e: len(seqs[e[:2]]) - n for e, n in want.items()}
    implied = {(g, u, w) for (g, u, v), x in far.items() for (h, t, w), y in far.items() if g == h and v == t and far.get((g, u, w)) == x + y}
    assert {tuple(r)[:3] for r in reads.reduced_graph(graph, unique, ("g",)).collect()} == set(want) - implied and implied


def test_sampling_by_coverage(spark, sequences):
    df = sequences("ACGT" * 500, "ACG", "", None, "A" * 45)
    got = reads.sample_reads_by_coverage(df, 5.0, 40, 60).collect()
    text = {0: "ACGT" * 500, 1: "ACG", 4: "A" * 45}
    assert all(r.seq == text[r.seq_id][r.start : r.start + r.len] for r in got) and {r.seq_id for r in got} == {0, 1, 4}
    assert sum(r.seq_id == 0 for r in got) == 200 and {r.seq for r in got if r.seq_id == 1} == {"ACG"}
    with pytest.raises(ValueError):
        reads.sample_reads_by_coverage(df, 0)


def test_streaming_bins_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    text = "".join(rng.choice("ACGTn") for _ in range(900))
    source, out = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    schema = "seq_id long, part_no long, seq string"
    stream = streaming.rolling_bins(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)), 9, 100)
    query = stream.writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(out)).start()
    try:
        for i in range(3):
            (source / f"{i}.json").write_text(json.dumps({"seq_id": 1, "part_no": i, "seq": text[300 * i : 300 * i + 300]}))
            query.processAllAvailable()
    finally:
        query.stop()
    got = {r.bin: (r.sum_gc, r.n) for r in streaming.merged(spark.table("bins")).collect()}
    bases = text.replace("n", "").upper()
    gc = [sum(c in "GC" for c in bases[i : i + 9]) for i in range(len(bases) - 8)]
    assert got == {i // 100: (sum(gc[i : i + 100]), len(gc[i : i + 100])) for i in range(0, len(gc), 100)}
