"""The scan by splits against a reader of whole files, and records read as one sequence against
sequences that are put together."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import concat, orfs, windows
from strandlake.plans import reports
from strandlake.sources import fasta, sinks, splits

STYLES = {"STATISTICS": splits.STATISTICS, "BASES": splits.BASES, "RECORDS": splits.RECORDS, "RAW": splits.RAW}


@pytest.fixture()
def small_splits(spark):
    """Splits of 300 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def text_of(rng, records, lead, end="\n"):
    lines = ["acg t", "GG"] if lead else []
    for i in range(records):
        lines.append((">" if i % 5 else " >") + f"h{i} x" if i != 3 else ">")
        for _ in range(rng.choice([0, 0, 1, 3, 40])):
            lines.append("".join(rng.choice("ACGTacgtNÄ ") for _ in range(rng.randrange(60))))
    return end.join(lines) + (end if records % 2 else "")


def whole_files(texts, style):
    """(header, seq) of the records of texts, line by line."""
    out = []
    for text in texts:
        found, lead = [], ""
        for line in text.split("\n"):
            bare = line.strip()
            if bare.startswith(">") if style.strip else line.startswith(">") or (style.returns and line.lstrip("\r").startswith(">")):
                found.append([bare.removeprefix(">").strip(), ""])
                continue
            part = bare if style.strip else line
            if style.fold:
                part = "".join(c.upper() if c.isascii() else c for c in part)
            part = "".join(c for c in part if not set(c.encode()) <= set(style.drop))
            if found:
                found[-1][1] += part
            else:
                lead += part
        if style.lead and found:
            found[0][1] = lead + found[0][1]
        elif style.lead and lead:
            found = [["(no header)", lead]]
        out += [tuple(f) for f in found]
    return out


@pytest.mark.parametrize("name", sorted(STYLES))
def test_scan_by_splits_equals_whole_files(spark, tmp_path, small_splits, name):
    rng = random.Random(1)
    texts = [text_of(rng, n, lead, end) for n, lead, end in ((9, 0, "\n"), (6, 1, "\r\n"), (1, 0, "\n"), (0, 1, "\n"), (12, 1, "\n"), (0, 0, "\n"))]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.fa").write_bytes(text.encode())
    found = splits.pieces(spark, str(tmp_path), STYLES[name])
    got = splits.joined(found).orderBy("seq_id").collect()
    want = whole_files(texts, STYLES[name])
    assert [(r.header, r.seq) for r in got] == want and [r.seq_id for r in got] == list(range(len(want)))
    assert found.rdd.getNumPartitions() > 20 and found.count() > len(want)
    assert [(r.header, r.n) for r in splits.lengths(found).orderBy("seq_id").collect()] == [(h, len(s)) for h, s in want]


def test_one_large_record_uses_all_tasks(spark, tmp_path, small_splits):
    rng = random.Random(2)
    bases = "".join(rng.choice("ACGT") for _ in range(20_000))
    lines = [bases[i : i + 70] for i in range(0, len(bases), 70)]
    (tmp_path / "one.fa").write_text(">genome\n" + "\n".join(lines) + "\n")
    found = splits.pieces(spark, str(tmp_path), splits.BASES)
    tasks = found.groupBy(F.spark_partition_id()).agg(F.sum(F.length("seq")).alias("n")).collect()
    assert len(tasks) > 50 and max(r.n for r in tasks) <= 400
    assert [tuple(r) for r in splits.lengths(found).select("header", "n").collect()] == [("genome", 20_000)]
    # windows over it are those of the sequence, without it ever being one value
    whole = spark.createDataFrame([(0, bases)], "seq_id long, seq string")
    want = windows.gc_bins(whole, 9, 1_000).drop("seq_id").orderBy("bin").collect()
    got = windows.joined_gc_bins(fasta.base_pieces(spark, str(tmp_path)), (), ("_at",), 9, 1_000, block=512).orderBy("bin").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_pieces_of_gzip_files_and_of_no_files(spark, tmp_path):
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b">x\nAC\n") + gzip.compress(b"GT\n>y\n"))
    (tmp_path / "b.other").write_text(">z\nA\n")
    got = fasta.records(spark, str(tmp_path), fasta.GLOB).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == [("x", "ACGT"), ("y", "")]
    (tmp_path / "empty.fa").write_text("")
    assert fasta.records(spark, str(tmp_path / "empty.fa")).count() == 0
    assert reports.fasta_report(spark, str(tmp_path / "empty.fa"))["summary"].first()[:2] == (0, 0)


def test_written_in_order_and_read_back(spark, tmp_path, small_splits):
    rng = random.Random(3)
    rows = [(i * 7 % 101, f"h{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(200)))) for i in range(101)]
    df = spark.createDataFrame(rows, "seq_id long, header string, seq string").repartition(5)
    sinks.write_fasta(df, str(tmp_path / "out"), 60, order="seq_id")
    got = fasta.records(spark, str(tmp_path / "out")).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == [r[1:] for r in sorted(rows)]


def parts_of(spark, seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice("ACGTacgt N-") for _ in range(rng.choice([0, 1, 2, 5, 80, 300])))
        rows.append((rng.choice(["a", "b", None]), i * 13 % 997, text if i % 9 else None))
    return rows, spark.createDataFrame(rows, "grp string, at long, seq string").repartition(4)


def whole_groups(rows):
    out = {}
    for g, _, text in sorted(rows, key=lambda r: r[1]):
        out[g] = out.get(g, "") + "".join(c for c in (text or "").upper() if c in "ACGT")
    return out


@pytest.mark.parametrize("size,halo", [(7, 0), (7, 20), (64, 8), (100_000, 3)])
def test_blocks_equal_cuts_of_whole_groups(spark, size, halo):
    rows, df = parts_of(spark, size)
    got = {}
    for r in concat.base_blocks(df, ("grp",), ("at",), halo, size).collect():
        got.setdefault(r.grp, {})[r.tile_off] = (r.n, r.tile)
    want = {g: {o: (len(s), s[o : o + size + halo]) for o in range(0, len(s), size)} for g, s in whole_groups(rows).items() if s}
    assert got == want


def test_places_need_one_order(spark):
    twice = spark.createDataFrame([("a", 1, 3), ("a", 1, 4)], "grp string, at long, n long")
    with pytest.raises(Exception, match="the same place"):
        concat.places(twice, ("grp",), ("at",)).collect()
    rows, df = parts_of(spark, 5)
    got = {(r.grp, r["at"]): (r.start, r.total) for r in concat.places(df.select("grp", "at", F.coalesce(F.length("seq"), F.lit(0)).alias("n")), ("grp",), ("at",)).collect()}
    upto = {}
    for g, at, text in sorted(rows, key=lambda r: r[1]):
        assert got[g, at][0] == upto.get(g, 0)
        upto[g] = upto.get(g, 0) + len(text or "")
    assert all(total == upto[g] for (g, _), (_, total) in got.items())


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_windows_span_records(spark, block):
    rows, df = parts_of(spark, 7)
    whole = whole_groups(rows)
    names = list(whole)
    one = spark.createDataFrame([(i, whole[g]) for i, g in enumerate(names)], "seq_id long, seq string")
    with pytest.raises(ValueError):
        windows.joined_gc_bins(df.withColumnRenamed("grp", "bin"), ("bin",), ("at",))
    for got, want in (
        (windows.joined_gc_bins(df, ("grp",), ("at",), 9, 256, block), windows.gc_bins(one, 9, 256)),
        (windows.joined_sliding_counts(df, ("grp",), ("at",), 25, 4, block), windows.sliding_counts(one, 25, 4)),
    ):
        assert {tuple(r) for r in got.collect()} == {(names[r[0]], *r[1:]) for r in want.collect()}


@pytest.mark.parametrize("block,stretch", [(10, 40), (64, 1 << 21), (4096, 100)])
def test_reading_frames_span_records(spark, block, stretch):
    rows, df = parts_of(spark, 11, 90)
    whole = whole_groups(rows)
    names = list(whole)
    one = orfs.rna_of(spark.createDataFrame([(i, whole[g]) for i, g in enumerate(names)], "seq_id long, seq string"))
    got = {tuple(r) for r in orfs.joined_reading_frames(df, ("grp",), ("at",), 12, block, stretch=stretch).collect()}
    want = {(names[r.seq_id], *r[1:]) for r in orfs.open_reading_frames(one, 12).collect()}
    assert got == want and len(want) > 20
    used = {(r.grp, r.codon): (r.n, tuple(r.first_ord)) for r in orfs.joined_codons_used(df, ("grp",), ("at",), 12, block).collect()}
    single = orfs.codons_used(one.withColumn("grp", F.col("seq_id")), 12, ("grp",)).collect()
    assert used == {(names[r.grp], r.codon): (r.n, tuple(r.first_ord)[1:]) for r in single}
    listed = orfs.codon_usage(orfs.orf_sequences(one.withColumn("grp", F.col("seq_id")), 12, keep=("grp", "seq_id")), ("grp",)).collect()
    assert {tuple(r) for r in listed} == {tuple(r) for r in single}


def test_genome_comparison_over_record_ends(spark):
    rows = [("x", i, "ATGGCC" if i % 2 else "AAACCCTA") for i in range(40)] + [("y", i, "CATGGCCGC") for i in range(30)]
    df = spark.createDataFrame(rows, "genome string, seq_id long, seq string")
    out = reports.codon_comparison(df, "x", "y", 9)
    joined = {g: "".join(r[2] for r in rows if r[0] == g).replace("T", "U") for g in "xy"}
    want = orfs.orf_sequences(spark.createDataFrame([(g, 0, s) for g, s in joined.items()], "genome string, seq_id long, rna string"), 9, keep=("genome", "seq_id"))
    top = orfs.top_codons(orfs.codon_usage(want, ("genome",)), 10, ("genome",))
    assert {tuple(r) for r in out["top_codons"].collect()} == {tuple(r) for r in top.collect()}
    assert {r.codon for r in out["common"].collect()} <= {r.codon for r in top.where("genome = 'x'").collect()}
