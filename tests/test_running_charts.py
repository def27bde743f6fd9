"""Runs with progress and cancellation, chart layers, text tables, options, streams out of order."""

import gzip
import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.operators import reads, windows
from strandlake.plans import reports
from strandlake.plans.options import TemperatureOptions
from strandlake.plans.running import CanceledError, Run, StreamProgress
from strandlake.sources import fasta, sinks
from strandlake.streaming import windows as streaming


def slow(spark, tasks, each):
    """A table whose tasks take some time each."""

    def run(batches):
        for batch in batches:
            time.sleep(each)
            yield batch

    return spark.range(0, tasks * 10, numPartitions=tasks).mapInArrow(run, "id long")


def test_progress_rises(spark, tmp_path):
    docs = spark.range(4_000).select(F.concat(F.lit(">r"), "id", F.lit("\n"), F.repeat(F.lit("ACGT"), 50)).alias("value"))
    docs.repartition(12).write.text(str(tmp_path / "in"))
    found = fasta.statistics_records(spark, str(tmp_path / "in"))
    heard = []
    run = Run(spark, lambda: (found.count(), slow(spark, 12, 0.2).count()))
    assert run.result(0.1, heard.append) == (4_000, 120)
    done = [p.done for p in heard]
    # stages that Spark finds done already have tasks that never run
    assert done == sorted(done) and len(set(done)) > 3 and 0 < done[-1] <= heard[-1].tasks
    assert heard[-1].bytes_read > 4_000 * 200 and heard[-1].rows_read >= 8_000


def test_cancelled_runs_end_and_others_go_on(spark):
    run = Run(spark, lambda: slow(spark, 400, 0.5).count())
    other = Run(spark, lambda: spark.range(1_000).count())
    while run.progress().tasks == 0:
        time.sleep(0.05)
    began = time.monotonic()
    run.cancel()
    with pytest.raises(CanceledError, match="Canceled"):
        run.result()
    assert time.monotonic() - began < 20 and other.result() == 1_000
    assert Run(spark, lambda: spark.range(7).count()).result() == 7


def test_errors_of_a_run_are_raised(spark):
    run = Run(spark, lambda: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        run.result()


def stream_of(spark, folder, state, files, name):
    folder.mkdir()
    schema = "seq_id long, part_no long, seq string"
    stream = streaming.rolling_bins(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), 9, 100)
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(state)).start()
    try:
        for i, rows in enumerate(files):
            (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("seq_id", "part_no", "seq"), r))) for r in rows))
            query.processAllAvailable()
    finally:
        query.stop()
    return {(r.seq_id, r.bin): (r.sum_gc, r.min_gc, r.max_gc, r.n) for r in streaming.merged(spark.table(name)).collect()}


def test_stream_takes_parts_out_of_order(spark, tmp_path):
    rng = random.Random(8)
    texts = {s: "".join(rng.choice("ACGTn") for _ in range(700 + 13 * s)) for s in (1, 2)}
    parts = [(s, i, t[90 * i : 90 * i + 90]) for s, t in texts.items() for i in range(-(-len(t) // 90))]
    rng.shuffle(parts)
    listener = StreamProgress()
    spark.streams.addListener(listener)
    try:
        got = stream_of(spark, tmp_path / "in", tmp_path / "state", [parts[:7], parts[5:9], parts[9:]], "shuffled")
    finally:
        time.sleep(1)
        spark.streams.removeListener(listener)
    whole = spark.createDataFrame(list(texts.items()), "seq_id long, seq string")
    assert got == {(r.seq_id, r.bin): (r.sum_gc, r.min_gc, r.max_gc, r.n) for r in windows.gc_bins(whole, 9, 100).collect()}
    told = listener.table(spark).where("batch is not null").agg(F.sum("rows"), F.countDistinct("batch")).first()
    assert told[0] == len(parts) + 2 and told[1] >= 3


def test_running_symbol_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"seq": "ACa"}\n{"seq": "G"}')
    counts = streaming.symbol_counts(spark.readStream.schema("seq string").json(str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("letters").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.symbol: r.n for r in spark.table("letters").collect()} == {"A": 2, "C": 1, "G": 1}


def test_gzip_of_several_members_under_any_name(spark, tmp_path):
    rng = random.Random(5)
    texts, members = [], []
    for i in range(6):
        body = "\n".join("".join(rng.choice("ACGTacgt") for _ in range(60)) for _ in range(rng.choice([1, 400])))
        texts.append((f"h{i}", body.replace("\n", "")))
        members.append(f">h{i}\r\n{body}\n")
    data = b"".join(gzip.compress(m.encode()) for m in members)
    (tmp_path / "odd.bin").write_bytes(data)
    (tmp_path / "p.GZIP").write_bytes(data)
    (tmp_path / "padded.bin").write_bytes(data + b"\0" * 64)
    (tmp_path / "named.fa.gz").write_bytes(data)
    (tmp_path / "plain.txt").write_text("".join(members))
    got = fasta.sniffed(spark, str(tmp_path)).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == texts * 5
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.bin").write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends inside a gzip member|zlib.error"):
        fasta.sniffed(spark, str(tmp_path / "cut")).collect()


def test_chart_layers(spark, sequences):
    df = sequences("ACGTGGCCAA" * 60, "AAAA", "GGGGGGGGGG")
    view = reports.tm_view(df, windows_per_bin=256, limits=[20.0, 25.0, 30.0])
    rows = view["layers"].where("seq_id = 0").collect()
    bins = {r.bin: r.mean_tm for r in view["bins"].where("seq_id = 0").collect()}
    assert {r.x: r.y for r in rows if r.layer == "line"} == bins
    assert {(r.series, r.x, r.y, r.colour) for r in rows if r.layer == "bar"} == {(str(i), b, 20.0 + 5 * i, i + 1) for i in range(3) for b in bins}
    low, high = ({r.series: r.y for r in rows if r.layer == "limit"}[n] for n in ("low", "high"))
    assert low == int(low) <= min(bins.values()) - 1 and high == int(high) >= max(bins.values()) + 1
    alone = windows.chart_layers(windows.tm_bins(sequences("GGGGGGGGGG"), windows_per_bin=256)).collect()
    assert {(r.layer, r.y) for r in alone} == {("line", 36.0), ("bar", 36.0), ("limit", 35.0), ("limit", 37.0)}
    shares = windows.series(sequences("ACGT" * 10), 4, 4)
    layers = windows.series_layers(shares).collect()
    assert {r.y for r in layers if r.layer == "grid"} == {0.0, 0.25, 0.5, 0.75, 1.0} and sum(r.layer == "line" for r in layers) == 40


def test_chart_image_or_a_clear_error(spark, sequences, tmp_path):
    layers = windows.chart_layers(windows.tm_bins(sequences("ACGTGGCCAA" * 60), windows_per_bin=256))
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="matplotlib"):
            sinks.chart_image(layers, str(tmp_path / "a.png"), "t")
    else:
        sinks.chart_image(layers, str(tmp_path / "a.png"), "t")
        assert (tmp_path / "a.png").read_bytes()[:4] == b"\x89PNG"


def test_reports_and_lines(spark, sequences, tmp_path):
    one = sequences("ACGTGGCCAATTACGGA" * 70)
    row = reports.assembly(one, 300, 100, 150, 30, 3).first()
    assert row.ref_len == 1190 and row.reads == 300 and 0 < row.identity <= 1 and "Assembled contig length" in sinks.assembly_report(row.asDict())
    lines = reports.symbol_lines(spark.createDataFrame([("A", 3, 37.5, 1)], "symbol string, n long, pct double, ord long")).collect()
    assert lines[0].line == "A  3 37.50%"
    assert reports.kmer_lines(spark.createDataFrame([("AC", 2, 0.25)], "kmer string, n long, freq double")).first().line == "AC: 2 (0.2500)"
    sinks.write_reads(spark.createDataFrame([(0, "AC"), (1, "GG")], "read_id int, seq string"), str(tmp_path / "reads"))
    assert [(r.header, r.seq) for r in fasta.records(spark, str(tmp_path / "reads")).orderBy("seq_id").collect()] == [("read_1", "AC"), ("read_2", "GG")]
    assert reads.inline(spark, "ACG").first()[:] == (0, "inline_sequence", "ACG")


def test_options_fall_back():
    read = TemperatureOptions.read
    assert read({}) == TemperatureOptions()
    assert read({"k": "x", "bin": "10", "width": "5", "sodium": "-1", "other": "1"}) == TemperatureOptions(bin=256, width=32)
    got = read({"k": "11", "bin": "500", "width": "64", "sodium": "0.1", "thresholds": "20, x,25.5,"})
    assert got == TemperatureOptions(11, 500, 64, 0.1, (20.0, 25.5))


def test_layers_read_the_sequences_once(spark, sequences, capsys):
    """A series is one pass over its sequences, and what is drawn of it reads the series."""
    df = sequences("ACGTGGCCAA" * 60, "ACGTACGTAC", "AC", "", None)
    shares = windows.series(df, 10, 1, 100, 8)
    shares.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    for layers in (windows.series_layers(shares), windows.chart_layers(windows.tm_bins(df, windows_per_bin=256))):
        layers.explain()
        assert "MapInArrow" not in capsys.readouterr().out
    rows = windows.series_layers(shares.unionByName(shares.where("seq_id = 1"))).collect()
    got = Counter((r.seq_id, r.layer) for r in rows)
    assert got == {(0, "line"): 32, (1, "line"): 8, **{(i, "grid"): 5 for i in (0, 1)}, **{(i, "limit"): 2 for i in (0, 1)}}
    line = {(r.series, round(r.y, 6), r.colour) for r in rows if r.seq_id == 1 and r.layer == "line"}
    assert line == {("a", 0.3, 0), ("c", 0.3, 1), ("g", 0.2, 2), ("t", 0.2, 3)}
