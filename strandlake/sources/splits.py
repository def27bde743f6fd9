"""Scan of FASTA text by splits: any number of tasks read one file, or one record of it.

Spark deals a plain file to tasks by byte ranges, at line ends. A task sees its own range only, so
it numbers records from the range on: 0 is the one that was open when the range began, 1 the first
that begins inside. What it reads leaves as *pieces* of records with places relative to that. The
ranges are then summarised (records begun, symbols before the first and after the last header), a
prefix sum over the summaries, one row a range, says what each one carries on from, and
adding that to the pieces makes their places absolute. Neither a record nor a file ever meets in
one task, no line is moved, and no order of rows is relied on beyond that inside a range.

Gzip cannot be split: such a file is one range, also if only its first bytes say what it is; those
are inflated as they stream through a task, member by member. A line is a value, so one of gigabytes is not
read in parts; files with wrapped lines, as FASTA usually is, have no such limit."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import ship

NO_HEADER = "(no header)"
#: Symbols of a piece at most, but for one line.
PIECE = 1 << 18
#: Pieces that leave a task together.
OUT = 1_000

_UPPER = bytes.maketrans(string.ascii_lowercase.encode(), string.ascii_uppercase.encode())
_NO_BASE = bytes(b for b in range(256) if b not in b"ACGTacgt")


@dataclass(frozen=True)
class Style:
    """What a reader takes for a header, and what it keeps of other lines.

    strip: lines count without outer white space, for headers too. returns: carriage returns before
    a header's sign are skipped. fold: upper case. drop: bytes that are removed. lead: what
    stands before the first header of a file belongs to its first record, and a file without
    headers is one record, ``(no header)``; otherwise that is record 0, which has no header."""

    strip: bool = False
    returns: bool = False
    fold: bool = False
    drop: bytes = b""
    lead: bool = False

    def is_header(self, line: bytes) -> bool:
        if line.startswith(b">"):
            return True
        if self.strip:
            return line.lstrip().startswith(b">")
        return self.returns and line.lstrip(b"\r").startswith(b">")

    def cleaned(self, lines: list[bytes]) -> bytes:
        if self.strip:
            lines = [line.decode("utf-8", "replace").strip().encode() for line in lines]
        text = b"".join(lines)
        return text.translate(_UPPER if self.fold else None, self.drop) if self.fold or self.drop else text


#: Statistics of symbols, bases of all records, records as they are written, their bases.
STATISTICS = Style(fold=True, drop=b" \t\r\n", lead=True)
BASES = Style(returns=True, fold=True, drop=_NO_BASE)
RECORDS = Style(strip=True)
RAW = Style(strip=True, fold=True)

_SCHEMA = "file string, block long, rel long, off long, header string, whole boolean, part string"
_NAMES = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]


class _Range:
    """The pieces of one range, line by line."""

    def __init__(self, file: str, block: int, style: Style):
        self.at, self.style = (file, block), style
        self.rel, self.off, self.header = 0, 0, None
        self.lines: list[bytes] = []
        self.size = 0
        self.alone = False  # nothing of the open record has left, and it began here
        self.out: list[tuple] = []

    def flush(self, closed: bool) -> None:
        text = self.style.cleaned(self.lines).decode("utf-8", "replace")
        if text or self.header is not None:
            self.out.append((*self.at, self.rel, self.off, self.header, closed and self.alone, text))
            self.alone = False
        self.off += len(text)
        self.lines, self.size, self.header = [], 0, None

    def add(self, line: bytes) -> None:
        if self.style.is_header(line):
            self.flush(True)
            self.rel, self.off, self.alone = self.rel + 1, 0, True
            self.header = _title(line)
        else:
            self.lines.append(line)
            self.size += len(line)
            if self.size >= PIECE:
                self.flush(False)


def _title(line: bytes) -> str:
    """A header line without its sign and outer white space."""
    return line.decode("utf-8", "replace").strip().removeprefix(">").strip()


def _pieces(rows: Iterator[tuple[str, int, list[bytes]]], style: Style) -> Iterator[pa.RecordBatch]:
    """The pieces of lines that come as (file, block, some of its lines)."""
    now: _Range | None = None

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)], _NAMES)

    for file, block, lines in rows:
        if now is None or now.at != (file, block):
            if now is not None:
                now.flush(False)
                if now.out:
                    yield batch_of(now.out)
            now = _Range(file, block, style)
        for line in lines:
            now.add(line)
        if len(now.out) >= OUT:
            yield batch_of(now.out)
            now.out = []
    if now is not None:
        now.flush(False)
        if now.out:
            yield batch_of(now.out)


def _cut(style: Style):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(((f, b, [v]) for batch in batches for f, b, v in zip(*_columns(batch))), style)

    return run


def _columns(batch: pa.RecordBatch) -> tuple[list, list, list]:
    return batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()


def _inflated(style: Style):
    """Pieces of gzip files whose bytes come in order, cut at the byte of a line end."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
        rows = (row for batch in batches for row in zip(*_columns(batch)))
        for file, own in groupby(rows, key=lambda r: r[0]):
            engine, rest, begun = zlib.decompressobj(31), b"", False
            for data in chain((r[2] for r in own), (None,)):
                # the reader took the line ends away; at the end of the file one may be missing
                more = b"\n" if data is None else (b"\n" if begun else b"") + data
                if data is None and engine.eof:
                    break
                begun = True
                text = [rest]
                while more:
                    if engine.eof:
                        if not more.strip(b"\0"):
                            break
                        engine = zlib.decompressobj(31)
                    text.append(engine.decompress(more))
                    more = engine.unused_data
                *whole, rest = b"".join(text).split(b"\n")
                if whole:
                    yield file, 0, whole
            if rest:
                yield file, 0, [rest]
            if not engine.eof:
                raise ValueError(f"{file} ends inside a gzip member")

    return lambda batches: _pieces(lines(batches), style)


def ranges(spark: SparkSession, path: str, style: Style, glob: str | None = None) -> DataFrame:
    """(file, block, rel, off, header, whole, part): the pieces, with places relative to ranges.
    ``glob`` chooses files of a folder by name.

    A header comes with the first piece of its record; ``whole`` marks pieces that are all of a
    record."""
    ship(spark)
    return _lines(spark, path, glob).select("file", "block", "value").mapInArrow(_cut(style), _SCHEMA)


def _lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, block, at, value): lines, whose bytes are as in the file."""
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter=glob)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def sniffed_ranges(spark: SparkSession, path: str, style: Style, glob: str | None = None) -> DataFrame:
    """``ranges`` of files that may be gzip whatever their names: by their first two bytes, which the
    driver reads. A gzip file without the name of one goes through one task in order, none of it is
    held but a line."""
    ship(spark)
    files = spark.read.text(path, pathGlobFilter=glob).inputFiles()
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    # files whose names say so are inflated by Spark's reader
    told = lambda f: f.lower().endswith(".gzip") or codecs.getCodec(_hadoop_path(spark, f)) is not None
    hidden = [f for f in files if not told(f) and _first_bytes(spark, f) == b"\x1f\x8b"]
    plain = sorted(set(files) - set(hidden))
    parts = []
    if plain:
        parts.append(_lines(spark, plain).select("file", "block", "value").mapInArrow(_cut(style), _SCHEMA))
    if hidden:
        ordered = _lines(spark, hidden).repartition("file").sortWithinPartitions("file", "block", "at")
        parts.append(ordered.select("file", "block", "value").mapInArrow(_inflated(style), _SCHEMA))
    if not parts:
        return ranges(spark, path, style, glob)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _hadoop_path(spark: SparkSession, file: str):
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))


def _first_bytes(spark: SparkSession, file: str) -> bytes:
    """The first two bytes of a file in any store that Spark reaches."""
    at = _hadoop_path(spark, file)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(x for x in (stream.read(), stream.read()) if x >= 0)
    finally:
        stream.close()


def summaries(found: DataFrame) -> DataFrame:
    """(file, block, begun, lead, tail): of each range the records that begin in it, the symbols
    before the first of them and those of the last one (both are all symbols if none begins)."""
    sizes = found.groupBy("file", "block", "rel").agg(F.sum(F.length("part")).alias("n"))
    last = F.max_by("n", "rel")
    return sizes.groupBy("file", "block").agg(F.max("rel").alias("begun"), F.coalesce(F.sum(F.when(F.col("rel") == 0, F.col("n"))), F.lit(0)).alias("lead"), last.alias("tail"))


def carried(summary: DataFrame, lead: bool) -> DataFrame:
    """What each range goes on from (file, block, before, open), and what holds for its file
    (begun, lead, first_id): the records begun in earlier ranges and how many symbols of the last of
    them were read, all records and the symbols before them, and the number of the file's first
    record among those of all files. One row a range goes through these windows."""
    file = W.partitionBy("file")
    by_place = file.orderBy("block")
    earlier = by_place.rowsBetween(W.unboundedPreceding, -1)
    until = by_place.rowsBetween(W.unboundedPreceding, 0)
    # a record stays open from the range in which it begins to the next in which one begins
    run = summary.select(
        "file", "block", "tail", F.col("begun").alias("_own"), F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("before"),
        F.sum((F.col("begun") > 0).cast("long")).over(until).alias("_run"), F.sum("begun").over(file).alias("begun"),
        F.row_number().over(by_place).alias("_no"), F.col("lead").alias("_lead"),
    )
    run = run.withColumn("_after", F.sum("tail").over(W.partitionBy("file", "_run").orderBy("block").rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("open", F.coalesce(F.lag("_after").over(by_place), F.lit(0))).withColumn("lead", F.sum(F.when(F.col("before") == 0, F.col("_lead")).otherwise(0)).over(file))
    bare = (F.col("begun") == 0) & (F.col("lead") > 0) & (F.col("_no") == 1) & F.lit(lead)
    every = run.withColumn("_count", F.col("_own") + bare.cast("long"))
    ahead = F.coalesce(F.sum("_count").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = every.withColumn("_ahead", ahead)
    return numbered.select("file", "block", "before", "open", "begun", "lead", F.min("_ahead").over(file).alias("first_id"))


def pieces(spark: SparkSession, path: str, style: Style, glob: str | None = None, sniff: bool = False) -> DataFrame:
    """(seq_id, file, record, offset, header, whole, seq): the records of all files in pieces.

    record counts from 1 in each file; offset is the place of a piece in its record; seq_id numbers
    the records of all files from 0, by file name, then place. One piece of a record has its
    header, the others have null. With ``sniff`` files may be gzip whatever their names."""
    found = (sniffed_ranges if sniff else ranges)(spark, path, style, glob)
    out = found.join(carried(summaries(found), style.lead), ["file", "block"]).select(
        "file", "begun", "lead", "first_id", "whole", "header", F.col("part").alias("seq"),
        (F.col("before") + F.col("rel")).alias("record"), (F.col("off") + F.when(F.col("rel") == 0, F.col("open")).otherwise(0)).alias("offset"),
    )
    header = F.col("header")
    if style.lead:
        header = F.when((F.col("begun") == 0) & (F.col("offset") == 0), F.lit(NO_HEADER)).otherwise(header)
        late = F.when(F.col("record") == 1, F.col("lead")).otherwise(0)
        out = out.withColumns({"offset": F.col("offset") + late, "whole": F.col("whole") & (late == 0), "record": F.greatest("record", F.lit(1))})
    else:
        out = out.where("record > 0")
    return out.select((F.col("first_id") + F.col("record") - 1).alias("seq_id"), "file", "record", "offset", header.alias("header"), "whole", "seq")


def joined(found: DataFrame) -> DataFrame:
    """(seq_id, file, header, seq): records as one value each. Only those that are in several
    pieces are moved; a record has to fit into a value, so analyse long ones by pieces."""
    whole = found.where("whole").select("seq_id", "file", "header", "seq")
    parts = found.where("not whole").groupBy("seq_id", "file").agg(
        F.max("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "seq"))), lambda x: x["seq"]), "").alias("seq")
    )
    return whole.unionByName(parts)


def lengths(found: DataFrame) -> DataFrame:
    """(seq_id, file, header, n): the symbols of each record, without putting any together."""
    return found.groupBy("seq_id", "file").agg(F.max("header").alias("header"), F.sum(F.length("seq")).alias("n"))
