"""What the operators of this subpackage share: keys, the shared folder, column checks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\\x20\\x09-\\x0D]``, the separators of every word rule here.
SEPARATORS = "[\\x20\\x09-\\x0D]"

#: Rows without an identifier sort before all others.
NO_ID = -(2**63)


def id_key(column: str = "doc_id") -> Column:
    """The identifier as a long that is never null: null becomes the smallest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID).cast("long"))


def id_back(key: Column) -> Column:
    return F.nullif(key, F.lit(NO_ID).cast("long"))


#: What this session wrote below spark.checkpoint.dir, by application, in order.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing a local folder is chosen, but only if the executors run on
    this machine; on a cluster it is an error, as they could not read each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/strandlake-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches; a missing one is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(spark: SparkSession) -> int:
    """How many folders this application has written so far; see ``clean``."""
    return len(_written.get(spark.sparkContext.applicationId, ()))


def clean(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the intermediate folders written after ``since``, but for those ``keep`` reads.

    For when every result that is built on them has been written elsewhere."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    used = keep.inputFiles() if keep is not None else []
    stay = [p for p in paths[since:] if any(p.rsplit("/", 1)[1] in file for file in used)]
    for path in paths[since:]:
        if path not in stay:
            delete(spark, path)
    paths[since:] = stay


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, each: int) -> int:
    """Tasks for a table that was written, at ``each`` rows a task: small tables that go through
    many steps then don't cost a task for each of spark.sql.shuffle.partitions."""
    return max(1, -(-df.count() // each))


def sampled(rows: DataFrame, limit: int, key: str = "k") -> DataFrame:
    """About ``limit`` of ``rows``, or all if there are no more: those with small hashes of
    ``key``, so every task filters its own and none has to order them."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(limit / n * (1 << 40)))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def named(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


_shipped: set[str] = set()
#: Rows of an Arrow batch at most, so batches of texts stay small on both sides.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application, and bound
    the rows of the session's Arrow batches, unless they are fewer already."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="strandlake-")) / "strandlake.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


#: What tasks of one kind remember in their worker for the next one, by that kind.
_remembered: dict[str, dict] = {}


def remembered(kind: str) -> dict:
    """This worker's memory for tasks of a kind; it lasts until a task of another kind comes."""
    return _remembered.setdefault(kind, {})


def forget(but: str | None) -> None:
    """Drop what tasks of other kinds than ``but`` remember in this worker."""
    for kind in [k for k in _remembered if k != but]:
        del _remembered[kind]


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, around which a task drops what is remembered in its worker but for its own
    ``kind``, and after which it gives unused memory back to the system: the worker stays for
    other tasks, and what it once needed would count against the executor for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(kind)
        try:
            yield from function(batches)
        finally:
            forget(kind)
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


def map_arrow(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow for a function of single batches; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    ship(df.sparkSession)
    return df.mapInArrow(released(run), schema)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_fold(column: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 5: 0 marks the held-out rows."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5))
