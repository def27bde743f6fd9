"""Runs that report how far they are and can be cancelled, and progress of streams as a table."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class CanceledError(RuntimeError):
    """The run was cancelled; the message is ``Canceled``."""

    def __init__(self) -> None:
        super().__init__("Canceled")


@dataclass(frozen=True)
class Progress:
    """Tasks that are done, of those that are known so far, and bytes and rows that they read."""

    seconds: float
    done: int
    tasks: int
    bytes_read: int
    rows_read: int


class Run:
    """An action on DataFrames in a thread of its own, as one group of Spark jobs.

    ``action`` is any function without arguments, such as the ``collect`` of a table.
    ``progress`` may be asked at any time; ``cancel`` stops the group's jobs on all executors, and
    ``result`` then raises ``CanceledError``. Other runs of the session go on."""

    def __init__(self, spark: SparkSession, action: Callable[[], Any]):
        self._context, self._group = spark.sparkContext, f"run-{uuid.uuid4().hex}"
        self._began, self._value, self._error, self._canceled = time.monotonic(), None, None, threading.Event()
        self._thread = InheritableThread(target=self._run, args=(action,), session=spark)
        self._thread.start()

    def _run(self, action: Callable[[], Any]) -> None:
        try:
            self._context.setJobGroup(self._group, "cancellable run", interruptOnCancel=True)
            if not self._canceled.is_set():
                self._value = action()
        except Exception as error:  # raised again where the result is asked for
            self._error = error
        finally:
            self._context.setLocalProperty("spark.jobGroup.id", None)

    def progress(self) -> Progress:
        tracker, store = self._context.statusTracker(), self._context._jsc.sc().statusStore()
        done = tasks = size = rows = 0
        for job in tracker.getJobIdsForGroup(self._group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info is not None else ():
                known = tracker.getStageInfo(stage)
                if known is not None:
                    tasks += known.numTasks
                    done += known.numCompletedTasks
                    data = store.lastStageAttempt(stage)
                    size += data.inputBytes()
                    rows += data.inputRecords()
        return Progress(time.monotonic() - self._began, done, tasks, size, rows)

    def running(self) -> bool:
        return self._thread.is_alive()

    def cancel(self) -> None:
        self._canceled.set()
        # a job that begins just now may be missed, so ask until the thread ends
        while self.running():
            self._context.cancelJobGroup(self._group)
            self._thread.join(0.2)

    def result(self, every: float = 0.2, tell: Callable[[Progress], None] | None = None) -> Any:
        """What the action returns; ``tell`` hears of the progress meanwhile and at the end."""
        while self.running():
            self._thread.join(every)
            if tell is not None:
                tell(self.progress())
        if self._canceled.is_set():
            raise CanceledError
        if self._error is not None:
            raise self._error
        return self._value


class StreamProgress(StreamingQueryListener):
    """Collects the batches of the session's streams; ``table`` has them as a DataFrame."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._rows.append((str(p.runId), p.name, p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0.0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._rows.append((str(event.runId), None, None, 0, 0.0))

    def table(self, spark: SparkSession) -> DataFrame:
        """(run, name, batch, rows, rows_per_second): one row a batch, and one without a batch when
        a stream ends."""
        return spark.createDataFrame(list(self._rows), "run string, name string, batch long, rows long, rows_per_second double")
