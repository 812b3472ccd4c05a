"""Progress of running jobs, cancelling them, and ingest that keeps what is there when it is stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parlance.sources import export, shards


@contextmanager
def watched(
    spark: SparkSession,
    on_progress: Callable[[int, int], None] | None = None,
    should_stop: Callable[[], bool] | None = None,
    every: float = 0.5,
) -> Iterator[None]:
    """Report ``(tasks done, tasks known)`` of the jobs started inside, and cancel these once ``should_stop`` says so.

    A cancelled job raises its error where it was started. A callback that fails stops nothing.
    """
    sc = spark.sparkContext
    group = f"parlance-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "watched", interruptOnCancel=True)
    over = threading.Event()
    known: dict[int, tuple[int, int]] = {}

    def look() -> None:
        status = sc.statusTracker()
        for job in status.getJobIdsForGroup(group):
            info = status.getJobInfo(job)
            for no in info.stageIds if info else ():
                stage = status.getStageInfo(no)
                if stage:
                    known[no] = (stage.numCompletedTasks, stage.numTasks)
        if on_progress:
            on_progress(sum(d for d, _ in known.values()), sum(n for _, n in known.values()))
        if should_stop and should_stop():
            sc.cancelJobGroup(group)

    def run() -> None:
        while not over.wait(every):
            try:
                look()
            except Exception:  # noqa: BLE001, S112
                continue

    watcher = threading.Thread(target=run, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join(5)
        sc.setLocalProperty("spark.jobGroup.id", None)
        if on_progress:
            on_progress(sum(d for d, _ in known.values()), sum(n for _, n in known.values()))


@dataclass(frozen=True)
class Ingested:
    """Files that were taken in whole, their messages, bytes of the store, and whether all files were."""

    files: int
    messages: int
    stored_bytes: int
    complete: bool


def ingest(
    spark: SparkSession,
    paths: Sequence[str],
    store: str,
    assistant_name: str | None = None,
    on_progress: Callable[[int, int], None] | None = None,
    should_stop: Callable[[], bool] | None = None,
) -> Ingested:
    """Take export files in one after the other; each is written whole or, if stopped, not at all.

    Between files ``on_progress`` gets the files done and all files, and ``should_stop`` is asked;
    what was written before stays.
    """
    done = messages = 0
    for path in paths:
        if should_stop and should_stop():
            break
        rows = export.emitted(export.normalize(export.read_large(spark, path)), assistant_name)
        shards.write_shards(rows, store)
        done += 1
        if on_progress:
            on_progress(done, len(paths))
    total = shards.stored_bytes(spark, store)
    if total:
        messages = shards.read_shards(spark, store).agg(F.count("*")).first()[0]
    return Ingested(done, messages, total, done == len(paths))
