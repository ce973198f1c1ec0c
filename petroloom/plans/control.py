"""Cancelling what runs on the cluster."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


@contextlib.contextmanager
def cancellable(spark: SparkSession, cancelled: Callable[[], bool] | None, every: float = 0.5) -> Iterator[None]:
    """Jobs that this thread starts inside carry a tag; once cancelled() says so they are interrupted, and the block
    ends with InterruptedError. Jobs of other threads and later ones go on."""
    if cancelled is None:
        yield
        return
    context = spark.sparkContext
    tag, over, hit = f"petroloom-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(every):
            if cancelled():
                hit.set()
                context.cancelJobsWithTag(tag)  # again and again, for jobs that begin just now

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as stopped:
        if hit.is_set():
            raise InterruptedError("cancelled") from stopped
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)
