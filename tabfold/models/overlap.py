"""Fits that run beside one another.

A fit is a chain of small jobs that leaves most of a cluster idle, so several are kept open: a bounded pool of threads on
the driver, each with a job group of its own.  The rows stay in the executors; threads only wait for jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Fits that are open at a time.
OPEN_FITS = 4


def overlapped(spark: SparkSession, jobs: list[tuple[str, Callable[[], Any]]], open_fits: int = OPEN_FITS) -> list[tuple[Any, str | None]]:
    """Result and error text of each named job, in order, one of them null."""
    context = spark.sparkContext

    def run(name: str, job: Callable[[], Any]) -> tuple[Any, str | None]:
        context.setJobGroup(name, name)
        try:
            return job(), None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(max(1, open_fits)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs]
        return [w.result() for w in waiting]
