"""Several independent Spark jobs at a time from one driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
R = TypeVar("R")


def run_jobs(spark: SparkSession, function: Callable[[T], R], items: Iterable[T], parallelism: int = 4) -> list[R]:
    """``function`` of every item, in order, so that one job's tail does not idle the cluster."""
    items = list(items)
    if len(items) < 2 or parallelism < 2:
        return [function(item) for item in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(function), items)
