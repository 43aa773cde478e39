"""Python that runs in tasks: its code travels with the job, so executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship(name: str) -> None:
    """Functions of module `name` travel to executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand at most so many rows at a time to Python, since whole texts make wide rows; a smaller setting of its own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
