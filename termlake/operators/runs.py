"""Runs, their steps, audit records, and the ordered steps that follow a publication."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_id string, sk string, kind string, status string, at timestamp, counts map<string,bigint>, note string"
AUDIT = "concept_id string, published_at timestamp, run_id string, version bigint, author string, note string, history string, digest string"
Step = Callable[[dict], dict[str, int]]


class RunLog:
    """Append-only rows below `path`; of rows with one key the newest is what holds."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.UTC)) -> None:
        self.spark, self.path, self.clock = spark, path, clock
        for name, schema in (("runs", RUN), ("audit", AUDIT)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def _add(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def write_run(self, run_id: str, kind: str, status: str, counts: dict[str, int] | None = None, note: str | None = None) -> None:
        self._add("runs", RUN, (run_id, "RUN", kind, status, self.clock(), counts or {}, note or None))

    def write_step(self, run_id: str, n: int, name: str, status: str, counts: dict[str, int] | None = None, note: str | None = None) -> None:
        self._add("runs", RUN, (run_id, f"STEP#{n:02d}#{name}", None, status, self.clock(), counts or {}, note or None))

    def write_audit(self, *row) -> None:
        self._add("audit", AUDIT, row)

    def rows(self) -> DataFrame:
        stored = self.spark.read.schema(RUN).parquet(f"{self.path}/runs")
        newest = stored.groupBy("run_id", "sk").agg(F.min("at").alias("started_at"), F.max_by(F.struct("kind", "status", "counts", "note"), "at").alias("last"))
        return newest.select("run_id", "sk", "started_at", "last.*")

    def audit(self) -> DataFrame:
        return self.spark.read.schema(AUDIT).parquet(f"{self.path}/audit")

    def steps(self, run_id: str) -> DataFrame:
        """In their order, whether or not there is a row for the run."""
        return self.rows().where((F.col("run_id") == run_id) & F.col("sk").startswith("STEP#")).orderBy("sk")

    def run(self, run_id: str) -> dict | None:
        """The run with its steps; None without a row for it."""
        row = self.rows().where((F.col("run_id") == run_id) & (F.col("sk") == "RUN")).first()
        return row and row.asDict() | {"steps": [r.asDict() for r in self.steps(run_id).collect()]}

    def runs(self, kind: str | None = None, limit: int = 20) -> DataFrame:
        """The newest first, of one kind or of all."""
        listed = self.rows().where("sk = 'RUN'")
        return (listed if kind is None else listed.where(F.col("kind") == kind)).orderBy(F.desc("started_at"), "run_id").limit(limit)

    def latest(self, kind: str) -> dict | None:
        row = self.runs(kind, 1).first()
        return self.run(row["run_id"]) if row else None


def totals(steps: DataFrame) -> DataFrame:
    """(run_id, name, total): counters summed over the steps only, so what an event carried along is not counted again."""
    return steps.where(F.col("sk").startswith("STEP#")).select("run_id", F.explode("counts").alias("name", "n")).groupBy("run_id", "name").agg(F.sum("n").alias("total"))


def run_steps(log: RunLog, run_id: str, kind: str, steps: Sequence[tuple[str, Step]], event: dict, attempts: int = 3, wait: float = 2.0, rate: float = 2.0) -> dict[str, int]:
    """Run steps (name, function of the event) in order, each tried `attempts` times with growing waits; counters summed.

    A run row is there before the first step. A step that fails for good ends the run as failed, which is recorded
    and raised; later steps do not run.
    """
    log.write_run(run_id, kind, "running")
    summed: dict[str, int] = {}
    for n, (name, step) in enumerate(steps, 1):
        for attempt in range(attempts):
            try:
                counts = step(event)
                break
            except Exception as error:
                if attempt + 1 == attempts:
                    log.write_step(run_id, n, name, "failed", note=str(error)[:500])
                    log.write_run(run_id, kind, "failed", summed, f"{name}: {error}"[:500])
                    raise
                time.sleep(wait * rate**attempt)
        log.write_step(run_id, n, name, "done", counts)
        for key, value in counts.items():
            summed[key] = summed.get(key, 0) + value
    log.write_run(run_id, kind, "done", summed, " · ".join(f"{v} {k}" for k, v in summed.items() if v))
    return summed
