"""Tables of dependent tasks, and progress."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "success", "failed", "skipped", "cancelled")


def ready(tasks: DataFrame, task: str = "task_id", status: str = "status", depends: str = "dependencies") -> DataFrame:
    """Pending tasks without a known dependency that is not yet a success."""
    needs = tasks.where(F.col(status) == "pending").select(F.col(task).alias("__t"), F.explode(depends).alias("__d"))
    unmet = needs.join(tasks.where(F.col(status) != "success").select(F.col(task).alias("__d")), "__d").select("__t").distinct()
    return tasks.where(F.col(status) == "pending").join(unmet, F.col(task) == F.col("__t"), "left_anti")


def status_counts(tasks: DataFrame, status: str = "status", statuses: Sequence[str] = STATUSES) -> DataFrame:
    """(status, n) with a row for every status."""
    every = tasks.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    n = tasks.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def export(tasks: DataFrame, path: str) -> None:
    """Tasks as JSON lines in a folder that the cluster shares."""
    tasks.write.json(path)


class JobMonitor:
    """Progress with rate and time left."""

    def __init__(self, total: int, description: str = "Processing"):
        if total <= 0:
            raise ValueError("total must be positive")
        self.total, self.description = total, description
        self.reset()

    def reset(self) -> None:
        self.done, self.began = 0, time.time()

    def update(self, n: int = 1) -> None:
        if n <= 0:
            raise ValueError("n must be positive")
        self.done = min(self.total, self.done + n)

    def status(self) -> dict:
        passed = time.time() - self.began
        rate = self.done / passed if passed > 0 else 0.0
        return {"done": self.done, "total": self.total, "percent": 100 * self.done / self.total, "elapsed": passed, "rate": rate, "eta": (self.total - self.done) / rate if rate else None}


def run_job(task_id: str, job: Callable[..., DataFrame], spark: SparkSession, *args) -> str:
    """Entry for schedulers: runs a job and reports its rows as JSON."""
    try:
        return json.dumps({"task_id": task_id, "status": "success", "rows": job(spark, *args).count()})
    except Exception as e:  # noqa: BLE001  reported to the scheduler
        return json.dumps({"task_id": task_id, "status": "failed", "error": str(e)[:500]})
