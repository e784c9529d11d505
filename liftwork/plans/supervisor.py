"""Several runs at once on one Spark session: a thread, a job group and a fair pool for each, and a file that says how they stand.

At most `most` jobs run together; a job of an exclusive data set runs alone. A job that fails or takes longer than `seconds`
has its Spark jobs cancelled, and with `stop_on_failure` so have all others, and none is started any more. The status is written after
every change, beside and moved into place; a later call with the same file leaves out what went well.

Jobs are in turn by the order given. An empty list gives an empty table; names must differ.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..operators.trials import unique
from ..operators.validate import check_whole, require
from ..sources import tables

STATUS = "name string, dataset string, status string, message string, seconds double"


@dataclass
class Job:
    """A run: what to do with the session, and the data set that it takes."""

    name: str
    dataset: str
    work: Callable[[SparkSession], object]
    status: str = "waiting"
    message: str | None = None
    began: float | None = None
    seconds: float | None = None
    done: threading.Event = field(default_factory=threading.Event)
    stopped: bool = False

    def row(self) -> dict:
        return {"name": self.name, "dataset": self.dataset, "status": self.status, "message": self.message, "seconds": self.seconds}


def names_of(text: str) -> list[str]:
    """A list written with commas: lower case, each name once, in order."""
    return unique([x.strip().lower() for x in text.split(",") if x.strip()])


def exclusive_of(datasets: Iterable[str], wanted: Iterable[str]) -> set[str]:
    """Those data sets that run alone, of those that run at all."""
    return set(wanted) & set(datasets)


class Supervisor:
    def __init__(self, spark: SparkSession, most: int = 4, exclusive: Iterable[str] = (), seconds: float | None = None, stop_on_failure: bool = False, path: str | None = None, every: float = 0.05):
        check_whole("most", most, 1)
        require(seconds is None or seconds > 0, "a time limit is positive")
        self.spark, self.most, self.exclusive, self.seconds = spark, most, set(exclusive), seconds
        self.stop_on_failure, self.path, self.every = stop_on_failure, path, every
        self.lock = threading.Lock()

    def _note(self, jobs: list[Job]) -> None:
        if self.path:
            with self.lock:
                tables.write_json(self.path, {"updated": tables.stamp(), "jobs": [j.row() for j in jobs]})

    def _group(self, job: Job) -> str:
        return f"liftwork-{id(self)}-{job.name}"

    def _run(self, job: Job) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup(self._group(job), job.name, interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", job.name)
        try:
            job.work(self.spark)
            status, message = "ok", None
        except Exception as e:  # a failed run is a row of the status
            status, message = "error", str(e)[:500]
        if not job.stopped:
            job.status, job.message = status, message
        job.seconds = time.time() - job.began
        job.done.set()

    def _stop(self, job: Job, why: str) -> None:
        job.stopped, job.status, job.message = True, "cancelled", why
        self.spark.sparkContext.cancelJobGroup(self._group(job))

    def _may_start(self, job: Job, running: list[Job]) -> bool:
        if len(running) >= self.most or any(r.dataset in self.exclusive for r in running):
            return False
        return not running or job.dataset not in self.exclusive

    def run(self, jobs: list[Job]) -> DataFrame:
        """The status of all jobs once they have ended."""
        require(len({j.name for j in jobs}) == len(jobs), "jobs need names of their own")
        before = {r["name"]: r for r in tables.read_json(self.path)["jobs"]} if self.path and os.path.exists(self.path) else {}
        for j in jobs:
            if before.get(j.name, {}).get("status") == "ok":
                j.status, j.seconds = "ok", before[j.name]["seconds"]
        waiting, running, broken = [j for j in jobs if j.status == "waiting"], [], False
        self._note(jobs)
        while waiting or running:
            for j in list(running):
                if j.done.is_set():
                    running.remove(j)
                    broken |= self.stop_on_failure and j.status != "ok"
                    self._note(jobs)
                elif self.seconds and not j.stopped and time.time() - j.began > self.seconds:
                    self._stop(j, f"took more than {self.seconds} s")
            if broken:
                for j in [j for j in running if not j.stopped]:
                    self._stop(j, "another run failed")
                for j in waiting:
                    j.status = "not started"
                waiting = []
            while waiting and self._may_start(waiting[0], running):
                job = waiting.pop(0)
                job.status, job.began = "running", time.time()
                running.append(job)
                InheritableThread(target=self._run, args=(job,), daemon=True, session=self.spark).start()
                self._note(jobs)
            time.sleep(self.every)
        self._note(jobs)
        return self.spark.createDataFrame([tuple(j.row().values()) for j in jobs], STATUS)
