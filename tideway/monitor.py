"""Progress lines and metric samples of a running transfer."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SAMPLES = "ts double, throughput double, cpu double, memory double, rows bigint"


def progress_line(phase: str, tasks: list[dict], seconds: float) -> str:
    """One JSON line: tables by state, rows, percent, rows a second, the tables at work and the failures."""
    tables: dict[str, list[dict]] = {}
    for t in tasks:
        tables.setdefault(t["table"], []).append(t)
    is_ = lambda rows, s: any(t["status"] == s for t in rows)
    done, total = (sum(t.get(k) or 0 for t in tasks) for k in ("rows_done", "rows_total"))
    return json.dumps(
        {
            "phase": phase,
            "tables_complete": sum(all(t["status"] == "success" for t in rows) for rows in tables.values()),
            "tables_total": len(tables),
            "tables_running": sum(is_(rows, "running") for rows in tables.values()),
            "rows_transferred": done,
            "rows_total": total,
            "progress_pct": done / total * 100 if total else 0.0,
            "rows_per_second": int(done / seconds) if seconds > 0 else 0,
            "current_tables": sorted(n for n, rows in tables.items() if is_(rows, "running")),
            "error_count": sum(is_(rows, "failed") for rows in tables.values()),
        }
    )


class SparkMetrics:
    """What Spark's own status store says of the stages that began since this was made, and of the executors now."""

    def __init__(self, spark: SparkSession) -> None:
        self.context = spark.sparkContext
        self.store = self.context._jsc.sc().statusStore()
        self.before = {s.stageId() for s in self._stages()}

    def _list(self, seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def _stages(self) -> list:
        none = self.context._gateway.new_array(self.context._jvm.double, 0)
        empty = self.context._jvm.java.util.ArrayList()
        return self._list(self.store.stageList(empty, False, False, none, empty))

    def rows(self) -> int:
        """Rows that stages have written to their outputs."""
        return sum(s.outputRecords() for s in self._stages() if s.stageId() not in self.before)

    def load(self) -> tuple[float, float]:
        """Percent of all executors' cores at work, and of their memory in use."""
        found = self._list(self.store.executorList(True))
        # one machine alone runs tasks in its driver
        workers = [e for e in found if e.id() != "driver"] or found
        cores, most = sum(e.totalCores() for e in workers), sum(e.maxMemory() for e in workers)
        busy, used = sum(e.activeTasks() for e in workers), sum(e.memoryUsed() for e in workers)
        return 100.0 * min(busy, cores) / cores if cores else 0.0, 100.0 * used / most if most else 0.0


class Collector:
    """Samples every `interval` seconds while it is entered: rows by now over the time since the start, and load and memory:
    the executors' with a SparkMetrics (which can count the rows too), else the driver machine's. The newest `keep` stay."""

    def __init__(self, rows: Callable[[], int] | None = None, interval: float = 30.0, keep: int = 100, spark: SparkSession | None = None) -> None:
        self.metrics = SparkMetrics(spark) if spark else None
        self.rows = rows or self.metrics.rows
        self.interval, self.keep, self.samples = interval, keep, []
        self._stop, self._thread = threading.Event(), None

    def sample(self) -> None:
        n, seconds = self.rows(), time.time() - self.began
        if self.metrics:
            self._keep(n, seconds, *self.metrics.load())
            return
        memory = {k: int(v.split()[0]) for k, v in (x.split(":") for x in Path("/proc/meminfo").read_text().splitlines())} if Path("/proc/meminfo").exists() else {}
        used = 100.0 * (1 - memory["MemAvailable"] / memory["MemTotal"]) if memory else 0.0
        self._keep(n, seconds, min(100.0, 100.0 * os.getloadavg()[0] / (os.cpu_count() or 1)), used)

    def _keep(self, n: int, seconds: float, cpu: float, memory: float) -> None:
        self.samples = [*self.samples, (time.time(), n / seconds if seconds > 0 else 0.0, cpu, memory, n)][-self.keep :]

    def __enter__(self) -> Collector:
        self.began = time.time()

        def loop() -> None:
            while not self._stop.wait(self.interval):
                self.sample()

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()
        self.sample()

    def df(self, spark: SparkSession) -> DataFrame:
        """The samples for metrics.with_trend()."""
        return spark.createDataFrame(self.samples, SAMPLES)
