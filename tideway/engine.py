"""Runs: plan, split, load or merge, validate, remember. State is one JSON file of runs, tasks and sync marks, written by a single driver; tables keep their own versions (targets)."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway import monitor
from tideway.catalog import TableSpec, catalog
from tideway.functions.values import normalized
from tideway.operators import metrics, validate
from tideway.operators.analyze import EXIT_CODES, EXIT_RULES, NOT_CONFIG, exclusion_candidate, ranked_date_columns, retryable_text
from tideway.plans import splits
from tideway.plans.ranges import KeyRange, equal_ranges
from tideway.sources import jdbc, tables
from tideway.sources.scan import read
from tideway.statefile import StateFile
from tideway.targets import DatabaseTarget, FolderTarget, ddl

STATE = {"runs": [], "tasks": [], "marks": {}, "sequences": {}}
INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Step:
    """What is read and written at once: ranges of keys that follow each other, some files, or (both empty) the whole table."""

    ranges: tuple[KeyRange, ...] = ()
    files: tuple[str, ...] = ()


@dataclass(frozen=True)
class Job:
    """A table, or one numbered split of it, in steps of which each is kept when it is done."""

    table: str
    part: int | None = None
    steps: tuple[Step, ...] = (Step(),)

    @property
    def key(self) -> str:
        return f"transfer:{self.table}" + (f":p{self.part}" if self.part is not None else "")

    @property
    def files(self) -> tuple[str, ...]:
        return tuple(f for s in self.steps for f in s.files)

    @property
    def ranges(self) -> tuple[KeyRange, ...]:
        return tuple(r for s in self.steps for r in s.ranges)

    def to_json(self) -> list:
        return [self.part, [[[r.to_json() for r in s.ranges], list(s.files)] for s in self.steps]]

    @staticmethod
    def from_json(table: str, text: list) -> Job:
        return Job(table, text[0], tuple(Step(tuple(map(KeyRange.from_json, r)), tuple(f)) for r, f in text[1]))


def _dealt(items: list, n: int) -> list[list]:
    """items in at most n lists of nearly equal length, in order."""
    size, more = divmod(len(items), n)
    at = [i * size + min(i, more) for i in range(n + 1)]
    return [items[a:b] for a, b in zip(at, at[1:]) if b > a]


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(timespec="seconds")


class Engine:
    """Replicates the tables of `source` into a folder (targets.FolderTarget) or a database (targets.DatabaseTarget; `target` is its JDBC options).

    Tables of more than `threshold` rows are read in splits: files by groups, all else by ranges of whole keys, whatever
    their columns and types. A split is read in `steps`, a database's steps by `readers` partitions each. Every step has
    a folder or a staging table of its own and is recorded when it is done, after every `cadence` steps in the file too,
    so a run that resumes goes on with the steps that are missing. A table is published once all of it is there and its
    rows have been held against the source's. Runs that ended `keep_days` ago leave the state, unless they were partial.
    """

    def __init__(self, spark: SparkSession, source: str, target: str | dict, state: str, specs: list[TableSpec], mode: str = "reload", workers: int = 4, retries: int = 3, wait: float = 1.0, threshold: int = 5_000_000, chunk: int = 100_000, most: int = 8, bucket_rows: int = 1_000_000, cadence: int = 1, progress: str | None = None, steps: int = 1, readers: int = 4, keep_days: int = 30, sample: int = 0) -> None:
        if isinstance(target, str) and source.rstrip("/") == target.rstrip("/"):
            raise ValueError("source and target are the same")
        self.spark, self.source, self.target, self.mode, self.workers, self.retries, self.wait = spark, source, target.rstrip("/") if isinstance(target, str) else target["url"], mode, workers, retries, wait
        self.threshold, self.chunk, self.most, self.cadence, self.progress = threshold, chunk, most, max(1, cadence), progress
        self.steps, self.readers, self.keep_days, self.sample = max(1, steps), max(1, readers), keep_days, sample
        self.specs = {s.name: s for s in specs}
        self.counted: dict[str, int] = {}
        self.lines: list[str] = []
        self.folder = FolderTarget(spark, target, bucket_rows) if isinstance(target, str) else None
        self.database = None if self.folder else DatabaseTarget(spark, target)
        self.file = StateFile(spark, state)
        self.state = self.file.load(json.loads(json.dumps(STATE)))

    def _save(self) -> None:
        with self.file.lock:
            self.file.save(self.state)

    def config_hash(self) -> str:
        text = json.dumps([self.source, self.target, self.mode, sorted(self.specs)])
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    # the target

    def current(self, table: str) -> DataFrame | None:
        return self.folder.current(table) if self.folder else self.database.current(self.specs[table])

    def clean(self) -> list[str]:
        """Delete what older versions of the tables need alone; returns these folders. Readers that began before the last run may still need them, so runs call this first."""
        gone = [f for t in self.specs for f in self.folder.prune(t)] if self.folder else []
        limit = (dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(days=self.keep_days)).isoformat()
        with self.file.lock:
            old = {r["run_id"] for r in self.state["runs"] if r["status"] in ("success", "failed") and r.get("completed_at", limit) < limit}
            if old:
                self.state["runs"] = [r for r in self.state["runs"] if r["run_id"] not in old]
                self.state["tasks"] = [t for t in self.state["tasks"] if t["run_id"] not in old]
        return gone

    def upsert(self, table: str, rows: DataFrame) -> list[str]:
        """Merge rows into the table; returns the buckets that were rewritten, or for a database the number of rows that changed. See targets."""
        spec = self.specs[table]
        if self.folder:
            return self.folder.upsert(spec, rows)
        part = uuid.uuid4().hex[:8]
        try:
            self.database.stage(spec, rows, part)
            return [str(self.database.merge(spec, part, rows.columns))]
        finally:
            self.database.drop(spec, [part])

    # planning

    def selected(self, include: list[str] = (), exclude: list[str] = ()) -> list[str]:
        low = {t: t.lower() for t in self.specs}
        hit = lambda t, globs: any(fnmatchcase(low[t], g.lower()) for g in globs)
        return sorted(t for t in self.specs if (not include or hit(t, include)) and not hit(t, exclude))

    def _source(self, table: str) -> DataFrame:
        return normalized(read(self.spark, self.source, self.specs[table]), self.specs[table].kinds)

    def _count(self, table: str) -> int:
        spec = self.specs[table]
        return int(jdbc.scalar(self.spark, spec.options, f"SELECT COUNT(*) AS n FROM {spec.options['dbtable']}")) if spec.format == "jdbc" else self._source(table).count()

    def plan(self, table: str, threshold: int | None = None, chunk: int | None = None, most: int | None = None) -> tuple[int, str, int, list[str]]:
        """(rows, method, splits, files to deal) of a table, for dry_run() and run() alike."""
        spec, df, n = self.specs[table], self._source(table), self._count(table)
        keyset = len(spec.key) == 1 and dict(df.dtypes)[spec.key[0]] in INTEGERS
        method = splits.strategy(n, keyset, bool(spec.key), threshold or self.threshold)
        self.counted[table] = n
        files = sorted(df.inputFiles()) if spec.format != "jdbc" else []
        parts = 1 if method == "full_table" else splits.split_count(n, chunk or self.chunk, most or self.most)
        return n, method, min(parts, len(files)) if len(files) > 1 else parts, files

    def dry_run(self, threshold: int | None = None, chunk: int | None = None, most: int | None = None, row_bytes: int = 500, buffers: int = 4) -> list[dict]:
        """What a run would do with each table, and the bytes that its buffers would take."""
        out = []
        for t in self.selected():
            n, method, parts, _ = self.plan(t, threshold, chunk, most)
            out.append({"table": t, "rows": n, "method": method, "partitions": parts, "columns": len(self._source(t).columns), "has_key": bool(self.specs[t].key), "memory": self.workers * buffers * (chunk or self.chunk) * row_bytes})
        return out

    def jobs(self, table: str) -> list[Job]:
        """The splits of a table, or the whole of it."""
        if self.mode == "upsert":
            return [Job(table)]
        spec, (_, method, parts, files) = self.specs[table], self.plan(table)
        if method == "full_table":
            return [Job(table)]
        if len(files) > 1:
            return [Job(table, i + 1, tuple(Step(files=tuple(f)) for f in _dealt(part, self.steps))) for i, part in enumerate(_dealt(files, parts))]
        if spec.format == "jdbc":
            ranges = jdbc.key_ranges(self.spark, spec.options["dbtable"], {k: v for k, v in spec.options.items() if k != "dbtable"}, list(spec.key), parts * self.steps * self.readers)
        else:
            ranges = equal_ranges(self._source(table), list(spec.key), parts * self.steps)
        return [Job(table, i + 1, tuple(Step(tuple(r)) for r in _dealt(part, self.steps))) for i, part in enumerate(_dealt(ranges, parts))]

    def _rows(self, job: Job, step: Step) -> DataFrame:
        spec = self.specs[job.table]
        if step.files:
            found = self.spark.read.format(spec.format).options(**spec.options).schema(read(self.spark, self.source, spec).schema).load(list(step.files))
            return normalized(found, spec.kinds)
        if not step.ranges:
            return self._source(job.table)
        if spec.format == "jdbc":
            found = jdbc.read_table(self.spark, spec.options["dbtable"], {k: v for k, v in spec.options.items() if k != "dbtable"}, ranges=list(step.ranges))
            return normalized(found, spec.kinds)
        return self._source(job.table).where(KeyRange(0, step.ranges[0].key, step.ranges[0].above, step.ranges[-1].up_to).where())

    def _preconditions(self, tables: list[str]) -> None:
        """Everything that stands against an upsert, in one error."""
        if self.mode != "upsert":
            return
        wrong = [f"{t}: no primary key" for t in tables if not self.specs[t].key]
        if self.folder:
            versions = {t: self.folder.version(t) for t in tables}
            wrong += [f"{t}: target is missing" for t in tables if versions[t] is None]
            wrong += [f"{t}: target has the key {','.join(versions[t]['key']) or 'none'}" for t in tables if versions[t] and versions[t]["key"] != list(self.specs[t].key)]
        else:
            wrong += [f"{t}: target is missing" for t in tables if not self.database.exists(self.database.name(self.specs[t]))]
        if wrong:
            raise ValueError("; ".join(wrong))

    # running

    def _load(self, run: dict, job: Job, task: dict) -> None:
        spec = self.specs[job.table]
        if self.mode == "upsert":
            rows = self._source(job.table)
            mark = self.state["marks"].get(spec.mark)
            changed = rows.where(F.col(f"`{spec.date_column}`") >= F.lit(mark)) if mark and spec.date_column else rows
            self.upsert(job.table, changed)
            # a database has its checks
            run["warnings"] += [f"{job.table}: rows break {c}" for c in spec.checks if self.folder and not validate.broken(changed, c).isEmpty()]
            return
        done = task.setdefault("done", {})
        for i, step in enumerate(job.steps):
            if str(i) not in done:
                rows = self._rows(job, step)
                if self.folder:
                    done[str(i)] = self.folder.write(job.table, list(spec.key), rows, self._folder(run, job, i), run["buckets"][job.table])
                else:
                    done[str(i)] = {"0": self.database.stage(spec, rows, self._folder(run, job, i).replace("/", "_"))}
                task["rows_done"] = task["rows_total"] = sum(sum(c.values()) for c in done.values())
                top = step.ranges[-1].top if step.ranges else None
                task["last_key"] = top[0] if top and len(top) == 1 and isinstance(top[0], int) else None
                self._done(run)

    def _folder(self, run: dict, job: Job, step: int) -> str:
        return f"{run['run_id']}/p{job.part or 0}" + (f"s{step}" if len(job.steps) > 1 else "")

    def _task(self, run: dict, job: Job) -> dict:
        task = self._record(run, job)
        if task["status"] == "success":
            return task
        task |= {"status": "running", "started_at": _now(), "error": None}
        # with FAIR scheduling each table has its share, so small ones end beside large ones
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", job.table)
        for attempt in range(self.retries + 1):
            task["retry_count"] = attempt
            try:
                self._load(run, job, task)
                task |= {"status": "success", "completed_at": _now(), "error": None}
                break
            except Exception as e:  # recorded; other tables go on
                task |= {"status": "failed", "completed_at": _now(), "error": str(e)[:500]}
                if attempt == self.retries or not retryable_text(str(e)):
                    break
                time.sleep(self.wait * 2**attempt)
        self._done(run)
        return task

    def _record(self, run: dict, job: Job) -> dict:
        """The task of a job in this run: the one that is there, or a new one."""
        with self.file.lock:
            found = next((t for t in self.state["tasks"] if (t["run_id"], t["task_key"]) == (run["run_id"], job.key)), None)
            if found is None:
                found = {"task_id": len(self.state["tasks"]) + 1, "run_id": run["run_id"], "task_key": job.key, "table": job.table, "status": "pending", "retry_count": 0, "max_retries": self.retries, "error": None, "started_at": None, "completed_at": None, "rows_done": 0, "rows_total": 0, "last_key": None}
                self.state["tasks"].append(found)
            return found

    def _done(self, run: dict) -> None:
        """State goes to its file after every `cadence` finished steps and tasks; one that a lost state forgets is only repeated."""
        with self.file.lock:
            run["finished"] = run.get("finished", 0) + 1
            if run["finished"] % self.cadence == 0:
                self._save()
            if self.progress:
                mine = [t for t in self.state["tasks"] if t["run_id"] == run["run_id"]]
                self.lines.append(monitor.progress_line("transferring", mine, time.time() - run["began"]))
                self.file.write(self.progress, "\n".join(self.lines) + "\n")

    def run(self, include: list[str] = (), exclude: list[str] = ()) -> dict:
        names = self.selected(include, exclude)
        self._preconditions(names)
        self.clean()
        run = {"run_id": uuid.uuid4().hex[:8], "started_at": _now(), "status": "running", "config_hash": self.config_hash(), "tables": names, "warnings": [], "buckets": {}}
        self.state["runs"].append(run)
        self._save()
        return self._finish(run, names)

    def _finish(self, run: dict, names: list[str]) -> dict:
        run["began"] = time.time()
        marks = {t: _now() for t in names}  # before reading
        planned = run.setdefault("jobs", {})
        with ThreadPoolExecutor(self.workers) as pool:
            # a resumed run keeps its plan, as its finished splits belong to it
            new = [t for t in names if t not in planned]
            for t, of in zip(new, pool.map(self.jobs, new)):
                planned[t] = [j.to_json() for j in of]
            # what the plan counted
            sizes = {t: self.counted[t] for t in new} if self.mode != "upsert" else {}
            run.setdefault("sizes", {}).update(sizes)
            for t in sizes:
                run["buckets"][t] = self.folder.buckets_for(self.specs[t], sizes[t]) if self.folder else 1
            jobs = [Job.from_json(t, of) for t in names for of in planned[t]]
            for j in jobs:
                self._record(run, j)
            self._save()
            # first splits and whole tables, then the rest
            done = list(pool.map(lambda j: self._task(run, j), [j for j in jobs if j.part in (None, 1)]))
            done += pool.map(lambda j: self._task(run, j), [j for j in jobs if j.part not in (None, 1)])
        failed = [t for t in done if t["status"] == "failed"]
        lost = {t["table"] for t in failed}
        errors = {t["task_key"]: t["error"] for t in failed}
        if self.database and self.mode != "upsert":
            self.database.unfinalize([self.specs[t] for t in names if t not in lost])
        for t in [t for t in names if t not in lost]:
            try:
                if self.mode != "upsert":
                    self._publish(run, t, [j for j in jobs if j.table == t])
                self.state["marks"][self.specs[t].mark] = marks[t]
            except Exception as e:
                lost.add(t)
                errors[f"publish:{t}"] = str(e)[:500]
        whole = [t for t in names if t not in lost]
        run |= {"status": "success" if not lost else "partial" if whole else "failed", "completed_at": _now()}
        self._save()
        if self.mode != "upsert":
            run["warnings"] += self.finalize(whole)
        for t in whole if self.sample else []:
            n = validate.sampled_keys(self._source(t), self.current(t), list(self.specs[t].key), self.sample).count() if self.specs[t].key else 0
            run["warnings"] += [f"{t}: {n} of {self.sample} sampled keys are missing"] if n else []
        self._save()
        return run | {"errors": errors}

    def _publish(self, run: dict, table: str, jobs: list[Job]) -> None:
        """Make the loaded table visible, if it has the rows that its source has: those counted when planning or, if the source changed since, those it has now."""
        spec = self.specs[table]
        tasks = [self._record(run, j) for j in jobs]
        written = [(self._folder(run, j, int(i)), counts) for j, t in zip(jobs, tasks) for i, counts in sorted(t["done"].items(), key=lambda x: int(x[0]))]
        rows = sum(sum(c.values()) for _, c in written)
        if rows != run["sizes"][table]:
            now = self._count(table)
            if rows < min(now, run["sizes"][table]):
                raise RuntimeError(f"row count of {table}: {rows} were loaded, its source had {run['sizes'][table]} and has {now}")
            run["warnings"].append(f"{table}: the source changed while it was read ({run['sizes'][table]} rows before, {now} after, {rows} loaded)")
        if self.folder:
            version = self.folder.version(table)
            self.folder.publish(spec, written, run["buckets"][table], ddl(self._source(table)), version["number"] if version else 0)
        else:
            self.database.publish(spec, [f.replace("/", "_") for f, _ in written], self._source(table).schema)

    def resume(self, force: bool = False) -> dict:
        """The newest running run goes on with the splits that aren't whole in the target."""
        running = [r for r in self.state["runs"] if r["status"] == "running"]
        if not running:
            raise ValueError("no running run")
        run = max(running, key=lambda r: r["started_at"])
        if any(r["status"] == "success" and r["config_hash"] == run["config_hash"] and r["started_at"] > run["started_at"] for r in self.state["runs"]):
            run["status"] = "failed"
            self._save()
            raise ValueError("a later run superseded it")
        if run["config_hash"] != self.config_hash() and not force:
            raise ValueError("settings changed since the run began")
        run.setdefault("warnings", [])
        run.setdefault("buckets", {})
        return self._finish(run, run["tables"])

    def finalize(self, names: list[str]) -> list[str]:
        """After a reload: the next value of integer keys is recorded; unique keys, foreign keys and checks that don't hold are warnings. A database gets its indexes and constraints, in this order."""
        out = []
        for t in names:
            df, spec = self.current(t), self.specs[t]
            if len(spec.key) == 1 and dict(df.dtypes)[spec.key[0]] in INTEGERS:
                self.state["sequences"][t] = df.agg(F.coalesce(F.max(f"`{spec.key[0]}`"), F.lit(0)) + 1).first()[0]
            if self.database:
                continue
            out += [f"{t}: repeated {','.join(k)}" for k in (spec.key, *spec.unique) if k and not validate.repeated(df, list(k)).isEmpty()]
            out += [f"{t}: orphans of {p}" for f, p, k in spec.foreign_keys if self.current(p) is not None and not validate.orphans(df, list(f), self.current(p), list(k)).isEmpty()]
            out += [f"{t}: rows break {c}" for c in spec.checks if not validate.broken(df, c).isEmpty()]
        return out + (self.database.finalize([self.specs[t] for t in names], set(self.specs)) if self.database else [])

    # looking

    def validate(self, timeout: float | None = None) -> DataFrame:
        """Row counts of both sides by table. With a timeout in seconds, a table whose counts come too late is judged by its files' footers; a difference of those is only estimated."""
        source = {t: self._source(t) for t in self.specs}
        target = {t: df for t in self.specs if (df := self.current(t)) is not None}
        if timeout is None:
            return validate.count_diff(source, target)

        def count(df: DataFrame) -> tuple[int | None, bool]:
            tag = uuid.uuid4().hex

            def exact() -> int:
                self.spark.addTag(tag)
                try:
                    return df.count()
                finally:
                    self.spark.removeTag(tag)

            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(exact).result(timeout), False
            except Late:
                self.spark.interruptTag(tag)
                return (tables.footer_count(df) or None) if df.inputFiles() else None, True
            finally:
                pool.shutdown(wait=False)

        rows = []
        for t in sorted(self.specs):
            a, late = count(source[t])
            b, later = count(target[t]) if t in target else (None, False)
            late |= later
            same = a == b
            status = "missing_target" if t not in target else "timeout" if late and (a is None or b is None) else ("ok" if same else "mismatch") + "_estimated" * late
            rows.append((t, a, b, status))
        return self.spark.createDataFrame(rows, "table_name string, source_rows bigint, target_rows bigint, status string")

    def health_check(self) -> dict:
        """Both sides at once: whether they answer, how fast, and how many tables the source has."""

        def side(path: str | DatabaseTarget) -> dict:
            began = time.time()
            try:
                if isinstance(path, DatabaseTarget):
                    n = sum(path.exists(path.name(s)) for s in self.specs.values())
                    jdbc.ping(self.spark, path.options)
                    return {"connected": True, "error": None, "tables": n, "latency_ms": int(1000 * (time.time() - began))}
                root = self.file.jvm.org.apache.hadoop.fs.Path(path)
                there = root.getFileSystem(self.file.conf).exists(root)
                n = len(tables.list_folder(self.spark, path)) if there else 0
                return {"connected": True, "error": None, "tables": n, "latency_ms": int(1000 * (time.time() - began))}
            except Exception as e:
                return {"connected": False, "error": str(e)[:500], "tables": 0, "latency_ms": int(1000 * (time.time() - began))}

        with ThreadPoolExecutor(2) as pool:
            source, target = pool.map(side, (self.source, self.target if self.folder else self.database))
        return {"timestamp": _now(), "source": source, "target": target, "healthy": source["connected"] and target["connected"]}

    def analyze(self) -> DataFrame:
        """(table_name, n_rows, avg_bytes, exclude, date_columns, large): sizes and suggestions for each source table; see defaults()."""
        frames = {t: self._source(t) for t in self.specs}
        sizes = metrics.table_sizes(frames)
        ranked = ranked_date_columns(catalog(self.spark, frames)).groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name"))), lambda x: x["column_name"]), ",").alias("date_columns"))
        out = sizes.join(ranked, "table_name", "left")
        return out.select("table_name", "n_rows", "avg_bytes", exclusion_candidate(F.col("table_name")).alias("exclude"), F.coalesce("date_columns", F.lit("")).alias("date_columns"), (F.col("n_rows") > self.threshold).alias("large"))

    def status(self) -> dict | None:
        if not self.state["runs"]:
            return None
        run = self.state["runs"][-1]
        mine = [t for t in self.state["tasks"] if t["run_id"] == run["run_id"]]
        return run | {"tasks": {s: sum(t["status"] == s for t in mine) for s in ("pending", "running", "success", "failed")}}

    def history(self) -> list[dict]:
        return list(self.state["runs"])

    def tasks(self) -> DataFrame:
        """All tasks as rows, for the functions of operators.state."""
        kinds = "task_id bigint, run_id string, task_key string, table string, status string, retry_count int, error string, started_at string, completed_at string, rows_done bigint, rows_total bigint, last_key bigint"
        names = [c.split()[0] for c in kinds.split(", ")]
        return self.spark.createDataFrame([tuple(t[n] for n in names) for t in self.state["tasks"]], kinds)


def exit_code(outcome: dict | BaseException) -> int:
    """The exit code of a run's result or of an exception that stopped it: operators.analyze.exit_code for one message on the driver."""
    if isinstance(outcome, dict):
        errors = list(outcome.get("errors", {}).values())
        return exit_code(RuntimeError(errors[0])) if errors else EXIT_CODES["success"]
    if isinstance(outcome, OSError):
        return EXIT_CODES["io"]
    if isinstance(outcome, KeyboardInterrupt):
        return EXIT_CODES["cancelled"]
    low = str(outcome).lower()
    for kind, parts in EXIT_RULES:
        if any(p in low for p in parts) and not (kind == "config" and any(p in low for p in NOT_CONFIG)):
            return EXIT_CODES[kind]
    return EXIT_CODES["transfer"]


def defaults(cores: int, row_bytes: int) -> dict:
    """Settings that go with a machine: workers leave two cores free, the rest follows from them."""
    workers = max(2, cores - 2)
    chunk = 50_000
    return {
        "workers": workers,
        "chunk_size": chunk,
        "read_ahead_buffers": 4,
        "write_ahead_writers": 2,
        "parallel_readers": 2,
        "max_partitions": workers,
        "large_table_threshold": 1_000_000,
        "max_source_connections": workers + 4,
        "max_target_connections": workers * 2 + 4,
        "upsert_merge_chunk_size": 5000,
        "checkpoint_frequency": 20,
        "max_retries": 3,
        "estimated_memory_mb": workers * 4 * chunk * row_bytes // 1024 // 1024,
    }
