"""Run, task and progress state, and what status, history and resume read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.values import task_table

RUNS = "run_id string, started_at timestamp_ntz, completed_at timestamp_ntz, status string, source_schema string, target_schema string"
TASKS = "task_id bigint, run_id string, task_key string, status string, error string"
PROGRESS = "task_id bigint, last_key bigint, rows_done bigint, rows_total bigint"


def task_progress(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    return tasks.join(progress, "task_id", "left").select("task_id", "run_id", "task_key", "status", F.coalesce("rows_done", F.lit(0)).alias("rows_done"), F.coalesce("rows_total", F.lit(0)).alias("rows_total"))


def saved_progress(progress: DataFrame, updates: DataFrame) -> DataFrame:
    """Progress after updates of the same columns: a task's row is replaced or added."""
    return progress.join(updates.select("task_id"), "task_id", "left_anti").unionByName(updates.select(progress.columns))


def cleared_progress(progress: DataFrame, tasks: DataFrame) -> DataFrame:
    return progress.join(tasks.select("task_id"), "task_id", "left_anti")


def created_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks with new ones: a (run_id, task_key) that is there is kept as it is."""
    key = ["run_id", "task_key"]
    return tasks.unionByName(new.join(tasks.select(*key), key, "left_anti").select(tasks.columns))


def history(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with the counts of their tasks, by start, the newest first."""
    counts = ("total", "pending", "running", "success", "failed")
    joined = runs.join(run_stats(tasks), "run_id", "left")
    return joined.select("run_id", "started_at", "completed_at", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).orderBy(F.desc("started_at"))


def run_stats(tasks: DataFrame) -> DataFrame:
    """(run_id, total, pending, running, success, failed)"""
    return tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "success", "failed")])


def table_rollup(joined: DataFrame) -> DataFrame:
    """Split tasks by table: sums, and failed over running over pending; success only if all succeeded."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    status = F.when(has("failed"), "failed").when(has("running"), "running").when(has("pending"), "pending").otherwise("success")
    return joined.groupBy(task_table(F.col("task_key")).alias("table_name")).agg(F.sum("rows_done").alias("rows_done"), F.sum("rows_total").alias("rows_total"), F.count(F.lit(1)).alias("n_tasks"), status.alias("status"))


def run_progress(joined: DataFrame) -> DataFrame:
    total, done = F.sum("rows_total"), F.sum("rows_done")
    return joined.groupBy("run_id").agg(done.alias("rows_done"), total.alias("rows_total"), F.when(total > 0, F.round(100.0 * done / total, 4)).otherwise(F.lit(0.0)).alias("percent"))


def latest_running(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'running'").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def superseded(runs: DataFrame) -> DataFrame:
    """Running runs after which a run of the same schemas succeeded."""
    of = ["source_schema", "target_schema"]
    later = runs.where("status = 'success'").groupBy(*of).agg(F.max("started_at").alias("_later"))
    return runs.where("status = 'running'").join(later, of).where("_later > started_at").select(*runs.columns)


def expired(runs: DataFrame, now: Column, days: int) -> DataFrame:
    """Finished runs older than so many days; partial ones are kept."""
    return runs.where(F.col("status").isin("success", "failed") & (F.col("completed_at") < now - F.make_dt_interval(F.lit(days))))


def without(rows: DataFrame, gone: DataFrame, key: str = "run_id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def resume_plan(joined: DataFrame, target_rows: DataFrame) -> DataFrame:
    """(table_name, action): skip a finished table whose target has all rows, restart one whose target lost rows, else go on."""
    rolled = table_rollup(joined).join(target_rows, "table_name", "left")
    action = (
        F.when(F.col("n_rows").isNull(), "create")
        .when((F.col("status") == "success") & (F.col("n_rows") == F.col("rows_total")), "skip")
        .when(F.col("n_rows") < F.col("rows_done"), "restart")
        .otherwise("continue")
    )
    return rolled.select("table_name", action.alias("action"))


def contiguous(acks: DataFrame) -> DataFrame:
    """(reader_id, seq, last_key): per reader the last acknowledgement before the first gap; repeats count once."""
    w = Window.partitionBy("reader_id").orderBy("seq")
    unbroken = acks.groupBy("reader_id", "seq").agg(F.max("last_key").alias("last_key")).where(F.lit(True)).withColumn("_n", F.row_number().over(w) - 1).where("seq = _n")
    return unbroken.groupBy("reader_id").agg(F.max("seq").alias("seq"), F.max_by("last_key", "seq").alias("last_key"))


def safe_checkpoint(acks: DataFrame, ranges: DataFrame) -> DataFrame:
    """The key up to which all is done: that of the first incomplete reader in range order, or the end of the last.

    ranges(reader_id, above, up_to). A reader without acknowledgements stands at the start of its range.
    """
    at = ranges.join(contiguous(acks).select("reader_id", "last_key"), "reader_id", "left").withColumn("last", F.coalesce("last_key", "above"))
    open_ = F.when(F.col("last") < F.col("up_to"), F.col("reader_id"))
    return at.agg(F.coalesce(F.min_by("last", open_), F.max("up_to")).alias("checkpoint"))


def sync_plan(tables: DataFrame, marks: DataFrame) -> DataFrame:
    """(table_name, mode): incremental, first_sync or no_date_column, from tables(table_name, date_column) and marks(table_name, mark)."""
    mode = F.when(F.col("date_column").isNull(), "no_date_column").when(F.col("mark").isNull(), "first_sync").otherwise("incremental")
    return tables.join(marks, "table_name", "left").select("table_name", mode.alias("mode"))


def first_failures(events: DataFrame) -> DataFrame:
    """The first error of each table, from events(table_name, seq, error)."""
    return events.where("error is not null").groupBy("table_name").agg(F.min_by("error", "seq").alias("error"))
