"""Throughput trends, tuning rules and table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.sources.scan import numbered


def with_trend(samples: DataFrame, order: str = "ts", by: str | None = None, block: int = 100_000) -> DataFrame:
    """samples(throughput, cpu, memory) with change, decline, baseline and flags.

    Trends are a job's own with `by`. Without it all rows are one history: they are numbered over a written range
    partitioning and dealt to blocks of `block` rows; each block also gets the two rows before it, and the baseline is the
    third row's, so no task sees more than a block.
    """
    if by is None:
        rows = numbered(samples, [order], "_n")
        head = rows.where("_n <= 3").agg(F.avg("throughput").alias("mean"), F.count(F.lit(1)).alias("n")).first()
        own = F.expr(f"(_n - 1) div {block}")
        # the last two rows of a block, and of blocks of one row those before them, are seen by the next ones too
        reach = F.expr(f"(_n + 1) div {block}")
        rows = rows.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, reach)))
        w = Window.partitionBy("_block").orderBy("_n")
    else:
        w = Window.partitionBy(by).orderBy(order)
        rows = samples
    x1, x2 = F.lag("throughput", 1).over(w), F.lag("throughput", 2).over(w)
    m1, m2 = F.lag("memory", 1).over(w), F.lag("memory", 2).over(w)
    rows = rows.select("*", x1.alias("_x1"), x2.alias("_x2"), m1.alias("_m1"), m2.alias("_m2"))
    if by is None:
        third = F.lit(head["mean"] if head["n"] == 3 else None).cast("double")
        rows = rows.where("_own = _block").drop("_own", "_block").withColumn("baseline", F.when(F.col("_n") >= 3, third))
    else:
        rows = rows.withColumns({"_avg": F.avg("throughput").over(w.rowsBetween(-2, 0)), "_n": F.row_number().over(w)})
        rows = rows.withColumn("baseline", F.max(F.when(F.col("_n") == 3, F.col("_avg"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_avg")
    change = F.when(F.col("_x1") > 0, (F.col("throughput") - F.col("_x1")) / F.col("_x1") * 100).otherwise(F.lit(0.0))
    decline = F.when((F.col("_x2") > 0) & (F.col("throughput") > 0), F.greatest((F.col("_x2") - F.col("throughput")) / F.col("_x2"), F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumns({"change_pct": change, "decline": decline})
    flags = {
        "insufficient": F.col("_n") < 3,
        "decreasing": (F.col("_n") >= 3) & (F.col("decline") > 0.2),
        "memory_rising": F.coalesce((F.col("memory") > F.col("_m1") * 1.05) & (F.col("_m1") > F.col("_m2") * 1.05), F.lit(False)),
        "cpu_high": F.col("cpu") > 90,
        "memory_high": F.col("memory") > 85,
    }
    return rows.withColumns(flags).drop("_x1", "_x2", "_m1", "_m2", "_n")


def decision(chunk: int = 50_000, workers: int = 4, cores: int = 8, least_chunk: int = 5000) -> Column:
    """The action of the first tuning rule that fits a row of with_trend(), given the settings in force: continue, reduce_chunk, scale_down or scale_up.

    Too few samples and a throughput within a tenth of the baseline change nothing; nor does a setting at its end.
    """
    near = (F.col("baseline") > 0) & (F.abs(F.col("throughput") - F.col("baseline")) <= 0.1 * F.col("baseline"))
    return (
        F.when(F.col("insufficient") | F.coalesce(near, F.lit(False)), "continue")
        .when(F.col("memory_high"), "reduce_chunk" if max(chunk // 2, least_chunk) != chunk else "continue")
        .when(F.col("cpu_high"), "scale_down" if workers > 1 else "continue")
        .when(F.col("decreasing"), "scale_up" if workers < cores else "continue")
        .otherwise("continue")
    )


def last_samples(samples: DataFrame, k: int, order: str = "ts", by: list[str] = ()) -> DataFrame:
    """The newest k samples (of each job, with `by`), oldest first."""
    if not by:
        return samples.orderBy(F.desc(order)).limit(k).orderBy(order)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return samples.withColumn("_at", at).where(F.col("_at") <= k).drop("_at")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, avg_bytes): rows and average bytes as text of each table; 0 bytes for an empty one."""
    parts = []
    for name, df in sorted(tables.items()):
        size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))), F.lit(0)).cast("long")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("total"))
        parts.append(one.select(F.lit(name).alias("table_name"), "n_rows", F.coalesce(F.expr("total div nullif(n_rows, 0)"), F.lit(0)).alias("avg_bytes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timing_profile(timings: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, query_pct, scan_pct, write_pct, rows_per_second) from timings(by, query_s, scan_s, write_s, rows); nulls without time."""
    parts = ("query", "scan", "write")
    sums = timings.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.sum(f"{p}_s").alias(p) for p in parts])
    total = F.nullif(F.col("query") + F.col("scan") + F.col("write"), F.lit(0.0))
    return sums.select(*by, "rows", *[F.round(F.col(p) / total * 100, 4).alias(f"{p}_pct") for p in parts], F.round(F.col("rows") / total, 4).alias("rows_per_second"))


def progress_update(tasks: DataFrame, seconds: float) -> DataFrame:
    """One row of progress from tasks(table_name, status, rows_done, rows_total): tables by state, rows, percent, rows a second and the tables at work."""
    tables = tasks.groupBy("table_name").agg(
        F.sum("rows_done").alias("done"), F.sum("rows_total").alias("total"), F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("status") == "running").alias("running"), F.bool_and(F.col("status") == "success").alias("complete")
    )
    done, total = F.coalesce(F.sum("done"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    return tables.agg(
        F.count_if("complete").alias("tables_complete"), F.count(F.lit(1)).alias("tables_total"), F.count_if("running").alias("tables_running"), done.alias("rows_transferred"), total.alias("rows_total"),
        F.when(total > 0, F.round(done * 100.0 / total, 4)).otherwise(F.lit(0.0)).alias("progress_pct"), F.floor(done / F.lit(seconds)).cast("bigint").alias("rows_per_second") if seconds > 0 else F.lit(0).cast("bigint").alias("rows_per_second"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("running"), F.col("table_name")))), ",").alias("current_tables"), F.count_if("failed").alias("error_count"),
    )


def largest(tables: DataFrame, n: int = 5) -> DataFrame:
    return tables.orderBy(F.desc("n_rows"), "table_name").limit(n)


def row_size_stats(tables: DataFrame) -> DataFrame:
    """Row-weighted average size and the largest, over tables with a known size."""
    sized = tables.where("avg_bytes > 0")
    return sized.agg(F.round(F.sum(F.col("n_rows") * F.col("avg_bytes")) / F.sum("n_rows"), 4).alias("weighted"), F.max("avg_bytes").alias("largest"), F.max_by("table_name", F.struct("avg_bytes", "table_name")).alias("largest_table"))


def average_row_size(tables: DataFrame) -> DataFrame:
    """Mean of the five largest tables, whole bytes; 500 if unknown, 2,000 at most."""
    top = largest(tables).where("n_rows > 0 and avg_bytes > 0")
    return top.agg(F.least(F.coalesce(F.floor(F.avg("avg_bytes")), F.lit(500)), F.lit(2000)).cast("bigint").alias("row_bytes"))


def action_effects(actions: DataFrame, least: float = 10.0, n: int = 3) -> DataFrame:
    """(action, n, mean_effect): the best actions by mean effect in percent, from before and after."""
    effect = (F.col("after") - F.col("before")) / F.col("before") * 100
    return actions.where("before > 0").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(effect), 4).alias("mean_effect")).where(F.col("mean_effect") > least).orderBy(F.desc("mean_effect"), "action").limit(n)
