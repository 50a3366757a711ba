"""Split planning: disjoint ranges of keys or row numbers that cover a table exactly once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.sources.scan import numbered_and_counted

@dataclass(frozen=True)
class Split:
    """Keys in (above, up_to], of which the bounds may be open."""

    number: int
    above: int | None
    up_to: int | None

    def predicate(self, key: str) -> str:
        """The range in Spark SQL, whatever the column is called; dialects.Dialect.predicate has the other databases' forms."""
        own = "`" + key.replace("`", "``") + "`"
        parts = ([f"{own} > {self.above}"] if self.above is not None else []) + ([f"{own} <= {self.up_to}"] if self.up_to is not None else [])
        return " AND ".join(parts) or "1 = 1"


def strategy(n_rows: int, keyset: bool, has_key: bool, threshold: int = 5_000_000) -> str:
    if n_rows <= threshold or not has_key:
        return "full_table"
    return "keyset" if keyset else "row_number"


def split_count(n_rows: int, chunk: int, most: int) -> int:
    return max(1, min(n_rows // max(1, chunk) + 1, most))


def reader_ranges(low: int, high: int, n: int) -> list[Split]:
    """At most n half-open ranges that cover low..high; the first starts below low even if low equals high."""
    if high < low:
        return []
    n = max(1, min(n, high - low + 1))
    size = (high - low + 1) // n
    cuts = [low - 1 + i * size for i in range(n)] + [high]
    return [Split(i + 1, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def equi_width(df: DataFrame, key: str, n: int) -> DataFrame:
    """(split, min_key, max_key): closed ranges of (max - min + 1) div n keys, the last with the remainder. One aggregate, no sort."""
    ends = df.agg(F.min(key).cast("long").alias("lo"), F.max(key).cast("long").alias("hi")).where("lo is not null")
    step = F.expr(f"greatest((hi - lo + 1) div {n}, 1)")
    rows = ends.withColumn("step", step).withColumn("split", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.expr("hi - lo + 1").cast("int")))))
    last = F.col("split") == F.least(F.lit(n), F.expr("hi - lo + 1"))
    return rows.select(F.col("split").cast("long").alias("split"), F.expr("lo + (split - 1) * step").alias("min_key"), F.when(last, F.col("hi")).otherwise(F.expr("lo + split * step - 1")).alias("max_key"))


def equi_depth(df: DataFrame, key: str, n: int) -> DataFrame:
    """(split, min_key, max_key, n_rows): n buckets of equal rows in key order; larger ones first."""
    bucket = F.ntile(n).over(Window.orderBy(key)).cast("long")
    return df.select(F.col(key).alias("k"), bucket.alias("split")).groupBy("split").agg(F.min("k").cast("long").alias("min_key"), F.max("k").cast("long").alias("max_key"), F.count(F.lit(1)).alias("n_rows"))


def equi_depth_scaled(df: DataFrame, key: str, n: int, accuracy: int = 100_000) -> list[Split]:
    """Buckets from approximate quantiles: one pass with mergeable sketches instead of a global sort; exact cover."""
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], accuracy).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if cuts["lo"] is None:
        return []
    edges = [int(cuts["lo"]) - 1, *sorted({int(c) for c in cuts["q"] or []} - {int(cuts["hi"])}), int(cuts["hi"])]
    return [Split(i + 1, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def equi_depth_numbered(df: DataFrame, key: str, n: int) -> DataFrame:
    """equi_depth() without a single-task window: rows are numbered over a written range partitioning, and a number tells its bucket."""
    rows, total = numbered_and_counted(df.select(F.col(f"`{key}`").alias("k")), ["k"], "rn")
    size, more = divmod(total, n)
    # ntile: the first `more` buckets have a row more
    at, wide = F.col("rn") - 1, more * (size + 1)
    bucket = F.when(at < wide, F.floor(at / (size + 1)) + 1).otherwise(more + F.floor((at - wide) / max(size, 1)) + 1)
    placed = rows.select("k", bucket.cast("long").alias("split"))
    return placed.groupBy("split").agg(F.min("k").cast("long").alias("min_key"), F.max("k").cast("long").alias("max_key"), F.count(F.lit(1)).alias("n_rows"))


def row_number_splits(rn: Column, size: int, n: int) -> Column:
    """The 1-based split of row number rn: pieces of `size` rows, the n-th takes the rest."""
    return F.least(F.floor((rn - 1) / size), F.lit(n - 1)) + 1


def covering(df: DataFrame, key: str, splits: list[Split]) -> DataFrame:
    """(split, n_rows) by the split of each key; rows outside all splits have split 0. The splits are few and planned."""
    number = F.lit(0)
    for s in splits:
        number = F.when(F.expr(s.predicate(key)), F.lit(s.number)).otherwise(number)
    return df.groupBy(number.cast("long").alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))
