"""Keyed upserts and the cleanups around them, on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, key: list[str], side: str) -> None:
    """Null or repeated keys would multiply rows in the merge; databases refuse them, so do we."""
    bad = df.groupBy(*key).count().where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key], F.col("count") > 1))
    if row := bad.first():
        raise ValueError(f"{side} key {row.asDict()} is null or repeated")


def _either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def merge(target: DataFrame, source: DataFrame, key: list[str], spatial: tuple[str, ...] = (), detect: bool = True) -> DataFrame:
    """The target's rows after the upsert, with _action: insert, update, unchanged or target_only.

    A matched row is an update if a non-key, non-spatial column differs (nulls compare as values) or, without detection,
    always; then all its non-key columns come from the source. A table of keys alone is insert-only. One full outer
    equi-join; the sides are told apart by tags, not by nulls.
    """
    rest = [c for c in target.columns if c not in key]
    s = source.select(*key, F.struct(F.lit(True), *[F.col(c) for c in rest]).alias("_s"))
    t = target.select(*key, F.struct(F.lit(True), *[F.col(c) for c in rest]).alias("_t"))
    differs = _either([~F.col(f"_t.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in rest if c not in spatial]) if detect else F.lit(bool(rest))
    both = t.join(s, key, "full_outer")
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_s").isNull(), "target_only").when(differs, "update").otherwise("unchanged")
    both = both.withColumn("_action", action)
    new = F.col("_action").isin("insert", "update")
    return both.select(*[F.col(c) if c in key else F.when(new, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in target.columns], "_action")


def merge_small(target: DataFrame, source: DataFrame, key: list[str], spatial: tuple[str, ...] = ()) -> DataFrame:
    """merge() for a source that fits into each task's memory, as the caller has checked: the target isn't shuffled and keeps its partitions."""
    rest = [c for c in target.columns if c not in key]
    held = F.broadcast(source.select(*key, F.struct(F.lit(True), *[F.col(c) for c in rest]).alias("_s")))
    both = target.join(held, key, "left")
    differs = _either([~F.col(c).eqNullSafe(F.col(f"_s.{c}")) for c in rest if c not in spatial])
    action = F.when(F.col("_s").isNull(), "target_only").when(differs, "update").otherwise("unchanged")
    new = F.col("_action") == "update"
    old = both.withColumn("_action", action).select(*[F.col(c) if c in key else F.when(new, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in target.columns], "_action")
    # keys that both sides have are no more than the source's
    met = target.select(*key).join(F.broadcast(source.select(*key)), key, "left_semi").distinct()
    return old.unionByName(source.join(met, key, "left_anti").select(*target.columns, F.lit("insert").alias("_action")))


def insert_only(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The target and the source rows whose keys it lacks."""
    return target.unionByName(source.join(target.select(*key), key, "left_anti").select(target.columns))


def replace_range(target: DataFrame, part: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """An idempotent split rewrite: rows of the closed range go, the part's rows come."""
    return target.where(~F.col(key).between(low, high)).unionByName(part)


def before_resume(target: DataFrame, key: str, last: object, up_to: object | None = None) -> DataFrame:
    """The target without what lies beyond the saved key, within the split."""
    beyond = F.col(key) > F.lit(last)
    return target.where(~(beyond & (F.col(key) <= F.lit(up_to)) if up_to is not None else beyond))
