"""Validation: counts, sampled keys, integrity, checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.sources.scan import hashed_sample
from tideway.storage import checkpointed


def counts(tables: dict[str, DataFrame], name: str = "n_rows") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias("table_name"), name) for t, df in sorted(tables.items())])


def count_diff(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """(table_name, source_rows, target_rows, status) of every table on either side."""
    both = counts(source, "source_rows").join(counts(target, "target_rows"), "table_name", "full_outer")
    status = F.when(F.col("target_rows").isNull(), "missing_target").when(F.col("source_rows").isNull(), "missing_source").when(F.col("source_rows") == F.col("target_rows"), "ok").otherwise("mismatch")
    return both.withColumn("status", status)


def sampled_keys(source: DataFrame, target: DataFrame, key: list[str], n: int = 100, present: bool = False) -> DataFrame:
    """Sampled source keys that the target lacks, or has. The sample has n rows by construction, so it is broadcast."""
    sample = hashed_sample(source, key, n)
    found = target.select(*key).join(F.broadcast(sample), key, "left_semi").distinct()
    return sample.join(found, key, "left_semi" if present else "left_anti")


def orphans(child: DataFrame, foreign: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    """Child rows without a parent; nulls in the foreign key pass."""
    named = parent.select(*[F.col(k).alias(f) for k, f in zip(key, foreign)])
    return child.dropna(subset=foreign).join(named, foreign, "left_anti")


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken(df: DataFrame, check: str) -> DataFrame:
    """Rows for which the check is false; null passes."""
    return df.where(~F.expr(check))


def checksum_diff(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): missing, extra or changed rows by a 64-bit hash of the other columns. An extension: the sampled check compares keys only."""
    rest = [c for c in source.columns if c not in key]
    hashed = lambda df, name: df.select(*key, F.xxhash64(*rest).alias(name))
    both = hashed(source, "_a").join(hashed(target, "_b"), key, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("changed")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, status.alias("status"))


#: Bits that each level of tree_diff adds to its buckets.
LEVEL = 12


def tree_diff(source: DataFrame, target: DataFrame, key: list[str], few: int = 100_000, trace: list | None = None) -> DataFrame:
    """checksum_diff() of large tables that hardly differ, moving only rows near a difference.

    Both sides are summed by buckets of the key's hash, in tasks first; only buckets whose sums differ are looked at
    again, in finer ones, until they hold at most `few` rows or grow no smaller, and their rows are compared one by one.
    Sums are of counts, of the rows' hashes by exclusive or, and of both halves of these by addition, so rows that come
    twice don't hide each other. The target's columns are taken in the source's types. `trace` gets (bits, buckets that
    differ, rows in them) for each level.
    """
    own = [F.col(f"`{k}`") for k in key]
    target = target.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in source.schema])
    sides = [df.withColumn("_place", F.xxhash64(*own)) for df in (source, target)]
    bits, before = 0, None
    while bits < 60:
        bits += LEVEL
        bucket = F.shiftrightunsigned("_place", 64 - bits)
        h = F.col("_hash")
        sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high")]
        told = [df.select(bucket.alias("_bucket"), F.xxhash64(*[F.col(f"`{c}`") for c in source.columns]).alias("_hash")).groupBy("_bucket").agg(*sums) for df in sides]
        names = ("n", "x", "low", "high")
        both = told[0].join(told[1].toDF("_bucket", *[f"{c}_" for c in names]), "_bucket", "full_outer")
        apart = checkpointed(both.where(~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names])).select("_bucket", (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n")))
        buckets, rows = apart.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if trace is not None:
            trace.append((bits, buckets, rows))
        # at most 2 ** LEVEL buckets at first; a level that doesn't halve the rows isn't followed, so no more than those rows' number
        if before is not None and 2 * rows > before:
            break
        keep = apart.select("_bucket")
        sides = [df.join(F.broadcast(keep) if buckets <= 1 << 2 * LEVEL else keep, bucket == keep["_bucket"], "left_semi") for df in sides]
        if rows <= few:
            break
        before = rows
    return checksum_diff(*[df.drop("_place") for df in sides], key)
