"""Forms for large tables give what the plain forms give."""

import random

import pytest
from pyspark.sql import functions as F

from tideway.functions import values as V
from tideway.operators import metrics, validate


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 37])
def test_trend_in_blocks(spark, n):
    r = random.Random(n)
    rows = [(i * 10, float(r.choice([0, 50, 100, 70])), 95.0 * r.random(), 90.0 * r.random(), "j") for i in range(n)]
    df = spark.createDataFrame(rows, "ts long, throughput double, cpu double, memory double, job string")
    names = ["ts", "change_pct", "decline", "baseline", "insufficient", "decreasing", "memory_rising", "cpu_high", "memory_high"]
    want = sorted(map(tuple, metrics.with_trend(df, by="job").select(names).collect()))
    for block in (1, 2, 3, 5, 100_000):
        found = metrics.with_trend(df, block=block)
        assert sorted(map(tuple, found.select(names).collect())) == want
        # only the counts of partitions meet in one task
        assert found._jdf.queryExecution().executedPlan().toString().count("SinglePartition") <= 1


def test_tree_of_checksums(spark):
    r = random.Random(3)
    base = spark.range(40_000).selectExpr("id as a", "cast(id % 13 as string) as b", "id * 3 as v", "if(id % 7 = 0, null, id) as w").cache()
    gone, new, changed = {r.randrange(40_000) for _ in range(5)}, [70_001, 70_002], {r.randrange(40_000) for _ in range(6)}
    target = base.where(~F.col("a").isin(*gone)).withColumn("v", F.when(F.col("a").isin(*changed), F.lit(-1)).otherwise(F.col("v")).cast("long"))
    target = target.union(spark.createDataFrame([(k, "x", 1, None) for k in new], target.schema))
    trace = []
    found = validate.tree_diff(base, target.withColumn("a", F.col("a").cast("decimal(20,0)")), ["a", "b"], 50, trace)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, validate.checksum_diff(base, target, ["a", "b"]).collect()))
    assert found.count() == len(gone | changed) + 2
    # a few of 4,096 buckets with some ten rows each are all that is compared
    assert trace[-1][2] < 500 and trace[0][1] <= 13
    assert validate.tree_diff(base, base, ["a", "b"]).count() == 0
    assert validate.tree_diff(base.limit(0), base.limit(3), ["a"]).count() == 3


def test_rows_that_come_twice_do_not_hide(spark):
    one = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    other = spark.createDataFrame([(1, "z"), (1, "z"), (2, "y")], "k long, v string")
    assert {r.status for r in validate.tree_diff(one, other, ["k"]).collect()} == {"changed"}


def test_cuts_at_whole_characters(spark):
    r = random.Random(4)
    texts = ["".join(r.choices("aé日😀", k=r.randint(0, 30))) for _ in range(300)] + ["", None, "é" * 5, "😀" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (4, 7, 10):
        def cut(t):
            if t is None or len(t.encode()) <= n:
                return t
            return t.encode()[:n].decode(errors="ignore") + "..."

        assert {x.t: x.c for x in df.select("t", V.cut_bytes(F.col("t"), n).alias("c")).collect()} == {t: cut(t) for t in texts}
