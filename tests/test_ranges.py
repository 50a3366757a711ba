import datetime as dt
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F

from tideway.plans import ranges
from tideway.plans.ranges import KeyRange, counted, encoded, equal_ranges, frame_counts, refined
from tideway.sources import jdbc


def held(df, found, mean=None):
    """Every row is in exactly one range, and ranges are of about equal rows."""
    n = df.count()
    rows = {r["range"]: r.n_rows for r in counted(df, found).collect()}
    assert sum(rows.values()) == n and 0 not in rows
    assert sum(df.where(r.where()).count() for r in found) == n
    assert {r.number: r.n_rows for r in found if r.n_rows} == rows
    return rows


def test_ranges_of_composite_keys_with_nulls(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b'c", "ü\\", "B"]), r.choice([None, *range(5)]), r.choice([None, decimal.Decimal("1.50"), decimal.Decimal("-2.25")]), dt.datetime(2024, 1, r.randint(1, 3), 5) if r.random() < 0.9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, n int, d decimal(9,2), t timestamp, `odd ``name` int").cache()
    for key in (["s"], ["s", "n"], ["n", "s", "d"], ["t", "odd `name"], ["d", "t", "s", "n"]):
        found = equal_ranges(df, key, 7)
        sizes = held(df, found)
        distinct = df.select(*[F.col(f"`{k.replace('`', '``')}`") for k in key]).distinct().count()
        assert len(found) <= 7 * 2
        if distinct > 200:
            assert max(sizes.values()) <= ranges.HEAVY * 3000 / 7
        again = [KeyRange.from_json(json.loads(json.dumps(x.to_json()))) for x in found]
        assert again == found


def test_rows_beyond_what_was_planned(spark):
    df = spark.range(100).selectExpr("id as k")
    found = equal_ranges(df, ["k"], 4)
    more = spark.createDataFrame([(None,), (-5,), (10**12,)], "k long")
    rows = {r["range"]: r.n_rows for r in counted(more, found).collect()}
    assert rows == {1: 2, len(found): 1}
    assert [r.predicate(lambda c: c, str) for r in equal_ranges(df.limit(0), ["k"], 4)] == ["1 = 1"]
    assert len(equal_ranges(spark.createDataFrame([(7,)] * 50, "k long"), ["k"], 4)) == 1


def test_histograms_cut_heavy_cells(spark):
    r = random.Random(2)
    keys = [r.randint(0, 50) for _ in range(5000)] + [r.randint(0, 10**12) for _ in range(300)] + [-(10**15)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").cache()
    found = refined(frame_counts(df, "k"), min(keys), max(keys), 8, "k")
    sizes = held(df, found)
    assert max(sizes.values()) <= ranges.HEAVY * len(keys) / 8 and len(found) >= 7
    one = spark.createDataFrame([(5,)] * 40, "k long")
    assert len(refined(frame_counts(one, "k"), 5, 5, 4, "k")) == 1


def test_values_survive_json():
    for v in (None, 1, "x", True, decimal.Decimal("1.20"), dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6), b"\x00\xff"):
        assert ranges.decoded(json.loads(json.dumps(encoded(v)))) == v


def test_a_database_plans_its_own_ranges(spark):
    options = {"url": "jdbc:derby:memory:ranges;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(1000).selectExpr("if(id < 900, id, id * 1000000) as K", "cast(id % 7 as string) as S", "id as V").cache()
    # keys of text have a length, as others don't compare in this database
    jdbc.execute(spark, options, jdbc.dialect_of(options).create_table("", "R1", rows.schema, ["K", "S"]))
    jdbc.write_table(rows, "R1", options)
    found = jdbc.key_ranges(spark, "R1", options, ["K"], 6)
    back = jdbc.read_table(spark, "R1", options, ranges=found)
    assert back.rdd.getNumPartitions() == len(found) >= 5 and back.count() == 1000
    assert max(r.n_rows for r in found) <= ranges.HEAVY * 1000 / 6
    found = jdbc.key_ranges(spark, "R1", options, ["S", "V"], 5)
    back = jdbc.read_table(spark, "R1", options, ranges=found)
    assert back.agg(F.count("*"), F.countDistinct("V")).first() == (1000, 1000) and len(found) >= 4
    with pytest.raises(Exception, match="(?i)K|null"):
        jdbc.execute(spark, options, "UPDATE R1 SET K = NULL")
