import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tideway.sources import keyed


@pytest.fixture
def source(spark):
    keyed.register(spark)
    return lambda **o: spark.read.format(keyed.NAME).options(**o)


def rows_of(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id as k", "cast(id % 7 as string) as s", "id * 0.5D as v", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 9 as int)) as ts")


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "t.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (k BIGINT PRIMARY KEY, s VARCHAR(20), v DOUBLE PRECISION)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i * i, f"s'{i % 5}", i / 2) for i in range(500)])
    con.commit()
    con.close()

    def ask(sql):
        con = sqlite3.connect(path)
        try:
            return con.execute(sql).fetchall()
        finally:
            con.close()

    ask.options = {"module": "sqlite3", "connect": json.dumps({"database": path, "timeout": 60}), "table": "t"}
    return ask


def test_files_by_row_groups(spark, source, tmp_path):
    path = str(tmp_path / "t")
    rows = rows_of(spark, 4000)
    rows.repartitionByRange(4, "k").write.option("parquet.block.size", 16384).parquet(path)
    df = source(path=path, key="k", splits=6).load()
    assert df.schema["ts"].dataType.typeName() == "timestamp_ntz" and df.rdd.getNumPartitions() > 3
    assert df.exceptAll(rows).count() == 0 == rows.exceptAll(df).count()
    some = df.where("k > 3500 and v < 1900 and s = '3'")
    assert some.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    # what is pushed doesn't stay behind
    assert "3500" not in some._jdf.queryExecution().executedPlan().toString() and "1900" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in some.collect()) == [k for k in range(3501, 3800) if k % 7 == 3]
    assert df.where("k = -1").count() == 0
    one = str(tmp_path / "one.parquet")
    rows.limit(0).toPandas().to_parquet(one)
    assert source(path=one, key="k").schema("k long, s string").load().count() == 0


def test_a_stream_goes_on_behind_its_last_key(spark, source, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("t", "out", "checkpoint"))
    key = "k,s"

    def run():
        stream = spark.readStream.format(keyed.NAME).options(path=path, key=key).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    rows_of(spark, 100).write.parquet(path)
    assert run().count() == 100
    # nothing new, then new files; rows that were read before don't come again
    assert run().count() == 100
    rows_of(spark, 60, 100).repartition(3).write.mode("append").parquet(path)
    found = run()
    assert found.agg(F.count("*"), F.countDistinct("k"), F.max("k")).first() == (160, 160, 159)
    rows_of(spark, 1, 159).withColumn("s", F.lit("z")).write.mode("append").parquet(path)
    assert run().count() == 161


def test_a_database_in_ranges(spark, source, database):
    ddl = "k long, s string, v double"
    df = source(**database.options, key="k", splits=5).schema(ddl).load()
    rows = [tuple(r) for r in df.collect()]
    assert df.rdd.getNumPartitions() >= 4 and sorted(rows) == [(i * i, f"s'{i % 5}", i / 2) for i in range(500)]
    assert sorted(r.k for r in df.where("k >= 100 and k < 400").collect()) == [i * i for i in range(10, 20)]
    both = source(**database.options, key="s,k", splits=4).schema(ddl).load()
    assert both.count() == 500 and both.rdd.getNumPartitions() == 4
    assert source(**database.options).schema(ddl).load().count() == 500
    with pytest.raises(Exception, match="schema"):
        source(**database.options).load()


def test_a_stream_of_a_database(spark, source, database, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        stream = spark.readStream.format(keyed.NAME).schema("k long, s string").options(**database.options, key="k").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 500
    con = sqlite3.connect(json.loads(database.options["connect"])["database"])
    con.execute("INSERT INTO t VALUES (1000000, 'new', 1), (-5, 'too low', 1)")
    con.commit()
    con.close()
    found = run()
    assert found.count() == 501 and found.where("s = 'new'").count() == 1


def test_two_phase_writes(spark, database):
    keyed.register(spark)
    rows = spark.range(300).selectExpr("id * id as k", "'merged' as s", "1.5D as v").union(spark.range(40).selectExpr("id + 5000000 as k", "'added' as s", "2.5D as v")).repartition(4)
    save = lambda df, how, **o: df.write.format(keyed.NAME).options(**database.options, **o).mode(how).save()
    save(rows, "append", mode="merge", key="k")
    assert database("SELECT s, COUNT(*) FROM t GROUP BY s ORDER BY s")[:2] == [("added", 40), ("merged", 300)] and database("SELECT COUNT(*) FROM t") == [(540,)]
    before = database("SELECT * FROM t ORDER BY k")
    # one task fails, others have committed their staging tables
    bad = rows.selectExpr("if(k = 5000007, cast('no number' as bigint), k) as k", "s", "v")
    with pytest.raises(Exception, match="(?i)cast|number"):
        save(bad, "append", mode="merge", key="k")
    # a repeated key, which the table refuses when the staging tables are moved
    with pytest.raises(Exception, match="(?i)unique|constraint|integrity"):
        save(rows, "append")
    assert database("SELECT * FROM t ORDER BY k") == before
    save(rows.where("s = 'added'"), "overwrite")
    assert database("SELECT COUNT(*), MIN(s) FROM t") == [(40, "added")]
    assert database("SELECT name FROM sqlite_master WHERE type = 'table'") == [("t",)]
