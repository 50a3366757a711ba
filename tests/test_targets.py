import pytest
from pyspark.sql import functions as F

from tideway.catalog import TableSpec
from tideway.engine import Engine
from tideway.sources import jdbc
from tideway.streaming.incremental import merge_stream
from tideway.targets import FolderTarget, bucket_of, parent
from tideway.versions import Conflict, VersionLog

SPEC = TableSpec("t", ("k",))


@pytest.fixture
def made(spark, tmp_path):
    def make(specs=(SPEC,), mode="reload", **more):
        return Engine(spark, str(tmp_path / "src"), more.pop("target", str(tmp_path / "dst")), str(tmp_path / "state.json"), list(specs), mode, **{"wait": 0, **more})

    return make


def source(spark, tmp_path, df, name="t"):
    df.write.mode("overwrite").parquet(str(tmp_path / "src" / f"{name}.parquet"))


def rows_of(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id as k", "id * 2 as v")


def test_keys_of_another_type_find_their_rows(spark, made, tmp_path):
    source(spark, tmp_path, rows_of(spark, 1000))
    e = made(bucket_rows=100)
    e.run()
    e.upsert("t", spark.createDataFrame([(7, -1)], "k int, v int"))
    e.upsert("t", spark.createDataFrame([("8", "-2", "x")], "k string, v string, other string"))
    assert e.current("t").count() == 1000 and {r.k: r.v for r in e.current("t").where("v < 0").collect()} == {7: -1, 8: -2}
    with pytest.raises(Exception, match="(?i)cast"):
        e.upsert("t", spark.createDataFrame([("not a number", "1")], "k string, v string"))
    with pytest.raises(ValueError, match="source key"):
        e.upsert("t", spark.createDataFrame([(None, 1)], "k long, v long"))
    assert e.current("t").count() == 1000


def test_a_source_that_changes_while_it_is_merged(spark, made, tmp_path):
    source(spark, tmp_path, rows_of(spark, 1000))
    e = made(bucket_rows=50)
    e.run()
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        # other rows each time that it is read
        import pyarrow as pa

        for _ in batches:
            seen.add(1)
            import time

            yield pa.record_batch([pa.array([int(time.time_ns() % 1000)]), pa.array([-1])], names=["k", "v"])

    e.upsert("t", spark.range(1).coalesce(1).mapInArrow(rows, "k long, v long"))
    assert seen.value == 1
    assert e.current("t").agg(F.count("*"), F.countDistinct("k")).first() == (1000, 1000) and e.current("t").where("v = -1").count() == 1


def test_null_keys_and_rows_that_come_late_are_loaded(spark, made, tmp_path):
    df = rows_of(spark, 100).union(spark.createDataFrame([(None, i) for i in range(7)], "k long, v long"))
    source(spark, tmp_path, df.coalesce(1))
    e = made(threshold=10, chunk=10, most=4)
    out = e.run()
    assert out["status"] == "success" and not [w for w in out["warnings"] if "changed" in w] and e.current("t").count() == 107 and len(e.jobs("t")) == 4


def test_a_load_that_lost_rows_is_not_published(spark, made, tmp_path, monkeypatch):
    source(spark, tmp_path, rows_of(spark, 1000).coalesce(1))
    rows = Engine._rows
    monkeypatch.setattr(Engine, "_rows", lambda self, job, step: rows(self, job, step).where("k <> 500"))
    e = made(threshold=10, chunk=100, most=4)
    out = e.run()
    assert out["status"] == "failed" and "row count of t" in out["errors"]["publish:t"] and e.current("t") is None


def test_a_second_writer_fails_and_changes_nothing(spark, made, tmp_path, monkeypatch):
    source(spark, tmp_path, rows_of(spark, 300))
    e, other = made(bucket_rows=50), made(bucket_rows=50)
    e.run()
    write = FolderTarget.write

    def late(self, table, key, df, folder, buckets, dealt=False):
        monkeypatch.setattr(FolderTarget, "write", write)
        other.upsert("t", rows_of(spark, 1).withColumn("v", F.lit(-9).cast("long")))
        return write(self, table, key, df, folder, buckets, dealt)

    monkeypatch.setattr(FolderTarget, "write", late)
    with pytest.raises(Conflict):
        e.upsert("t", rows_of(spark, 300).withColumn("v", F.lit(-1).cast("long")))
    assert e.current("t").where("v < 0").count() == 1 and e.folder.version("t")["number"] == 2
    used = {p.name for p in (tmp_path / "dst" / "t").iterdir()}
    assert used == {"_versions", "_staged", *(f.split("/")[0] for f in e.folder.version("t")["folders"])}
    e.upsert("t", rows_of(spark, 300).withColumn("v", F.lit(-1).cast("long")))
    assert e.current("t").where("v = -1").count() == 300


def test_versions_are_made_once(spark, tmp_path):
    log, again = VersionLog(spark, str(tmp_path / "t")), VersionLog(spark, str(tmp_path / "t"))
    assert log.latest() is None and log.commit({"a": 1}, 0)["number"] == 1 and log.commit({"a": 2}, 1)["number"] == 2
    with pytest.raises(Conflict):
        again.commit({"a": 3}, 1)
    assert again.latest() == {"a": 2, "number": 2} and again.numbers() == [1, 2]
    assert sorted(p.name for p in (tmp_path / "t" / "_versions").iterdir() if not p.name.endswith(".crc")) == ["000000000001.json", "000000000002.json"]


def test_buckets_split_as_a_table_grows(spark, made, tmp_path):
    df = spark.range(5000).selectExpr("id as k")
    for before in range(1, 9):
        for after in range(before, 20):
            moved = df.select(bucket_of(["k"], before).alias("a"), bucket_of(["k"], after).alias("b")).distinct().collect() if (before, after) in ((1, 7), (3, 4), (5, 16), (8, 19)) else []
            assert all(r.b < after and r.a == (r.b if r.b < before and r.a == r.b else parent(r.b, before)) for r in moved)
    source(spark, tmp_path, rows_of(spark, 200))
    e = made(bucket_rows=100)
    e.run()
    for n in range(200, 4000, 760):
        e.upsert("t", rows_of(spark, 760, n))
    v = e.folder.version("t")
    assert e.current("t").agg(F.count("*"), F.countDistinct("k")).first() == (4000, 4000)
    assert v["buckets"] >= 26 and max(v["rows"].values()) < 500 and sum(v["rows"].values()) == 4000
    gone = e.clean()
    assert gone and e.current("t").count() == 4000 and e.clean() == []


def test_large_changes_merge_as_small_ones_do(spark, made, tmp_path):
    source(spark, tmp_path, rows_of(spark, 400).withColumn("s", F.when(F.col("k") % 3 > 0, F.col("k").cast("string"))))
    change = rows_of(spark, 300, 250).selectExpr("k", "if(k % 2 = 0, v, null) as v", "if(k % 5 = 0, null, cast(k as string)) as s")
    found = []
    for small in (0, 64 << 20):
        e = made(bucket_rows=60, target=str(tmp_path / f"dst{small}"))
        e.folder.small = small
        e.run()
        e.upsert("t", change)
        found.append(sorted(map(tuple, e.current("t").collect())))
    assert found[0] == found[1] and len(found[0]) == 550


def test_a_split_goes_on_from_its_last_step(spark, made, tmp_path, monkeypatch):
    spec = TableSpec("t", ("a", "b"))
    source(spark, tmp_path, spark.range(3000).selectExpr("concat('k', id % 10) as a", "id as b", "id as v").coalesce(1))
    read, write = [], FolderTarget.write

    def dies(self, table, key, df, folder, buckets, dealt=False):
        if folder.endswith("p2s3"):
            raise KeyboardInterrupt
        return counts(self, table, key, df, folder, buckets, dealt)

    def counts(self, table, key, df, folder, buckets, dealt=False):
        out = write(self, table, key, df, folder, buckets, dealt)
        read.append(sum(out.values()))
        return out

    more = {"threshold": 100, "chunk": 1000, "most": 3, "steps": 5, "workers": 1}
    monkeypatch.setattr(FolderTarget, "write", dies)
    with pytest.raises(KeyboardInterrupt):
        made([spec], **more).run()
    before = sum(read)
    monkeypatch.setattr(FolderTarget, "write", counts)
    e = made([spec], **more)
    assert [len(j.steps) for j in e.jobs("t")] == [5, 5, 5] and 0 < before < 3000
    assert e.resume()["status"] == "success"
    # nothing that was done is read again
    assert sum(read) == 3000 and e.current("t").agg(F.count("*"), F.countDistinct("a", "b")).first() == (3000, 3000)


def test_composite_keys_are_loaded_in_splits(spark, made, tmp_path):
    source(spark, tmp_path, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").coalesce(1), "conversations")
    e = made([TableSpec("conversations", ("conv_id", "turn"))], threshold=10, chunk=20, most=6)
    n = spark.read.parquet(str(tmp_path / "src" / "conversations.parquet")).count()
    plan = e.dry_run()[0]
    assert plan["method"] == "row_number" and plan["partitions"] == len(e.jobs("conversations")) == min(n // 20 + 1, 6)
    assert e.run()["status"] == "success" and e.current("conversations").count() == n
    assert e.tasks().count() == plan["partitions"] and e.tasks().agg(F.max("rows_done")).first()[0] <= 2 * n / plan["partitions"]


def test_old_runs_leave_the_state(spark, made, tmp_path):
    source(spark, tmp_path, rows_of(spark, 5))
    for _ in range(2):
        made().run()
    e = made()
    e.state["runs"][0]["completed_at"] = "2001-01-01T00:00:00"
    e.state["runs"][1] |= {"completed_at": "2001-01-01T00:00:00", "status": "partial"}
    e.run()
    assert len(e.state["runs"]) == 2 and {t["run_id"] for t in e.state["tasks"]} == {r["run_id"] for r in e.state["runs"]}


def test_sampled_keys_after_a_run(spark, made, tmp_path, monkeypatch):
    source(spark, tmp_path, rows_of(spark, 50))
    monkeypatch.setattr(Engine, "current", lambda self, t: self.folder.current(t).where("k % 2 = 0"))
    out = made(sample=50).run()
    assert out["warnings"] == ["t: 25 of 50 sampled keys are missing"]


# databases


def derby(name):
    return {"url": f"jdbc:derby:memory:{name};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def tables_of(spark, options):
    return {r[0] for r in jdbc.query_rows(spark, options, "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'")}


def test_from_database_to_database(spark, made):
    a, b = derby("from_db"), derby("to_db")
    parents, rows = spark.range(20).selectExpr("id as p", "concat('n', id) as name"), spark.range(900).selectExpr("id as k", "id % 20 as p", "cast(id as string) as s", "id * 0.5D as v")
    jdbc.write_table(parents, "PARENTS", a, "overwrite")
    jdbc.write_table(rows, "ROWS1", a, "overwrite")
    specs = [
        TableSpec("rows1", ("k",), format="jdbc", options=a | {"dbtable": "ROWS1"}, foreign_keys=((("p",), "parents", ("p",)),), checks=("v >= 0", "s <> 'k'"), unique=(("s",),)),
        TableSpec("parents", ("p",), format="jdbc", options=a | {"dbtable": "PARENTS"}),
    ]
    e = made(specs, target=b, threshold=100, chunk=100, most=4, steps=2, readers=3)
    assert sum(len(s.ranges) for j in e.jobs("rows1") for s in j.steps) > 12
    out = e.run()
    assert out["status"] == "success" and e.health_check()["target"]["tables"] == 2
    # the index needs a bounded type, which Derby says; all else is made
    assert all("unique s" in w for w in out["warnings"]), out["warnings"]
    assert tables_of(spark, b) == {"rows1", "parents"} and e.current("rows1").count() == 900
    with pytest.raises(Exception, match="(?i)constraint|foreign"):
        jdbc.execute(spark, b, 'INSERT INTO "rows1" ("k", "p", "s", "v") VALUES (5000, 99, \'x\', 1)')
    with pytest.raises(Exception, match="(?i)constraint|check"):
        jdbc.execute(spark, b, 'INSERT INTO "rows1" ("k", "p", "s", "v") VALUES (5000, 9, \'x\', -1)')
    again = made(specs, target=b).run()
    assert again["status"] == "success" and again["warnings"] == out["warnings"] and e.current("rows1").count() == 900
    jdbc.execute(spark, a, "UPDATE ROWS1 SET \"v\" = 7 WHERE \"k\" < 10", "INSERT INTO ROWS1 (\"k\", \"p\", \"s\", \"v\") VALUES (2000, 3, 'new', 1)")
    up = made(specs, "upsert", target=b)
    out = up.run()
    assert out["status"] == "success" and not out["errors"], out["errors"]
    assert up.current("rows1").count() == 901 and up.current("rows1").where("v = 7").count() >= 10
    assert tables_of(spark, b) == {"rows1", "parents"}


def test_a_failed_task_leaves_nothing_in_a_database(spark, made, tmp_path):
    source(spark, tmp_path, rows_of(spark, 500).repartition(5))
    b = derby("failing")
    e = made(target=b)
    e.run()
    assert e.current("t").count() == 500

    bad = rows_of(spark, 600).repartition(4).selectExpr("k", "if(k = 577, cast('no number' as bigint), v) as v")
    with pytest.raises(Exception, match="(?i)cast|number"):
        e.upsert("t", bad)
    assert tables_of(spark, b) == {"t"} and e.current("t").where("v = k * 2").count() == 500
    assert e.upsert("t", rows_of(spark, 10, 495)) == ["5"] and e.current("t").count() == 505


def test_rows_that_a_lost_task_wrote_twice_are_staged_again(spark, monkeypatch):
    b, write, calls = derby("twice"), jdbc.write_table, []

    def twice(df, table, options, mode="append", batch=10_000):
        write(df, table, options, mode, batch)
        calls.append(table)
        if len(calls) == 1:
            write(rows_of(spark, 3), table, options)

    monkeypatch.setattr(jdbc, "write_table", twice)
    assert jdbc.stage(rows_of(spark, 40), "STG", b) == 40 and len(calls) == 2
    assert jdbc.read_table(spark, "STG", b).count() == 40


def test_generated_keys_go_on_behind_loaded_ones(spark, made, tmp_path):
    source(spark, tmp_path, rows_of(spark, 30))
    b = derby("identity")
    jdbc.execute(spark, b, 'CREATE TABLE "t" ("k" BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, "v" BIGINT)')
    out = made([TableSpec("t", ("k",), identity="k")], target=b).run()
    assert out["status"] == "success" and not out["warnings"]
    jdbc.execute(spark, b, 'INSERT INTO "t" ("v") VALUES (77)')
    assert jdbc.scalar(spark, b, 'SELECT "k" FROM "t" WHERE "v" = 77') == 30


def test_a_stream_of_changes(spark, made, tmp_path):
    spec = TableSpec("t", ("k",), date_column="at")
    row = lambda k, v, day: (k, v, f"2024-01-0{day} 00:00:00")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long, at string").selectExpr("k", "v", "cast(at as timestamp_ntz) as at")
    source(spark, tmp_path, frame([row(k, 0, 1) for k in range(20)]))
    e = made([spec], bucket_rows=5)
    e.run()
    folder = str(tmp_path / "changes")

    def run():
        changes = spark.readStream.schema("k long, v long, at timestamp_ntz").parquet(folder)
        merge_stream(changes, e, "t", str(tmp_path / "checkpoint")).awaitTermination()
        return {r.k: r.v for r in e.current("t").collect()}

    # of repeated keys the last by date wins
    frame([row(3, 5, 2), row(3, 9, 4), row(3, 7, 3), row(50, 1, 2)]).write.mode("append").parquet(folder)
    found = run()
    assert found[3] == 9 and found[50] == 1 and len(found) == 21
    version = e.folder.version("t")["number"]
    # nothing new: the checkpoint remembers what was merged
    assert run() == found and e.folder.version("t")["number"] == version
    frame([row(4, 8, 5)]).write.mode("append").parquet(folder)
    assert run() == found | {4: 8}
