import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideway import catalog, config, monitor
from tideway.engine import Engine, defaults, exit_code
from tideway.functions import values as V
from tideway.operators import analyze, metrics
from tideway.sources import dialects, jdbc, tables
from tideway.statefile import StateFile


@pytest.fixture
def made(spark, tmp_path):
    def make(specs, mode="reload", **more):
        return Engine(spark, str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "state.json"), specs, mode, **more)

    return make


def rows_of(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id as k", "id * 2 as v", "timestamp_ntz'2024-01-01' as ts")


def test_state_file_with_many_writers(spark, tmp_path):
    file = StateFile(spark, str(tmp_path / "s.json"))
    failed = []

    def write(i):
        for n in range(40):
            try:
                file.save({"writer": i, "n": n})
            except Exception as e:
                failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and file.load({"other": 1})["n"] == 39 and file.load({"other": 1})["other"] == 1
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".json"] == ["s.json"]


def test_upsert_of_many_tables(spark, made, tmp_path):
    specs = [catalog.TableSpec(f"t{i}", ("k",)) for i in range(6)]
    for s in specs:
        rows_of(spark, 30).write.parquet(str(tmp_path / "src" / f"{s.name}.parquet"))
    assert made(specs).run()["status"] == "success"
    for s in specs:
        rows_of(spark, 10, 25).write.mode("overwrite").parquet(str(tmp_path / "src" / f"{s.name}.parquet"))
    for _ in range(2):
        out = made(specs, "upsert", workers=6).run()
        assert out["status"] == "success" and not out["errors"]
    e = made(specs)
    assert {e.current(s.name).count() for s in specs} == {35} and len(e.state["marks"]) == 6


def test_a_killed_run_resumes_without_its_finished_splits(spark, made, tmp_path, monkeypatch):
    specs = [catalog.TableSpec("t", ("k",))]
    rows_of(spark, 1000).coalesce(1).write.parquet(str(tmp_path / "src" / "t.parquet"))
    more = {"threshold": 100, "chunk": 100, "most": 5, "workers": 1, "progress": str(tmp_path / "progress.jsonl")}
    load, seen = Engine._load, []

    def dies(self, run, job, task):
        if job.part == 4:
            raise KeyboardInterrupt
        load(self, run, job, task)

    monkeypatch.setattr(Engine, "_load", dies)
    with pytest.raises(KeyboardInterrupt):
        made(specs, **more).run()
    again = made(specs, **more)
    assert again.current("t") is None and again.status()["status"] == "running"

    def counted(self, run, job, task):
        seen.append(job.part)
        load(self, run, job, task)

    monkeypatch.setattr(Engine, "_load", counted)
    out = again.resume()
    assert out["status"] == "success" and 4 in seen and set(seen) <= {4, 5}
    assert again.current("t").agg(F.count("*"), F.countDistinct("k")).first() == (1000, 1000)
    tasks = again.tasks()
    assert tasks.count() == 5 and tasks.agg(F.sum("rows_done")).first()[0] == 1000 and tasks.where("last_key = 999").count() == 1
    assert again.state["sequences"]["t"] == 1000
    assert json.loads((tmp_path / "progress.jsonl").read_text().splitlines()[-1])["progress_pct"] == 100.0
    with pytest.raises(ValueError, match="no running run"):
        again.resume()


def test_splits_by_files(spark, made, tmp_path):
    rows_of(spark, 1000).repartition(6).write.parquet(str(tmp_path / "src" / "t.parquet"))
    e = made([catalog.TableSpec("t", ("k",))], threshold=100, chunk=100, most=3)
    assert [len(j.files) for j in e.jobs("t")] == [2, 2, 2]
    assert e.run()["status"] == "success" and e.current("t").count() == 1000


def test_upsert_leaves_other_buckets_alone(spark, made, tmp_path):
    spec = catalog.TableSpec("t", ("k",))
    rows_of(spark, 2000).write.parquet(str(tmp_path / "src" / "t.parquet"))
    e = made([spec], bucket_rows=100)
    e.run()
    paths = lambda: {b: [f"{e.folder.path}/t/{v['folders'][i]}/tideway_bucket={b}" for i in at] for v in [e.folder.version("t")] for b, at in v["of"].items()}
    before = paths()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "dst").rglob("*.parquet")}
    touched = e.upsert("t", rows_of(spark, 2, 1999).withColumn("v", F.lit(-1).cast("bigint")))
    after = paths()
    assert 1 <= len(touched) <= 2 < len(before)
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert e.current("t").where("v = -1").count() == 2 and e.current("t").count() == 2001
    gone = [f for b in touched for f in before.get(b, [])]
    assert sorted(e.clean()) == sorted(gone) and not any(Path(f).exists() for f in gone) and e.current("t").count() == 2001
    assert e.upsert("t", rows_of(spark, 0)) == []
    with pytest.raises(ValueError, match="source key"):
        e.upsert("t", rows_of(spark, 1).union(rows_of(spark, 1)))


def test_what_stands_against_an_upsert(spark, made, tmp_path):
    rows_of(spark, 5).write.parquet(str(tmp_path / "src" / "t.parquet"))
    made([catalog.TableSpec("t")]).run()
    with pytest.raises(ValueError, match="t: target has the key none"):
        made([catalog.TableSpec("t", ("k",))], "upsert").run()
    with pytest.raises(ValueError, match="no primary key"):
        made([catalog.TableSpec("t")], "upsert").run()


def test_retries(spark, made, tmp_path, monkeypatch):
    rows_of(spark, 5).write.parquet(str(tmp_path / "src" / "t.parquet"))
    for message, tries in (("Deadlock found", 3), ("no such column", 1)):
        calls = []

        def fails(self, run, job, task, message=message, calls=calls):
            calls.append(1)
            raise RuntimeError(message)

        monkeypatch.setattr(Engine, "_load", fails)
        out = made([catalog.TableSpec("t")], retries=2, wait=0).run()
        assert out["status"] == "failed" and len(calls) == tries and message in out["errors"]["transfer:t"]


def test_validation_and_health(spark, made, tmp_path):
    for t in ("a", "b"):
        rows_of(spark, 20).write.parquet(str(tmp_path / "src" / f"{t}.parquet"))
    e = made([catalog.TableSpec("a"), catalog.TableSpec("b")])
    e.run(include=["a"])
    assert {r.table_name: r.status for r in e.validate().collect()} == {"a": "ok", "b": "missing_target"}
    assert {r.table_name: r.status for r in e.validate(timeout=60).collect()} == {"a": "ok", "b": "missing_target"}
    assert {r.table_name: r.status for r in e.validate(timeout=0).collect()}["a"] in ("ok", "ok_estimated")
    health = e.health_check()
    assert health["healthy"] and health["source"]["tables"] == 2
    assert e.analyze().where("exclude").count() == 0 and defaults(8, 500)["workers"] == 6 and defaults(1, 500)["max_target_connections"] == 8


def test_metric_samples(spark):
    n = iter(range(0, 1000, 100))
    with monitor.Collector(lambda: next(n), interval=0.05) as c:
        threading.Event().wait(0.2)
    df = c.df(spark)
    assert df.count() >= 2 and metrics.last_samples(df, 2).count() == 2 and metrics.with_trend(df).count() == df.count()
    tasks = [{"table": "a", "status": "success", "rows_done": 5, "rows_total": 5}, {"table": "b", "status": "running", "rows_done": 1, "rows_total": 5}, {"table": "c", "status": "failed", "rows_done": 0, "rows_total": 0}]
    line = json.loads(monitor.progress_line("x", tasks, 2.0))
    assert (line["tables_complete"], line["tables_running"], line["error_count"], line["rows_per_second"], line["progress_pct"], line["current_tables"]) == (1, 1, 1, 3, 60.0, ["b"])
    assert json.loads(monitor.progress_line("x", [], 0))["progress_pct"] == 0.0


def test_settings(tmp_path, monkeypatch):
    secret = tmp_path / "s"
    secret.write_text(" hush \n")
    monkeypatch.setenv("A_USER", "u")
    raw = {"source": {"host": "a", "database": "x", "user": "${A_USER}", "password": f"${{file:{secret}}}"}, "target": {"host": "b", "database": "x", "user": "${env:NOT_THERE}"}, "migration": {"target_mode": "upsert", "unknown": 1}}
    c = config.load(json.dumps(raw))
    assert (c.source.type, c.source.port, c.source.schema, c.source.user, c.source.password, c.target.user, c.target.port) == ("mssql", 1433, "dbo", "u", "hush", "", 5432)
    assert config.yaml_text({"a": {"b": 1, "c": []}, "d": ["x y", None]}) == 'a:\n  b: 1\n  c: []\nd:\n  - "x y"\n  - null'
    assert c.migration.target_mode == "upsert" and "hush" not in repr(c)
    for change, said in (({"source": {}}, "source.host"), ({"migration": {"target_mode": "x"}}, "target_mode"), ({"target": raw["source"] | {"host": "A", "type": "sqlserver"}}, "same database")):
        with pytest.raises(ValueError, match=said):
            config.load(json.dumps(raw | change))


def test_connectors_that_users_add(monkeypatch):
    monkeypatch.setattr(catalog, "_ADDED", {})
    catalog.register("Derby", ("javadb",), "jdbc:derby://{host}:{port}/{database}", 1527)
    assert catalog.canonical("JavaDB") == "derby" and catalog.available() == ["derby", "mssql", "mysql", "oracle", "postgres"]
    with pytest.raises(ValueError, match="taken"):
        catalog.register("other", ("PG",), "", 1)
    assert catalog.jdbc_options("pg", "h", "d", "u", "p")["sslmode"] == "prefer"
    assert catalog.jdbc_options("mysql", "h", "d", "u", "p", options={"ssl_mode": "verify-full"})["sslMode"] == "VERIFY_IDENTITY"
    assert catalog.jdbc_options("mssql", "h", "d", "u", "p", options={"encrypt": False})["encrypt"] == "false"
    assert catalog.jdbc_options("oracle", "h", "d", "u", "p", options={"service_name": "s"})["url"].endswith("/s")


def test_upsert_statements():
    make = lambda c: dialects.dialect(c).upsert("s", "t", "stage", ["k", "v"], ["k"])
    assert "ON CONFLICT" in make("postgres") and "IS DISTINCT FROM" in make("postgres") and make("mssql").endswith(";") and "ON DUPLICATE KEY" in make("mysql") and make("oracle").startswith("MERGE INTO S.T t")
    assert dialects.dialect("postgres").upsert("s", "t", "stage", ["k"], ["k"]).endswith("DO NOTHING")
    assert dialects.dialect("oracle").quote("order") == '"ORDER"' and dialects.dialect("oracle").quote("my_col") == "MY_COL" and dialects.dialect("mssql").quote("a]b") == "[a]]b]"
    assert len(jdbc.staging_name("x" * 80)) == 60 and jdbc.staging_name("t", "1") == "stg_t_1"
    assert "all_tables" in dialects.catalog_query(dialects.TABLES_QUERY, "oracle", "O'X") and "'O''X'" in dialects.catalog_query(dialects.TABLES_QUERY, "pg", "O'X")


def test_staged_upsert_into_a_database(spark):
    options = {"url": "jdbc:derby:memory:staged;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    jdbc.write_table(spark.range(10).selectExpr("id as `order`", "id * 2 as V"), "S1", options, "overwrite")
    changed = jdbc.upsert_table(spark.range(8, 14).selectExpr("id as `order`", "if(id = 8, 16, -id) as V"), "", "S1", ["order"], options)
    back = {r[0]: r[1] for r in jdbc.read_table(spark, "S1", options, "order", None).collect()}
    assert changed == 5 and len(back) == 14 and back[8] == 16 and back[9] == -9 and back[13] == -13
    assert jdbc.read_table(spark, "S1", options, "order", [s for s in __import__("tideway.plans.splits", fromlist=["x"]).reader_ranges(0, 13, 3)]).count() == 14


def test_statements_around_a_load(spark):
    options = {"url": "jdbc:derby:memory:made;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    own = jdbc.dialect_of(options)
    parent, child = spark.range(3).selectExpr("id as k", "cast(id as string) as name"), spark.range(6).selectExpr("id as k", "id % 3 as p", "cast(1.5 as decimal(10,2)) as d", "current_date() as day", "id * 0.5d as x")
    jdbc.execute(spark, options, own.create_table("", "PARENT", parent.schema, ["k"]), own.create_table("", "CHILD", child.schema, ["k"]))
    jdbc.write_table(parent, own.table("", "PARENT"), options)
    jdbc.write_table(child, own.table("", "CHILD"), options)
    jdbc.execute(spark, options, own.create_index("", "CHILD", "ix", ["p"]), own.add_foreign_key("", "CHILD", "fk", ["p"], "PARENT", ["k"]), own.add_check("", "CHILD", "ck", '"x" >= 0'))
    with pytest.raises(Exception, match="(?i)violat|foreign|constraint"):
        jdbc.execute(spark, options, 'INSERT INTO "CHILD" ("k", "p") VALUES (9, 9)')
    assert jdbc.upsert_table(child.where("k > 4").withColumn("x", F.lit(7.0)), "", "CHILD", ["k"], options) == 1
    jdbc.execute(spark, options, own.drop_table("", "CHILD"), own.truncate("", "PARENT"))
    assert jdbc.read_table(spark, '"PARENT"', options).count() == 0
    for c in ("postgres", "mssql", "mysql", "oracle"):
        ddl = dialects.dialect(c).create_table("s", "t", child.schema, ["k"])
        assert "PRIMARY KEY" in ddl and "NOT NULL" in ddl


def test_session_catalog(spark, tmp_path):
    schema = "tideway_test_schema"
    tables.create_schema(spark, schema)
    try:
        df = rows_of(spark, 12)
        ddl = tables.create_table(spark, schema, "t_x", df.schema, ("k",))
        assert tables.exists(spark, schema, "t_x") and tables.table_key(spark, schema, "t_x") == ["k"] and "parquet" in ddl and "t_x" in tables.ddl_of(spark, schema, "t_x")
        assert tables.ddl_of(spark, schema, "none") == "" and tables.list_tables(spark, schema) == ["t_x"]
        tables.load_table(df.select("ts", "v", "k"), schema, "t_x")
        name = tables.name_of(schema, "t_x")
        assert tables.statistics_count(spark, name) is None and tables.tiered_count(spark, name) == 12 and tables.footer_count(spark.table(name)) == 12
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
        tables.load_table(df, schema, "t_x")
        assert tables.record_sequence(spark, schema, "t_x", "k") == 12
        tables.truncate(spark, schema, "t_x")
        assert spark.table(name).count() == 0
        tables.drop(spark, schema, "t_x")
        assert not tables.exists(spark, schema, "t_x")
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")


def test_constants_agree_with_their_cases(spark):
    few, more = analyze.capped(spark.range(20), ["id"])
    assert few.count() == 15 and more and not analyze.capped(spark.range(15), ["id"])[1]
    redacted = {"@x.org": "@x.org", "a@x.org": "[EMAIL]@x.org", "": "", "é" * 60: "é" * 50 + "...", "123-45-6789": "[SSN]", "@.1234567890": "[PHONE]"}
    df = spark.createDataFrame([(k,) for k in redacted], "t string").select("t", V.redacted(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == redacted
    cases = {"validation failed": 4, "transfer broke": 3, "context canceled": 5, "state lost": 6, "row count": 4, "yaml: connect": 2, "json: x": 1, "???": 3}
    assert {m: exit_code(RuntimeError(m)) for m in cases} == cases
    assert [exit_code(x) for x in ({"errors": {}}, {"errors": {"t": "row count"}}, FileNotFoundError("x"), KeyboardInterrupt())] == [0, 4, 7, 5]
    got = spark.createDataFrame([(k,) for k in cases], "m string").select("m", analyze.exit_code(F.col("m")).alias("c")).collect()
    assert {r.m: r.c for r in got} == cases
