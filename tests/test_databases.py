"""Databases as they tell themselves: catalogs, settings, values, spatial columns and counts."""

import json

import pytest
from pyspark.sql import functions as F

from tideway import catalog, config, monitor
from tideway.catalog import TableSpec
from tideway.engine import Engine
from tideway.functions import values as V
from tideway.operators import metrics
from tideway.sources import dialects, jdbc, tables

STATEMENTS = (
    "CREATE SCHEMA SHOP",
    "CREATE TABLE SHOP.GROUPS (ID BIGINT NOT NULL PRIMARY KEY, NAME VARCHAR(40), UPDATED_AT TIMESTAMP)",
    "CREATE TABLE SHOP.ITEMS (A BIGINT NOT NULL, B VARCHAR(20) NOT NULL, GROUP_ID BIGINT, PRICE DECIMAL(9, 2), LASTCHANGE TIMESTAMP, PRIMARY KEY (B, A), CONSTRAINT FK_G FOREIGN KEY (GROUP_ID) REFERENCES SHOP.GROUPS (ID))",
    "CREATE TABLE SHOP.TMP_X (V INT)",
    *[f"INSERT INTO SHOP.GROUPS VALUES ({i}, 'g{i}', TIMESTAMP('2024-01-0{i % 9 + 1} 00:00:00'))" for i in range(5)],
    *[f"INSERT INTO SHOP.ITEMS VALUES ({i}, 'b{i % 3}', {i % 5}, {i}.5, CURRENT_TIMESTAMP)" for i in range(40)],
)


@pytest.fixture
def shop(spark, tmp_path):
    options = {"url": f"jdbc:derby:memory:shop_{tmp_path.name};create=true"}
    jdbc.execute(spark, options, *STATEMENTS)
    return options


def test_a_live_catalog(spark, shop):
    found = tables.live_catalog(spark, shop, "SHOP")
    assert [r[0] for r in found["tables"].collect()] == ["GROUPS", "ITEMS", "TMP_X"]
    assert {r.table_name: r.cols for r in tables.primary_keys(found["constraints"], found["key_columns"]).collect()} == {"GROUPS": "ID", "ITEMS": "B,A"}
    told = tables.described(found["columns"], found["constraints"], found["key_columns"])
    assert {(r.column_name, r.type_name, r.key_pos) for r in told.where("table_name = 'ITEMS'").collect()} == {("A", "BIGINT", 2), ("B", "VARCHAR", 1), ("GROUP_ID", "BIGINT", None), ("PRICE", "DECIMAL", None), ("LASTCHANGE", "TIMESTAMP", None)}
    specs = {s.name: s for s in jdbc.specs_of(spark, shop, "SHOP", ["lastchange", "updated_at"])}
    assert specs["ITEMS"].key == ("B", "A") and specs["ITEMS"].foreign_keys == ((("GROUP_ID",), "GROUPS", ("ID",)),) and specs["ITEMS"].date_column == "LASTCHANGE" and specs["GROUPS"].date_column == "UPDATED_AT"
    assert jdbc.estimated_count(spark, shop, "SHOP", "ITEMS") is None and jdbc.tiered_count(spark, shop, "SHOP", "ITEMS") == 40


def test_settings_run_from_database_to_database(spark, shop, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_ADDED", {})
    catalog.register("derby", (), "jdbc:derby:memory:{database};create=true", 1527)
    name = shop["url"].split(":")[3].split(";")[0]
    raw = {"source": {"type": "derby", "host": "a", "database": name, "schema": "SHOP"}, "target": {"type": "derby", "host": "b", "database": f"to_{name}", "schema": "COPY"}, "migration": {"exclude_tables": ["tmp_*"], "large_table_threshold": 10, "chunk_size": 10, "sample_validation": True, "date_updated_columns": ["lastchange"], "checkpoint_frequency": 2}}
    to = {"url": f"jdbc:derby:memory:to_{name};create=true"}
    jdbc.execute(spark, to, "CREATE SCHEMA COPY")
    e = config.engine(spark, config.load(json.dumps(raw)), str(tmp_path / "state.json"))
    assert sorted(e.specs) == ["GROUPS", "ITEMS"] and e.sample == 100 and len(e.jobs("ITEMS")) == 5
    out = e.run()
    assert out["status"] == "success" and not out["warnings"]
    assert jdbc.scalar(spark, to, 'SELECT COUNT(*) AS n FROM COPY.ITEMS') == 40
    with pytest.raises(Exception, match="(?i)foreign|constraint"):
        jdbc.execute(spark, to, "INSERT INTO COPY.ITEMS (A, B, GROUP_ID) VALUES (1000, 'x', 77)")
    again = config.engine(spark, config.load(json.dumps(raw | {"migration": raw["migration"] | {"target_mode": "upsert"}})), str(tmp_path / "state.json"))
    jdbc.execute(spark, shop, "UPDATE SHOP.ITEMS SET PRICE = 7, LASTCHANGE = TIMESTAMP('2099-01-01 00:00:00') WHERE A < 4", "UPDATE SHOP.ITEMS SET PRICE = 8, LASTCHANGE = TIMESTAMP('2001-01-01 00:00:00') WHERE A = 9")
    assert again.run()["status"] == "success"
    # rows older than the mark aren't read
    assert jdbc.query_rows(spark, to, "SELECT PRICE, COUNT(*) AS n FROM COPY.ITEMS WHERE PRICE < 9 AND A < 4 OR A = 9 GROUP BY PRICE")[0][0] == 7


def test_values_are_normalised_on_their_way(spark, tmp_path):
    guid = bytes.fromhex("33221100554477668899aabbccddeeff")
    rows = [(1, b"", guid, 1, "2024-01-01 00:00:00"), (2, b"\x01", b"\x01", 0, "0000-06-01 00:00:00"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "k long, raw binary, id binary, flag int, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "src" / "t.parquet"))
    kinds = {"raw": "VARBINARY(20)", "id": "uniqueidentifier", "flag": "bit", "at": "datetime2", "k": "bigint"}
    e = Engine(spark, str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "s.json"), [TableSpec("t", ("k",), kinds=kinds)])
    assert e.run()["status"] == "success"
    got = {r.k: (r.raw, r.id, r.flag, str(r.at) if r.at else None) for r in e.current("t").collect()}
    assert got == {1: (None, "00112233-4455-6677-8899-aabbccddeeff", True, "2024-01-01 00:00:00"), 2: (bytearray(b"\x01"), "01", False, None), 3: (None, None, None, None)}
    assert V.normalized(df, {}).schema == df.schema


def test_spatial_texts_become_values():
    make = lambda c: dialects.dialect(c).upsert("s", "t", "stage", ["k", "v", "g"], ["k"], ["g"], 4326)
    for c, said in (("postgres", 'ST_GeomFromText("g", 4326) AS "g"'), ("mssql", "geometry::STGeomFromText([g], 4326) AS [g]"), ("mysql", "ST_GeomFromText(`g`, 4326) AS `g`"), ("oracle", "SDO_GEOMETRY(G, 4326) AS G")):
        text = make(c)
        assert said in text
        # set, but never compared
        compared = text.split("IS DISTINCT FROM")[0].split("WHERE")[-1] if c == "postgres" else text
        assert "t.[g] <>" not in text and "t.G <>" not in text and (c != "postgres" or '"g"' not in compared)
        schema = __import__("pyspark.sql.types", fromlist=["x"]).StructType.fromDDL("k bigint, g string")
        assert "GEOMETRY" in dialects.dialect(c).create_table("s", "t", schema, ["k"], ["g"])
    assert dialects.Dialect("derby").from_text("x") == "x"
    for c in ("postgres", "mssql", "mysql", "oracle"):
        assert "'o''x'" in dialects.ROW_STATISTICS[c].format(schema="'s'", table="'o''x'")


def test_samples_of_spark_itself(spark, tmp_path):
    with monitor.Collector(interval=0.05, spark=spark) as c:
        spark.range(50_000).repartition(4).write.parquet(str(tmp_path / "x"))
    df = c.df(spark)
    assert c.samples[-1][4] >= 50_000 and all(0 <= s[2] <= 100 and 0 <= s[3] <= 100 for s in c.samples) and any(s[2] > 0 for s in c.samples)
    assert metrics.with_trend(df).count() == len(c.samples)
