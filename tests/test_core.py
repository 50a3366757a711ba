import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideway import catalog
from tideway.engine import Engine
from tideway.functions import values as V
from tideway.operators import merge, state
from tideway.plans.splits import equi_depth_scaled, equi_width, reader_ranges, split_count
from tideway.sources import scan


@given(st.integers(-50, 50), st.integers(0, 60), st.integers(1, 12))
def test_each_key_in_one_range(low, size, n):
    ranges = reader_ranges(low, low + size, n)
    for k in range(low, low + size + 1):
        assert sum(r.above < k <= r.up_to for r in ranges) == 1
    assert len(ranges) <= n


def test_range_edges():
    assert [(r.above, r.up_to) for r in reader_ranges(7, 7, 2)] == [(6, 7)]
    assert reader_ranges(5, 4, 3) == []
    assert len(reader_ranges(1, 3, 10)) == 3
    assert split_count(0, 100, 8) == 1 and split_count(10_000, 100, 8) == 8


def test_splits_of_small_tables(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert equi_width(empty, "k", 4).count() == 0 and equi_depth_scaled(empty, "k", 4) == []
    one = spark.range(5, 6).withColumnRenamed("id", "k")
    assert [tuple(r) for r in equi_width(one, "k", 4).collect()] == [(1, 5, 5)]
    many = spark.range(-30, 70).withColumnRenamed("id", "k")
    found = equi_depth_scaled(many, "k", 7)
    assert found[0].above == -31 and found[-1].up_to == 69 and all(a.up_to == b.above for a, b in zip(found, found[1:]))


def test_row_numbers_with_other_columns(spark):
    sizes = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 400_000, 1, 16).selectExpr("pmod(xxhash64(id), 1099511627776) * 1000000 + id as k", "repeat('x', cast(pmod(id, 90) as int)) as p")
        found = scan.numbered(rows, ["k"])
        assert tuple(found.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn"), F.max("p")).first()) == (1, 400_000, 400_000, "x" * 89)
        assert found.columns == ["k", "p", "rn"] and scan.numbered(rows.limit(0), ["k"]).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_connectors_and_names():
    assert catalog.canonical("MariaDB") == "mysql"
    with pytest.raises(ValueError, match="available"):
        catalog.canonical("nope")
    assert [catalog.sanitize_name(x) for x in ("Id", "2nd", "", "a b", "É")] == ["id", "col_2nd", "col_", "a_b", "é"]
    assert catalog.spark_type("NUMBER", 10, 0).simpleString() == "bigint" and catalog.spark_type("numeric", 50, 2).simpleString() == "string"


def test_merge_is_idempotent_and_null_safe(spark):
    vals = [None, "a", "b"]
    target = spark.createDataFrame([(i * 3 + j, v) for i, v in enumerate(vals) for j in range(3)], "k int, v string")
    source = spark.createDataFrame([(i * 3 + j, w) for i in range(3) for j, w in enumerate(vals)] + [(99, None)], "k int, v string")
    once = merge.merge(target, source, ["k"])
    assert {r.k: r._action for r in once.collect()} == {i * 3 + j: "unchanged" if i == j else "update" for i in range(3) for j in range(3)} | {99: "insert"}
    again = merge.merge(once.drop("_action"), source, ["k"])
    assert {r._action for r in again.collect()} == {"unchanged"}
    assert sorted(map(tuple, again.drop("_action").collect()), key=str) == sorted(map(tuple, source.collect()), key=str)
    empty = target.limit(0)
    assert {r._action for r in merge.merge(empty, source, ["k"]).collect()} == {"insert"}


def test_merge_edges(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    assert {r._action for r in merge.merge(keys, keys, ["k"]).collect()} == {"unchanged"}
    t = spark.createDataFrame([(1, "POINT(0 0)")], "k int, g string")
    s = spark.createDataFrame([(1, "POINT(1 1)")], "k int, g string")
    assert tuple(merge.merge(t, s, ["k"], spatial=("g",)).first()) == (1, "POINT(0 0)", "unchanged")
    with pytest.raises(ValueError, match="repeated"):
        merge.assert_unique(keys.union(keys), ["k"], "source")
    nan = spark.createDataFrame([(1, float("nan"))], "k int, x double")
    assert merge.merge(nan, nan, ["k"]).first()._action == "unchanged"


def test_safe_checkpoints_follow_acknowledgements(spark):
    ranges = spark.createDataFrame([(0, 0, 99), (1, 100, 199)], "reader_id int, above bigint, up_to bigint")
    acks = [(1, 0, 150), (0, 1, 60), (0, 0, 40)]
    found = [state.safe_checkpoint(spark.createDataFrame(acks[:n], "reader_id int, seq bigint, last_key bigint"), ranges).first()[0] for n in (1, 2, 3)]
    assert found == [0, 0, 60]


def test_redaction_and_sealing(spark):
    cases = {"jane@x.org": "[EMAIL]@x.org", "123-45-6789": "[SSN]", "+1 555 123 4567": "[PHONE]", "hello": "hello"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", V.redacted(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
    key = F.lit(b"0123456789abcdef")
    sealed = spark.range(1).select(V.encrypted(F.lit("secret"), key, F.lit("p")).alias("s"))
    assert sealed.select(V.decrypted(F.col("s"), key, F.lit("p"))).first()[0] == "secret"


def test_engine_reload_upsert_resume(spark, tmp_path):
    src, spec = str(tmp_path / "src"), catalog.TableSpec("t", ("k",), checks=("v >= 0",))
    rows = spark.range(20).selectExpr("id as k", "id * 2 as v")
    rows.write.parquet(f"{src}/t.parquet")
    make = lambda mode: Engine(spark, src, str(tmp_path / "dst"), str(tmp_path / "state.json"), [spec], mode)
    with pytest.raises(ValueError, match="target is missing"):
        make("upsert").run()
    assert make("reload").run()["status"] == "success"
    rows.where("k < 10").selectExpr("k", "v - 30 as v").write.mode("overwrite").parquet(f"{src}/t.parquet")
    out = make("upsert").run()
    assert out["status"] == "success" and out["warnings"] == ["t: rows break v >= 0"]
    e = make("upsert")
    assert e.current("t").count() == 20 and e.validate().first().status == "mismatch"
    e.state["runs"].append({"run_id": "x", "started_at": "9999", "status": "running", "config_hash": e.config_hash(), "tables": ["t"]})
    assert e.resume()["status"] == "success" and len(e.history()) == 3
    assert e.dry_run(threshold=5)[0]["method"] == "keyset"


def test_derby_round_trip(spark):
    from tideway.sources import jdbc

    options = {"url": "jdbc:derby:memory:tideway;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    jdbc.write_table(spark.range(50).selectExpr("id as K", "id + 1 as V"), "T", options, "overwrite")
    back = jdbc.read_table(spark, "T", options, "K", reader_ranges(0, 49, 4))
    assert back.rdd.getNumPartitions() == 4 and back.agg(F.sum("V")).first()[0] == sum(range(1, 51))
