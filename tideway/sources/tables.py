"""Tables of a session catalog, of a folder and of a database: listing, keys, counts, and the statements around a load."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.sources import dialects, jdbc

_SPARK = dialects.Dialect("spark")


def name_of(schema: str, table: str) -> str:
    return f"{_SPARK.quote(schema)}.{_SPARK.quote(table)}" if schema else _SPARK.quote(table)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of the Parquet tables below a folder, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return sorted(n.removesuffix(".parquet") for s in found if (n := s.getPath().getName()).endswith(".parquet"))


def list_tables(spark: SparkSession, schema: str) -> list[str]:
    """Names of a schema's tables without views, in order."""
    return sorted(t.name for t in spark.catalog.listTables(schema) if t.tableType not in ("VIEW", "TEMPORARY"))


def load_catalog(spark: SparkSession, connector: str, options: dict, schema: str) -> dict[str, DataFrame]:
    """tables, columns, constraints and key_columns of a database's schema, by its own catalog."""
    names = {"tables": dialects.TABLES_QUERY, "columns": dialects.COLUMNS_QUERY, "constraints": dialects.CONSTRAINTS_QUERY, "key_columns": dialects.KEY_COLUMNS_QUERY}
    lower = lambda df: df.toDF(*[c.lower() for c in df.columns])
    return {k: lower(spark.read.format("jdbc").options(**options).option("query", dialects.catalog_query(q, connector, schema)).load()) for k, q in names.items()}


def live_catalog(spark: SparkSession, options: dict, schema: str) -> dict[str, DataFrame]:
    """load_catalog() by what the JDBC driver tells, for any database."""
    found = jdbc.live_catalog(spark, options, schema)
    name = lambda t: f"pk_{t}"
    return {
        "tables": spark.createDataFrame([(t,) for t in found["tables"]], "table_name string"),
        "columns": spark.createDataFrame(found["columns"], "table_name string, column_name string, type_name string, ordinal int, is_nullable boolean"),
        "constraints": spark.createDataFrame([(name(t), t, "PRIMARY KEY") for t in sorted({k[0] for k in found["keys"]})], "constraint_name string, table_name string, constraint_type string"),
        "key_columns": spark.createDataFrame([(name(t), t, c, n) for t, c, n in found["keys"]], "constraint_name string, table_name string, column_name string, pos int"),
    }


def primary_keys(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """(table_name, cols): the columns of each primary key in key order, comma-joined."""
    own = constraints.where("constraint_type = 'PRIMARY KEY'").select("constraint_name", "table_name")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name"))), lambda x: x["column_name"])
    return own.join(key_columns, ["constraint_name", "table_name"]).groupBy("table_name").agg(F.array_join(ordered, ",").alias("cols"))


def described(columns: DataFrame, constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """(table_name, column_name, type_name, ordinal, key_pos): each column, with its place in the primary key or null."""
    own = constraints.where("constraint_type = 'PRIMARY KEY'").select("constraint_name", "table_name")
    keys = own.join(key_columns, ["constraint_name", "table_name"]).select("table_name", "column_name", F.col("pos").alias("key_pos"))
    return columns.select("table_name", "column_name", "type_name", "ordinal").join(keys, ["table_name", "column_name"], "left")


def indexed_columns(indexes: DataFrame) -> DataFrame:
    """(table_name, index_name, pos, column_name) from indexes(table_name, index_name, columns array): a row for each column, numbered from 1."""
    return indexes.select("table_name", "index_name", F.posexplode("columns").alias("at", "column_name")).select("table_name", "index_name", (F.col("at") + 1).alias("pos"), "column_name")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uri in batch.column("file").to_pylist():
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            rows.append(pyarrow.parquet.read_metadata(path, filesystem=fs).num_rows)
        yield pa.record_batch([batch.column("table_name"), pa.array(rows, pa.int64())], names=["table_name", "n"])


def footer_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of Parquet tables by their files' footers, read in the tasks of one job; only file names pass through the driver."""
    spark = next(iter(frames.values())).sparkSession
    files = [(t, f) for t, df in frames.items() for f in df.inputFiles()]
    names = spark.createDataFrame(files, "table_name string, file string").repartition(max(1, min(len(files) // 16, 10_000)))
    counts = names.mapInArrow(_footers, "table_name string, n long").groupBy("table_name").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([(t,) for t in frames], "table_name string")
    return every.join(counts, "table_name", "left").select("table_name", F.coalesce("n", F.lit(0)).alias("n_rows"))


def footer_count(df: DataFrame) -> int:
    return footer_counts({"": df}).first()["n_rows"]


def statistics_count(spark: SparkSession, table: str) -> int | None:
    """The row count that ANALYZE TABLE last stored; it may be stale. None without one."""
    for r in spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'").collect():
        if found := re.search(r"(\d+) rows", r.data_type):
            return int(found[1])
    return None


def tiered_count(spark: SparkSession, table: str) -> int:
    """The stored count if there is one above zero, else the exact one."""
    return statistics_count(spark, table) or spark.table(table).count()


def create_schema(spark: SparkSession, schema: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_SPARK.quote(schema)}")


def create_table(spark: SparkSession, schema: str, table: str, columns: T.StructType, key: tuple[str, ...] = (), buckets: int = 0) -> str:
    """Create a Parquet table unless it is there, bucketed by its key if asked; the key is kept as a table property. Returns the DDL."""
    fields = ", ".join(f"{_SPARK.quote(f.name)} {f.dataType.simpleString()}" for f in columns)
    clustered = f" CLUSTERED BY ({', '.join(map(_SPARK.quote, key))}) INTO {buckets} BUCKETS" if buckets and key else ""
    text = ",".join(key).replace("'", "\\'")
    ddl = f"CREATE TABLE IF NOT EXISTS {name_of(schema, table)} ({fields}) USING parquet{clustered} TBLPROPERTIES ('primary_key' = '{text}')"
    spark.sql(ddl)
    return ddl


def table_key(spark: SparkSession, schema: str, table: str) -> list[str]:
    """The key that create_table kept, in key order."""
    for r in spark.sql(f"SHOW TBLPROPERTIES {name_of(schema, table)}").collect():
        if r.key == "primary_key" and r.value:
            return r.value.split(",")
    return []


def ddl_of(spark: SparkSession, schema: str, table: str) -> str:
    """The table's CREATE statement; empty if there is no such table."""
    return spark.sql(f"SHOW CREATE TABLE {name_of(schema, table)}").first()[0] if exists(spark, schema, table) else ""


def exists(spark: SparkSession, schema: str, table: str) -> bool:
    return spark.catalog.tableExists(name_of(schema, table))


def truncate(spark: SparkSession, schema: str, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name_of(schema, table)}")


def drop(spark: SparkSession, schema: str, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name_of(schema, table)}")


def load_table(df: DataFrame, schema: str, table: str) -> None:
    """Append rows to a catalog table, by column names."""
    own = df.sparkSession.table(name_of(schema, table)).columns
    df.select(*(F.col(f"`{c}`") for c in own)).write.insertInto(name_of(schema, table))


def record_sequence(spark: SparkSession, schema: str, table: str, key: str) -> int:
    """After a load: the next value of a key, kept as a table property."""
    value = spark.table(name_of(schema, table)).agg(F.coalesce(F.max(F.col(f"`{key}`")), F.lit(0)) + 1).first()[0]
    spark.sql(f"ALTER TABLE {name_of(schema, table)} SET TBLPROPERTIES ('next_value' = '{int(value)}')")
    return int(value)
