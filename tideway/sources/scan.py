"""Scans: whole tables, keyset pages, row-number pages, samples and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideway.catalog import TableSpec
from tideway.storage import checkpointed


#: A row-number page that ends within so many rows is found by a top-n.
TOP = 10_000


def read(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """The table's rows, whatever its format: files below path, or what the options say for JDBC."""
    reader = spark.read.format(spec.format).options(**spec.options)
    return reader.load() if spec.format == "jdbc" else reader.load(f"{path}/{spec.name}.parquet")


def key_range(key: str, above: object | None, up_to: object | None) -> Column:
    """above < key <= up_to; None leaves a side open."""
    keep = F.lit(True)
    if above is not None:
        keep = F.col(key) > F.lit(above)
    if up_to is not None:
        keep = keep & (F.col(key) <= F.lit(up_to))
    return keep


def since(column: str, mark: object) -> Column:
    """Rows at the mark or later; nulls never are."""
    return F.col(column) >= F.lit(mark)


def keyset_page(df: DataFrame, key: str, columns: list[str], above: object | None = None, up_to: object | None = None, limit: int | None = None, changed: Column | None = None) -> DataFrame:
    """One page in key order. Range and date filters reach the scan, and a limit plans as a top-n."""
    out = df.where(key_range(key, above, up_to))
    if changed is not None:
        out = out.where(changed)
    out = out.select(*columns).orderBy(key)
    return out if limit is None else out.limit(limit)


def row_number_page(df: DataFrame, key: list[str], columns: list[str], above: int, up_to: int, changed: Column | None = None) -> DataFrame:
    """Rows above < n <= up_to, numbered by key after the filter. A top-n finds the rows up to a page that ends within TOP rows, so
    no task holds more than those; deeper pages are numbered over range partitions (numbered())."""
    if not key:
        raise ValueError("row-number pages need a primary key")
    rows = (df if changed is None else df.where(changed)).select(*dict.fromkeys([*key, *columns]))
    if up_to <= TOP:
        found = rows.orderBy(*key).limit(max(0, up_to)).withColumn("_rn", F.row_number().over(Window.orderBy(*key)))
    else:
        found = numbered(rows, key, "_rn")
    return found.where((F.col("_rn") > above) & (F.col("_rn") <= up_to)).select(*columns)


def numbered(df: DataFrame, key: list[str], name: str = "rn") -> DataFrame:
    """df with row numbers in key order over all rows; see numbered_and_counted()."""
    return numbered_and_counted(df, key, name)[0]


def numbered_and_counted(df: DataFrame, key: list[str], name: str = "rn") -> tuple[DataFrame, int]:
    """df with row numbers in key order over all rows, without a single-task window, and their count: range partitions are
    sorted and each continues where the ones before it end. A count for each partition passes through the driver.

    The partition of each row is written to the shared folder first: the rows and the counts must see the same bounds, and
    a range partitioning that is planned twice, or again after an executor is lost, may sample others."""
    placed = checkpointed(df.repartitionByRange(*key).withColumn("_part", F.spark_partition_id()))
    before, bases = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("_part").count().collect())):
        bases.append((part, before))
        before += n
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*key))
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "_part int, _before long"))
    out = placed.withColumn("_at", at).join(base, "_part").withColumn(name, (F.col("_at") + F.col("_before")).cast("long"))
    return out.drop("_part", "_at", "_before"), before


def distinct_sample(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """The first distinct non-null values of a column, as text."""
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


def row_sample(df: DataFrame, key: list[str], columns: list[str], limit: int = 5) -> DataFrame:
    """(column_name, samples) of the first rows in key order; empty and null values are left out."""
    head = df.orderBy(*key).limit(limit).select(*key, *[F.col(c).cast("string").alias(f"v_{c}") for c in columns])
    aggs = [F.array_sort(F.collect_list(F.when(F.col(f"v_{c}") != "", F.struct(*key, F.col(f"v_{c}").alias("v"))))).alias(c) for c in columns]
    one = head.agg(*aggs)
    pairs = [F.struct(F.lit(c).alias("column_name"), F.array_join(F.transform(c, lambda x: x["v"]), ",").alias("samples")) for c in columns]
    return one.select(F.inline(F.array(*pairs)))


def hashed_sample(df: DataFrame, key: list[str], n: int = 100, seed: str = "") -> DataFrame:
    """n keys in an order that looks random but repeats."""
    order = F.md5(F.concat_ws(",", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    return df.select(*key).orderBy(order, *key).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))
