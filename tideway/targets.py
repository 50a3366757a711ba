"""Where a run puts its tables: folders of Parquet with numbered versions, or a database."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.catalog import TableSpec
from tideway.operators import merge
from tideway.sources import jdbc
from tideway.versions import Conflict, VersionLog

BUCKET = "tideway_bucket"


def bucket_of(key: list[str], buckets: int) -> Column:
    """The bucket of a row by its key's hash. Buckets grow one at a time: number n takes its rows from n without its highest bit, all others stay."""
    if not key:
        return F.lit(0)
    size = 1 << (buckets.bit_length() - 1)
    h = F.xxhash64(*(F.col(f"`{k}`") for k in key))
    wide, narrow = F.pmod(h, F.lit(2 * size)), F.pmod(h, F.lit(size))
    return F.when(wide < buckets, wide).otherwise(narrow).cast("int")


def parent(bucket: int, buckets: int) -> int:
    """The bucket out of `buckets` whose rows a later bucket takes."""
    while bucket >= buckets:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class FolderTarget:
    """Tables below a folder, each in buckets of its key's hash, with a log of versions.

    A version names, for each bucket, the written folders that hold its rows, and how many there are. Nothing that a
    version names is ever overwritten, so readers keep what they began with; a version becomes visible whole, in one
    step that fails if another writer came first (VersionLog). An upsert rewrites the buckets that its changes fall into,
    and splits buckets as the table grows past `bucket_rows` a bucket. Changes of at most `small` bytes of files and
    `small_rows` rows are broadcast. prune() deletes what older versions alone need.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 1_000_000, most: int = 100_000, small: int = 8 << 20, small_rows: int = 100_000) -> None:
        self.spark, self.path, self.bucket_rows, self.most = spark, path.rstrip("/"), bucket_rows, most
        self.small, self.small_rows = small, small_rows

    def log(self, table: str) -> VersionLog:
        return VersionLog(self.spark, f"{self.path}/{table}")

    def version(self, table: str) -> dict | None:
        return self.log(table).latest()

    def leaves(self, table: str, version: dict, buckets: set[int] | None = None) -> list[str]:
        """The folders of a version's buckets; one that is needed whole stands for its buckets."""
        base = f"{self.path}/{table}"
        wanted = [(i, b) for b, at in version["of"].items() if buckets is None or int(b) in buckets for i in at]
        uses: dict[int, int] = {}
        for i, _ in wanted:
            uses[i] = uses.get(i, 0) + 1
        whole = {i for i, n in uses.items() if n == version["sizes"][i]}
        return [f"{base}/{version['folders'][i]}" for i in sorted(whole)] + [f"{base}/{version['folders'][i]}/{BUCKET}={b}" for i, b in wanted if i not in whole]

    def stored(self, table: str, version: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = self.leaves(table, version, buckets)
        if not paths:
            return self.spark.createDataFrame([], version["schema"])
        return self.spark.read.schema(version["schema"]).option("recursiveFileLookup", "true").parquet(*paths)

    def current(self, table: str) -> DataFrame | None:
        version = self.version(table)
        return None if version is None else self.stored(table, version)

    # writing

    def write(self, table: str, key: list[str], df: DataFrame, folder: str, buckets: int, dealt: bool = False) -> dict[str, int]:
        """df as files of `folder` by bucket; returns the rows of each. A second attempt replaces the first; `dealt` rows go as they come."""
        path = f"{self.path}/{table}/{folder}"
        rows = df.withColumn(BUCKET, bucket_of(key, buckets))
        if buckets > 1 and not dealt:
            # each bucket in one task; how many buckets a task has follows from their sizes
            rows = rows.repartition(BUCKET)
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        # files by their footers: no column is read
        found = self.spark.read.schema(f"{ddl(df)}, {BUCKET} int").parquet(path).groupBy(BUCKET).count().collect()
        return {str(r[0]): r[1] for r in found}

    def buckets_for(self, spec: TableSpec, rows: int) -> int:
        return max(1, min(self.most, -(-rows // self.bucket_rows))) if spec.key else 1

    def publish(self, spec: TableSpec, written: list[tuple[str, dict[str, int]]], buckets: int, schema: str, after: int) -> dict:
        """A version of the folders written for a whole table."""
        of: dict[str, list[int]] = {}
        rows: dict[str, int] = {}
        for i, (_, counts) in enumerate(written):
            for b, n in counts.items():
                of.setdefault(b, []).append(i)
                rows[b] = rows.get(b, 0) + n
        version = {"schema": schema, "key": list(spec.key), "buckets": buckets, "folders": [f for f, _ in written], "sizes": [len(c) for _, c in written], "of": of, "rows": rows}
        return self.log(spec.name).commit(version, after)

    def upsert(self, spec: TableSpec, rows: DataFrame) -> list[str]:
        """Merge rows into the table; returns the buckets that were rewritten.

        The changes are written once, with the table's types, and only that copy is used: a source that goes on changing,
        or has other types, can't make the steps disagree. Null or repeated keys are refused. Whatever is written must
        fall into buckets that were read, and no row may be lost, or nothing is published.
        """
        log = self.log(spec.name)
        version = log.latest()
        key = list(spec.key)
        # the types come from the table, names that it lacks are left out
        typed = self.spark.createDataFrame([], version["schema"]).schema
        mark = uuid.uuid4().hex
        staged_at, folder = f"_staged/{mark}", mark
        path = f"{self.path}/{spec.name}/{staged_at}"
        try:
            rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in typed]).write.parquet(path)
            changes = self.spark.read.schema(version["schema"]).parquet(path)
            merge.assert_unique(changes, key, "source")
            before = version["buckets"]
            counts = {r[0]: r[1] for r in changes.groupBy(bucket_of(key, before)).count().collect()}
            if not counts:
                return []
            rows_now, new = sum(version["rows"].values()), sum(counts.values())
            after = before
            if rows_now + new > 1.5 * before * self.bucket_rows:
                # as many splits as the changes may fill buckets, so no upsert rewrites the whole table for its growth
                after = min(max(before, self.buckets_for(spec, rows_now + new)), before + max(len(counts), -(-2 * new // self.bucket_rows)))
            touched = set(counts) | {parent(b, before) for b in range(before, after)}
            old = self.stored(spec.name, version, touched)
            had = sum(version["rows"].get(str(b), 0) for b in touched)
            # files may be far smaller than their rows are in memory, which the driver and each task hold
            small = new <= self.small_rows and log.fs.getContentSummary(log._path(path)).getLength() <= self.small
            merged = merge.merge_small(old, changes, key, spec.spatial) if small else merge.merge(old, changes, key, spec.spatial)
            written = self.write(spec.name, key, merged.drop("_action"), folder, after, dealt=small and after == before)
            may = touched | set(range(before, after))
            if stray := {int(b) for b in written} - may:
                raise RuntimeError(f"{spec.name}: rows fell into buckets {sorted(stray)[:5]} that weren't read")
            if not had <= sum(written.values()) <= had + sum(counts.values()):
                raise RuntimeError(f"{spec.name}: {sum(written.values())} rows were written where {had} were and {sum(counts.values())} changed")
            log.commit(self._replaced(version, may, folder, written, after), version["number"])
            return sorted(map(str, set(map(int, written)) | touched), key=int)
        except Exception:
            log.fs.delete(log._path(f"{self.path}/{spec.name}/{folder}"), True)
            raise
        finally:
            log.fs.delete(log._path(path), True)

    def _replaced(self, version: dict, buckets: set[int], folder: str, written: dict[str, int], n: int) -> dict:
        """The version with some buckets' rows from a new folder; folders that nothing needs any more leave it."""
        of = {b: list(at) for b, at in version["of"].items() if int(b) not in buckets}
        rows = {b: c for b, c in version["rows"].items() if int(b) not in buckets} | written
        needed = sorted({i for at in of.values() for i in at})
        place = {i: k for k, i in enumerate(needed)}
        of = {b: [place[i] for i in at] for b, at in of.items()} | {b: [len(needed)] for b in written}
        return version | {"of": of, "rows": rows, "buckets": n, "folders": [*(version["folders"][i] for i in needed), folder], "sizes": [*(version["sizes"][i] for i in needed), len(written)]}

    def prune(self, table: str, keep: int = 1) -> list[str]:
        """Delete versions before the newest `keep`, and the files that only they need; returns the deleted folders."""
        log = self.log(table)
        numbers = log.numbers()
        if len(numbers) <= keep:
            return []
        leaf = lambda v: {(v["folders"][i], b) for b, at in v["of"].items() for i in at}
        live = {x for n in numbers[-keep:] for x in leaf(log.read(n))}
        gone = {x for n in numbers[:-keep] for x in leaf(log.read(n))} - live
        kept = {f for f, _ in live}
        paths = sorted({f"{log.base}/{f}" + (f"/{BUCKET}={b}" if f in kept else "") for f, b in gone})
        for p in paths:
            log.fs.delete(log._path(p), True)
        for n in numbers[:-keep]:
            log.delete(n)
        return paths


class DatabaseTarget:
    """Tables of a database. Each part of a load has a staging table of its own; one transaction moves or merges them.

    A part that is tried again drops its staging table first, and its rows are counted against what Spark read, so
    neither a failed task nor a repeated one leaves rows behind. Nothing is seen in the target before the transaction.
    """

    def __init__(self, spark: SparkSession, options: dict, schema: str = "") -> None:
        self.spark, self.options, self.schema, self.own = spark, options, schema, jdbc.dialect_of(options)

    def name(self, spec: TableSpec) -> str:
        return self.own.table(spec.target_schema or self.schema, spec.name)

    def staging(self, spec: TableSpec, part: str) -> str:
        return self.own.table(spec.target_schema or self.schema, jdbc.staging_name(spec.name, part))

    def exists(self, table: str) -> bool:
        return jdbc.table_exists(self.spark, self.options, table)

    def current(self, spec: TableSpec) -> DataFrame | None:
        return jdbc.read_table(self.spark, self.name(spec), self.options) if self.exists(self.name(spec)) else None

    def stage(self, spec: TableSpec, df: DataFrame, part: str) -> int:
        """Fill a part's staging table; returns its rows."""
        return jdbc.stage(df, self.staging(spec, part), self.options)

    def publish(self, spec: TableSpec, parts: list[str], schema, create: bool = True) -> int:
        """Replace the table's rows by those of its staging tables; the table is made if it isn't there."""
        table = self.name(spec)
        if not self.exists(table):
            if not create:
                raise ValueError(f"{table} is missing")
            jdbc.execute(self.spark, self.options, self.own.create_table(spec.target_schema or self.schema, spec.name, schema, list(spec.key), list(spec.spatial)))
        cols = ", ".join(map(self.own.quote, schema.names))
        chosen = ", ".join(self.own.from_text(self.own.quote(c), srid=spec.srid) if c in spec.spatial else self.own.quote(c) for c in schema.names)
        moves = [f"INSERT INTO {table} ({cols}) SELECT {chosen} FROM {self.staging(spec, p)}" for p in parts]
        done = jdbc.execute(self.spark, self.options, f"DELETE FROM {table}", *moves)
        self.drop(spec, parts)
        return sum(done[1:])

    def merge(self, spec: TableSpec, part: str, columns: list[str]) -> int:
        """Merge a staging table into its table; returns the rows that changed."""
        done = jdbc.execute(self.spark, self.options, self.own.upsert(spec.target_schema or self.schema, spec.name, self.staging(spec, part), columns, list(spec.key), list(spec.spatial), spec.srid))
        self.drop(spec, [part])
        return done[0]

    def drop(self, spec: TableSpec, parts: list[str]) -> None:
        for p in parts:
            if self.exists(self.staging(spec, p)):
                jdbc.execute(self.spark, self.options, f"DROP TABLE {self.staging(spec, p)}")

    def _constraints(self, spec: TableSpec, tables: set[str]) -> list[tuple[int, str, str, str]]:
        """(order, what it is, the statement that makes it, the one that takes it away) of indexes, then foreign keys, then checks."""
        schema, table = spec.target_schema or self.schema, spec.name
        name, q = self.name(spec), self.own.quote
        out = []
        for i, c in enumerate(spec.unique):
            gone = f"DROP INDEX {q(f'ux_{table}_{i}')}" + (f" ON {name}" if self.own.name in ("mssql", "mysql") else "")
            out.append((0, f"unique {','.join(c)}", self.own.create_index(schema, table, f"ux_{table}_{i}", list(c), unique=True), gone))
        for i, (columns, other, key) in enumerate(spec.foreign_keys):
            if other in tables:
                out.append((1, f"foreign key to {other}", self.own.add_foreign_key(schema, table, f"fk_{table}_{i}", list(columns), other, list(key)), f"ALTER TABLE {name} DROP CONSTRAINT {q(f'fk_{table}_{i}')}"))
        for i, c in enumerate(spec.checks):
            out.append((2, f"check {c}", self.own.add_check(schema, table, f"ck_{table}_{i}", self._quoted(c, spec)), f"ALTER TABLE {name} DROP CONSTRAINT {q(f'ck_{table}_{i}')}"))
        return out

    def finalize(self, specs: list[TableSpec], tables: set[str]) -> list[str]:
        """What generated keys go on with, then indexes, foreign keys and checks of loaded tables; what the database refuses is a warning."""
        out = []
        for s in (s for s in specs if s.identity):
            top = jdbc.scalar(self.spark, self.options, f"SELECT COALESCE(MAX({self.own.quote(s.identity)}), 0) + 1 AS n FROM {self.name(s)}")
            try:
                jdbc.run(self.spark, self.options, self.own.restart_identity(s.target_schema or self.schema, s.name, s.identity, int(top)))
            except Exception as e:
                out.append(f"{s.name}: {s.identity} wasn't set to {top}: {str(e)[:200]}")
        for _, table, what, statement in sorted((order, s.name, what, make) for s in specs for order, what, make, _ in self._constraints(s, tables)):
            try:
                jdbc.execute(self.spark, self.options, statement)
            except Exception as e:
                out.append(f"{table}: {what} wasn't made: {next((x for x in str(e).splitlines() if 'SQL' in x), str(e))[:200]}")
        return out

    def unfinalize(self, specs: list[TableSpec]) -> None:
        """Take away what finalize() of an earlier run made, foreign keys first, so that rows can be replaced."""
        for s in specs:
            if self.exists(self.name(s)):
                for *_, gone in sorted(self._constraints(s, {f[1] for f in s.foreign_keys}), key=lambda c: c[0] != 1):
                    with contextlib.suppress(Exception):
                        jdbc.execute(self.spark, self.options, gone)

    def _quoted(self, check: str, spec: TableSpec) -> str:
        """A check with the table's column names as the database writes them."""
        names = {f.lower(): f for f in jdbc.read_table(self.spark, self.name(spec), self.options).columns}
        return re.sub(r"'[^']*'|[A-Za-z_]\w*", lambda m: self.own.quote(names[m[0].lower()]) if m[0].lower() in names else m[0], check)


__all__ = ["BUCKET", "Conflict", "DatabaseTarget", "FolderTarget", "bucket_of", "ddl", "parent"]
