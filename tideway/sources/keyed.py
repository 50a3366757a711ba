"""A Spark data source for tables with a key, by ranges of it: Parquet files by their row groups, databases by a DB-API module.

    keyed.register(spark)
    spark.read.format("tideway_keyed").option("path", folder).option("key", "id").load()
    spark.readStream.format("tideway_keyed").option("path", folder).option("key", "id").load()
    spark.read.format("tideway_keyed").schema(ddl).options(module="psycopg2", connect=json, table="t", key="a,b", splits=64).load()

Options: `key`, columns that order the rows and hold no nulls; `path`, or `module` (a DB-API module that executors can
import), `connect` (its connect() arguments as JSON) and `table`; `splits`, how many ranges of a database are read at
once; `batch`, rows of an Arrow batch. Writing takes `module`, `connect`, `table` and `mode` (append, or merge by `key`;
Spark's own overwrite mode replaces all rows).

Reading: a partition is a range of row groups, or a range of whole keys that the database cut itself; filters on numbers
are pushed to both. A stream's offset is the greatest key that was read, so each batch holds the rows behind it; rows
whose key isn't beyond that are never seen, which is what a growing key promises. Parquet files are found anew for each batch.

Writing is in two phases. Each attempt of a task fills a staging table of its own in one transaction, and notes its name
in the same one; the driver moves or merges the staging tables that the finished attempts name in one transaction more,
and drops all that were noted, those of failed and repeated attempts too.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from tideway.plans.ranges import KeyRange, ansi_literal, decoded, encoded, refined

NAME = "tideway_keyed"


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedSource)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_COMPARE = {D.EqualTo: ("=", pc.equal), D.GreaterThan: (">", pc.greater), D.GreaterThanOrEqual: (">=", pc.greater_equal), D.LessThan: ("<", pc.less), D.LessThanOrEqual: ("<=", pc.less_equal)}


@dataclass
class Cut(D.InputPartition):
    """What one task reads: a range of keys, or row groups of files, behind a stream's last key."""

    number: int = 0
    keys: KeyRange | None = None
    groups: tuple[tuple[str, tuple[int, ...]], ...] = ()
    behind: tuple | None = None
    up_to: tuple | None = None


# files


class Files:
    """Parquet files below a path. Their footers give each row group's least and greatest key."""

    def __init__(self, options: dict) -> None:
        self.path, self.key = options["path"], options["key"].split(",")
        self.batch = int(options.get("batch", 65_536))

    def _found(self) -> tuple[pa.fs.FileSystem, list[str]]:
        fs, path = pa.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{os.path.abspath(self.path)}")
        info = fs.get_file_info(path)
        if info.is_file:
            return fs, [path]
        inside = fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        return fs, sorted(f.path for f in inside if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        fs, files = self._found()
        if not files:
            raise ValueError(f"no Parquet files below {self.path}")
        return from_arrow_schema(pq.read_schema(files[0], filesystem=fs), prefer_timestamp_ntz=True)

    def groups(self) -> list[tuple[str, int, object, object, int]]:
        """(file, row group, least and greatest value of the key's first column or None, rows), in order of the least one."""
        fs, files = self._found()
        out = []
        for f in files:
            meta = pq.read_metadata(f, filesystem=fs)
            at = [meta.schema.column(i).path for i in range(meta.num_columns)].index(self.key[0])
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(at).statistics
                has = s is not None and s.has_min_max
                out.append((f, g, s.min if has else None, s.max if has else None, meta.row_group(g).num_rows))
        return sorted(out, key=lambda x: (x[2] is not None, x[2] if x[2] is not None else 0))

    def last(self) -> tuple | None:
        """The greatest key: from footers where these tell it, else from the groups that may hold it."""
        groups = [x for x in self.groups() if x[4]]
        if not groups:
            return None
        if len(self.key) == 1 and all(x[3] is not None for x in groups):
            return (max(x[3] for x in groups),)
        top = max((x[3] for x in groups if x[3] is not None), default=None)
        fs, best = self._found()[0], None
        for f, g, _, most, _n in groups:
            if most is None or most == top:
                rows = pq.ParquetFile(f, filesystem=fs).read_row_group(g, columns=self.key).to_pylist()
                found = max(tuple(r[k] for k in self.key) for r in rows)
                best = found if best is None or found > best else best
        return best

    def cuts(self, splits: int, filters: list) -> list[Cut]:
        first = self.key[0]
        bounds = [(type(f), f.value) for f in filters if f.attribute == (first,)]

        def may(low: object, high: object) -> bool:
            return low is None or all({D.EqualTo: lambda v: low <= v <= high, D.GreaterThan: lambda v: high > v, D.GreaterThanOrEqual: lambda v: high >= v, D.LessThan: lambda v: low < v, D.LessThanOrEqual: lambda v: low <= v}[t](v) for t, v in bounds)

        return self._dealt([x for x in self.groups() if may(x[2], x[3])], splits)

    def between(self, behind: tuple | None, up_to: tuple, splits: int) -> list[Cut]:
        """Cuts of the row groups that may hold keys in (behind, up_to]."""
        hit = [x for x in self.groups() if x[2] is None or ((behind is None or x[3] >= behind[0]) and x[2] <= up_to[0])]
        return [Cut(c.number, groups=c.groups, behind=behind, up_to=up_to) for c in self._dealt(hit, splits)]

    def _dealt(self, groups: list, splits: int) -> list[Cut]:
        size = max(1, -(-sum(x[4] for x in groups) // max(1, splits)))
        out: list[Cut] = []
        held: dict[str, list[int]] = {}
        n = 0
        for f, g, *_, rows in groups:
            held.setdefault(f, []).append(g)
            n += rows
            if n >= size:
                out.append(Cut(len(out), groups=tuple((f, tuple(g)) for f, g in held.items())))
                held, n = {}, 0
        return [*out, Cut(len(out), groups=tuple((f, tuple(g)) for f, g in held.items()))] if held else out

    def read(self, cut: Cut, schema: T.StructType, filters: list) -> Iterator[pa.RecordBatch]:
        want = _arrow(schema)
        fs = self._found()[0]
        for f, groups in cut.groups:
            for batch in pq.ParquetFile(f, filesystem=fs).iter_batches(self.batch, list(groups), want.names):
                keep = None
                for x in filters:
                    keep = _both(keep, pc.fill_null(_COMPARE[type(x)][1](batch.column(x.attribute[0]), x.value), False))
                for bound, over in ((cut.behind, True), (cut.up_to, False)):
                    if bound is not None:
                        beyond = _after([batch.column(k) for k in self.key], bound)
                        keep = _both(keep, beyond if over else pc.invert(beyond))
                batch = batch if keep is None else batch.filter(keep)
                if batch.num_rows:
                    yield batch.cast(want)


def _both(a, b):
    return b if a is None else pc.and_(a, b)


def _after(columns: list, bound: tuple):
    """Whether rows of key columns stand behind a key."""
    more = pc.fill_null(pc.greater(columns[0], pa.scalar(bound[0], columns[0].type)), False)
    if len(columns) == 1:
        return more
    same = pc.fill_null(pc.equal(columns[0], pa.scalar(bound[0], columns[0].type)), False)
    return pc.or_(more, pc.and_(same, _after(columns[1:], bound[1:])))


# databases


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Database:
    """A table behind a DB-API module. Its SQL is what most databases share."""

    def __init__(self, options: dict) -> None:
        self.module, self.arguments = options["module"], json.loads(options.get("connect", "{}"))
        self.table, self.batch = options["table"], int(options.get("batch", 10_000))
        self.key = [k for k in options.get("key", "").split(",") if k]
        self.names = ", ".join(map(_quote, self.key))

    def connect(self):
        return importlib.import_module(self.module).connect(**self.arguments)

    def rows(self, query: str) -> list[tuple]:
        con = self.connect()
        try:
            cursor = con.cursor()
            cursor.execute(query)
            return [tuple(r) for r in cursor.fetchall()]
        finally:
            con.close()

    def schema(self) -> T.StructType:
        raise ValueError("a table behind a DB-API module needs .schema(...), as modules don't tell types alike")

    def last(self) -> tuple | None:
        """The greatest key, column by column, each by an aggregate that an index answers."""
        out: list = []
        for k in self.key:
            where = " AND ".join(f"{_quote(c)} = {ansi_literal(v)}" for c, v in zip(self.key, out)) or "1 = 1"
            out.append(self.rows(f"SELECT MAX({_quote(k)}) FROM {self.table} WHERE {where}")[0][0])
        return None if out[0] is None else tuple(out)

    def ranges(self, splits: int, where: str = "1 = 1") -> list[KeyRange]:
        """Ranges of about equal rows; the database counts histograms of an integer key, or gives every so many-th key."""
        own = f"(SELECT * FROM {self.table} WHERE {where}) q"
        if len(self.key) == 1:
            low, high, n = self.rows(f"SELECT MIN({self.names}), MAX({self.names}), COUNT(*) FROM {own}")[0]
            if not n:
                return []
            if isinstance(low, int):

                def count(low: int, width: int, end: int) -> dict[int, int]:
                    cell = f"CAST(({self.names} - {low}) / {width} AS BIGINT)"
                    return {int(r[0]): r[1] for r in self.rows(f"SELECT c, COUNT(*) FROM (SELECT {cell} AS c FROM {own} WHERE {self.names} >= {low} AND {self.names} < {end}) p GROUP BY c")}

                return refined(count, low, high, splits, self.key[0])
        n = self.rows(f"SELECT COUNT(*) FROM {own}")[0][0]
        size = max(1, -(-n // splits))
        tops = self.rows(f"SELECT {self.names} FROM (SELECT {self.names}, ROW_NUMBER() OVER (ORDER BY {self.names}) AS rn FROM {own}) p WHERE rn % {size} = 0 AND rn < {n} ORDER BY rn")
        edges = [None, *tops, None]
        return [KeyRange(i + 1, tuple(self.key), a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))] if n else []

    def cuts(self, splits: int, filters: list) -> list[Cut]:
        if not self.key:
            return [Cut(0)]
        return [Cut(r.number, keys=r) for r in self.ranges(splits, self._where(filters))]

    def between(self, behind: tuple | None, up_to: tuple, splits: int) -> list[Cut]:
        window = KeyRange(0, tuple(self.key), behind, up_to).predicate(_quote, ansi_literal)
        return [Cut(r.number, keys=r, behind=behind, up_to=up_to) for r in self.ranges(splits, window)]

    def _where(self, filters: list) -> str:
        return " AND ".join(f"{_quote(f.attribute[0])} {_COMPARE[type(f)][0]} {ansi_literal(f.value)}" for f in filters) or "1 = 1"

    def read(self, cut: Cut, schema: T.StructType, filters: list) -> Iterator[pa.RecordBatch]:
        want = _arrow(schema)
        parts = [self._where(filters)] + ([cut.keys.predicate(_quote, ansi_literal)] if cut.keys else [])
        parts += [KeyRange(0, tuple(self.key), cut.behind, cut.up_to).predicate(_quote, ansi_literal)] if cut.up_to is not None else []
        con = self.connect()
        try:
            cursor = con.cursor()
            cursor.execute(f"SELECT {', '.join(map(_quote, want.names))} FROM {self.table} WHERE {' AND '.join(parts)}")
            while rows := cursor.fetchmany(self.batch):
                yield pa.record_batch([_column(c, f.type) for c, f in zip(zip(*rows), want)], schema=want)
        finally:
            con.close()


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Values as a database gave them; texts and numbers that stand for other types are read as these."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return pa.array([None if v is None else str(v) for v in values]).cast(kind)


def _store(options: dict) -> Files | Database:
    return Database(options) if "module" in options else Files(options)


# what Spark calls


class KeyedReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.store, self.wanted, self.splits, self.filters = _store(options), schema, int(options.get("splits", 8)), []

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons with numbers are the store's, all others stay Spark's: texts may sort otherwise in a database."""
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and type(f.value) in (int, float) and f.value == f.value:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Cut]:
        return self.store.cuts(self.splits, self.filters) or [Cut(0)]

    def read(self, partition: Cut) -> Iterator[pa.RecordBatch]:
        if isinstance(self.store, Files) or partition.keys or not self.store.key:
            yield from self.store.read(partition, self.wanted, self.filters)


class KeyedStream(D.DataSourceStreamReader):
    """Offsets are {"last": key} with the key as JSON holds it; null stands for the beginning."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.store, self.wanted, self.splits = _store(options), schema, int(options.get("splits", 8))

    def initialOffset(self) -> dict:
        return {"last": None}

    def latestOffset(self) -> dict:
        last = self.store.last()
        return {"last": None if last is None else [encoded(v) for v in last]}

    def partitions(self, start: dict, end: dict) -> list[Cut]:
        if end["last"] is None or start == end:
            return []
        behind = None if start["last"] is None else tuple(decoded(v) for v in start["last"])
        return self.store.between(behind, tuple(decoded(v) for v in end["last"]), self.splits)

    def read(self, partition: Cut) -> Iterator[pa.RecordBatch]:
        yield from self.store.read(partition, self.wanted, [])


@dataclass
class Staged(D.WriterCommitMessage):
    table: str
    rows: int


class KeyedWriter(D.DataSourceArrowWriter):
    """Two-phase load of a database table."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.store, self.columns, self.overwrite = Database(options), schema.names, overwrite
        self.merge, self.run = options.get("mode", "append") == "merge", uuid.uuid4().hex[:12]
        self.style = importlib.import_module(self.store.module).paramstyle
        if self.merge and not self.store.key:
            raise ValueError("a merge needs the option key")
        self.cols = ", ".join(map(_quote, self.columns))
        self._run(f"CREATE TABLE {self._noted} (name VARCHAR(200) NOT NULL)")

    @property
    def _noted(self) -> str:
        return f"stg_{self.run}_names"

    def _run(self, *statements: str) -> None:
        con = self.store.connect()
        try:
            for s in statements:
                con.cursor().execute(s)
            con.commit()
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"stg_{self.run}_{task.partitionId()}_{task.attemptNumber()}_{uuid.uuid4().hex[:6]}"
        mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}.get(self.style)
        marks = ", ".join(mark or f":{i + 1}" for i in range(len(self.columns)))
        con, n = self.store.connect(), 0
        try:
            cursor = con.cursor()
            # the note comes first: an attempt that outlives an abort finds nowhere to note its name, and makes no table
            cursor.execute(f"INSERT INTO {self._noted} VALUES ('{name}')")
            cursor.execute(f"CREATE TABLE {name} AS SELECT {self.cols} FROM {self.store.table} WHERE 1 = 0")
            for batch in iterator:
                cursor.executemany(f"INSERT INTO {name} ({self.cols}) VALUES ({marks})", list(zip(*(c.to_pylist() for c in batch.columns))))
                n += batch.num_rows
            con.commit()
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()
        return Staged(name, n)

    def commit(self, messages: list) -> None:
        table, moves = self.store.table, []
        for m in messages:
            if self.merge:
                match = " AND ".join(f"s.{_quote(k)} = {table}.{_quote(k)}" for k in self.store.key)
                moves.append(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {m.table} s WHERE {match})")
            moves.append(f"INSERT INTO {table} ({self.cols}) SELECT {self.cols} FROM {m.table}")
        self._run(*([f"DELETE FROM {table}"] if self.overwrite else []), *moves)
        self._drop()

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        names = [r[0] for r in self.store.rows(f"SELECT name FROM {self._noted}")]
        self._run(*[f"DROP TABLE {n}" for n in names], f"DROP TABLE {self._noted}")


class KeyedSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return _store(self.options).schema()

    def reader(self, schema: T.StructType) -> KeyedReader:
        return KeyedReader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> KeyedStream:
        return KeyedStream(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(dict(self.options), schema, overwrite)
