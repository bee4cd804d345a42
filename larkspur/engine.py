"""The engine: a database folder, or registered Parquet files, behind SQL and a fluent API."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import IndexCorruption, TableCorruption
from .operators.query import Query
from .operators.ranking import placed
from .plans.lowering import lower, order_of
from .plans.parser import ExplainPlan, SelectPlan, parse_select, parse_statement
from .plans.planner import BoundPlan, bind, explain
from .sources.catalog import Catalog, Folder, IndexEntry, TableEntry
from .types import RID, Column, DataType, Schema, check_row, fold, schema_of, spark_schema

#: Deleted ids up to which they are broadcast to every reader; beyond it the anti join shuffles.
BROADCAST_GONE = 100_000
#: Rows from the driver up to which a batch is written without a job.
DIRECT = 100_000
#: What load() takes for each type; a narrower integer is widened.
_TAKES = {DataType.INTEGER: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), DataType.TEXT: (T.StringType,), DataType.BOOLEAN: (T.BooleanType,)}
_ARROW = {DataType.INTEGER: pa.int64(), DataType.TEXT: pa.string(), DataType.BOOLEAN: pa.bool_()}
#: Hidden columns that order the rows of registered files.
_FILE, _ROW = "_file", "_row"


@dataclass(frozen=True)
class BoundSelect:
    """A lazy result with what planning found out."""

    df: DataFrame
    plan: BoundPlan
    #: The rows before order and limit, with the names of the hidden columns that order ties.
    ordered: tuple[DataFrame, list[str]] | None = None

    def placed(self, name: str, by: Sequence[str] = ()) -> DataFrame:
        """The result with each row's place from 1 in its order; ties go by the columns `by`, then in row order."""
        (df, ties), plan = self.ordered, self.plan
        used = [*[c.name for c in plan.output], *by, *ties, *[c.name for c in [plan.order] if c], *[a.column for a in [plan.access] if a]]
        got = placed(df.select(*dict.fromkeys(used)), order_of(plan, ties, by), name, plan.limit)
        return got.select(*[F.col(c.name) for c in plan.output], name)

    @property
    def output_schema(self) -> Schema:
        return self.plan.output

    @property
    def access_path(self) -> str:
        return self.plan.path

    @property
    def index_name(self) -> str | None:
        return self.plan.access.index if self.plan.access else None

    def rows(self) -> Iterator[Row]:
        return self.df.toLocalIterator()


class Engine:
    """Open with create() or open(); Engine(spark) alone holds registered files only.

    A reader works on the catalog it has loaded, so it sees a snapshot. Every write makes new folders and then replaces
    the catalog file; a failed write leaves the catalog as it was. Folders that a write replaces stay until vacuum().
    """

    def __init__(self, spark: SparkSession, folder: Folder | None = None, catalog: Catalog | None = None):
        self.spark, self.folder, self.catalog = spark, folder, catalog or Catalog()
        self._frames: dict[str, tuple[DataFrame, list[str]]] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Engine:
        folder = Folder(spark, path)
        if folder.exists():
            raise ValueError(f"path already exists: {path}")
        folder.make()
        folder.replace("catalog.json", Catalog().dumped())
        return cls(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        folder = Folder(spark, path)
        if not folder.exists("catalog.json"):
            raise LookupError(f"no database: {path}")
        e = cls(spark, folder, Catalog.loaded(folder.read("catalog.json")))
        for t in e.catalog.tables:
            for b in (*t.batches, *t.gone):
                if not folder.exists(b):
                    raise TableCorruption(f"table {t.name}: missing files: {b}")
        for i in e.catalog.indexes:
            e._check_index(i)
        return e

    # definitions

    def _commit(self, changed: Catalog) -> None:
        changed.commits += 1
        if self.folder is not None:
            self.folder.replace("catalog.json", changed.dumped())
        self.catalog = changed

    def create_table(self, name: str, schema: Sequence[Column], version: int = 1) -> None:
        if self.folder is None:
            raise ValueError("no database is open")
        changed = self.catalog.copied()
        changed.add_table(name, schema, version)
        self._commit(changed)

    def register(self, name: str, path: str) -> None:
        """A read-only table over Parquet files; its row order is by file and place in it."""
        changed = self.catalog.copied()
        changed.add_table(name, schema_of(self.spark.read.parquet(path).schema), path=path)
        self._commit(changed)

    def register_frame(self, name: str, df: DataFrame, order: Sequence[str]) -> None:
        """A read-only table over a DataFrame for this session; `order` are the columns that give its rows their order."""
        if self.folder is not None:
            raise ValueError("a database holds no session tables")
        changed = self.catalog.copied()
        changed.add_table(name, schema_of(df.schema), path="frame:")
        hidden = [f"_o{i}" for i in range(len(order))]
        self._frames[fold(name)] = (df.select("*", *[F.col(c).alias(h) for c, h in zip(order, hidden)]), hidden)
        self._commit(changed)

    def register_index(self, name: str, table: str, column: str, batches: list[str] | None = None) -> None:
        if batches:
            for b in batches:
                self._index_files(b)
        changed = self.catalog.copied()
        changed.register_index(name, table, column, batches)
        self._commit(changed)

    def _index_files(self, batch: str) -> None:
        found = Folder(self.spark, batch).exists() if self._whole(batch) else self.folder is not None and self.folder.exists(batch)
        if not found:
            raise IndexCorruption(f"missing index files: {batch}")

    def _check_index(self, i: IndexEntry) -> None:
        for b in i.batches if i.stored else ():
            self._index_files(b)

    @staticmethod
    def _whole(path: str) -> bool:
        """Whether a path stands by itself, not below the database's folder."""
        return path.startswith("/") or "://" in path or path.startswith("file:")

    # reading

    def _read(self, schema: Schema, batches: list[str]) -> DataFrame:
        want = spark_schema(schema, rid=True)
        if not batches:
            return self.spark.createDataFrame([], want)
        return self.spark.read.schema(want).parquet(*[f"{self.folder.path}/{b}" for b in batches])

    def _live(self, t: TableEntry, df: DataFrame) -> DataFrame:
        if not t.gone:
            return df
        gone = self.spark.read.schema(f"{RID} long").parquet(*[f"{self.folder.path}/{g}" for g in t.gone])
        return df.join(F.broadcast(gone) if t.n_gone <= BROADCAST_GONE else gone, RID, "left_anti")

    def _leading(self, t: TableEntry, n: int) -> DataFrame:
        """A part of a table's rows that holds its first n, from as few batches or files as their counts allow."""
        if fold(t.name) in self._frames:
            return self._base(t)
        if t.path is None:
            if len(t.counts) != len(t.batches):
                return self._base(t)
            some, held = 0, 0
            while some < len(t.batches) and held < n + t.n_gone:
                held += t.counts[some]
                some += 1
            return self._live(t, self._read(t.schema, t.batches[:some]))
        # registered files tell their rows by their footers; of the last one needed, only rows before the limit count
        files, held, some = sorted(self.spark.read.parquet(t.path).inputFiles()), 0, []
        for f in files:
            some.append(f)
            if held + (k := self.spark.read.parquet(f).count()) >= n:
                break
            held += k
        if not some:
            return self._base(t)
        df = self._shown_with_rows(self.spark.read.schema(self.spark.read.parquet(t.path).schema).parquet(*some))
        return df.where((F.col(_FILE) != F.lit(some[-1])) | (F.col(_ROW) < n - held))

    @staticmethod
    def _shown_with_rows(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))

    def _base(self, t: TableEntry) -> DataFrame:
        if fold(t.name) in self._frames:
            return self._frames[fold(t.name)][0]
        if t.path is not None:
            return self._shown_with_rows(self.spark.read.parquet(t.path))
        return self._live(t, self._read(t.schema, t.batches))

    def _ties(self, t: TableEntry) -> list[str]:
        if fold(t.name) in self._frames:
            return self._frames[fold(t.name)][1]
        return [_FILE, _ROW] if t.path is not None else [RID]

    def _copy(self, i: IndexEntry) -> DataFrame | None:
        """The index's sorted copy of the table, if it has one."""
        t = self.catalog.table(i.table)
        if not i.stored:
            return None
        self._check_index(i)
        if t.path is None:
            return self._live(t, self._read(t.schema, i.batches))
        if i.source != self._marks(t):
            return None  # the files were written anew since; the table itself is read
        return self.spark.read.parquet(*[b if self._whole(b) else f"{self.folder.path}/{b}" for b in i.batches])

    def _marks(self, t: TableEntry) -> str:
        folder = self.folder or Folder(self.spark, t.path)
        return folder.marks(self.spark.read.parquet(t.path).inputFiles())

    def table(self, name: str) -> DataFrame:
        """The rows of a table with its declared columns."""
        t = self.catalog.table(name)
        return self._base(t).select(*[F.col(c.name) for c in t.schema])

    def scan(self, name: str) -> list[Row]:
        """All rows in their order, each with its id as the last field."""
        t = self.catalog.table(name)
        return self._base(t).orderBy(*self._ties(t)).collect()

    def cursor(self, name: str) -> Iterator[Row]:
        t = self.catalog.table(name)
        return self._base(t).orderBy(*self._ties(t)).toLocalIterator()

    def read(self, name: str, rid: int) -> tuple:
        t = self._managed(name)
        got = self._base(t).where(F.col(RID) == rid).drop(RID).take(1)
        if not got:
            raise LookupError(f"no row {rid} in {t.name}")
        return tuple(got[0])

    def query(self, name: str) -> Query:
        """The fluent pipeline over a table."""
        t = self.catalog.table(name)
        return Query(self._base(t), [c.name for c in t.schema], self._ties(t), lambda n: self._leading(t, n))

    # SQL

    def bind(self, plan: SelectPlan, in_order: bool = False) -> BoundSelect:
        """in_order: rows come in their order even if the statement asks for none."""
        b = bind(plan, self.catalog)
        t = self.catalog.table(b.table)
        copy = self._copy(self.catalog.index(b.access.index)) if b.access is not None and not b.empty else None
        ahead = b.limit and b.order is None and b.access is None and not b.predicates
        base, ties = self._leading(t, b.limit) if ahead else self._base(t), self._ties(t)
        rows = lower(replace(b, limit=None, order=None, output=b.schema), base, copy, ties, hidden=True)
        return BoundSelect(lower(b, base, copy, ties, in_order), b, (rows, ties))

    def select(self, sql: str) -> BoundSelect:
        return self.bind(parse_select(sql))

    def execute(self, sql: str) -> BoundSelect | BoundPlan:
        """A result, or for EXPLAIN the bound plan, made without reading a row."""
        plan = parse_statement(sql)
        return bind(plan.select, self.catalog) if isinstance(plan, ExplainPlan) else self.bind(plan)

    def explain(self, sql: str) -> str:
        plan = parse_statement(sql)
        return explain(bind(plan.select if isinstance(plan, ExplainPlan) else plan, self.catalog))

    def explain_physical(self, sql: str) -> None:
        self.select(sql).df.explain("formatted")

    # writing

    def _managed(self, name: str) -> TableEntry:
        t = self.catalog.table(name)
        if t.path is not None:
            raise ValueError(f"table {t.name} is read-only")
        return t

    def insert(self, name: str, values: Sequence) -> int:
        return self.insert_many(name, [values])[0]

    def insert_many(self, name: str, rows: Iterable[Sequence]) -> range:
        """Adds rows, all or none, and keeps every index; returns their ids, which are never used again."""
        t = self._managed(name)
        checked = [check_row(t.schema, r) for r in rows]
        numbered = [(*r, t.next_rid + k) for k, r in enumerate(checked)]
        if 0 < len(numbered) <= DIRECT:
            fields = [pa.field(c.name, _ARROW[c.type], c.nullable) for c in t.schema] + [pa.field(RID, pa.int64(), False)]
            self._add(t, pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*numbered), fields)], schema=pa.schema(fields)), len(numbered))
        elif numbered:
            self._add(t, self.spark.createDataFrame(numbered, spark_schema(t.schema, rid=True)), len(numbered))
        return range(t.next_rid, t.next_rid + len(numbered))

    def load(self, name: str, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds a DataFrame of the table's columns, without taking rows to the driver; returns how many.

        Nothing is converted, but narrower integers are widened; ValueError for another type, or for a NULL where none may be.
        batch: (stream, number) of a micro-batch. The commit keeps it with the rows; one that comes again adds nothing.
        """
        t = self._managed(name)
        if batch is not None and batch[1] <= t.streams.get(batch[0], -1):
            return 0
        want = spark_schema(t.schema)
        for c in t.schema:
            kind = df.schema[c.name].dataType if c.name in df.columns else None
            if not isinstance(kind, (*_TAKES[c.type], *[T.NullType] * c.nullable)):
                raise ValueError(f"column {c.name} of type {c.type.value} cannot be loaded from {kind.simpleString() if kind else 'no column'}")
        df = df.select(*[F.col(c.name).cast(f.dataType).alias(c.name) for c, f in zip(t.schema, want.fields)])
        bad = [c.name for c in t.schema if not c.nullable]
        staged = f"tables/{fold(t.name)}/stage-{uuid.uuid4().hex}"
        try:
            df.withColumn(RID, F.monotonically_increasing_id()).write.parquet(f"{self.folder.path}/{staged}")
            at = self.spark.read.parquet(f"{self.folder.path}/{staged}")
            counts = {r["p"]: r["n"] for r in at.groupBy(F.shiftright(RID, 33).alias("p")).agg(F.count("*").alias("n")).collect()}
            if bad and at.where(" or ".join(f"`{c}` is null" for c in bad)).limit(1).count():
                raise ValueError(f"NULL in a required column of {t.name}")
            starts, n = [], t.next_rid
            for p in range(max(counts, default=-1) + 1):
                starts.append(n)
                n += counts.get(p, 0)
            place = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), (F.shiftright(RID, 33) + 1).cast("int"))
            total = n - t.next_rid
            if total:
                self._add(t, at.withColumn(RID, place + F.col(RID).bitwiseAND(F.lit((1 << 33) - 1))), total, batch)
            return total
        finally:
            self.folder.delete(staged)

    def _add(self, t: TableEntry, rows: DataFrame | pa.Table, n: int, batch: tuple[str, int] | None = None) -> None:
        changed = self.catalog.copied()
        tag, made = uuid.uuid4().hex, []
        entry = changed.table(t.name)
        try:
            made.append(f"tables/{fold(t.name)}/batch-{tag}")
            if isinstance(rows, pa.Table):
                self.folder.write_rows(made[0], rows)
            else:
                rows.write.parquet(f"{self.folder.path}/{made[0]}")
                rows = self._read(t.schema, [made[0]])
            if len(entry.counts) == len(entry.batches):
                entry.counts.append(n)
            entry.batches.append(made[0])
            for i in changed.indexes:
                if i.table == t.name and i.stored:
                    made.append(self._index_at(i.name, tag))
                    self._write_index(made[-1], i.column, rows)
                    i.batches.append(made[-1])
            entry.next_rid += n
            if batch is not None:
                entry.streams[batch[0]] = batch[1]
            self._commit(changed)
        except BaseException:
            for m in made:
                self.folder.delete(m)
            raise

    @staticmethod
    def _index_at(name: str, tag: str) -> str:
        return f"indexes/{fold(name)}/batch-{tag}"

    def _write_index(self, at: str, column: str, rows: DataFrame | pa.Table, ties: Sequence[str] = (RID,)) -> None:
        """A copy of the rows whose key is not NULL, in ranges sorted by (key, ties)."""
        if isinstance(rows, pa.Table):
            keyed = rows.filter(rows[column].is_valid())
            return self.folder.write_rows(at, keyed.sort_by([(column, "ascending"), (RID, "ascending")]))
        keyed = rows.where(F.col(column).isNotNull())
        keyed.repartitionByRange(column, *ties).sortWithinPartitions(column, *ties).write.parquet(at if self._whole(at) else f"{self.folder.path}/{at}")

    def erase(self, name: str, rid: int) -> bool:
        """Deletes a row from the table and its indexes; False if there is none."""
        t = self._managed(name)
        row = self._base(t).where(F.col(RID) == rid).take(1)
        if not row:
            return False
        for i in self.catalog.indexes:
            if i.table == t.name and i.stored and row[0][i.column] is not None:
                if not self._copy(i).where((F.col(i.column) == row[0][i.column]) & (F.col(RID) == rid)).take(1):
                    raise TableCorruption(f"index {i.name} lacks row {rid}")
        changed = self.catalog.copied()
        entry = changed.table(t.name)
        at = f"tables/{fold(t.name)}/gone-{uuid.uuid4().hex}"
        self.folder.write_rows(at, pa.table({RID: pa.array([rid], pa.int64())}))
        entry.gone.append(at)
        entry.n_gone += 1
        self._commit(changed)
        return True

    def compact(self, name: str) -> None:
        """Rewrites a table and its indexes as one batch each, without deleted rows; ids stay.

        Readers that are open go on with the old folders, which stay until vacuum().
        """
        t = self._managed(name)
        changed = self.catalog.copied()
        entry = changed.table(t.name)
        tag, made = uuid.uuid4().hex, []
        try:
            made.append(f"tables/{fold(t.name)}/batch-{tag}")
            self._base(t).repartitionByRange(RID).sortWithinPartitions(RID).write.parquet(f"{self.folder.path}/{made[0]}")
            rows = self._read(t.schema, made[:1])
            entry.replaced += [*t.batches, *t.gone]
            entry.batches, entry.gone, entry.n_gone, entry.counts = made[:1], [], 0, [rows.count()]
            for i in changed.indexes:
                if i.table == t.name and i.stored:
                    made.append(self._index_at(i.name, tag))
                    self._write_index(made[-1], i.column, rows)
                    entry.replaced += i.batches
                    i.batches = made[-1:]
            self._commit(changed)
        except BaseException:
            for m in made:
                self.folder.delete(m)
            raise

    def vacuum(self) -> int:
        """Deletes the folders that writes have replaced, once no reader opened before is left; returns how many."""
        if self.folder is None:
            raise ValueError("no database is open")
        changed, old = self.catalog.copied(), []
        for t in changed.tables:
            old += t.replaced
            t.replaced = []
        self._commit(changed)
        for m in old:
            self.folder.delete(m)
        return len(old)

    # indexes

    def create_index(self, name: str, table: str, column: str, at: str | None = None) -> None:
        """Builds the sorted copy from the rows whose key is not NULL, then registers it.

        at: for registered files outside a database, the folder to keep the copy in; without one the index only steers
        planning. A copy of registered files is read as long as they are the same.
        """
        t, c = self.catalog.check_index(name, table, column)
        tag = uuid.uuid4().hex
        if fold(t.name) in self._frames or (t.path is not None and self.folder is None and at is None):
            return self.register_index(name, table, column)
        batch = self._index_at(name, tag)
        batch = batch if self.folder is not None and at is None else f"{at}/{batch}"
        source = self._marks(t) if t.path is not None else None
        try:
            self._write_index(batch, c.name, self._base(t), self._ties(t))
            changed = self.catalog.copied()
            changed.register_index(name, table, column, [batch]).source = source
            self._commit(changed)
        except BaseException:
            Folder(self.spark, batch if self._whole(batch) else f"{self.folder.path}/{batch}").delete("")
            raise

    def describe_index(self, name: str) -> dict:
        """What an index holds: its table and column, entries, files, and least and greatest key."""
        i, df = self._entries(name)
        r = df.agg(F.count("*"), F.min(i.column), F.max(i.column)).first()
        return {"index": i.name, "table": i.table, "column": i.column, "stored": i.stored, "entries": r[0], "files": len(df.inputFiles()) if i.stored else 0,
                "least": r[1], "greatest": r[2]}

    def _entries(self, name: str) -> tuple[IndexEntry, DataFrame]:
        i = self.catalog.index(name)
        copy = self._copy(i)
        if copy is None:
            t = self.catalog.table(i.table)
            return i, self._base(t).where(F.col(i.column).isNotNull())
        return i, copy

    def lookup_index(self, name: str, key: int, limit: int | None = None) -> DataFrame:
        """The rows of one key in row order."""
        i, df = self._entries(name)
        ties = self._ties(self.catalog.table(i.table))
        df = df.where(F.col(i.column) == key).orderBy(*ties)
        return df if limit is None else df.limit(limit)

    def lookup_index_range(self, name: str, lower: int | None = None, upper: int | None = None, descending: bool = False,
                           limit: int | None = None) -> DataFrame:
        """The rows of inclusive bounds by key; rows of one key come in row order either way."""
        i, df = self._entries(name)
        if lower is not None and upper is not None and lower > upper:
            raise ValueError("lower bound above upper bound")
        key = F.col(i.column)
        if lower is not None:
            df = df.where(key >= lower)
        if upper is not None:
            df = df.where(key <= upper)
        df = df.orderBy(key.desc() if descending else key.asc(), *self._ties(self.catalog.table(i.table)))
        return df if limit is None else df.limit(limit)

    def verification(self, name: str) -> DataFrame:
        """One row (missing, extra, indexed): entries that only the table has, that only the index has, and all of the index."""
        i, copy = self._entries(name)
        t = self.catalog.table(i.table)
        cols = [F.col(i.column).alias("key"), *[F.col(x) for x in self._ties(t)]]
        rows = self._base(t).where(F.col(i.column).isNotNull()).select(*cols, F.lit(1).alias("side"))
        both = rows.union(copy.select(*cols, F.lit(-1).alias("side")))
        sums = both.groupBy("key", *self._ties(t)).agg(F.sum("side").alias("d"), F.sum(F.when(F.col("side") < 0, 1).otherwise(0)).alias("n"))
        zero = F.lit(0)
        return sums.agg(F.coalesce(F.sum(F.greatest("d", zero)), zero).alias("missing"), F.coalesce(-F.sum(F.least("d", zero)), zero).alias("extra"),
                        F.coalesce(F.sum("n"), zero).alias("indexed"))

    def verify_index(self, name: str) -> int:
        """How many entries the index has; TableCorruption unless they are the table's, copies counted."""
        r = self.verification(name).first()
        if r["missing"] or r["extra"]:
            raise TableCorruption(f"index {name}: {r['missing']} entries missing, {r['extra']} too many")
        return r["indexed"]
