"""The catalog: tables and indexes, kept as one JSON file that each commit replaces whole."""

from __future__ import annotations

import copy
import hashlib
import io
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from ..errors import CatalogCorruption
from ..types import Column, DataType, Schema, check_identifier, check_schema, fold

FORMAT = 1


@dataclass
class TableEntry:
    name: str
    schema: Schema
    version: int = 1
    #: Folders of row batches and of deleted row ids, below the table's own.
    batches: list[str] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    n_gone: int = 0
    #: Rows of each batch; ids rise from batch to batch. Shorter than `batches` if unknown.
    counts: list[int] = field(default_factory=list)
    #: Folders that no longer count but that open readers may still read; vacuum() deletes them.
    replaced: list[str] = field(default_factory=list)
    next_rid: int = 0
    #: Set for registered Parquet files, which are never written.
    path: str | None = None
    #: The last micro-batch of each stream that was loaded, so that one that comes again is known.
    streams: dict[str, int] = field(default_factory=dict)


@dataclass
class IndexEntry:
    name: str
    table: str
    column: str
    batches: list[str] = field(default_factory=list)
    #: Whether there is a sorted copy; without one the index only steers planning.
    stored: bool = True
    #: For a copy of registered files, what they were when it was made; a copy of other files is not read.
    source: str | None = None


class Catalog:
    """Names compare without ASCII case and keep their spelling; order is that of creation."""

    def __init__(self):
        self.tables: list[TableEntry] = []
        self.indexes: list[IndexEntry] = []
        self.commits = 0

    def schemas(self) -> dict[str, Schema]:
        return {t.name: t.schema for t in self.tables}

    def indexes_of(self, table: str) -> list[tuple[str, str]]:
        return [(i.name, i.column) for i in self.indexes if fold(i.table) == fold(table)]

    def find_table(self, name: str) -> TableEntry | None:
        return next((t for t in self.tables if fold(t.name) == fold(name)), None)

    def find_index(self, name: str) -> IndexEntry | None:
        return next((i for i in self.indexes if fold(i.name) == fold(name)), None)

    def table(self, name: str) -> TableEntry:
        if (t := self.find_table(name)) is None:
            raise LookupError(f"unknown table: {name}")
        return t

    def index(self, name: str) -> IndexEntry:
        if (i := self.find_index(name)) is None:
            raise LookupError(f"unknown index: {name}")
        return i

    def add_table(self, name: str, schema, version: int = 1, path: str | None = None) -> TableEntry:
        check_identifier(name, "table")
        schema = tuple(schema) if path else check_schema(schema)
        if not isinstance(version, int) or version < 1:
            raise ValueError("schema version must be at least 1")
        if self.find_table(name):
            raise ValueError(f"table already exists: {name}")
        self.tables.append(TableEntry(name, schema, version, path=path))
        return self.tables[-1]

    def check_index(self, name: str, table: str, column: str) -> tuple[TableEntry, Column]:
        check_identifier(name, "index")
        if self.find_index(name):
            raise ValueError(f"index already exists: {name}")
        if (t := self.find_table(table)) is None:
            raise ValueError(f"unknown table: {table}")
        c = next((c for c in t.schema if fold(c.name) == fold(column)), None)
        if c is None:
            raise ValueError(f"unknown column: {column}")
        if c.type is not DataType.INTEGER:
            raise ValueError(f"column {c.name} is no INTEGER column")
        return t, c

    def register_index(self, name: str, table: str, column: str, batches: list[str] | None = None) -> IndexEntry:
        """Metadata only: without batches the index steers planning and EXPLAIN."""
        t, c = self.check_index(name, table, column)
        if batches and any(set(batches) & set(i.batches) for i in self.indexes):
            raise ValueError("two indexes cannot share a stored copy")
        self.indexes.append(IndexEntry(name, t.name, c.name, list(batches or []), batches is not None))
        return self.indexes[-1]

    def copied(self) -> Catalog:
        return copy.deepcopy(self)

    def dumped(self) -> str:
        tables = [{**t.__dict__, "schema": [[c.name, c.type.value, c.nullable] for c in t.schema]} for t in self.tables]
        return json.dumps({"format": FORMAT, "commits": self.commits, "tables": tables, "indexes": [i.__dict__ for i in self.indexes]}, indent=1)

    @classmethod
    def loaded(cls, text: str) -> Catalog:
        out = cls()
        try:
            raw = json.loads(text)
            if raw["format"] != FORMAT:
                raise ValueError("unknown format")
            out.commits = int(raw["commits"])
            for t in raw["tables"]:
                schema = tuple(Column(n, DataType(k), bool(z)) for n, k, z in t["schema"])
                entry = out.add_table(t["name"], schema, t["version"], t["path"])
                entry.batches, entry.gone, entry.n_gone, entry.next_rid = list(t["batches"]), list(t["gone"]), int(t["n_gone"]), int(t["next_rid"])
                entry.streams = {str(k): int(v) for k, v in t.get("streams", {}).items()}
                entry.counts, entry.replaced = [int(n) for n in t.get("counts", [])], list(t.get("replaced", []))
            for i in raw["indexes"]:
                made = out.register_index(i["name"], i["table"], i["column"], list(i["batches"]))
                made.stored, made.source = bool(i["stored"]), i.get("source")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise CatalogCorruption(f"unreadable catalog: {e}") from e
        return out


class Folder:
    """Files of any file system that Spark reaches, by Hadoop's own calls."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def make(self) -> None:
        self.fs.mkdirs(self._at(""))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def write_rows(self, name: str, rows: pa.Table) -> None:
        """A Parquet folder of rows that the driver holds, made without a job; it looks like one of Spark's."""
        held = io.BytesIO()
        pq.write_table(rows, held, compression="snappy")
        self.write(f"{name}/part-00000.snappy.parquet", held.getvalue())
        self.write(f"{name}/_SUCCESS", b"")

    def marks(self, paths: Sequence[str]) -> str:
        """Names, lengths and times of files, as one string that differs once any of them was written anew."""
        out = []
        for p in sorted(paths):
            at = self.jvm.org.apache.hadoop.fs.Path(p)
            s = at.getFileSystem(self.conf).getFileStatus(at)
            out.append(f"{p} {s.getLen()} {s.getModificationTime()}")
        return hashlib.sha256("\n".join(out).encode()).hexdigest()

    def replace(self, name: str, text: str) -> None:
        """Writes beside the file and renames onto it, so readers see the old or the new one."""
        beside = self._at(f".{name}.new")
        self.write(f".{name}.new", text.encode("utf-8"))
        fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri() if ":" in self.path else self.jvm.java.net.URI("file:///"), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        fc.rename(beside, self._at(name), options)
