"""The command line: python -m larkspur.cli DATABASE COMMAND ..."""

from __future__ import annotations

import re
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .engine import BoundSelect, Engine
from .plans.parser import parse_statement
from .plans.planner import explain
from .sources.records import RecordStore
from .types import INT_MAX, INT_MIN, Column, DataType, fold

PROGRAM = "larkspur"
USAGE = f"""usage: {PROGRAM} DATABASE COMMAND
  init                                   create the database
  create-table TABLE NAME:TYPE[?]...     TYPE is int, text or bool; ? admits NULL
  create-index INDEX TABLE COLUMN
  verify-index INDEX
  insert TABLE VALUE...
  query SQL
  shell
  put TEXT | get ID | erase ID | list    raw records"""
HELP = """.tables         list the tables
.schema TABLE   show a table's columns
.help           show this help
.quit           leave
Anything else is a SQL statement."""
_TYPES = {"int": DataType.INTEGER, "integer": DataType.INTEGER, "text": DataType.TEXT, "bool": DataType.BOOLEAN, "boolean": DataType.BOOLEAN}
_ESCAPES = str.maketrans({"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"})


#: What a statement or command can fail with; anything else is a fault of the program.
FAULTS = (ValueError, LookupError, RuntimeError, PySparkException, Py4JError)


class UsageError(Exception):
    pass


def said(e: BaseException) -> str:
    """The first line of a fault."""
    return (str(e.args[0] if e.args and isinstance(e.args[0], str) else e) or type(e).__name__).splitlines()[0]


def column_spec(text: str) -> Column:
    name, colon, kind = text.rpartition(":")
    nullable = kind.endswith("?")
    kind = kind[:-1] if nullable else kind
    if not colon or not name or fold(kind) not in _TYPES:
        raise ValueError(f"invalid column: {text}")
    return Column(name, _TYPES[fold(kind)], nullable)


def value_of(column: Column, text: str):
    if text == "NULL":
        if not column.nullable:
            raise ValueError(f"column {column.name} cannot be NULL")
        return None
    if column.type is DataType.TEXT:
        return text
    if column.type is DataType.BOOLEAN:
        if fold(text) not in ("true", "false"):
            raise ValueError(f"invalid boolean: {text}")
        return fold(text) == "true"
    if not re.fullmatch(r"\+?-?[0-9]+", text, re.ASCII) or not INT_MIN <= int(text.lstrip("+")) <= INT_MAX:
        raise ValueError(f"invalid integer: {text}")
    return int(text.lstrip("+"))


def shown(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return v.translate(_ESCAPES) if isinstance(v, str) else str(v)


def run_sql(engine: Engine, sql: str, out) -> None:
    got = engine.execute(sql)
    if not isinstance(got, BoundSelect):
        print(explain(got), file=out)
        return
    print("\t".join(c.name for c in got.output_schema), file=out)
    if got.plan.order is None and got.plan.limit is None:
        got = engine.bind(parse_statement(sql), in_order=True)  # rows come in their own order, which Spark keeps only if asked
    for r in got.rows():
        print("\t".join(shown(v) for v in r), file=out)


def schema_line(engine: Engine, name: str) -> str:
    t = engine.catalog.table(name)
    cols = ", ".join(f"{c.name} {c.type.value} {'' if c.nullable else 'NOT '}NULL" for c in t.schema)
    return f"{t.name}({cols}) [schema version {t.version}]"


def shell(engine: Engine, lines, out, err) -> int:
    """Reads statements and dot commands; a fault is told and the session goes on."""
    prompt = getattr(lines, "isatty", lambda: False)()
    while True:
        if prompt:
            print(f"{PROGRAM}> ", end="", file=out, flush=True)
        line = lines.readline()
        if not line:
            return 0
        line = line.strip()
        if not line:
            continue
        try:
            if line in (".quit", ".exit"):
                return 0
            if line == ".help":
                print(HELP, file=out)
            elif line == ".tables":
                for name in sorted((t.name for t in engine.catalog.tables), key=fold):
                    print(name, file=out)
            elif line.split()[0] == ".schema" and len(line.split()) == 2:
                print(schema_line(engine, line.split()[1]), file=out)
            elif line.startswith("."):
                raise ValueError(f"unknown command: {line}")
            else:
                run_sql(engine, line, out)
        except FAULTS as e:
            print(f"error: {said(e)}", file=err)


def command(spark: SparkSession, args: list[str], out=None, err=None, lines=None) -> None:
    out, err, lines = out or sys.stdout, err or sys.stderr, lines or sys.stdin
    if len(args) < 2:
        raise UsageError
    path, name, rest = args[0], args[1], args[2:]
    if name == "init" and not rest:
        Engine.create(spark, path)
        print(f"initialized {path}", file=out)
        return
    needs = {"create-table": (2, None), "create-index": (3, 3), "verify-index": (1, 1), "insert": (2, None), "query": (1, 1),
             "shell": (0, 0), "put": (1, 1), "get": (1, 1), "erase": (1, 1), "list": (0, 0)}.get(name)
    if needs is None or len(rest) < needs[0] or (needs[1] is not None and len(rest) > needs[1]):
        raise UsageError
    engine = Engine.open(spark, path)
    if name == "create-table":
        engine.create_table(rest[0], [column_spec(c) for c in rest[1:]])
        print(f"created table {rest[0]}", file=out)
    elif name == "create-index":
        engine.create_index(*rest)
        i = engine.catalog.index(rest[0])
        print(f"created index {i.name} on {i.table}({i.column})", file=out)
    elif name == "verify-index":
        print(f"verified index {engine.catalog.index(rest[0]).name} rows={engine.verify_index(rest[0])}", file=out)
    elif name == "insert":
        t = engine.catalog.table(rest[0])
        if len(rest) - 1 != len(t.schema):
            raise ValueError(f"table {t.name} has {len(t.schema)} columns")
        print(engine.insert(t.name, [value_of(c, v) for c, v in zip(t.schema, rest[1:])]), file=out)
    elif name == "query":
        run_sql(engine, rest[0], out)
    elif name == "shell":
        shell(engine, lines, out, err)
    else:
        raw(RecordStore(spark, f"{path}/records"), name, rest, out)


def as_bytes(out, data: bytes) -> None:
    """Writes bytes as they are; to a stream of text alone, those that are no UTF-8 as surrogates, which give them back."""
    below = getattr(out, "buffer", None)
    if below is None:
        out.write(data.decode("utf-8", "surrogateescape"))
    else:
        out.flush()
        below.write(data)
        below.flush()


def raw(store: RecordStore, name: str, rest: list[str], out) -> None:
    if name == "put":
        print(store.insert(rest[0].encode("utf-8", "surrogateescape")), file=out)
    elif name == "list":
        for r in store.cursor():
            as_bytes(out, f"{r['rid']}\t".encode() + bytes(r["bytes"]) + b"\n")
    else:
        if not rest[0].isdecimal():
            raise ValueError(f"invalid record id: {rest[0]}")
        rid = int(rest[0])
        if name == "get":
            as_bytes(out, store.read(rid) + b"\n")
        elif not store.erase(rid):
            raise LookupError(f"no record {rid}")
        else:
            print(f"deleted {rid}", file=out)


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None, lines=None) -> int:
    """0 if all went well, 1 after an error, 2 for wrong usage."""
    args, err = sys.argv[1:] if args is None else args, err or sys.stderr
    try:
        if len(args) < 2:
            raise UsageError
        spark = spark or SparkSession.builder.appName(PROGRAM).getOrCreate()
        command(spark, args, out, err, lines)
        return 0
    except UsageError:
        print(USAGE, file=err)
        return 2
    except FAULTS as e:
        print(f"{PROGRAM}: {said(e)}", file=err)
        return 1


if __name__ == "__main__":
    sys.exit(main())
