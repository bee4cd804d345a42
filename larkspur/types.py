"""Columns, schemas and the values they admit."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

INT_MIN, INT_MAX = -(2**63), 2**63 - 1
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*", re.ASCII)
#: The longest identifier and the widest schema.
_LIMIT = 65_535
#: The hidden row id of managed tables.
RID = "_rid"


class DataType(Enum):
    INTEGER = "INTEGER"
    TEXT = "TEXT"
    BOOLEAN = "BOOLEAN"
    #: Columns of registered files of any other type: they can be shown and tested for NULL only.
    OPAQUE = "OPAQUE"


_SPARK = {DataType.INTEGER: T.LongType(), DataType.TEXT: T.StringType(), DataType.BOOLEAN: T.BooleanType()}
_PYTHON = {DataType.INTEGER: int, DataType.TEXT: str, DataType.BOOLEAN: bool}


@dataclass(frozen=True)
class Column:
    name: str
    type: DataType
    nullable: bool = False


Schema = tuple[Column, ...]


def fold(name: str) -> str:
    """A name as it is compared: ASCII letters in lower case."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def check_identifier(name: str, what: str) -> None:
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name) or len(name) > _LIMIT:
        raise ValueError(f"invalid {what} name: {name!r}")


def check_schema(columns: Sequence[Column]) -> Schema:
    if not columns:
        raise ValueError("a table needs at least one column")
    if len(columns) > _LIMIT:
        raise ValueError("too many columns")
    seen = set()
    for c in columns:
        check_identifier(c.name, "column")
        if fold(c.name) in seen:
            raise ValueError(f"duplicate column name: {c.name}")
        if fold(c.name) == RID:
            raise ValueError(f"column name {RID} is reserved")
        if c.type not in _SPARK:
            raise ValueError(f"column {c.name} has no storable type")
        seen.add(fold(c.name))
    return tuple(columns)


def check_row(schema: Schema, values: Sequence) -> tuple:
    """The values as a tuple, or ValueError for a wrong count, a NULL where none may be, a wrong type or range."""
    if len(values) != len(schema):
        raise ValueError(f"expected {len(schema)} values, got {len(values)}")
    for c, v in zip(schema, values):
        if v is None:
            if not c.nullable:
                raise ValueError(f"column {c.name} cannot be NULL")
        elif type(v) is not _PYTHON[c.type]:
            raise ValueError(f"column {c.name} expects {c.type.value}")
        elif c.type is DataType.INTEGER and not INT_MIN <= v <= INT_MAX:
            raise ValueError(f"column {c.name}: integer out of range")
    return tuple(values)


def spark_schema(schema: Schema, rid: bool = False) -> T.StructType:
    fields = [T.StructField(c.name, _SPARK[c.type], c.nullable) for c in schema]
    return T.StructType(fields + [T.StructField(RID, T.LongType(), False)] * rid)


def schema_of(struct: T.StructType) -> Schema:
    """The engine's view of a file's schema; widths stay as they are in the file."""
    def kind(t: T.DataType) -> DataType:
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return DataType.INTEGER
        if isinstance(t, T.StringType):
            return DataType.TEXT
        return DataType.BOOLEAN if isinstance(t, T.BooleanType) else DataType.OPAQUE

    seen = set()
    for f in struct.fields:
        if fold(f.name) in seen:
            raise ValueError(f"duplicate column name: {f.name}")
        seen.add(fold(f.name))
    return tuple(Column(f.name, kind(f.dataType), f.nullable) for f in struct.fields)
