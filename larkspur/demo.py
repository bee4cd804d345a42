"""Makes a small database to try queries on: python -m larkspur.demo DATABASE"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.catalog import Folder
from .types import Column, DataType

ROWS = ((1, "Mary", True, None), (2, "Edgar", True, "librarian"), (3, "Radia", True, "bridges"), (4, "Tony", False, None), (5, "Barbara", True, "types"))


def make(spark: SparkSession, path: str) -> Engine:
    """A table `people` of five rows with an index on its id; ValueError if the path exists, and nothing is left of a failed try."""
    folder = Folder(spark, path)
    if folder.exists():
        raise ValueError(f"path already exists: {path}")
    try:
        e = Engine.create(spark, path)
        e.create_table("people", [Column("id", DataType.INTEGER), Column("name", DataType.TEXT), Column("active", DataType.BOOLEAN), Column("note", DataType.TEXT, True)])
        e.create_index("people_id_idx", "people", "id")
        e.insert_many("people", ROWS)
        return e
    except BaseException:
        folder.delete("")
        raise


if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit("usage: python -m larkspur.demo DATABASE")
    try:
        make(SparkSession.builder.appName("larkspur").getOrCreate(), sys.argv[1])
    except ValueError as fault:
        sys.exit(f"larkspur: {fault}")
    print(f"created {sys.argv[1]}")
