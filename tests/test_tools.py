import json

import pytest

from larkspur import demo
from larkspur.engine import Engine
from larkspur.report import SETTINGS, report
from larkspur.streaming import append
from larkspur.types import Column, DataType


def test_demo(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/demo"
    demo.make(spark, path)
    e = Engine.open(spark, path)
    assert [tuple(r) for r in e.select("SELECT name FROM people WHERE active = FALSE").df.collect()] == [("Tony",)]
    assert e.verify_index("people_id_idx") == 5 and e.explain("SELECT * FROM people WHERE id = 3").startswith("INDEX_LOOKUP")
    with pytest.raises(ValueError):
        demo.make(spark, path)
    monkeypatch.setattr(demo, "ROWS", ((1, None, True, None),))
    with pytest.raises(ValueError):
        demo.make(spark, f"{path}2")
    assert not (tmp_path / "demo2").exists()


def test_report(spark):
    got = json.loads(json.dumps(report(spark)))
    assert got["spark"] == spark.version and set(got["settings"]) == set(SETTINGS) and got["settings"]["spark.sql.shuffle.partitions"] == "4"


def test_stream_loads_each_batch_once(spark, tmp_path):
    e = Engine.create(spark, f"{tmp_path}/db")
    e.create_table("t", [Column("id", DataType.INTEGER), Column("name", DataType.TEXT, True)])
    e.create_index("by_id", "t", "id")
    rows = spark.createDataFrame([(i, None if i % 3 else f"n{i}") for i in range(20)], "id long, name string")
    rows.write.parquet(f"{tmp_path}/in")

    def run():
        append(e, "t", spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/at").awaitTermination()

    run()
    assert e.table("t").count() == 20 and e.verify_index("by_id") == 20
    rows.where("id < 5").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    e = Engine.open(spark, f"{tmp_path}/db")
    assert e.table("t").count() == 25 and e.verify_index("by_id") == 25
    assert e.load("t", rows, (f"{tmp_path}/at", 1)) == 0 and e.table("t").count() == 25
    assert e.load("t", rows, (f"{tmp_path}/at", 2)) == 20 and e.table("t").count() == 45
