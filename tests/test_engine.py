"""Managed tables, indexes, the fluent API, raw records, the command line and the registered queries."""

import io
import random
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur import engine as engine_module
from larkspur.cli import main
from larkspur.engine import Engine
from larkspur.errors import IndexCorruption, TableCorruption
from larkspur.operators import query as query_module
from larkspur.operators import ranking
from larkspur.operators.query import Query
from larkspur.operators.ranking import first_rows, placed
from larkspur.plans import lowering
from larkspur.sources.records import RecordStore
from larkspur.types import Column, DataType

I, X, B = DataType.INTEGER, DataType.TEXT, DataType.BOOLEAN
CREW = (Column("berth", I), Column("call", X), Column("ashore", B), Column("rank", X, True))
ROWS = [(40, "Nell", True, None), (41, "Omar", False, "cook"), (42, "Pia", True, "mate"), (43, "Nell", False, "bosun")]


@pytest.fixture
def crew(spark, tmp_path):
    e = Engine.create(spark, f"{tmp_path}/db")
    e.create_table("Crew", CREW)
    e.insert_many("crew", ROWS)
    return e


def rows(e, sql):
    got = [tuple(r) for r in e.select(sql).rows()]
    return got if "ORDER BY" in sql else sorted(got)


def test_select(crew):
    got = crew.select("SELECT CALL, call, berth FROM crew WHERE ashore = TRUE AND rank IS NULL")
    assert [c.name for c in got.output_schema] == ["call", "call", "berth"] and [tuple(r) for r in got.rows()] == [("Nell", "Nell", 40)]
    assert rows(crew, "SELECT berth FROM crew ORDER BY call DESC LIMIT 9") == [(42,), (41,), (40,), (43,)]
    assert rows(crew, "SELECT berth FROM crew ORDER BY rank DESC") == [(42,), (41,), (43,), (40,)]
    assert rows(crew, "SELECT berth FROM crew WHERE rank != 'cook'") == [(42,), (43,)] and rows(crew, "SELECT berth FROM crew WHERE rank = NULL") == []
    assert [tuple(r) for r in crew.select("SELECT berth FROM crew ORDER BY call DESC LIMIT 3").placed("at").orderBy("at").collect()] == [(42, 1), (41, 2), (40, 3)]
    assert crew.select("SELECT berth FROM crew WHERE berth = 1 AND call = 'x' LIMIT 0").placed("at").count() == 0


def test_writes(crew, spark):
    for bad in ((1, "x", True), (None, "x", True, None), (1, 2, True, None), (2**63, "x", True, None), (True, "x", True, None)):
        with pytest.raises(ValueError):
            crew.insert("crew", bad)
    crew.create_index("berths", "crew", "berth")
    rid = crew.insert("crew", (42, "Quin", True, None))
    assert [r["call"] for r in crew.lookup_index("BERTHS", 42).collect()] == ["Pia", "Quin"]
    assert [r["call"] for r in crew.lookup_index_range("berths", 41, None, True).collect()] == ["Nell", "Pia", "Quin", "Omar"]
    with pytest.raises(ValueError):
        crew.lookup_index_range("berths", 9, 8)
    assert crew.erase("crew", rid) and not crew.erase("crew", rid) and crew.verify_index("berths") == 4
    crew.compact("crew")
    again = Engine.open(spark, crew.folder.path)
    assert again.verify_index("berths") == 4 and again.read("crew", 0) == ROWS[0] and again.insert("crew", ROWS[0]) == rid + 1
    with pytest.raises(LookupError):
        again.read("crew", rid)
    df = spark.range(5).select(F.col("id") + 10, F.lit("n"), F.lit(True), F.lit(None).cast("string")).toDF("berth", "call", "ashore", "rank")
    assert again.load("crew", df) == 5 and again.load("crew", df.withColumn("berth", F.col("berth").cast("short"))) == 5 and again.verify_index("berths") == 15
    for column, bad in (("call", F.lit(None).cast("string")), ("berth", F.lit(1.9)), ("call", F.lit(7)), ("ashore", F.lit("true")), ("berth", F.lit("7"))):
        with pytest.raises(ValueError):
            again.load("crew", df.withColumn(column, bad))
    assert again.table("crew").count() == 15
    again.catalog.index("berths").batches.pop()
    with pytest.raises(TableCorruption):
        again.verify_index("berths")


def test_rows_from_the_driver_in_either_way(crew, monkeypatch):
    crew.create_index("berths", "crew", "berth")
    monkeypatch.setattr(engine_module, "DIRECT", 1)
    crew.insert_many("crew", [(44, "Rui", False, None), (45, "Sol", True, "mate")])
    assert crew.verify_index("berths") == 6 and [r["berth"] for r in crew.scan("crew")] == [40, 41, 42, 43, 44, 45]


def test_open_readers_outlive_compact(crew, spark):
    crew.erase("crew", 1)
    crew.create_index("berths", "crew", "berth")
    reader = Engine.open(spark, crew.folder.path)
    held = reader.select("SELECT call FROM crew WHERE berth >= 40")
    crew.compact("crew")
    assert sorted(r[0] for r in held.rows()) == ["Nell", "Nell", "Pia"] and reader.table("crew").count() == 3
    assert Engine.open(spark, crew.folder.path).vacuum() == 3 and crew.table("crew").count() == 3
    later = Engine.open(spark, crew.folder.path)
    assert later.verify_index("berths") == 3 and later.vacuum() == 0


def test_failed_writes_leave_nothing(crew, monkeypatch):
    at = Path(crew.folder.path)
    before = sorted(p.name for p in at.rglob("batch-*"))
    monkeypatch.setattr(crew, "_commit", lambda changed: (_ for _ in ()).throw(OSError("full")))
    for write in (lambda: crew.create_index("berths", "crew", "berth"), lambda: crew.compact("crew"), lambda: crew.insert("crew", ROWS[0])):
        with pytest.raises(OSError):
            write()
    assert sorted(p.name for p in at.rglob("batch-*")) == before


def test_missing_files_are_told_apart(crew, spark):
    crew.create_index("berths", "crew", "berth")
    crew.folder.delete(crew.catalog.index("berths").batches[0])
    for read in (lambda: crew.select("SELECT * FROM crew WHERE berth = 40"), lambda: crew.lookup_index("berths", 40), lambda: Engine.open(spark, crew.folder.path)):
        with pytest.raises(IndexCorruption):
            read()
    crew.folder.delete(crew.catalog.table("crew").batches[0])
    with pytest.raises(TableCorruption):
        Engine.open(spark, crew.folder.path)


def test_index_of_registered_files(spark, tmp_path):
    path = f"{tmp_path}/ports.parquet"
    spark.range(0, 300, 1, 3).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")).write.parquet(path)
    e = Engine(spark)
    e.register("ports", path)
    e.create_index("ks", "ports", "k", f"{tmp_path}/copies")
    e.create_index("vs", "ports", "v")
    want = [(7, v) for v in range(7, 300, 50)]
    got = e.select("SELECT * FROM ports WHERE k = 7")
    assert got.index_name == "ks" and "copies" in "".join(got.df.inputFiles()) and sorted(map(tuple, got.rows())) == want
    assert e.describe_index("ks") == {"index": "ks", "table": "ports", "column": "k", "stored": True, "entries": 300, "files": e.describe_index("ks")["files"], "least": 0, "greatest": 49}
    assert e.verify_index("ks") == 300 and e.describe_index("vs")["stored"] is False
    spark.range(300, 310).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")).write.mode("append").parquet(path)
    got = e.select("SELECT * FROM ports WHERE k = 7")
    assert "copies" not in "".join(got.df.inputFiles()) and sorted(map(tuple, got.rows())) == [*want, (7, 307)]


def test_limit_reads_leading_batches_only(spark, tmp_path):
    e = Engine.create(spark, f"{tmp_path}/db")
    e.create_table("log", [Column("n", I)])
    for i in range(5):
        e.insert_many("log", [(10 * i + k,) for k in range(10)])
    e.erase("log", 0)
    read = lambda df: len({f for f in df.inputFiles() if "/batch-" in f})
    got = e.select("SELECT n FROM log LIMIT 12")
    assert [r[0] for r in got.rows()] == list(range(1, 13)) and read(got.df) == 2
    assert read(e.select("SELECT n FROM log ORDER BY n DESC LIMIT 12").df) == 5
    q = e.query("log")
    assert read(q.limit(3).df) == 1 and q.limit(3).project([0]).collect() == [(1,), (2,), (3,)] and q.filter(q.column(0) > 40).limit(2).collect() == [(41,), (42,)]
    again = Engine.open(spark, f"{tmp_path}/db")
    assert read(again.select("SELECT n FROM log LIMIT 1").df) == 1
    again.compact("log")
    assert [r[0] for r in again.select("SELECT n FROM log LIMIT 2").rows()] == [1, 2]
    path = f"{tmp_path}/files.parquet"
    spark.range(0, 90, 1, 9).write.parquet(path)
    e = Engine(spark)
    e.register("files", path)
    got = e.select("SELECT id FROM files LIMIT 25")
    assert len(got.df.inputFiles()) == 3 and [r[0] for r in got.rows()] == list(range(25)) and len(rows(e, "SELECT id FROM files LIMIT 900")) == 90


def test_limits_beyond_those_of_spark(spark, crew, monkeypatch):
    monkeypatch.setattr(query_module, "MOST", 2)
    assert [r[0] for r in first_rows(spark.range(50), [F.col("id").desc()], 7, 3).orderBy(F.desc("id")).collect()] == [49, 48, 47, 46, 45, 44, 43]
    assert crew.query("crew").limit(3).project([0]).collect() == [(40,), (41,), (42,)]
    plan = crew.select("SELECT berth FROM crew ORDER BY call LIMIT 3").plan
    t = crew.catalog.table("crew")
    assert sorted(r[0] for r in lowering.lower(plan, crew._base(t), None, ["_rid"], most=2).collect()) == [40, 41, 43]


OPS = {"=": int.__eq__, "!=": int.__ne__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}


def test_index_changes_no_result(spark, tmp_path):
    """320 statements over an indexed table against plain Python; every one must choose an index."""
    rng = random.Random(11)
    data = [(rng.randint(-9, 9), rng.randint(0, 200), rng.random() < 0.4, k) for k in range(140)]
    e = Engine.create(spark, f"{tmp_path}/db")
    e.create_table("tide", [Column("level", I), Column("mark", I), Column("spring", B), Column("seq", I)])
    e.insert_many("tide", data)
    e.create_index("levels", "tide", "level")
    e.create_index("marks", "tide", "mark")
    cases = []
    for _ in range(320):
        tests = [(0, rng.choice("= < <= > >=".split()), rng.randint(-11, 11))]
        tests += [(c, rng.choice(list(OPS)), rng.randint(-11, 11) if c == 0 else rng.randint(0, 200)) for c in (0, 1) if rng.random() < 0.4]
        flag = rng.choice([None, None, True, False])
        order = rng.choice([None, (0, False), (0, True), (1, False), (1, True)])
        limit = rng.choice([None, rng.randint(0, 15)]) if order else None
        names = ("level", "mark")
        sql = "SELECT * FROM tide WHERE " + " AND ".join([f"{names[c]} {op} {v}" for c, op, v in tests] + ([] if flag is None else [f"spring = {str(flag).upper()}"]))
        sql += ("" if order is None else f" ORDER BY {names[order[0]]}{' DESC' if order[1] else ''}") + ("" if limit is None else f" LIMIT {limit}")
        want = [r for r in data if all(OPS[op](r[c], v) for c, op, v in tests) and (flag is None or r[2] == flag)]
        got = e.select(sql)
        assert got.index_name is not None, sql
        if order:
            path = got.plan.access
            second = 0 if path.column == "level" else 1
            want.sort(key=lambda r: (-r[order[0]] if order[1] else r[order[0]], 0 if path.lookup else r[second], r[3]))
        cases.append((sql, got, want if limit is None else want[:limit], order))
    for at in range(0, len(cases), 40):
        some = cases[at:at + 40]
        both = reduce(lambda a, b: a.union(b), [got.df.withColumn("q", F.lit(i)) for i, (_, got, _, _) in enumerate(some)]).collect()
        for i, (sql, _, want, _) in enumerate(some):
            assert sorted(tuple(r)[:4] for r in both if r["q"] == i) == sorted(want), sql
    for sql, got, want, order in [c for c in cases if c[3]][:24]:
        assert [tuple(r) for r in got.rows()] == want, sql


def test_fluent(spark, crew):
    q = crew.query("crew")
    assert q.filter(q.column(2)).sort(q.column(1), descending=True).project([0, 0]).limit(1).collect() == [(42, 42)]
    assert q.sort(q.column(1)).project([0]).collect() == [(40,), (43,), (41,), (42,)] and q.limit(0).collect() == []
    assert q.filter(lambda r: r[3] is not None).limit(2).project([]).collect() == [(), ()]
    for bad in (lambda: q.project([4]), lambda: q.column(-1)):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: q.sort(), lambda: q.filter(None), lambda: q.limit(-1), lambda: Query.from_rows(spark, [(1, 2)], CREW)):
        with pytest.raises(ValueError):
            bad()
    assert Query.from_rows(spark, [], CREW).collect() == []


def test_cursor_and_scan_keep_order(crew):
    crew.erase("crew", 2)
    crew.insert("crew", (7, "Tam", False, None))
    want = [40, 41, 43, 7]
    assert [r["berth"] for r in crew.cursor("crew")] == [r["berth"] for r in crew.scan("crew")] == want


def test_records(spark, tmp_path):
    s = RecordStore(spark, f"{tmp_path}/r")
    assert [s.insert(b"fog"), s.insert(b"\xfe")] == [0, 1]
    s.replace(0, b"haze")
    assert s.erase(1) and not s.erase(1) and RecordStore(spark, f"{tmp_path}/r").scan() == [(0, b"haze")] and s.insert(b"mist") == 2
    with pytest.raises(LookupError):
        s.read(1)
    with pytest.raises(ValueError):
        s.insert(b"")


@pytest.fixture
def run(spark, tmp_path):
    def go(*args, lines=""):
        out, err = io.StringIO(), io.StringIO()
        return main([f"{tmp_path}/cli", *args], spark, out, err, io.StringIO(lines)), out.getvalue(), err.getvalue()

    go.path = f"{tmp_path}/cli"
    return go


def test_cli(run):
    assert run("init") == (0, f"initialized {run.path}\n", "") and run("init")[0] == 1
    assert run("create-table", "Crew", "berth:INT", "call:text", "ashore:bool", "rank:text?") == (0, "created table Crew\n", "")
    assert run("insert", "crew", "9", "back\\slash\nline", "FALSE", "NULL") == (0, "0\n", "")
    assert run("insert", "crew", "+12", "Uma", "true", "pilot")[1] == "1\n" and run("insert", "crew", "twelve", "a", "true", "x")[0] == 1
    assert run("create-index", "berths", "crew", "BERTH")[1] == "created index berths on Crew(berth)\n"
    assert run("verify-index", "berths")[1] == "verified index berths rows=2\n"
    assert run("query", "SELECT * FROM crew")[1] == "berth\tcall\tashore\trank\n9\tback\\\\slash\\nline\tfalse\tNULL\n12\tUma\ttrue\tpilot\n"
    assert run("query", "EXPLAIN SELECT call FROM crew WHERE berth = 9")[1].startswith("INDEX_LOOKUP table=Crew index=berths key=9 ")
    code, out, err = run("shell", lines=".tables\n.schema crew\nhoist\n.rig\nSELECT berth FROM crew LIMIT 1\n.quit\n")
    assert code == 0 and out == "Crew\nCrew(berth INTEGER NOT NULL, call TEXT NOT NULL, ashore BOOLEAN NOT NULL, rank TEXT NULL) [schema version 1]\nberth\n9\n" and err.count("error: ") == 2
    assert run("put", "ahoy")[1] == "0\n" and run("get", "0")[1] == "ahoy\n" and run("list")[1] == "0\tahoy\n"
    assert run("erase", "0")[1] == "deleted 0\n" and run("erase", "0")[0] == 1 and run("reef")[0] == 2


def test_shell_outlives_faults_of_spark(run, spark):
    run("init")
    run("create-table", "t", "n:int")
    run("insert", "t", "3")
    e = Engine.open(spark, run.path)
    e.folder.write(f"{e.catalog.table('t').batches[0]}/part-00000.snappy.parquet", b"no parquet")
    code, out, err = run("shell", lines="SELECT * FROM t\n.tables\n")
    assert code == 0 and out.endswith("t\n") and err.startswith("error: ") and err.count("\n") == 1


def test_records_come_out_byte_by_byte(run, spark):
    run("init")
    data = b"\xff\x00\xc3\xa9 end"
    RecordStore(spark, f"{run.path}/records").insert(data)
    assert run("get", "0")[1].encode("utf-8", "surrogateescape") == data + b"\n"
    assert run("list")[1].encode("utf-8", "surrogateescape") == b"0\t" + data + b"\n"
    below = io.BytesIO()
    assert main([run.path, "get", "0"], spark, io.TextIOWrapper(below, "ascii"), io.StringIO()) == 0 and below.getvalue() == data + b"\n"


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from larkspur.queries import ORACLE_SQL, QUERIES, TABLES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(repr([r[c] for c in cols]) for r in df.collect())
        cur = con.execute(sql)
        at = [x[0] for x in cur.description]
        want = sorted(repr([r[at.index(c)] for c in cols]) for r in cur.fetchall())
        assert got == want and cols == sorted(at), name


def check_places(spark, d, name):
    """A query with an order against its SQL: as many rows, places without gaps, the same row at each."""
    duckdb = pytest.importorskip("duckdb")
    from larkspur.queries import ORACLE_SQL, QUERIES, SELECTS

    con = duckdb.connect()
    table = "events" if " flags" in SELECTS[name] else SELECTS[name].split(" FROM ")[1].split()[0]
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet{'/*.parquet' if Path(d, table + '.parquet').is_dir() else ''}')")
    want = con.execute(ORACLE_SQL[name])
    at = [x[0] for x in want.description].index("place")
    assert sorted((tuple(r) for r in QUERIES[name](spark, d).collect()), key=lambda r: r[at]) == sorted(want.fetchall(), key=lambda r: r[at])


@pytest.fixture
def merging(spark):
    """Sets the size (in KB) up to which Spark merges the partitions of a shuffle; 0 for none."""
    own = "spark.sql.adaptive.coalescePartitions."
    held = {k: spark.conf.get(k, None) for k in (f"{own}enabled", f"{own}parallelismFirst", f"{own}minPartitionSize", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}

    def go(kb):
        for k, v in zip(held, (str(kb > 0).lower(), "false", "1b", f"{kb or 64}k")):
            spark.conf.set(k, v)

    yield go
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Sizes at which the shuffle of the order columns alone is merged to fewer partitions than that of all columns, on sf0.01.
MERGED = {"order_int_asc": 200, "index_range_desc_topk": 200, "order_int_desc": 200, "order_nulls_last_asc": 60, "order_nulls_last_desc": 60, "topk_asc": 60,
          "order_text": 30, "order_unprojected": 10}


@pytest.mark.parametrize("name", MERGED)
def test_places_hold_however_partitions_merge(spark, merging, name):
    for kb in (MERGED[name], 0):
        merging(kb)
        check_places(spark, "/root/testdata/sf0.01", name)


def test_places_are_those_of_one_shuffle(spark, merging):
    """Bounds of ranges come from a sample, which differs from one shuffle to the next, whatever of the rows is read."""
    merging(0)
    n = 30_000
    df = spark.range(0, n, 1, 4).select("id", F.xxhash64("id").alias("h"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
    got = placed(df, [F.col("h").desc()], "place")
    want = {r["id"]: k for k, r in enumerate(sorted(df.select("id", "h").collect(), key=lambda r: -r["h"]), 1)}
    assert {r["id"]: r["place"] for r in got.select("id", "place").collect()} == want
    assert {r["id"]: r["place"] for r in got.where("length(wide) > 0").repartition(3).collect()} == want
    assert placed(df.limit(0), [F.col("h")], "place").collect() == []


def test_few_places_and_many_are_alike(spark, monkeypatch):
    df = spark.range(0, 900, 1, 3).select("id", F.when(F.col("id") % 5 != 0, F.xxhash64("id")).alias("h"))
    order = [F.col("h").desc_nulls_last(), F.col("id")]
    few = sorted(map(tuple, placed(df, order, "place", 800).collect()))
    monkeypatch.setattr(ranking, "FEW", 799)
    many = placed(df, order, "place", 800)
    assert few == sorted(map(tuple, many.collect())) and sorted(r[2] for r in few) == list(range(1, 801)) and many.dtypes == [("id", "bigint"), ("h", "bigint"), ("place", "bigint")]
    assert placed(df, order, "place", 0).collect() == []


def test_ties_go_by_key_wherever_files_hold_the_rows(spark, tmp_path):
    """Falling keys, in files whose names fall too."""
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    o.orderBy(F.col("o_orderkey").desc()).repartitionByRange(3, F.col("o_orderkey").desc()).write.parquet(f"{tmp_path}/orders.parquet")
    check_places(spark, str(tmp_path), "order_int_asc")
