"""What must hold at any size: bounded readers, joins without nested loops, places of sorted rows."""

import gzip
import itertools
import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from nestq import Session, workload
from nestq.sources import ion


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


# --- F1, F9: Ion files are parsed as they come ------------------------------------------------------------
@pytest.mark.parametrize("text", [b"{a:1,b:'x y'} ", b"{a:1,\n b:\"x y\"}\n", b"{a:1,b:\"x y\"}\n"])
def test_values_come_before_the_end(text):
    for texts in (False, True):
        found = ion.stream(_endless(text), json_texts=texts)
        assert [json.loads(v if texts else ion.to_json(v)) for v in itertools.islice(found, 3)] == [{"a": 1, "b": "x y"}] * 3


def _endless(text):
    yield from itertools.repeat(text + b"\n", 100_000)
    raise AssertionError("the end was read")


def ion_files(folder):
    """Five files of 400 values, each in another form; their numbers."""
    folder.mkdir()
    parts = [range(k * 400, k * 400 + 400) for k in range(5)]
    (folder / "lines.ion").write_text("".join(f'{{v:{i},t:"a\u00e9:{i}"}}\n' for i in parts[0]))
    (folder / "spread out.ion").write_text("".join(f"// {i}\n{{\n v: {i},\n t: '''a\n{{v:1}}\n''' '''b'''\n}}\n" for i in parts[1]))
    (folder / "lines.gz").write_bytes(gzip.compress("".join(f"{{v:{i},t:x}}\n" for i in parts[2]).encode()))
    (folder / "zstd.ion").write_bytes(zstandard.compress("".join(f"{{v:{i}}} " for i in parts[3]).encode()))
    table = b"\xe0\x01\x00\xea\xe7\x81\x83\xd4\x87\xb2\x81v"  # v is symbol 10
    (folder / "binary.ion").write_bytes(table + b"".join(b"\xd4\x8a\x22" + i.to_bytes(2, "big") for i in [*parts[4][1:], 0x0A0A]))
    return [*range(1600), *parts[4][1:], 0x0A0A]


def test_large_files_give_the_same_values(spark, tmp_path, monkeypatch):
    wanted = sorted(ion_files(tmp_path / "in"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for large in (100, 1 << 20):
            monkeypatch.setattr(ion, "LARGE", large)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1000" if large == 100 else before)
            s = Session(spark, mode="strict")
            read = s.sql(f"SELECT CAST(x.v.v AS BIGINT) AS v FROM scan_ion('{tmp_path}/in') AS x")
            assert sorted(r.v for r in read.collect()) == wanted
            typed = s.sql(f"SELECT x.t FROM read_ion('{tmp_path}/in') AS x WHERE x.v = 401 OR x.v = 7")
            assert sorted(r.t for r in typed.collect()) == ["a\n{v:1}\nb", "a\u00e9:7"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- F2: alternatives that each have an equality ----------------------------------------------------------
def test_alternatives_are_an_equi_join(spark):
    s = Session(spark)
    s.register("l", spark.createDataFrame([(1, 1), (2, 9), (3, None), (None, 5)], "a long, b long"))
    s.register("r", spark.createDataFrame([(1, 1), (1, 4), (9, 2), (5, None), (None, None)], "c long, d long"))
    on = "l.a = r.c OR (r.d = l.a AND r.c > 1) OR l.b = r.c"
    df = s.sql(f"SELECT l.a, l.b, r.c, r.d FROM l JOIN r ON {on}")
    assert "NestedLoop" not in plan_of(df)
    wanted = [(1, 1, 1, 1), (1, 1, 1, 4), (2, 9, 9, 2), (None, 5, 5, None)]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(wanted, key=str)


# --- F3: IN of a subquery among the results ---------------------------------------------------------------
def test_projected_in_collects_no_set(spark):
    s = Session(spark)
    s.register("l", spark.createDataFrame([(1,), (2,), (None,)], "a long"))
    s.register("r", spark.createDataFrame([(1,), (None,)], "b long"))
    df = s.sql("SELECT l.a, l.a IN (SELECT VALUE r.b FROM r AS r) AS x, l.a NOT IN (SELECT VALUE r.b FROM r AS r WHERE r.b > 0) AS y FROM l AS l")
    assert "collect_set" not in plan_of(df)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, True, False), (2, None, True), (None, None, None)], key=str)
    total = s.sql("SELECT SUM(CASE WHEN l.a IN (SELECT VALUE r.b FROM r AS r) THEN 1 ELSE 0 END) AS n FROM l AS l")
    assert [tuple(r) for r in total.collect()] == [(1,)]


# --- F4 to F7: places of sorted rows ----------------------------------------------------------------------
def test_places_are_of_the_rows_that_are_numbered(spark):
    drawn = F.udf(lambda _: random.random(), "double").asNondeterministic()
    df = spark.range(0, 4000, 1, 6).withColumn("x", drawn("id")).orderBy("x")
    found = sorted(workload.numbered(df).collect(), key=lambda r: r.x)
    assert [r.place for r in found] == list(range(1, 4001))


# --- F8: a job that was stopped is no empty table ---------------------------------------------------------
def test_stopped_table_function_is_an_error(spark):
    def full(session):
        raise MemoryError

    s = Session(spark).register_table_function("STOPPED", full)
    with pytest.raises(MemoryError):
        s.sql("SELECT * FROM STOPPED() AS t")


# --- F10: lateral left joins filter arrays, items are sorted by compiled code -----------------------------
def test_lateral_left_join_is_no_join(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, [5, None, 7]), (2, [1]), (3, []), (4, None), (1, [5, None, 7])], "k long, xs array<long>"))
    df = s.sql("SELECT t.k, x, p FROM t AS t LEFT JOIN t.xs AS x AT p ON x > 4 + t.k")
    assert "Join" not in plan_of(df)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 7, 2), (1, 7, 2), (2, None, None), (3, None, None), (4, None, None)], key=str)
    assert s.sql("SELECT t.k, x FROM t AS t LEFT JOIN t.xs AS x ON true").count() == 9


def test_items_are_sorted_without_a_lambda(spark):
    df = workload.session(spark, "/root/testdata/sf0.001").sql("SELECT o.items FROM nested_orders AS o")
    assert "lambda" not in plan_of(df)
