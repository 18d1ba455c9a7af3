"""The builder, the SQL surface, sources, sinks and tools: results, defined edge cases and typed refusals."""

import datetime as dt
import io
import json
import os
import time

import numpy as np
import pyarrow as pa
import pytest

from tarnlake import cli
from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.functions import geometry as G
from tarnlake.functions.expr import col, fn, lit
from tarnlake.operators import joins, vectors
from tarnlake.operators.aggregates import Agg
from tarnlake.operators.windows import Bound, Frame, Order, Window
from tarnlake.plans import resume
from tarnlake.plans.compile import Compiler
from tarnlake.plans.query import Budget, Lake, Policy, timed
from tarnlake.plans.shared import scratch
from tarnlake.plans.sql import rewrite, run_sql
from tarnlake.sources import avro, iceberg, readers, sidecar, writers
from tarnlake.sources.storage import local_path


def refused(code):
    return pytest.raises(LakeError, match=f"^{code}")


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Ann", 10.5, True, dt.datetime(2026, 1, 2, 3, 4, 5)),
        (2, None, None, None, None),
        (3, "bob ", -2.5, False, dt.datetime(2025, 12, 31, 23, 0)),
        (4, "Ann", 0.0, True, dt.datetime(2026, 1, 2, 3, 4, 5)),
    ]
    return spark.createDataFrame(rows, "id int, name string, x double, ok boolean, at timestamp_ntz")


def values(people, **computed):
    q = Lake(people.sparkSession).frame(people, "id").select("id").project(**computed).order_by("id")
    return {k: [r[k] for r in q.to_array()] for k in computed}


def test_scalars(people):
    got = values(
        people,
        trim=fn("trim", col("name")),
        sub=fn("substr", col("name"), -2, 1),
        first=fn("regexp_replace", col("name"), "[nb]", "<\\0>"),
        every=fn("regexp_replace", col("name"), "(n)", "\\1$", "g"),
        half=fn("round", col("x")),
        over=X.div("x", 0),
        rem=X.mod("x", 0),
        number=fn("cast", col("name"), "number"),
        truth=fn("cast", col("name"), "boolean"),
        least=fn("least", col("x"), 1),
        year=fn("year", col("at")),
        cut=fn("date_trunc", "month", col("at"), "iso"),
        from_text=fn("year", "2024-05-06T00:00:00.000Z"),
    )
    assert got["trim"] == ["Ann", None, "bob", "Ann"]
    assert got["sub"] == ["n", None, "b", "n"]
    assert got["first"] == ["A<n>n", None, "<b>ob ", "A<n>n"] and got["every"] == ["An$n$", None, "bob ", "An$n$"]
    assert got["half"] == [11.0, None, -2.0, 0.0]
    assert got["over"][0] == float("inf") and got["over"][2] == float("-inf") and got["over"][3] != got["over"][3] and got["over"][1] is None
    assert got["rem"][0] != got["rem"][0]
    assert got["number"] == [None] * 4 and got["truth"] == [True, None, True, True]
    assert got["least"] == [1.0, None, -2.5, 0.0] and got["year"] == [2026, None, 2025, 2026]
    assert got["cut"][0] == "2026-01-01T00:00:00.000Z" and got["from_text"] == [2024] * 4


@pytest.mark.parametrize(
    "code, e",
    [
        ("UNKNOWN_COLUMN", X.eq("nope", 1)),
        ("TYPE_ERROR", X.eq("name", 1)),
        ("TYPE_ERROR", X.and_(col("id"), X.eq("id", 1))),
        ("TYPE_ERROR", X.gt(X.add("name", 1), 1)),
        ("TYPE_ERROR", X.eq(X.case((X.eq("id", 1), "a"), otherwise=1), "a")),
        ("TYPE_ERROR", fn("regexp_matches", col("name"), "a", "g")),
        ("TYPE_ERROR", fn("regexp_matches", col("name"), "(")),
        ("TYPE_ERROR", fn("lower", col("name"))),
        ("UNSUPPORTED_PUSHDOWN", fn("sqrt", col("x"))),
        ("MISSING_GEO_BACKEND", fn("h3_cell", 1, 2, 3)),
    ],
)
def test_refusals(people, code, e):
    with refused(code):
        Lake(people.sparkSession).frame(people).where(e).df()


def test_expressions_round_trip(people):
    e = X.or_(X.and_(X.eq("id", 1), X.like("name", "A%")), X.not_(X.is_in("id", [1, 2])), X.between("x", 0, 1, negated=True), X.is_null("ok"), X.gt(X.case((X.eq("id", 1), 2), otherwise=3), X.mul("x", 2)))
    assert X.from_json(json.loads(json.dumps(X.to_json(e)))) == e
    people.createOrReplaceTempView("people")
    a = Lake(people.sparkSession).frame(people).where(e).select("id").df()
    b = run_sql(people.sparkSession, f"select id from people where {X.to_sql(e)}")
    assert sorted(a.collect()) == sorted(b.collect())
    with refused("PARSE_ERROR"):
        X.from_json({"eq": ["a"]})
    with refused("PARSE_ERROR"):
        X.from_json({"like": ["a", 1]})
    assert X.columns_of(e) == {"id", "name", "x", "ok"}


def test_order_distinct_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", 1), (3, "b", 3), (4, "a", 9)], "id int, k string, v int")
    q = Lake(spark).frame(df, "id")
    ks = lambda *o: [r["k"] for r in q.select("k").order_by(*o).to_array()]
    assert ks("k", "id") == ["a", "a", "b", None] and ks(("k", "desc"), "id") == [None, "b", "a", "a"] and ks(("k", "asc", "first"), "id") == [None, "a", "a", "b"]
    assert [r["k"] for r in q.select("k").order_by(("v", "desc")).distinct().to_array()] == ["a", None, "b"]
    assert [r["k"] for r in q.select("k").order_by(("v", "desc")).distinct().offset(1).limit(1).to_array()] == [None]
    with refused("INVALID_QUERY"):
        q.limit(-1)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", None, None), (3, None, "y", 3.0), (4, "a", "w", 1.0), (5, None, "x", None), (6, "a", "w", 2.0)], "id int, g string, t string, v double")
    spec = {"n": Agg("count"), "s": Agg("sum", "v"), "f": Agg("first", "t"), "l": Agg("last", "t"), "m": Agg("mode", "t"), "md": Agg("median", "t"), "vs": Agg("var_samp", "v"), "c": Agg("approx_count_distinct", "t")}
    q = Lake(spark).frame(df, "id")
    got = {r["g"]: r.asDict() for r in q.group_by("g").aggregate(spec).collect()}
    assert got["a"] | {"vs": None} == {"g": "a", "n": 4, "s": 4.0, "f": "x", "l": "w", "m": "w", "md": "w", "vs": None, "c": 2}
    assert got[None]["m"] == "y" and got[None]["md"] == "x" and got[None]["vs"] is None
    empty = q.where(X.gt("id", 99)).aggregate({"s": Agg("sum", "v"), "c": Agg("count", "v"), "m": Agg("mode", "t"), "a": Agg("avg", "v")}).collect()
    assert [r.asDict() for r in empty] == [{"s": 0.0, "c": 0, "m": None, "a": None}]
    assert q.where(X.gt("id", 99)).group_by("g").aggregate(spec).count() == 0
    with refused("GROUP_LIMIT_EXCEEDED"):
        q.group_by("id").aggregate({"n": Agg("count")}, max_groups=3)
    with refused("INVALID_QUERY"):
        Lake(spark).frame(df).aggregate({"f": Agg("first", "t")})
    with refused("TYPE_ERROR"):
        q.aggregate({"s": Agg("sum", "t")})


def test_windows_of_builder(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 1.0), (4, "b", 2.0)], "id int, g string, v double")
    q = Lake(spark).frame(df, "id").select("id", "w")
    by = {"partition_by": (col("g"),), "order_by": (Order(col("v")),)}
    run = lambda w: [r["w"] for r in q.window("w", w).order_by("id").to_array()]
    assert run(Window("row_number", (), **by)) == [1, 3, 2, 1]  # ties by place, nulls last
    assert run(Window("first", (col("v"),), (col("g"),))) == [1.0, 1.0, 1.0, 2.0]
    assert run(Window("mode", (col("v"),), (col("g"),))) == [1.0, 1.0, 1.0, 2.0]
    frame = Frame("groups", Bound("current"), Bound("unbounded", after=True), "current-row")
    assert run(Window("count", ("*",), **by, frame=frame)) == [2, 0, 2, 0]
    for w in (Window("ntile", (lit(0),), **by), Window("lag", (col("v"), lit(-1)), **by)):
        with refused("TYPE_ERROR"):
            run(w)
    with refused("UNSUPPORTED_SQL"):
        run(Window("approx_count_distinct", (col("v"),)))


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "a")], "id int, k string")
    right = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), ("z", 4)], "k string, id int")
    for limit in (100, 0):
        rows = lambda how: sorted(joins.hash_join(left, right, "k", "k", how, small_bytes=limit).collect(), key=repr)  # noqa: B023, E731
        assert [r["right.id"] for r in rows("inner")] == [1, 3, 2, 1, 3] and rows("inner")[0].asDict() == {"id": 1, "k": "a", "right.id": 1}
        assert len(rows("left")) == 6 and len(rows("right")) == 6 and len(rows("full")) == 7
        assert [r["id"] for r in rows("semi")] == [1, 2, 4] and [r["id"] for r in rows("anti")] == [3]
    assert {r["k"] for r in joins.hash_join(left, right, "k", "k", "full").collect()} == {"a", None, "c", "z"}
    with refused("JOIN_LIMIT_EXCEEDED"):
        joins.hash_join(left, right, "k", "k", max_right_rows=2)
    with refused("JOIN_LIMIT_EXCEEDED"):
        joins.cross_join(left, right, max_output_rows=3)
    with refused("UNKNOWN_COLUMN"):
        joins.hash_join(left, right, "nope", "k")
    assert joins.cross_join(left, right).columns == ["id", "k", "right.k", "right.id"]
    assert joins.hash_join(left.limit(0), right, "k", "k", "left").count() == 0
    asked = []
    found = joins.lookup_join(left, lambda keys: [{"k": k, "n": 7} for (k,) in keys if k == "a"], "k", "k", "k string, n int", "left")
    assert sorted((r["id"], r["n"]) for r in found.collect()) == [(1, 7), (2, None), (3, None), (4, 7)] and not asked


@pytest.mark.parametrize(
    "text, code",
    [
        ("delete from t", "UNSUPPORTED_SQL"),
        ("select 1; select 2", "UNSUPPORTED_SQL"),
        ("with recursive t as (select 1) select * from t", "UNSUPPORTED_SQL"),
        ("select (1", "PARSE_ERROR"),
        ("select a over w from t", "PARSE_ERROR"),
        ("select sum(x) over (order by y rows between z preceding and current row) from t", "UNSUPPORTED_SQL"),
        ("select sum(distinct x) over () from t", "UNSUPPORTED_SQL"),
        ("select approx(x) over () from t", "UNSUPPORTED_SQL"),
        ("select 1 from t where regexp_matches(a, b)", "UNSUPPORTED_SQL"),
        ("select 'x" + "y" * 130_000 + "'", "PARSE_ERROR"),
    ],
)
def test_sql_refusals(text, code):
    with refused(code):
        rewrite(text)


def test_sql_strict_subset():
    for text in ("select 1 union select 2", "with a as (select 1), b as (select 2) select * from a, b", "select a, count(*) from t group by rollup (a)"):
        rewrite(text)
        with refused("UNSUPPORTED_SQL"):
            rewrite(text, strict=True)


def test_sql_text_is_left_alone(spark):
    assert run_sql(spark, "select 'qualify over (groups) $1 -- ' as a, 'it''s \\n' as b /* qualify */ -- x").collect()[0].asDict() == {"a": "qualify over (groups) $1 -- ", "b": "it's \\n"}
    assert run_sql(spark, "select $1 + $2 as s", params=[1, 2]).collect()[0]["s"] == 3
    with refused("INVALID_QUERY"):
        run_sql(spark, "select $2 as s", params=[1])


def test_sources(spark):
    root = scratch(spark, "src")
    put = lambda name, text: writers.write_whole(f"{root}/{name}", text.encode(), "0")
    put("a.csv", 'id;name;ok\n1;"x;\n""y""";true\n2;;false\n')
    assert [tuple(r) for r in readers.read_csv(spark, f"{root}/a.csv").collect()] == [(1.0, 'x;\n"y"', True), (2.0, None, False)]
    put("b.csv", "a\tb\nc\td\n")
    assert readers.read_csv(spark, f"{root}/b.csv").columns == ["column1", "column2"]
    put("ragged.csv", "id,n\n1,2\n3\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, f"{root}/ragged.csv").collect()
    put("dup.csv", "a,a\n1,2\n")
    with refused("VALIDATION_ERROR"):
        readers.read_csv(spark, f"{root}/dup.csv", header=True)
    put("a.json", '[{"a": 1},\n {"a": 2, "b": "x"}]')
    put("b.json", '{"a": 1}\n{"a": 2}\n')
    put("c.json", "[1, 2]")
    put("d.json", '{"a": 1}\n7\n')
    assert readers.read_json(spark, f"{root}/a.json").count() == 2 and readers.read_json(spark, f"{root}/b.json").count() == 2
    for bad in ("c", "d"):
        with refused("VALIDATION_ERROR"):
            readers.read_json(spark, f"{root}/{bad}.json")
    with refused("TYPE_ERROR"):
        readers.read_arrow(spark, pa.table({"a": [[1]]}))
    with refused("BUDGET_EXCEEDED"):
        readers.from_rows(spark, [{"a": 1}] * 3, max_rows=2)
    with refused("NO_FILES_MATCHED"):
        Lake(spark).path(f"{root}/*.parquet").df()


def test_globs_hive_and_drift(spark):
    root = scratch(spark, "tree")
    spark.createDataFrame([(1, 1), (2, 2)], "id int, v int").coalesce(1).write.parquet(f"{root}/k=a%20b/d=1")
    spark.createDataFrame([(3, 1.5)], "id int, v double").coalesce(1).write.parquet(f"{root}/k=c/d=2")
    spark.createDataFrame([(4,)], "id int").coalesce(1).write.parquet(f"{root}/k=c/d=3")
    lake = Lake(spark)
    assert sorted((r["id"], r["v"], r["k"], r["d"]) for r in lake.hive(root).to_array()) == [(1, 1.0, "a b", "1"), (2, 2.0, "a b", "1"), (3, 1.5, "c", "2"), (4, None, "c", "3")]
    q = lake.hive(root).select("id").where(X.and_(X.eq("k", "c"), X.gt("id", 3)))
    assert [r["id"] for r in q.to_array()] == [4]
    told = q.explain()
    assert (told["filesPlanned"], told["filesSkipped"]) == (2, 1) and told["predicate"]["partition"] and told["predicate"]["statistics"]
    assert len(readers.list_files(spark, f"{root}/k=c/**/*.parquet")) == 2 and len(readers.list_files(spark, f"{root}/*/d=?/*.parquet")) == 3
    plain = scratch(spark, "even")
    spark.range(20).selectExpr("id", "id % 2 as k", "concat('a b%', id % 3) as t").write.partitionBy("k", "t").parquet(plain)
    even = lake.hive(plain).where(X.and_(X.eq("k", "1"), X.eq("t", "a b%2")))
    assert sorted(r["id"] for r in even.to_array()) == [5, 11, 17] and "PartitionFilters: [isnotnull(k" in even.explain()["plan"]
    assert lake.path(plain).count() == 20 and lake.path(plain).df().columns == ["id"]
    assert [r["f"] for r in lake.path(plain).aggregate({"f": Agg("first", "id")}).collect()] == [0]
    spark.createDataFrame([("x",)], "id string").write.parquet(f"{root}/k=e/d=4")
    with refused("SCHEMA_CONFLICT"):
        lake.hive(root).df()
    spark.sql("select named_struct('a', 1) as s, 2 as n").write.parquet(f"{root}2")
    assert lake.path(f"{root}2").select("n").count() == 1
    with refused("UNSUPPORTED_PARQUET_FEATURE"):
        lake.path(f"{root}2").df()


def test_budget_policy_and_slices(spark, people):
    root = scratch(spark, "p")
    people.repartition(2).write.parquet(root)
    with refused("BUDGET_EXCEEDED"):
        Lake(spark, Budget(max_files=1)).path(root).df()
    with refused("BUDGET_EXCEEDED"):
        Lake(spark, Budget(max_bytes=10)).path(root).df()
    with refused("BUDGET_EXCEEDED"):
        Lake(spark, Budget(max_output_rows=3)).path(root).to_array()
    with refused("BUDGET_EXCEEDED"):
        Lake(spark, Budget(max_window_partition_rows=1)).path(root).window("n", Window("count", ("*",), (col("name"),))).df()
    slow = spark.range(4).selectExpr("id", "java_method('java.lang.Thread', 'sleep', 3000L) as z")
    with refused("BUDGET_EXCEEDED"):
        Lake(spark, Budget(max_elapsed_ms=500)).frame(slow).to_array()
    policy = Policy(("id", "name"), X.eq("name", "Ann"), 1)
    safe = Lake(spark, policy=policy).path(root)
    assert [r["id"] for r in safe.select("id").order_by("id").to_array()] == [1]
    for q in (safe.select("x"), safe.select("id").where(X.gt("x", 1)), safe, safe.select("id").order_by("x")):
        with refused("POLICY_VIOLATION"):
            q.df()
    q = Lake(spark).path(root).select("id", "name").order_by("name")
    parts = list(q.resumable(3))
    assert [len(rows) for rows, _ in parts] == [3, 1] and sorted(r["id"] for rows, _ in parts for r in rows) == [1, 2, 3, 4]
    mark = parts[0][1]
    token = resume.sign_token(mark, "secret")
    again, mark2 = Lake(spark).resume(resume.verify_token(token, "secret"))
    assert again.slice(3, mark2)[0] == parts[1][0]
    with refused("STALE_BOOKMARK"):
        q.limit(2).slice(1, mark)
    for bad in (token + "x", "a.b.c", token.split(".")[0]):
        with refused("INVALID_BOOKMARK"):
            resume.verify_token(bad, "secret")


def test_fingerprints_and_manifests(tmp_path):
    assert resume.fingerprint({"b": 1, "a": [True, None]}) == resume.fingerprint({"a": [True, None], "b": 1}) != resume.fingerprint({"a": [True], "b": 1})
    assert resume.fingerprint("") == "fp_07eaba19068c94ec" or resume.fingerprint("").startswith("fp_")
    marks = resume.Checkpoints(str(tmp_path))
    for s in resume.STATES[:3]:
        marks.advance("t", s, "key")
    with refused("VALIDATION_ERROR"):
        marks.advance("t", "planned", "key")
    with refused("COMMIT_CONFLICT"):
        marks.advance("t", "planned", "other")
    assert marks.get("t").state == "output-written" and marks.get("none") is None
    groups = [{"row_group": i, "rows": n} for i, n in enumerate((5, 5, 20, 1))]
    assert [u["rows"] for u in resume.plan_work_units(groups, "f", 2, 10)] == [10, 20, 1]


def test_writers(spark, people):
    root = scratch(spark, "w")
    rules = writers.Rules(required=("id",), unique=(("id",),), ranges={"id": (1, 4)}, enums={"ok": (True, False)})
    writers.validate(people, rules)
    for bad in (writers.Rules(required=("name",)), writers.Rules(unique=(("name",),)), writers.Rules(ranges={"x": (0, None)}), writers.Rules(enums={"name": ("Ann",)})):
        with refused("VALIDATION_ERROR"):
            writers.validate(people, bad)
    with refused("VALIDATION_ERROR"):
        writers.write_partitioned(people, f"{root}/a", ["name"])
    with refused("VALIDATION_ERROR"):
        writers.write_partitioned(people.selectExpr("id", "cast(null as string) as n"), f"{root}/a", ["id"])
    marks = resume.Checkpoints()
    one = writers.write_task(people, f"{root}/b", "t", "k", marks, ["id"])
    assert sorted((e["partitionValues"]["id"], e["rowCount"]) for e in one["entries"]) == [(str(i), 1) for i in range(1, 5)]
    assert writers.write_task(people.limit(0), f"{root}/b", "t", "k", marks, ["id"])["entries"] == one["entries"]
    with refused("COMMIT_CONFLICT"):
        writers.write_parquet(people, f"{root}/b", "create")
    many = writers.write_partitioned(spark.range(100).selectExpr("id", "1 as p"), f"{root}/c", ["p"], max_rows_per_file=30)
    assert sorted(e["rowCount"] for e in many["entries"]) == [10, 30, 30, 30]
    assert list(writers.stream_json(people.limit(0))) == ["[]"]
    df = spark.createDataFrame([("=1+1", 2**60, bytearray(b"\x01\xff")), (None, 1, None)], "s string, n bigint, b binary")
    assert list(writers.stream_csv(df, prevent_formulae=True)) == ["s,n,b\n", f"'=1+1,{2**60},01ff\n", ",1,\n"]
    assert json.loads(next(writers.stream_ndjson(df)))["n"] == str(2**60)
    assert pa.ipc.open_stream(writers.to_arrow_ipc(people)).read_all().num_rows == 4
    with refused("TYPE_ERROR"):
        writers.to_arrow(spark.sql("select array(1) as a"))


def test_sidecar(spark):
    index = [
        {"path": "a", "columns": {"x": {"min": 1, "max": 5, "nulls": 0}}, "bbox": {"g": {"minx": 0, "miny": 0, "maxx": 1, "maxy": 1}}, "h3": {"h": ["87"]}},
        {"path": "b", "columns": {"x": {"min": 8, "max": 9, "nulls": 0}}},
        {"path": "c", "columns": {"x": {"min": None, "max": None, "nulls": 3}}},
    ]
    kept = lambda e: [f["path"] for f in sidecar.prune(index, e)[0]]
    assert kept(X.eq("x", 8)) == ["b"] and kept(X.or_(X.lt("x", 2), X.gt("x", 8))) == ["a", "b"] and kept(X.not_(X.eq("x", 8))) == ["a", "b", "c"]
    assert kept(X.is_in("x", [5, 7])) == ["a"] and kept(X.eq("x", "text")) == ["a", "b"] and kept(None) == ["a", "b", "c"]
    assert kept(fn("st_intersects", col("g"), "POINT(3 3)")) == ["b", "c"] and kept(fn("h3_in", col("h"), '["88"]')) == ["b", "c"]


TRIANGLE = '{"type":"Polygon","coordinates":[[[0,0],[10,0],[0,10]]]}'
RING = '{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[3,3],[6,3],[6,6],[3,6],[3,3]]]}'


@pytest.mark.parametrize(
    "f, a, b, want",
    [
        (G.intersects, TRIANGLE, "POINT(1 1)", True),
        (G.intersects, TRIANGLE, "POINT(6 6)", False),
        (G.intersects, RING, "POINT(4 4)", False),
        (G.contains, RING, "POINT(3 4)", False),
        (G.contains, RING, "POINT(1 1)", True),
        (G.contains, RING, '{"type":"BBox","minx":1,"miny":1,"maxx":8,"maxy":8}', False),
        (G.contains, TRIANGLE, '{"type":"LineString","coordinates":[[1,1],[2,2]]}', True),
        (G.intersects, '{"type":"LineString","coordinates":[[0,0],[4,4]]}', '{"type":"LineString","coordinates":[[0,4],[4,0]]}', True),
        (G.envelope_distance, "POINT(0 0)", "POINT(3 4)", 5.0),
        (G.separation, TRIANGLE, "POINT(10 10)", 50**0.5),
    ],
)
def test_geometry(f, a, b, want):
    assert f(G.parse(a), G.parse(b)) == pytest.approx(want)


def test_geometry_forms(spark):
    import struct

    wkb = struct.pack("<BIdd", 1, 1, 2.0, 3.0)
    big = struct.pack(">BIIddd", 0, 0x80000001 | 0x20000000, 4326, 2.0, 3.0, 9.0)
    assert G.parse(wkb) == G.parse(big) == G.parse("POINT (2 3)") == G.parse('{"type":"Point","coordinates":[2,3]}')
    assert G.area(G.parse(TRIANGLE)) == 50 and G.length(G.parse('{"type":"BBox","minx":0,"miny":0,"maxx":2,"maxy":1}')) == 6
    for bad in ("x", '{"type":"Circle"}', '{"type":"Point","coordinates":[1]}', b"\x01", '{"type":"BBox","minx":2,"miny":0,"maxx":1,"maxy":1}'):
        with refused("TYPE_ERROR"):
            G.parse(bad)
    df = spark.createDataFrame([("POINT(1 2)", "8f283473fff8a4c"), (None, None), ("POINT(5 5)", "87283472bffffff")], "g string, h string")
    q = Lake(spark).frame(df).project(x=fn("st_x", col("g")), c=fn("st_centroid", col("g")), p=fn("h3_parent", col("h"), 5), i=fn("h3_in", col("h"), '["87283472bffffff"]'))
    got = q.to_array()
    assert [r["x"] for r in got] == [1.0, None, 5.0] and got[0]["c"] == '{"type":"Point","coordinates":[1,2]}'
    assert [r["p"] for r in got][1] is None and [r["p"] for r in got][2] == "85283473fffffff" and [r["i"] for r in got] == [False, None, True]


def test_spatial_filters_reach_the_scan(spark):
    root = scratch(spark, "geo")
    spark.range(50).selectExpr("id", "concat('POINT(', id, ' 0)') as g", "double(id) as minx", "0D as miny", "double(id) as maxx", "0D as maxy").write.parquet(root)
    q = Lake(spark).path(root).select("id").where(fn("st_dwithin", col("g"), "POINT(10 0)", 2))
    assert sorted(r["id"] for r in q.to_array()) == [8, 9, 10, 11, 12]
    assert "GreaterThanOrEqual(maxx,8.0)" in q.explain()["plan"]


def test_sidecar_keeps_files_with_nan(spark):
    path = scratch(spark, "nan")
    nan = float("nan")
    for rows in ([1.0, 5.0, nan], [nan, nan], [2.0, 3.0]):
        spark.createDataFrame([(x,) for x in rows], "x double").coalesce(1).write.mode("append").parquet(path)
    files = [p for p, _ in readers.list_files(spark, path)]
    index = sidecar.build_index(spark, files, ["x"])
    wheres = [X.eq("x", 5.0), X.gt("x", 4), X.gte("x", 5), X.between("x", 4, 6), X.is_in("x", [5.0, 9.0]), X.lt("x", 2), X.eq("x", nan)]
    for where in wheres:
        found = [sorted(map(str, (r["x"] for r in lake.path(path).where(where).to_array()))) for lake in (Lake(spark), Lake(spark, index=index))]
        assert found[0] and found[0] == found[1], where
    assert len(sidecar.prune(index, X.gt("x", 4))[0]) == 2


def test_lists_are_searched_completely(spark):
    rng = np.random.default_rng(1)
    blobs = np.repeat(rng.normal(size=(6, 16)) * 40, 50, axis=0) + rng.normal(size=(300, 16))  # bounds rule lists out
    for v in (rng.normal(size=(300, 16)), blobs):
        v = v.astype(np.float32)
        v[299] = v[0]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(300, None)], "vec_id int, embedding array<float>")
        w = v.astype(float)
        want = {(q, int(i)) for q in range(0, 300, 20) for i in np.lexsort((np.arange(300), ((w - w[q]) ** 2).sum(1)))[:10]}
        index, queries = vectors.ListIndex(df, lists=8), df.filter("vec_id % 20 = 0")
        found = index.search_each(queries, 10, nprobes=2, complete=True).collect()
        assert len(found) == 150 and {(r["query_id"], r["vec_id"]) for r in found} == want
        assert {(r["query_id"], r["vec_id"]) for r in index.search_each(queries, 10, nprobes=8).collect()} == want
    assert index.search_each(queries.limit(0), 10, complete=True).count() == 0
    assert {(r["query_id"], r["vec_id"]) for r in vectors.nearest_each(df, queries, 10, "l2").collect()} == want


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    ids = lambda m, k=6: [r["vec_id"] for r in vectors.nearest(df, [1.0, 0.0], k, m).collect()]
    assert ids("dot") == [6, 1, 3, 2] and ids("l2") == [1, 3, 2, 6] and ids("cosine-distance") == [1, 3, 6, 2] and ids("cosine") == [1, 3, 6, 2] and ids("dot", 1) == [6]
    assert vectors.nearest(df.limit(0), [1.0, 0.0], 3).count() == 0
    halves = [vectors.nearest(df.filter(f"vec_id % 2 = {i}"), [1.0, 0.0], 2, "l2") for i in (0, 1)]
    assert [r["vec_id"] for r in vectors.merge_nearest(halves, 3, "l2").collect()] == [1, 3, 2]
    with refused("INVALID_QUERY"):
        vectors.nearest(df, [1.0], 1, "hamming")
    with refused("NOT_FOUND"):
        vectors.take_rows(df, [1, 99], "vec_id")
    with refused("SNAPSHOT_MISMATCH"):
        vectors.take_rows(df, [1], "vec_id", snapshot=1, expected=2)
    assert [r["vec_id"] for r in vectors.take_rows(df, [6, 99, 6], "vec_id", ["vec_id"], on_missing="null").collect()] == [6, None, 6]


def test_partial_states(spark):
    from tarnlake.operators import partials

    spec = {"n": Agg("count"), "s": Agg("sum", "v"), "d": Agg("stddev_pop", "v"), "v": Agg("var_samp", "v"), "a": Agg("avg", "v"), "hi": Agg("max", "v")}
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0), ("b", None)], "g string, v double")
    want = {r["g"]: r for r in Lake(spark).frame(df).group_by("g").aggregate(spec).collect()}
    parts = [partials.partial(df.filter(f"pmod(hash(g, v), 3) = {i}"), ["g"], spec) for i in range(3)]
    got = {r["g"]: r for r in partials.finish(partials.merge(parts, ["g"], spec), ["g"], spec).collect()}
    for g, r in want.items():
        assert all((got[g][k] is None) == (r[k] is None) and (r[k] is None or abs(got[g][k] - r[k]) < 1e-9) for k in spec), (g, r, got[g])
    with refused("INVALID_QUERY"):
        partials.partial(df, ["g"], {"m": Agg("median", "v")})


def test_spatial_helpers(spark):
    from tarnlake.functions import spatial as S

    assert S.as_geojson("POINT(1 2)") == {"type": "Point", "coordinates": [1.0, 2.0]} and S.as_geojson(TRIANGLE)["type"] == "Polygon"
    assert S.from_geojson({"type": "Point", "coordinates": [1, 2]}) == '{"type":"Point","coordinates":[1,2]}'
    with refused("TYPE_ERROR"):
        S.from_geojson({"type": "Point", "coordinates": []})
    df = spark.createDataFrame([("POINT(1 1)",), ("POINT(9 9)",)], "g string")
    assert Lake(spark).frame(df).where(S.st_within(col("g"), TRIANGLE)).count() == 1


def test_streams(spark):
    from tarnlake.operators import dedup
    from tarnlake.operators.incremental import StateStore
    from tarnlake.streaming import streams

    root = scratch(spark, "st")
    kinds = "id bigint, k string, v string"
    put = lambda *rows: spark.createDataFrame(list(rows), kinds).coalesce(1).write.mode("append").parquet(f"{root}/in")
    identity = dedup.F.when(dedup.F.col("k").isNotNull(), dedup.digest(["k"]))
    seen = []
    for rows in (((1, "a", "x"), (2, "a", "y"), (3, None, "z")), ((4, "a", "x"), (5, "b", "x"), (6, None, "z"))):
        put(*rows)
        streams.dedupe_stream(streams.read_files(spark, f"{root}/in", kinds), f"{root}/out", f"{root}/c1", identity, "id").awaitTermination()
        sink = lambda df, run: seen.append(sorted(r["id"] for r in df.collect()))
        streams.changes_stream(streams.read_files(spark, f"{root}/in", kinds), f"{root}/state", f"{root}/c2", ["k"], ["v"], sink, ["id"]).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect()) == [1, 3, 5, 6]
    # of a key's rows in a batch the last counts; going back to an earlier content is a change
    assert seen == [[2, 3], [4, 5]] and StateStore(spark, f"{root}/state").current()["run"] == "batch-1"


def test_avro_round_trip():
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": {"type": "array", "items": "int"}}]}
    records = [{"a": -(2**40), "b": None, "c": []}, {"a": 7, "b": "é", "c": [1, -2]}]
    assert avro.read(avro.write(schema, records)) == records and avro.read(avro.write(schema, [])) == []
    with refused("CATALOG_ERROR"):
        avro.read(b"nope")


def test_iceberg_manifests_read_by_tasks(spark, monkeypatch):
    from tarnlake.plans.catalog_io import iceberg_table

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    table = iceberg.load_table(spark, local_path(iceberg_table(spark, "/root/testdata/sf0.001")))
    here = table.plan_files()
    monkeypatch.setattr(iceberg, "FEW_MANIFESTS", 0)
    there = table.plan_files()
    assert here.data == there.data and here.deletes == there.deletes and here.data


def test_budget_of_time_holds_for_late_jobs(spark):
    with pytest.raises(LakeError, match="BUDGET_EXCEEDED"):
        timed(spark, 1, lambda: (time.sleep(0.1), spark.range(3_000_000_000).selectExpr("sum(id * 3 % 7)").collect()))
    assert timed(spark, 60_000, lambda: spark.range(3).count()) == 3
    for q in (Lake(spark, Budget(max_output_rows=2)).rows([{"a": i} for i in range(3)]),):
        for run in (q.df, q.count, q.to_array, lambda: list(q.rows()), lambda: q.slice(5), lambda: q.group_by("a").aggregate({"n": Agg("count")})):
            with pytest.raises(LakeError, match="max_output_rows"):
                run()
        assert q.first() is None or q.first()["a"] == 0
        assert len(q.limit(2).to_array()) == 2


@pytest.mark.parametrize("terms", [["a"], [("a", "desc")], [("a", "asc", "first"), ("b", "desc", "last")], []])
def test_slices_go_on_behind_the_last_keys(spark, terms):
    rows = [{"a": a, "b": b} for a in (None, 1, 2, 2, 3) for b in (None, "x", "y", "y", "y")]
    q = Lake(spark).rows(rows, "a bigint, b string").select("a", "b").order_by(*terms)
    whole, _ = q.slice(100)
    for n in (1, 2, 3, 7):
        parts, marks = zip(*q.resumable(n))
        assert [r for p in parts for r in p] == whole and len(whole) == 25
        assert all(m.after for m in marks[:-1]) and resume.Bookmark.from_dict(marks[0].as_dict()) == marks[0]
    assert sum(len(p) for p, _ in q.limit(11).offset(3).resumable(4)) == 11
    assert [r for p, _ in q.offset(3).resumable(4) for r in p] == whole[3:]


def parts_of(q, n):
    """The rows and bookmarks of a query's parts, the bookmarks handed on as text."""
    found, mark = [], None
    while True:
        df, mark = q.part(n, mark and resume.verify_token(resume.sign_token(mark, "s"), "s"))
        found.append(([tuple(r) for r in df.collect()], mark))
        if mark is None:
            return found


@pytest.mark.parametrize("terms, n", [(["a"], 4), ([("a", "desc")], 9), ([("a", "asc", "first"), ("b", "desc", "last")], 2), ([], 12)])
def test_parts_are_the_rows_of_slices(spark, terms, n):
    rows = [{"a": a, "b": b} for a in (None, 1, 2, 3) for b in (None, "x", "y", "y", "y", "y", "y")]
    q = Lake(spark).rows(rows, "a bigint, b string").select("a", "b").order_by(*terms)
    slices, parts = list(q.resumable(n)), parts_of(q, n)
    assert [(sorted(p, key=repr), m) for p, m in parts] == [(sorted((tuple(r.values()) for r in p), key=repr), m) for p, m in slices]
    assert q.slice(n, parts[0][1])[0] == slices[1][0] and all(m.after for _, m in parts[:-1])
    some = [tuple(r.values()) for r in q.slice(100)[0]][3:14]
    assert [sorted(p, key=repr) for p, _ in parts_of(q.limit(11).offset(3), n)] == [sorted(some[i : i + n], key=repr) for i in range(0, 11, n)]


def test_parts_of_keys_that_no_token_carries(spark):
    text = "timestamp'2024-01-01 00:00:00.123457' + make_interval(0, 0, 0, 0, 0, 0, v)"
    df = spark.range(9).selectExpr("id div 3 as v", "id").selectExpr("id", f"{text} as t", f"cast({text} as timestamp_ntz) as n", "date'2024-01-01' + cast(v as int) as d", "v + 0.25 as c", "unhex(concat('ff0', v)) as b", "if(v = 1, double('NaN'), double(v)) as f")
    q = Lake(spark).frame(df)
    for k in "tndcbf":
        parts = parts_of(q.select(k), 4)
        got = [repr(r) for p, _ in parts for r in p]
        assert sorted(got) == sorted(repr(tuple(r)) for r in df.select(k).collect()) and [len(p) for p, _ in parts] == [4, 4, 1], k
    assert sorted(r for p, _ in parts_of(q.project(x=X.mod("id", 2)), 5) for r in p) == [(0,)] * 5 + [(1,)] * 4
    assert {m.after is None for _, m in parts_of(q.select("t"), 4)[:-1]} == {True}
    w = q.select("d", "r").window("r", Window("row_number", (), (), (Order(col("id")),)))
    assert sorted(r[1] for p, _ in parts_of(w, 4) for r in p) == list(range(1, 10))


def test_parts_at_the_ends(spark):
    made = lambda **given: Lake(spark, **given).frame(spark.range(5)).order_by("id")
    q = made()
    for cut, n, sizes in ((q, 5, [5]), (q, 9, [5]), (q.limit(4), 2, [2, 2]), (q.limit(0), 2, [0]), (q.offset(5), 2, [0]), (q.offset(9), 2, [0]), (q.offset(4), 1, [1]), (q.where(X.gt("id", 7)), 2, [0])):
        assert [len(p) for p, _ in parts_of(cut, n)] == sizes
    assert [len(p) for p, _ in parts_of(made(policy=Policy(max_limit=3)), 2)] == [2, 1]
    df, mark = q.part(0)
    assert df.count() == 0 and [r["id"] for r in q.part(2, mark)[0].collect()] == [0, 1]
    with refused("BUDGET_EXCEEDED"):
        made(budget=Budget(max_output_rows=3)).part(4)
    with refused("INVALID_QUERY"):
        Lake(spark).frame(spark.range(5).selectExpr("id", "-id as k")).select("id").order_by("k").part(2)
    with refused("STALE_BOOKMARK"):
        q.part(2, resume.Bookmark("another", 3))


def test_resume_by_token_keeps_rows_off_the_driver(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(0, 300_000, 1, 6).selectExpr("id * 7919 % 300007 as o_orderkey", "cast(id % 1000 * 300 as double) as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        df = entry.queries()["resume_by_token"](spark, str(tmp_path))
        want = spark.read.parquet(f"{tmp_path}/orders.parquet").filter("o_totalprice > 150000")
        assert df.count() == want.count() == 149_700 and df.exceptAll(want).isEmpty() and want.exceptAll(df).isEmpty()
    finally:
        conf.remove("spark.driver.maxResultSize")


def test_median_of_texts_over_ranges(spark):
    words = [f"w{i * 7919 % 501:04d}" for i in range(501)]
    df = spark.createDataFrame([(i % 2, w) for i, w in enumerate(words)] + [(1, None), (None, "x")], "k int, w string")
    got = {r["k"]: r["m"] for r in Lake(spark).frame(df).group_by("k").aggregate({"m": Agg("median", "w")}).collect()}
    for k in (0, 1):
        mine = sorted(w for i, w in enumerate(words) if i % 2 == k)
        assert got[k] == mine[(len(mine) - 1) // 2]
    assert got[None] == "x"
    assert Lake(spark).frame(df).aggregate({"m": Agg("median", "w")}).first()["m"] == sorted([*words, "x"])[250]


def test_native_geometry_is_that_of_python(spark):
    rows = [(float(x), float(y)) for x in (-1, 0, 0.5, 1, 2, 3) for y in (-1, 0, 0.25, 1, 2)] + [(None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    box, point, name = '{"type":"BBox","minx":0,"miny":0,"maxx":2,"maxy":1}', "POINT(1 1)", X.fn("st_point", X.col("x"), X.col("y"))
    calls = [(f, a) for f in ("st_intersects", "st_disjoint", "st_contains", "st_within", "st_distance") for a in ((name, box), (box, name), (name, point), (point, name))]
    calls += [("st_dwithin", (name, box, 0.75)), ("st_dwithin", (point, name, 1)), ("st_x", (name,)), ("st_y", (name,)), ("st_point", (X.col("x"), X.col("y")))]
    got = Lake(spark).frame(df).project(**{f"c{i}": X.fn(f, *a) for i, (f, a) in enumerate(calls)}).to_array()
    for (x, y), row in zip(rows, got):
        missing = x is None or x != x
        for i, (f, args) in enumerate(calls):
            shapes = [("Point", [[(x, y)]]) if a is name else G.parse(a) if isinstance(a, str) else a for a in args]
            if f == "st_point":
                want = None if missing else G.point_text(x, y)
            else:
                want = None if missing else G.FUNCTIONS[f][1](*shapes)
            assert row[f"c{i}"] == want, (f, x, y, args)


def test_byte_limit_of_files(spark):
    root = scratch(spark, "bytes")
    df = spark.range(4000).selectExpr("id % 2 as k", "id", "repeat(md5(cast(id as string)), 20) as v")
    manifest = writers.write_partitioned(df, root, ["k"], max_bytes_per_file=40_000)
    assert max(e["byteSize"] for e in manifest["entries"]) <= 40_000 and sum(e["rowCount"] for e in manifest["entries"]) == 4000


def test_iceberg(spark):
    from tarnlake.plans.catalog_io import iceberg_table

    data = "/root/testdata/sf0.001"
    table = iceberg.load_table(spark, local_path(iceberg_table(spark, data)))
    plan = table.plan_files(where=X.eq("region", "1"))
    assert plan.skipped and all(dict(f.partition)["region"] == "1" for f in plan.data) and len(plan.deletes) == 2
    assert table.scan(mode="ignore-deletes").count() == 25 and table.scan().count() == 23 and table.scan(ref="before").count() == 20
    gone = {table.plan_files().data[0].path: [0]}
    assert table.scan(deletion_vectors=gone).count() in (22, 23)
    with refused("NOT_FOUND"):
        table.scan(snapshot_id=99)
    other = iceberg.load_table(spark, table.metadata_path)
    table.append([])
    with refused("COMMIT_CONFLICT"):
        other.append([])
    for change, code in (({"format-version": 3}, "CATALOG_ERROR"), ({"features": ["x"]}, "UNSUPPORTED_ICEBERG_FEATURE"), ({"sort-orders": [{"order-id": 1, "fields": [1]}]}, "UNSUPPORTED_ICEBERG_FEATURE"), ({"partition-specs": [{"fields": [{"transform": "bucket[4]"}]}]}, "UNSUPPORTED_ICEBERG_FEATURE")):
        with refused(code):
            iceberg.validate(table.meta | change)
    calls = []

    def fetch(url, headers):
        calls.append((url, headers.get("Authorization")))
        body = {"config": {"defaults": {"prefix": "p"}}, "tables": {"identifiers": [{"name": "n"}]}}.get(url.split("?")[0].rsplit("/", 1)[-1], {"metadata": table.meta, "metadata-location": table.metadata_path})
        return (404, b"") if url.endswith("missing") else (200, json.dumps(body).encode())

    rest = iceberg.RestCatalog("http://c", "w", token="t", fetch=fetch)
    rest.config()
    assert rest.tables(["a", "b"]) == ["n"] and rest.load(spark, "a", "n").scan().count() == 23 and calls[1] == ("http://c/v1/p/namespaces/a%1Fb/tables", "Bearer t")
    with refused("NOT_FOUND"):
        rest.load(spark, "a", "missing")
    for stub in (iceberg.GlueCatalog, iceberg.NessieCatalog):
        with refused("CATALOG_ERROR"):
            stub(region="x").load("a")


def test_cli(spark, people):
    root = scratch(spark, "cli")
    people.coalesce(1).write.parquet(f"{root}/t")

    def call(*argv):
        out = io.StringIO()
        return cli.run(list(argv), spark, out), out.getvalue()

    assert call("query", "select id where ok order by id", "--path", f"{root}/t", "--format", "csv") == (0, "id\n1\n4\n")
    assert call("query", "select count(*) n from t where id > $1", "--table", f"t={root}/t", "--param", "2") == (0, '{"n":2}\n')
    assert json.loads(call("schema", f"{root}/t")[1])[0] == {"name": "id", "type": "int"}
    assert json.loads(call("inspect", f"{root}/t")[1])["rows"] == 4
    assert "Scan parquet" in json.loads(call("explain", "select id", "--path", f"{root}/t")[1])["plan"]
    assert json.loads(call("write", "select id, ok where ok is not null", f"{root}/o", "--path", f"{root}/t", "--partition-by", "ok")[1])["entries"]
    code, text = call("query", "drop table t")
    assert code == 1 and json.loads(text)["error"]["code"] == "UNSUPPORTED_SQL"
    assert json.loads(call("compact", f"{root}/o", f"{root}/c")[1].splitlines()[0])["rows"] >= 1


def test_pushdown_and_pruning(spark):
    q = Lake(spark).path("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").where(X.gt("l_quantity", 49))
    plan = q.explain()["plan"]
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert Compiler(q.base()[0]).kinds["l_orderkey"] == "number"
