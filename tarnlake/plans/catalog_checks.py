"""Queries of what surrounds an operation: limits, refusals, resuming, manifests, text forms, and the rarer operations."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import cli
from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.functions import spatial
from tarnlake.functions.expr import col, fn, lit
from tarnlake.operators import vectors
from tarnlake.operators.aggregates import Agg
from tarnlake.operators.windows import Bound, Frame, Order, Window
from tarnlake.plans import resume
from tarnlake.plans.catalog import _points, built, frame, query, text
from tarnlake.plans.catalog_io import iceberg_table
from tarnlake.plans.engine import load_table
from tarnlake.plans.query import Budget, Lake
from tarnlake.plans.shared import scratch
from tarnlake.plans.sql import run_sql
from tarnlake.sources import iceberg, readers, writers
from tarnlake.sources.storage import local_path


def _codes(spark: SparkSession, attempts: dict[str, Callable[[], Any]]) -> DataFrame:
    """The error that each attempt ends in."""
    found = []
    for name, attempt in attempts.items():
        try:
            attempt()
            found.append((name, "none"))
        except LakeError as e:
            found.append((name, e.code))
    return spark.createDataFrame(found, "attempt string, code string")


def _values(pairs: dict[str, str]) -> str:
    return "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in pairs.items()) + ") t(attempt, code)"


# --- limits and refusals ------------------------------------------------------------------------------------------

_LIMITS = ["max_files", "max_bytes", "max_rows_decoded", "rows of df", "rows of array", "rows of count", "rows of batches", "rows of groups", "rows of a slice", "partition rows", "elapsed", "groups"]


@query(_values({k: "GROUP_LIMIT_EXCEEDED" if k == "groups" else "BUDGET_EXCEEDED" for k in _LIMITS} | {"within": "none"}))
def budgets(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/nation.parquet"
    lake = lambda **b: Lake(spark, Budget(**b)).path(path)
    slow = Lake(spark, Budget(max_elapsed_ms=1)).frame(spark.range(200_000_000).selectExpr("id % 1000003 as k"))
    few = dict(max_output_rows=3)
    attempts = [
        lambda: lake(max_files=0).df(),
        lambda: lake(max_bytes=10).df(),
        lambda: lake(max_rows_decoded=24).df(),
        lambda: lake(**few).df(),
        lambda: lake(**few).to_array(),
        lambda: lake(**few).count(),
        lambda: list(lake(**few).batches()),
        lambda: lake(**few).group_by("n_regionkey").aggregate({"n": Agg("count")}),
        lambda: lake(**few).slice(10),
        lambda: lake(max_window_partition_rows=2).window("r", Window("row_number", (), (col("n_regionkey"),))).df(),
        lambda: slow.distinct().count(),
        lambda: lake().group_by("n_nationkey").aggregate({"n": Agg("count")}, max_groups=3),
    ]
    wide = lambda: lake(max_files=9, max_bytes=10**9, max_rows_decoded=25, max_output_rows=25, max_elapsed_ms=10**6).to_array()
    return _codes(spark, dict(zip(_LIMITS, attempts)) | {"within": wide})


_REFUSED = {
    "struct column": "UNSUPPORTED_PARQUET_FEATURE",
    "approximate distinct count over a window": "UNSUPPORTED_SQL",
    "union in the strict subset": "UNSUPPORTED_SQL",
    "missing parameter": "INVALID_QUERY",
    "unknown column": "UNKNOWN_COLUMN",
    "unknown function": "UNSUPPORTED_PUSHDOWN",
    "glue": "CATALOG_ERROR",
    "nessie": "CATALOG_ERROR",
    "no metadata": "CATALOG_ERROR",
    "nulls in a required column": "VALIDATION_ERROR",
    "values out of range": "VALIDATION_ERROR",
    "values out of a list": "VALIDATION_ERROR",
    "values not unique": "VALIDATION_ERROR",
    "null partition": "VALIDATION_ERROR",
    "existing folder": "COMMIT_CONFLICT",
    "bookmark of another plan": "STALE_BOOKMARK",
    "token with another secret": "INVALID_BOOKMARK",
    "task going back": "VALIDATION_ERROR",
    "JSON of two operators": "PARSE_ERROR",
    "missing row": "NOT_FOUND",
    "array as sort key": "TYPE_ERROR",
}


@query(_values(_REFUSED))
def refusals(spark: SparkSession, d: str) -> DataFrame:
    orders, root = frame(spark, d, "orders").limit(50), scratch(spark, "refused")
    spark.sql("select named_struct('a', 1) as i, 1 as k").write.parquet(f"{root}/nested")
    orders.coalesce(1).write.parquet(f"{root}/orders")
    q = Lake(spark).path(f"{root}/orders")
    store = resume.Checkpoints()
    store.advance("t", "planned", "k")
    store.advance("t", "running", "k")
    token = resume.sign_token(resume.Bookmark("fp", 1), "one")
    rule = lambda **r: writers.validate(orders.withColumn("nothing", F.when(F.col("o_orderkey") > 5, 1)), writers.Rules(**r))
    attempts = [
        lambda: Lake(spark).path(f"{root}/nested").df(),
        lambda: q.window("w", Window("approx_count_distinct", ("o_custkey",))).df(),
        lambda: run_sql(spark, "select 1 as a union select 2", strict_subset=True),
        lambda: run_sql(spark, "select o_orderkey from orders where o_orderkey = $2", tables={"orders": orders}, params=[1]),
        lambda: q.select("nope").df(),
        lambda: q.project(x=fn("nope", col("o_orderkey"))).df(),
        lambda: iceberg.GlueCatalog().load(spark, "db", "t"),
        lambda: iceberg.NessieCatalog().load(spark, "db", "t"),
        lambda: iceberg.load_table(spark, local_path(f"{root}/orders")),
        lambda: rule(required=("nothing",)),
        lambda: rule(ranges={"o_totalprice": (None, 0)}),
        lambda: rule(enums={"o_orderstatus": ("X",)}),
        lambda: rule(unique=(("o_orderstatus",),)),
        lambda: writers.write_partitioned(orders.withColumn("p", F.when(F.col("o_orderkey") > 5, "x")), f"{root}/p", ["p"]),
        lambda: writers.write_parquet(orders, f"{root}/orders", "create"),
        lambda: q.slice(3, resume.Bookmark("another", 3)),
        lambda: resume.verify_token(token, "two"),
        lambda: store.advance("t", "planned", "k"),
        lambda: X.from_json({"eq": ["a", 1], "gt": ["b", 2]}),
        lambda: vectors.take_rows(orders, [-5], "o_orderkey"),
        lambda: Lake(spark).frame(orders.withColumn("a", F.array("o_orderkey"))).order_by("a").df(),
    ]
    return _codes(spark, dict(zip(_REFUSED, attempts)))


# --- resuming, manifests and text ---------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 150000")
def resume_by_token(spark: SparkSession, d: str) -> DataFrame:
    """Parts handed on as signed tokens that carry the query; each is opened by ``Lake.resume``."""
    lake = Lake(spark)
    q = lake.path(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").where(X.gt("o_totalprice", 150_000)).order_by("o_orderkey")
    third = 1 + q.count() // 3
    rows, mark = q.part(third)
    while mark is not None:
        again, bookmark = lake.resume(resume.verify_token(resume.sign_token(mark, "secret"), "secret"))
        more, mark = again.part(third, bookmark)
        rows = rows.unionByName(more)
    return rows


@query("select true as same_plan, false as other_plan, '{\"a\":1,\"b\":[2,null]}' as stable")
def plan_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    q = Lake(spark).path(f"{d}/orders.parquet").select("o_orderkey")
    same, other = q.where(X.gt("o_orderkey", 1)), q.where(X.gt("o_orderkey", 2))
    again = q.where({"gt": ["o_orderkey", 1]})
    return spark.createDataFrame([(same.fingerprint() == again.fingerprint(), same.fingerprint() == other.fingerprint(), resume.stable_json({"b": [2, None], "a": 1}))], "same_plan boolean, other_plan boolean, stable string")


@query("select o_orderstatus, count(*) as orders from orders group by 1")
def write_task_repeated(spark: SparkSession, d: str) -> DataFrame:
    """A task written twice under one key: the second time nothing is written, and the manifest is the same."""
    root, store = scratch(spark, "task"), resume.Checkpoints()
    df = frame(spark, d, "orders")
    first = writers.write_task(df, f"{root}/out", "t1", "key", store, ["o_orderstatus"])
    if writers.write_task(df.limit(0), f"{root}/out", "t1", "key", store, ["o_orderstatus"])["entries"] != first["entries"] or store.get("t1").state != "complete":
        raise LakeError("VALIDATION_ERROR", "the task was written again")
    entries = [(e["partitionValues"]["o_orderstatus"], e["rowCount"]) for e in first["entries"]]
    return spark.createDataFrame(entries, "o_orderstatus string, n bigint").groupBy("o_orderstatus").agg(F.sum("n").alias("orders"))


@query("select p_partkey, p_name, p_size from part where p_size > 20")
def write_and_read_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "written")
    writers.write_parquet(frame(spark, d, "part").filter("p_size > 20").select("p_partkey", "p_name", "p_size"), path)
    return readers.read_parquet(spark, path)


@query("select count(*) as n, true as in_order, true as bounded from lineitem")
def work_units(spark: SparkSession, d: str) -> DataFrame:
    """Row groups as tasks: all rows, in order, and no unit of more than two groups."""
    path = scratch(spark, "groups")
    frame(spark, d, "lineitem").coalesce(1).write.option("parquet.block.size", 1 << 18).parquet(path)
    file = readers.list_files(spark, path)[0][0]
    units = resume.plan_work_units(readers.row_groups(file), file, max_row_groups=2)
    ranges = [u["rowGroupRanges"][0] for u in units]
    ordered = all(a["end"] == b["start"] for a, b in zip(ranges, ranges[1:]))
    manifest = resume.task_manifest("job", "fp", "s1", units)
    rows = sum(t["rows"] for t in manifest["tasks"])
    return spark.createDataFrame([(rows, ordered, all(r["end"] - r["start"] <= 2 for r in ranges))], "n bigint, in_order boolean, bounded boolean")


@query("""select * from (values ('"9007199254740993"', '"1.50"', '"2024-01-02T03:04:05.000Z"', 'null', 'plain', '"a,""b"', '''=1+1', '-3')) t(big, exact, moment, nan, plain, quoted, formula, number)""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """How values that JSON or CSV can't hold as they are come out."""
    import datetime
    from decimal import Decimal

    safe = [json.dumps(writers.json_safe(v)) for v in (2**53 + 1, Decimal("1.50"), datetime.datetime(2024, 1, 2, 3, 4, 5), float("nan"))]
    cells = [writers.csv_cell("plain"), writers.csv_cell('a,"b'), writers.csv_cell("=1+1", True), writers.csv_cell(-3, True)]
    return spark.createDataFrame([(*safe, *cells)], "big string, exact string, moment string, nan string, plain string, quoted string, formula string, number string")


@query("select n_nationkey, n_name from nation where n_regionkey = 3")
def cli_query(spark: SparkSession, d: str) -> DataFrame:
    out = io.StringIO()
    cli.run(["query", "select n_nationkey, n_name from nation where n_regionkey = 3", "--table", f"nation={d}/nation.parquet", "--format", "ndjson"], spark, out)
    rows = [json.loads(line) for line in out.getvalue().splitlines()]
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey bigint, n_name string")


@query("select count(*) as n, 3 as columns from region")
def describe_table(spark: SparkSession, d: str) -> DataFrame:
    wide = frame(spark, d, "region").select("r_regionkey", "r_name", F.lit(1).alias("one"))
    return run_sql(spark, "DESCRIBE region", tables={"region": wide}).select(F.col("rows").alias("n"), F.size("columns").alias("columns"))


@query("select 2::bigint as planned, 3::bigint as skipped, count(*) as n from nation where n_regionkey in (1, 2) and n_nationkey > 3")
def explain_analyze(spark: SparkSession, d: str) -> DataFrame:
    """Files planned and skipped by partition, and the rows that came."""
    path = scratch(spark, "explained")
    frame(spark, d, "nation").withColumn("part", F.when(F.col("n_regionkey").isin(1, 2), "a").otherwise("b")).repartition(1).write.partitionBy("part", "n_regionkey").parquet(path)
    found = Lake(spark).hive(path).where(X.and_(X.eq("part", "a"), X.gt("n_nationkey", 3))).analyze()
    return spark.createDataFrame([(found["filesPlanned"], found["filesSkipped"], found["rows"])], "planned bigint, skipped bigint, n bigint")


@query("select c_custkey, c_acctbal from customer")
def column_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = [(r["c_custkey"], r["c_acctbal"]) for batch in Lake(spark).path(f"{d}/customer.parquet").select("c_custkey", "c_acctbal").batches(100) for r in batch]
    return spark.createDataFrame(rows, "c_custkey bigint, c_acctbal double")


@query("select n_nationkey, n_name from nation where n_regionkey = 4")
def engine_batches_and_files(spark: SparkSession, d: str) -> DataFrame:
    opened = load_table(spark, f"{d}/nation.parquet")
    if [f["path"].rsplit("/", 1)[1] for f in opened.plan_files()] != ["nation.parquet"]:
        raise LakeError("VALIDATION_ERROR", "the plan doesn't name the file")
    rows = list(opened.scan_rows(select=["n_nationkey", "n_name"], where=X.eq("n_regionkey", 4)))
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey bigint, n_name string")


# --- tables of snapshots ------------------------------------------------------------------------------------------


@query("select n_regionkey, count(*) as n from nation where n_name <> 'NATION_7' and n_regionkey > 0 group by 1")
def sql_iceberg_table(spark: SparkSession, d: str) -> DataFrame:
    source = {"metadataPath": local_path(iceberg_table(spark, d)), "where": X.gt("region", "0")}
    return run_sql(spark, "select cast(region as bigint) as n_regionkey, count(*) as n from lake group by 1", tables={"lake": source})


@query("select n_nationkey from nation where n_nationkey < 20")
def iceberg_tag(spark: SparkSession, d: str) -> DataFrame:
    return iceberg.load_table(spark, local_path(iceberg_table(spark, d))).scan(["n_nationkey"], ref="before")


@query("select n_nationkey from nation where n_name <> 'NATION_7' and n_regionkey = 2")
def iceberg_rest_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A table that a catalog hands out over HTTP, which is answered here."""
    root = local_path(iceberg_table(spark, d))
    with open(f"{root}/metadata/v2.metadata.json") as f:
        meta = json.load(f)
    answers = {"config": {"overrides": {"prefix": "p"}}, "p/namespaces/db/tables": {"identifiers": [{"name": "nation"}]}, "p/namespaces/db/tables/nation": {"metadata": meta, "metadata-location": f"{root}/metadata/v2.metadata.json"}}
    catalog = iceberg.RestCatalog("http://catalog", fetch=lambda url, headers: (200, json.dumps(answers[url.split("/v1/")[1]]).encode()))
    catalog.config()
    return catalog.load(spark, "db", catalog.tables("db")[0]).scan(["n_nationkey"], X.eq("region", "2"))


# --- expressions, geometry, cells ---------------------------------------------------------------------------------

_PREDICATES = {
    "and": [
        {"or": [{"lt": ["p_size", 10]}, {"gte": ["p_size", 30]}, {"eq": ["p_size", 20]}]},
        {"not": {"between": ["p_retailprice", 1000, 1100]}},
        {"in": ["p_size", [1, 2, 3, 5, 8, 20, 31, 33, 40, 45, 50]]},
        {"notIn": ["p_brand", ["Brand#11", "Brand#21"]]},
        {"like": ["p_name", "%a%"]},
        {"not": {"ilike": ["p_type", "%XYZ%"]}},
        {"isNotNull": "p_name"},
        {"not": {"isNull": "p_type"}},
        {"ne": ["p_partkey", 5]},
        {"lte": ["p_partkey", 1000000]},
        {"gt": ["p_partkey", 1]},
    ]
}
built(
    "json_predicates",
    "part",
    """select p_partkey from part where (p_size < 10 or p_size >= 30 or p_size = 20) and not p_retailprice between 1000 and 1100
  and p_size in (1, 2, 3, 5, 8, 20, 31, 33, 40, 45, 50) and p_brand not in ('Brand#11', 'Brand#21') and p_name like '%a%' and not p_type ilike '%XYZ%'
  and p_name is not null and p_type is not null and p_partkey <> 5 and p_partkey <= 1000000 and p_partkey > 1""",
    lambda q: q.select("p_partkey").where(_PREDICATES),
)

_POINT = fn("st_point", col("x"), col("y"))
_X, _Y = "(c_custkey % 37)", "((c_custkey * 7) % 41)"
_BOX = '{"type":"BBox","minx":5,"miny":10,"maxx":12,"maxy":30}'


@query(f"select c_custkey, {_X}::double as x, {_Y}::double as y from customer")
def geo_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("c_custkey").project(x=fn("st_x", _POINT), y=fn("st_y", _POINT)).df()


@query(f"select c_custkey, not ({_X} between 5 and 12 and {_Y} between 10 and 30) as apart, {_X} > 5 and {_X} < 12 and {_Y} > 10 and {_Y} < 30 as inside from customer")
def geo_disjoint_within(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("c_custkey").project(apart=fn("st_disjoint", _POINT, _BOX), inside=fn("st_within", _POINT, _BOX)).df()


@query("select n_nationkey, (n_nationkey + 1) / 2.0::double as x, 1::double as y, (2 * (n_nationkey + 1))::double as area from nation")
def geo_centroid_envelope(spark: SparkSession, d: str) -> DataFrame:
    box = fn("st_bbox", 0, 0, X.add("n_nationkey", 1), 2)
    return Lake(spark).path(f"{d}/nation.parquet").select("n_nationkey").project(x=fn("st_x", fn("st_centroid", box)), y=fn("st_y", fn("st_centroid", box)), area=fn("st_area", fn("st_envelope", box))).df()


@query(f"select c_custkey, {_X}::double as x, {_X} between 0 and 20 and {_Y} between 0 and 10 as inside from customer")
def geo_wkb(spark: SparkSession, d: str) -> DataFrame:
    """Points that Python packed as WKB, and a polygon in WKB."""
    ring = [(0, 0), (20, 0), (20, 10), (0, 10), (0, 0)]
    area = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<dd", *p) for p in ring)

    def pack(batches):
        for pdf in batches:
            yield pdf.assign(g=[struct.pack(">BIdd", 0, 1, x, y) for x, y in zip(pdf["x"], pdf["y"])], area=area)[["c_custkey", "g", "area"]]

    df = _points(spark, d).df().mapInPandas(pack, "c_custkey bigint, g binary, area binary")
    return Lake(spark).frame(df).select("c_custkey").project(x=fn("st_x", col("g")), inside=fn("st_intersects", col("area"), col("g"))).df()


@query(f"select c_custkey, sqrt(power(greatest(5 - {_X}, {_X} - 12, 0), 2) + power(greatest(10 - {_Y}, {_Y} - 30, 0), 2)) as away from customer where sqrt(power(greatest(5 - {_X}, {_X} - 12, 0), 2) + power(greatest(10 - {_Y}, {_Y} - 30, 0), 2)) <= 4")
def geo_box_distance(spark: SparkSession, d: str) -> DataFrame:
    q = _points(spark, d).select("c_custkey").project(away=spatial.st_distance(_POINT, _BOX))
    return q.where(spatial.st_dwithin(_POINT, _BOX, 4)).df()


@query("select * from (values (1, '8828308281fffff', true), (2, '85283083fffffff', true), (3, null, false)) t(k, parent, listed)")
def h3_cells(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(1, "8928308280fffff", 8), (2, "8928308280fffff", 5), (3, "85283083fffffff", 9)], "k int, cell string, res int")
    cells = json.dumps(["8928308280fffff"])
    return Lake(spark).frame(df).select("k").project(parent=fn("h3_parent", col("cell"), col("res")), listed=fn("h3_in", col("cell"), lit(cells))).df()


# --- aggregates, windows, subqueries ------------------------------------------------------------------------------

_FRAME = Frame("rows", Bound("preceding", "3"), Bound("following", "1"))
_OVER = ((col("o_custkey"),), (Order(col("o_orderkey")),), _FRAME)
built(
    "win_spread_frames",
    "orders",
    """select o_orderkey, round(var_samp(o_totalprice) over w / 1e6) as v, round(stddev_pop(o_totalprice) over w) as s, first(o_totalprice) over w as f, last(o_totalprice) over w as l, median(o_totalprice) over w as m
  from orders window w as (partition by o_custkey order by o_orderkey rows between 3 preceding and 1 following)""",
    lambda q: q.select("o_orderkey", "v0", "s0", "f", "l", "m")
    .window("v0", Window("var_samp", ("o_totalprice",), *_OVER))
    .window("s0", Window("stddev_pop", ("o_totalprice",), *_OVER))
    .window("f", Window("first", ("o_totalprice",), *_OVER))
    .window("l", Window("last", ("o_totalprice",), *_OVER))
    .window("m", Window("median", ("o_totalprice",), *_OVER))
    .df()
    .select("o_orderkey", F.round(F.col("v0") / 1e6).alias("v"), F.round("s0").alias("s"), "f", "l", "m"),
)
text(
    "agg_over_subqueries",
    "select o_orderpriority, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as cents from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0) and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49) group by o_orderpriority",
)
text("sql_empty_cte", "with none as (select n_nationkey from nation where n_nationkey < 0) select n_nationkey, n_name from nation where n_nationkey in (select n_nationkey from none)")
text("sql_empty_cte_aggregate", "with none as (select n_nationkey from nation where n_nationkey < 0) select count(*) as n, max(n_nationkey) as most from none")


@query("select o_orderpriority, count(*) as n from orders group by 1 having count(*) > 1")
def agg_within_max_groups(spark: SparkSession, d: str) -> DataFrame:
    return Lake(spark).path(f"{d}/orders.parquet").group_by("o_orderpriority").aggregate({"n": Agg("count")}, having=X.gt("n", 1), max_groups=1000)


@query("select distinct n from (select o_custkey, count(*) as n from orders group by 1)")
def agg_distinct_after(spark: SparkSession, d: str) -> DataFrame:
    return Lake(spark).path(f"{d}/orders.parquet").group_by("o_custkey").aggregate({"n": Agg("count")}, select=["n"], distinct=True)


@query("select 'more than one row' as problem")
def sql_scalar_of_many(spark: SparkSession, d: str) -> DataFrame:
    """A scalar subquery of several rows is an error of the run."""
    df = run_sql(spark, "select (select n_name from nation) as x from region", tables={t: f"{d}/{t}.parquet" for t in ("nation", "region")})
    try:
        df.collect()
    except Exception as e:
        return spark.createDataFrame([("more than one row" if "SCALAR_SUBQUERY_TOO_MANY_ROWS" in str(e) or "more than one row" in str(e) else str(e)[:80],)], "problem string")
    return spark.createDataFrame([("none",)], "problem string")


# --- vectors ------------------------------------------------------------------------------------------------------

_Q = "(select embedding from embeddings where vec_id = 7)"


@query(f"select vec_id, round(power(list_distance(embedding::double[], {_Q}::double[]), 2), 3) as score from embeddings order by list_distance(embedding::double[], {_Q}::double[]), vec_id limit 10")
def vec_merged_lists(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of two halves of the table, merged."""
    df = frame(spark, d, "embeddings")
    asked = df.filter("vec_id = 7").first()["embedding"]
    halves = [vectors.nearest(df.filter(F.pmod(F.xxhash64("vec_id"), F.lit(2)) == h), asked, 10, "l2") for h in (0, 1)]
    return vectors.merge_nearest(halves, 10, "l2").withColumn("score", F.round("score", 3))


@query(f"select vec_id, round(1 - list_inner_product(embedding::double[], {_Q}::double[]), 3) as score from embeddings order by list_inner_product(embedding::double[], {_Q}::double[]) desc, vec_id limit 10")
def vec_one_minus_dot(spark: SparkSession, d: str) -> DataFrame:
    df = frame(spark, d, "embeddings")
    return vectors.nearest(df, df.filter("vec_id = 7").first()["embedding"], 10, "one-minus-dot").withColumn("score", F.round("score", 3))
