"""Every query of the catalog against DuckDB, and seeded random windows over a table with ties and nulls."""

import math
import os
import random

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tarnlake.plans.sql import run_sql  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "as_tuple"):
        return float(v)
    return str(v) if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("p4_", "p6_", "p7_", "p8_"))}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = df.collect()
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, found) == rows(names, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


SEED = 20_311


@pytest.mark.parametrize("case", range(24))
def test_random_windows(spark, duck, case):
    rng = random.Random(SEED + case)
    matrix = "(select event_id as id, event_type as account, user_id % 7 as bucket, case when event_id % 5 = 0 then null else round(value, 1) end as amount, ts from events where event_id <= 400)"
    mode = rng.choice(["rows", "range", "groups"])
    order = "ts, id" if mode == "rows" else "bucket"
    bound = lambda: rng.choice([None, "0", str(rng.randint(1, 3))])
    a, b = bound(), bound()
    start = "unbounded preceding" if a is None else "current row" if a == "0" else f"{a} preceding"
    end = "unbounded following" if b is None else "current row" if b == "0" else f"{b} following"
    exclude = rng.choice(["", "", "exclude current row", "exclude group", "exclude ties"])
    if mode == "range" and (a not in (None, "0") or b not in (None, "0")):
        order = "bucket"
    call = rng.choice(["sum(amount)", "count(amount)", "avg(amount)", "min(amount)", "max(amount)", "count(*)", "median(amount)", "quantile_cont(amount, 0.3)"] + ["count(distinct account)"] * (not exclude) + ["sum(amount) filter (where bucket > 2)"])
    part = rng.choice(["partition by account ", ""])
    direction = rng.choice(["", " desc"]) if "," not in order else ""
    sql = f"select id, round({call} over ({part}order by {order}{direction} {mode} between {start} and {end} {exclude}), 8) as w from {matrix} m"
    cur = duck.execute(sql)
    want = rows(["id", "w"], cur.fetchall())
    got = run_sql(spark, sql, tables={"events": f"{DATA}/events.parquet"})
    assert rows(got.columns, got.collect()) == want, (SEED + case, sql)
