"""A query for each operation of the engine over the test tables, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import expr as X
from tarnlake.functions.expr import col, fn, lit
from tarnlake.operators import joins, vectors
from tarnlake.operators.aggregates import Agg
from tarnlake.operators.windows import Bound, Frame, Order, Window
from tarnlake.plans.query import Lake, Policy, Query
from tarnlake.plans.sql import run_sql

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Run, str | None]] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        _QUERIES[name or run.__name__] = (run, sql)
        return run

    return add


def built(name: str, table: str, sql: str, make: Callable[[Query], Query | DataFrame]) -> None:
    """A query of the builder over one table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = make(Lake(spark).path(f"{d}/{table}.parquet"))
        return out.df() if isinstance(out, Query) else out

    _QUERIES[name] = (run, sql)


def text(name: str, sql: str, oracle: str | None = None, **options) -> None:
    """A query of the SQL surface; the same text is the comparison unless another is given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        used = {t: f"{d}/{t}.parquet" for t in TABLES if t in sql}
        return run_sql(spark, sql.replace("{d}", d), tables=used, **{k: v.replace("{d}", d) if isinstance(v, str) else v for k, v in options.items()})

    _QUERIES[name] = (run, oracle or sql)


def frame(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- projection and filter ----------------------------------------------------------------------------------------

built("scan_projection", "lineitem", "select l_orderkey, l_linenumber, l_quantity from lineitem", lambda q: q.select("l_orderkey", "l_linenumber", "l_quantity"))
built(
    "filter_compare",
    "lineitem",
    "select l_orderkey, l_linenumber from lineitem where l_quantity > 45 and l_discount <= 0.02 and l_returnflag <> 'N' and l_shipdate >= timestamp '1995-01-01'",
    lambda q: q.select("l_orderkey", "l_linenumber").where(X.and_(X.gt("l_quantity", 45), X.lte("l_discount", 0.02), X.ne("l_returnflag", "N"), X.gte("l_shipdate", "1995-01-01T00:00:00"))),
)
built(
    "filter_in_notin",
    "orders",
    "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('1-URGENT', '5-LOW')",
    lambda q: q.select("o_orderkey").where(X.and_(X.is_in("o_orderstatus", ["F", "P"]), X.not_in("o_orderpriority", ["1-URGENT", "5-LOW"]))),
)
built(
    "filter_between",
    "part",
    "select p_partkey from part where p_size between 10 and 20 and p_retailprice not between 950 and 1200",
    lambda q: q.select("p_partkey").where(X.and_(X.between("p_size", 10, 20), X.between("p_retailprice", 950, 1200, negated=True))),
)
built(
    "filter_like_ilike",
    "part",
    "select p_partkey, p_name from part where p_name like '%1_' or p_type ilike '%std%' or p_type like 'a\\b%'",
    lambda q: q.select("p_partkey", "p_name").where(X.or_(X.like("p_name", "%1_"), X.ilike("p_type", "%std%"), X.like("p_type", "a\\b%"))),
)
built(
    "null_checks",
    "orders",
    "select o_orderkey, nullif(o_orderstatus, 'O') is null as was_open from orders where nullif(o_orderpriority, '5-LOW') is not null",
    lambda q: q.select("o_orderkey").project(was_open=X.is_null(fn("nullif", col("o_orderstatus"), "O"))).where(X.is_not_null(fn("nullif", col("o_orderpriority"), "5-LOW"))),
)
_MAYBE = X.Compare("gt", fn("nullif", col("o_totalprice"), 0), lit(100000))
built(
    "and_or_not_3vl",
    "orders",
    """select o_orderkey, (nullif(o_orderstatus, 'O') = 'F') and (o_totalprice > 100000) as a, (nullif(o_orderstatus, 'O') = 'F') or (o_totalprice > 100000) as b,
    not (nullif(o_orderstatus, 'O') = 'F') as c, nullif(o_orderstatus, 'O') in ('F', null) as d, o_orderstatus not in ('F', null) as e from orders""",
    lambda q: q.select("o_orderkey").project(
        a=X.and_(X.eq(fn("nullif", col("o_orderstatus"), "O"), "F"), X.gt("o_totalprice", 100000)),
        b=X.or_(X.eq(fn("nullif", col("o_orderstatus"), "O"), "F"), X.gt("o_totalprice", 100000)),
        c=X.not_(X.eq(fn("nullif", col("o_orderstatus"), "O"), "F")),
        d=X.is_in(fn("nullif", col("o_orderstatus"), "O"), ["F", None]),
        e=X.not_in("o_orderstatus", ["F", None]),
    ),
)
built(
    "case_searched",
    "part",
    "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size_class, case when p_size > 45 then 'top' end as top from part",
    lambda q: q.select("p_partkey").project(size_class=X.case((X.lt("p_size", 10), "small"), (X.lt("p_size", 30), "medium"), otherwise="large"), top=X.case((X.gt("p_size", 45), "top"))),
)
built(
    "case_simple",
    "orders",
    "select o_orderkey, case o_orderstatus when 'F' then 1.0 when 'O' then 2.0 else 0.0 end::double as code from orders",
    lambda q: q.select("o_orderkey").project(code=X.simple_case("o_orderstatus", ("F", 1.0), ("O", 2.0), otherwise=0.0)),
)
built(
    "arith_all",
    "lineitem",
    """select l_orderkey, l_linenumber, l_quantity + l_tax as a, l_extendedprice - l_quantity as b, l_extendedprice * l_discount as c, l_extendedprice / l_quantity as d,
    l_orderkey::double % 7 as e, 0 - l_quantity as f from lineitem""",
    lambda q: q.select("l_orderkey", "l_linenumber").project(
        a=X.add("l_quantity", col("l_tax")),
        b=X.sub("l_extendedprice", col("l_quantity")),
        c=X.mul("l_extendedprice", col("l_discount")),
        d=X.div("l_extendedprice", col("l_quantity")),
        e=X.mod("l_orderkey", 7),
        f=X.neg("l_quantity"),
    ),
)
built(
    "arith_by_zero",
    "nation",
    "select n_nationkey, case when n_regionkey = 0 then 'Infinity'::double else n_nationkey / n_regionkey end as q from nation where n_nationkey > 0",
    lambda q: q.select("n_nationkey").project(q=X.div("n_nationkey", col("n_regionkey"))).where(X.gt("n_nationkey", 0)),
)

# --- scalar functions ---------------------------------------------------------------------------------------------

built(
    "fn_lower_upper_trim",
    "part",
    "select p_partkey, lower(p_type) as a, upper(p_name) as b, trim('  ' || p_brand || ' ', ' ') as c from part",
    lambda q: q.select("p_partkey").project(a=fn("lower", col("p_type")), b=fn("upper", col("p_name")), c=fn("trim", col("p_brand"))),
)
built(
    "fn_substr0",
    "customer",
    "select c_custkey, substr(c_name, 3, 4) as a, substr(c_name, length(c_name) - 1, 2) as b from customer",
    lambda q: q.select("c_custkey").project(a=fn("substr", col("c_name"), 2, 4), b=fn("substr", col("c_name"), -2, 100)),
)
built("fn_replace", "part", "select p_partkey, replace(p_brand, 'Brand', 'B') as a from part", lambda q: q.select("p_partkey").project(a=fn("replace", col("p_brand"), "Brand", "B")))
built(
    "fn_regexp_matches_opts",
    "part",
    "select p_partkey, regexp_matches(p_type, '^ECO', 'i') as a, regexp_matches(p_name, '\\d5$') as b, regexp_matches(p_name, '.', 'l') as c from part",
    lambda q: q.select("p_partkey").project(a=fn("regexp_matches", col("p_type"), "^ECO", "i"), b=fn("regexp_matches", col("p_name"), r"\d5$"), c=fn("regexp_matches", col("p_name"), ".", "l")),
)
built(
    "fn_regexp_replace_first",
    "customer",
    "select c_custkey, regexp_replace(c_name, '([0-9])', '<\\1>') as a, regexp_replace(c_mktsegment, '[AEIOU](.)', '\\1-\\1') as b, regexp_replace(c_mktsegment, '[aeiou]', '$', 'i') as c from customer",
    lambda q: q.select("c_custkey").project(
        a=fn("regexp_replace", col("c_name"), "([0-9])", r"<\1>"), b=fn("regexp_replace", col("c_mktsegment"), "[AEIOU](.)", r"\1-\1"), c=fn("regexp_replace", col("c_mktsegment"), "[aeiou]", "$", "i")
    ),
)
built(
    "fn_regexp_replace_g",
    "customer",
    "select c_custkey, regexp_replace(c_mktsegment, '([AEIOU])', '(\\1)', 'g') as a from customer",
    lambda q: q.select("c_custkey").project(a=fn("regexp_replace", col("c_mktsegment"), "([AEIOU])", r"(\1)", "g")),
)
built(
    "fn_coalesce_nullif",
    "orders",
    "select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') as a from orders",
    lambda q: q.select("o_orderkey").project(a=fn("coalesce", fn("nullif", col("o_orderstatus"), "O"), "open")),
)
built(
    "fn_cast_number",
    "customer",
    "select c_custkey, try_cast(substr(c_name, 5, 3) as double) as a, cast(c_custkey as varchar) as b, c_nationkey <> 0 as c, c_name <> '' as d from customer",
    lambda q: q.select("c_custkey").project(a=fn("cast", fn("substr", col("c_name"), 4, 3), "number"), b=fn("cast", col("c_custkey"), "string"), c=fn("cast", col("c_nationkey"), "boolean"), d=fn("cast", col("c_name"), "boolean")),
)
built(
    "fn_date_parts",
    "events",
    "select event_id, year(ts)::int as y, month(ts)::int as m, day(ts)::int as d, hour(ts)::int as h from events",
    lambda q: q.select("event_id").project(y=fn("year", col("ts")), m=fn("month", col("ts")), d=fn("day", col("ts")), h=fn("hour", col("ts"))),
)
built(
    "fn_date_trunc",
    "events",
    "select event_id, date_trunc('day', ts) as d, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.000Z') as iso from events",
    lambda q: q.select("event_id").project(d=fn("date_trunc", "day", col("ts")), iso=fn("date_trunc", "hour", col("ts"), "iso")),
)
built(
    "fn_round_floor_ceil_abs",
    "events",
    "select event_id, floor((value - 50) * 10 + 0.5) / 10 as a, floor(value - 50)::double as b, ceil(value - 50)::double as c, abs(value - 50) as d, floor(value + 0.5) as e from events",
    lambda q: q.select("event_id").project(
        a=fn("round", X.sub("value", 50), 1), b=fn("floor", X.sub("value", 50)), c=fn("ceil", X.sub("value", 50)), d=fn("abs", X.sub("value", 50)), e=fn("round", col("value"))
    ),
)
built(
    "fn_least_greatest_null",
    "orders",
    """select o_orderkey, case when o_orderstatus = 'O' then null else least(o_totalprice, 100000) end as a,
    greatest(o_orderstatus, 'G') as b from orders""",
    lambda q: q.select("o_orderkey").project(a=fn("least", X.case((X.ne("o_orderstatus", "O"), col("o_totalprice"))), 100000), b=fn("greatest", col("o_orderstatus"), "G")),
)

# --- distinct, order, limits --------------------------------------------------------------------------------------

built("distinct_proj", "orders", "select distinct o_orderstatus, o_orderpriority from orders", lambda q: q.select("o_orderstatus", "o_orderpriority").distinct())
built(
    "order_nulls_default",
    "orders",
    "select o_orderkey, nullif(o_orderstatus, 'O') as s from orders order by s asc nulls last, o_orderkey desc nulls first",
    lambda q: q.select("o_orderkey").project(s=fn("nullif", col("o_orderstatus"), "O")).order_by("s", ("o_orderkey", "desc")),
)
built("topk", "orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25", lambda q: q.select("o_orderkey", "o_totalprice").order_by(("o_totalprice", "desc"), "o_orderkey").limit(25))
built("offset_limit", "customer", "select c_custkey from customer order by c_custkey limit 30 offset 40", lambda q: q.select("c_custkey").order_by("c_custkey").offset(40).limit(30))
built(
    "distinct_order_limit",
    "orders",
    "select o_orderpriority from (select o_orderpriority, max(o_totalprice) m from orders group by 1) order by m desc limit 3",
    lambda q: q.select("o_orderpriority").order_by(("o_totalprice", "desc")).distinct().limit(3),
)

# --- aggregates ---------------------------------------------------------------------------------------------------

built(
    "agg_global",
    "lineitem",
    "select count(*) as n, round(sum(l_quantity), 4) as s, round(avg(l_extendedprice), 4) as a, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem",
    lambda q: _rounded(q.aggregate({"n": Agg("count"), "s": Agg("sum", "l_quantity"), "a": Agg("avg", "l_extendedprice"), "lo": Agg("min", "l_shipdate"), "hi": Agg("max", "l_shipdate")}), "s", "a"),
)
built(
    "agg_of_nothing",
    "orders",
    "select 0::bigint as n, 0::double as s, null::double as a, null::bigint as m from range(1)",
    lambda q: q.where(X.eq("o_orderstatus", "none")).aggregate({"n": Agg("count", "o_orderkey"), "s": Agg("sum", "o_totalprice"), "a": Agg("avg", "o_totalprice"), "m": Agg("max", "o_orderkey")}),
)
built(
    "agg_group_multi",
    "lineitem",
    """select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 3) as q, round(sum(l_extendedprice * (1 - l_discount)), 3) as revenue, count(nullif(l_returnflag, 'N')) as c
    from lineitem group by all""",
    lambda q: _rounded(
        q.group_by("l_returnflag", "l_linestatus").aggregate(
            {"n": Agg("count"), "q": Agg("sum", "l_quantity"), "revenue": Agg("sum", X.mul("l_extendedprice", X.sub(lit(1), col("l_discount")))), "c": Agg("count", fn("nullif", col("l_returnflag"), "N"))}
        ),
        "q",
        "revenue",
        digits=3,
    ),
)
built(
    "agg_stats",
    "events",
    "select event_type, round(var_samp(value), 5) as a, round(var_pop(value), 5) as b, round(stddev_samp(value), 5) as c, round(stddev_pop(value), 5) as d from events group by 1",
    lambda q: _rounded(q.group_by("event_type").aggregate({"a": Agg("var_samp", "value"), "b": Agg("var_pop", "value"), "c": Agg("stddev_samp", "value"), "d": Agg("stddev_pop", "value")}), *"abcd", digits=5),
)
built(
    "agg_median",
    "events",
    "select event_type, round(median(value), 6) as m, quantile_disc(props, 0.5) as t from events group by 1",
    lambda q: _rounded(q.group_by("event_type").aggregate({"m": Agg("median", "value"), "t": Agg("median", "props")}), "m", digits=6),
)
built(
    "agg_quantile",
    "lineitem",
    "select l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 5) as p90, round(quantile_cont(l_quantity, 0.0), 5) as p0 from lineitem group by 1",
    lambda q: _rounded(q.group_by("l_returnflag").aggregate({"p90": Agg("quantile", "l_extendedprice", 0.9), "p0": Agg("quantile", "l_quantity", 0.0)}), "p90", "p0", digits=5),
)
built(
    "agg_mode",
    "lineitem",
    """select l_returnflag, l_quantity as m from (select l_returnflag, l_quantity, row_number() over (partition by l_returnflag order by count(*) desc, min(file_row_number)) rn
    from (select *, row_number() over () as file_row_number from lineitem) group by 1, 2) where rn = 1""",
    lambda q: q.group_by("l_returnflag").aggregate({"m": Agg("mode", "l_quantity")}),
)
built(
    "agg_count_distinct",
    "lineitem",
    "select l_returnflag, count(distinct l_partkey) as a, count(distinct l_suppkey) as b from lineitem group by 1",
    lambda q: q.group_by("l_returnflag").aggregate({"a": Agg("count_distinct", "l_partkey"), "b": Agg("approx_count_distinct", "l_suppkey")}),
)
built(
    "agg_first_last",
    "orders",
    """select o_orderstatus, first(o_orderkey order by r) as f, last(o_orderkey order by r) as l, first(o_custkey order by r) as a from (select *, row_number() over () as r from orders) group by 1""",
    lambda q: q.group_by("o_orderstatus").aggregate({"f": Agg("first", "o_orderkey"), "l": Agg("last", "o_orderkey"), "a": Agg("any", "o_custkey")}),
)
built(
    "agg_having_alias",
    "orders",
    "select o_custkey, count(*) as n, round(sum(o_totalprice), 4) as s from orders group by 1 having count(*) >= 15 order by n desc, o_custkey limit 50",
    lambda q: _rounded(q.group_by("o_custkey").aggregate({"n": Agg("count"), "s": Agg("sum", "o_totalprice")}, having=X.gte("n", 15), order_by=[("n", "desc"), "o_custkey"], limit=50), "s"),
)
text("agg_having_hidden", "select o_orderpriority, count(*) as n from orders group by o_orderpriority having avg(o_totalprice) > 1 order by o_orderpriority")
text("group_by_alias", "select year(o_orderdate)::bigint as y, count(*) as n from orders group by y", "select year(o_orderdate) as y, count(*) as n from orders group by y")
built("group_only", "orders", "select distinct o_orderstatus, o_orderpriority from orders", lambda q: q.group_by("o_orderstatus", "o_orderpriority").aggregate({}))


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- windows ------------------------------------------------------------------------------------------------------

_BY_USER = {"partition_by": (col("user_id"),), "order_by": (Order(col("ts")), Order(col("event_id")))}


def _windows(name: str, sql: str, digits: tuple[str, ...] = (), **windows: Window) -> None:
    def make(q: Query) -> DataFrame:
        for alias, w in windows.items():
            q = q.window(alias, w)
        out = q.select("event_id", *windows).df()
        return _rounded(out, *digits, digits=8) if digits else out

    built(name, "events", sql, make)


_windows(
    "win_rank_family",
    """select event_id, row_number() over w as rn, rank() over v as rk, dense_rank() over v as dr from events
    window w as (partition by user_id order by ts, event_id), v as (partition by user_id order by event_type)""",
    rn=Window("row_number", (), **_BY_USER),
    rk=Window("rank", (), (col("user_id"),), (Order(col("event_type")),)),
    dr=Window("dense_rank", (), (col("user_id"),), (Order(col("event_type")),)),
)
_windows(
    "win_percent_cume_ntile",
    """select event_id, percent_rank() over v as pr, cume_dist() over v as cd, ntile(4) over w as nt from events
    window w as (partition by user_id order by ts, event_id), v as (partition by user_id order by event_type)""",
    pr=Window("percent_rank", (), (col("user_id"),), (Order(col("event_type")),)),
    cd=Window("cume_dist", (), (col("user_id"),), (Order(col("event_type")),)),
    nt=Window("ntile", (lit(4),), **_BY_USER),
)
_windows(
    "win_lag_lead_default",
    "select event_id, lag(value) over w as a, lead(value, 2, -1.0) over w as b, lag(value, 1, value) over w as c from events window w as (partition by user_id order by ts, event_id)",
    a=Window("lag", (col("value"),), **_BY_USER),
    b=Window("lead", (col("value"), lit(2), lit(-1.0)), **_BY_USER),
    c=Window("lag", (col("value"), lit(1), col("value")), **_BY_USER),
)
_SOME = X.case((X.gt("value", 50), col("value")))
_windows(
    "win_value_ignore_nulls",
    """select event_id, lag(x ignore nulls) over w as a, first_value(x ignore nulls) over w as b, last_value(x) over w as c, nth_value(x, 2) over w as d
    from (select *, case when value > 50 then value end as x from events) window w as (partition by user_id order by ts, event_id)""",
    a=Window("lag", (_SOME,), **_BY_USER, ignore_nulls=True),
    b=Window("first_value", (_SOME,), **_BY_USER, ignore_nulls=True),
    c=Window("last_value", (_SOME,), **_BY_USER),
    d=Window("nth_value", (_SOME, lit(2)), **_BY_USER),
)


def _frame(mode: str, before: str | None, after: str | None, exclude: str = "no-others") -> Frame:
    return Frame(mode, Bound("unbounded") if before is None else Bound("current") if before == "0" else Bound("preceding", before), Bound("unbounded", after=True) if after is None else Bound("current") if after == "0" else Bound("following", after), exclude)


_windows(
    "win_rows_frame",
    """select event_id, round(sum(value) over (w rows between 2 preceding and current row), 8) as s, count(*) over (w rows between 1 preceding and 1 following) as n,
    min(value) over (w rows between 3 preceding and 1 preceding) as m from events window w as (partition by user_id order by ts, event_id)""",
    ("s",),
    s=Window("sum", (col("value"),), **_BY_USER, frame=_frame("rows", "2", "0")),
    n=Window("count", ("*",), **_BY_USER, frame=_frame("rows", "1", "1")),
    m=Window("min", (col("value"),), **_BY_USER, frame=Frame("rows", Bound("preceding", "3"), Bound("preceding", "1"))),
)
_TYPE = {"partition_by": (col("event_type"),), "order_by": (Order(col("user_id")),)}
_windows(
    "win_range_numeric",
    "select event_id, round(sum(value) over (partition by event_type order by user_id range between 3 preceding and 2 following), 8) as s, count(*) over (partition by event_type order by user_id range between unbounded preceding and current row) as n from events",
    ("s",),
    s=Window("sum", (col("value"),), **_TYPE, frame=_frame("range", "3", "2")),
    n=Window("count", ("*",), **_TYPE, frame=_frame("range", None, "0")),
)
_windows(
    "win_range_interval",
    "select event_id, count(*) over (partition by user_id order by ts range between interval '6' hour preceding and interval '1' hour following) as n from events",
    n=Window("count", ("*",), (col("user_id"),), (Order(col("ts")),), _frame("range", "INTERVAL '6' HOUR", "INTERVAL '1' HOUR")),
)
_windows(
    "win_groups",
    "select event_id, round(sum(value) over (partition by event_type order by user_id groups between 1 preceding and 1 following), 8) as s, count(*) over (partition by event_type order by user_id desc groups between 2 preceding and current row) as n from events",
    ("s",),
    s=Window("sum", (col("value"),), **_TYPE, frame=_frame("groups", "1", "1")),
    n=Window("count", ("*",), (col("event_type"),), (Order(col("user_id"), "desc"),), _frame("groups", "2", "0")),
)
for _name, _sql, _exclude in (("current", "current row", "current-row"), ("group", "group", "group"), ("ties", "ties", "ties")):
    _windows(
        f"win_exclude_{_name}",
        f"""select event_id, round(sum(value) over (partition by event_type order by user_id groups between 1 preceding and 1 following exclude {_sql}), 8) as s,
        max(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following exclude {_sql}) as m,
        round(avg(value) over (partition by event_type order by user_id range between 2 preceding and 2 following exclude {_sql}), 8) as a from events""",
        ("s", "a"),
        s=Window("sum", (col("value"),), **_TYPE, frame=_frame("groups", "1", "1", _exclude)),
        m=Window("max", (col("value"),), **_BY_USER, frame=_frame("rows", "2", "2", _exclude)),
        a=Window("avg", (col("value"),), **_TYPE, frame=_frame("range", "2", "2", _exclude)),
    )
_windows(
    "win_filter",
    "select event_id, count(*) filter (where value > 50) over (partition by user_id) as n, round(sum(value) filter (where event_type = 'click') over (partition by user_id order by ts, event_id), 8) as s from events",
    ("s",),
    n=Window("count", ("*",), (col("user_id"),), where=X.gt("value", 50)),
    s=Window("sum", (col("value"),), **_BY_USER, where=X.eq("event_type", "click")),
)
_windows(
    "win_count_distinct",
    "select event_id, count(distinct event_type) over (partition by user_id) as n from events",
    n=Window("count", (col("event_type"),), (col("user_id"),), distinct=True),
)
_windows(
    "win_median_quantile_mode",
    """select event_id, round(median(value) over (partition by user_id), 8) as m, round(quantile_cont(value, 0.25) over w, 8) as q,
    list_sort(list_transform(list_distinct(list(event_type) over w), lambda x: {'n': -len(list_filter(list(event_type) over w, lambda y: y = x)), 'v': x}))[1].v as o
    from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row)""",
    ("m", "q"),
    m=Window("median", (col("value"),), (col("user_id"),)),
    q=Window("quantile", (col("value"), lit(0.25)), **_BY_USER, frame=_frame("rows", "4", "0")),
    o=Window("mode", (col("event_type"),), **_BY_USER, frame=_frame("rows", "4", "0")),
)
_windows(
    "win_rows_by_row",
    """select event_id, round(sum(value) over (w rows between user_id % 3 preceding and user_id % 2 following), 8) as s, count(*) over (w rows between user_id % 4 preceding and current row) as n
    from events window w as (partition by user_id order by ts, event_id)""",
    ("s",),
    s=Window("sum", (col("value"),), **_BY_USER, frame=Frame("rows", Bound("preceding", X.mod("user_id", 3)), Bound("following", X.mod("user_id", 2)))),
    n=Window("count", ("*",), **_BY_USER, frame=Frame("rows", Bound("preceding", X.mod("user_id", 4)), Bound("current"))),
)
text(
    "win_named",
    "select event_id, row_number() over w as rn, round(sum(value) over (w rows between 1 preceding and current row), 8) as s from events window p as (partition by user_id), w as (p order by ts, event_id)",
)
text("qualify_topn", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) <= 2")
text("qualify_alias", "select event_id, rank() over (partition by event_type order by value desc, event_id) as rk from events where value > 10 qualify rk <= 3 and event_id > 5 order by event_id")
built(
    "qualify_builder",
    "orders",
    "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1",
    lambda q: q.select("o_custkey", "o_orderkey").window("rn", Window("row_number", (), (col("o_custkey"),), (Order(col("o_totalprice"), "desc"), Order(col("o_orderkey"))))).qualify(X.eq("rn", 1)),
)

# --- joins --------------------------------------------------------------------------------------------------------

text("join_inner_multi", "select n_name, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name")
text("join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000")
text("join_right", "select s_suppkey, n_name from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000")
text("join_full", "select a.n_nationkey as a, b.n_nationkey as b from (select * from nation where n_nationkey < 15) a full join (select * from nation where n_nationkey > 8) b on a.n_nationkey = b.n_nationkey")
text("join_cross", "select r_name, n_name from region cross join nation")
text("join_theta", "select a.s_suppkey as a, b.r_regionkey as b from supplier a join region b on a.s_nationkey % 5 > b.r_regionkey and a.s_acctbal > 1000")
text("join_theta_full", "select n_nationkey, r_regionkey from nation full join region on n_nationkey > 20 and r_regionkey < n_regionkey")
text("join_using", "select n_nationkey, c from nation join (select s_nationkey as n_nationkey, count(*) as c from supplier group by 1) x using (n_nationkey)")
text("semi_in", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 350000)")
text("anti_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
text("semi_multi_key", "select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_suppkey) in (select o_orderkey, o_custkey % 100 + 1 from orders)")
text("exists_corr", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 30)")
text("not_exists_corr", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')")
text("in_corr_noneq", "select s_suppkey from supplier s where s_nationkey in (select c_nationkey from customer c where c.c_acctbal > s.s_acctbal)")
text("scalar_agg_corr_where", "select o_orderkey from orders o where o_totalprice > (select 1.5 * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
text("scalar_agg_corr_select", "select n_nationkey, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation")
text("in_grouped_having", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)")
text("in_order_limit", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders order by o_totalprice desc, o_orderkey limit 20)")
text("exists_uncorrelated", "select r_name from region where exists (select 1 from nation where n_nationkey > 20) and not exists (select 1 from nation where n_nationkey > 100)")


@query("""with a as (select o_orderkey, nullif(o_orderstatus, 'O') as k from orders), b as (select * from (values (null, 'none'), ('F', 'done')) t(k, label))
select a.o_orderkey, a.k, b.label from a left join b on a.k is not distinct from b.k""")
def null_safe_broadcast_join(spark: SparkSession, d: str) -> DataFrame:
    left = frame(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("k"))
    right = spark.createDataFrame([(None, "none"), ("F", "done")], "k string, label string")
    return joins.hash_join(left, right, "k", "k", "left")


@query("select o_orderkey, o_custkey, c_name as \"right.c_name\" from orders join (select c_custkey as o_custkey, c_name from customer) using (o_custkey)", "broadcast_join_collision")
def broadcast_join_collision(spark: SparkSession, d: str) -> DataFrame:
    left = frame(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("c_name"))
    right = frame(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.hash_join(left, right, "o_custkey", "o_custkey").drop("c_name")


@query("select n_nationkey, r_name from nation left join region on n_regionkey = r_regionkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    names = {r["r_regionkey"]: r["r_name"] for r in frame(spark, d, "region").collect()}
    left = frame(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return joins.lookup_join(left, lambda keys: [{"r_regionkey": k, "r_name": names[k]} for (k,) in keys if k in names], "n_regionkey", "r_regionkey", "r_regionkey int, r_name string", "left").select("n_nationkey", "r_name")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders) ", "hash_semi")
def hash_semi(spark: SparkSession, d: str) -> DataFrame:
    return joins.hash_join(frame(spark, d, "customer").select("c_custkey"), frame(spark, d, "orders"), "c_custkey", "o_custkey", "semi")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders) ", "hash_anti")
def hash_anti(spark: SparkSession, d: str) -> DataFrame:
    return joins.hash_join(frame(spark, d, "customer").select("c_custkey"), frame(spark, d, "orders"), "c_custkey", "o_custkey", "anti")


@query("select n_name, r_name from nation, region", "cross_join_builder")
def cross_join_builder(spark: SparkSession, d: str) -> DataFrame:
    return joins.cross_join(frame(spark, d, "nation").select("n_name"), frame(spark, d, "region").select("r_name"))


# --- the flagship: filter, aggregate, join, windows and QUALIFY in one statement -----------------------------------

FLAGSHIP = """select r_name, n_name, segment, n, revenue, rank() over (partition by r_name order by revenue desc, n_name, segment) as place from (
  select r_name, n_name, c_mktsegment as segment, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where l_shipdate >= timestamp '1993-01-01' and l_quantity < 45 group by r_name, n_name, c_mktsegment) x
qualify place <= 5 order by r_name, place"""
text("flagship", FLAGSHIP)

# --- the SQL surface ----------------------------------------------------------------------------------------------

text("sql_cte", "with big as (select * from orders where o_totalprice > 200000) select o_orderstatus, count(*) as n from big group by o_orderstatus order by n desc, o_orderstatus")
text("sql_cte_nested", "with a as (with b as (select n_regionkey as k, count(*) as n from nation group by 1) select * from b where n > 0) select r_name, n from region join a on r_regionkey = k")
text("sql_derived", "select k, n from (select o_custkey as k, count(*) as n from orders group by o_custkey) x where n > 12")
text("sql_scalar_sub", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders) and o_custkey < (select max(c_custkey) from customer)")
text("sql_params", "select o_orderkey from orders where o_totalprice > $1 and o_orderstatus = $2", "select o_orderkey from orders where o_totalprice > 250000.0 and o_orderstatus = 'F'", params=[250000.0, "F"])
text("sql_read_parquet", "select r_name, r_regionkey from read_parquet('{d}/region.parquet') where r_regionkey >= 2", "select r_name, r_regionkey from region where r_regionkey >= 2")
text("sql_default_from", "select p_brand, count(*) as n group by p_brand", "select p_brand, count(*) as n from part group by p_brand", path="{d}/part.parquet")
text("sql_regexp", "select c_custkey, regexp_replace(c_name, '#0*', '-') as a, regexp_matches(c_mktsegment, '^auto', 'i') as b, regexp_replace(c_name, '[0-9]', 'x', 'g') as c from customer where c_name like '%1%'")
text("sql_quoted_strings", "select 'it''s' as a, '\\d' as b, \"r_name\" from region where r_name is distinct from 'x''y'")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000 and o_orderstatus in ('F', 'O') order by o_totalprice desc, o_orderkey limit 40 offset 5")
def json_query(spark: SparkSession, d: str) -> DataFrame:
    spec = {
        "version": 1,
        "from": f"{d}/orders.parquet",
        "select": ["o_orderkey", "o_totalprice"],
        "where": {"and": [{"gt": ["o_totalprice", 200000]}, {"in": ["o_orderstatus", ["F", "O"]]}]},
        "orderBy": [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}],
        "limit": 40,
        "offset": 5,
    }
    return Lake(spark).query(spec).df()


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 150000 and o_orderstatus like 'F%' qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2", "sql_from_builder")
def sql_from_builder(spark: SparkSession, d: str) -> DataFrame:
    """A builder's query printed as SQL text, and that text run."""
    by = Window("row_number", (), (col("o_custkey"),), (Order(col("o_totalprice"), "desc"), Order(col("o_orderkey"))))
    q = Lake(spark).path(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "rn").where(X.and_(X.gt("o_totalprice", 150000), X.like("o_orderstatus", "F%")))
    return run_sql(spark, q.window("rn", by).qualify(X.lte("rn", 2)).to_sql()).drop("rn")


@query("""select l_returnflag, count(*) as n, round(sum(l_quantity), 3) as s, round(avg(l_tax), 8) as a, round(var_samp(l_quantity), 5) as v, min(l_shipdate) as lo, max(l_shipdate) as hi
from lineitem group by 1""")
def agg_partial_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two halves aggregated on their own, their states merged and finished."""
    from tarnlake.operators import partials

    spec = {"n": Agg("count"), "s": Agg("sum", "l_quantity"), "a": Agg("avg", "l_tax"), "v": Agg("var_samp", "l_quantity"), "lo": Agg("min", "l_shipdate"), "hi": Agg("max", "l_shipdate")}
    df = frame(spark, d, "lineitem")
    early = F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    _, state = partials.resumed(df.filter(early), ["l_returnflag"], spec, None)
    done, _ = partials.resumed(df.filter(~early), ["l_returnflag"], spec, state)
    return done.withColumns({"s": F.round("s", 3), "a": F.round("a", 8), "v": F.round("v", 5)})


@query("select n_nationkey, n_name from nation where n_regionkey = 2", "engine_load_table")
def engine_load_table(spark: SparkSession, d: str) -> DataFrame:
    from tarnlake.plans.engine import load_table

    return load_table(spark, f"{d}/nation.parquet").scan(["n_nationkey", "n_name"], X.eq("n_regionkey", 2))


# --- vectors and rows ---------------------------------------------------------------------------------------------

_Q = "(select embedding from embeddings where vec_id = 7)"


def _nearest(metric: str) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = frame(spark, d, "embeddings")
        q = df.filter("vec_id = 7").first()["embedding"]
        return vectors.nearest(df, q, 10, metric).withColumn("score", F.round("score", 3))

    return run


_QUERIES["vec_dot_topk"] = (_nearest("dot"), f"select vec_id, round(list_inner_product(embedding::double[], {_Q}::double[]), 3) as score from embeddings order by list_inner_product(embedding::double[], {_Q}::double[]) desc, vec_id limit 10")
_QUERIES["vec_l2_topk"] = (_nearest("l2"), f"select vec_id, round(power(list_distance(embedding::double[], {_Q}::double[]), 2), 3) as score from embeddings order by list_distance(embedding::double[], {_Q}::double[]), vec_id limit 10")
_QUERIES["vec_cosine_topk"] = (
    _nearest("cosine-distance"),
    f"select vec_id, round(greatest(list_cosine_distance(embedding::double[], {_Q}::double[]), 0), 3) as score from embeddings order by list_cosine_distance(embedding::double[], {_Q}::double[]), vec_id limit 10",
)


@query(f"select vec_id, label from embeddings order by list_distance(embedding::double[], {_Q}::double[]), vec_id limit 10")
def vec_ivf_probe_all(spark: SparkSession, d: str) -> DataFrame:
    df = frame(spark, d, "embeddings")
    return vectors.ListIndex(df, lists=8).search(df.filter("vec_id = 7").first()["embedding"], 10, nprobes=8, select=["label"]).select("vec_id", "label")


def _each_sql(score: str, order: str, columns: str = "e.vec_id") -> str:
    """The ten nearest rows of every vector ``q`` whose id is divisible by 100."""
    return f"select q.vec_id as query_id, {columns}{score} from embeddings e, embeddings q where q.vec_id % 100 = 0 qualify row_number() over (partition by q.vec_id order by {order}, e.vec_id) <= 10"


_DISTANCE = "list_distance(e.embedding::double[], q.embedding::double[])"


@query(_each_sql(f", round(power({_DISTANCE}, 2), 3) as score", _DISTANCE))
def vec_ivf_probe_two(spark: SparkSession, d: str) -> DataFrame:
    df = frame(spark, d, "embeddings")
    found = vectors.ListIndex(df, lists=8).search_each(df.filter("vec_id % 100 = 0"), 10, nprobes=2, complete=True)
    return found.withColumn("score", F.round("score", 3))


def _nearest_each(metric: str) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = frame(spark, d, "embeddings")
        return vectors.nearest_each(df, df.filter("vec_id % 100 = 0"), 10, metric).withColumn("score", F.round("score", 3))

    return run


_DOT, _COSINE = (f"{f}(e.embedding::double[], q.embedding::double[])" for f in ("list_inner_product", "list_cosine_distance"))
_QUERIES["vec_dot_topk_each"] = (_nearest_each("dot"), _each_sql(f", round({_DOT}, 3) as score", f"{_DOT} desc"))
_QUERIES["vec_l2_topk_each"] = (_nearest_each("l2"), _each_sql(f", round(power({_DISTANCE}, 2), 3) as score", _DISTANCE))
_QUERIES["vec_cosine_topk_each"] = (_nearest_each("cosine-distance"), _each_sql(f", round(greatest({_COSINE}, 0), 3) as score", f"greatest({_COSINE}, 0)"))


@query(_each_sql("", _DISTANCE, "e.vec_id, e.label"))
def vec_ivf_probe_all_each(spark: SparkSession, d: str) -> DataFrame:
    df = frame(spark, d, "embeddings")
    return vectors.ListIndex(df, lists=8).search_each(df.filter("vec_id % 100 = 0"), 10, nprobes=8, select=["label"]).select("query_id", "vec_id", "label")


_IDS = [7, 3, 7, 1]


@query("select p as __pos, o_orderkey, o_totalprice from (values (0, 7), (1, 3), (2, 7), (3, 1)) t(p, k) join orders on o_orderkey = k")
def take_rows_order_dups(spark: SparkSession, d: str) -> DataFrame:
    return vectors.take_rows(frame(spark, d, "orders"), _IDS, "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("select p as __pos, l_orderkey, l_linenumber from (values (0, 7), (1, 3), (2, 7)) t(p, k) join lineitem on l_orderkey = k")
def lookup_rows(spark: SparkSession, d: str) -> DataFrame:
    return vectors.lookup_rows(frame(spark, d, "lineitem"), [7, 3, 7], "l_orderkey", "l_linenumber", ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders where o_custkey > 10 and o_custkey <= 25")
def range_rows(spark: SparkSession, d: str) -> DataFrame:
    return vectors.range_rows(frame(spark, d, "orders"), "o_custkey", "o_orderkey", 10, 25, include_lower=False).select("o_orderkey", "o_custkey")


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 100000 order by o_orderkey limit 100")
def policy_row_filter(spark: SparkSession, d: str) -> DataFrame:
    policy = Policy(("o_orderkey", "o_totalprice"), lambda c: X.eq("o_orderstatus", c["status"]), 100, {"status": "F"})
    return Lake(spark, policy=policy).path(f"{d}/orders.parquet").select("o_orderkey").where(X.gt("o_totalprice", 100000)).order_by("o_orderkey").df()


@query("select c_custkey, c_name from customer")
def slice_resume_union(spark: SparkSession, d: str) -> DataFrame:
    q = Lake(spark).path(f"{d}/customer.parquet").select("c_custkey", "c_name").order_by("c_custkey")
    rows = [r for part, _ in q.resumable(1 + q.count() // 3) for r in part]
    return spark.createDataFrame([(r["c_custkey"], r["c_name"]) for r in rows], "c_custkey bigint, c_name string")


# --- geometry -----------------------------------------------------------------------------------------------------

_POINT = fn("st_point", col("x"), col("y"))


def _points(spark: SparkSession, d: str) -> Query:
    df = frame(spark, d, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(37)).cast("double").alias("x"), F.pmod(F.col("c_custkey") * 7, F.lit(41)).cast("double").alias("y"))
    return Lake(spark).frame(df)


@query("select c_custkey from customer where c_custkey % 37 between 5 and 12 and (c_custkey * 7) % 41 between 10 and 30")
def geo_points_within_bbox(spark: SparkSession, d: str) -> DataFrame:
    box = '{"type":"BBox","minx":5,"miny":10,"maxx":12,"maxy":30}'
    return _points(spark, d).select("c_custkey").where(fn("st_intersects", _POINT, box)).df()


@query("select c_custkey, sqrt(power(c_custkey % 37 - 10, 2) + power((c_custkey * 7) % 41 - 20, 2)) as dist from customer where sqrt(power(c_custkey % 37 - 10, 2) + power((c_custkey * 7) % 41 - 20, 2)) <= 6")
def geo_dwithin(spark: SparkSession, d: str) -> DataFrame:
    q = _points(spark, d).select("c_custkey").project(dist=fn("st_distance", _POINT, "POINT(10 20)"))
    return q.where(fn("st_dwithin", _POINT, "POINT(10 20)", 6)).df()


@query("select n_nationkey, ((n_nationkey + 1) * 2)::double as area, (2 * (n_nationkey + 1 + 2))::double as length from nation")
def geo_area_length(spark: SparkSession, d: str) -> DataFrame:
    box = fn("st_bbox", 0, 0, X.add("n_nationkey", 1), 2)
    return Lake(spark).path(f"{d}/nation.parquet").select("n_nationkey").project(area=fn("st_area", box), length=fn("st_length", box)).df()


@query("select c_custkey from customer where c_custkey % 37 > 0 and (c_custkey * 7) % 41 > 0 and c_custkey % 37 + (c_custkey * 7) % 41 < 20")
def geo_polygon_contains(spark: SparkSession, d: str) -> DataFrame:
    triangle = '{"type":"Polygon","coordinates":[[[0,0],[20,0],[0,20],[0,0]]]}'
    return _points(spark, d).select("c_custkey").where(fn("st_contains", triangle, _POINT)).df()


def queries() -> dict[str, Run]:
    return {k: run for k, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
