"""Window functions beyond what Spark parses: GROUPS frames, EXCLUDE, FILTER, DISTINCT, median and mode, lowered to SQL it has.

One lowering serves the builder and the SQL surface: a window call becomes a Spark SQL expression, and helper columns
(peer group and row numbers) that must be computed one level below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.plans.compile import Compiler, quoted

RANKING = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
VALUE = ("lag", "lead", "first_value", "last_value", "nth_value")
#: Other names of aggregates.
ALIASES = {"var": "var_samp", "variance": "var_samp", "stddev": "stddev_samp", "quantile_cont": "quantile", "any_value": "any", "percentile_cont": "quantile"}
AGGREGATES = ("count", "sum", "avg", "var_samp", "var_pop", "stddev_samp", "stddev_pop", "min", "max", "median", "quantile", "mode", "first", "last", "any", "count_distinct")


@dataclass(frozen=True)
class Bound:
    """A frame bound: ``kind`` is unbounded, preceding, current or following; ``offset`` is SQL text or, in a builder's ROWS
    frame, an expression of each row."""

    kind: str
    offset: str | X.Expr | None = None
    after: bool = False  # for unbounded: following


@dataclass(frozen=True)
class Frame:
    mode: str = "range"
    start: Bound = Bound("unbounded")
    end: Bound = Bound("current")
    exclude: str = "no-others"


@dataclass
class WindowCall:
    """A window call in SQL text; ``order`` has (expression, asc or desc, first or last or None)."""

    fn: str
    args: list[str] = field(default_factory=list)
    partition: list[str] = field(default_factory=list)
    order: list[tuple[str, str, str | None]] = field(default_factory=list)
    frame: Frame | None = None
    where: str | None = None
    ignore_nulls: bool = False
    distinct: bool = False
    ordinal: str | None = None
    #: Lowest and highest row of the frame relative to each row, as SQL; ``frame`` is then wide enough for all rows.
    span: tuple[str, str] | None = None


def _order_text(order: list[tuple[str, str, str | None]], nulls_default) -> str:
    return ", ".join(f"{e} {d.upper()} NULLS {(n or nulls_default(d)).upper()}" for e, d, n in order)


def builder_nulls(direction: str) -> str:
    """The builder's default: nulls last ascending, first descending."""
    return "last" if direction == "asc" else "first"


def sql_nulls(_direction: str) -> str:
    """The SQL surface's default: nulls last."""
    return "last"


def _bound(b: Bound) -> str:
    if b.kind == "unbounded":
        return "UNBOUNDED FOLLOWING" if b.after else "UNBOUNDED PRECEDING"
    return "CURRENT ROW" if b.kind == "current" else f"{X.to_sql(b.offset) if isinstance(b.offset, X.Expr) else b.offset} {b.kind.upper()}"


def _holds_current(f: Frame) -> bool:
    """Whether the current row is in its frame whatever the offsets are."""
    return f.start.kind in ("unbounded", "preceding", "current") and f.end.kind in ("unbounded", "following", "current") and not (f.start.kind == "unbounded" and f.start.after)


def lower(w: WindowCall, name, nulls_default=builder_nulls) -> tuple[str, dict[str, str]]:
    """The Spark SQL expression of a window call and its helper columns (name to SQL); ``name()`` makes new names."""
    fn = ALIASES.get(w.fn.lower(), w.fn.lower())
    if fn == "approx_count_distinct":
        raise LakeError("UNSUPPORTED_SQL", "approx_count_distinct isn't a window function")
    if fn == "count" and w.distinct:
        fn = "count_distinct"
    elif w.distinct:
        raise LakeError("UNSUPPORTED_SQL", "only count takes DISTINCT")
    if fn not in (*RANKING, *VALUE, *AGGREGATES):
        raise LakeError("UNSUPPORTED_SQL", f"unknown window function {fn}")
    if w.where and fn not in AGGREGATES:
        raise LakeError("UNSUPPORTED_SQL", f"FILTER doesn't apply to {fn}")
    helpers: dict[str, str] = {}
    part = f"PARTITION BY {', '.join(w.partition)} " if w.partition else ""
    order = _order_text(w.order, nulls_default)
    # ties are broken by the place in the source, where it is known and matters
    places = order
    if w.ordinal and (fn in ("row_number", "ntile", "lag", "lead") or (w.frame and w.frame.mode == "rows")):
        places = ", ".join(x for x in (order, f"{w.ordinal} ASC") if x)
    if fn in RANKING:
        _arity(fn, w.args, 1 if fn == "ntile" else 0)
        if fn == "ntile" and not (w.args[0].strip().isdigit() and int(w.args[0]) > 0):
            raise LakeError("TYPE_ERROR", "ntile needs a positive whole number")
        by = places or "1"
        return f"{fn}({', '.join(w.args)}) OVER ({part}ORDER BY {by})", helpers
    ignore = " IGNORE NULLS" if w.ignore_nulls else ""
    if fn in ("lag", "lead"):
        if not 1 <= len(w.args) <= 3 or (len(w.args) > 1 and not w.args[1].strip().isdigit()):
            raise LakeError("TYPE_ERROR", f"{fn} takes a value, a whole number and a default")
        return f"{fn}({', '.join(w.args)}){ignore} OVER ({part}ORDER BY {places or '1'})", helpers
    frame, over_order = w.frame, places
    peer = None
    if frame and (frame.mode == "groups" or frame.exclude != "no-others" or w.span):
        peer = name()
        helpers[peer] = f"dense_rank() OVER ({part}ORDER BY {order or '1'})"
    if frame and frame.mode == "groups":
        over_order = peer
    frame_text = ""
    if frame:
        for b in (frame.start, frame.end):
            if b.offset is not None and not _literal_offset(b.offset):
                raise LakeError("UNSUPPORTED_SQL", "frame offsets must be literals")
        mode = "ROWS" if frame.mode == "rows" else "RANGE"
        frame_text = f" {mode} BETWEEN {_bound(frame.start)} AND {_bound(frame.end)}"
        if not over_order:
            over_order = "1"
    elif not order:
        frame_text = ""
    over = f"OVER ({part}{'ORDER BY ' + over_order if over_order else ''}{frame_text})"
    if frame and (frame.exclude != "no-others" or w.span):
        return _excluding(fn, w, frame, part, order, places, over, peer, helpers, name), helpers
    if fn in VALUE:
        _arity(fn, w.args, 2 if fn == "nth_value" else 1)
        return f"{fn}({', '.join(w.args)}){ignore} {over}", helpers
    return _aggregate(fn, w, over), helpers


def _arity(fn: str, args: list[str], n: int) -> None:
    if len(args) != n:
        raise LakeError("TYPE_ERROR", f"{fn} takes {n} argument(s)")


def _literal_offset(text: str) -> bool:
    import re

    return bool(re.fullmatch(r"\s*(\d+(\.\d+)?|INTERVAL\s+.+)\s*", text, re.I | re.S))


def _value(w: WindowCall) -> str:
    """The argument, null where the filter doesn't hold; 1 for ``count(*)``."""
    x = "1" if not w.args or w.args[0].strip() == "*" else w.args[0]
    return f"CASE WHEN {w.where} THEN {x} END" if w.where else x


def _aggregate(fn: str, w: WindowCall, over: str) -> str:
    x = _value(w)
    if fn == "count_distinct":
        return f"CAST(size(collect_set({x}) {over}) AS BIGINT)"
    if fn == "median":
        return f"percentile({x}, 0.5) {over}"
    if fn == "quantile":
        _arity(fn, w.args, 2)
        return f"percentile({x}, {w.args[1]}) {over}"
    if fn == "mode":
        return _mode(f"collect_list({x}) {over}")
    if fn in ("first", "last", "any"):
        return f"{'last' if fn == 'last' else 'first'}({x}) IGNORE NULLS {over}"
    return f"{fn}({x}) {over}"


def _mode(values: str) -> str:
    """The most frequent of an array without nulls; of equally frequent ones the smallest."""
    counted = f"transform(array_sort(array_distinct({values})), `__lv` -> struct(-size(filter({values}, `__lu` -> `__lu` = `__lv`)) AS n, `__lv` AS v))"
    return f"array_min({counted}).v"


def _excluding(fn: str, w: WindowCall, frame: Frame, part: str, order: str, places: str, over: str, peer: str, helpers: dict[str, str], name) -> str:
    x = _value(w)
    if fn in ("count", "sum", "avg") and not w.span and _holds_current(frame) and (frame.exclude == "current-row" or frame.mode != "rows"):
        # the excluded rows are all in the frame: what they add is taken away, without gathering frames
        peers = f"OVER ({part.rstrip()}{', ' if part else 'PARTITION BY '}{peer})"
        own_n, own_s = f"CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END", f"coalesce(({x}), 0)"
        if frame.exclude == "current-row":
            gone_n, gone_s = own_n, own_s
        else:
            back = frame.exclude == "ties"
            gone_n = f"(count({x}) {peers}" + (f" - {own_n})" if back else ")")
            gone_s = f"(coalesce(sum({x}) {peers}, 0)" + (f" - {own_s})" if back else ")")
        n = f"(count({x}) {over} - {gone_n})"
        if fn == "count":
            return n
        s = f"(coalesce(sum({x}) {over}, 0) - {gone_s})"
        return f"CASE WHEN {n} > 0 THEN {s}{f' / {n}' if fn == 'avg' else ''} END"
    row = name()
    helpers[row] = f"row_number() OVER ({part}ORDER BY {places or '1'})"
    keep = {"current-row": f"`__le`.r <> {row}", "group": f"`__le`.g <> {peer}", "ties": f"`__le`.g <> {peer} OR `__le`.r = {row}", "no-others": "true"}[frame.exclude]
    if w.span:
        keep = f"({keep}) AND `__le`.r >= {row} + {w.span[0]} AND `__le`.r <= {row} + {w.span[1]}"
    rows = f"filter(collect_list(struct({row} AS r, {peer} AS g, {x} AS v)) {over}, `__le` -> {keep})"
    values = f"transform({rows}, `__le` -> `__le`.v)"
    if fn in VALUE:
        if w.ignore_nulls:
            values = f"filter({values}, `__lv` -> `__lv` IS NOT NULL)"
        at = {"first_value": "1", "last_value": "-1"}.get(fn) or w.args[1]
        return f"try_element_at({values}, {at})"
    there = f"filter({values}, `__lv` -> `__lv` IS NOT NULL)"
    if fn == "count":
        return f"CAST(size({there}) AS BIGINT)"
    if fn == "count_distinct":
        return f"CAST(size(array_distinct({there})) AS BIGINT)"
    if fn in ("min", "max"):
        return f"array_{fn}({there})"
    if fn in ("first", "any", "last"):
        return f"try_element_at({there}, {'-1' if fn == 'last' else '1'})"
    if fn == "mode":
        return _mode(there)
    total = f"aggregate({there}, CAST(0 AS DOUBLE), (`__la`, `__lv`) -> `__la` + `__lv`)"
    if fn == "sum":
        return f"CASE WHEN size({there}) > 0 THEN {total} END"
    if fn == "avg":
        return f"CASE WHEN size({there}) > 0 THEN {total} / size({there}) END"
    if fn in ("median", "quantile"):
        p = "0.5" if fn == "median" else w.args[1]
        at = f"((size({there}) - 1) * {p})"
        pick = lambda i: f"element_at(array_sort({there}), CAST({i} AS INT) + 1)"
        return f"CASE WHEN size({there}) > 0 THEN {pick(f'floor{at}')} + ({at} - floor{at}) * ({pick(f'ceil{at}')} - {pick(f'floor{at}')}) END"
    mean = f"({total} / size({there}))"
    spread = f"aggregate({there}, CAST(0 AS DOUBLE), (`__la`, `__lv`) -> `__la` + (`__lv` - {mean}) * (`__lv` - {mean}))"
    sample = fn.endswith("samp")
    variance = f"CASE WHEN size({there}) > {1 if sample else 0} THEN {spread} / (size({there}) - {1 if sample else 0}) END"
    return f"sqrt({variance})" if fn.startswith("stddev") else variance


# --- the builder's surface ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Order:
    expr: X.Expr
    direction: str = "asc"
    nulls: str | None = None


@dataclass(frozen=True)
class Window:
    """A window expression of the builder: function, arguments and specification; offsets of ``frame`` are numbers or interval text."""

    fn: str
    args: tuple = ()
    partition_by: tuple[X.Expr, ...] = ()
    order_by: tuple[Order, ...] = ()
    frame: Frame | None = None
    where: X.Expr | None = None
    ignore_nulls: bool = False
    distinct: bool = False


def add_windows(df: DataFrame, windows: dict[str, Window], ordinal: str | None = None) -> DataFrame:
    """``df`` with a column per window; all are computed from the columns of ``df``. Specifications that agree share a sort.

    Frames are over the partition's rows in order; nulls in an order key of a RANGE frame with offsets are peers of each
    other. An empty ``df`` stays empty.
    """
    compiler, helpers, results = Compiler(df, box_columns=False), {}, {}
    counter = iter(range(1, 1_000_000))

    def name() -> str:
        return f"__w{next(counter)}"

    known: dict[X.Expr, str] = {}

    def plain(e: X.Expr) -> str:
        """SQL text of an expression: its own name, its literal, or a helper column."""
        if isinstance(e, X.ColumnRef):
            compiler.compile(e)
            return quoted(e.name)
        if isinstance(e, X.Literal) and isinstance(e.value, (int, float)) and not isinstance(e.value, bool):
            return repr(e.value)
        if e not in known:
            known[e] = name()
            helpers[known[e]] = compiler.column(e)
        return known[e]

    def spanned(f: Frame) -> tuple[Frame, tuple[str, str] | None]:
        """A ROWS frame with offsets by row as one of literal offsets that holds it, and each row's span within."""
        ends = (f.start, f.end)
        if not any(isinstance(b.offset, X.Expr) for b in ends):
            return f, None
        if f.mode != "rows":
            raise LakeError("UNSUPPORTED_SQL", "only ROWS frames take offsets by row")
        span, wide = [], []
        for b in ends:
            if b.kind in ("unbounded", "current"):
                span.append({"current": "0"}.get(b.kind, str(1 << 62) if b.after else str(-(1 << 62))))
                wide.append(b)
                continue
            e = b.offset if isinstance(b.offset, X.Expr) else X.lit(int(b.offset))
            c = compiler.column(e).cast("int")
            low, most = df.agg(F.min(c), F.max(c)).first()
            if low is not None and low < 0:
                raise LakeError("TYPE_ERROR", "a frame offset is negative")
            span.append(f"{'-' if b.kind == 'preceding' else ''}CAST({plain(e)} AS INT)")
            # to be wide enough, a frame that starts after its row starts at the row, and one that ends before ends there
            nearer = (b is f.start and b.kind == "following") or (b is f.end and b.kind == "preceding")
            wide.append(Bound("current") if nearer else Bound(b.kind, str(most or 0)))
        return Frame("rows", wide[0], wide[1], f.exclude), (span[0], span[1])

    lowered = {}
    for alias, w in windows.items():
        frame, span = spanned(w.frame) if w.frame else (None, None)
        args = ["*" if a == "*" else plain(a if isinstance(a, X.Expr) else X.lit(a) if not isinstance(a, str) else X.col(a)) for a in w.args]
        call = WindowCall(
            w.fn,
            args,
            [plain(p) for p in w.partition_by],
            [(plain(o.expr), o.direction, o.nulls) for o in w.order_by],
            frame,
            plain(w.where) if w.where else None,
            w.ignore_nulls,
            w.distinct,
            ordinal,
            span,
        )
        lowered[alias], deeper = lower(call, name)
        results |= deeper
    base = df.withColumns(helpers) if helpers else df
    if results:
        base = base.withColumns({k: F.expr(v) for k, v in results.items()})
    out = base.withColumns({a: F.expr(s) for a, s in lowered.items()}) if lowered else base
    return out.drop(*helpers, *results)
