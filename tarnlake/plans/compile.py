"""Expressions to columns, with the type checks that Spark's implicit casts would skip."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.functions import geometry, scalar


@dataclass(frozen=True)
class Typed:
    """A column and its kind: number, string, boolean, timestamp, bytes, interval, null or other."""

    column: Column
    kind: str


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.NullType):
        return "null"
    return "interval" if "Interval" in type(t).__name__ else "other"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Compiler:
    """Compiles expressions against the columns of one DataFrame."""

    def __init__(self, source: DataFrame | T.StructType, box_columns: bool = True):
        schema = source if isinstance(source, T.StructType) else source.schema
        self.kinds = {f.name: kind_of(f.dataType) for f in schema.fields}
        self.types = {f.name: f.dataType for f in schema.fields}
        self.boxes = box_columns and {"minx", "miny", "maxx", "maxy"} <= set(self.kinds)

    def column(self, e: X.Expr) -> Column:
        return self.compile(e).column

    def predicate(self, e: X.Expr) -> Column:
        """A filter; anything but a boolean is refused. Spatial filters of rows with box columns gain conjuncts on those."""
        t = self.compile(e)
        if t.kind not in ("boolean", "null"):
            raise LakeError("TYPE_ERROR", "a predicate must be boolean", {"kind": t.kind})
        pruning = self._box_conjuncts(e) if self.boxes else None
        return t.column if pruning is None else pruning & t.column

    def _box_conjuncts(self, e: X.Expr) -> Column | None:
        if isinstance(e, X.Logical) and e.op == "and":
            found = [c for c in map(self._box_conjuncts, e.operands) if c is not None]
            return None if not found else found[0] if len(found) == 1 else found[0] & found[1]
        if isinstance(e, X.Call) and e.fn in ("st_intersects", "st_within", "st_contains", "st_dwithin"):
            texts = [a.value for a in e.args[:2] if isinstance(a, X.Literal) and isinstance(a.value, str)]
            if len(texts) == 1 and any(isinstance(a, X.ColumnRef) for a in e.args[:2]):
                d = e.args[2].value if e.fn == "st_dwithin" and isinstance(e.args[2], X.Literal) else 0.0
                return geometry.bbox_filter(texts[0], float(d))
        return None

    def compile(self, e: X.Expr) -> Typed:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _literal(self, e: X.Literal) -> Typed:
        v = e.value
        if v is None:
            return Typed(F.lit(None), "null")
        kinds = ((bool, "boolean"), ((int, float, Decimal), "number"), (str, "string"), ((dt.datetime, dt.date), "timestamp"), ((bytes, bytearray), "bytes"))
        for t, k in kinds:
            if isinstance(v, t):
                if isinstance(v, dt.datetime) and v.tzinfo is None:
                    return Typed(F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz"), k)
                return Typed(F.lit(v), k)
        raise LakeError("TYPE_ERROR", f"unsupported literal {type(v).__name__}")

    def _columnref(self, e: X.ColumnRef) -> Typed:
        if e.name not in self.kinds:
            raise LakeError("UNKNOWN_COLUMN", f"unknown column {e.name}", {"column": e.name, "columns": sorted(self.kinds)})
        return Typed(F.col(quoted(e.name)), self.kinds[e.name])

    def _pair(self, a: X.Expr, b: X.Expr) -> tuple[Column, Column]:
        """Both sides of a comparison; different kinds are refused, but text compared with a timestamp is read as one."""
        x, y = self.compile(a), self.compile(b)
        for t in (x, y):
            if t.kind in ("bytes", "interval", "other"):
                raise LakeError("TYPE_ERROR", f"{t.kind} values can't be compared")
        if x.kind != y.kind and "null" not in (x.kind, y.kind):
            if {x.kind, y.kind} != {"string", "timestamp"}:
                raise LakeError("TYPE_ERROR", f"can't compare {x.kind} with {y.kind}")
            x, y = (Typed(F.try_to_timestamp(t.column).cast("timestamp_ntz"), "timestamp") if t.kind == "string" else t for t in (x, y))
        return x.column, y.column

    def _compare(self, e: X.Compare) -> Typed:
        a, b = self._pair(e.left, e.right)
        return Typed({"eq": a == b, "ne": a != b, "lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[e.op], "boolean")

    def _in(self, e: X.In) -> Typed:
        pairs = [self._pair(e.target, v) for v in e.values]
        found = pairs[0][0].isin([y for _, y in pairs]) if pairs else F.when(self.column(e.target).isNotNull(), F.lit(False))
        return Typed(~found if e.negated else found, "boolean")

    def _between(self, e: X.Between) -> Typed:
        (t, low), (_, high) = self._pair(e.target, e.low), self._pair(e.target, e.high)
        inside = (t >= low) & (t <= high)
        return Typed(~inside if e.negated else inside, "boolean")

    def _nullcheck(self, e: X.NullCheck) -> Typed:
        c = self.column(e.target)
        return Typed(c.isNotNull() if e.negated else c.isNull(), "boolean")

    def _boolean(self, e: X.Expr) -> Column:
        t = self.compile(e)
        if t.kind not in ("boolean", "null"):
            raise LakeError("TYPE_ERROR", f"a {t.kind} is no condition")
        return t.column.cast("boolean")

    def _logical(self, e: X.Logical) -> Typed:
        result = self._boolean(e.operands[0])
        for x in e.operands[1:]:
            result = result & self._boolean(x) if e.op == "and" else result | self._boolean(x)
        return Typed(result, "boolean")

    def _not(self, e: X.Not) -> Typed:
        return Typed(~self._boolean(e.operand), "boolean")

    def _like(self, e: X.Like) -> Typed:
        t = self.compile(e.target)
        if t.kind not in ("string", "null"):
            raise LakeError("TYPE_ERROR", "LIKE needs text")
        pattern = e.pattern.replace("\\", "\\\\")
        return Typed(t.column.ilike(pattern) if e.ignore_case else t.column.like(pattern), "boolean")

    def _number(self, e: X.Expr, what: str) -> Column:
        t = self.compile(e)
        if t.kind not in ("number", "null"):
            raise LakeError("TYPE_ERROR", f"{what} needs numbers, not {t.kind}")
        return t.column if t.kind == "number" else t.column.cast("double")

    def _arithmetic(self, e: X.Arithmetic) -> Typed:
        a, b = self._number(e.left, e.op), self._number(e.right, e.op)
        if e.op in ("div", "mod"):
            return Typed(scalar.divide(a, b) if e.op == "div" else scalar.modulo(a, b), "number")
        a, b = a.cast("double"), b.cast("double")
        return Typed({"add": a + b, "sub": a - b, "mul": a * b}[e.op], "number")

    def _case(self, e: X.Case) -> Typed:
        values = [self.compile(v) for _, v in e.whens] + ([self.compile(e.otherwise)] if e.otherwise else [])
        kinds = {v.kind for v in values} - {"null"}
        if len(kinds) > 1:
            raise LakeError("TYPE_ERROR", f"branches of different kinds: {', '.join(sorted(kinds))}")
        result = F.when(self._boolean(e.whens[0][0]), values[0].column)
        for (w, _), v in zip(e.whens[1:], values[1:]):
            result = result.when(self._boolean(w), v.column)
        return Typed(result.otherwise(values[-1].column) if e.otherwise else result, next(iter(kinds), "null"))

    def _text(self, e: X.Expr, what: str) -> str:
        if not isinstance(e, X.Literal) or not isinstance(e.value, str):
            raise LakeError("TYPE_ERROR", f"{what} must be literal text")
        return e.value

    def _call(self, e: X.Call) -> Typed:
        name, args = e.fn.lower(), e.args
        if name in ("regexp_matches", "regexp_replace"):
            least = 2 if name == "regexp_matches" else 3
            if not least <= len(args) <= least + 1:
                raise LakeError("TYPE_ERROR", f"{name} takes {least} or {least + 1} arguments")
            texts = [self._text(a, f"{name}: each argument after the first") for a in args[1:]]
            s = self.column(args[0])
            return Typed(scalar.regexp_matches(s, *texts), "boolean") if least == 2 else Typed(scalar.regexp_replace(s, *texts), "string")
        if name == "cast":
            t, to = self.compile(args[0]), self._text(args[1], "the type of a cast")
            return Typed(scalar.cast(t.column, t.kind, to), {"string": "string", "boolean": "boolean"}.get(to, "number"))
        if name in scalar.PARTS:
            t = self.compile(args[0])
            return Typed(scalar.date_part(name, t.column, t.kind), "number")
        if name == "date_trunc":
            t = self.compile(args[1])
            iso = len(args) > 2
            return Typed(scalar.date_trunc(self._text(args[0], "the part"), t.column, t.kind, iso), "string" if iso else "timestamp")
        if name == "round":
            digits = args[1].value if len(args) > 1 and isinstance(args[1], X.Literal) else 0
            return Typed(scalar.round_half_up(self._number(args[0], "round"), int(digits)), "number")
        if name in geometry.FUNCTIONS:
            kind = {"double": "number", "boolean": "boolean", "string": "string"}[geometry.FUNCTIONS[name][0]]
            plain = geometry.native(name, list(args), self.column)
            return Typed(geometry.call(name, *(self.column(a) for a in args)) if plain is None else plain, kind)
        if name in ("h3_cell", "h3_within"):
            if name == "h3_within" and isinstance(args[2], X.Literal) and args[2].value == 0:
                return Typed(F.lower(self.column(args[0])) == F.lower(self.column(args[1])), "boolean")
            raise LakeError("MISSING_GEO_BACKEND", f"{name} needs an H3 backend, which isn't installed")
        if name not in scalar.PLAIN:
            raise LakeError("UNSUPPORTED_PUSHDOWN", f"unknown function {name}")
        f, least, most = scalar.PLAIN[name]
        if len(args) < least or (most is not None and len(args) > most):
            raise LakeError("TYPE_ERROR", f"{name} takes {least}{'' if most == least else ' or more'} argument(s)")
        typed = [self.compile(a) for a in args]
        if name in ("floor", "ceil", "abs"):
            self._number(args[0], name)
        kinds = [t.kind for t in typed if t.kind != "null"]
        kind = {"floor": "number", "ceil": "number", "abs": "number", "h3_in": "boolean"}.get(name, kinds[0] if name in ("coalesce", "nullif", "least", "greatest") and kinds else "string")
        return Typed(f(*(t.column for t in typed)), kind)
