"""Expressions as plain data: constructors, JSON both ways, and SQL text. ``plans.compile`` turns them into columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from tarnlake.errors import LakeError

COMPARISONS = {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}


class Expr:
    """Base of all expressions."""


@dataclass(frozen=True)
class Literal(Expr):
    value: Any


@dataclass(frozen=True)
class ColumnRef(Expr):
    name: str


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class In(Expr):
    target: Expr
    values: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    target: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class NullCheck(Expr):
    target: Expr
    negated: bool = False


@dataclass(frozen=True)
class Logical(Expr):
    op: str
    operands: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    operand: Expr


@dataclass(frozen=True)
class Like(Expr):
    target: Expr
    pattern: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Call(Expr):
    fn: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Arithmetic(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None


def col(name: str) -> ColumnRef:
    return ColumnRef(name)


def lit(value: Any) -> Literal:
    return Literal(value)


def _column(x: str | Expr) -> Expr:
    return ColumnRef(x) if isinstance(x, str) else x


def _value(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


def _comparison(op: str):
    def make(left: str | Expr, right: Any) -> Compare:
        return Compare(op, _column(left), _value(right))

    make.__name__ = op
    return make


eq, ne, lt, lte, gt, gte = map(_comparison, COMPARISONS)


def is_in(target: str | Expr, values: list) -> In:
    return In(_column(target), tuple(map(_value, values)))


def not_in(target: str | Expr, values: list) -> In:
    return In(_column(target), tuple(map(_value, values)), True)


def between(target: str | Expr, low: Any, high: Any, negated: bool = False) -> Between:
    return Between(_column(target), _value(low), _value(high), negated)


def is_null(target: str | Expr) -> NullCheck:
    return NullCheck(_column(target))


def is_not_null(target: str | Expr) -> NullCheck:
    return NullCheck(_column(target), True)


def _logical(op: str, operands: tuple[Expr, ...]) -> Logical:
    if len(operands) < 2:
        raise LakeError("INVALID_EXPRESSION", f"{op} needs at least two operands")
    return Logical(op, tuple(operands))


def and_(*operands: Expr) -> Logical:
    return _logical("and", operands)


def or_(*operands: Expr) -> Logical:
    return _logical("or", operands)


def not_(operand: Expr) -> Not:
    return Not(operand)


def like(target: str | Expr, pattern: str) -> Like:
    return Like(_column(target), pattern)


def ilike(target: str | Expr, pattern: str) -> Like:
    return Like(_column(target), pattern, True)


def fn(name: str, *args: Any) -> Call:
    """A function call; strings are literals here, columns are given by ``col``."""
    return Call(name.lower(), tuple(map(_value, args)))


def _arithmetic(op: str):
    def make(left: str | Expr, right: Any) -> Arithmetic:
        return Arithmetic(op, left if isinstance(left, Expr) else _column(left) if isinstance(left, str) else Literal(left), _value(right))

    make.__name__ = op
    return make


add, sub, mul, div, mod = map(_arithmetic, ARITHMETIC)


def neg(operand: str | Expr) -> Arithmetic:
    return Arithmetic("sub", Literal(0), _column(operand))


def case(*whens: tuple[Expr, Any], otherwise: Any = None) -> Case:
    if not whens:
        raise LakeError("INVALID_EXPRESSION", "case needs at least one branch")
    return Case(tuple((w, _value(v)) for w, v in whens), None if otherwise is None else _value(otherwise))


def simple_case(target: str | Expr, *whens: tuple[Any, Any], otherwise: Any = None) -> Case:
    return case(*((Compare("eq", _column(target), _value(w)), v) for w, v in whens), otherwise=otherwise)


def columns_of(e: Expr | None) -> set[str]:
    """The names of all columns that an expression reads."""
    if e is None:
        return set()
    if isinstance(e, ColumnRef):
        return {e.name}
    found: set[str] = set()
    for v in vars(e).values():
        for x in v if isinstance(v, tuple) else (v,):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Expr):
                    found |= columns_of(y)
    return found


# --- JSON ---------------------------------------------------------------------------------------------------------


def _fail(message: str) -> LakeError:
    return LakeError("PARSE_ERROR", message)


def _scalar(x: Any) -> Literal:
    if isinstance(x, (list, dict)):
        raise _fail("a literal must be a scalar")
    return Literal(x)


def from_json(x: Any) -> Expr:
    """An expression from its JSON form: a node with ``kind``, or one operator as key with its operands as value."""
    if not isinstance(x, dict):
        raise _fail("a JSON expression must be an object")
    if isinstance(x.get("kind"), str):
        return _from_node(x)
    if len(x) != 1:
        raise _fail("a JSON expression must have exactly one operator")
    op, v = next(iter(x.items()))

    def operands(n: int) -> list:
        if not isinstance(v, list) or len(v) != n or not isinstance(v[0], str):
            raise _fail(f"{op} expects a column and {n - 1} operand(s)")
        return v

    if op in COMPARISONS:
        name, value = operands(2)
        return Compare(op, ColumnRef(name), _scalar(value))
    if op in ("in", "notIn"):
        name, values = operands(2)
        if not isinstance(values, list):
            raise _fail(f"{op} expects a list of values")
        return In(ColumnRef(name), tuple(map(_scalar, values)), op == "notIn")
    if op == "between":
        name, low, high = operands(3)
        return Between(ColumnRef(name), _scalar(low), _scalar(high))
    if op in ("isNull", "isNotNull"):
        if not isinstance(v, str):
            raise _fail(f"{op} expects a column")
        return NullCheck(ColumnRef(v), op == "isNotNull")
    if op in ("like", "ilike"):
        name, pattern = operands(2)
        if not isinstance(pattern, str):
            raise _fail(f"{op} expects a string pattern")
        return Like(ColumnRef(name), pattern, op == "ilike")
    if op in ("and", "or"):
        if not isinstance(v, list) or len(v) < 2:
            raise _fail(f"{op} expects at least two expressions")
        return Logical(op, tuple(map(from_json, v)))
    if op == "not":
        return Not(from_json(v))
    raise _fail(f"unsupported JSON expression operator {op}")


def _from_node(x: dict) -> Expr:
    kind = x["kind"]
    try:
        if kind == "literal":
            return _scalar(x["value"])
        if kind == "column":
            return ColumnRef(x["name"])
        if kind == "compare" and x["op"] in COMPARISONS:
            return Compare(x["op"], from_json(x["left"]), from_json(x["right"]))
        if kind == "in":
            return In(from_json(x["target"]), tuple(map(from_json, x["values"])), bool(x.get("negated", False)))
        if kind == "between":
            return Between(from_json(x["target"]), from_json(x["low"]), from_json(x["high"]), bool(x.get("negated", False)))
        if kind == "null-check":
            return NullCheck(from_json(x["target"]), bool(x["negated"]))
        if kind == "logical" and x["op"] in ("and", "or"):
            return _logical(x["op"], tuple(map(from_json, x["operands"])))
        if kind == "not":
            return Not(from_json(x["operand"]))
        if kind == "like":
            return Like(from_json(x["target"]), x["pattern"], bool(x.get("caseInsensitive", False)))
        if kind == "call":
            return Call(x["fn"].lower(), tuple(map(from_json, x["args"])))
        if kind == "arithmetic" and x["op"] in ARITHMETIC:
            return Arithmetic(x["op"], from_json(x["left"]), from_json(x["right"]))
        if kind == "case":
            return Case(tuple((from_json(w["when"]), from_json(w["value"])) for w in x["whens"]), from_json(x["else"]) if x.get("else") else None)
    except KeyError as e:
        raise _fail(f"{kind} expression lacks {e}") from e
    raise _fail(f"unsupported JSON expression {kind}")


def to_json(e: Expr) -> dict:
    """The JSON node of an expression; ``from_json`` gives it back."""
    match e:
        case Literal(v):
            return {"kind": "literal", "value": v}
        case ColumnRef(n):
            return {"kind": "column", "name": n}
        case Compare(op, a, b):
            return {"kind": "compare", "op": op, "left": to_json(a), "right": to_json(b)}
        case In(t, vs, n):
            return {"kind": "in", "target": to_json(t), "values": [to_json(v) for v in vs], "negated": n}
        case Between(t, a, b, n):
            return {"kind": "between", "target": to_json(t), "low": to_json(a), "high": to_json(b), "negated": n}
        case NullCheck(t, n):
            return {"kind": "null-check", "target": to_json(t), "negated": n}
        case Logical(op, xs):
            return {"kind": "logical", "op": op, "operands": [to_json(x) for x in xs]}
        case Not(x):
            return {"kind": "not", "operand": to_json(x)}
        case Like(t, p, i):
            return {"kind": "like", "target": to_json(t), "pattern": p, "caseInsensitive": i}
        case Call(f, xs):
            return {"kind": "call", "fn": f, "args": [to_json(x) for x in xs]}
        case Arithmetic(op, a, b):
            return {"kind": "arithmetic", "op": op, "left": to_json(a), "right": to_json(b)}
        case Case(ws, o):
            return {"kind": "case", "whens": [{"when": to_json(w), "value": to_json(v)} for w, v in ws]} | ({"else": to_json(o)} if o else {})
    raise LakeError("INVALID_EXPRESSION", f"no JSON form of {type(e).__name__}")


def to_sql(e: Expr) -> str:
    """The expression as SQL text, fully parenthesised."""
    match e:
        case Literal(None):
            return "NULL"
        case Literal(bool() as v):
            return str(v).upper()
        case Literal(str() as v):
            return "'" + v.replace("'", "''") + "'"
        case Literal(dt.datetime() as v):
            return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
        case Literal(dt.date() as v):
            return f"DATE '{v.isoformat()}'"
        case Literal(v):
            return repr(v)
        case ColumnRef(n):
            return '"' + n.replace('"', '""') + '"'
        case Compare(op, a, b):
            return f"({to_sql(a)} {COMPARISONS[op]} {to_sql(b)})"
        case In(t, vs, n):
            return f"({to_sql(t)} {'NOT ' * n}IN ({', '.join(map(to_sql, vs))}))"
        case Between(t, a, b, n):
            return f"({to_sql(t)} {'NOT ' * n}BETWEEN {to_sql(a)} AND {to_sql(b)})"
        case NullCheck(t, n):
            return f"({to_sql(t)} IS {'NOT ' * n}NULL)"
        case Logical(op, xs):
            return "(" + f" {op.upper()} ".join(map(to_sql, xs)) + ")"
        case Not(x):
            return f"(NOT {to_sql(x)})"
        case Like(t, p, i):
            return f"({to_sql(t)} {'I' * i}LIKE {to_sql(Literal(p))})"
        case Call(f, xs):
            return f"{f}({', '.join(map(to_sql, xs))})"
        case Arithmetic(op, a, b):
            return f"({to_sql(a)} {ARITHMETIC[op]} {to_sql(b)})"
        case Case(ws, o):
            return "CASE " + " ".join(f"WHEN {to_sql(w)} THEN {to_sql(v)}" for w, v in ws) + (f" ELSE {to_sql(o)}" if o else "") + " END"
    raise LakeError("INVALID_EXPRESSION", f"no SQL form of {type(e).__name__}")
