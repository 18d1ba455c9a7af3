"""Planar geometry, longitude as x and latitude as y: parsing and exact predicates, vectorised over Arrow batches.

Geometries are GeoJSON or BBox text (``{"type":"BBox","minx":…}``), ``POINT(x y)`` text or WKB bytes. Points, lines and
polygons (first ring the outline, others holes) and boxes are supported; others raise a typed error.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.errors import LakeError

Point = tuple[float, float]
Shape = tuple[str, list[list[Point]]]  # kind and rings (a point or line has one)
_WKT = re.compile(r"\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*(\S+)\s+(\S+?)(?:\s+\S+)*\s*\)\s*$", re.I)


def _bad(message: str) -> LakeError:
    return LakeError("TYPE_ERROR", message)


def _position(x: Any) -> Point:
    if not isinstance(x, (list, tuple)) or len(x) < 2 or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in x[:2]):
        raise _bad("invalid coordinates")
    return float(x[0]), float(x[1])


def box(minx: float, miny: float, maxx: float, maxy: float) -> Shape:
    if not all(map(math.isfinite, (minx, miny, maxx, maxy))) or minx > maxx or miny > maxy:
        raise _bad("invalid bounding box")
    return "BBox", [[(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]]


def _wkb(data: bytes) -> Shape:
    at = 0

    def take(fmt: str) -> tuple:
        nonlocal at
        size = struct.calcsize(fmt)
        if at + size > len(data):
            raise _bad("WKB ends early")
        at += size
        return struct.unpack(fmt, data[at - size : at])

    order = "<" if take("<B")[0] == 1 else ">"
    kind = take(order + "I")[0]
    extra = bool(kind & 0x80000000) + bool(kind & 0x40000000)
    if kind & 0x20000000:
        take(order + "I")
    kind &= 0x0FFFFFFF
    extra += {0: 0, 1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)
    kind %= 1000

    def point() -> Point:
        return _position(take(order + "d" * (2 + extra)))

    def ring() -> list[Point]:
        return [point() for _ in range(take(order + "I")[0])]

    if kind == 1:
        return "Point", [[point()]]
    if kind == 2:
        return "LineString", [ring()]
    if kind == 3:
        return "Polygon", [_closed(ring()) for _ in range(take(order + "I")[0])]
    raise _bad(f"unsupported WKB geometry type {kind}")


def _closed(ring: list[Point]) -> list[Point]:
    if len(ring) < 3:
        raise _bad("a ring needs at least three points")
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def parse(value: Any) -> Shape:
    """A geometry from any of its forms."""
    if isinstance(value, (bytes, bytearray)):
        return _wkb(bytes(value))
    if m := _WKT.match(value):
        return "Point", [[_position([float(m[1]), float(m[2])])]]
    try:
        g = json.loads(value)
    except ValueError as e:
        raise _bad("a geometry must be GeoJSON, BBox, POINT or WKB") from e
    kind = g.get("type") if isinstance(g, dict) else None
    if kind == "BBox" or (isinstance(g, dict) and kind is None and "minx" in g):
        return box(*(float(g[k]) for k in ("minx", "miny", "maxx", "maxy")))
    c = g.get("coordinates") if isinstance(g, dict) else None
    if kind == "Point":
        return "Point", [[_position(c)]]
    if kind == "LineString" and isinstance(c, list) and c:
        return "LineString", [[_position(p) for p in c]]
    if kind == "Polygon" and isinstance(c, list) and c:
        return "Polygon", [_closed([_position(p) for p in r]) for r in c]
    raise _bad(f"unsupported geometry {kind}")


def envelope(g: Shape) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for r in g[1] for p in r], [p[1] for r in g[1] for p in r]
    return min(xs), min(ys), max(xs), max(ys)


def _segments(g: Shape) -> list[tuple[Point, Point]]:
    return [(r[0], r[0]) for r in g[1] if len(r) == 1] + [(a, b) for r in g[1] for a, b in zip(r, r[1:])]


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a: Point, b: Point, p: Point) -> bool:
    return _side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(s: tuple[Point, Point], t: tuple[Point, Point]) -> bool:
    a, b, c, d = *s, *t
    x, y, z, w = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    return (x * y < 0 and z * w < 0) or _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def _in_ring(ring: list[Point], p: Point) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _area_has(g: Shape, p: Point) -> int:
    """1 inside, 0 on the edge, -1 outside of a polygon or box."""
    if any(_on(a, b, p) for a, b in _segments(g)):
        return 0
    return 1 if _in_ring(g[1][0], p) and not any(_in_ring(h, p) for h in g[1][1:]) else -1


def _areal(g: Shape) -> bool:
    return g[0] in ("Polygon", "BBox")


def intersects(a: Shape, b: Shape) -> bool:
    (ax, ay, aX, aY), (bx, by, bX, bY) = envelope(a), envelope(b)
    if ax > bX or bx > aX or ay > bY or by > aY:
        return False
    if any(_cross(s, t) for s in _segments(a) for t in _segments(b)):
        return True
    return (_areal(a) and _area_has(a, b[1][0][0]) >= 0) or (_areal(b) and _area_has(b, a[1][0][0]) >= 0)


def contains(a: Shape, b: Shape) -> bool:
    """Whether no point of ``b`` is outside of ``a``, and one is in its interior."""
    cuts: list[Point] = []
    for s in _segments(b):
        cuts += _pieces(a, s)
    if _areal(a):
        places = [_area_has(a, p) for p in [*(p for r in b[1] for p in r), *cuts]]
        if min(places) < 0 or any(_area_has(b, p) > 0 for h in a[1][1:] for p in [_inner(h)] if _areal(b)):
            return False
        return max(places) > 0 or _areal(b)
    edge = lambda p: any(_on(s[0], s[1], p) for s in _segments(a))
    if _areal(b):
        return False
    if not all(edge(p) for p in [*(p for r in b[1] for p in r), *cuts]):
        return False
    return b[0] != "Point" or a[0] == "Point" or b[1][0][0] not in (a[1][0][0], a[1][0][-1]) or a[1][0][0] == a[1][0][-1]


def _pieces(a: Shape, s: tuple[Point, Point]) -> list[Point]:
    """Midpoints of the pieces into which the edges of ``a`` cut a segment."""
    (x0, y0), (x1, y1) = s
    ts = {0.0, 1.0}
    for c, d in _segments(a):
        over = (x1 - x0) * (d[1] - c[1]) - (y1 - y0) * (d[0] - c[0])
        if over:
            t = ((c[0] - x0) * (d[1] - c[1]) - (c[1] - y0) * (d[0] - c[0])) / over
            if 0 < t < 1:
                ts.add(t)
        else:
            n = (x1 - x0) ** 2 + (y1 - y0) ** 2
            for p in (c, d):
                if n and 0 < (t := ((p[0] - x0) * (x1 - x0) + (p[1] - y0) * (y1 - y0)) / n) < 1 and abs(_side(s[0], s[1], p)) == 0:
                    ts.add(t)
    cuts = sorted(ts)
    return [(x0 + (x1 - x0) * m, y0 + (y1 - y0) * m) for m in ((u + v) / 2 for u, v in zip(cuts, cuts[1:]))]


def _inner(ring: list[Point]) -> Point:
    """A point inside a ring: the middle of the first inside stretch of a horizontal line through it."""
    ys = sorted({p[1] for p in ring})
    y = (ys[0] + ys[1]) / 2 if len(ys) > 1 else ys[0]
    xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:]) if (a[1] > y) != (b[1] > y))
    return ((xs[0] + xs[1]) / 2, y) if len(xs) > 1 else ring[0]


def _to_segment(p: Point, s: tuple[Point, Point]) -> float:
    (x0, y0), (x1, y1) = s
    n = (x1 - x0) ** 2 + (y1 - y0) ** 2
    t = max(0.0, min(1.0, ((p[0] - x0) * (x1 - x0) + (p[1] - y0) * (y1 - y0)) / n)) if n else 0.0
    return math.hypot(p[0] - x0 - t * (x1 - x0), p[1] - y0 - t * (y1 - y0))


def separation(a: Shape, b: Shape) -> float:
    """The exact planar distance."""
    if intersects(a, b):
        return 0.0
    sa, sb = _segments(a), _segments(b)
    return min(min(_to_segment(p, t) for s in sa for p in s for t in sb), min(_to_segment(p, s) for t in sb for p in t for s in sa))


def envelope_distance(a: Shape, b: Shape) -> float:
    (ax, ay, aX, aY), (bx, by, bX, bY) = envelope(a), envelope(b)
    return math.hypot(max(bx - aX, ax - bX, 0.0), max(by - aY, ay - bY, 0.0))


def within_distance(a: Shape, b: Shape, d: float) -> bool:
    return envelope_distance(a, b) <= d and separation(a, b) <= d


def area(g: Shape) -> float:
    """Of a box its area; of a polygon the shoelace sum over the points of all rings in a row (holes aren't taken away)."""
    if not _areal(g):
        return 0.0
    if g[0] == "BBox":
        x, y, x2, y2 = envelope(g)
        return (x2 - x) * (y2 - y)
    points = [p for r in g[1] for p in r]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:]))) / 2


def length(g: Shape) -> float:
    points = [p for r in g[1] for p in r]
    return 0.0 if g[0] == "Point" else sum(math.dist(a, b) for a, b in zip(points, points[1:]))


def _number(x: float) -> float | int:
    return int(x) if float(x).is_integer() and abs(x) < 2**53 else x


def point_text(x: float, y: float) -> str:
    return json.dumps({"type": "Point", "coordinates": [_number(x), _number(y)]}, separators=(",", ":"))


def box_text(b: tuple[float, float, float, float]) -> str:
    return json.dumps({"type": "BBox"} | dict(zip(("minx", "miny", "maxx", "maxy"), map(_number, b))), separators=(",", ":"))


def _of(kind: str, f):
    """A vectorised function of parsed geometries (the first two arguments of a pair, or one) and numbers; null for nulls."""

    def run(*args: pd.Series) -> pd.Series:
        known: dict[Any, Shape] = {}

        def shape(v: Any) -> Any:
            if not isinstance(v, (str, bytes)):
                return v
            if v not in known:
                known[v] = parse(v)
            return known[v]

        return pd.Series([None if any(x is None or x != x for x in row) else f(*map(shape, row)) for row in zip(*args)], dtype=object)

    return F.pandas_udf(run, kind)


def _only_point(g: Shape) -> Point:
    if g[0] != "Point":
        raise _bad("a point is expected")
    return g[1][0][0]


def centroid(g: Shape) -> str:
    x, y, x2, y2 = envelope(g)
    return point_text((x + x2) / 2, (y + y2) / 2)


#: Name: (result type, function, number of arguments). Built into UDFs when first used, as that needs a session.
FUNCTIONS = {
    "st_x": ("double", lambda g: _only_point(g)[0], 1),
    "st_y": ("double", lambda g: _only_point(g)[1], 1),
    "st_intersects": ("boolean", intersects, 2),
    "st_disjoint": ("boolean", lambda a, b: not intersects(a, b), 2),
    "st_contains": ("boolean", contains, 2),
    "st_within": ("boolean", lambda a, b: contains(b, a), 2),
    "st_dwithin": ("boolean", within_distance, 3),
    "st_distance": ("double", envelope_distance, 2),
    "st_area": ("double", area, 1),
    "st_length": ("double", length, 1),
    "st_centroid": ("string", centroid, 1),
    "st_envelope": ("string", lambda g: box_text(envelope(g)), 1),
    "st_point": ("string", lambda x, y: point_text(*_position([x, y])), 2),
    "st_bbox": ("string", lambda *b: box_text(envelope(box(*b))), 4),
}


def call(name: str, *args: Column) -> Column:
    kind, f, n = FUNCTIONS[name]
    if len(args) != n:
        raise _bad(f"{name} takes {n} argument(s)")
    return _of(kind, f)(*args)


Box = tuple[Column, Column, Column, Column]


def _finite(x: Column) -> Column:
    """``x`` as a coordinate: null for null and NaN, an error if infinite."""
    d = x.cast("double")
    return F.when(F.abs(d) == float("inf"), F.raise_error(F.lit("invalid coordinates")).cast("double")).when(~F.isnan(d), d)


def _plain_number(x: Column) -> Column:
    return F.when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def native(name: str, args: list[Any], column: Callable[[Any], Column]) -> Column | None:
    """A function of points made of columns, and of literal points and boxes, in expressions that Spark compiles; None where that isn't so.

    Points and boxes are their envelopes, of which distance, intersection and containment are comparisons.
    """
    from tarnlake.functions import expr as X

    def placed(a: Any) -> tuple[str, Box] | None:
        if isinstance(a, X.Call) and a.fn == "st_point" and len(a.args) == 2:
            x, y = (_finite(column(p)) for p in a.args)
            return "Point", (x, y, x, y)
        if isinstance(a, X.Literal) and isinstance(a.value, str):
            g = parse(a.value)
            if g[0] in ("Point", "BBox"):
                return g[0], tuple(F.lit(v) for v in envelope(g))
        return None

    if name == "st_point" and len(args) == 2:
        x, y = (_finite(column(a)) for a in args)
        return F.concat(F.lit('{"type":"Point","coordinates":['), _plain_number(x), F.lit(","), _plain_number(y), F.lit("]}"))
    if name in ("st_x", "st_y") and len(args) == 1 and isinstance(args[0], X.Call) and (p := placed(args[0])):
        # both coordinates must be there
        return F.when(p[1][0].isNotNull() & p[1][1].isNotNull(), p[1][0 if name == "st_x" else 1])
    if name not in ("st_distance", "st_dwithin", "st_intersects", "st_disjoint", "st_contains", "st_within") or len(args) != (3 if name == "st_dwithin" else 2):
        return None
    a, b = (placed(x) for x in args[:2])
    if a is None or b is None or not any(isinstance(x, X.Call) for x in args[:2]):
        return None
    (kind, (ax, ay, aX, aY)), (other, (bx, by, bX, bY)) = a, b
    there = ax.isNotNull() & ay.isNotNull() & bx.isNotNull() & by.isNotNull()
    if name in ("st_distance", "st_dwithin"):
        away = F.hypot(F.greatest(bx - aX, ax - bX, F.lit(0.0)), F.greatest(by - aY, ay - bY, F.lit(0.0)))
        if name == "st_dwithin":
            d = column(args[2]).cast("double")
            return F.when(there & ~F.isnan(d), away <= d)
        return F.when(there, away)
    if name in ("st_intersects", "st_disjoint"):
        meet = (ax <= bX) & (bx <= aX) & (ay <= bY) & (by <= aY)
        return F.when(there, meet if name == "st_intersects" else ~meet)
    if name == "st_within":
        (kind, (ax, ay, aX, aY)), (other, (bx, by, bX, bY)) = b, a
    if other != "Point":  # a point holds no box
        return None
    inside = (ax < bx) & (bx < aX) & (ay < by) & (by < aY) if kind == "BBox" else (ax == bx) & (ay == by)
    return F.when(there, inside)


def bbox_filter(query: str, d: float = 0.0, columns: tuple[str, str, str, str] = ("minx", "miny", "maxx", "maxy")) -> Column:
    """Plain comparisons that reach the Parquet scan: rows whose box columns come within ``d`` of a literal geometry's box."""
    x, y, x2, y2 = envelope(parse(query))
    minx, miny, maxx, maxy = columns
    return (F.col(maxx) >= x - d) & (F.col(minx) <= x2 + d) & (F.col(maxy) >= y - d) & (F.col(miny) <= y2 + d)
