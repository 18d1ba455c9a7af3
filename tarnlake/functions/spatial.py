"""Spatial calls of the builder by name; text is a literal geometry, columns are given by ``col``."""

from __future__ import annotations

import json
from typing import Any

from tarnlake.errors import LakeError
from tarnlake.functions import geometry as G
from tarnlake.functions.expr import Call, Expr, fn


def _call(name: str):
    def make(*args: Any) -> Call:
        return fn(name, *args)

    make.__name__ = name
    return make


st_point, st_bbox, st_envelope, st_x, st_y, st_area, st_length, st_centroid = map(_call, "st_point st_bbox st_envelope st_x st_y st_area st_length st_centroid".split())
st_intersects, st_disjoint, st_contains, st_within, st_dwithin, st_distance = map(_call, "st_intersects st_disjoint st_contains st_within st_dwithin st_distance".split())
h3_cell, h3_within, h3_parent = map(_call, "h3_cell h3_within h3_parent".split())


def h3_in(cell: Expr, cells: list[str]) -> Call:
    return fn("h3_in", cell, json.dumps(cells))


def as_geojson(geometry: Any) -> dict:
    """A geometry of any form as a GeoJSON object; a box becomes a polygon."""
    kind, rings = G.parse(json.dumps(geometry) if isinstance(geometry, dict) else geometry)
    points = [[list(p) for p in r] for r in rings]
    if kind == "Point":
        return {"type": "Point", "coordinates": points[0][0]}
    return {"type": "LineString", "coordinates": points[0]} if kind == "LineString" else {"type": "Polygon", "coordinates": points}


def from_geojson(value: dict) -> str:
    """The text of a GeoJSON object, checked."""
    if not isinstance(value, dict):
        raise LakeError("TYPE_ERROR", "GeoJSON must be an object")
    text = json.dumps(value, separators=(",", ":"))
    G.parse(text)
    return text
