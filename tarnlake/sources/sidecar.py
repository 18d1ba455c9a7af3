"""Indexes beside the files: least and greatest values, boxes and cells per file, by which files are left unread."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import expr as X
from tarnlake.functions import geometry
from tarnlake.functions.text import unescaped
from tarnlake.plans.compile import quoted


def build_index(spark: SparkSession, paths: list[str], columns: list[str], boxes: dict[str, tuple[str, str, str, str]] | None = None, cells: list[str] | None = None) -> list[dict]:
    """An entry per file: min and max of columns, the box of box columns, the distinct cells of cell columns. One pass over the files."""
    df: DataFrame = spark.read.parquet(*paths)
    parts = [F.struct(F.min(quoted(c)).alias("min"), F.max(quoted(c)).alias("max"), F.count_if(F.col(quoted(c)).isNull()).alias("nulls")).alias(f"c{i}") for i, c in enumerate(columns)]
    for name, (minx, miny, maxx, maxy) in (boxes or {}).items():
        parts.append(F.struct(F.min(minx).alias("minx"), F.min(miny).alias("miny"), F.max(maxx).alias("maxx"), F.max(maxy).alias("maxy")).alias(f"b_{name}"))
    parts += [F.sort_array(F.collect_set(quoted(c))).alias(f"h_{c}") for c in cells or []]
    out = []
    for r in df.groupBy(unescaped(F.col("_metadata.file_path")).alias("path")).agg(*parts).collect():
        entry: dict[str, Any] = {"path": r["path"], "columns": {c: r[f"c{i}"].asDict() for i, c in enumerate(columns)}}
        if boxes:
            entry["bbox"] = {n: r[f"b_{n}"].asDict() for n in boxes}
        if cells:
            entry["h3"] = {c: r[f"h_{c}"] for c in cells}
        entry["path"] = re.sub("^file:/+", "file:/", entry["path"])  # as the file system's client names it
        out.append(entry)
    return sorted(out, key=lambda e: e["path"])


def prune(index: list[dict], where: X.Expr | None) -> tuple[list[dict], list[dict]]:
    """The entries of files that may hold matching rows, and those that can't."""
    planned, skipped = [], []
    for entry in sorted(index, key=lambda e: e["path"]):
        (planned if where is None or _may(entry, where) else skipped).append(entry)
    return planned, skipped


def _may(entry: dict, e: X.Expr) -> bool:
    match e:
        case X.Logical("and", xs):
            return all(_may(entry, x) for x in xs)
        case X.Logical(_, xs):
            return any(_may(entry, x) for x in xs)
        case X.Compare(op, X.ColumnRef(c), X.Literal(v)):
            return _range(entry, c, op, v)
        case X.Compare(op, X.Literal(v), X.ColumnRef(c)):
            return _range(entry, c, {"lt": "gt", "gt": "lt", "lte": "gte", "gte": "lte"}.get(op, op), v)
        case X.Between(X.ColumnRef(c), X.Literal(low), X.Literal(high), False):
            return _range(entry, c, "gte", low) and _range(entry, c, "lte", high)
        case X.In(X.ColumnRef(c), vs, False) if all(isinstance(v, X.Literal) for v in vs):
            return any(_range(entry, c, "eq", v.value) for v in vs)
        case X.Call("h3_in", (X.ColumnRef(c), X.Literal(str() as text))):
            import json

            own = entry.get("h3", {}).get(c)
            return own is None or bool(set(own) & set(json.loads(text)))
        case X.Call("st_intersects" | "st_within" | "st_contains" | "st_dwithin", args):
            column = next((a.name for a in args if isinstance(a, X.ColumnRef)), None)
            text = next((a.value for a in args if isinstance(a, X.Literal) and isinstance(a.value, str)), None)
            b = entry.get("bbox", {}).get(column)
            if b is None or text is None or b["minx"] is None:
                return True
            d = float(args[2].value) if e.fn == "st_dwithin" and isinstance(args[2], X.Literal) else 0.0
            x, y, x2, y2 = geometry.envelope(geometry.parse(text))
            return b["maxx"] >= x - d and b["minx"] <= x2 + d and b["maxy"] >= y - d and b["miny"] <= y2 + d
    return True


def _range(entry: dict, column: str, op: str, v: Any) -> bool:
    stats = entry.get("columns", {}).get(column)
    if not stats:
        return True
    low, high = stats["min"], stats["max"]
    if any(isinstance(x, float) and math.isnan(x) for x in (low, high, v)):
        return True  # NaN is greatest in Spark, so the file's other values are unknown
    if v is None or low is None or high is None:
        return False  # a comparison with null is never true, and neither is one with a column that is null throughout
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if type(low) is not type(v) and not (number(low) and number(v)):
        return True
    return {"eq": low <= v <= high, "ne": not (low == v == high), "lt": low < v, "lte": low <= v, "gt": high > v, "gte": high >= v}[op]
