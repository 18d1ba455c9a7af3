"""Aggregates of the builder: what each operation gives, also of nothing, and which need an order of the source's rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.plans.compile import Compiler, quoted
from tarnlake.plans.shared import materialized

OPS = (
    "count sum avg var_samp var_pop stddev_samp stddev_pop median quantile min max count_distinct approx_count_distinct mode first last any".split()
)
ORDERED = ("first", "last", "any", "mode")


@dataclass(frozen=True)
class Agg:
    """An aggregate: operation, what of (a column or expression; nothing counts rows) and the fraction of a quantile."""

    op: str
    of: str | X.Expr | None = None
    quantile: float | None = None

    def expr(self) -> X.Expr | None:
        return X.col(self.of) if isinstance(self.of, str) else self.of


def _one(a: Agg, x: Column | None, kind: str, ordinal: str | None) -> Column | None:
    """The aggregate as a column, or None if it needs the frequencies of values."""
    if a.op not in OPS:
        raise LakeError("INVALID_QUERY", f"unknown aggregate {a.op}")
    if x is None:
        if a.op != "count":
            raise LakeError("INVALID_QUERY", f"{a.op} needs a column or expression")
        return F.count(F.lit(1))
    if a.op in ("sum", "avg", "var_samp", "var_pop", "stddev_samp", "stddev_pop", "quantile") and kind not in ("number", "null"):
        raise LakeError("TYPE_ERROR", f"{a.op} needs numbers, not {kind}")
    if a.op in ORDERED and ordinal is None:
        raise LakeError("INVALID_QUERY", f"{a.op} needs a source whose rows have an order")
    simple = {
        "count": F.count,
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
        "avg": F.avg,
        "var_samp": F.var_samp,
        "var_pop": F.var_pop,
        "stddev_samp": F.stddev_samp,
        "stddev_pop": F.stddev_pop,
        "min": F.min,
        "max": F.max,
        "count_distinct": F.count_distinct,
        "approx_count_distinct": F.count_distinct,  # exact: same values on every run
    }
    if a.op in simple:
        return simple[a.op](x)
    if a.op in ("first", "any"):
        return F.min_by(x, F.col(ordinal))
    if a.op == "last":
        return F.max_by(x, F.col(ordinal))
    if a.op == "quantile":
        if a.quantile is None or not 0 <= a.quantile <= 1:
            raise LakeError("INVALID_QUERY", "a quantile's fraction must be from 0 to 1")
        return F.percentile(x, a.quantile)
    if a.op == "median" and kind != "string":
        return F.median(x)
    return None


def aggregate(df: DataFrame, keys: list[str], spec: dict[str, Agg], ordinal: str | None = None) -> DataFrame:
    """One row per distinct ``keys`` (nulls are a value; one row in all without keys) with the aggregates of ``spec``.

    Of no values, ``sum`` gives 0, counts 0 and the others null; sample variances need two. ``first``, ``last`` and
    ``any`` count nulls and follow ``ordinal``; ``mode`` takes the first seen of equally frequent values. ``mode`` and the
    median of texts work on value frequencies, counted before any shuffle of rows; so no group is gathered.
    """
    compiler = Compiler(df, box_columns=False)
    for k in keys:
        compiler.compile(X.col(k))
    simple: dict[str, Column] = {}
    by_value: dict[str, tuple[Agg, Column]] = {}
    for alias, a in spec.items():
        e = a.expr()
        typed = compiler.compile(e) if e is not None else None
        c = _one(a, typed.column if typed else None, typed.kind if typed else "null", ordinal)
        if c is None:
            by_value[alias] = (a, typed.column)
        else:
            simple[alias] = c
    names = [quoted(k) for k in keys]
    hidden = not simple
    columns = [c.alias(k) for k, c in simple.items()] or [F.count(F.lit(1)).alias("__n")]
    out = df.groupBy(*names).agg(*columns)
    for alias, (a, x) in by_value.items():
        grouped = df.select(*names, x.alias("__x"), *([F.col(ordinal)] if a.op == "mode" else [])).filter(F.col("__x").isNotNull())
        if a.op == "mode":
            counts = grouped.groupBy(*names, "__x").agg(F.count("*").alias("__c"), F.min(ordinal).alias("__first"))
            best = counts.groupBy(*names).agg(F.min_by("__x", F.struct(-F.col("__c"), F.col("__first"))).alias(alias))
        else:
            # values lie in ranges, a range to a task; only the ranges' totals are added up across tasks
            counts = grouped.groupBy(*names, "__x").agg(F.count("*").alias("__c"))
            ranged = materialized(counts.repartitionByRange(*names, "__x").withColumn("__part", F.spark_partition_id()), "median")
            parts = ranged.groupBy(*names, "__part").agg(F.sum("__c").alias("__n"))
            before = F.sum("__n").over(W.partitionBy(*names).orderBy("__part")) - F.col("__n")
            parts = parts.withColumns({"__before": before, "__total": F.sum("__n").over(W.partitionBy(*names))})
            middle = F.floor((F.col("__total") - 1) / 2)
            parts = parts.filter((F.col("__before") <= middle) & (F.col("__before") + F.col("__n") > middle)).select(*[F.col(n).alias(f"__p{i}") for i, n in enumerate(names)], F.col("__part").alias("__at"), "__before", "__total")
            same = F.col("__part") == F.col("__at")
            for i, n in enumerate(names):
                same &= F.col(n).eqNullSafe(F.col(f"__p{i}"))
            upto = F.col("__before") + F.sum("__c").over(W.partitionBy(*names, "__part").orderBy("__x"))
            placed = ranged.join(parts, same).withColumn("__upto", upto)
            best = placed.filter(F.col("__upto") > F.floor((F.col("__total") - 1) / 2)).groupBy(*names).agg(F.min("__x").alias(alias))
        if keys:
            right = best.select(*[F.col(n).alias(f"__k{i}") for i, n in enumerate(names)], quoted(alias))
            on = F.lit(True)
            for i, n in enumerate(names):
                on &= out[n].eqNullSafe(right[f"__k{i}"])
            out = out.join(right, on, "left").drop(*[f"__k{i}" for i in range(len(names))])
        else:
            out = out.crossJoin(F.broadcast(best))  # one row each
    order = [*keys, *spec]
    return (out.drop("__n") if hidden else out).select(*map(quoted, order))
