"""Aggregates as states that can be stored, merged and finished later: what a refresh or a resumed run adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.operators.aggregates import Agg
from tarnlake.plans.compile import Compiler, quoted

_MOMENTS = ("avg", "var_samp", "var_pop", "stddev_samp", "stddev_pop", "sum", "count")


def partial(df: DataFrame, keys: list[str], spec: dict[str, Agg]) -> DataFrame:
    """One row per group with the state of each aggregate: count, sum, mean square deviation, least and greatest.

    Order-dependent and holistic aggregates (first, mode, median, distinct counts) have no state of bounded size and are
    refused.
    """
    compiler = Compiler(df, False)
    parts = []
    for alias, a in spec.items():
        if a.op not in (*_MOMENTS, "min", "max"):
            raise LakeError("INVALID_QUERY", f"{a.op} has no state of bounded size")
        e = a.expr()
        x = compiler.column(e) if e is not None else F.lit(1)
        if a.op in ("min", "max"):
            parts.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(alias))
        elif a.op in ("count", "sum"):
            parts.append(F.struct(F.count(x).alias("n"), F.sum(x.cast("double")).alias("s")).alias(alias) if e is not None and a.op == "sum" else F.struct(F.count(x).alias("n"), F.lit(0.0).alias("s")).alias(alias))
        else:
            parts.append(F.struct(F.count(x).alias("n"), F.sum(x.cast("double")).alias("s"), (F.var_pop(x) * F.count(x)).alias("m2")).alias(alias))
    return df.groupBy(*map(quoted, keys)).agg(*parts)


def merge(states: list[DataFrame], keys: list[str], spec: dict[str, Agg]) -> DataFrame:
    """The states of several parts as one; deviations are combined about the common mean, which stays exact for far-off parts."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    parts = []
    for alias, a in spec.items():
        c = lambda f: F.col(f"{quoted(alias)}.{f}")  # noqa: B023, E731
        if a.op in ("min", "max"):
            parts.append(F.struct(F.min(c("lo")).alias("lo"), F.max(c("hi")).alias("hi")).alias(alias))
        elif a.op in ("count", "sum"):
            parts.append(F.struct(F.sum(c("n")).alias("n"), F.sum(c("s")).alias("s")).alias(alias))
        else:
            n, s = F.sum(c("n")), F.sum(c("s"))
            square = F.sum(F.when(c("n") > 0, c("s") * c("s") / c("n")))
            m2 = F.sum(c("m2")) + F.greatest(square - F.try_divide(s * s, n), F.lit(0.0))
            parts.append(F.struct(n.alias("n"), s.alias("s"), m2.alias("m2")).alias(alias))
    return union.groupBy(*map(quoted, keys)).agg(*parts)


def finish(state: DataFrame, keys: list[str], spec: dict[str, Agg]) -> DataFrame:
    """The results of states, as ``aggregates.aggregate`` gives them."""
    out = []
    for alias, a in spec.items():
        c = lambda f: F.col(f"{quoted(alias)}.{f}")  # noqa: B023, E731
        if a.op in ("min", "max"):
            x = c("lo" if a.op == "min" else "hi")
        elif a.op == "count":
            x = F.coalesce(c("n"), F.lit(0))
        elif a.op == "sum":
            x = F.coalesce(c("s"), F.lit(0.0))
        elif a.op == "avg":
            x = F.try_divide(c("s"), c("n"))
        else:
            sample = a.op.endswith("samp")
            x = F.when(c("n") > (1 if sample else 0), c("m2") / (c("n") - (1 if sample else 0)))
            x = F.sqrt(x) if a.op.startswith("stddev") else x
        out.append(x.alias(alias))
    return state.select(*map(quoted, keys), *out)


def resumed(df: DataFrame, keys: list[str], spec: dict[str, Agg], state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(results, state) of ``df`` after an earlier ``state``."""
    now = partial(df, keys, spec)
    whole = now if state is None else merge([state, now], keys, spec)
    return finish(whole, keys, spec), whole


