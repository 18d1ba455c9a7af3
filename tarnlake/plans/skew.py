"""Joins and neighbours that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALT = "__salt"


#: Bytes, by the optimizer's estimate, up to which a side of a join is broadcast.
BROADCAST_BYTES = 8 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size: of a table its files, of what is derived from one seldom less than it has."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", salts: int = 24) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, no key's rows of ``left`` in one task alone.

    A ``right`` of at most ``BROADCAST_BYTES`` is broadcast, which leaves ``left`` where it is. A larger one is repeated
    ``salts`` times and shuffled, never broadcast, and each key's rows of ``left`` go to ``salts`` tasks; ``spread`` is
    hashed to choose the task, so it should differ between the rows of a key. Null keys match null keys. ``how``: inner,
    left, left_semi or left_anti.
    """
    small = plan_bytes(right) <= BROADCAST_BYTES
    if small:
        left_salt, right_salt = F.lit(0), F.lit(0)
    else:
        left_salt, right_salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    lhs, rhs = left.withColumn(_SALT, left_salt).alias("l"), right.withColumn(_SALT, right_salt).hint("broadcast" if small else "merge").alias("r")
    on = F.lit(True) if small else F.col(f"l.{_SALT}") == F.col(f"r.{_SALT}")
    for k in keys:
        on &= F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    joined = lhs.join(rhs, on, how)
    kept = [F.col(f"l.`{c}`") for c in left.columns]
    if how not in ("left_semi", "left_anti"):
        kept += [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return joined.select(*kept)


def neighbours(df: DataFrame, group: Sequence[str], order: str, block: int = 4096) -> DataFrame:
    """The distinct (``group``, ``order``) of ``df`` with the value before and after in ``__prev`` and ``__next``.

    ``order`` is an integer column. A window over a whole group would put a group with a third of all rows into one
    task; here windows run inside blocks of ``block`` consecutive values, and only one row of each block is compared
    across blocks.
    """
    keys = df.select(*group, order).distinct().withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    inner = Window.partitionBy(*group, "__block").orderBy(order)
    outer = Window.partitionBy(*group).orderBy("__block")
    blocks = (
        keys.groupBy(*group, "__block")
        .agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
        .withColumns({"__before": F.lag("__hi").over(outer), "__after": F.lead("__lo").over(outer)})
        .drop("__lo", "__hi")
    )
    return (
        keys.withColumns({"__prev": F.lag(order).over(inner), "__next": F.lead(order).over(inner)})
        .join(blocks, [*group, "__block"])
        .select(*group, order, F.coalesce("__prev", "__before").alias("__prev"), F.coalesce("__next", "__after").alias("__next"))
    )
