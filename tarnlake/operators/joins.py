"""Joins of the builder: equal keys with null matching null, lookups, products; limits on sizes only where asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.plans.compile import quoted
from tarnlake.plans.skew import BROADCAST_BYTES, plan_bytes

#: Rows that the right side of a product may have.
PRODUCT_ROWS = 100_000
TYPES = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti", "right": "right", "full": "full"}


def _guard(df: DataFrame, most: int | None, what: str) -> None:
    if most is not None and df.limit(most + 1).count() > most:
        raise LakeError("JOIN_LIMIT_EXCEEDED", f"more than {most} {what}", {"limit": most})


def renamed_right(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], prefix: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``right`` under names that don't clash: all columns get private names; those shown get their own or a prefixed one."""
    private = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    shown: dict[str, str] = {}
    taken = set(left.columns)
    for c in right.columns:
        if c in right_keys and c in left_keys:
            continue
        new = c if c not in taken else prefix + c
        while new in taken:
            new = prefix + new
        shown[c] = new
        taken.add(new)
    return right.select(*[F.col(quoted(c)).alias(p) for c, p in private.items()]), private, list(shown.items())


def hash_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str | Sequence[str],
    right_key: str | Sequence[str],
    how: str = "inner",
    right_prefix: str = "right.",
    max_right_rows: int | None = None,
    max_output_rows: int | None = None,
    small_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` of equal keys; a null key equals a null key.

    ``how``: inner, left, right, full, semi or anti. A right key of the same name is shown once, other clashing names of
    the right get ``right_prefix``. Columns without match are null. The right side is broadcast only if the optimizer
    takes it for at most ``small_bytes``; otherwise both sides are shuffled, and AQE splits skewed keys and broadcasts a
    side that turns out small.
    """
    lk, rk = ([left_key] if isinstance(left_key, str) else list(left_key)), ([right_key] if isinstance(right_key, str) else list(right_key))
    if how not in TYPES:
        raise LakeError("INVALID_QUERY", f"unknown join type {how}")
    if len(lk) != len(rk) or not lk:
        raise LakeError("INVALID_QUERY", "both sides of a join need the same number of keys")
    for df, keys in ((left, lk), (right, rk)):
        for k in keys:
            if k not in df.columns:
                raise LakeError("UNKNOWN_COLUMN", f"unknown join key {k}", {"column": k})
    _guard(right, max_right_rows, "rows on the right of a join")
    side, private, shown = renamed_right(left, right, lk, rk, right_prefix)
    if how in ("inner", "left", "semi", "anti") and plan_bytes(side) <= small_bytes:
        side = F.broadcast(side)
    on: Column = F.lit(True)
    for a, b in zip(lk, rk):
        on = on & F.col(quoted(a)).eqNullSafe(F.col(private[b]))
    joined = left.join(side, on, TYPES[how])
    if how in ("semi", "anti"):
        return joined
    keys = dict(zip(lk, rk))
    base = [F.coalesce(F.col(quoted(c)), F.col(private[keys[c]])).alias(c) if how in ("right", "full") and keys.get(c) == c else F.col(quoted(c)) for c in left.columns]
    out = joined.select(*base, *[F.col(private[c]).alias(n) for c, n in shown])
    _guard(out, max_output_rows, "rows out of a join")
    return out


def lookup_join(left: DataFrame, lookup: Callable[[list[tuple]], list[dict]], left_key: str | Sequence[str], right_key: str | Sequence[str], right_schema: str, how: str = "inner", right_prefix: str = "right.") -> DataFrame:
    """``left`` joined to what ``lookup`` finds: it gets lists of distinct keys in a task and returns rows for them.

    Each distinct key is looked up once. Rows whose key isn't among those asked for are dropped, as the key is compared
    again by the join.
    """
    lk = [left_key] if isinstance(left_key, str) else list(left_key)

    def fetch(batches):
        import pandas as pd

        for pdf in batches:
            rows = lookup(list(pdf.itertuples(index=False, name=None))) if len(pdf) else []
            yield pd.DataFrame(rows, columns=names)

    probe = left.sparkSession.createDataFrame([], right_schema)
    names = probe.columns
    found = left.select(*map(quoted, lk)).distinct().mapInPandas(fetch, right_schema)
    return hash_join(left, found, lk, right_key, how, right_prefix, small_bytes=-1)


def cross_join(left: DataFrame, right: DataFrame, max_right_rows: int = PRODUCT_ROWS, max_output_rows: int | None = None, right_prefix: str = "right.") -> DataFrame:
    """All pairs. The right side must have at most ``max_right_rows`` rows, which is counted; it is broadcast if it is small in bytes too."""
    _guard(right, max_right_rows, "rows on the right of a product")
    side, private, shown = renamed_right(left, right, [], [], right_prefix)
    out = left.crossJoin(F.broadcast(side) if plan_bytes(side) <= BROADCAST_BYTES else side).select(*[F.col(quoted(c)) for c in left.columns], *[F.col(private[c]).alias(n) for c, n in shown])
    _guard(out, max_output_rows, "rows out of a product")
    return out
