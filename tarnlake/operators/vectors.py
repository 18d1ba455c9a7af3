"""Exact vector search, search in lists of nearest centroids, and rows by id, key or range."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.plans.compile import quoted
from tarnlake.plans.shared import scratch

#: Metric: whether greater scores are nearer.
METRICS = {"dot": True, "l2": False, "cosine-distance": False, "one-minus-dot": False, "cosine": False}
#: Vectors that centroids are fitted on, at most about.
SAMPLE = 20_000


def scores(vectors: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """``dot``: inner product; ``l2``: squared distance; ``cosine-distance``: 1 - cosine, NaN for a zero vector;
    ``one-minus-dot``; ``cosine``: 1 - cosine, 1 for a zero vector."""
    if metric in ("dot", "one-minus-dot"):
        dot = vectors @ query
        return dot if metric == "dot" else 1 - dot
    if metric == "l2":
        return ((vectors - query) ** 2).sum(axis=1)
    if metric not in METRICS:
        raise LakeError("INVALID_QUERY", f"unknown metric {metric}")
    norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)
    with np.errstate(divide="ignore", invalid="ignore"):
        result = 1 - (vectors @ query) / norms
    return np.where(norms > 0, result, np.nan if metric == "cosine-distance" else 1.0)


def nearest(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine-distance", vector: str = "embedding", id: str = "vec_id", select: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with their ``score``; NaN scores come last, ties go to the smaller id.

    Each task keeps its own best ``k``, so what is shuffled doesn't grow with the rows. Vectors that are null or of
    another length are left out.
    """
    q = np.asarray(query, np.float64)
    if metric not in METRICS or k < 1:
        raise LakeError("INVALID_QUERY", "unknown metric or no k")
    columns = [id, *[c for c in select if c != id]]
    sign = -1.0 if METRICS[metric] else 1.0

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.equal(pc.list_value_length(table.column("__v")), len(q)))
            if not table.num_rows:
                continue
            flat = table.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            s = scores(flat, q, metric)
            table = table.drop(["__v"]).append_column("score", pa.array(s)).append_column("__key", pa.array(np.where(np.isnan(s), np.inf, sign * s)))
            kept = table if kept is None else pa.concat_tables([kept, table])
            kept = kept.sort_by([("__key", "ascending"), (id, "ascending")]).slice(0, k)
        if kept is not None:
            yield from kept.drop(["__key"]).to_batches()

    kinds = ", ".join(f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in columns)
    local = df.filter(F.col(quoted(vector)).isNotNull()).select(*map(quoted, columns), F.col(quoted(vector)).cast("array<double>").alias("__v")).mapInArrow(best, f"{kinds}, score double")
    order = F.when(F.isnan("score"), F.lit(float("inf"))).otherwise(F.lit(sign) * F.col("score"))
    return local.orderBy(order, quoted(id)).limit(k)


def nearest_each(
    df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine-distance", vector: str = "embedding", id: str = "vec_id", select: Sequence[str] = (), lists: Mapping[Any, Sequence[int]] | None = None
) -> DataFrame:
    """``nearest`` for every row of ``queries`` (its ``id`` as ``query_id``, its ``vector``) at once, in one pass over ``df``.

    A task holds the queries and its best ``k`` rows of each. A query whose vector is null has no answers. ``lists`` names
    the lists (column ``list`` of ``df``) that each query id asks; without it all rows are asked.
    """
    if metric not in METRICS or k < 1:
        raise LakeError("INVALID_QUERY", "unknown metric or no k")
    asked = [(r[0], np.asarray(r[1], np.float64)) for r in queries.filter(F.col(quoted(vector)).isNotNull()).select(quoted(id), quoted(vector)).collect()]
    chosen = None if lists is None else [np.asarray(lists.get(q, ()), np.int64) for q, _ in asked]
    columns = [id, *[c for c in select if c != id]]
    sign = -1.0 if METRICS[metric] else 1.0
    many = len(asked)

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = None
        for batch in batches:
            whole, found = pa.Table.from_batches([batch]), []
            for length in {len(q) for _, q in asked}:
                table = whole.filter(pc.equal(pc.list_value_length(whole.column("__v")), length))
                if not table.num_rows:
                    continue
                flat = table.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
                place = table.column("__list").to_numpy() if lists is not None else None
                bare = table.drop(["__v", "__list"] if lists is not None else ["__v"])
                for i, (_, q) in enumerate(asked):
                    rows = np.arange(len(flat)) if place is None else np.flatnonzero(np.isin(place, chosen[i]))
                    if len(q) != length or not len(rows):
                        continue
                    s = scores(flat[rows], q, metric)
                    part = bare.take(pa.array(rows)).append_column("score", pa.array(s)).append_column("__key", pa.array(np.where(np.isnan(s), np.inf, sign * s)))
                    part = part.sort_by([("__key", "ascending"), (id, "ascending")]).slice(0, k)
                    found.append(part.append_column("__query", pa.array(np.full(part.num_rows, i, np.int32))))
            if found:
                kept = pa.concat_tables(found if kept is None else [kept, *found]).sort_by([("__query", "ascending"), ("__key", "ascending"), (id, "ascending")])
                of = kept.column("__query").to_numpy()
                kept = kept.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < k))
        if kept is not None:
            yield from kept.drop(["__key"]).to_batches()

    kinds = ", ".join(f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in columns)
    read = [F.col(quoted(vector)).cast("array<double>").alias("__v"), *([F.col("list").alias("__list")] if lists is not None else [])]
    local = df.filter(F.col(quoted(vector)).isNotNull()).select(*map(quoted, columns), *read).mapInArrow(best, f"{kinds}, score double, __query int")
    names = df.sparkSession.createDataFrame([(i, asked[i][0]) for i in range(many)], f"__query int, query_id {queries.schema[id].dataType.simpleString()}")
    return _first_of_each(local.join(names, "__query").select("query_id", *map(quoted, columns), "score"), k, metric, id)


def _first_of_each(found: DataFrame, k: int, metric: str, id: str) -> DataFrame:
    """The ``k`` nearest of each ``query_id``."""
    order = F.when(F.isnan("score"), F.lit(float("inf"))).otherwise(F.lit(-1.0 if METRICS[metric] else 1.0) * F.col("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, quoted(id)))
    return found.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def merge_nearest(lists: Sequence[DataFrame], k: int, metric: str, id: str = "vec_id") -> DataFrame:
    """The ``k`` nearest of several results of ``nearest``."""
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    sign = -1.0 if METRICS[metric] else 1.0
    order = F.when(F.isnan("score"), F.lit(float("inf"))).otherwise(F.lit(sign) * F.col("score"))
    return merged.orderBy(order, quoted(id)).limit(k)


class ListIndex:
    """Vectors stored in lists by their nearest centroid; a search reads the lists of the ``nprobes`` nearest centroids only."""

    def __init__(self, df: DataFrame, vector: str = "embedding", id: str = "vec_id", lists: int = 16, metric: str = "l2", centroids: np.ndarray | None = None):
        self.vector, self.id, self.metric = vector, id, metric
        whole = df.filter(F.col(quoted(vector)).isNotNull())
        if centroids is None:
            n = whole.count()
            sample = whole.select(id, vector).filter(F.pmod(F.xxhash64(quoted(id)), F.lit(1_000_000)) < min(1_000_000, -(-1_000_000 * SAMPLE // max(n, 1))))
            points = np.array([r[1] for r in sample.collect()], np.float64)
            rng = np.random.default_rng(5)
            centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)] if len(points) else np.zeros((1, 1))
            for _ in range(10 * bool(len(points))):
                near = ((points[:, None] - centroids[None]) ** 2).sum(-1).argmin(1) if len(points) * len(centroids) < 4_000_000 else (-2 * points @ centroids.T + (centroids**2).sum(1)).argmin(1)
                centroids = np.stack([points[near == c].mean(0) if (near == c).any() else centroids[c] for c in range(len(centroids))])
        self.centroids = centroids
        c = centroids

        def assign(batches: Iterator) -> Iterator:
            for pdf in batches:
                v = np.stack(pdf[vector].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, c.shape[1]))
                yield pdf.assign(list=(-2 * v @ c.T + (c**2).sum(1)).argmin(1).astype("int32") if len(pdf) else [])

        kinds = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
        # stored by list, so that a search reads the folders of the lists it probes and no others
        root = scratch(df.sparkSession, "lists")
        whole.mapInPandas(assign, f"{kinds}, list int").hint("rebalance", "list").write.partitionBy("list").parquet(root)
        self.table = df.sparkSession.read.schema(f"{kinds}, list int").parquet(root)

    def search(self, query: Sequence[float], k: int, nprobes: int = 1, select: Sequence[str] = ()) -> DataFrame:
        """Exact scores within the chosen lists; all lists give the exact result."""
        q = np.asarray(query, np.float64)
        near = np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")[:nprobes].tolist()
        return nearest(self.table.filter(F.col("list").isin(near)), query, k, self.metric, self.vector, self.id, select)

    def search_each(self, queries: DataFrame, k: int, nprobes: int = 1, select: Sequence[str] = (), complete: bool = False) -> DataFrame:
        """``search`` for every row of ``queries`` at once (see ``nearest_each``).

        With ``complete`` the result is exact for any ``nprobes``: the lists probed first give each query the distance of
        its k-th row, and every other list that may hold a row within it (by the triangle inequality, from the list's
        radius) is read as well; of metrics other than ``l2``, which have no such bound, all other lists.
        """
        asked = [(r[0], np.asarray(r[1], np.float64)) for r in queries.filter(F.col(quoted(self.vector)).isNotNull()).select(quoted(self.id), quoted(self.vector)).collect()]
        away = {q: np.sqrt(((self.centroids - v) ** 2).sum(1)) for q, v in asked}
        near = {q: np.argsort(d, kind="stable")[:nprobes].tolist() for q, d in away.items()}
        first = nearest_each(self.table, queries, k, self.metric, self.vector, self.id, select, near)
        if not complete:
            return first
        rest = {q: [c for c in range(len(self.centroids)) if c not in near[q]] for q in away}
        if self.metric == "l2":
            worst = {r["query_id"]: r["worst"] for r in first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("worst")).filter(F.col("n") == k).collect()}
            radius = self._radii()
            # the slack covers rounding, so that a tie with the k-th row isn't ruled out
            rest = {q: [c for c in cs if away[q][c] - radius[c] <= np.sqrt(worst.get(q, np.inf)) * (1 + 1e-9) + 1e-9 * (1 + away[q][c])] for q, cs in rest.items()}
        second = nearest_each(self.table, queries, k, self.metric, self.vector, self.id, select, rest)
        return _first_of_each(first.unionByName(second), k, self.metric, self.id)

    def _radii(self) -> np.ndarray:
        """Of each list the distance of its farthest vector from its centroid; infinite where a vector isn't finite, -inf for an empty list."""
        c, vector = self.centroids, self.vector

        def far(batches: Iterator) -> Iterator:
            import pandas as pd

            most = np.full(len(c), -np.inf)
            for pdf in batches:
                if len(pdf):
                    v, place = np.stack(pdf[vector].to_numpy()).astype(np.float64), pdf["list"].to_numpy()
                    d = np.sqrt(((v - c[place]) ** 2).sum(1))
                    np.maximum.at(most, place, np.where(np.isfinite(d), d, np.inf))
            yield pd.DataFrame({"list": np.arange(len(c), dtype=np.int32), "radius": most})

        radius = np.full(len(c), -np.inf)
        for r in self.table.select(quoted(vector), "list").mapInPandas(far, "list int, radius double").groupBy("list").agg(F.max("radius").alias("radius")).collect():
            radius[r["list"]] = r["radius"]
        return radius


def take_rows(df: DataFrame, ids: Sequence[Any], id: str, select: Sequence[str] | None = None, on_missing: str = "error", snapshot: Any = None, expected: Any = None) -> DataFrame:
    """The rows of the given ids in the caller's order (column ``__pos``), repeated as asked for.

    Ids that aren't there are an error, or rows of nulls with ``on_missing="null"``. ``snapshot`` is what the ids were
    taken from; another than ``expected`` is refused.
    """
    if expected is not None and snapshot != expected:
        raise LakeError("SNAPSHOT_MISMATCH", "the row ids are of another snapshot", {"snapshot": snapshot, "expected": expected})
    spark: SparkSession = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"__pos bigint, __id {kind}")
    chosen = df.filter(F.col(quoted(id)).isin(list(dict.fromkeys(ids)))) if len(ids) <= 1000 else df
    columns = list(select) if select is not None else df.columns
    joined = asked.join(chosen.withColumn("__found", F.lit(True)), F.col("__id") == F.col(quoted(id)), "left")
    if on_missing == "error":
        missing = [r[0] for r in joined.filter("__found is null").select("__id").limit(10).collect()]
        if missing:
            raise LakeError("NOT_FOUND", "rows are missing", {"ids": missing})
    return joined.orderBy("__pos").select("__pos", *map(quoted, columns))


def lookup_rows(df: DataFrame, keys: Sequence[Any], key: str, id: str, select: Sequence[str] | None = None) -> DataFrame:
    """The rows of each key in the caller's order of keys, then by id; a repeated key gives its rows again."""
    kind = df.schema[key].dataType.simpleString()
    asked = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(keys)], f"__pos bigint, __key {kind}")
    columns = list(select) if select is not None else df.columns
    return asked.join(df, F.col("__key") == F.col(quoted(key))).orderBy("__pos", quoted(id)).select("__pos", *map(quoted, columns))


def range_rows(df: DataFrame, key: str, id: str, lower: Any = None, upper: Any = None, include_lower: bool = True, include_upper: bool = True) -> DataFrame:
    """The rows whose key is within the bounds, in order of key and id; nulls are in no range."""
    c, inside = F.col(quoted(key)), F.col(quoted(key)).isNotNull()
    if lower is not None:
        inside &= c >= lower if include_lower else c > lower
    if upper is not None:
        inside &= c <= upper if include_upper else c < upper
    return df.filter(inside).orderBy(quoted(key), quoted(id))
