"""The k most similar vectors of every vector, by search graphs over shards of the collection.

Vectors are routed to the clusters of their nearest centroids, on two levels where there are too many for one; a task builds the graph of its shard (greedy searches
propose neighbours, relaxed distance pruning keeps diverse edges) and searches it for the vectors of the shard. Exact
copies are one point of a graph, so that a vector repeated without end costs no more than one. Points of one direction
(copies of other length) share a place in the graph and are compared one by one; where more candidates tie than a walk
returns, all vectors of the graph are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.graph_index import BEAM, DEGREE, RELAX, SearchGraph
from tarnlake.plans.shared import materialized
from tarnlake.plans.skew import salted_join

#: Documented bounds: vectors that the centroids of a dimension count, or of one of its clusters, are fitted on;
#: centroids of one fit; vectors of a cluster aimed at; clusters that a vector is put in; vectors of a graph before its
#: cluster is split; vectors that a task routes to the inner clusters of a cluster at once.
SAMPLE, MOST_CLUSTERS, CLUSTER_SIZE, ROUTES, GRAPH_SIZE, SLICE = 20_000, 1024, 4000, 2, 16_000, 50_000
#: Fixed value: distance of unit vectors of one direction; float32 copies of other length come within about 1e-7.
NEAR = 1e-6


def row_id(high: str = "row_ids_high", low: str = "row_ids_low") -> Column:
    """high * 2^32 + low, both read as unsigned 32-bit words."""
    word = F.lit(0xFFFFFFFF).cast("bigint")
    return F.shiftleft(F.col(high).bitwiseAND(word), 32) + F.col(low).bitwiseAND(word)


def usable(blocks: DataFrame) -> DataFrame:
    """(id, dimensions, vectors) of the rows whose vector can be compared: not marked invalid, of the declared length, finite and not all zero."""
    v = F.col("vectors")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return blocks.filter(
        F.coalesce(F.col("valid"), F.lit(True)) & F.col("row_ids_high").isNotNull() & F.col("row_ids_low").isNotNull() & (F.size(v) == F.col("dimensions")) & finite & F.exists(v, lambda x: x != 0)
    ).select(row_id().alias("id"), "dimensions", "vectors")


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square overflows or vanishes."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _directions(unit: np.ndarray) -> np.ndarray:
    """A number for each unit vector, equal for those of one direction but for rounding (scaled copies, say).

    Vectors of one number are within 1e-5 of each other, so that their similarity is 1 at nine decimals. Vectors within
    ``NEAR`` have close projections on any axis; gaps on a few random axes separate all others, distances settle the rest.
    """
    label = np.zeros(len(unit), np.int64)
    axes = np.random.default_rng(3).normal(size=(4, unit.shape[1]))
    for axis in axes / np.linalg.norm(axes, axis=1, keepdims=True):
        at = unit @ axis
        order = np.lexsort((at, label))
        label[order] = np.concatenate([[0], np.cumsum((np.diff(label[order]) != 0) | (np.diff(at[order]) > NEAR))])
    order = np.argsort(label, kind="stable")
    count = len(label)
    for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        while len(rows) > 1:
            far = np.linalg.norm(unit[rows] - unit[rows[0]], axis=1) > 5 * NEAR
            rows = rows[far]
            label[rows] = count
            count += 1
    return np.unique(label, return_inverse=True)[1].reshape(-1)


def _centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit centroids of unit vectors by a few rounds of spherical k-means from a fixed seed."""
    rng = np.random.default_rng(11)
    sample = sample.astype(np.float32)
    centres = sample[rng.choice(len(sample), k, replace=len(sample) < k)]
    for _ in range(10):
        nearest = (sample @ centres.T).argmax(axis=1)
        for c in range(k):
            mine = sample[nearest == c]
            centre = mine.sum(axis=0) if len(mine) else sample[rng.integers(len(sample))]
            norm = np.linalg.norm(centre)
            centres[c] = centre / norm if norm > 0 else sample[rng.integers(len(sample))]
    return centres


def _fitted(unit: np.ndarray, k: int, n: float, routes: int, graph_size: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """``k`` centroids of a sample ``unit`` of ``n`` vectors, into how many graphs each cluster is split, and the cluster's vectors, about."""
    centres = _centroids(unit, k)
    near = np.argsort(-(unit.astype(np.float32) @ centres.T), axis=1, kind="stable")[:, :routes]
    size = np.bincount(near.ravel(), minlength=k) * (n / len(unit))
    return centres, [int(x) for x in np.maximum(1, np.ceil(size / graph_size))], size


def _routing(vectors: DataFrame, sample: int, routes: int, cluster_size: int, graph_size: int, most: int) -> dict[int, tuple[np.ndarray, list[int], np.ndarray | None]]:
    """Of each dimension count: centroids, into how many graphs each cluster is split, and, where the clusters have clusters of their own, their sizes.

    Up to ``most`` clusters of ``cluster_size`` there is one level. Beyond, the clusters of the first level are as many
    as each is to have of the second, so that a vector is compared with about the root of all clusters on either.
    """
    counts = {r["dimensions"]: r["n"] for r in vectors.groupBy("dimensions").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(1_000_000, -(-1_000_000 * sample // n)))])
    chosen = vectors.filter(F.pmod(F.xxhash64(F.col("id"), F.lit("centroids")), F.lit(1_000_000)) < share[F.col("dimensions")]).toArrow()
    routing = {}
    for d, n in counts.items():
        mine = chosen.filter(np.asarray(chosen.column("dimensions")) == d) if chosen.num_rows else chosen
        if not mine.num_rows:
            mine = vectors.filter(F.col("dimensions") == d).limit(1).toArrow()
        unit = _unit(np.stack(mine.column("vectors").to_numpy()))
        wanted = max(4, -(-n // cluster_size))
        deep = wanted > most
        k = int(min(most, len(unit), np.ceil(np.sqrt(wanted)) if deep else wanted))
        centres, parts, size = _fitted(unit, k, n, routes, graph_size)
        routing[d] = (centres, parts, size if deep else None)
    return routing


def _spread_over_parts(reps: np.ndarray, row: np.ndarray, cluster: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cluster, part, stored): each graph of a split cluster is asked, one of them stores the vector."""
    n = parts[cluster]
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, cluster, n = np.repeat(row, n), np.repeat(cluster, n), np.repeat(n, n)
    return row, cluster, part, part == reps[row] * 0x9E3779B1 % (1 << 31) % n


def _compare(queries: np.ndarray, asking: np.ndarray, unit: np.ndarray, rows: np.ndarray, n: int, into: list[list[tuple]]) -> None:
    """Add to ``into`` of each query in ``asking`` the ``n`` most similar of ``rows`` (ascending, so by smallest id if tied) with their similarity."""
    for part in np.array_split(asking, -(-len(asking) // 64)) if len(asking) else ():
        sims = np.round(queries[part] @ unit[rows].T, 9)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :n]
        for i, r, s in zip(part.tolist(), rows[top].tolist(), np.take_along_axis(sims, top, axis=1).tolist()):
            into[i].extend(zip(r, s))


_ROUTED = "d int, outer int, first boolean, rep bigint, ids array<bigint>, vectors array<float>"
_PLACED = "d int, cluster bigint, part int, stored boolean, rep bigint, ids array<bigint>, vectors array<float>"
_FOUND = "rep bigint, near array<struct<loss:double,id:bigint>>"


def nearest(
    blocks: DataFrame,
    k: int = 5,
    *,
    sample: int = SAMPLE,
    routes: int = ROUTES,
    cluster_size: int = CLUSTER_SIZE,
    graph_size: int = GRAPH_SIZE,
    most_clusters: int = MOST_CLUSTERS,
    degree: int = DEGREE,
    beam: int = BEAM,
    relax: float = RELAX,
) -> DataFrame:
    """(id, near): for each usable vector its ``k`` most similar others of the same dimensions, nearest first.

    ``near`` has structs of id and similarity: the cosine in double precision; similarities equal at nine decimals are
    tied, the smaller id first. Candidates come from graphs, so a few true neighbours may be missed (see the README for
    measured recall); their similarities are exact. Unusable vectors neither ask nor answer. An id delivered several
    times counts once; if its vectors differ, one of them is taken, the same each time. A vector without others of its
    dimensions has an empty list; an empty input gives an empty result.
    """
    mark = ["dimensions", "h1", "h2"]
    rows = materialized(usable(blocks).withColumns({"h1": F.xxhash64("vectors"), "h2": F.hash("vectors")}), "vectors")
    ids = materialized(rows.groupBy("id").agg(F.min(F.struct(*mark)).alias("m")).select("id", "m.*"), "vector-ids")
    # a copy beyond the first k + 1 ids can be nobody's neighbour; the rank limit is applied before the shuffle
    rank = F.row_number().over(Window.partitionBy(*mark).orderBy("id"))
    first = ids.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy(*mark).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = rows.groupBy(*mark).agg(F.max("vectors").alias("vectors")).join(first, mark)
    routing = _routing(rows, sample, routes, cluster_size, graph_size, most_clusters)

    def placed(pa, d: int, own, reps, row, cluster, part, stored):
        taken, n = own.take(pa.array(row, pa.int64())), len(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, d, np.int32)), pa.array(cluster, pa.int64()), pa.array(part, pa.int32()), pa.array(stored, pa.bool_()), pa.array(reps[row]), taken.column("ids"), taken.column("vectors")],
            names=["d", "cluster", "part", "stored", "rep", "ids", "vectors"],
        )

    def nearest_centres(batch, centres: np.ndarray, n: int) -> np.ndarray:
        unit = _unit(np.stack(batch.column("vectors").to_numpy(zero_copy_only=False))).astype(np.float32)
        return np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :n]

    def by_dimension(batches: Iterator, deep: bool) -> Iterator:
        """(dimensions, rows, their first ids, nearest centroids of the first level) of what is routed on one level, or on two."""
        import pyarrow as pa

        for batch in batches:
            dims = np.asarray(batch.column("dimensions"))
            for d in np.unique(dims).tolist():
                centres, _, sizes = routing[d]
                if (sizes is not None) == deep:
                    own = batch.filter(pa.array(dims == d))
                    yield d, own, np.array([x[0] for x in own.column("ids").to_pylist()], np.int64), nearest_centres(own, centres, routes)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for d, own, reps, near in by_dimension(batches, False):
            row = np.repeat(np.arange(len(near)), near.shape[1])
            yield placed(pa, d, own, reps, *_spread_over_parts(reps, row, near.ravel(), np.array(routing[d][1])))

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for d, own, reps, near in by_dimension(batches, True):
            for j in range(near.shape[1]):
                n = len(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, d, np.int32)), pa.array(near[:, j], pa.int32()), pa.array(np.full(n, j == 0)), pa.array(reps), own.column("ids"), own.column("vectors")],
                    names=["d", "outer", "first", "rep", "ids", "vectors"],
                )

    def fit_inner(key, table):
        import pyarrow as pa

        d, outer, size = key[0].as_py(), key[1].as_py(), key[2].as_py()
        unit = _unit(np.stack(table.column("vectors").to_numpy()))
        k_inner = int(min(most_clusters, len(unit), max(1, -(-size // cluster_size))))
        centres, parts, _ = _fitted(unit, k_inner, size, routes, graph_size)
        return pa.table({"d": pa.array([d], pa.int32()), "outer": pa.array([outer], pa.int32()), "slices": pa.array([int(-(-size // SLICE))], pa.int32()), "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float32())), "parts": pa.array([parts], pa.list_(pa.int32()))})

    def place_inner(key, left, right):
        import pyarrow as pa

        tables = [pa.RecordBatch.from_pylist([], schema=pa.schema([("d", pa.int32()), ("cluster", pa.int64()), ("part", pa.int32()), ("stored", pa.bool_()), ("rep", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float32()))]))]
        if left.num_rows and right.num_rows:
            d, outer = key[0].as_py(), key[1].as_py()
            own = left.combine_chunks().to_batches()[0]
            centres = np.array(right.column("centres")[0].as_py(), np.float32).reshape(-1, d)
            near = nearest_centres(own, centres, routes)
            reps, leads = np.asarray(own.column("rep")), np.asarray(own.column("first"))
            # of the nearest outer cluster as many inner ones as there are routes, of the others one
            keep = leads[:, None] | (np.arange(near.shape[1]) == 0)[None, :]
            row, column = np.nonzero(keep)
            row, cluster, part, stored = _spread_over_parts(reps, row, near[row, column], np.array(right.column("parts")[0].as_py()))
            tables.append(placed(pa, d, own, reps, row, (outer + 1) * 1_000_000 + cluster, part, stored))
        return pa.Table.from_batches(tables[-1:])

    def search(key, table):
        import pyarrow as pa

        table = table.sort_by("rep")
        unit = _unit(np.stack(table.column("vectors").to_numpy()))
        stored = np.flatnonzero(np.asarray(table.column("stored")))
        reps, ids = table.column("rep").to_pylist(), table.column("ids").to_pylist()
        direction = _directions(unit)
        # the stored points by direction, those of one direction by their smallest id; the first of each is in the graph
        members = stored[np.argsort(direction[stored], kind="stable")]
        groups = np.split(members, np.flatnonzero(np.diff(direction[members])) + 1) if len(members) else []
        leads, sizes = np.array([g[0] for g in groups], np.int64), np.array([len(g) for g in groups], np.int64)
        group_of = np.full(len(unit), -1)
        group_of[direction[leads]] = np.arange(len(leads))
        graph = SearchGraph(unit[leads], degree, beam, relax)
        width = max(2 * (k + 1), beam)
        near: list[list[dict]] = []
        for at in range(0, len(unit), 512):
            queries, own = unit[at : at + 512], group_of[direction[at : at + 512]]
            more: list[list[tuple]] = [[] for _ in queries]
            if len(stored):
                # a point that is in the graph begins at its neighbours there
                found, _ = graph.search(queries.astype(np.float32), width, first=np.where(own[:, None] >= 0, graph.edges[np.maximum(own, 0)], -1))
                rows_found = np.where(found >= 0, leads[np.maximum(found, 0)], -1)
                exact = np.where(found >= 0, np.einsum("qd,qcd->qc", queries, unit[np.maximum(rows_found, 0)]), -np.inf)
                sims = np.round(exact, 9)
                ordered = -np.sort(-exact, axis=1)
                least = ordered[:, k] if ordered.shape[1] > k else np.full(len(queries), -np.inf)
                # members of a direction are within 1e-5 of its lead; those of the query's own direction all have similarity 1
                open_groups = (found >= 0) & (sizes[np.maximum(found, 0)] > 1) & (exact + 1e-5 >= least[:, None]) & (found != own[:, None])
                for g in np.unique(found[open_groups]).tolist():
                    asking = np.flatnonzero((open_groups & (found == g)).any(axis=1))
                    _compare(queries, asking, unit, groups[g], k + 1, more)
                if found.shape[1] < len(leads):
                    tied = np.round(ordered[:, -1], 9) == np.round(least, 9)
                    _compare(queries, np.flatnonzero(tied), unit, stored, k + 2, more)
            else:
                rows_found, sims = np.full((len(queries), 1), -1), np.zeros((len(queries), 1))
            for i in range(len(queries)):
                me = at + i
                best = {x: 0.0 for x in ids[me]}  # copies of the vector are as near as can be
                for r in groups[own[i]][: k + 1].tolist() if own[i] >= 0 else ():
                    for x in ids[r]:
                        best.setdefault(x, 0.0)
                for r, s in [*zip(rows_found[i].tolist(), sims[i].tolist()), *more[i]]:
                    if r >= 0 and r != me:
                        for x in ids[r]:
                            best.setdefault(x, 1.0 - s)
                ranked = sorted((round(loss, 9) + 0.0, x) for x, loss in best.items())[: k + 1]
                near.append([{"loss": max(0.0, loss), "id": x} for loss, x in ranked])
        kind = pa.list_(pa.struct([("loss", pa.float64()), ("id", pa.int64())]))
        return pa.table({"rep": pa.array(reps, pa.int64()), "near": pa.array(near, kind)})

    shards = points.mapInArrow(place, _PLACED)
    deep = {d: sizes for d, (_, _, sizes) in routing.items() if sizes is not None}
    if deep:
        # the clusters of these dimension counts are too many for one fit: each has inner clusters, fitted by tasks on
        # samples, and its vectors are routed among them in slices
        sizes = F.create_map(*[F.lit(x) for d, ns in deep.items() for c, n in enumerate(ns.tolist()) for x in (f"{d}/{c}", float(max(n, 1.0)))])
        routed = materialized(points.filter(F.col("dimensions").isin(list(deep))).mapInArrow(route, _ROUTED), "routed").withColumn("size", sizes[F.concat_ws("/", "d", "outer")])
        share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("size")) * F.lit(1_000_000)
        chosen = routed.filter(F.pmod(F.xxhash64(F.col("rep"), F.lit("inner")), F.lit(1_000_000)) < share)
        inner = materialized(chosen.groupBy("d", "outer", "size").applyInArrow(fit_inner, "d int, outer int, slices int, centres array<float>, parts array<int>"), "inner")
        sliced = routed.withColumn("slice", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / F.lit(SLICE))).cast("int")).groupBy("d", "outer", "slice")
        repeated = inner.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).groupBy("d", "outer", "slice")
        shards = shards.unionByName(sliced.cogroup(repeated).applyInArrow(place_inner, _PLACED))
    found = shards.groupBy("d", "cluster", "part").applyInArrow(search, _FOUND)
    # a point asks at most routes + 1 clusters of a few graphs; each answers k + 1 rows
    merged = found.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))
    merged = materialized(merged, "vector-near")
    owners = first.select(*mark, F.col("ids")[0].alias("rep"), F.explode("ids").alias("id"))
    copies = first.filter(F.size("ids") > k).select(*mark, F.col("ids")[0].alias("rep"), F.col("ids")[k].alias("last"))
    late = salted_join(ids, copies, mark, F.col("id")).filter(F.col("id") > F.col("last")).select(*mark, "rep", "id")
    # only copies beyond the first k + 1 can make a point's answer wanted by many ids; those few points' answers are repeated
    hot = merged.join(copies.select("rep"), "rep", "left_semi")
    answers = owners.select("id", "rep").join(merged, "rep").select("id", "near").unionByName(salted_join(late.select("id", "rep"), hot, ["rep"], F.col("id")).select("id", "near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    shown = F.transform(others, lambda x: F.struct(x["id"].alias("id"), (F.lit(1.0) - x["loss"]).alias("similarity")))
    return answers.select("id", shown.alias("near"))


def nearest_pairs(blocks: DataFrame, k: int = 5, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of which one is among the other's ``k`` nearest, each once."""
    pairs = nearest(blocks, k, **options).select("id", F.explode("near.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
