"""Mixing sources to target weights: equal-token blocks apportioned by highest quotients (Sainte-Laguë), then chosen by a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.encoding import FOLDER, NAME, token_counts
from tarnlake.plans.shared import materialized

BLOCK = 256
#: Documents of one shard, about; a shard of a source is ordered in one task.
SHARD_DOCUMENTS = 50_000
#: Fixed value: a prime above any number of blocks of a shard.
STEP = 1_000_000_007


def source_name(c: Column) -> Column:
    """A source's canonical spelling: lower case, hyphens for underscores and white space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s_\p{Z}-]+", "-"), "^-+|-+$", "")


def apportion(weights: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Whole seats by highest quotients weight / (2k + 1), none above its cap; the first of equal quotients goes first.

    If the caps don't allow all seats, all that they allow are given. The common divisor is found by bisection, so that
    the work doesn't grow with ``seats``; the last few seats are settled one by one.
    """
    weights, caps = np.asarray(weights, float), np.where(np.asarray(weights, float) > 0, np.asarray(caps, np.int64), 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    given = lambda x: np.minimum(caps, np.floor(weights * x + 0.5)).astype(np.int64)
    low, high = 0.0, 1.0
    while given(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() <= seats else (low, middle)
    result = given(low)
    while (left := seats - int(result.sum())) > 0:
        quotients = np.where(result < caps, weights / (2 * result + 1), -1.0)
        result[np.argsort(-quotients, kind="stable")[0]] += 1
        del left
    return result


def largest_total(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> int:
    """The most tokens at which every source that has any can reach its share within its repeats; 0 if none has."""
    limits = [available[s] * repeats / share for s, (share, repeats) in targets.items() if share > 0 and available.get(s, 0) > 0 and repeats > 0]
    return int(min(limits, default=0))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    total_tokens: int | None = None,
    block: int = BLOCK,
    seed: str = "mix-1",
    folder: str = FOLDER,
    name: str = NAME,
) -> DataFrame:
    """(key, source, shard, block, first_token, tokens, copies): the blocks that are used, piece by piece of the documents they are made of.

    In a shard of a source the documents, in an order by the seed, are one stream of tokens, cut into blocks of ``block``
    tokens; a row is the part of a document in a block (its first token and how many) and how often the block is used.
    The total is ``total_tokens`` or the largest at which all sources with documents reach their shares; each source
    gets whole blocks by its share, capped by its blocks times ``max_repeats``, and passes them on to its shards by their
    blocks. In a shard all blocks are used as often as its quota holds them all, and as many as are left of the quota,
    chosen by the seed, once more. So the tokens of a source are its quota exactly, and none is used more than
    ``max_repeats`` times. A source short of its quota gives what it may; its reached share shows it.

    Sources without target, null sources and documents without tokens aren't used, nor are the last tokens of a shard
    that fill no block. Repeated rows count as documents of their own; equal ones are counted before they are spread over
    the shards, so a key with many rows is split. ``targets`` is a small table with a row per source (several: the first).
    """
    kept = [key, "__source", "__mark"]
    sized = token_counts(documents.withColumns({"__source": source_name(F.col("source")), "__mark": F.xxhash64("text")}), kept, folder=folder, name=name)
    equal = sized.filter("tokens > 0 and __source is not null").groupBy(*kept, "tokens").agg(F.count("*").alias("__rows"))
    sized = materialized(equal.withColumnRenamed("__source", "source"), "sized")
    goals = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}
    wanted = sized.filter(F.col("source").isin(list(goals)))
    stats = {r["source"]: (r["tokens"], r["n"]) for r in wanted.groupBy("source").agg(F.sum(F.col("tokens") * F.col("__rows")).alias("tokens"), F.sum("__rows").alias("n")).collect()}
    names = sorted(goals)
    tokens = {s: stats.get(s, (0, 0))[0] for s in names}
    total = largest_total(tokens, goals) if total_tokens is None else total_tokens
    # each source's seats follow its own share of the total; a source that falls short doesn't hand its seats on
    seats = apportion(np.array([goals[s][0] for s in names]), np.full(len(names), np.iinfo(np.int64).max // (4 * max(1, len(names)))), int(total * min(1.0, sum(g[0] for g in goals.values())) // block))
    quota = dict(zip(names, map(int, seats)))
    shards = max(1, -(-sum(n for _, n in stats.values()) // SHARD_DOCUMENTS))
    marks = [F.col(key).cast("string"), F.col("__mark"), F.col("__row")]
    each = wanted.withColumn("__row", F.explode(F.sequence(F.lit(1), "__rows")))
    placed = each.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), *marks), F.lit(shards)))

    def share_out(pdf):
        pdf = pdf.sort_values("shard")
        source = pdf["source"].iloc[0]
        blocks = pdf["tokens"].to_numpy() // block
        return pdf.assign(blocks=blocks, quota=apportion(blocks, blocks * goals[source][1], quota[source]))

    quotas = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).groupBy("source").applyInPandas(share_out, "source string, shard bigint, tokens bigint, blocks bigint, quota bigint")
    limits = quotas.filter("quota > 0").select("source", "shard", F.col("blocks").alias("__blocks"), F.col("quota").alias("__quota"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + "/order"), *marks), *marks).rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("__end", F.sum("tokens").over(order)).join(limits, ["source", "shard"]).withColumn("__start", F.col("__end") - F.col("tokens"))
    size = F.lit(block)
    pieces = ends.withColumn("block", F.explode(F.sequence(F.expr(f"__start div {block}"), F.expr(f"(__end - 1) div {block}")))).filter(F.col("block") < F.col("__blocks"))
    begin = F.greatest(F.col("__start"), F.col("block") * size)
    # block numbers are permuted (a prime step never closes early), which chooses exactly as many as are wanted
    turned = F.pmod(F.col("block") * F.lit(STEP) + F.pmod(F.xxhash64(F.lit(seed + "/blocks"), "source", "shard"), F.lit(1 << 31)), F.col("__blocks"))
    copies = F.expr("__quota div __blocks") + (turned < F.col("__quota") % F.col("__blocks")).cast("int")
    return pieces.select(
        key, "source", "shard", "block", (begin - F.col("__start")).alias("first_token"), (F.least(F.col("__end"), (F.col("block") + 1) * size) - begin).alias("tokens"), copies.cast("int").alias("copies")
    ).filter("copies > 0")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target source: its share as wanted and as reached and the gap, tokens, blocks, pieces of documents and the most copies of one; zeros for a source that gave nothing.

    ``met``: the reached share is within a hundredth of the target share, in proportion.
    """
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    # combined by block first, which counts blocks without gathering them
    blocks = mixed.groupBy("source", "shard", "block").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies"), F.count("*").alias("pieces"))
    used = blocks.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("blocks"), F.sum("pieces").alias("pieces"), F.max("copies").alias("most_copies"))
    used = materialized(used, "mix-report")
    joined = goals.join(F.broadcast(used), "source", "left").na.fill(0, ["mixed_tokens", "blocks", "pieces", "most_copies"])
    total = used.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0))).first()[0]
    reached = F.col("mixed_tokens") / F.lit(total) if total else F.lit(0.0)
    gap = reached - F.col("target_share")
    return joined.select("source", "target_share", "max_repeats", reached.alias("reached_share"), gap.alias("gap"), "mixed_tokens", "blocks", "pieces", "most_copies", (F.abs(gap) <= 0.01 * F.col("target_share")).alias("met"))
