"""Messages delivered more than once: exactly one copy of each, split by how often an identifier occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.text import identifier, letters
from tarnlake.operators.incremental import digest
from tarnlake.plans.shared import materialized


def message_identity(key: str = "idempotency_key", task: str = "task_id", state: str = "state") -> Column:
    """128 bits of a message's key, task and state as they agree across spellings; null where the key is null or blank.

    A null task or state agrees with null only.
    """
    name = identifier(F.col(key))
    return F.when(name != "", digest([name, identifier(F.col(task)), letters(F.col(state))]))


#: Parts that the deliveries of one message are spread over: as many as a long has bits to note them in.
PARTS = 32


def _part(spread: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int")


def frequencies(messages: DataFrame, identity: str, part: str) -> DataFrame:
    """Of each identity (null is none), how many deliveries there are and the parts that hold some, as bits.

    Both are combined before the shuffle: an identity with a third of all rows reaches its task as one row per input
    partition.
    """
    bit = F.expr(f"shiftleft(1L, {part})")
    return messages.filter(F.col(identity).isNotNull()).groupBy(identity).agg(F.count("*").alias("copies"), F.bit_or(bit).alias("parts"))


def split_by_frequency(messages: DataFrame, identity: str, part: str) -> tuple[DataFrame, DataFrame]:
    """``messages`` with an identity, in two: deliveries of messages that came once, and of those that came again.

    What tells them apart are the (identity, part) pairs of the repeated messages; joined on both, a hot identity's
    deliveries stay spread over their parts.
    """
    named = messages.filter(F.col(identity).isNotNull())
    repeated = frequencies(messages, identity, part).filter("copies > 1")
    holds = lambda p: F.getbit("parts", p) == 1
    pairs = repeated.select(identity, F.explode(F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), holds)).alias(part))
    return named.join(pairs, [identity, part], "left_anti"), named.join(pairs, [identity, part], "left_semi")


def ranked(repeated: DataFrame, identity: str, part: str, order: Sequence[Column]) -> DataFrame:
    """``repeated`` with ``__rank`` 1 for the first delivery of each identity by ``order`` and a greater one for all others.

    Ranks are taken within (identity, part), then among the first of each part, of which an identity has at most
    ``PARTS``; so no task orders a hot identity alone.
    """
    inside = repeated.withColumn("__inside", F.row_number().over(Window.partitionBy(identity, part).orderBy(*order)))
    lead = inside.filter("__inside = 1").withColumn("__rank", F.row_number().over(Window.partitionBy(identity).orderBy(*order)))
    return inside.filter("__inside > 1").withColumn("__rank", F.col("__inside")).unionByName(lead).drop("__inside")


def once_each(rows: DataFrame, id: str) -> DataFrame:
    """``rows`` with each ``id`` once; rows whose id is null are all kept."""
    own = F.when(F.col(id).isNull(), F.monotonically_increasing_id())
    return rows.withColumn("__own", own).dropDuplicates([id, "__own"]).drop("__own")


def repeated_deliveries(messages: DataFrame, identity: Column, order: str) -> DataFrame:
    """The ``order`` values (unique per delivery) of all deliveries that are copies of an earlier one.

    Messages that came once have none; of one that came again, every delivery but that of rank 1 by ``order`` (nulls
    last) is a copy. Rows without identity are no copies. Empty in, empty out.
    """
    # identities cost more than their bytes: they are computed once and read again
    marked = materialized(messages.select(order, identity.alias("__identity")).filter(F.col("__identity").isNotNull()), "identities").withColumn("__part", _part([order]))
    _, repeated = split_by_frequency(marked, "__identity", "__part")
    return ranked(repeated, "__identity", "__part", [F.asc_nulls_last(order)]).filter("__rank > 1").select(order)


def dedupe_messages(new: DataFrame, stored: DataFrame | None, identity: Column, order: str) -> DataFrame:
    """All of ``stored`` and ``new`` (same columns) with one copy of each message.

    Messages that came once pass; of one that came again, the delivery of rank 1 stays: a stored one before a new one,
    then the smallest ``order`` (null last). ``order`` need not be unique: of equals, the row of smallest hash stays,
    and other messages with that value aren't touched. Rows without identity are all kept.
    """
    rows = new.withColumn("__age", F.lit(1))
    if stored is not None:
        rows = stored.withColumn("__age", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "__age"]
    whole = [F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in rows.dtypes if c != "__age"]
    rows = rows.withColumns({"__identity": identity, "__hash": F.xxhash64(*whole)})
    rows = rows.withColumn("__part", _part(["__hash"]))
    single, repeated = split_by_frequency(rows, "__identity", "__part")
    firsts = ranked(repeated, "__identity", "__part", [F.asc("__age"), F.asc_nulls_last(order), F.asc("__hash")]).filter("__rank = 1")
    nameless = rows.filter(F.col("__identity").isNull())
    return single.unionByName(firsts.drop("__rank")).unionByName(nameless).select(*columns)
