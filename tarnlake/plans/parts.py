"""Tables cut at a row number of their order: only the sort keys at the cut reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.plans.compile import quoted
from tarnlake.plans.shared import remove, scratch, shuffles_released

#: Types whose values are the same as JSON.
PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


class Reached(NamedTuple):
    """A row's sort keys, as plain values; the number of rows with just these up to it, and of all of them."""

    keys: list
    repeats: int
    copies: int = 0


def plain(c: Column, t: T.DataType) -> Column:
    """A value as a number or text, from which ``typed`` makes it again."""
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.BinaryType):
        return F.hex(c)
    return c if isinstance(t, PLAIN) else c.cast("string")


def typed(v: Any, t: T.DataType) -> Column:
    if v is not None and isinstance(t, T.TimestampType):
        return F.timestamp_micros(F.lit(v))
    if v is not None and isinstance(t, T.BinaryType):
        return F.unhex(F.lit(v))
    return F.lit(v).cast(t)


def reached(df: DataFrame, columns: Sequence[str], order: Sequence[Column], n: int) -> Reached | None:
    """The ``n``-th row of ``df`` in an order that has all its ``columns``; None if it has fewer rows.

    Equal rows are combined first. The sorted rest is written, and positions are counted within its partitions, so that no
    task has more than one of them.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "ordered")
    counted = df.groupBy(*map(quoted, columns)).agg(F.count(F.lit(1)).alias("__n"))
    try:
        with shuffles_released(spark):
            counted.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)  # the partition's number, and 33 bits of the row's in it
        ordered = spark.read.schema(T.StructType([*counted.schema, T.StructField("__at", T.LongType())])).parquet(path)
        for part, rows in sorted(ordered.groupBy(F.shiftright("__at", 33)).agg(F.sum("__n")).collect()):
            if n > rows:
                n -= rows
                continue
            inside = ordered.filter(F.col("__at").between(part << 33, (part + 1 << 33) - 1)).withColumn("__end", F.sum("__n").over(W.orderBy("__at")))
            keys = [plain(F.col(quoted(c)), counted.schema[c].dataType) for c in columns]
            *keys, copies, end = inside.filter(F.col("__end") >= n).orderBy("__at").select(*keys, "__n", "__end").first()
            return Reached(keys, n - (end - copies), copies)
        return None
    finally:
        remove(spark, path)


def copies(schema: T.StructType, row: dict[str, Any], n: int, df: DataFrame) -> DataFrame:
    """``n`` times the row of these plain values."""
    return df.sparkSession.range(n).select(*[typed(row[f.name], f.dataType).alias(f.name) for f in schema])
