"""The batch operators over streams of files: new files in, exactly one copy of each message, records compacted or kept by version.

Streams are not among the operations that lake queries need; they are here because tables are fed by them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlake.operators import dedup
from tarnlake.operators.incremental import StateStore, run_incremental


def read_files(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive under a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


#: Buckets of identities that a stream's table keeps.
BUCKETS = 64


def dedupe_stream(messages: DataFrame, out: str, checkpoint: str, identity: Column, order: str = "delivery_id") -> StreamingQuery:
    """Append each batch's messages that are neither repeated in the batch nor stored under ``out``.

    A batch's part of ``out`` is a folder of its own, replaced if the batch is run again; so a failure neither loses nor
    repeats a message. The identities of what is stored are kept beside it (``-identities``) in buckets by their hash, a
    folder per batch; a batch reads those of the buckets that it touches, and none of the rows.
    """
    spark, names = messages.sparkSession, f"{out.rstrip('/')}-identities"
    bucket = F.pmod(F.xxhash64("seen"), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(names)
        known = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        kept = dedup.dedupe_messages(batch, None, identity, order).withColumn("__identity", identity)
        if known:
            touched = [r[0] for r in batch.select(identity.alias("seen")).filter("seen is not null").select(bucket).distinct().collect()]  # at most BUCKETS
            stored = spark.read.schema("seen binary, bucket int, batch bigint").option("basePath", names).parquet(names)
            stored = stored.filter((F.col("batch") < number) & F.col("bucket").isin(touched)).select("seen")
            kept = kept.join(stored, F.col("__identity") == F.col("seen"), "left_anti")
        kept.drop("__identity").write.mode("overwrite").parquet(f"{out}/batch={number}")
        mine = spark.read.schema(batch.schema).parquet(f"{out}/batch={number}").select(identity.cast("binary").alias("seen")).filter("seen is not null")
        mine.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{names}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_stream(rows: DataFrame, root: str, checkpoint: str, keys: list[str], content: list[str], sink: Callable[[DataFrame, str], None], order: Sequence[str] = ()) -> StreamingQuery:
    """Hand each batch's new and changed records to ``sink`` under a ``StateStore``; the batch's number is the run's name. Of a key's rows in a batch the last by ``order`` counts."""
    store = StateStore(rows.sparkSession, root)

    def step(batch: DataFrame, number: int) -> None:
        run_incremental(store, batch, keys, content, f"batch-{number}", sink, order)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts per window of event time, final once events can't be later than ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
