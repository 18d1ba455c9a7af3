"""Only new or changed records: the last content hash of each key, in state versions that are swapped atomically."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.functions.text import stripped
from tarnlake.plans.shared import Pointer, remove, scratch
from tarnlake.plans.skew import salted_join


def digest(columns: Sequence[str | Column]) -> Column:
    """128 bits of the columns' values; nulls, and where one value ends, count."""
    parts = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)]
    return F.unhex(F.md5(F.concat(*parts)))


#: Buckets that a new state store has.
BUCKETS = 16
STATE = "key binary, content binary"


class StateStore:
    """The last content of each key, in buckets by the key's hash, and the pointer that says which files of each count.

    A commit writes the buckets that a run touched under a folder of its own; then a pointer naming the folder of every
    bucket and the run is published exclusively (``Pointer``). A run that fails before that leaves the earlier state in
    force, so its records come again; a run that is named by the pointers is never applied twice. Of two runs that began
    from one pointer, the second to commit is refused.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = Pointer(spark, root)
        self.buckets = (self.pointer.current() or {}).get("buckets", buckets)

    def current(self) -> dict | None:
        """The pointer in force: number, run, runs, buckets and the folder of each bucket; None before the first commit."""
        return self.pointer.current()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None, at: dict | None = None) -> DataFrame:
        """The state in force (or of the pointer ``at``), of some ``buckets`` only if given; empty before the first commit."""
        folders = (at or self.current() or {}).get("folders", {})
        paths = [f"{self.root}/{f}" for b, f in folders.items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def commit(self, state: DataFrame, run: str, expected: dict | None, touched: Sequence[int] | None = None) -> bool:
        """Put ``state`` (key, content; one row a key) in force as the whole of the ``touched`` buckets, by default of all.

        ``expected`` is the pointer that the run began with; another one now is a conflict. False if ``run`` is already
        committed.
        """
        now = self.current()
        if now and run in now["runs"]:
            return False
        if (now or {}).get("number") != (expected or {}).get("number"):
            raise LakeError("COMMIT_CONFLICT", "another run has committed", {"now": now, "expected": expected})
        touched = set(range(self.buckets) if touched is None else touched)
        version = f"v-{uuid.uuid4().hex}"
        parts = state.select("key", "content", self.bucket(F.col("key")).alias("bucket"))
        parts.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{version}")
        folders = {b: f for b, f in (now or {}).get("folders", {}).items() if int(b) not in touched}
        folders |= {n.partition("=")[2]: f"{version}/{n}" for n in self.pointer.names("bucket=", version)}
        self.pointer.publish({"run": run, "runs": [*(now or {}).get("runs", []), run], "buckets": self.buckets, "folders": folders}, now)
        return True

    def vacuum(self) -> None:
        """Delete the buckets' files that the pointer in force doesn't name."""
        keep = set((self.current() or {}).get("folders", {}).values())
        for version in self.pointer.names("v-"):
            inside = [f"{version}/{n}" for n in self.pointer.names("bucket=", version)]
            for folder in inside if keep.intersection(inside) else [version]:
                if folder not in keep:
                    remove(self.spark, f"{self.root}/{folder}")


def keyed(df: DataFrame, keys: Sequence[str], content: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``df`` as ``__key``, ``__content`` (digests) and ``__row``, each key once.

    Of several rows of a key the greatest by ``order``, then by content digest, counts; they are combined before the
    shuffle, so that a key with a third of all rows costs its task one row per input partition.
    """
    last = F.struct(*order, F.col("__content"))
    return (
        df.select(F.struct(*df.columns).alias("__row"), digest(keys).alias("__key"), digest(content).alias("__content"), *[F.col(c).alias(c) for c in order])
        .groupBy("__key")
        .agg(F.max_by(F.struct("__content", "__row"), last).alias("x"))
        .select("__key", "x.*")
    )


def new_or_changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """``keyed`` rows with ``__status``: new (the state hasn't the key), changed (it has another content) or same."""
    known = state.select(F.col("key").alias("__key"), F.col("content").alias("__known"))
    status = F.when(F.col("__known").isNull(), "new").when(F.col("__known") != F.col("__content"), "changed").otherwise("same")
    return current.join(known, "__key", "left").withColumn("__status", status).drop("__known")


def run_incremental(
    store: StateStore, current: DataFrame, keys: Sequence[str], content: Sequence[str], run: str, sink: Callable[[DataFrame, str], None], order: Sequence[str] = (), complete: bool = False
) -> bool:
    """One run: hand the new and changed records to ``sink(df, run)`` with ``_change`` (new or changed), then commit their state.

    The state is the last content of each key, so a record that goes back to an earlier content is changed again. The
    input is read once: its digests, and the rows to hand over, are pinned in the shared folder, and both the sink and
    the state come from there; what arrives meanwhile belongs to the next run. ``sink`` must replace what an earlier
    attempt of the same ``run`` wrote; so a failure at any point, repeated under the same name, neither skips nor
    repeats a record. False if the run was already committed.

    Of several rows of a key the last by ``order`` counts. With ``complete`` the input is all there is: keys that it
    hasn't leave the state, and are new if they come back; without, they stay. Keys that are null are one key.
    """
    began = store.current()
    if began and run in began["runs"]:
        return False
    spark, pinned = store.spark, scratch(store.spark, "pinned")
    marked = new_or_changed(keyed(current, keys, content, order), store.read(at=began))
    handed = F.when(F.col("__status") != "same", F.col("__row"))
    marked.select(F.col("__key").alias("key"), F.col("__content").alias("content"), handed.alias("row"), F.col("__status").alias("_change")).write.parquet(pinned)
    now = spark.read.parquet(pinned)
    sink(now.filter("_change <> 'same'").select("row.*", "_change"), run)
    state, touched = now.select("key", "content"), None
    if not complete:
        touched = [r[0] for r in now.filter("_change <> 'same'").select(store.bucket(F.col("key"))).distinct().collect()]  # at most the buckets there are
        inside = state.filter(store.bucket(F.col("key")).isin(touched)) if touched else state.limit(0)
        state = store.read(touched, began).join(inside.select("key"), "key", "left_anti").unionByName(inside) if began else inside
    committed = store.commit(state, run, began, touched)
    remove(spark, pinned)
    return committed


def job_bookmarks(jobs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Each job with the position of its last successful run under its present plan; nulls for a job without one.

    A bookmark counts if it is complete, has its plan's fingerprint (white space and letter case aside), a snapshot
    number and both parts of its position. Of several, the highest run number wins, then the farthest position.
    """
    plain = lambda c: F.lower(stripped(c))
    usable = (
        bookmarks.select(
            "job_id",
            plain(F.col("plan_fingerprint")).alias("plan"),
            F.regexp_extract(F.coalesce("snapshot_ref", F.lit("")), r"(\d+)\s*$", 1).try_cast("bigint").alias("snapshot"),
            "file_index",
            "row_offset",
            "run_no",
            plain(F.col("state")).alias("state"),
        )
        .filter((F.col("state") == "complete") & F.col("plan").isNotNull() & F.col("snapshot").isNotNull() & F.col("file_index").isNotNull() & F.col("row_offset").isNotNull() & F.col("run_no").isNotNull())
        .groupBy("job_id", "plan")
        .agg(F.max(F.struct("run_no", "snapshot", "file_index", "row_offset")).alias("at"))
    )
    present = jobs.filter(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.max(F.struct("created_at", "table_name", plain(F.col("plan_fingerprint")).alias("plan"))).alias("job"))
    return present.select("job_id", "job.table_name", "job.plan").join(usable, ["job_id", "plan"], "left").select(
        "job_id", "table_name", F.col("at.snapshot").alias("snapshot"), F.col("at.file_index").alias("file_index"), F.col("at.row_offset").alias("row_offset")
    )


def job_rows(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """The rows of each job's table, with ``covered``: whether the job's last successful run had read the row.

    A table with most rows is spread over tasks. Rows of no job's table, and rows without table, don't come out; a row
    without snapshot or position isn't covered.
    """
    at = positions.filter(F.col("table_name").isNotNull()).select("job_id", "table_name", F.col("snapshot").alias("__s"), F.col("file_index").alias("__f"), F.col("row_offset").alias("__o"))
    pairs = salted_join(rows.filter(F.col("table_name").isNotNull()), at, ["table_name"], F.col("row_id"))
    before = (F.col("file_index") < F.col("__f")) | ((F.col("file_index") == F.col("__f")) & (F.col("row_offset") < F.col("__o")))
    return pairs.withColumn("covered", F.coalesce((F.col("snapshot_id") <= F.col("__s")) & before, F.lit(False))).drop("__s", "__f", "__o")


def pending_records(rows: DataFrame, jobs: DataFrame, bookmarks: DataFrame, root: str) -> DataFrame:
    """(job_id, record_id, record_version) of every record version of a job's table of which no row is covered.

    Two runs over a ``StateStore`` under ``root``: the first puts the versions that the job's last successful run had
    read in the state, with the hashes of their payloads; the second starts from that state with all present rows and
    hands over what is new. A version whose payload was rewritten since is changed, not new, and isn't pending. Rows
    without record id or version are compared as nulls.
    """
    store, out = StateStore(rows.sparkSession, root), scratch(rows.sparkSession, "pending")
    needed = rows.select("row_id", "table_name", "record_id", "record_version", "snapshot_id", "file_index", "row_offset", F.unhex(F.md5("payload")).alias("payload"))
    present = job_rows(needed, job_bookmarks(jobs, bookmarks)).select("job_id", "record_id", "record_version", "payload", "covered")
    keys, content = ["job_id", "record_id", "record_version"], ["payload"]
    run_incremental(store, present.filter("covered").drop("covered"), keys, content, "last successful run", lambda df, run: None)
    run_incremental(store, present.drop("covered"), keys, content, "next run", lambda df, run: df.write.mode("overwrite").parquet(out))
    return rows.sparkSession.read.parquet(out).filter("_change = 'new'").select(*keys)
