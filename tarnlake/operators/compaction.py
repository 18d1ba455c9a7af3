"""Far too many small files: which files to merge, and merging them by copying their encoded column blocks."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.errors import LakeError
from tarnlake.functions.text import object_name
from tarnlake.operators.dedup import once_each
from tarnlake.plans.shared import Pointer, materialized, scratch, shuffles_released, tasks
from tarnlake.plans.skew import salted_join

if TYPE_CHECKING:
    import pyarrow as pa

SMALL = 1_048_576
TARGET = 64 * SMALL
PARTITION = ("table_name", "store_id", "sale_date")


def current_files(entries: DataFrame) -> DataFrame:
    """The state of each file that ``entries`` (manifest entries) name: its last entry and last known size.

    Entries are of one file if their paths name one object. The last entry is the one of highest sequence number (null
    counts lowest), then of highest entry id. ``size`` and ``records`` come from the last entry with a positive size
    or, of records, a count; null if none has. Entries without path or entry id are left out.
    """
    seq = F.coalesce("sequence_number", F.lit(-1))
    last = F.struct(seq.alias("seq"), "entry_id", "entry_status", "content", *PARTITION, "schema_id", "file_path")
    return (
        entries.filter(F.col("file_path").isNotNull() & F.col("entry_id").isNotNull())
        .withColumn("file", object_name(F.col("file_path")))
        .groupBy("file")
        .agg(
            F.max(last).alias("last"),
            F.max(F.when(F.col("file_size_in_bytes") > 0, F.struct(seq, "entry_id", F.col("file_size_in_bytes").alias("n")))).alias("sized"),
            F.max(F.when(F.col("record_count") >= 0, F.struct(seq, "entry_id", F.col("record_count").alias("n")))).alias("counted"),
        )
        .select("file", "last.*", F.col("sized.n").alias("size"), F.col("counted.n").alias("records"))
    )


def live_data_files(entries: DataFrame) -> DataFrame:
    """The files of ``current_files`` that aren't deleted and hold data (no content kind counts as data)."""
    status, content = F.lower(F.coalesce("entry_status", F.lit(""))), F.lower(F.coalesce("content", F.lit("data")))
    return current_files(entries).filter((F.trim(status) != "deleted") & (F.trim(content) == "data"))


def small_files(entries: DataFrame, below: int = SMALL) -> DataFrame:
    """The live data files under ``below`` bytes that share their partition (nulls equal) with another such file.

    A partition with a single small file has nothing to merge with. Those files are found by counting per partition
    (combined before the shuffle) and are taken away by their unique entry id, so that a partition with most files is
    never gathered.
    """
    small = live_data_files(entries).filter((F.col("size") > 0) & (F.col("size") < below))
    alone = small.groupBy(*PARTITION).agg(F.count("*").alias("n"), F.min("entry_id").alias("entry_id")).filter("n = 1").select("entry_id")
    return small.join(alone, "entry_id", "left_anti")


def with_layouts(files: DataFrame) -> DataFrame:
    """``files`` (path, start, length and any others) with each file's ``layout`` (digest of its schema as encoded) and ``rows``; footers are read by tasks.

    A file is the whole of ``path``, or, if it has a ``start``, ``length`` bytes of it from there on.
    """

    def read_layouts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tarnlake.sources import parquet_blocks as blocks
        from tarnlake.sources.storage import open_part

        shape, digest = None, ""
        for batch in batches:
            marks, counts = [], []
            for place in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                file, length = open_part(*place)
                with file:
                    meta = blocks.outline(file, length)
                if shape is not (now := blocks.get(meta, blocks.SCHEMA)):
                    shape, digest = now, hashlib.md5(blocks.layout(meta)).hexdigest()
                marks.append(digest)
                counts.append(blocks.row_count(meta))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string()), pa.array(counts, pa.int64())], names=[*batch.schema.names, "layout", "rows"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read_layouts, f"{kinds}, layout string, `rows` bigint")


def plan_bins(files: DataFrame, group: Sequence[str], target: int = TARGET) -> DataFrame:
    """``files`` (file, length, layout) with ``bin``: the number of its output within its group and layout, so that outputs come near ``target`` bytes.

    A group gets as many bins as its files' lengths need; files are spread over them by hash, which needs no order
    within a group. Files of different layouts never share a bin. The group's totals come back by a salted join.
    """
    keys = [*group, "layout"]
    totals = files.groupBy(*keys).agg(F.greatest(F.ceil(F.sum("length") / F.lit(target)), F.lit(1)).alias("bins"))
    return salted_join(files, totals, keys, F.col("file")).withColumn("bin", F.pmod(F.xxhash64("file"), F.col("bins"))).drop("bins")


_COUNTS = "path string, files bigint, blocks bigint, `groups` bigint, `rows` bigint, bytes bigint, sources array<string>"


def compact_files(files: DataFrame, group: Sequence[str], out: str, target: int = TARGET, folder: str | None = None) -> DataFrame:
    """Merge Parquet ``files`` (``with_layouts``; ``file`` is unique and ``group`` columns are strings) by copying their encoded column blocks; a report row of each output.

    A task copies the blocks of one bin after another into files under ``out`` as it reads them, and checks layout, blocks
    and rows; only names and places are shuffled. ``folder`` is the group column that names the folder of an output, if any.
    The report has the group, path, files, blocks read, row groups written, rows and bytes of each output and the files it
    replaces. The same bin goes to the same path, so a repeated task does no harm.
    """
    keys = [*group, "layout", "bin"]
    kinds = ", ".join(f"`{g}` string" for g in group)

    def copy_blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tarnlake.sources import parquet_blocks as blocks
        from tarnlake.sources.storage import open_part, open_read, writing

        def opened(places: list[tuple]) -> Iterator:
            for _, path, start, length, _ in places:
                file, n = open_part(path, start, length)
                with file:
                    yield file, n

        def copied(values: tuple, places: list[tuple]) -> dict:
            named = dict(zip(group, values))
            name = f"part-{hashlib.md5(repr([*values]).encode()).hexdigest()}.parquet"
            path = "/".join(x for x in (out.rstrip("/"), named.get(folder), name) if x)
            with writing(path, uuid.uuid4().hex) as sink:
                counts = blocks.merge(opened(places), sink)
            file, length = open_read(path)
            with file:
                kept = blocks.row_count(blocks.outline(file, length))
            if length != counts["bytes"] or kept != sum(rows for *_, rows in places):
                raise LakeError("VALIDATION_ERROR", "a merged file isn't as long as it was written or has lost or gained rows", {"path": path})
            return named | {"path": path} | counts | {"sources": [place[0] for place in places]}

        fields = [*((g, pa.string()) for g in group), ("path", pa.string()), *((k, pa.int64()) for k in ("files", "blocks", "groups", "rows", "bytes")), ("sources", pa.list_(pa.string()))]
        report = pa.schema(fields)
        current, held, found = None, [], []
        # files come in order of their bins; a bin may go on in the next batch
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for values, place in zip(zip(*(columns[k] for k in keys)), zip(*(columns[c] for c in ("file", "path", "start", "length", "rows")))):
                if held and values != current:
                    found.append(copied(current, held))
                    held = []
                current = values
                held.append(place)
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=report)
                found = []
        if held:
            yield pa.RecordBatch.from_pylist([copied(current, held)], schema=report)

    binned = plan_bins(files, group, target).select(*keys, "file", "path", "start", "length", "rows")
    return binned.repartition(tasks(files.sparkSession), *keys).sortWithinPartitions(*keys, "file").mapInArrow(copy_blocks, f"{kinds}, {_COUNTS}")


def publish(spark: SparkSession, out: str, build: Callable[[str], DataFrame], rows: Callable[[], int], files: Callable[[], int] | None = None) -> DataFrame:
    """Run ``build``, which writes files under the folder it is given and reports them, and put them in force as the table at ``out``.

    Readers (``read_compacted``) see the earlier files or the new ones, never both: a pointer names the snapshot of the
    files that count, and it is published only when the reported rows are as many as ``rows`` says, and the files read as
    many as ``files``. The report, which
    lists the files that each output replaces, is kept beside the files and comes back.
    """
    pointer, snapshot = Pointer(spark, out), f"snap-{uuid.uuid4().hex}"
    began = pointer.current()
    build(f"{pointer.root}/{snapshot}/data").write.parquet(f"{pointer.root}/{snapshot}/report")
    report = spark.read.parquet(f"{pointer.root}/{snapshot}/report")
    total = report.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("files"), F.lit(0)), F.count("*")).first()
    if total[0] != rows():
        raise LakeError("VALIDATION_ERROR", "compaction has lost or gained rows", {"kept": total[0]})
    if files and total[1] != files():
        raise LakeError("VALIDATION_ERROR", "compaction has lost or gained files", {"read": total[1]})
    pointer.publish({"snapshot": snapshot, "rows": total[0], "sources": total[1], "files": total[2]}, began)
    return report


def read_compacted(spark: SparkSession, out: str, schema: StructType | None = None) -> DataFrame:
    """The rows of the snapshot in force at ``out``; without files, no rows of ``schema``."""
    now = Pointer(spark, out).current()
    if now is None:
        raise LakeError("TABLE_NOT_FOUND", "nothing was compacted here", {"path": out})
    if not now["files"]:
        return spark.createDataFrame([], schema or StructType([]))
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{out.rstrip('/')}/{now['snapshot']}/data")


#: Columns of which staged files keep bounds; in files of a dozen records the bounds of all columns are four tenths of the bytes.
BOUNDED = ("row_id", "store_id", "sale_date")


def stage_files(rows: DataFrame, files: DataFrame, out: str, every: bool = False) -> DataFrame:
    """The records of ``files`` written as one small Parquet file each: (file, path, start, length, partition columns), as ``with_layouts`` takes them.

    The test tables have the records of lake files in one table; this makes the files. ``rows`` holds ``file_path``,
    ``row_offset`` and ``row_id`` (unique per record, repeated if delivered twice, and then in the same file; records of
    null ``row_id`` are all kept). Files of which it holds no record are written, empty, if ``every``. So small a file gains
    nothing from dictionaries, and without them blocks can be joined. A task writes its files one behind another into a
    pack under ``out``: each is whole, with its own footer, but a file system would give each blocks of its own.
    """
    n = tasks(rows.sparkSession)
    planned = files.select("file", *[F.col(c).alias(f"__{c}") for c in PARTITION])
    columns = rows.columns

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        from tarnlake.sources.storage import writing

        kinds = pa.schema([("file", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in PARTITION)])
        name = uuid.uuid4().hex
        path, at, empty = f"{out}/{name}.pack", 0, b""

        def encoded(table: pa.Table) -> pa.Buffer:
            sink = pa.BufferOutputStream()
            pq.write_table(table, sink, compression="zstd", use_dictionary=False, store_schema=False, write_statistics=[c for c in BOUNDED if c in columns])
            return sink.getvalue()

        def written(named: tuple, parts: list[pa.RecordBatch], sink) -> tuple:
            nonlocal at, empty
            body = pa.Table.from_batches(parts)
            if body.num_rows:
                data = encoded(body.combine_chunks() if len(parts) > 1 else body)
            else:
                data = empty = empty or encoded(body)
            sink.write(data)
            at += len(data)
            return named[0], path, at - len(data), len(data), *named[1:]

        current, seen, held, found = None, set(), [], []
        with writing(path, name) as sink:
            # rows come in order of file; a file may go on in the next batch
            for batch in batches:
                names, ids, there = (batch.column(c).to_pylist() for c in ("file", "row_id", "__there"))
                lake = list(zip(*(batch.column(f"__{c}").to_pylist() for c in PARTITION)))
                keep, ends, kept = [], [], 0  # ends: where the files before the last end among the rows kept
                for i, (file, row) in enumerate(zip(names, ids)):
                    if current is None or file != current[0]:
                        if current is not None:
                            ends.append((current, kept))
                        current, seen = (file, *lake[i]), set()
                    once = there[i] and (row is None or row not in seen)
                    seen.add(row)
                    keep.append(once)
                    kept += once
                body, begin = batch.select(columns).filter(pa.array(keep, pa.bool_())), 0
                for named, end in ends:
                    found.append(written(named, [*held, body.slice(begin, end - begin)], sink))
                    held, begin = [], end
                held.append(body.slice(begin))
            if current is not None:
                found.append(written(current, held, sink))
        # told when the pack is there, as what follows in the task may read it
        for begin in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found[begin : begin + 10_000]), kinds.types)], schema=kinds)

    # both sides are spread alike before the join, so that the records of a file come to one task in one shuffle; AQE leaves such partitions whole
    there = rows.filter(F.col("file_path").isNotNull()).withColumn("file", object_name(F.col("file_path"))).repartition(n, "file")
    tagged = planned.repartition(n, "file").join(there, "file", "left" if every else "inner").withColumn("__there", F.col("file_path").isNotNull())
    kinds = ", ".join(f"{c} string" for c in PARTITION)
    return tagged.sortWithinPartitions("file", "row_offset", "row_id").mapInArrow(write, f"file string, path string, start bigint, length bigint, {kinds}")


def _merge_staged(rows: DataFrame, cases: DataFrame, out: str, target: int, every: bool) -> DataFrame:
    """``compact_lake`` of the files of ``cases`` (``small_files``, written and read from there)."""
    spark = rows.sparkSession
    measured = materialized(with_layouts(stage_files(rows, cases, scratch(spark, "small"), every)), "layouts")
    # each file once: as many as there are names
    files = cases.count if every else measured.select("file").distinct().count
    return publish(spark, out, lambda to: compact_files(measured, PARTITION, to, target), lambda: measured.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], files)


def compact_lake(rows: DataFrame, entries: DataFrame, out: str, target: int = TARGET, every: bool = False) -> DataFrame:
    """Merge the small files (``small_files``) of a lake whose records are in ``rows`` into a table at ``out``; the report of outputs.

    Small files of which ``rows`` holds no record are merged too, as empty ones, if ``every``. The report names the files
    that an output replaces as ``small_files`` does.
    """
    with shuffles_released(rows.sparkSession):
        return _merge_staged(rows, materialized(small_files(entries), "cases"), out, target, every)


def merged_files(rows: DataFrame, entries: DataFrame, out: str) -> DataFrame:
    """The files of ``small_files`` that compaction replaces, read off the report of a ``compact_lake`` at ``out`` that is in force.

    Every small file has its blocks copied and checked, those without a record in ``rows`` as empty files.
    """
    with shuffles_released(rows.sparkSession):
        cases = materialized(small_files(entries), "cases")
        report = _merge_staged(rows, cases, out, TARGET, True)
    return cases.join(report.select(F.explode("sources").alias("file")), "file")


def untouched_rows(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The records (once each) that ``compact_lake`` doesn't merge, with ``kept`` true for those of other live data files and false for those of none."""
    cases = small_files(entries).select("file", F.lit(True).alias("__merged"))
    live = live_data_files(entries).select("file").join(cases, "file", "left").withColumn("kept", F.lit(True))
    named = once_each(rows, "row_id").withColumn("file", object_name(F.coalesce("file_path", F.lit(""))))
    return named.join(live, "file", "left").filter(F.col("__merged").isNull()).withColumn("kept", F.col("kept").isNotNull()).drop("__merged")


def compact_directory(spark: SparkSession, source: str, out: str, target: int = TARGET, below: int = SMALL) -> DataFrame:
    """The rows of all Parquet files under ``source`` as a table at ``out`` (``read_compacted``), the small files merged by folder and layout to near ``target`` bytes.

    Files are listed and their footers read by tasks, not by the driver. A report row of each output comes back, with the
    counts of files, blocks and rows that were checked. Files of ``below`` bytes or more are carried over as they are, each
    under a name of its own (``kept-``), so that ``out`` alone holds every row of ``source``. Empty folders are left out.
    """
    every = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source).select("path", "length").withColumn("file", F.col("path")).withColumn("start", F.lit(None).cast("bigint"))
    bare = lambda p: re.sub("^file:/+", "/", p).rstrip("/")
    prefix = bare(source)
    plain = F.regexp_replace("path", "^file:/+", "/")
    folder = F.btrim(F.regexp_replace(F.substr(plain, F.lit(len(prefix) + 1)), "/?[^/]*$", ""), F.lit("/"))
    measured = materialized(with_layouts(every).withColumn("folder", folder), "layouts")

    def carry(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tarnlake.sources import parquet_blocks as blocks
        from tarnlake.sources.storage import open_read, writing

        for batch in batches:
            for path, inside in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist()):
                to = "/".join(x for x in (root[0], inside, f"kept-{hashlib.md5(path.encode()).hexdigest()}.parquet") if x)
                file, length = open_read(path)
                with file:
                    file.seek(0)
                    with writing(to, uuid.uuid4().hex) as sink:
                        while piece := file.read(1 << 22):
                            sink.write(piece)
                    source_meta = blocks.footer(file, length)
                copy, copied = open_read(to)
                with copy:
                    meta = blocks.footer(copy, copied)
                if copied != length or meta != source_meta:
                    raise LakeError("VALIDATION_ERROR", "a file carried over isn't the same", {"path": path})
                n = blocks.block_count(meta)
                counts = {"files": 1, "blocks": n, "groups": n, "rows": blocks.row_count(meta), "bytes": copied}
                yield pa.RecordBatch.from_pydict({"folder": [inside], "path": [to]} | {k: pa.array([v], pa.int64()) for k, v in counts.items()} | {"sources": [[path]]})

    root: list[str] = []

    def build(to: str) -> DataFrame:
        root.append(to)
        merged = compact_files(measured.filter(F.col("length") < below), ["folder"], to, target, "folder")
        return merged.unionByName(measured.filter(F.col("length") >= below).mapInArrow(carry, f"folder string, {_COUNTS}"))

    return publish(spark, out, build, lambda: measured.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], measured.count)
