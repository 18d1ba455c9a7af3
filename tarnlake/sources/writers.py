"""Sinks: validated and partitioned Parquet, tables from queries, manifests, and text and Arrow streams."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.errors import LakeError
from tarnlake.plans.compile import quoted
from tarnlake.plans.resume import Checkpoints, output_manifest, stable_json
from tarnlake.sources import readers
from tarnlake.sources.storage import open_read, write_whole


@dataclass(frozen=True)
class Rules:
    """What rows must satisfy: columns without nulls, unique column sets, ranges (least, greatest; None is open), allowed values."""

    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    ranges: dict[str, tuple[Any, Any]] = field(default_factory=dict)
    enums: dict[str, tuple[Any, ...]] = field(default_factory=dict)


def validate(df: DataFrame, rules: Rules) -> None:
    """One pass for all rules on single rows, and a count per unique set; the first rule broken is an error."""
    tests = {f"required {c}": F.col(quoted(c)).isNull() for c in rules.required}
    for c, (low, high) in rules.ranges.items():
        outside = F.lit(False)
        outside = outside | (F.col(quoted(c)) < low) if low is not None else outside
        tests[f"range {c}"] = outside | (F.col(quoted(c)) > high) if high is not None else outside
    tests |= {f"enum {c}": ~F.col(quoted(c)).isin(list(vs)) for c, vs in rules.enums.items()}
    if tests:
        counts = df.agg(*[F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests.values())]).first()
        for i, name in enumerate(tests):
            if counts[f"t{i}"]:
                raise LakeError("VALIDATION_ERROR", f"{counts[f't{i}']} row(s) break the rule: {name}", {"rule": name, "rows": counts[f"t{i}"]})
    for columns in rules.unique:
        if not columns:
            raise LakeError("VALIDATION_ERROR", "a unique rule must name columns")
        twice = df.groupBy(*map(quoted, columns)).count().filter("count > 1").limit(1).collect()
        if twice:
            raise LakeError("VALIDATION_ERROR", f"not unique: {', '.join(columns)}", {"columns": list(columns), "values": [str(twice[0][c]) for c in columns]})


def _mode(df: DataFrame, path: str, mode: str) -> str:
    if mode not in ("overwrite", "create"):
        raise LakeError("INVALID_QUERY", "a write overwrites or creates")
    if mode == "create":
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise LakeError("COMMIT_CONFLICT", f"{path} exists")
    return "overwrite" if mode == "overwrite" else "error"


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = 1) -> None:
    """All rows under one folder, in ``files`` files (None: as many as there are partitions)."""
    (df.coalesce(files) if files else df).write.mode(_mode(df, path, mode)).parquet(path)


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: list[str],
    max_rows_per_file: int | None = None,
    max_bytes_per_file: int | None = None,
    rules: Rules | None = None,
    mode: str = "overwrite",
    job_id: str = "data",
    plan_fingerprint: str = "",
) -> dict:
    """A folder per value of the partition columns; gives the manifest of the files written.

    Rows are first brought together by partition, a large one over several tasks (AQE splits it), so that each folder gets
    few files. A null partition value and a column of nulls alone are refused, as is what breaks ``rules``. The bytes
    limit holds for every file of more than one row: rows a file are lowered, by how far the largest file is over it,
    until all are within.
    """
    for c in partition_by:
        if c not in df.columns:
            raise LakeError("UNKNOWN_COLUMN", f"unknown partition column {c}", {"column": c})
    checks = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    for i, c in enumerate(df.columns):
        if c in partition_by and checks[f"c{i}"] < checks["n"]:
            raise LakeError("VALIDATION_ERROR", f"partition column {c} has nulls", {"column": c})
        if checks["n"] and not checks[f"c{i}"]:
            raise LakeError("VALIDATION_ERROR", f"column {c} has nulls only", {"column": c})
    if rules:
        validate(df, rules)
    limit, how = max_rows_per_file, _mode(df, path, mode)
    while True:
        out = df.hint("rebalance", *[F.col(quoted(c)) for c in partition_by]).write.mode(how).partitionBy(*partition_by)
        if limit:
            out = out.option("maxRecordsPerFile", limit)
        out.parquet(path)
        manifest = manifest_of(df, path, job_id, plan_fingerprint)
        large = [e for e in manifest["entries"] if max_bytes_per_file and e["byteSize"] > max_bytes_per_file and e["rowCount"] > 1]
        if not large:
            return manifest
        limit, how = max(1, min(min(e["rowCount"] * max_bytes_per_file // (e["byteSize"] + 1), e["rowCount"] - 1) for e in large)), "overwrite"


def manifest_of(df: DataFrame, path: str, job_id: str = "data", plan_fingerprint: str = "") -> dict:
    """The manifest of the files under ``path``: rows come from their footers, read by tasks."""
    try:
        files = readers.list_files(df.sparkSession, path)
    except LakeError:
        return output_manifest(job_id, plan_fingerprint, [])

    def count(batches: Iterator) -> Iterator:
        import pyarrow.parquet as pq

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                f, _ = open_read(p)
                with f:
                    rows.append(pq.read_metadata(f).num_rows)
            yield pdf.assign(n=rows)

    listed = df.sparkSession.createDataFrame(files, "path string, size bigint")
    entries = []
    for r in listed.mapInPandas(count, "path string, size bigint, n bigint").collect():
        values = {k: unquote(v) for k, v in (part.split("=", 1) for part in r["path"].split("/")[:-1] if "=" in part)}
        entries.append({"taskId": job_id, "outputPath": r["path"], "partitionValues": values, "rowCount": r["n"], "byteSize": r["size"]})
    return output_manifest(job_id, plan_fingerprint, entries)


def write_task(df: DataFrame, path: str, task_id: str, idempotency_key: str, checkpoints: Checkpoints, partition_by: list[str], **options: Any) -> dict:
    """A partitioned write that may be repeated: a complete task isn't written again, an unfinished one is written anew."""
    done = checkpoints.get(task_id)
    if done and done.state == "complete" and done.idempotency_key == idempotency_key:
        return output_manifest(task_id, "", done.outputs)
    if not done or done.state == "complete":
        checkpoints.advance(task_id, "planned", idempotency_key)
    if not done or done.state in ("planned", "complete"):
        checkpoints.advance(task_id, "running", idempotency_key)
    manifest = write_partitioned(df, path, partition_by, job_id=task_id, **options)
    for state in ("output-written", "manifest-recorded"):
        if not done or done.state != "manifest-recorded" or state != "output-written":
            checkpoints.advance(task_id, state, idempotency_key, manifest["entries"])
    checkpoints.advance(task_id, "complete", idempotency_key, manifest["entries"])
    return manifest


def create_table_as(df: DataFrame, path: str, partition_by: list[str] | None = None, **options: Any) -> dict:
    """A query's rows as files under ``path``, with the manifest beside them in ``_manifest.json``."""
    if partition_by:
        manifest = write_partitioned(df, path, partition_by, **options)
    else:
        write_parquet(df, path, options.get("mode", "overwrite"), None)
        manifest = manifest_of(df, path, options.get("job_id", "data"))
    write_manifest(f"{path.rstrip('/')}/_manifest.json", manifest)
    return manifest


def write_manifest(path: str, manifest: dict) -> None:
    write_whole(path, stable_json(manifest).encode(), "manifest")


def read_manifest(path: str) -> dict:
    file, _ = open_read(path)
    with file:
        d = json.loads(file.read())
    if d.get("version") != 1 or not isinstance(d.get("entries"), list):
        raise LakeError("VALIDATION_ERROR", "not an output manifest")
    return d


# --- text and Arrow -----------------------------------------------------------------------------------------------


def json_safe(v: Any) -> Any:
    """A value as JSON has it: times as ISO text in UTC, bytes as hex, whole numbers beyond 2^53 as text."""
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(timespec="microseconds" if v.microsecond % 1000 else "milliseconds") + "Z"
    if isinstance(v, (dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 2**53 - 1:
        return str(v)
    if isinstance(v, float) and v != v:
        return None
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_safe(x) for x in v]
    return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)


def _rows(df: DataFrame) -> Iterator[dict]:
    for r in df.toLocalIterator():
        yield {k: json_safe(v) for k, v in r.asDict(recursive=True).items()}


def stream_ndjson(df: DataFrame) -> Iterator[str]:
    for r in _rows(df):
        yield json.dumps(r, ensure_ascii=False, separators=(",", ":")) + "\n"


def stream_json(df: DataFrame) -> Iterator[str]:
    before = "["
    for r in _rows(df):
        yield before + json.dumps(r, ensure_ascii=False, separators=(",", ":"))
        before = ","
    yield "[]" if before == "[" else "]"


def csv_cell(v: Any, prevent_formulae: bool = False) -> str:
    """Text of a cell, quoted where it must be; null is empty. Formulae can be defused by an apostrophe."""
    if v is None:
        return ""
    text = json.dumps(v) if isinstance(v, (bool, list, dict)) else str(v)
    if prevent_formulae and isinstance(v, str) and text[:1] in ("=", "+", "-", "@"):
        text = "'" + text
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


def stream_csv(df: DataFrame, header: bool = True, prevent_formulae: bool = False) -> Iterator[str]:
    if header:
        yield ",".join(csv_cell(c) for c in df.columns) + "\n"
    for r in _rows(df):
        yield ",".join(csv_cell(r[c], prevent_formulae) for c in df.columns) + "\n"


def to_arrow(df: DataFrame) -> Any:
    """An Arrow table of scalar columns."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise LakeError("TYPE_ERROR", f"column {f.name} is nested", {"column": f.name})
    return df.toArrow()


def to_arrow_ipc(df: DataFrame) -> bytes:
    import pyarrow as pa

    table, sink = to_arrow(df), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()
