"""Sources: Parquet files, folders, globs and Hive trees with one reconciled schema; CSV, JSON, Arrow and rows in memory."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.errors import LakeError
from tarnlake.plans.compile import quoted

FILE_ORDINAL = "__place"


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` stay within a path segment, ``**`` spans segments."""
    out = ""
    for m in re.finditer(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m.group(), re.escape(m.group()))
    return f"^{out}$"


def list_files(spark: SparkSession, source: str, suffix: str = ".parquet") -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files under a folder, or of those that match a glob; in order of path.

    Listing is done by the driver's file system client: for globs, limits on files, and file indexes. Folders that are
    read whole are listed by Spark (``read_parquet``). Nothing found is an error.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    wild = re.search(r"[*?]", source)
    base = source[: source.rfind("/", 0, wild.start()) + 1] or "." if wild else source
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(conf)
    found: list[tuple[str, int]] = []
    if fs.exists(path):
        matcher = re.compile(glob_regex(fs.makeQualified(path).toUri().getPath().rstrip("/") + "/" + source[len(base) :].lstrip("/"))) if wild else None
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            p = f.getPath()
            if p.getName()[:1] in "._":
                continue
            name = p.toUri().getPath()
            if (matcher.match(name) if matcher else name.endswith(suffix) or not f.isDirectory() and name == path.toUri().getPath()):
                found.append((p.toString(), f.getLen()))
    if not found:
        raise LakeError("NO_FILES_MATCHED", f"no files match {source}", {"source": source})
    return sorted(found)


def reject_unsupported(schema: T.StructType, columns: Iterable[str] | None = None) -> None:
    """Struct columns, and decimals beyond what a double holds exactly, are refused where they are read."""
    wanted = None if columns is None else set(columns)
    for f in schema.fields:
        if wanted is not None and f.name not in wanted:
            continue
        t = f.dataType
        while isinstance(t, T.ArrayType):
            t = t.elementType
        if isinstance(t, T.StructType) or (isinstance(t, T.DecimalType) and t.precision > 15):
            raise LakeError("UNSUPPORTED_PARQUET_FEATURE", f"column {f.name} has an unsupported type {t.simpleString()}", {"column": f.name})


def _schemas_of(listed: DataFrame) -> DataFrame:
    """(path, schema as JSON) of the files in ``listed``; footers are read by tasks."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        from tarnlake.sources.storage import open_read

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                file, _ = open_read(p)
                with file:
                    rows.append((p, from_arrow_schema(pq.read_schema(file), prefer_timestamp_ntz=True).json()))
            yield pd.DataFrame(rows, columns=["path", "schema"])

    return listed.select("path").mapInPandas(read, "path string, schema string")


def _file_schemas(spark: SparkSession, paths: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """The distinct schemas of files and the files of each."""
    tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    return _grouped(_schemas_of(spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)))


def _grouped(found: DataFrame) -> list[tuple[T.StructType, list[str]]]:
    groups: dict[str, list[str]] = {}
    for row in found.collect():
        groups.setdefault(row["schema"], []).append(row["path"])
    return [(T.StructType.fromJson(json.loads(s)), sorted(ps)) for s, ps in sorted(groups.items())]


def _read_folder(spark: SparkSession, folder: str, hive: bool, ordinal: bool) -> DataFrame | None:
    """A folder whose files have one schema, listed and planned by Spark alone; None if they differ.

    Only the distinct schemas reach the driver. Partition columns are Spark's own, as text, so that conditions on them
    prune folders; where a file has a column of such a name this reader isn't used, as the file's column counts.
    """
    listed = spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", recursiveFileLookup="true").load(folder).select("path")
    found = _schemas_of(listed).groupBy("schema").agg(F.first("path").alias("path")).limit(2).collect()
    if len(found) != 1:
        return None
    own = T.StructType.fromJson(json.loads(found[0]["schema"]))
    inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inference)
    spark.conf.set(inference, "false")
    try:
        df = spark.read.parquet(folder) if hive else spark.read.schema(own).option("recursiveFileLookup", "true").parquet(folder)
        parts = [c for c in df.columns if c not in own.fieldNames()]
        if hive and len(parts) < len(set(re.findall(r"/([^/=]+)=[^/]+(?=/)", found[0]["path"][len(folder.split(":", 1)[-1]) :]))):
            return None
        extra = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(FILE_ORDINAL)] * ordinal
        return df.select(*[F.col(quoted(c)) for c in [*own.fieldNames(), *parts]], *extra)
    finally:
        spark.conf.set(inference, before)


def _is_folder(spark: SparkSession, source: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not re.search(r"[*?]", source) and fs.exists(path) and fs.getFileStatus(path).isDirectory()


def _plain(t: T.DataType) -> T.DataType:
    """The type without nullability, which differs between writers."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_plain(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(_plain(t.keyType), _plain(t.valueType), True)
    return t


def unify(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """The common type of each column: the same in all, or double where numbers differ; else a conflict."""
    types: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s.fields:
            new, old = _plain(f.dataType), types.get(f.name)
            if old is None or old == new:
                types[f.name] = new
            elif isinstance(old, T.NumericType) and isinstance(new, T.NumericType):
                types[f.name] = T.DoubleType()
            else:
                raise LakeError("SCHEMA_CONFLICT", f"column {f.name} is {old.simpleString()} in one file and {new.simpleString()} in another", {"column": f.name})
    return types


def read_parquet(spark: SparkSession, source: str | list[str], hive: bool = False, ordinal: bool = False) -> DataFrame:
    """One DataFrame over all files of ``source`` (or of a list of paths): columns unified by name, missing ones null.

    With ``hive``, ``key=value`` folders give text columns (URL escapes undone); a file's own column of the name wins.
    With ``ordinal``, each row's place (file and row number) is in ``__place``.
    """
    if isinstance(source, str) and _is_folder(spark, source):
        df = _read_folder(spark, source, hive, ordinal)
        if df is not None:
            return df
    paths = source if isinstance(source, list) else [p for p, _ in list_files(spark, source)]
    groups = _file_schemas(spark, paths) if len(paths) > 1 else [(spark.read.parquet(paths[0]).schema, paths)]
    types = unify([s for s, _ in groups])
    frames = []
    for schema, files in groups:
        df = spark.read.schema(schema).parquet(*files)
        extra = [F.col("_metadata.file_path").alias("__file")] * hive
        extra += [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(FILE_ORDINAL)] * ordinal
        own = {f.name: f.dataType for f in schema.fields}
        shown = [(F.col(quoted(c)).cast(t) if own[c] != t and isinstance(t, T.NumericType) else F.col(quoted(c))).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in types.items()]
        frames.append(df.select(*shown, *extra))
    df = reduce(DataFrame.unionByName, frames)
    return _partitions(df, paths) if hive else df


def _partitions(df: DataFrame, paths: list[str]) -> DataFrame:
    """Columns from ``key=value`` folders; ``k=`` without a value gives no value."""
    keys = list(dict.fromkeys(m for p in paths for m in re.findall(r"/([^/=]+)=[^/]+(?=/)", p)))
    folder = F.regexp_replace("__file", "[^/]*$", "")
    values = {}
    for k in keys:
        if k in df.columns:
            continue
        raw = F.regexp_extract(folder, f"/{re.escape(k)}=([^/]+)/", 1)
        # the path is escaped once by the URI and once by the writer
        once = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
        twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once, raw)
        values[k] = F.when(raw != "", twice)
    return df.withColumns(values).drop("__file") if values else df.drop("__file")


def hive_files(files: list[tuple[str, int]], wanted: dict[str, str]) -> list[tuple[str, int]]:
    """The files whose folders don't contradict the wanted partition values."""
    from urllib.parse import unquote

    def fits(path: str) -> bool:
        own = {k: unquote(v) for k, v in re.findall(r"/([^/=]+)=([^/]+)(?=/)", path)}
        return all(own.get(k, v) == v for k, v in wanted.items())

    return [f for f in files if fits(f[0])]


def read_batches(df: DataFrame, size: int = 4096) -> Iterator[list[dict]]:
    """Rows in lists of ``size``, one partition in memory at a time."""
    batch: list[dict] = []
    for row in df.toLocalIterator():
        batch.append(row.asDict())
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def row_range(spark: SparkSession, source: str, start: int, end: int, columns: list[str] | None = None) -> DataFrame:
    """The rows numbered ``start`` to ``end`` (exclusive) of one file."""
    df = spark.read.parquet(source)
    inside = df.filter((F.col("_metadata.row_index") >= start) & (F.col("_metadata.row_index") < end))
    return inside.select(*map(quoted, columns)) if columns else inside


def row_groups(path: str, columns: list[str] | None = None) -> list[dict]:
    """From the footer alone: number, rows and byte range of each row group of a file, with min and max of its columns."""
    import pyarrow.parquet as pq

    from tarnlake.sources.storage import open_read

    file, _ = open_read(path)
    with file:
        meta = pq.ParquetFile(file).metadata
        plan = []
        for i in range(meta.num_row_groups):
            g = meta.row_group(i)
            chunks = [g.column(j) for j in range(g.num_columns) if columns is None or g.column(j).path_in_schema.split(".")[0] in columns]
            begins = [c.dictionary_page_offset or c.data_page_offset for c in chunks]
            stats = {c.path_in_schema: {"min": c.statistics.min, "max": c.statistics.max, "nulls": c.statistics.null_count} for c in chunks if c.statistics and c.statistics.has_min_max}
            plan.append({"row_group": i, "rows": g.num_rows, "start": min(begins), "end": max(b + c.total_compressed_size for b, c in zip(begins, chunks)), "stats": stats})
        return plan


# --- text sources -------------------------------------------------------------------------------------------------

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_DELIMITERS = (",", "\t", ";", "|")


def _head(spark: SparkSession, path: str) -> list[str]:
    return [r[0] for r in spark.read.text(path).filter(F.length("value") > 0).limit(50).collect()]


def _unquoted_count(line: str, delimiter: str) -> int:
    return re.sub(r'"(?:[^"]|"")*"', "", line).count(delimiter)


def _cells(line: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=delimiter))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, quote: str = '"', trim: bool = False, null_values: Iterable[str] = ("",), sniff: bool = True) -> DataFrame:
    """A CSV file with typed columns: boolean or double where all values are, else text.

    Delimiter and header are detected unless given: the most frequent of comma, tab, semicolon and bar in the first
    line; a header if the first line is of distinct plain names and a later one isn't all text. Without header columns
    are ``column1`` and so on. A line of another width is an error; quoted line breaks belong to their value.
    """
    lines = _head(spark, path)
    if not lines:
        return spark.createDataFrame([], T.StructType([]))
    delimiter = delimiter or max(_DELIMITERS, key=lambda d: (_unquoted_count(lines[0], d), -_DELIMITERS.index(d)))
    first = [c.strip() for c in _cells(lines[0], delimiter)]
    if header is None:
        plain = all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", c) for c in first) and len(set(first)) == len(first)
        header = plain and any(re.fullmatch(_NUMBER, c.strip()) or c.strip().lower() in ("true", "false") for line in lines[1:] for c in _cells(line, delimiter))
    if header and ("" in first or len(set(first)) < len(first)):
        raise LakeError("VALIDATION_ERROR", "CSV header columns must be distinct and non-empty", {"header": first})
    names = first if header else [f"column{i + 1}" for i in range(len(first))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # the value's own quotes tell an empty text from none; blanks stay unless trimmed
    reader = spark.read.schema(schema).options(sep=delimiter, quote=quote, escape=quote, header=str(header).lower(), multiLine="true", mode="FAILFAST", enforceSchema="true", nullValue="\x00", emptyValue="", ignoreLeadingWhiteSpace=str(trim).lower(), ignoreTrailingWhiteSpace=str(trim).lower())
    raw = reader.csv(path)
    nulls = list(null_values)
    df = raw.select(*[F.when(~F.coalesce(F.col(quoted(n)), F.lit("")).isin(nulls), F.coalesce(F.col(quoted(n)), F.lit(""))).alias(n) for n in names])
    if not sniff:
        return df
    tests = []
    for i, n in enumerate(names):
        v = F.trim(F.col(quoted(n)))
        tests += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(_NUMBER)).alias(f"d{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}")]
    seen = df.agg(*tests).first()
    kinds = ["double" if seen[f"n{i}"] and seen[f"d{i}"] == seen[f"n{i}"] else "boolean" if seen[f"n{i}"] and seen[f"b{i}"] == seen[f"n{i}"] else "string" for i in range(len(names))]
    return df.select(*[(F.trim(F.col(quoted(n))).cast(k) if k != "string" else F.col(quoted(n))).alias(n) for n, k in zip(names, kinds)])


def _is_json(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def read_json(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    """A JSON array of objects, one object, or an object per line; a row that is no object is an error."""
    lines = _head(spark, path)
    start = lines[0].lstrip()[:1] if lines else ""
    if format == "auto":
        whole = start == "[" or (start == "{" and not all(map(_is_json, lines)))
        format = "json" if whole else "ndjson"
    if format == "ndjson":
        odd = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*\{")).limit(1).count()
        if odd:
            raise LakeError("VALIDATION_ERROR", "JSON rows must be objects")
        return spark.read.option("mode", "FAILFAST").json(path)
    if start == "[":
        odd = not re.fullmatch(r"\s*\[\s*\]\s*", "".join(lines)) and spark.read.text(path, wholetext=True).select(F.explode_outer(F.from_json("value", "array<string>")).alias("v")).filter(~F.coalesce(F.col("v"), F.lit("")).rlike(r"^\s*\{")).limit(1).count()
        if odd:
            raise LakeError("VALIDATION_ERROR", "JSON rows must be objects")
    elif start != "{":
        raise LakeError("VALIDATION_ERROR", "JSON rows must be objects")
    return spark.read.options(multiLine="true", mode="FAILFAST").json(path)


def read_arrow(spark: SparkSession, table: Any) -> DataFrame:
    """An Arrow table of scalar columns."""
    import pyarrow as pa

    for f in table.schema:
        if pa.types.is_nested(f.type):
            raise LakeError("TYPE_ERROR", f"column {f.name} is nested", {"column": f.name})
    return spark.createDataFrame(table)


def from_rows(spark: SparkSession, rows: list[dict], schema: str | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Rows in memory as a table; columns that some rows lack are null there."""
    if max_rows is not None and len(rows) > max_rows:
        raise LakeError("BUDGET_EXCEEDED", "too many rows", {"metric": "max_rows", "limit": max_rows, "actual": len(rows)})
    if max_bytes is not None and (size := sum(len(json.dumps(r, default=str)) for r in rows)) > max_bytes:
        raise LakeError("BUDGET_EXCEEDED", "too many bytes", {"metric": "max_bytes", "limit": max_bytes, "actual": size})
    names = list(dict.fromkeys(k for r in rows for k in r))
    if schema:
        names = spark.createDataFrame([], schema).columns
    if not rows and not schema:
        return spark.createDataFrame([], T.StructType([]))
    tuples = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(tuples, schema or names)
