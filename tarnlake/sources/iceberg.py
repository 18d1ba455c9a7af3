"""Iceberg tables, versions 1 and 2, without a connector: metadata and manifests are planned here, rows and deletes are Spark's.

Data files become one DataFrame; position and equality deletes become anti joins on it. What this reader can't honour
(other versions, table features, partition transforms, sort orders) is refused.
"""

from __future__ import annotations

import json
import os
import pickle
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.functions.text import unescaped
from tarnlake.plans.compile import Compiler, quoted
from tarnlake.sources import avro, readers
from tarnlake.sources.storage import local_path, open_read

MODES = ("strict", "ignore-deletes", "ignore-unsupported-deletes")
#: Contents of manifest entries and statuses, from the format's public specification.
DATA, POSITION_DELETES, EQUALITY_DELETES = 0, 1, 2
EXISTING, ADDED, DELETED = 0, 1, 2
#: Files whose partitions are sent to every task at most; beyond, they are joined by shuffling.
SMALL_FILES = 10_000


def _load(path: str) -> bytes:
    try:
        file, _ = open_read(path)
    except FileNotFoundError as e:
        raise LakeError("CATALOG_ERROR", f"missing {path}") from e
    with file:
        return file.read()


def _manifest_entries(path: str) -> list[dict]:
    raw = _load(path)
    return json.loads(raw)["entries"] if raw[:1] in (b"{", b"[") else list(avro.read(raw))


#: What planning needs of a manifest entry and of its file.
_PLANNED = ("status", "sequence_number")
_PLANNED_FILE = ("content", "file_path", "file_format", "partition", "record_count", "file_size_in_bytes", "equality_ids")
#: Manifests that the driver reads itself.
FEW_MANIFESTS = 4


def _refuse(what: str, **details: Any) -> LakeError:
    return LakeError("UNSUPPORTED_ICEBERG_FEATURE", what, details)


def validate(meta: Any) -> dict:
    """Metadata that this reader can honour, or an error that names what it can't."""
    if not isinstance(meta, dict):
        raise LakeError("CATALOG_ERROR", "metadata must be an object")
    if meta.get("format-version") not in (1, 2):
        raise LakeError("CATALOG_ERROR", "only format versions 1 and 2 are supported", {"version": meta.get("format-version")})
    if not isinstance(meta.get("schemas"), list) and isinstance(meta.get("schema"), dict):
        meta["schemas"] = [meta["schema"]]
    if not isinstance(meta.get("snapshots"), list) or not isinstance(meta.get("schemas"), list):
        raise LakeError("CATALOG_ERROR", "metadata lacks snapshots or schemas")
    for key in ("features", "table-features", "format-version-features"):
        if meta.get(key):
            raise _refuse("unsupported table features", key=key, features=meta[key])
    for spec in meta.get("partition-specs") or []:
        for f in spec["fields"]:
            if f.get("transform") not in ("identity", "void"):
                raise _refuse("unsupported partition transform", field=f.get("name"), transform=f.get("transform"))
    for order in meta.get("sort-orders") or []:
        if order["fields"]:
            raise _refuse("unsupported sort order", order=order.get("order-id"))
    return meta


@dataclass(frozen=True)
class File:
    path: str
    content: int
    partition: tuple[tuple[str, Any], ...]
    records: int
    size: int
    sequence: int
    equality_ids: tuple[int, ...] = ()


@dataclass
class Plan:
    snapshot_id: int | None
    data: list[File] = field(default_factory=list)
    deletes: list[File] = field(default_factory=list)
    skipped: int = 0


def _type(t: Any) -> T.DataType:
    if isinstance(t, dict):
        if t["type"] == "list":
            return T.ArrayType(_type(t["element"]))
        if t["type"] == "map":
            return T.MapType(_type(t["key"]), _type(t["value"]))
        return T.StructType([T.StructField(f["name"], _type(f["type"])) for f in t["fields"]])
    names = {"int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "string": "string", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "binary": "binary", "uuid": "string"}
    text = t.replace(" ", "")
    return T._parse_datatype_string(names.get(text, text if text.startswith("decimal") else "binary"))


class Table:
    """A table at one version of its metadata."""

    def __init__(self, spark: SparkSession, metadata: dict, location: str | None = None, metadata_path: str | None = None):
        self.spark, self.meta, self.metadata_path = spark, validate(metadata), metadata_path
        self.location = (location or metadata.get("location") or "").rstrip("/")

    # -- metadata

    def snapshot(self, snapshot_id: int | None = None, as_of: int | str | None = None, ref: str | None = None) -> dict | None:
        """The snapshot of an id, the last at a time (milliseconds or ISO text), of a ref, or the current one."""
        snaps = self.meta["snapshots"]
        if ref is not None:
            r = (self.meta.get("refs") or {}).get(ref)
            if r is None:
                raise LakeError("NOT_FOUND", f"unknown ref {ref}")
            snapshot_id = r["snapshot-id"]
        if as_of is not None:
            at = int(datetime.fromisoformat(as_of.replace("Z", "+00:00")).timestamp() * 1000) if isinstance(as_of, str) else as_of
            before = [s for s in snaps if s["timestamp-ms"] <= at]
            if not before:
                raise LakeError("NOT_FOUND", "no snapshot so early", {"asOf": as_of})
            return max(before, key=lambda s: s["timestamp-ms"])
        wanted = self.meta.get("current-snapshot-id") if snapshot_id is None else snapshot_id
        if wanted in (None, -1):
            return None
        found = next((s for s in snaps if s["snapshot-id"] == wanted), None)
        if found is None:
            raise LakeError("NOT_FOUND", f"unknown snapshot {wanted}")
        return found

    def schema(self, snapshot: dict | None = None) -> dict:
        wanted = (snapshot or {}).get("schema-id", self.meta.get("current-schema-id", 0))
        return next((s for s in self.meta["schemas"] if s.get("schema-id", 0) == wanted), self.meta["schemas"][-1])

    def _resolve(self, path: str) -> str:
        """A stored path, or the same below this table's folder if the table was moved."""
        if local_path(path) is not None and os.path.exists(local_path(path)) or not self.location:
            return path
        stored = (self.meta.get("location") or "").rstrip("/")
        return self.location + path[len(stored) :] if stored and path.startswith(stored) else path if "://" in path or path.startswith("/") else f"{self.location}/{path}"

    def _spec_names(self, spec_id: int) -> list[str]:
        specs = self.meta.get("partition-specs") or [{"spec-id": 0, "fields": self.meta.get("partition-spec", [])}]
        spec = next((s for s in specs if s["spec-id"] == spec_id), specs[0])
        return [f["name"] for f in spec["fields"] if f.get("transform") != "void"]

    def _manifests(self, snapshot: dict) -> list[dict]:
        if "manifest-list" in snapshot:
            raw = _load(self._resolve(snapshot["manifest-list"]))
            return json.loads(raw)["manifests"] if raw[:1] in (b"{", b"[") else avro.read(raw)
        return [{"manifest_path": p} for p in snapshot.get("manifests", [])]

    def _entries(self, manifests: list[dict]) -> Iterator[tuple[dict, list[dict]]]:
        """The entries of each manifest; more than a few manifests are read by tasks, which give back what planning needs."""
        paths = [self._resolve(m["manifest_path"]) for m in manifests]
        if len(manifests) <= FEW_MANIFESTS:
            return ((m, _manifest_entries(p)) for m, p in zip(manifests, paths))

        def read(batches: Iterator) -> Iterator:
            for pdf in batches:
                yield pdf.assign(entries=[pickle.dumps([{k: e.get(k) for k in _PLANNED} | {"data_file": {k: e["data_file"].get(k) for k in _PLANNED_FILE}} for e in _manifest_entries(p)]) for p in pdf["path"]])[["at", "entries"]]

        listed = self.spark.createDataFrame(list(enumerate(paths)), "at int, path string").repartition(min(len(paths), 10 * self.spark.sparkContext.defaultParallelism))
        found = {r["at"]: r["entries"] for r in listed.mapInPandas(read, "at int, entries binary").collect()}
        return ((m, pickle.loads(found[i])) for i, m in enumerate(manifests))

    def plan_files(self, snapshot_id: int | None = None, as_of: int | str | None = None, ref: str | None = None, where: X.Expr | None = None, mode: str = "strict") -> Plan:
        """The data and delete files of a snapshot, without those whose partition rules them out."""
        if mode not in MODES:
            raise LakeError("INVALID_QUERY", f"unknown read mode {mode}")
        snap = self.snapshot(snapshot_id, as_of, ref)
        plan = Plan(snap["snapshot-id"] if snap else None)
        if snap is None:
            return plan
        for m, entries in self._entries(self._manifests(snap)):
            for e in entries:
                if e.get("status") == DELETED:
                    continue
                f = e["data_file"]
                content = f.get("content") or DATA
                if str(f.get("file_format", "PARQUET")).upper() != "PARQUET":
                    if content == DATA or mode == "strict":
                        raise _refuse("only Parquet files are supported", path=f["file_path"])
                    continue
                names = self._spec_names(m.get("partition_spec_id") or 0)
                own = f.get("partition") or {}
                partition = tuple((n, own[n]) for n in names if n in own)
                sequence = e.get("sequence_number")
                file = File(self._resolve(f["file_path"]), content, partition, f.get("record_count") or 0, f.get("file_size_in_bytes") or 0, m.get("sequence_number") or 0 if sequence is None else sequence, tuple(f.get("equality_ids") or ()))
                if content == DATA:
                    if where is None or _fits(where, dict(partition)) is not False:
                        plan.data.append(file)
                    else:
                        plan.skipped += 1
                elif mode != "ignore-deletes":
                    if content == EQUALITY_DELETES and not file.equality_ids or content not in (POSITION_DELETES, EQUALITY_DELETES):
                        if mode == "strict":
                            raise LakeError("UNSUPPORTED_DELETE", "an unsupported delete file", {"path": file.path})
                        continue
                    plan.deletes.append(file)
        plan.data.sort(key=lambda f: f.path)
        return plan

    # -- rows

    def _names(self, schema: dict) -> dict[str, tuple[list[str], T.DataType]]:
        """Of each field, its own name and those that it, or the field it comes from, had in other schemas."""
        known: dict[int, list[str]] = {}
        for s in reversed(self.meta["schemas"]):
            for f in s["fields"]:
                known.setdefault(f["id"], []).append(f["name"])
        out = {}
        for f in schema["fields"]:
            source = f.get("source-id", f.get("sourceId"))
            names = [f["name"], *known.get(f["id"], []), *(known.get(source, []) if source is not None else [])]
            out[f["name"]] = (list(dict.fromkeys(names)), _type(f["type"]))
        return out

    def _read(self, files: list[File], wanted: dict[str, tuple[list[str], T.DataType]]) -> DataFrame:
        paths = [f.path for f in files]
        marks = [F.regexp_replace(unescaped(F.col("_metadata.file_path")), "^file:/+", "/").alias("__path"), F.col("_metadata.row_index").alias("__pos")]
        if not files:
            empty = ", ".join([*(f"{quoted(n)} {t.simpleString()}" for n, (_, t) in wanted.items()), "__path string", "__pos bigint"])
            return self.spark.createDataFrame([], empty)
        frames = []
        for own, some in readers._file_schemas(self.spark, paths) if len(paths) > 1 else [(self.spark.read.parquet(paths[0]).schema, paths)]:
            df = self.spark.read.schema(own).parquet(*some)
            columns = []
            for n, (names, t) in wanted.items():
                found = next((x for x in names if x in own.fieldNames()), None)
                columns.append((F.col(quoted(found)).cast(t) if found else F.lit(None).cast(t)).alias(n))
            frames.append(df.select(*columns, *marks))
        return reduce(DataFrame.unionByName, frames)

    def scan(
        self,
        select: list[str] | None = None,
        where: X.Expr | None = None,
        snapshot_id: int | None = None,
        as_of: int | str | None = None,
        ref: str | None = None,
        mode: str = "strict",
        spec_sequence_numbers: bool = False,
        deletion_vectors: dict[str, list[int]] | None = None,
    ) -> DataFrame:
        """The rows of a snapshot with deletes applied.

        A delete file applies to the data files whose partition has its partition's values, or to all if it has none;
        with ``spec_sequence_numbers`` also only to files that are older. Equality deletes match null with null.
        ``deletion_vectors`` gives further deleted row numbers by path.
        """
        snap = self.snapshot(snapshot_id, as_of, ref)
        schema = self.schema(snap)
        plan = self.plan_files(snapshot_id, as_of, ref, where, mode)
        by_id = {f["id"]: f["name"] for s in self.meta["schemas"] for f in s["fields"]} | {f["id"]: f["name"] for f in schema["fields"]}
        shown = select or [f["name"] for f in schema["fields"]]
        names = self._names(schema)
        for c in [*shown, *X.columns_of(where)]:
            if c not in names:
                raise LakeError("UNKNOWN_COLUMN", f"unknown column {c}", {"column": c})
        keys = {by_id[i] for f in plan.deletes for i in f.equality_ids}
        needed = [n for n in names if n in {*shown, *X.columns_of(where), *keys}]
        df = self._read(plan.data, {n: names[n] for n in needed})
        if plan.deletes or deletion_vectors:
            df = self._without(df, plan, names, by_id, spec_sequence_numbers, deletion_vectors or {})
        if where is not None:
            df = df.filter(Compiler(df, False).predicate(where))
        return df.select(*map(quoted, shown))

    def _without(self, df: DataFrame, plan: Plan, names: dict, by_id: dict[int, str], sequences: bool, vectors: dict[str, list[int]]) -> DataFrame:
        plain = lambda p: local_path(p) or p
        parts = sorted({k for f in [*plan.data, *plan.deletes] for k, _ in f.partition})
        text = lambda f: [None if v is None else str(v) for v in (dict(f.partition).get(k) for k in parts)]
        fields = "".join(f", {quoted('__p_' + k)} string" for k in parts)
        if plan.deletes:
            files = self.spark.createDataFrame([(plain(f.path), f.sequence, *text(f)) for f in plan.data], f"__path string, __seq bigint{fields}")
            df = df.join(F.broadcast(files) if len(plan.data) <= SMALL_FILES else files, "__path")
        scope = lambda used: [F.col(quoted("__p_" + k)).eqNullSafe(F.col(quoted("__d_" + k))) for k in used]
        groups: dict[tuple, list[File]] = {}
        for f in plan.deletes:
            groups.setdefault((f.content, f.equality_ids, tuple(k for k, _ in f.partition)), []).append(f)
        for (content, ids, used), files in sorted(groups.items()):
            info = self.spark.createDataFrame([(plain(f.path), f.sequence, *[None if v is None else str(v) for _, v in f.partition]) for f in files], "__from string, __dseq bigint" + "".join(f", {quoted('__d_' + k)} string" for k in used))
            columns = ["file_path", "pos"] if content == POSITION_DELETES else [by_id[i] for i in ids]
            kinds = {"file_path": (["file_path"], T.StringType()), "pos": (["pos"], T.LongType())} if content == POSITION_DELETES else {c: names.get(c, ([c], T.StringType())) for c in columns}
            rows = self._read(files, kinds).select(*[F.col(quoted(c)).alias(f"__e{i}") for i, c in enumerate(columns)], F.col("__path").alias("__from"))
            rows = rows.join(F.broadcast(info) if len(files) <= SMALL_FILES else info, "__from").drop("__from").distinct()
            on = scope(used)
            if content == POSITION_DELETES:
                where = F.regexp_replace("__e0", "^file:/+", "/")
                stored, here = (self.meta.get("location") or "").rstrip("/"), plain(self.location)
                if stored and here and plain(stored) != here:
                    where = F.when(F.startswith(F.col("__e0"), F.lit(stored)), F.concat(F.lit(here), F.substring("__e0", len(stored) + 1, 1 << 20))).otherwise(where)
                rows = rows.withColumn("__e0", where)
                on += [F.col("__path") == F.col("__e0"), F.col("__pos") == F.col("__e1")]
                on += [F.col("__dseq") >= F.col("__seq")] if sequences else []
            else:
                on += [F.col(quoted(c)).eqNullSafe(F.col(f"__e{i}")) for i, c in enumerate(columns)]
                on += [F.col("__dseq") > F.col("__seq")] if sequences else []
            df = df.join(rows, reduce(lambda a, b: a & b, on), "left_anti")
        if vectors:
            gone = self.spark.createDataFrame([(plain(p), i) for p, ps in vectors.items() for i in ps], "__path string, __pos bigint")
            df = df.join(gone, ["__path", "__pos"], "left_anti")
        return df

    # -- commits

    def append(self, entries: list[dict]) -> Table:
        """A new snapshot with further data files (of an output manifest); refused if another commit came first."""
        if not self.metadata_path or local_path(self.metadata_path) is None:
            raise LakeError("CATALOG_ERROR", "the table's metadata has no path to commit to")
        snapshot_id, now = uuid.uuid4().int >> 65, int(time.time() * 1000)
        sequence = self.meta.get("last-sequence-number", 0) + 1
        parts = self._spec_names(self.meta.get("default-spec-id", 0))
        partition = {"type": "record", "name": "r102", "fields": [{"name": p, "type": ["null", "string"]} for p in parts]}
        data_file = {"type": "record", "name": "r2", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "partition", "type": partition}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"}]}
        entry = {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": data_file}]}
        records = [
            {"status": ADDED, "snapshot_id": snapshot_id, "sequence_number": sequence, "data_file": {"content": DATA, "file_path": e["outputPath"], "file_format": "PARQUET", "partition": {p: e.get("partitionValues", {}).get(p) for p in parts}, "record_count": e["rowCount"], "file_size_in_bytes": e["byteSize"]}}
            for e in entries
        ]
        folder = os.path.dirname(local_path(self.metadata_path))
        manifest, listing = os.path.join(folder, f"{uuid.uuid4().hex}-m0.avro"), os.path.join(folder, f"snap-{snapshot_id}.avro")
        raw = avro.write(entry, records)
        _create(manifest, raw)
        head = {"type": "record", "name": "manifest_file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "partition_spec_id", "type": "int"}, {"name": "content", "type": "int"}, {"name": "sequence_number", "type": "long"}, {"name": "added_snapshot_id", "type": "long"}]}
        old = self.snapshot()
        before = [{k: m.get(k) or 0 for k in ("manifest_length", "partition_spec_id", "content", "sequence_number", "added_snapshot_id")} | {"manifest_path": m["manifest_path"]} for m in (self._manifests(old) if old else [])]
        _create(listing, avro.write(head, [*before, {"manifest_path": manifest, "manifest_length": len(raw), "partition_spec_id": self.meta.get("default-spec-id", 0), "content": 0, "sequence_number": sequence, "added_snapshot_id": snapshot_id}]))
        snap = {"snapshot-id": snapshot_id, "timestamp-ms": now, "sequence-number": sequence, "manifest-list": listing, "summary": {"operation": "append", "added-data-files": str(len(entries))}, "schema-id": self.meta.get("current-schema-id", 0)}
        if old:
            snap["parent-snapshot-id"] = old["snapshot-id"]
        meta = self.meta | {"snapshots": [*self.meta["snapshots"], snap], "current-snapshot-id": snapshot_id, "last-sequence-number": sequence, "last-updated-ms": now}
        if "main" in (meta.get("refs") or {}):
            meta["refs"] = meta["refs"] | {"main": meta["refs"]["main"] | {"snapshot-id": snapshot_id}}
        version = _version(self.metadata_path)
        path = os.path.join(folder, f"v{version + 1}.metadata.json")
        try:
            _create(path, json.dumps(meta).encode())
        except FileExistsError as e:
            raise LakeError("COMMIT_CONFLICT", "another commit came first", {"version": version + 1}) from e
        hint = os.path.join(folder, "version-hint.text")
        with open(hint + ".tmp", "w") as f:
            f.write(str(version + 1))
        os.replace(hint + ".tmp", hint)
        return Table(self.spark, meta, self.location, path)


def _create(path: str, data: bytes) -> None:
    """Write a file that mustn't exist; it appears whole or not at all, and one of two writers fails."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "wb") as f:
        f.write(data)
    try:
        os.link(temporary, path)
    finally:
        os.unlink(temporary)


def _version(path: str) -> int:
    name = os.path.basename(path)
    digits = name[1:].split(".")[0] if name.startswith("v") else name.split("-")[0]
    return int(digits) if digits.isdigit() else 0


def _fits(e: X.Expr, partition: dict[str, Any]) -> bool | None:
    """Whether rows of a partition can satisfy a condition: False if none can, None if it can't be told."""
    match e:
        case X.Logical("and", xs):
            return False if any(_fits(x, partition) is False for x in xs) else None
        case X.Logical(_, xs):
            return False if all(_fits(x, partition) is False for x in xs) else None
        case X.Compare(op, X.ColumnRef(c), X.Literal(v)) if c in partition:
            own = partition[c]
            if own is None or v is None:
                return False
            own = type(v)(own) if isinstance(v, (int, float)) and not isinstance(v, bool) and isinstance(own, str) and own.replace(".", "", 1).lstrip("-").isdigit() else own
            if type(own) is not type(v):
                return None
            return {"eq": own == v, "ne": own != v, "lt": own < v, "lte": own <= v, "gt": own > v, "gte": own >= v}[op] or False
        case X.In(X.ColumnRef(c), vs, False) if c in partition and all(isinstance(v, X.Literal) for v in vs):
            return None if any(_fits(X.Compare("eq", X.ColumnRef(c), v), partition) is not False for v in vs) else False
        case X.Between(X.ColumnRef(c), low, high, False) if c in partition:
            return _fits(X.Logical("and", (X.Compare("gte", X.ColumnRef(c), low), X.Compare("lte", X.ColumnRef(c), high))), partition)
        case X.NullCheck(X.ColumnRef(c), negated) if c in partition:
            return None if (partition[c] is None) != negated else False
    return None


def load_table(spark: SparkSession, path: str) -> Table:
    """A table from a metadata file, or from its folder by the version hint or the highest version there."""
    if not path.endswith(".json"):
        folder = f"{path.rstrip('/')}/metadata"
        here = local_path(folder)
        if here is None:
            version = _load(f"{folder}/version-hint.text").decode().strip()
            path = f"{folder}/v{version}.metadata.json"
        else:
            found = [f for f in os.listdir(here) if f.endswith(".metadata.json")] if os.path.isdir(here) else []
            if not found:
                raise LakeError("CATALOG_ERROR", f"no metadata under {path}")
            path = f"{folder}/{max(found, key=lambda f: (_version(f), f))}"
    meta = json.loads(_load(path))
    return Table(spark, meta, path.rsplit("/metadata/", 1)[0] if "/metadata/" in path else None, path)


class RestCatalog:
    """Tables of a REST catalog. ``fetch(url, headers)`` gives (status, body) and may be replaced, as in tests."""

    def __init__(self, url: str, warehouse: str | None = None, prefix: str | None = None, token: str | None = None, fetch=None):
        self.url, self.warehouse, self.prefix, self.token, self.fetch = url.rstrip("/"), warehouse, prefix, token, fetch or _fetch

    def _get(self, path: str) -> dict:
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        status, body = self.fetch(f"{self.url}/v1/{path}", headers)
        if status != 200:
            raise LakeError("NOT_FOUND" if status == 404 else "CATALOG_ERROR", f"the catalog answered {status}", {"path": path})
        return json.loads(body)

    def config(self) -> dict:
        found = self._get("config" + (f"?warehouse={quote(self.warehouse, safe='')}" if self.warehouse else ""))
        merged = (found.get("defaults") or {}) | (found.get("overrides") or {})
        self.prefix = self.prefix or merged.get("prefix")
        return merged

    def _base(self, namespace: str | list[str]) -> str:
        parts = [namespace] if isinstance(namespace, str) else namespace
        return (f"{self.prefix}/" if self.prefix else "") + "namespaces/" + quote("\x1f".join(parts), safe="")

    def tables(self, namespace: str | list[str]) -> list[str]:
        return [t["name"] for t in self._get(f"{self._base(namespace)}/tables")["identifiers"]]

    def load(self, spark: SparkSession, namespace: str | list[str], table: str) -> Table:
        found = self._get(f"{self._base(namespace)}/tables/{quote(table, safe='')}")
        if "metadata" not in found:
            raise LakeError("CATALOG_ERROR", "the catalog gave no metadata")
        return Table(spark, found["metadata"], metadata_path=found.get("metadata-location"))


def _fetch(url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError as e:
        raise LakeError("CATALOG_ERROR", f"the catalog can't be reached: {e}") from e


class GlueCatalog:
    """Not supported: each use is refused."""

    def __init__(self, **_options: Any):
        pass

    def load(self, *_args: Any) -> Table:
        raise LakeError("CATALOG_ERROR", f"{type(self).__name__} isn't supported")


class NessieCatalog(GlueCatalog):
    """Not supported: each use is refused."""
