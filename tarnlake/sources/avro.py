"""Avro object files, as table manifests are: a small reader and writer (null, deflate and zstandard codecs)."""

from __future__ import annotations

import io
import json
import struct
import zlib
from typing import Any

from tarnlake.errors import LakeError

_MAGIC = b"Obj\x01"


class _In:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise LakeError("CATALOG_ERROR", "an Avro file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7


def _named(schema: Any, names: dict[str, Any]) -> Any:
    if isinstance(schema, dict) and "name" in schema and schema["type"] in ("record", "fixed", "enum"):
        names[schema["name"]] = schema
    return schema


def _read(schema: Any, f: _In, names: dict[str, Any]) -> Any:
    if isinstance(schema, list):
        return _read(schema[f.long()], f, names)
    kind = _named(schema, names)["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _read(kind, f, names)
    if kind == "null":
        return None
    if kind == "boolean":
        return f.take(1) == b"\x01"
    if kind in ("int", "long"):
        return f.long()
    if kind == "float":
        return struct.unpack("<f", f.take(4))[0]
    if kind == "double":
        return struct.unpack("<d", f.take(8))[0]
    if kind in ("bytes", "string"):
        raw = f.take(f.long())
        return raw.decode() if kind == "string" else raw
    if kind == "fixed":
        return f.take(schema["size"])
    if kind == "enum":
        return schema["symbols"][f.long()]
    if kind == "record":
        return {x["name"]: _read(x["type"], f, names) for x in schema["fields"]}
    if kind in ("array", "map"):
        out: list = []
        while n := f.long():
            if n < 0:
                n = -n
                f.long()
            for _ in range(n):
                out.append(_read(schema["items"], f, names) if kind == "array" else (_read("string", f, names), _read(schema["values"], f, names)))
        return out if kind == "array" else dict(out)
    if kind in names:
        return _read(names[kind], f, names)
    raise LakeError("CATALOG_ERROR", f"unsupported Avro type {kind}")


def read(data: bytes) -> list[dict]:
    """All records of an object file."""
    f = _In(data)
    if f.take(4) != _MAGIC:
        raise LakeError("CATALOG_ERROR", "not an Avro file")
    meta = _read({"type": "map", "values": "bytes"}, f, {})
    sync, schema, codec = f.take(16), json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    out: list[dict] = []
    while f.at < len(f.data):
        n, body = f.long(), f.take(f.long())
        if codec == "deflate":
            body = zlib.decompress(body, -15)
        elif codec == "zstandard":
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        elif codec != "null":
            raise LakeError("UNSUPPORTED_ICEBERG_FEATURE", f"unsupported Avro codec {codec}")
        block, names = _In(body), {}
        out += [_read(schema, block, names) for _ in range(n)]
        if f.take(16) != sync:
            raise LakeError("CATALOG_ERROR", "an Avro block doesn't end with its marker")
    return out


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _write(schema: Any, v: Any, out: io.BytesIO) -> None:
    if isinstance(schema, list):
        i = schema.index("null") if v is None else next(i for i, s in enumerate(schema) if s != "null")
        out.write(_long(i))
        return _write(schema[i], v, out)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "null":
        return None
    if kind == "boolean":
        out.write(b"\x01" if v else b"\x00")
    elif kind in ("int", "long"):
        out.write(_long(v))
    elif kind == "double":
        out.write(struct.pack("<d", v))
    elif kind in ("bytes", "string"):
        raw = v.encode() if kind == "string" else v
        out.write(_long(len(raw)) + raw)
    elif kind == "record":
        for x in schema["fields"]:
            _write(x["type"], v.get(x["name"]), out)
    elif kind == "array":
        if v:
            out.write(_long(len(v)))
            for x in v:
                _write(schema["items"], x, out)
        out.write(_long(0))
    else:
        raise LakeError("CATALOG_ERROR", f"unsupported Avro type {kind}")
    return None


def write(schema: dict, records: list[dict], meta: dict[str, str] | None = None) -> bytes:
    """An object file of the records."""
    out, sync = io.BytesIO(), zlib.crc32(json.dumps(schema).encode()).to_bytes(4, "big") * 4
    out.write(_MAGIC)
    entries = {"avro.schema": json.dumps(schema), "avro.codec": "deflate"} | (meta or {})
    out.write(_long(len(entries)))
    for k, v in entries.items():
        _write("string", k, out)
        _write("bytes", v.encode(), out)
    out.write(_long(0) + sync)
    if records:
        block = io.BytesIO()
        for r in records:
            _write(schema, r, block)
        squeeze = zlib.compressobj(wbits=-15)
        body = squeeze.compress(block.getvalue()) + squeeze.flush()
        out.write(_long(len(records)) + _long(len(body)) + body + sync)
    return out.getvalue()
