"""Parquet files joined by copying their encoded column blocks: only footers are read and rewritten, no value is decoded.

A footer is a Thrift structure in the compact protocol. It is read into nested ``(field id, type, value)`` lists, which
keep fields that this module doesn't know, changed where it holds offsets, and written again.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

from tarnlake.errors import LakeError

MAGIC = b"PAR1"
#: Type codes of the Thrift compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)

Struct = list[list]  # of [field id, type, value]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n, shift = 0, 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _value(data: bytes, at: int, kind: int) -> tuple[Any, int]:
    """The value of type ``kind`` that begins at ``at``, and where it ends."""
    if kind in (I16, I32, I64):
        n, at = _varint(data, at)
        return (n >> 1) ^ -(n & 1), at
    if kind == BINARY:
        n, at = _varint(data, at)
        return data[at : at + n], at + n
    if kind == STRUCT:
        return _struct(data, at)
    if kind in (LIST, SET):
        head = data[at]
        n, of, at = head >> 4, head & 15, at + 1
        if n == 15:
            n, at = _varint(data, at)
        items = []
        for _ in range(n):
            if of == STRUCT:
                item, at = _struct(data, at)
            elif of in (TRUE, FALSE):
                item, at = data[at] == TRUE, at + 1
            else:
                item, at = _value(data, at, of)
            items.append(item)
        return [of, items], at
    if kind in (TRUE, FALSE):
        return kind == TRUE, at
    if kind == BYTE:
        return data[at], at + 1
    if kind == DOUBLE:
        return data[at : at + 8], at + 8
    if kind == MAP:
        n, at = _varint(data, at)
        kinds, pairs = 0, []
        if n:
            kinds, at = data[at], at + 1
        for _ in range(n):
            k, at = _value(data, at, kinds >> 4)
            v, at = _value(data, at, kinds & 15)
            pairs.append([k, v])
        return [kinds, pairs], at
    raise LakeError("UNSUPPORTED_PARQUET_FEATURE", f"thrift type {kind} in a footer")


def _struct(data: bytes, at: int) -> tuple[Struct, int]:
    """The structure that begins at ``at``, and where it ends. What most fields are (short numbers and texts) takes no call."""
    fields, last = [], 0
    while head := data[at]:
        kind, at = head & 15, at + 1
        if head >> 4:
            last += head >> 4
        else:
            last, at = _value(data, at, I32)
        if I16 <= kind <= I64:
            if (n := data[at]) < 0x80:
                at += 1
            elif (high := data[at + 1]) < 0x80:
                n, at = n & 0x7F | high << 7, at + 2
            else:
                n, at = _varint(data, at)
            value = (n >> 1) ^ -(n & 1)
        elif kind == STRUCT:
            value, at = _struct(data, at)
        elif kind == BINARY and (n := data[at]) < 0x80:
            at += 1 + n
            value = data[at - n : at]
        else:
            value, at = _value(data, at, kind)
        fields.append([last, kind, value])
    return fields, at + 1


class _Writer:
    def __init__(self) -> None:
        self.out = bytearray()

    def varint(self, n: int) -> None:
        while n > 0x7F:
            self.out.append(n & 0x7F | 0x80)
            n >>= 7
        self.out.append(n)

    def zigzag(self, n: int) -> None:
        self.varint((n << 1) ^ (n >> 63))

    def value(self, kind: int, x: Any) -> None:
        if kind == BYTE:
            self.out.append(x)
        elif kind in (I16, I32, I64):
            self.zigzag(x)
        elif kind == DOUBLE:
            self.out += x
        elif kind == BINARY:
            self.varint(len(x))
            self.out += x
        elif kind in (LIST, SET):
            of, items = x
            self.out.append(min(len(items), 15) << 4 | of)
            if len(items) >= 15:
                self.varint(len(items))
            for item in items:
                if of in (TRUE, FALSE):
                    self.out.append(TRUE if item else FALSE)
                else:
                    self.value(of, item)
        elif kind == MAP:
            kinds, items = x
            self.varint(len(items))
            if items:
                self.out.append(kinds)
            for k, v in items:
                self.value(kinds >> 4, k)
                self.value(kinds & 15, v)
        elif kind == STRUCT:
            self.struct(x)

    def struct(self, fields: Struct) -> None:
        last = 0
        for key, kind, x in fields:
            kind = (TRUE if x else FALSE) if kind in (TRUE, FALSE) else kind
            if 0 < key - last <= 15:
                self.out.append((key - last) << 4 | kind)
            else:
                self.out.append(kind)
                self.zigzag(key)
            if kind not in (TRUE, FALSE):
                self.value(kind, x)
            last = key
        self.out.append(0)


def get(fields: Struct, key: int, default: Any = None) -> Any:
    for k, _, x in fields:
        if k == key:
            return x
    return default


def put(fields: Struct, key: int, x: Any) -> None:
    for f in fields:
        if f[0] == key:
            f[2] = x


#: Files up to this many bytes are read at once, and of others as much of the end, in which most footers lie whole.
AT_ONCE = 1 << 16


def _packed_footer(file: BinaryIO, length: int) -> bytes:
    """The footer of a Parquet file of ``length`` bytes, as encoded; a file that is none, or is encrypted, is refused."""
    if length < 12:
        raise LakeError("UNSUPPORTED_PARQUET_FEATURE", "not a Parquet file: too short")
    file.seek(max(0, length - AT_ONCE))
    tail = file.read(min(length, AT_ONCE))
    if tail[-4:] != MAGIC:
        raise LakeError("UNSUPPORTED_PARQUET_FEATURE", "not a plain Parquet file")
    n = struct.unpack("<I", tail[-8:-4])[0]
    if n > length - 12:
        raise LakeError("UNSUPPORTED_PARQUET_FEATURE", "the footer is longer than the file")
    if n + 8 > len(tail):
        file.seek(length - 8 - n)
        return file.read(n)
    return tail[-8 - n : -8]


#: The schema read last in this process, as encoded and as read: most footers that follow another have the same.
_last_schema: list[tuple[bytes, list]] = []


def _head(data: bytes) -> tuple[Struct, int]:
    """The fields of a footer up to its rows, which come before its blocks, and where the next one begins.

    A schema that is encoded as the last one is that one, and isn't read again: an encoded list tells its own end.
    """
    fields, last, at = [], 0, 0
    while (head := data[at]) and last < ROWS:
        kind, start = head & 15, at + 1
        if head >> 4:
            last += head >> 4
        else:
            last, start = _value(data, start, I32)
        if last == SCHEMA and _last_schema and data.startswith(_last_schema[0][0], start):
            value, at = _last_schema[0][1], start + len(_last_schema[0][0])
        else:
            value, at = _value(data, start, kind)
            if last == SCHEMA:
                _last_schema[:] = [(data[start:at], value)]
        fields.append([last, kind, value])
    return fields, at


def footer(file: BinaryIO, length: int) -> Struct:
    """The footer of a Parquet file of ``length`` bytes; a file that is none, or is encrypted, is refused. Footers may share their schema's list."""
    data = _packed_footer(file, length)
    fields, at = _head(data)
    # what is left is numbered from the last field on
    last = fields[-1][0] if fields else 0
    while head := data[at]:
        kind, at = head & 15, at + 1
        if head >> 4:
            last += head >> 4
        else:
            last, at = _value(data, at, I32)
        value, at = _value(data, at, kind)
        fields.append([last, kind, value])
    return fields


def outline(file: BinaryIO, length: int) -> Struct:
    """The schema and the number of rows of ``footer``, without its blocks."""
    return _head(_packed_footer(file, length))[0]


#: Field ids of the Parquet footer, from the format's public definition.
SCHEMA, ROWS, BLOCKS, KEY_VALUES = 2, 3, 4, 5
CHUNKS, BLOCK_ROWS, BLOCK_OFFSET, ORDINAL = 1, 3, 5, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META, CHUNK_INDEXES = 1, 2, 3, (4, 5, 6, 7)
PACKED_SIZE, DATA_OFFSET, INDEX_OFFSET, DICTIONARY_OFFSET, BLOOM = 7, 9, 10, 11, (14, 15)


def layout(meta: Struct) -> bytes:
    """The schema's encoding; files with equal layouts can share blocks."""
    out = _Writer()
    out.value(LIST, get(meta, SCHEMA))
    return bytes(out.out)


def row_count(meta: Struct) -> int:
    return get(meta, ROWS)


def block_count(meta: Struct) -> int:
    return len(get(meta, BLOCKS, [STRUCT, []])[1])


def _meta(chunk: Struct) -> dict[int, Any]:
    """The metadata of a column block by field id."""
    meta = get(chunk, CHUNK_META)
    if meta is None or get(chunk, CHUNK_PATH) is not None:
        raise LakeError("UNSUPPORTED_PARQUET_FEATURE", "a column block outside its file or without metadata")
    return {k: x for k, _, x in meta}


def _span(meta: dict[int, Any]) -> tuple[int, int]:
    return min(x for k in (DATA_OFFSET, DICTIONARY_OFFSET, INDEX_OFFSET) if (x := meta.get(k))), meta[PACKED_SIZE]


#: More field ids, and the encodings that need a dictionary.
KIND, ENCODINGS, CODEC, VALUES, FULL_SIZE, STATISTICS, ENCODING_STATS, SIZE_STATS = 1, 2, 4, 5, 6, 12, 13, 16
BLOCK_FULL_SIZE, SORTED_BY, BLOCK_PACKED_SIZE = 2, 4, 6
NULLS, MOST, LEAST_VALUE, MOST_EXACT, LEAST_EXACT = 3, 5, 6, 7, 8
DICTIONARIES = frozenset((2, 8))
#: Blocks are joined up to about this many bytes and rows; a joined block is held in memory until it is written.
JOIN_BYTES, JOIN_ROWS = 32 << 20, 1 << 20


def _orders(meta: Struct) -> list:
    """Of each leaf column, how its encoded bounds compare (a function to a sortable value), or None if that isn't known."""
    plain = {1: "<i", 2: "<q", 4: "<f", 5: "<d"}
    found = []
    for element in get(meta, SCHEMA)[1][1:]:
        if get(element, 5):  # a group
            continue
        kind, converted, logical = get(element, 1), get(element, 6), get(element, 10) or []
        unsigned = converted in (11, 12, 13, 14) or any(k == 10 and get(x, 2) is False for k, _, x in logical)
        if kind in plain and not unsigned:
            found.append(lambda raw, code=plain[kind]: struct.unpack(code, raw)[0])
        elif kind == 0 or kind == 6 and converted in (None, 0) and all(k == 1 for k, _, _ in logical):
            found.append(bytes)
        else:
            found.append(None)
    return found


def _joined_statistics(parts: list[Struct | None], order) -> Struct:
    """The statistics of blocks taken together: nulls, and bounds where every block with values has them and they compare."""
    out: Struct = []
    if any(p is None for p in parts):
        return out
    nulls = [get(p, NULLS) for p in parts]
    if all(n is not None for n in nulls):
        out.append([NULLS, I64, sum(nulls)])
    if order is None or any(get(p, MOST) is None or get(p, LEAST_VALUE) is None for p in parts):
        return out
    bounds = [(order(get(p, LEAST_VALUE)), order(get(p, MOST)), p) for p in parts]
    if any(low != low or high != high for low, high, _ in bounds):  # NaN
        return out
    least, most = min(bounds, key=lambda x: x[0])[2], max(bounds, key=lambda x: x[1])[2]
    out += [[MOST, BINARY, get(most, MOST)], [LEAST_VALUE, BINARY, get(least, LEAST_VALUE)]]
    for key, p in ((MOST_EXACT, most), (LEAST_EXACT, least)):
        if get(p, key) is not None:
            out.append([key, TRUE, get(p, key)])
    return out


def _joinable(metas: list[dict[int, Any]]) -> bool:
    """Whether the pages of a block's columns may follow other pages: no column needs a dictionary of its own."""
    return all(m.get(DICTIONARY_OFFSET) is None and DICTIONARIES.isdisjoint(m[ENCODINGS][1]) for m in metas)


class _Copier:
    """Writes blocks one after another, joining neighbours whose pages may share a block."""

    def __init__(self, out: BinaryIO, orders: list):
        self.out, self.orders, self.at = out, orders, len(MAGIC)
        self.blocks: list[Struct] = []
        self._held: list[Struct] = []
        self._pages: list[list[bytes]] = []
        self._codecs: list[int] = []
        self._size = self._rows = 0

    def add(self, file: BinaryIO, block: Struct) -> None:
        chunks = get(block, CHUNKS)[1]
        metas = [_meta(c) for c in chunks]
        spans = [_span(m) for m in metas]
        size, rows = sum(n for _, n in spans), get(block, BLOCK_ROWS)
        if not _joinable(metas) or size > JOIN_BYTES:
            self.flush()
            return self._copy(file, block)
        codecs = [m[CODEC] for m in metas]
        if self._held and (self._size + size > JOIN_BYTES or self._rows + rows > JOIN_ROWS or codecs != self._codecs):
            self.flush()
        if not self._held:
            self._pages, self._codecs = [[] for _ in chunks], codecs
        for pages, span in zip(self._pages, spans):
            pages.extend(_pieces(file, *span))
        self._held.append(block)
        self._size, self._rows = self._size + size, self._rows + rows
        return None

    def _placed(self, block: Struct, start: int) -> None:
        put(block, BLOCK_OFFSET, start)
        block[:] = [f for f in block if f[0] != ORDINAL]
        self.blocks.append(block)

    def _copy(self, file: BinaryIO, block: Struct) -> None:
        start = self.at
        for chunk in get(block, CHUNKS)[1]:
            begin, n = _span(_meta(chunk))
            for piece in _pieces(file, begin, n):
                self.out.write(piece)
            inner = get(chunk, CHUNK_META)
            for key in (DATA_OFFSET, INDEX_OFFSET, DICTIONARY_OFFSET):
                if get(inner, key):
                    put(inner, key, get(inner, key) - begin + self.at)
            inner[:] = [f for f in inner if f[0] not in BLOOM]
            chunk[:] = [f for f in chunk if f[0] not in CHUNK_INDEXES]
            put(chunk, CHUNK_OFFSET, 0)
            self.at += n
        self._placed(block, start)

    def flush(self) -> None:
        """Write the blocks held, as one."""
        if not self._held:
            return
        start, first = self.at, self._held[0]
        columns = [[get(get(b, CHUNKS)[1][i], CHUNK_META) for b in self._held] for i in range(len(self._pages))]
        for chunk, pages, metas, order in zip(get(first, CHUNKS)[1], self._pages, columns, self.orders):
            inner = get(chunk, CHUNK_META)
            if len(metas) > 1:
                statistics = _joined_statistics([get(m, STATISTICS) for m in metas], order)
                encodings = sorted({e for m in metas for e in get(m, ENCODINGS)[1]})
                sums = {k: sum(get(m, k) for m in metas) for k in (VALUES, FULL_SIZE, PACKED_SIZE)}
                dropped = {ENCODING_STATS, SIZE_STATS, STATISTICS, INDEX_OFFSET}
                inner[:] = sorted([[k, t, sums.get(k, x)] for k, t, x in inner if k not in dropped] + ([[STATISTICS, STRUCT, statistics]] if statistics else []), key=lambda f: f[0])
                put(inner, ENCODINGS, [I32, encodings])
            put(inner, DATA_OFFSET, self.at)
            inner[:] = [f for f in inner if f[0] not in BLOOM]
            chunk[:] = [f for f in chunk if f[0] not in CHUNK_INDEXES]
            put(chunk, CHUNK_OFFSET, 0)
            for page in pages:
                self.out.write(page)
                self.at += len(page)
        if len(self._held) > 1:
            for key in (BLOCK_FULL_SIZE, BLOCK_ROWS, BLOCK_PACKED_SIZE):
                if all(get(b, key) is not None for b in self._held):
                    put(first, key, sum(get(b, key) for b in self._held))
            first[:] = [f for f in first if f[0] != SORTED_BY]
        self._placed(first, start)
        self._held, self._pages, self._size, self._rows = [], [], 0, 0


def _pieces(file: BinaryIO, begin: int, n: int) -> Iterator[bytes]:
    """``n`` bytes of ``file`` from ``begin`` on."""
    file.seek(begin)
    while n:
        piece = file.read(min(n, 1 << 22))
        if not piece:
            raise LakeError("UNSUPPORTED_PARQUET_FEATURE", "a column block ends beyond its file")
        yield piece
        n -= len(piece)


def merge(sources: Iterable[tuple[BinaryIO, int]], out: BinaryIO) -> dict[str, int]:
    """Copy the blocks of all ``sources`` (file, length) into ``out``; counts of files, blocks read, blocks written (groups), rows and bytes.

    All must have one layout. Neighbouring small blocks become one where no column of theirs has a dictionary: their
    pages then follow each other under one entry of the footer, with joined statistics. Blocks with dictionaries stay as
    they are. Page indexes and Bloom filters, which lie outside the blocks, are left out of the new file, and so are
    blocks without rows. The footer as written is read again and its blocks and rows are compared with the sums of the
    sources'.
    """
    out.write(MAGIC)
    first, copier, blocks, rows, files = None, None, 0, 0, 0
    for file, length in sources:
        meta = footer(file, length)
        if first is None:
            first, shape = meta, get(meta, SCHEMA)
            copier = _Copier(out, _orders(meta))
        elif get(meta, SCHEMA) != shape:
            raise LakeError("SCHEMA_CONFLICT", "blocks of different schemas can't share a file")
        files, rows = files + 1, rows + row_count(meta)
        for block in get(meta, BLOCKS)[1]:
            if get(block, BLOCK_ROWS):  # a file without rows may have an empty block, which has no place
                copier.add(file, block)
                blocks += 1
    if first is None:
        raise LakeError("VALIDATION_ERROR", "no file to merge")
    copier.flush()
    put(first, ROWS, rows)
    put(first, BLOCKS, [STRUCT, copier.blocks])
    packed = _Writer()
    packed.struct(first)
    again = _struct(bytes(packed.out), 0)[0]
    totals = sum(get(b, BLOCK_ROWS) for b in get(again, BLOCKS)[1])
    if row_count(again) != rows or totals != rows or block_count(again) != len(copier.blocks):
        raise LakeError("VALIDATION_ERROR", "the merged footer doesn't hold the rows and blocks of its sources")
    out.write(packed.out + struct.pack("<I", len(packed.out)) + MAGIC)
    return {"files": files, "blocks": blocks, "groups": len(copier.blocks), "rows": rows, "bytes": copier.at + len(packed.out) + 8}


def merge_bytes(files: Iterable[bytes]) -> tuple[bytes, dict[str, int]]:
    """``merge`` of files in memory."""
    out = io.BytesIO()
    counts = merge(((io.BytesIO(x), len(x)) for x in files), out)
    return out.getvalue(), counts
