"""Files reached from Python tasks by URI: the local file system directly, others through pyarrow."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` or plain path; None for other schemes. Escapes stay, as in the paths that Hadoop's client gives."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", uri) else uri


def open_read(uri: str) -> tuple[BinaryIO, int]:
    """An open file and its length."""
    if path := local_path(uri):
        return open(path, "rb"), os.path.getsize(path)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path), system.get_file_info(path).size


#: Parts of files up to this many bytes are read at once.
AT_ONCE = 1 << 20


class _Part(io.RawIOBase):
    """``length`` bytes of ``file`` from ``start`` on, as a file."""

    def __init__(self, file: BinaryIO, start: int, length: int):
        self.file, self.start, self.length, self.at = file, start, length, 0

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.length)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        left = max(0, self.length - self.at)
        self.file.seek(self.start + self.at)
        piece = self.file.read(left if n is None or n < 0 else min(n, left))
        self.at += len(piece)
        return piece

    def close(self) -> None:
        self.file.close()
        super().close()


def open_part(uri: str, start: int | None, length: int) -> tuple[BinaryIO, int]:
    """``open_read`` of the file that is ``length`` bytes of the file at ``uri`` from ``start`` on; without ``start``, of the file itself."""
    file, whole = open_read(uri)
    if start is None:
        return file, whole
    if length > AT_ONCE:
        return _Part(file, start, length), length
    with file:
        file.seek(start)
        return io.BytesIO(file.read(length)), length


@contextmanager
def writing(uri: str, attempt: str) -> Iterator[BinaryIO]:
    """A file to write to, that appears whole when the block ends and not at all if it fails, also if two attempts of a task write it."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{attempt}.tmp"
        try:
            with open(temporary, "wb") as f:
                yield f
            os.replace(temporary, path)
        finally:
            if os.path.exists(temporary):
                os.remove(temporary)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{attempt}.tmp"
    with system.open_output_stream(temporary) as f:
        yield f
    system.move(temporary, path)


def write_whole(uri: str, data: bytes | Iterable[bytes], attempt: str) -> None:
    """``writing`` of bytes, given at once or piece by piece."""
    with writing(uri, attempt) as f:
        for piece in [data] if isinstance(data, bytes) else data:
            f.write(piece)
