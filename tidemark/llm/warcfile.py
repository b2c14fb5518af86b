"""Writing and reading WARC files as streams in Python workers, on any Arrow file system."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.IGNORECASE)
_ID = re.compile(rb"\r\nwarc-record-id:[ \t]*([^\r\n]*)", re.IGNORECASE)
CHUNK = 1 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_folder(path: str, create: bool = False):
    store, inner = _store(path)
    if create:
        store.create_dir(inner, recursive=True)
    return store, inner


def write_file(path: str):
    """A buffered output stream."""
    store, inner = _store(path)
    return store.open_output_stream(inner, compression=None, buffer_size=CHUNK)


def member(record: bytes) -> bytes:
    """A record as a gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a stream with their closing lines, one held at a time; bytes that start no record are an error."""
    data, at = bytearray(), 0

    def more() -> bool:
        chunk = next(chunks, b"")
        data.extend(chunk)
        return bool(chunk)

    while more() or data:
        start = 0
        while (end := data.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(data) - 3)
            if len(data) >= 5 and not data.startswith(b"WARC/") or not more():
                raise ValueError(f"no record at byte {at}")
        length = _LENGTH.search(data, 0, end + 2)
        if length is None or not data.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        stop = end + 8 + int(length[1])
        while len(data) < stop and more():
            pass
        if data[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield bytes(data[:stop])
        del data[:stop]
        at += stop


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of gzip members, one after the other."""
    unzip, open_ = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            open_ = True
            if data := unzip.decompress(chunk):
                yield data
            chunk = b""
            if unzip.eof:
                chunk, unzip, open_ = unzip.unused_data, zlib.decompressobj(31), False
    if open_:
        raise ValueError("the last member is cut short")


def scan(path: str) -> Iterator[tuple[int, str, str, bytes]]:
    """Offset, record id, SHA-256 and bytes of each record of a file; files named .gz hold gzip members, offsets are those of the unpacked stream."""
    store, inner = _store(path)
    at = 0
    with store.open_input_stream(inner, compression=None) as f:
        chunks = iter(lambda: f.read(CHUNK), b"")
        for record in split_records(_unpacked(chunks) if path.endswith(".gz") else chunks):
            name = _ID.search(record, 0, record.find(b"\r\n\r\n") + 2)
            yield at, name[1].decode("utf-8", "replace") if name else "", hashlib.sha256(record).hexdigest(), record
            at += len(record)
