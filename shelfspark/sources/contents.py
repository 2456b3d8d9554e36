"""Contents of listed files, read in tasks by ranges of a few MB; a path is on a mount of every executor, or a URI that Arrow's file systems open."""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

from shelfspark.functions.content import HEADER_BYTES, INES_MAGIC, LYNX_MAGIC, N64, PAYLOAD_LIMIT, V64

CHUNK = 4 << 20
#: What reading a file or an archive may raise; such a file has no digests.
UNREADABLE = (OSError, EOFError, NotImplementedError, RuntimeError, ValueError, zipfile.BadZipFile, zlib.error)


def opened(path: str) -> BinaryIO:
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _chunks(stream: BinaryIO) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield bytes(chunk)


def _led(chunks: Iterator[bytes], n: int) -> Iterator[bytes]:
    """The same bytes, the first chunk of n bytes or more where there are as many."""
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) >= n:
            yield head
            yield from chunks
            return
    if head:
        yield head


def _swapped(chunks: Iterator[bytes], unit: int) -> Iterator[bytes]:
    """Bytes of each unit turned round, the last unit padded with zeros."""
    rest = b""
    for chunk in chunks:
        rest += chunk
        whole = len(rest) - len(rest) % unit
        yield np.frombuffer(rest[:whole], f"u{unit}").byteswap().tobytes()
        rest = rest[whole:]
    if rest:
        yield np.frombuffer(rest + b"\0" * (unit - len(rest)), f"u{unit}").byteswap().tobytes()


def bare(chunks: Iterator[bytes], rule: str | None, size: int | None) -> Iterator[bytes]:
    """The content without the header that its rule names, chunk by chunk. size: of all bytes, for the rule that goes by it."""
    chunks = _led(chunks, 64)
    first = next(chunks, b"")
    skip, unit = 0, None
    if rule == "smc_512" and size % 1024 == 512:
        skip = HEADER_BYTES[rule]
    elif rule == "ines_16" and first.startswith(bytes.fromhex(INES_MAGIC)):
        skip = HEADER_BYTES[rule]
    elif rule == "lynx_64" and first.startswith(bytes.fromhex(LYNX_MAGIC)):
        skip = HEADER_BYTES[rule]
    elif rule == "n64_byteswap":
        unit = {V64: 2, N64: 4}.get(first[:4])

    def every() -> Iterator[bytes]:
        left = skip
        for chunk in [first] if first else []:
            yield chunk[left:]
            left = max(0, left - len(chunk))
        for chunk in chunks:
            yield chunk[left:]
            left = max(0, left - len(chunk))

    return _swapped(every(), unit) if unit else every()


def _digest(chunks: Iterator[bytes]) -> tuple[str, str, str, int]:
    crc, sha1, md5, size = 0, hashlib.sha1(), hashlib.md5(), 0
    for chunk in chunks:
        crc = zlib.crc32(chunk, crc)
        sha1.update(chunk)
        md5.update(chunk)
        size += len(chunk)
    return f"{crc:08x}", sha1.hexdigest(), md5.hexdigest(), size


def _within(chunks: Iterator[bytes], limit: int) -> Iterator[bytes]:
    size = 0
    for chunk in chunks:
        size += len(chunk)
        if size > limit:  # the size in the directory may be a lie
            raise ValueError("the payload is too large")
        yield chunk


def digests_of(path: str, rule: str | None, limit: int = PAYLOAD_LIMIT, raw: bool = False) -> tuple[str, str, str, int] | None:
    """crc32, sha1, md5 and size of a file without its header (of a .zip: of its largest file, the first of equals), one pass; null if it can't be read. raw: of its bytes as they are."""
    try:
        with opened(path) as stream:
            if raw:
                return _digest(_chunks(stream))
            if not path.lower().endswith(".zip"):
                size = None
                if rule == "smc_512":
                    size = stream.seek(0, 2)
                    stream.seek(0)
                return _digest(bare(_chunks(stream), rule, size))
            with zipfile.ZipFile(stream) as archive:
                files = [i for i in archive.infolist() if not i.is_dir()]
                if not files:
                    return None
                largest, size = max(files, key=lambda i: i.file_size), None
                if rule == "smc_512":
                    with archive.open(largest) as inner:
                        size = sum(len(c) for c in _within(_chunks(inner), limit))
                with archive.open(largest) as inner:
                    return _digest(bare(_within(_chunks(inner), limit), rule, size))
    except UNREADABLE:
        return None


def archived_names(path: str) -> list[str]:
    """Names of a .zip's files by its directory; none if it can't be read."""
    try:
        with opened(path) as stream, zipfile.ZipFile(stream) as archive:
            return [i.filename for i in archive.infolist() if not i.is_dir()]
    except UNREADABLE:
        return []
