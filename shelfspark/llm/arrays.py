"""Vectorised text helpers for Arrow batches.

Everything here works on one *chunk*: the UTF-8 bytes of some documents laid end to end plus the
offsets of the documents.  Chunks are bounded by bytes, so memory in a task does not grow with the
number of rows; one document is never split (its word arrays are what every operator needs whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
#: ``[\x20\x09-\x0D]``, the white space of the word contracts.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but digits, lower-case letters and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False
NOT_ALNUM[0x80:] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    return _mixed(np.asarray(x, np.uint64))


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


class Rolling:
    """Polynomial fingerprints of any span of a symbol array from one prefix sum (arithmetic modulo 2^64)."""

    def __init__(self, seed: int):
        self.table = constants(seed, 256)
        base = int(constants(seed + 1000, 1)[0]) | 5
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.pw = self.ipw = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pw) <= n:
            size = max(1 << 17, 1 << int(n + 1).bit_length())
            self.pw = np.cumprod(np.concatenate([[_U(1)], np.full(size, self.base, np.uint64)]), dtype=np.uint64)
            self.ipw = np.cumprod(np.concatenate([[_U(1)], np.full(size, self.inverse, np.uint64)]), dtype=np.uint64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols))
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.pw[: len(symbols)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.ipw[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Of each span of that length, by start."""
        n = len(prefix) - length
        return mix((prefix[length:] - prefix[:n]) * self.ipw[:n]) if n > 0 else np.zeros(0, np.uint64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes, or of one longer row."""
    data, offsets = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, at + 4096, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's offsets into them; no word crosses documents."""
    inside = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_WORDS = Rolling(11)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word, the same wherever the word stands; long inputs are hashed in pieces of whole words."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
        base = starts[at]
        prefix = _WORDS.prefix(_WORDS.table[data[base : ends[end - 1]]])
        out[at:end] = _WORDS.spans(prefix, starts[at:end] - base, ends[at:end] - base)
        at = end
    return out


def ngrams(symbols: np.ndarray, n: int, seed: int = 77) -> np.ndarray:
    """A fingerprint of each n consecutive symbols (document borders are the caller's)."""
    size = len(symbols) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for j, c in enumerate(constants(seed, n)):
        out += symbols[j : j + size] * c
    return mix(out)


def valid_starts(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which positions start n consecutive symbols of one document; size: how many to report."""
    ok = np.zeros(offsets[-1] + 1, np.int32)
    lengths = np.diff(offsets)
    good = lengths >= n
    np.add.at(ok, offsets[:-1][good], 1)
    np.add.at(ok, offsets[1:][good] - n + 1, -1)
    return np.cumsum(ok)[:size] > 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, in about log2(width) passes."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in any [start, end)."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d)[:size] > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each document has."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's runs of n symbols (of fewer: the whole sequence as one) and the documents' offsets into them."""
    size = np.diff(at)
    counts = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(to[-1]), np.uint64)
    full = np.repeat(size >= n, counts)
    if full.any():
        out[full] = ngrams(h, n)[ragged(at[:-1], counts)[full]]
    for m in range(1, n):
        few = np.flatnonzero(size == m)
        if len(few):
            out[to[few]] = ngrams(h, m, 50 + m)[at[few]]
    return out, to
