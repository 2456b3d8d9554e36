"""Token counts and token ids (operator 8, and what operators 2 and 7 build on).

Batches are balanced by bytes: a chunk holds BATCH_BYTES of texts, and a longer text is split where the pre-tokenizer
always ends a piece.  Texts are then cut where the byte-level pre-tokenizer cuts them, by array operations over a whole
chunk; of the distinct pieces of a chunk those that a bounded cache lacks are encoded by the tokenizers library (its
model's ``tokenize``).  The sum over pieces is what the library gives for the text, because a byte-level BPE never
merges across pieces.  Pieces are told apart by their bytes, in the chunk and in the cache.  Vocabularies with another
normalizer, pre-tokenizer or post-processor, and texts with special strings, take the library's own batch encoding.

Defined results: null and empty text have 0 tokens; repeated rows are counted each; extra columns are
ignored; special strings inside texts are handled as the library does by default (one special id).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import LOWER, Rolling, chunks, column_bytes, ragged
from shelfspark.llm.common import bounded_batches, unused

BATCH_BYTES = 1 << 19
PIECE_BYTES = 1 << 16
#: The cache of a worker is emptied beyond so many pieces, or so many bytes of long pieces and their ids.
CACHE_ENTRIES, CACHE_BYTES = 1_200_000, 64 << 20
LIMIT = 512
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class that the pre-tokenizer's pattern gives each code point, found by the pattern itself."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for low in range(0, 0x110000, 0x1000):
            if 0xD800 <= low < 0xE000:
                continue
            text = "".join(map(chr, range(low, low + 0x1000)))
            for m in regex.finditer(pattern, text):
                out[low + m.start() : low + m.end()] = kind
    return out


#: The endings that the pattern takes with an apostrophe before them.
_SHORT = [np.array([ord(c) for c in s], np.uint32) for s in ("s", "t", "re", "ve", "m", "ll", "d")]


def piece_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer starts a piece, in code points; borders: document offsets (pieces never cross them)."""
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[borders] = True
    space = kind == _SPACE
    before = np.concatenate([[False], space[:-1]])
    before[first[:-1]] = False
    blank = points == 0x20
    before_blank = np.concatenate([[False], blank[:-1]]) & before
    start = first[:-1].copy()
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    joined = ~space & before_blank  # a text piece takes the blank before it
    start |= change & ~joined
    # the last of several spaces before a text piece stands alone or goes with that piece
    ahead = np.concatenate([~space[1:], [False]])
    ahead[borders[(borders > 0)] - 1] = False
    start |= space & ahead
    # apostrophes with a short ending
    for a in np.flatnonzero((points == 0x27) & (start | first[:-1])):
        if joined[a] or (a + 1 < n and kind[a + 1] != _LETTER):
            continue
        for s in _SHORT:
            e = a + 1 + len(s)
            if e <= n and not first[a + 1 : e].any() and (points[a + 1 : e] == s).all():
                start[a + 1 : e] = False
                if e < n:
                    start[e] = True
                break
    return np.flatnonzero(start)


_HASH = Rolling(23)
#: Keeps so many leading bytes of a little-endian word.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)], np.uint64)


class PieceEncoder:
    """Encodes documents piece by piece through a cache; one for each worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.plain = bool(spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and all(len(x["content"]) > 1 and not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) for x in spec.get("added_tokens", [])))
        if self.plain:
            self.byte_char = self._byte_chars()
        self._reset()

    def _reset(self) -> None:
        self.row: dict[int | bytes, int] = {}
        self.flat: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0
        self.held = 0

    @staticmethod
    def _byte_chars() -> str:
        """What the byte-level alphabet writes for byte i: printable Latin-1 as itself, the rest from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))

    def _add(self, pieces: dict[int | bytes, bytes]) -> None:
        """New pieces by their keys."""
        table = dict(enumerate(self.byte_char))
        need = len(self.row) + len(pieces)
        if need > len(self.lengths):
            grow = max(need, 2 * len(self.lengths))
            self.lengths, self.starts = np.resize(self.lengths, grow), np.resize(self.starts, grow)
        out: list[int] = []
        tokenize = self.model.tokenize
        used = self.used
        for key, piece in pieces.items():
            ids = [t.id for t in tokenize(piece.decode("latin-1").translate(table))]
            at = len(self.row)
            self.row[key] = at
            self.lengths[at], self.starts[at] = len(ids), used
            used += len(ids)
            out += ids
        if used > len(self.pool):
            self.pool = np.resize(self.pool, max(used, 2 * len(self.pool)))
        self.pool[self.used : used] = out
        self.held += 4 * (used - self.used) + sum(len(k) for k in pieces if isinstance(k, bytes))
        self.used = used

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cache row of each piece, and each document's offsets into the pieces."""
        if len(self.row) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            self._reset()
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        text_start = (data & 0xC0) != 0x80
        if text_start.all():
            points, borders, at_byte = data, offsets, None
        else:
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            at_byte = np.flatnonzero(text_start)
            borders = np.searchsorted(at_byte, offsets)
        starts = piece_starts(points, np.unique(borders))
        if at_byte is not None:
            starts = at_byte[starts]
        ends = np.append(starts[1:], len(data))
        length = ends - starts
        # short pieces are keys themselves (their bytes and length); of long ones a fingerprint, compared byte by byte
        key = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))[starts]
        key = (key & _MASK[np.minimum(length, 7)]) | (length.astype(np.uint64) << np.uint64(56))
        long = np.flatnonzero(length > 7)
        key[long] = _HASH.spans(_HASH.prefix(_HASH.table[data]), starts[long], ends[long]) | np.uint64(1 << 63)
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        like, size = first[inverse[long]], length[long]
        if not (np.array_equal(length[like], size) and np.array_equal(data[ragged(starts[like], size)], data[ragged(starts[long], size)])):
            first = inverse = np.arange(len(starts))  # two pieces with one fingerprint: each piece is looked up for itself
            unique = key
        raw, row = data.tobytes(), self.row
        keys: list[int | bytes] = unique.tolist()
        spans = lambda of: zip(of.tolist(), starts[first[of]].tolist(), ends[first[of]].tolist(), strict=True)
        for k, s, e in spans(np.flatnonzero(length[first] > 7)):
            keys[k] = raw[s:e]
        table = np.array([row.get(k, -1) for k in keys], np.int64)
        lack = {keys[k]: raw[s:e] for k, s, e in spans(np.flatnonzero(table < 0))}
        if lack:
            self._add(lack)
            table = np.array([row[k] for k in keys], np.int64)
        return table[inverse], np.searchsorted(starts, offsets)

    def _has_special(self, data: np.ndarray) -> bool:
        raw = data.tobytes()
        return any(x.encode() in raw for x in self.special)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a chunk, and each document's offsets into them."""
        if not self.plain or self._has_special(data):
            got = self._library(data, offsets)
            return (np.concatenate(got).astype(np.uint32) if got else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        ids, ends = [], np.zeros(len(offsets), np.int64)
        for part, border in split_long(data, offsets, BATCH_BYTES):
            rows, at = self.rows(part, border)
            lengths = self.lengths[rows]
            ids.append(self.pool[ragged(self.starts[rows], lengths)])
            ends += np.concatenate([[0], np.cumsum(lengths)])[at]
        return (ids[0] if len(ids) == 1 else np.concatenate(ids)), ends

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each document."""
        if not self.plain or self._has_special(data):
            return np.array([len(x) for x in self._library(data, offsets)], np.int64)
        out = np.zeros(len(offsets) - 1, np.int64)
        for part, border in split_long(data, offsets, BATCH_BYTES):
            rows, at = self.rows(part, border)
            total = np.concatenate([[0], np.cumsum(self.lengths[rows])])
            out += total[at[1:]] - total[at[:-1]]
        return out

    def _library(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The library's own batch encoding; where cuts are safe, long texts go in pieces."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        pieces, owner = [], []
        for k, t in enumerate(texts):
            for p in safe_pieces(t, PIECE_BYTES) if self.plain else [t]:
                pieces.append(p)
                owner.append(k)
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for k, e in zip(owner, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            got[k].append(np.array(e.ids, np.uint32))
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in got]


def split_long(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets): a chunk as it is, or a single long text in parts that end before a blank or line feed after an ASCII letter or digit."""
    if len(offsets) != 2 or len(data) <= size:
        yield data, offsets
        return
    after = np.flatnonzero((data[1:] == 0x20) | (data[1:] == 0x0A)) + 1
    before = LOWER[data[after - 1]]
    after = after[((before >= 0x61) & (before <= 0x7A)) | ((before >= 0x30) & (before <= 0x39))]
    at = 0
    while at < len(data):
        k = np.searchsorted(after, at + size, "right") - 1
        if k >= 0 and after[k] > at and at + size < len(data):
            end = int(after[k])
        else:  # the rest, or no safe place so soon: up to the next one
            end = len(data) if at + size >= len(data) or k + 1 == len(after) else int(after[k + 1])
        yield data[at:end], np.array([0, end - at])
        at = end


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """Cuts before a blank or line feed that follows a letter or digit: the pattern always ends a piece there."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut > at and not (text[cut] in " \n" and text[cut - 1].isalnum()):
            cut -= 1
        if cut == at:  # no safe place: the piece grows to the next one
            cut = at + size
            while cut < len(text) and not (text[cut] in " \n" and text[cut - 1].isalnum()):
                cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def token_counts(docs: DataFrame, vocabulary_path: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """keys, n_bytes, n_tokens, over_limit of every row. Map only: nothing is shuffled, only numbers leave the workers.

    A ``.model`` vocabulary is counted by sentencepiece, a ``.json`` one by tokenizers.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(*keys, F.col(text).alias(unused(list(keys), "__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", n_bytes long, n_tokens long, over_limit boolean"

    def count(batches):
        if vocabulary_path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)

            def of(data, offsets):
                raw = data.tobytes()
                return np.array([len(x) for x in model.encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], num_threads=1)], np.int64)
        else:
            of = piece_encoder(vocabulary_path).count
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n = [of(data, offsets) for _, _, data, offsets in chunks(column, BATCH_BYTES)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            sizes = np.diff(column_bytes(column)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(count, schema)
