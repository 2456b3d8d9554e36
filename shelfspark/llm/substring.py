"""Substring dedup (operator 9): words in windows of 13 that a document of smaller id has too are removed.

The method is the levelled fingerprint index of ``repeats``: sorted immutable runs of window fingerprints,
merge-joined with the runs of every other batch of documents, verified by second fingerprints, compacted.

Defined results: null and empty text have no words; a null doc_id is smaller than all others; rows with one
doc_id count as one document (its windows don't remove each other); a document of fewer than 13 words loses
nothing; an empty table gives no rows; extra columns are ignored by ``substring_dedup`` and kept by
``remove_repeats``, which also drops rows that lose every word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import per_document, ragged, word_hashes, words
from shelfspark.llm.repeats import SHARD_BYTES, Rule, repeated_windows

RULE = Rule(window=13, gram=4, ordered=True)
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _read(data, offsets):
    s, e, at = words(data, offsets)
    h = word_hashes(data, s, e)
    return (lambda: h), at, s, e, data, offsets


def kept_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, gone: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The kept words of a chunk, each with a blank after it, and each document's start and end (without the last blank) in them."""
    stay = ~gone
    length = (e - s)[stay] + 1
    place = ragged(s[stay], length)
    out = np.append(data, np.uint8(0x20))[place]
    ends = np.cumsum(length)
    out[ends - 1] = 0x20
    n = np.concatenate([[0], np.cumsum(stay)])[at]
    border = np.concatenate([[0], ends])[n]
    return memoryview(out), border[:-1], np.maximum(border[1:] - 1, border[:-1])


#: Of a word with the blank after it, for the number of index partitions.
WORD_BYTES = 6


def digest_rows(table: pa.Table, pieces) -> pa.Table:
    """The rows of a shard with the digest of what is kept; pieces: its chunks with the flags of repeated words."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    ids, rows = table.column("__id").combine_chunks(), []
    for piece, gone in pieces:
        s, e, data, _ = piece.extra
        raw, a, b = kept_words(data, s, e, piece.at, gone)
        digest = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        rows.append(pa.table([ids.slice(piece.first_row, len(a)), np.diff(piece.at), per_document(gone, piece.at), digest], names=names))
    return pa.concat_tables(rows) if rows else pa.table([pa.array([], t) for t in types], names=names)


def substring_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rule: Rule = RULE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return repeated_windows(docs.select(F.col(key), F.col(text)), rule, _read, digest_rows, DIGEST, key=key, text=text, symbol_bytes=WORD_BYTES, shard_bytes=shard_bytes)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: str | None = "n_chars", rule: Rule = RULE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with repeated words cut out of the texts (white space between kept words stays) and ``size`` counted anew."""
    schema = docs.schema

    def finish(table, pieces):
        table, out = table.select(range(len(schema.names))).rename_columns(schema.names), []
        for piece, gone in pieces:
            s, e, data, offsets = piece.extra
            n = len(offsets) - 1
            lost, had = per_document(gone, piece.at), np.diff(piece.at)
            part = table.slice(piece.first_row, n)
            changed = np.flatnonzero(lost)
            if len(changed):
                d = np.zeros(len(data) + 1, np.int64)
                until = np.append(s[1:], len(data))  # a word goes with the white space after it
                border = np.searchsorted(offsets, s, "right")
                until = np.minimum(until, offsets[border])
                np.add.at(d, s[gone], 1)
                np.add.at(d, until[gone], -1)
                stay = np.cumsum(d)[:-1] == 0
                texts = part.column(text).to_pylist()
                for k in changed.tolist():
                    x = slice(offsets[k], offsets[k + 1])
                    texts[k] = data[x][stay[x]].tobytes().decode("utf-8").rstrip(" \t\n\v\f\r")
                part = part.set_column(schema.names.index(text), text, pa.array(texts, pa.string()))
                if size in schema.names:
                    sizes = part.column(size).to_pylist()
                    for k in changed.tolist():
                        sizes[k] = len(texts[k])
                    part = part.set_column(schema.names.index(size), size, pa.array(sizes, part.schema.field(size).type))
            out.append(part.filter(pa.array((lost == 0) | (lost < had))))
        return pa.concat_tables(out) if out else table.slice(0, 0)

    return repeated_windows(docs, rule, _read, finish, schema, key=key, text=text, symbol_bytes=WORD_BYTES, shard_bytes=shard_bytes)
