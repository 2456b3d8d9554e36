"""Suffix-array dedup (operator 3): bytes in 400-byte strings that also start anywhere else are removed.

A full suffix array takes 8 bytes or more for each byte of text.  The index family of ``repeats`` holds
*sampled* suffixes instead: those at anchors, about one in 73 bytes, chosen so that every 400-byte string has
one and equal strings have it at the same place.  Each batch (shard) sends its suffixes as sorted arrays,
ordered by the fingerprint of their first 256 bytes and then by that of the whole stretch of text around
them; an array is merge-scanned against the existing levels for matches, and levels of equal size merge
geometrically.  Where suffixes agree in part only, all 400-byte strings of that stretch are compared.

Passages of 50 or 60 words are often shorter than 400 bytes.  They aren't removed, but a first scan of the same
family, over the suffixes at the anchors of 256-byte strings, finds them: n_shared tells how many bytes of a document
lie in such 128-byte suffixes that another document has too.  Each string of 256 bytes or more that another
document has adds 128 bytes or more to it, and a document that shares no 128-byte string has 0.  Only stretches
that this scan leaves go on to the comparison of 400-byte strings.

Defined results: null text is empty; equal rows are different documents; matches never cross documents; a
document shorter than 400 bytes loses nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import constants, per_document
from shelfspark.llm.repeats import SHARD_BYTES, Rule, repeated_windows

RULE = Rule(window=400, gram=256, ordered=False, scout=(256, 128))
_SYMBOL = constants(303, 256)


def _read(data, offsets):
    return (lambda: _SYMBOL[data]), offsets, data


def suffix_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rule: Rule = RULE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (null if the rule has no scout) of every row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"]
    types = [pa.int64()] * 4 + [pa.string(), pa.int64()]

    def finish(table, pieces, shared=None):
        ids, rows = table.column("__id").combine_chunks(), []
        for piece, gone in pieces:
            (data,) = piece.extra
            first = gone.copy()
            same = np.ones(len(gone), bool)
            same[piece.at[:-1][piece.at[:-1] < len(gone)]] = False
            first[1:] &= ~(gone[:-1] & same[1:])
            stay = np.concatenate([[0], np.cumsum(~gone)])[piece.at]
            raw = memoryview(data[~gone])
            digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)]
            rows.append(pa.table([ids.slice(piece.first_row, len(digest)), np.diff(piece.at), per_document(gone, piece.at), per_document(first, piece.at), digest, pa.nulls(len(digest), pa.int64()) if shared is None else shared[piece.first_row : piece.first_row + len(digest)]], names=names))
        return pa.concat_tables(rows) if rows else pa.table([pa.array([], t) for t in types], names=names)

    return repeated_windows(docs.select(F.col(key), F.col(text)), rule, _read, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long", key=key, text=text, shard_bytes=shard_bytes)
