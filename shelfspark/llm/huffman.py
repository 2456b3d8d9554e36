"""Token-id files in canonical length-limited Huffman code (operator 7).

Ids of all documents stand in ascending doc_id order, each document followed by an end id.  A file holds the
ids of consecutive documents:

    magic "TIDH", version, counts; doc_id array with null flags; ids of each document; then blocks.

A block of BLOCK ids is coded by itself from a byte border on, with the bit offset of every STEP-th id, so any
block, or any part of one from a checkpoint on, is read without the rest.  Code lengths come from the counts of
ids over the whole corpus (package-merge, at most LIMIT bits); the codes follow from the lengths (canonical).
Decoding looks LIMIT bits up in a table and advances all checkpoints of a file together.

Defined results: a null or empty text has the end id alone; a null doc_id sorts before all others; rows with
equal doc_id follow each other in the order of their texts; extra columns are ignored; an empty table gives
no files and no rows; a corpus with more than 2^LIMIT (262,144) different ids raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.arrays import chunks, column_bytes, ragged
from shelfspark.llm.common import bounded_batches, dropping_shuffles, shared_dir, shard_count, stored, tasks_for
from shelfspark.llm.files import Replacing, read_file
from shelfspark.llm.tokens import BATCH_BYTES, piece_encoder

END_ID = 2
LIMIT = 18
BLOCK = 1 << 16
STEP = 128
FILE_IDS = 1 << 21
SHARD_BYTES = 24 << 20
_MAGIC = b"TIDH\x01"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # each list: weights, and for each element how it is made (a symbol: -1, a package: its number)
    lists, merged = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, merged])
        place = np.argsort(both, kind="stable")
        lists.append(place)
        both = both[place]
        pairs = len(both) // 2
        merged = both[0 : 2 * pairs : 2] + both[1 : 2 * pairs : 2]
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for place in reversed(lists):
        head = place[:take]
        symbols = head[head < n]
        lengths[symbols] += 1
        take = 2 * int((head >= n).sum())
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """id << 5 | length for every ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entry = (order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32)
    table = np.repeat(entry, 1 << (limit - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << limit) - len(table), np.uint32)])


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The coded bytes and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint32)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    # codes that start in one word don't overlap, so sums are ors
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    return out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8], at[::STEP].astype(np.uint32)


def decode_lanes(data: np.ndarray, bit: np.ndarray, count: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of all lanes (count[k] ids from bit[k] on), one lane after another."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    base = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint32)
    order = np.argsort(-count, kind="stable")
    bit, base, count = bit[order].astype(np.int64), base[order], count[order]
    shift, mask = np.int64(32 - limit), np.int64((1 << limit) - 1)
    live = len(count)
    for k in range(int(count[0]) if len(count) else 0):
        while count[live - 1] <= k:
            live -= 1
        bit = bit[:live]
        b = bit >> 3
        # limit + 7 bits fit into 4 bytes
        window = (data[b].astype(np.int64) << 24) | (data[b + 1].astype(np.int64) << 16) | (data[b + 2].astype(np.int64) << 8) | data[b + 3]
        entry = table[(window >> (shift - (bit & 7))) & mask]
        out[base[:live] + k] = entry >> np.uint32(5)
        bit = bit + (entry & np.uint32(31))
    return out


def pack_file(doc_ids: np.ndarray, null_id: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    head = [_MAGIC, struct.pack("<QQ", len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), null_id.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes()]
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        coded, steps = encode_block(part, codes, lengths)
        head += [struct.pack("<II", len(part), len(coded)), steps.astype("<u4").tobytes(), coded]
    return b"".join(head)


def unpack_file(raw: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, null flags, ids of each document, ids)"""
    if raw[:5] != _MAGIC:
        raise ValueError("not a token-id file")
    n, total = struct.unpack_from("<QQ", raw, 5)
    at = 21
    doc_ids = np.frombuffer(raw, "<i8", n, at)
    null_id = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
    sizes = np.frombuffer(raw, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    bits, counts, done = [], [], 0
    while done < total:
        size, coded = struct.unpack_from("<II", raw, at)
        lanes = -(-size // STEP)
        bits.append(np.frombuffer(raw, "<u4", lanes, at + 8).astype(np.int64) + 8 * (at + 8 + 4 * lanes))
        counts.append(np.append(np.full(lanes - 1, STEP), size - STEP * (lanes - 1)))
        at += 8 + 4 * lanes + coded
        done += size
    if not bits:
        return doc_ids, null_id, sizes, np.zeros(0, np.uint32)
    return doc_ids, null_id, sizes, decode_lanes(np.frombuffer(raw, np.uint8), np.concatenate(bits), np.concatenate(counts), table)


_GROUP = "doc_ids binary, null_ids binary, sizes binary, ids binary, part int, no int"


def tokenized_groups(docs: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of consecutive documents in order of doc_id, about file_ids ids each. The one shuffle is of the texts, by ranges of doc_id."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    parts = shard_count(source, "t", shard_bytes)
    ordered = source.repartitionByRange(parts, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")

    def run(batches):
        from pyspark import TaskContext

        encoder = piece_encoder(vocabulary_path)
        kind = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
        part, no = TaskContext.get().partitionId(), 0
        keep: list[list[np.ndarray]] = [[], [], [], []]
        held = 0

        def group():
            nonlocal keep, held, no
            k, null, size, ids = (np.concatenate(x) for x in keep)
            row = [k.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), size.astype("<u4").tobytes(), bytes([kind().itemsize]) + ids.tobytes()]
            keep, held, no = [[], [], [], []], 0, no + 1
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), pa.array([part], pa.int32()), pa.array([no - 1], pa.int32())], names=["doc_ids", "null_ids", "sizes", "ids", "part", "no"])

        for batch in batches:
            keys = batch.column(0)
            null = np.asarray(keys.is_null())
            values = keys.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(batch.column(1), BATCH_BYTES):
                ids, at = encoder.encode(data, offsets)
                sizes = np.diff(at) + 1
                out = np.full(len(ids) + b - a, end_id, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(b - a), sizes - 1)] = ids
                for x, y in zip(keep, (values[a:b], null[a:b], sizes, out), strict=True):
                    x.append(y)
                held += len(out)
                if held >= file_ids:
                    yield group()
        if held:
            yield group()

    return ordered.mapInArrow(run, _GROUP)


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1)


def id_counts(groups: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the whole corpus; the result has one number for each id of the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(_ids(x.as_py()), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = groups.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_ids(docs: DataFrame, vocabulary_path: str, folder: str, **options) -> DataFrame:
    """Writes the files and a codebook under folder; a row for each file, in order: path, first (ids before it), n_ids, n_docs."""
    groups = stored(tokenized_groups(docs, vocabulary_path, **options), "token-groups")
    size = max(piece_encoder(vocabulary_path).tokenizer.get_vocab_size(), options.get("end_id", END_ID) + 1)
    lengths = code_lengths(id_counts(groups, size))
    with Replacing(f"{folder}/codebook.bin") as f:
        f.write(zlib.compress(lengths.tobytes()))

    def run(batches):
        codes = canonical_codes(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                k, null = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["null_ids"], np.uint8)
                sizes, ids = np.frombuffer(r["sizes"], "<u4"), _ids(r["ids"])
                path = f"{folder}/ids-{r['part']:06d}-{r['no']:06d}.tidh"
                with Replacing(path) as f:
                    f.write(pack_file(k, null, sizes, ids, codes, lengths))
                yield pa.RecordBatch.from_pylist([{"path": path, "part": r["part"], "no": r["no"], "n_ids": len(ids), "n_docs": len(k)}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("no", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
    files = stored(groups.mapInArrow(run, "path string, part int, no int, n_ids long, n_docs long"), "token-files")
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"), "n_ids", "n_docs")


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    lengths = np.frombuffer(zlib.decompress(read_file(f"{folder}/codebook.bin")), np.uint8)

    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, null, sizes, ids = unpack_file(read_file(path), table)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n, ids = files.agg(F.count("*"), F.sum("n_ids")).first()
    return files.select("path", "first").repartition(tasks_for(files.sparkSession, n, 2 * (ids or 0))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def huffman_ids(docs: DataFrame, vocabulary_path: str, **options) -> DataFrame:
    """Writes all ids of docs and reads them back."""
    folder = shared_dir(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, vocabulary_path, folder, **options), folder)
