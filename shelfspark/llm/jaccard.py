"""Exact Jaccard join of 3-word shingle sets with set-relation skipping (operator 6).

1. Equal sets become one class.
2. Candidates: sets with 19 |A ∩ B| >= 9 (|A| + |B|) differ in at most 2/19 of their largest size, so of one more part
   than that, into which shingles are dealt by hash, one part is equal.  Parts are keys of an index whose lists only hold
   sets with an equal part and a fitting size; each task combines equal keys before it sends them, and each list
   gives a chain, not pairs.  Connected candidates form a family, which no link leaves.
3. Links inside a family, in blocks of about BLOCK sets and BLOCK_SHINGLES shingles at most: index lists of prefix shingles are kept in order of position, and the part of a list whose positions rule a
   link out is skipped; a set that is highly similar to an earlier one isn't probed at all: its overlaps with
   every set follow from the earlier set's overlaps and the lists of the few shingles in which the two differ.
   A family of more sets is compared within each block first; of each component there the set with most links stands
   for it, and these are compared with each other.  What is connected then and makes the largest part of the family needs
   no comparison inside; the other sets are compared with all, block by block.  So a family of near copies
   costs as many tasks as it has blocks.
4. Components of the links.

Defined results: null text or text without words has an empty set and is linked with nothing; fewer than three words
make one shingle; rows with equal sets are linked whatever their ids; a null doc_id is no candidate for
component_id (rows with nothing else have null); an empty table gives no rows; extra columns are ignored by
``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import LOWER, chunks, constants, mix, ragged, shingles, word_hashes, words
from shelfspark.llm.common import bounded_batches, shard_count, stored, unused
from shelfspark.llm.components import components

SHINGLE = 3
#: A block holds so many sets, or fewer where their shingles are more than so many.
BLOCK, BLOCK_SHINGLES = 2048, 2 << 20
FLUSH = 4_000_000
INDEX_BYTES = 16 << 20
JOIN_BYTES = 64 << 20
_C = constants(717, 6)


def _class_ends() -> tuple[np.ndarray, np.ndarray]:
    """Size classes so that linked sets are in one class or in neighbours, and the number of parts for each class."""
    ends = [1, 2]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, 10 * (ends[-1] - 1) // 9 + 1))
    ends = np.array(ends, np.int64)
    return ends, np.append(2 * (ends[1:] - 1) // 19 + 1, 1)


_ENDS, _PARTS = _class_ends()


def linked(overlap, a, b):
    """100 |A ∩ B| >= 90 |A ∪ B|."""
    return 19 * overlap >= 9 * (a + b)


def doc_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document in ascending order, and the documents' offsets into them."""
    low = LOWER[data]
    s, e, at = words(low, offsets)
    values, to = shingles(word_hashes(low, s, e), at, SHINGLE)
    doc = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(to)))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def set_ids(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set."""
    return mix(_sums(mix(values ^ _C[0]), at) + np.diff(at).astype(np.uint64)), _sums(mix(values ^ _C[1]), at)


def part_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index keys, document of each) of all sets."""
    sizes = np.diff(at)
    kind = np.searchsorted(_ENDS, np.maximum(sizes, 1), "right") - 1
    token, part_hash = mix(values ^ _C[2]), mix(values ^ _C[3]) >> np.uint64(33)
    keys, docs = [], []
    for up in (0, 1):
        context = kind + up
        parts = np.where((sizes > 0) & (_PARTS[context] > 1), _PARTS[context], 0)
        base = np.cumsum(parts) - parts
        use = np.repeat(parts > 0, sizes)
        m = np.repeat(parts, sizes)[use]
        slot = np.repeat(base, sizes)[use] + (part_hash[use].astype(np.int64) % np.maximum(m, 1))
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, slot, token[use])
        number = np.arange(len(total)) - np.repeat(base, parts)
        keys.append(mix(total + number.astype(np.uint64) * _C[4] + np.repeat(context, parts).astype(np.uint64) * _C[5]))
        docs.append(np.repeat(np.arange(len(sizes)), parts))
    return np.concatenate(keys), np.concatenate(docs)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that aren't roots of their components."""
    nodes, k = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = k[: len(u)], k[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _chain(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, an owner of each, and the edges between owners of one key)"""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    same = key[1:] == key[:-1]
    edge = same & (owner[1:] != owner[:-1])
    first = np.concatenate([[True], ~same]) if len(key) else np.zeros(0, bool)
    return key[first], owner[first], owner[1:][edge], owner[:-1][edge]


_ROW = "dest int, a binary, b binary"


def _candidate_edges(docs: DataFrame, text: str) -> DataFrame:
    """u, v: sets (by their first fingerprint) with an equal part, as forests."""
    parts = shard_count(docs, text, INDEX_BYTES)

    def send(key, owner):
        key, owner, u, v = _chain(key, owner)
        cut = np.searchsorted(((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        rows = [(d, key[cut[d] : cut[d + 1]].tobytes(), owner[cut[d] : cut[d + 1]].tobytes()) for d in np.flatnonzero(np.diff(cut)).tolist()]
        if len(u):
            node, root = _forest(u, v)
            rows.append((-1 - int(node[0] % np.uint64(parts)), node.tobytes(), root.tobytes()))  # edges, not entries
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["dest", "a", "b"])

    def run(batches):
        keys, owners, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                values, at = doc_sets(data, offsets)
                key, doc = part_keys(values, at)
                keys.append(key)
                owners.append(set_ids(values, at)[0][doc])
                held += len(key)
                if held > FLUSH:
                    yield send(np.concatenate(keys), np.concatenate(owners))
                    keys, owners, held = [], [], 0
        if held:
            yield send(np.concatenate(keys), np.concatenate(owners))

    def meet(table: pa.Table) -> pa.Table:
        a, b = (np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column(c)]) for c in "ab")
        if table.column("dest")[0].as_py() >= 0:
            _, _, a, b = _chain(a, b)
        node, root = _forest(a, b) if len(a) else (a, b)
        return pa.table({"u": node.view(np.int64), "v": root.view(np.int64)})

    return docs.select(text).mapInArrow(run, _ROW).groupBy("dest").applyInArrow(meet, "u long, v long")


class SetIndex:
    """The sets of a block with full index lists, and prefix lists in order of position."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        token = rank[token]  # rare shingles first
        order = np.lexsort((token, owner))
        self.tokens, self.at = token[order], np.concatenate([[0], np.cumsum(self.sizes)])
        by = np.argsort(self.tokens, kind="stable")
        self.list_at = np.searchsorted(self.tokens[by], np.arange(len(count) + 1))
        self.lists = owner[by]
        position = np.arange(len(self.tokens)) - np.repeat(self.at[:-1], self.sizes)
        room = self.sizes - (9 * self.sizes + 9) // 10  # positions up to this one are the prefix
        head = np.flatnonzero(position <= np.repeat(room, self.sizes))
        by = head[np.lexsort((position[head], self.tokens[head]))]
        self.prefix_at = np.searchsorted(self.tokens[by], np.arange(len(count) + 1))
        self.prefix_set, self.prefix_position = owner[by], position[by]
        self.mark = np.zeros(len(count) + 1, bool)

    def of(self, k: int) -> np.ndarray:
        return self.tokens[self.at[k] : self.at[k + 1]]

    def _listed(self, tokens: np.ndarray) -> np.ndarray:
        n = self.list_at[tokens + 1] - self.list_at[tokens]
        return np.bincount(self.lists[ragged(self.list_at[tokens], n)], minlength=len(self.sizes))

    def overlaps(self, k: int) -> np.ndarray:
        """With every set of the block."""
        return self._listed(self.of(k))

    def derived(self, k: int, like: int, known: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """The same from the overlaps of a similar set."""
        mine = np.isin(differ, self.of(k), assume_unique=True)
        return known + self._listed(differ[mine]) - self._listed(differ[~mine])

    def probe(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, overlaps) from prefix lists; positions i and j of a first common shingle rule a link out if i + j is over 2/19 of both sizes' bound."""
        a = int(self.sizes[k])
        most = (a + 10 * a // 9) // 19
        own = self.of(k)
        found = []
        for i, t in enumerate(own[: a - (9 * a + 9) // 10 + 1].tolist()):
            low, high = self.prefix_at[t], self.prefix_at[t + 1]
            high = low + np.searchsorted(self.prefix_position[low:high], most - i, "right")  # skip the rest of the list
            found.append(self.prefix_set[low:high])
        near = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        near = near[(10 * self.sizes[near] >= 9 * a) & (9 * self.sizes[near] <= 10 * a)]
        self.mark[own] = True
        n = self.sizes[near]
        hit = self.mark[self.tokens[ragged(self.at[near], n)]]
        self.mark[own] = False
        return near, np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64) if len(near) else near

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A pair list whose components are those of all links of the block."""
        u, v, computed = [], [], []
        for k in np.argsort(self.sizes, kind="stable").tolist():
            own, result = self.of(k), None
            for like, known in computed:
                differ = np.setxor1d(own, self.of(like), assume_unique=True)
                if 3 * len(differ) <= len(own):
                    result = self.derived(k, like, known, differ)
                    break
            if result is None:
                near, overlap = self.probe(k)
                hit = near[linked(overlap, self.sizes[k], self.sizes[near])]
                if len(hit) > 1:  # others are like it: its overlaps serve them
                    computed = [(k, self.overlaps(k)), *computed[:3]]
            else:
                hit = np.flatnonzero(linked(result, self.sizes[k], self.sizes))
            hit = hit[hit != k]
            u.append(np.full(len(hit), k))
            v.append(hit)
        return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(table: pa.Table) -> pa.Table:
    """Links of a block as a forest (kind 0); for each of its components the set with most links (kind 1, u and v)."""
    ids = table.column("cid").to_pylist()
    u, v = SetIndex([np.frombuffer(x.as_py(), np.uint64) for x in table.column("items")]).links()
    node, root = _forest(u, v) if len(u) else (u, v)
    of = np.arange(len(ids))
    of[node] = root
    order = np.lexsort((-np.bincount(u, minlength=len(ids)), of))
    top = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    left, right = np.concatenate([node, top]).tolist(), np.concatenate([root, top]).tolist()
    return pa.table({"kind": pa.array(np.repeat([0, 1], [len(node), len(top)]), pa.int32()), "u": pa.array([ids[k] for k in left], pa.binary()), "v": pa.array([ids[k] for k in right], pa.binary())})


_LINK = "kind int, u binary, v binary"


def _count(block: int, shingles):
    """How many blocks sets need, as an aggregate; shingles: a set's number of them."""
    return F.ceil(F.greatest(F.count("*") / block, F.sum(shingles) / BLOCK_SHINGLES)).cast("int")


def _block(n: str):
    """A set's block of n."""
    return F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")


def _paired(sets: DataFrame, n: str) -> DataFrame:
    """Each pair of a family's n blocks as a group of its own."""
    own = sets.withColumn("own", _block(n)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return own.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "items")


def _large_links(items: DataFrame, block: int) -> DataFrame:
    """u, v: enough links of the families of several blocks to give their components; items: family, blocks, cid, items."""
    items = stored(items, "large-sets")
    within = stored(items.withColumn("own", _block("blocks")).groupBy("family", "own").applyInArrow(_links, _LINK), "large-links")
    tops = items.join(within.where("kind = 1").select(F.col("u").alias("cid")), "cid", "left_semi")
    count = tops.groupBy("family").agg(_count(block, F.octet_length("items") / 8).alias("n"))
    between = _paired(tops.join(count, "family"), "n").groupBy("family", "i", "j").applyInArrow(_links, _LINK)
    first = stored(within.where("kind = 0").unionByName(between.where("kind = 0")).select("u", "v"), "large-links")
    part = components(first).select(F.col("node").alias("cid"), "root")
    sets = items.select("family", "blocks", "cid").join(part, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    largest = sets.groupBy("family", "root").agg(F.count("*").alias("size")).groupBy("family").agg(F.max(F.struct("size", "root"))["root"].alias("main"))
    rest = stored(sets.join(largest, "family").where("root <> main").select("family", "cid"), "large-rest")
    n = items.join(rest, ["family", "cid"], "left_semi").groupBy("family").agg(_count(block, F.octet_length("items") / 8).alias("n"))
    of = items.join(n, "family")
    other = stored(of.join(rest, ["family", "cid"], "left_semi"), "large-rest")
    # the rest with the rest, and each block of the main part with each block of the rest
    main = of.join(rest, ["family", "cid"], "left_anti").withColumn("own", _block("blocks"))
    split = lambda df, c, k: df.withColumn(c, F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    mixed = split(main, "other", "n").select("family", F.col("own").alias("i"), (-1 - F.col("other")).alias("j"), "cid", "items")
    mixed = mixed.unionByName(split(other, "i", "blocks").select("family", "i", (-1 - _block("n")).alias("j"), "cid", "items"))
    last = _paired(other, "n").unionByName(mixed).groupBy("family", "i", "j").applyInArrow(_links, _LINK)
    return first.unionByName(last.where("kind = 0").select("u", "v"))


def _described(docs: DataFrame, key: str, text: str, row: str) -> DataFrame:
    """doc_id, row, n, cid (a set's two fingerprints), h (the first) of every row."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                values, at = doc_sets(data, offsets)
                one, two = set_ids(values, at)
                cid = np.stack([one, two], axis=1).tobytes()
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(np.diff(at), pa.int64()), pa.array([cid[16 * k : 16 * k + 16] for k in range(b - a)], pa.binary()), pa.array(one.view(np.int64))], names=["doc_id", "row", "n", "cid", "h"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, row long, n long, cid binary, h long")


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    numbered = _numbered(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "row")
    return _grouped(numbered, "doc_id", "text", block, "row").select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, key: str, text: str, block: int, row: str) -> DataFrame:
    """doc_id, row, n_shingles, component_id, first_row of every row; row: a column of unique numbers, by which rows are told apart."""
    bounded_batches(docs.sparkSession)
    rows = stored(_described(docs, key, text, row), "sets")
    family = stored(components(_candidate_edges(docs, text)), "families")
    members = rows.where("n > 0").join(family.select(F.col("node").alias("h"), F.col("root").alias("family")), "h").groupBy("cid", "family").agg(F.min("row").alias("k"), F.max("n").alias("n"))
    size = members.groupBy("family").agg(_count(block, F.col("n")).alias("blocks"))
    members = stored(members.join(size, "family"), "members")

    def sets(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                values, at = doc_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (2, 3, 0)), pa.array([values[at[k] : at[k + 1]].tobytes() for k in range(b - a)], pa.binary())], names=["family", "blocks", "cid", "items"])

    parts = shard_count(docs, text, JOIN_BYTES)
    texts = docs.select(F.col(row).alias("k"), F.col(text).alias("t")).repartition(parts, "k")
    # merged at every size: neither side has a bound that would allow a broadcast
    with_text = members.repartition(parts, "k").hint("merge").join(texts, "k").select("cid", "t", "family", "blocks")
    items = with_text.mapInArrow(sets, "family long, blocks int, cid binary, items binary")
    large = members.where("blocks > 1").limit(1).count() > 0
    if large:
        items = stored(items, "items")
    links = items.where("blocks = 1").groupBy("family").applyInArrow(_links, _LINK).where("kind = 0").select("u", "v")
    if large:
        links = links.unionByName(_large_links(items.where("blocks > 1"), block))
    links = stored(links, "links")
    joined = components(links).select(F.col("node").alias("cid"), "root")
    # the first row of a group: least doc_id, nulls last, then least number
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = rows.where("n > 0").groupBy("cid").agg(F.min(order).alias("least")).join(joined, "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    first = classes.groupBy("root").agg(F.min("least").alias("first"))
    of = classes.join(first, "root").select("cid", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    full = rows.where("n > 0").join(of, "cid").select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", "first_row")
    return full.unionByName(rows.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row").alias("first_row")))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of each group of linked rows (that of the smallest id, nulls last; of equal ids any one), and all rows without words; all columns, whatever their names."""
    row = unused(docs.columns, "__row")
    gone = unused([*docs.columns, row], "__gone")
    numbered = _numbered(docs, row)
    found = _grouped(numbered, key, text, block, row).where("row <> first_row").select(F.col("row").alias(gone))
    return numbered.join(found, F.col(row) == F.col(gone), "left_anti").select(*docs.columns)
