"""Finding repeated windows across a corpus through a distributed, levelled fingerprint index.

Shared by suffix-array dedup (operator 3: symbols are bytes, a window is 400 of them) and substring dedup
(operator 9: symbols are words, a window is 13 of them).  Both need every window that also starts elsewhere;
storing all windows would take many times the corpus, so windows are handled through *anchors*:

* In each window of W symbols the least of its K-symbol grams is the anchor (sampled suffix).  Consecutive
  windows share an anchor, and equal windows have equal anchors at equal places, so windows can only be equal
  if their anchors' grams are.  An anchor *owns* the windows that chose it; the text they span is its context.
* Documents are dealt into shards (batches) by id and text.  Each shard sends one sorted immutable run of (gram, context)
  fingerprints to each index partition.  A partition takes run after run into a family of sorted levels (``Levels``):
  a run is merge-scanned against every level that is there, a match is noted in the level, keys that no level has become
  a new level, and levels of equal size are merged geometrically.  From the family each shard gets its answers.
* Equal contexts settle all their windows at once.  Where a gram occurs with several contexts (the ends of
  shared passages, near copies) the windows themselves are sent in a second exchange of the same kind, with
  two independent 64-bit fingerprints, of which the second verifies the first.

A rule may have a *scout*: a first scan of the same kind with shorter windows and bare grams, each sent once for a shard.
A window whose scout grams aren't all repeated can't be repeated, so only the stretches that are left take part in what
follows.  The scout also tells how many bytes of a document lie in grams that another document has.

Equal entries of a shard are combined before they are sent, so a gram, context or window has at most one entry
for each shard however often the corpus repeats it; no group holds all its copies.  The texts are shuffled
once (all passes over them reuse one exchange); what else moves is fingerprints.  Rows with equal ids, or without one,
are dealt by their texts and by the task that read them, so no id makes a large shard; index partitions follow the
size of the entries and not the number of shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import Rolling, chunks, covered, mix, per_document, ragged, sliding_min, valid_starts
from shelfspark.llm.common import grouped_by, parts_of, text_bytes

SHARD_BYTES = 4 << 20
#: Of a run or partition of the index.
INDEX_BYTES = 16 << 20
ENTRY_BYTES = 24
_ONE, _TWO = Rolling(101), Rolling(202)
_LOW = np.uint64(0xFFFFFFFF)
_BACK = np.iinfo(np.int64).min


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, first of each group in that order); keys by rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


class Levels:
    """A logarithmic family of sorted levels of (a, b) keys, each key in one level, with its least value and the number of runs that have it."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Takes in a sorted run of distinct keys; which of them were there before."""
        known = np.zeros(len(a), bool)
        for la, lb, least, count in self.levels:
            at, hit = _find(la, lb, a, b)
            at = at[hit]
            least[at] = np.minimum(least[at], value[hit])
            count[at] += 1
            known |= hit
        if not known.all():
            self.levels.append((a[~known], b[~known], value[~known], np.ones(int((~known).sum()), np.int64)))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()
        return known

    def _merge(self) -> None:
        two, one = self.levels.pop(), self.levels.pop()
        a, b, value, count = (np.concatenate(x) for x in zip(one, two, strict=True))
        order = np.argsort(a, kind="stable")  # two sorted runs: linear
        if ((a[order][1:] == a[order][:-1]) & (b[order][1:] < b[order][:-1])).any():
            order = np.lexsort((b, a))
        self.levels.append((a[order], b[order], value[order], count[order]))

    def compacted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))


def _find(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key (x, y) is in the sorted (a, b), and whether it is there."""
    low, high = np.searchsorted(a, x, "left"), np.searchsorted(a, x, "right") - 1
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        less = b[mid] < y[open_]
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)
    at = np.minimum(low, max(0, len(a) - 1))
    return at, (a[at] == x) & (b[at] == y) if len(a) else np.zeros(len(x), bool)


@dataclass(frozen=True)
class Rule:
    """window, gram: lengths in symbols. ordered: a window counts as repeated if a document of smaller id has it too; else if it starts anywhere else.

    scout: window and gram of a first scan (none of them longer than the rule's window); not for ordered rules.
    """

    window: int
    gram: int
    ordered: bool
    scout: tuple[int, int] | None = None

    def entries_per_symbol(self) -> float:
        return 2 / (self.window - self.gram + 2)


@dataclass
class _Chunk:
    first_row: int
    symbols: Callable[[], np.ndarray]
    at: np.ndarray
    extra: tuple


@dataclass
class _State:
    chunks: list[_Chunk]
    chunk: np.ndarray  # of each anchor
    row: np.ndarray
    start: np.ndarray
    owned: np.ndarray
    of: np.ndarray  # class of each anchor
    gram: np.ndarray  # of each class, sorted
    context: np.ndarray
    least: np.ndarray  # least document (ordered) of each class
    members: np.ndarray
    pick: np.ndarray  # an anchor of each class, of its least document
    entry: np.ndarray  # entry of each class
    entries: tuple[np.ndarray, np.ndarray, np.ndarray]
    many: np.ndarray  # of each entry: its gram has several contexts here
    value: np.ndarray  # of each row: its document id (ordered) or the shard


def _kept(symbols: np.ndarray, at: np.ndarray, window: int, gram: int):
    """(prefix, starts of the windows, the gram that each keeps, all grams), or None without windows."""
    prefix = _ONE.prefix(symbols)
    grams = _ONE.windows(prefix, gram)
    if len(symbols) < window:
        return None
    order = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(order, window - gram + 1)
    s = np.flatnonzero(valid_starts(at, window, len(least)))
    return (prefix, s, (least[s] & _LOW).astype(np.int64), grams) if len(s) else None


def _anchors(symbols: np.ndarray, at: np.ndarray, rule: Rule):
    got = _kept(symbols, at, rule.window, rule.gram)
    if got is None:
        return None
    prefix, s, anchor, grams = got
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    s0, owned = s[first], np.diff(np.append(first, len(s)))
    anchor = anchor[first]
    context = mix(_ONE.spans(prefix, s0, s0 + owned - 1 + rule.window) + (anchor - s0).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + owned.astype(np.uint64)) | np.uint64(1)
    return s0, owned, mix(grams[anchor]), context  # kept grams are small numbers: mixed once more, index partitions get even shares


class _Stretches:
    """Of each text (by its hash) that has any: its stretches of starts of windows that may be repeated, and how much of it another document has."""

    def __init__(self, hashes: np.ndarray, shared: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.hashes, self.shared, self.counts, self.first, self.last = hashes, shared, counts, first, last
        self.at = np.cumsum(counts) - counts

    def pack(self) -> bytes:
        return np.concatenate([[len(self.hashes)], self.hashes, self.shared, self.counts, self.first, self.last]).astype(np.int64).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> _Stretches:
        x = np.frombuffer(raw, np.int64)
        m = int(x[0])
        head, rest = x[1 : 1 + 3 * m].reshape(3, m), x[1 + 3 * m :]
        return cls(*head, *rest.reshape(2, -1))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each text here, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, k, -1)

    def shared_of(self, hashes: np.ndarray) -> np.ndarray:
        k = self.rows(hashes)
        return np.where(k >= 0, self.shared[np.maximum(k, 0)], 0) if len(self.hashes) else np.zeros(len(hashes), np.int64)

    def of(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first start, last start) of each stretch of a chunk's texts."""
        k = self.rows(hashes)
        row = np.flatnonzero(k >= 0)
        n = self.counts[k[row]]
        place = ragged(self.at[k[row]], n)
        row = np.repeat(row, n)
        return row, at[row] + self.first[place], at[row] + self.last[place]


def _sightings(table: pa.Table, rule: Rule, read: Callable, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, document offsets, places, grams, first scout window and number of those that keep it) of what the scout keeps in each chunk."""
    for a, _, data, offsets in chunks(table.column(text).combine_chunks()):
        symbols, at, *_ = read(data, offsets)
        got = _kept(symbols(), at, *rule.scout)
        if got is None:
            yield a, at, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        _, s, anchor, grams = got
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        yield a, at, anchor[first], mix(grams[anchor[first]]), s[first], np.diff(np.append(first, len(s)))


def _stretches(table: pa.Table, rule: Rule, read: Callable, text: str, hashes: np.ndarray, far_of: Callable[[np.ndarray], np.ndarray]) -> _Stretches:
    """far_of: which of the sorted distinct grams another shard has."""
    found = list(_sightings(table, rule, read, text))
    gram = np.concatenate([x[3] for x in found]) if found else np.zeros(0, np.uint64)
    row = np.concatenate([a + np.searchsorted(at, p, "right") - 1 for a, at, p, *_ in found]) if found else np.zeros(0, np.int64)
    known, of, times = np.unique(gram, return_inverse=True, return_counts=True)
    far = far_of(known)
    least, most = np.full(len(known), len(table)), np.full(len(known), -1)
    np.minimum.at(least, of, row)
    np.maximum.at(most, of, row)
    repeated, shared = (far | (times > 1))[of], (far | (least < most))[of]
    window, (scout, length), done, out = rule.window, rule.scout, 0, []
    for a, at, place, g, begin, owned in found:
        mine = slice(done, done + len(g))
        done += len(g)
        size = int(at[-1])
        bad = ~repeated[mine]
        begin, end = begin[bad], (begin + owned)[bad]  # scout windows that aren't repeated, and so no window around them
        start = np.maximum(begin + scout - window, at[np.searchsorted(at, begin, "right") - 1])
        ok = valid_starts(at, window, size) & ~covered(start, end, size)
        edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        doc = np.searchsorted(at, first, "right") - 1
        both = per_document(covered(place[shared[mine]], place[shared[mine]] + length, size), at)
        out.append((hashes[a : a + len(at) - 1], both, np.bincount(doc, minlength=len(at) - 1), first - at[doc], last - at[doc]))
    if not out:
        return _Stretches(*(np.zeros(0, np.int64) for _ in range(5)))
    h, both, n, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    some = np.flatnonzero((n > 0) | (both > 0))
    _, k = np.unique(h[some], return_index=True)  # equal texts have equal stretches
    some = some[k]
    place = ragged((np.cumsum(n) - n)[some], n[some])
    return _Stretches(h[some], both[some], n[some], first[place], last[place])


def _state(table: pa.Table, rule: Rule, read: Callable, src: int, text: str = "__text", stretches: _Stretches | None = None, hashes: np.ndarray | None = None) -> _State:
    """read(bytes, offsets) -> (function that gives the symbols, their document offsets, anything else)."""
    ids = table.column("__id")
    value = ids.fill_null(_BACK).to_numpy() if rule.ordered else np.full(len(table), src, np.int64)
    pieces, parts = [], []
    for a, _, data, offsets in chunks(table.column(text).combine_chunks()):
        symbols, at, *extra = read(data, offsets)
        k = len(pieces)
        pieces.append(_Chunk(a, symbols, at, tuple(extra)))
        if stretches is None:
            got = _anchors(symbols(), at, rule)
            if got:
                s0, owned, gram, context = got
                parts.append((np.full(len(s0), k), a + np.searchsorted(at, s0, "right") - 1, s0, owned, gram, context))
            continue
        row, first, last = stretches.of(hashes[a : a + len(at) - 1], at)
        if len(row):
            length = last - first + rule.window
            border = np.concatenate([[0], np.cumsum(length)])
            s0, owned, gram, context = _anchors(symbols()[ragged(first, length)], border, rule)
            piece = np.searchsorted(border, s0, "right") - 1
            parts.append((np.full(len(s0), k), a + row[piece], s0 - border[piece] + first[piece], owned, gram, context))
    if not parts:
        parts = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))]
    chunk, row, start, owned, gram, context = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = value[row]
    order, _ = _groups(gram, context, doc, row, start)
    # classes: groups of (gram, context); in each the first is of the least document
    new = np.zeros(len(order), bool)
    new[:1] = True
    g, c = gram[order], context[order]
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    pick = order[first]
    cg, cc, least = g[first], c[first], doc[pick]
    members = np.diff(np.append(first, len(order)))
    new_gram = np.flatnonzero(np.concatenate([[True], cg[1:] != cg[:-1]])) if len(cg) else np.zeros(0, np.int64)
    classes = np.diff(np.append(new_gram, len(cg)))
    many = classes > 1
    return _State(pieces, chunk, row, start, owned, of, cg, cc, least, members, pick, np.repeat(np.arange(len(new_gram)), classes), (cg[new_gram], np.where(many, np.uint64(0), cc[new_gram]), least[new_gram]), many, value)


_RUN = "level int, dest int, src int, a binary, b binary, v binary"
_ANSWER = "src int, level int, dest int, answer binary"
#: Levels of runs and answers: grams of the scout, stretches (passed on as they are), anchors, windows.
_SCOUT, _PASSED, _ANCHORS, _WINDOWS = 0, 9, 1, 2


def _destination(a: np.ndarray, parts: int) -> np.ndarray:
    """Monotone in a, so a sorted run stays sorted in each partition."""
    return (((a >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _cuts(a: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The index partitions that a run has keys for, and where each one's begin in it (and the end). The work follows the run, not the number of partitions."""
    d = _destination(a, parts)
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1])[: len(d)])
    return d[first], np.append(first, len(a))


def _runs(level: int, src: int, parts: int, a: np.ndarray, b: np.ndarray | None = None, v: np.ndarray | None = None, passed: bytes | None = None) -> pa.Table:
    dests, cut = _cuts(a, parts)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    piece = lambda x: [b"" if x is None else x[i:j].tobytes() for i, j in spans]
    rows = [[level] * len(spans), dests.tolist(), piece(a), piece(b), piece(v)]
    if passed is not None:
        for x, y in zip(rows, (_PASSED, src % parts, passed, b"", b""), strict=True):
            x.append(y)
    return pa.table({"level": pa.array(rows[0], pa.int32()), "dest": pa.array(rows[1], pa.int32()), "src": pa.array([src] * len(rows[0]), pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in zip("abv", rows[2:], strict=True)})


def _index(rule: Rule) -> Callable[[pa.Table], pa.Table]:
    """What an index partition does with the runs that the shards sent it, all of one level."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("src", "ascending"), ("level", "ascending")])
        runs, out, family, level = [], [], Levels(), 0
        for lv, *r in zip(*(table.column(c) for c in ("level", "a", "b", "v")), strict=True):
            if lv.as_py() == _PASSED:
                runs.append(r[0].as_py())
                continue
            level = lv.as_py()
            x, y, v = (np.frombuffer(z.as_py(), t) for z, t in zip(r, (np.uint64, np.uint64, np.int64), strict=True))
            if level == _SCOUT:
                y, v = np.zeros(len(x), np.uint64), np.zeros(len(x), np.int64)
            family.add(x, y, v)
            runs.append((x, y, v))
        a, b, least, count = family.compacted()
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        several = (np.diff(np.append(first, len(a))) > 1) | (b[first] == 0)
        everywhere = np.add.reduceat(count, first) if len(a) else count
        for run in runs:
            if isinstance(run, bytes):
                out.append(run)
                continue
            x, y, v = run
            at, _ = _find(a, b, x, y)
            own = group[at]
            known = (least[at] < v) if rule.ordered else (count[at] > 1)
            if level == _ANCHORS:
                known &= y != 0
                ask = several[own] & (~known if rule.ordered else v == least[at])
                ask = np.where(y == 0, everywhere[own] > 1, ask)
                out.append(np.packbits(np.stack([known, ask], axis=1).ravel()).tobytes())
            else:
                out.append(np.packbits(known).tobytes())
        return pa.table({"src": table.column("src").cast(pa.int32()), "level": table.column("level").cast(pa.int32()), "dest": table.column("dest").cast(pa.int32()), "answer": pa.array(out, pa.binary())})

    return merge


def _answers(table: pa.Table, level: int, a: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The answers in the order of the run a."""
    out = np.zeros((len(a), bits), bool)
    dests, cut = _cuts(a, parts)
    place = np.searchsorted(dests, table.column("dest").to_numpy())
    for lv, k, x in zip(table.column("level").to_pylist(), place.tolist(), table.column("answer"), strict=True):
        if lv == level:
            n = cut[k + 1] - cut[k]
            out[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n * bits).reshape(n, bits).astype(bool)
    return out


@dataclass
class _Windows:
    classes: np.ndarray  # that have windows of their own
    counts: np.ndarray
    number: np.ndarray  # of each window: its distinct window
    keys: tuple[np.ndarray, np.ndarray, np.ndarray]
    here: np.ndarray  # how often each distinct window starts in this shard
    sent: np.ndarray


def _windows(state: _State, rule: Rule, first: np.ndarray) -> _Windows:
    """The windows of classes that aren't settled, distinct within the shard."""
    ask = first[:, 1]
    entry = state.entry
    classes = np.flatnonzero((ask | state.many)[entry])
    pick = state.pick[classes]
    counts = state.owned[pick]
    h1, h2 = np.zeros(int(counts.sum()), np.uint64), np.zeros(int(counts.sum()), np.uint64)
    at = np.cumsum(counts) - counts
    for k in np.unique(state.chunk[pick]).tolist():
        mine = np.flatnonzero(state.chunk[pick] == k)
        s = ragged(state.start[pick[mine]], counts[mine])
        to = ragged(at[mine], counts[mine])
        symbols = state.chunks[k].symbols()
        h1[to] = _ONE.spans(_ONE.prefix(symbols), s, s + rule.window)
        h2[to] = _TWO.spans(_TWO.prefix(symbols), s, s + rule.window)
    owner = np.repeat(np.arange(len(classes)), counts)
    order, head = _groups(h1, h2)
    number = np.empty(len(order), np.int64)
    new = np.zeros(len(order), np.int64)
    new[head] = 1
    number[order] = np.cumsum(new) - 1
    least = state.least[classes][owner]
    ask_class = ask[entry[classes]][owner]
    if len(order):
        value = np.minimum.reduceat(least[order], head)
        here = np.add.reduceat(state.members[classes][owner][order], head)
        sent = np.logical_or.reduceat(ask_class[order], head)
    else:
        value, here, sent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return _Windows(classes, counts, number, (h1[order][head], h2[order][head], value), here, sent)


def _repeated(state: _State, rule: Rule, first: np.ndarray, second: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[_Chunk, np.ndarray]]:
    """Each chunk with the flags of its symbols that lie in repeated windows."""
    known = first[:, 0][state.entry] & ~state.many[state.entry]
    w = _windows(state, rule, first)
    far = np.zeros(len(w.sent), bool)
    far[w.sent] = second(w.keys[0][w.sent])
    owner = np.repeat(np.arange(len(w.classes)), w.counts)
    if rule.ordered:
        hit = far[w.number] | (state.least[w.classes][owner] > w.keys[2][w.number])
    else:
        hit = far[w.number] | (w.here[w.number] > 1)
    slot = np.full(len(state.gram), -1)
    slot[w.classes] = np.arange(len(w.classes))
    base = np.cumsum(w.counts) - w.counts
    for k, piece in enumerate(state.chunks):
        mine = np.flatnonzero(state.chunk == k)
        of, s, n = state.of[mine], state.start[mine], state.owned[mine]
        whole = known[of]
        if rule.ordered:
            whole = whole | (state.value[state.row[mine]] > state.least[of])
        else:
            whole = whole | (state.members[of] > 1)
        d = np.zeros(int(piece.at[-1]) + 1, np.int64)
        np.add.at(d, s[whole], 1)
        np.add.at(d, (s + n - 1 + rule.window)[whole], -1)
        part = np.flatnonzero(~whole & (slot[of] >= 0))
        if len(part):
            windows = ragged(s[part], n[part])
            good = windows[hit[ragged(base[slot[of[part]]], n[part])]]
            np.add.at(d, good, 1)
            np.add.at(d, good + rule.window, -1)
        yield piece, np.cumsum(d)[:-1] > 0


def repeated_windows(docs: DataFrame, rule: Rule, read: Callable, finish: Callable, schema: str, *, key: str = "doc_id", text: str = "text", symbol_bytes: float = 1, shard_bytes: int = SHARD_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """finish(table of a shard, [(chunk, flags)], with a scout: shared bytes of each row) -> table of ``schema``.

    The shard's table begins with the columns of docs (under other names) and has their id as __id. symbol_bytes: a symbol's usual size, for the number of index partitions.
    """
    total = text_bytes(docs, text)
    shards, parts = parts_of(total, shard_bytes), parts_of(total / symbol_bytes * rule.entries_per_symbol() * ENTRY_BYTES, index_bytes)
    named = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    i, t = (F.col(f"c{docs.columns.index(c)}") for c in (key, text))
    t_name = f"c{docs.columns.index(text)}"
    dealt = named.withColumns({"__id": i.cast("long"), "__hash": F.xxhash64(t, F.octet_length(t))})
    dealt = dealt.withColumn("__shard", F.pmod(F.xxhash64("__id", "__hash", F.spark_partition_id()), F.lit(shards)).cast("int"))

    def src_of(table: pa.Table) -> int:
        return table.column("__shard")[0].as_py()

    def passed(table: pa.Table, answers: pa.Table) -> dict:
        """What the scout left of a shard, as arguments of _state."""
        if not rule.scout:
            return {}
        (raw,) = (x.as_py() for lv, x in zip(answers.column("level").to_pylist(), answers.column("answer"), strict=True) if lv == _PASSED)
        return {"stretches": _Stretches.unpack(raw), "hashes": table.column("__hash").to_numpy()}

    def scout_runs(table: pa.Table) -> pa.Table:
        grams = [x[3] for x in _sightings(table, rule, read, t_name)]
        return _runs(_SCOUT, src_of(table), parts, np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64))

    def scouted_runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _runs(_ANCHORS, 0, parts, np.zeros(0, np.uint64))
        src, hashes = src_of(table), table.column("__hash").to_numpy()
        left = _stretches(table, rule, read, t_name, hashes, lambda a: _answers(answers, _SCOUT, a, parts, 1)[:, 0])
        state = _state(table, rule, read, src, t_name, left, hashes)
        return _runs(_ANCHORS, src, parts, *state.entries, passed=left.pack())

    def first_runs(table: pa.Table) -> pa.Table:
        src = src_of(table)
        return _runs(_ANCHORS, src, parts, *_state(table, rule, read, src, t_name).entries)

    def second_runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _runs(_WINDOWS, 0, parts, np.zeros(0, np.uint64))
        src = src_of(table)
        state = _state(table, rule, read, src, t_name, **passed(table, answers))
        w = _windows(state, rule, _answers(answers, _ANCHORS, state.entries[0], parts, 2))
        return _runs(_WINDOWS, src, parts, *(x[w.sent] for x in w.keys))

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return finish(table, [], *([np.zeros(0, np.int64)] if rule.scout else []))
        left = passed(table, answers)
        state = _state(table, rule, read, src_of(table), t_name, **left)
        first = _answers(answers, _ANCHORS, state.entries[0], parts, 2)
        found = _repeated(state, rule, first, lambda a: _answers(answers, _WINDOWS, a, parts, 1)[:, 0])
        return finish(table, found, *([left["stretches"].shared_of(left["hashes"])] if rule.scout else []))

    by_shard = grouped_by(dealt, "__shard", total).groupBy("__shard")
    index = _index(rule)
    met = lambda runs: grouped_by(runs, "dest", parts * index_bytes).groupBy("dest").applyInArrow(index, _ANSWER)
    if rule.scout:
        one = met(by_shard.cogroup(met(by_shard.applyInArrow(scout_runs, _RUN)).groupBy("src")).applyInArrow(scouted_runs, _RUN))
    else:
        one = met(by_shard.applyInArrow(first_runs, _RUN))
    two = met(by_shard.cogroup(one.groupBy("src")).applyInArrow(second_runs, _RUN))
    return by_shard.cogroup(one.unionByName(two).groupBy("src")).applyInArrow(last, schema)
