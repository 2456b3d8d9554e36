"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``, by iterative-deepening A*.

Rows are put in order by ranges, so a long conversation lies over several partitions. Faults are found by aggregation, each row becomes one letter,
and runs of at most SEGMENT letters are searched apart from one another: from every role state at their start to every one at their end. One pass over
the ordered rows then joins the segments' answers and applies the edits, holding a conversation's letters and edits but never its texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfspark.llm.common import bounded_batches, parts_of, stored

#: Rows of a segment as a power of two, and bytes of text in a partition.
SEGMENT_BITS, PART_BYTES = 5, 32 << 20
FOUND = r"[^\x20\x09-\x0D]"
#: A letter is 4 * fault + initial of the role; later faults than the first don't count.
LETTERS = "ABCDEFGHIJKLMNOP"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATION = 0, 1, 2, 5, 5
#: What came last: nothing, system, user, assistant. The next role of each, and the states that may be reached from it.
NEXT = (USER, USER, ASSISTANT, USER)
REACHES = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
PAIRS = [(a, b) for a in range(4) for b in REACHES[a]]
NEVER = 1 << 60


def damaged(rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text after damage that depends on crc32 of ``id:turn`` only. A null is one blank (in the key too; a null turn stays null)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(id_column), F.lit(":"), blank("turn"))) % 20
    out = rows.select(F.col(id_column).alias("conv_id"), "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text")).alias("text"), kind.alias("kind"))
    return out.where("kind <> 0").withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


class Search:
    """Depth-first searches under rising cost bounds over one segment, in the order D, I, K, R.

    ``need`` is the table of failed states: the least that is known to be needed from a row and role state to the goal. Costs to go don't depend on
    the way there, so every start of the same goal uses it. The first accepting path under the least bound is the ASCII-least of the cheapest.
    """

    def __init__(self, letters: str, goal: int):
        self.rows = [divmod(LETTERS.index(c), 4) for c in letters]
        self.goal, self.n = goal, len(letters)
        self.rest = [0] * (self.n + 1)  # every faulty row costs 2 at least
        for i in range(self.n - 1, -1, -1):
            self.rest[i] = self.rest[i + 1] + (DELETE if self.rows[i][0] else 0)
        self.need: dict[tuple[int, int], int] = {}

    def moves(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        role = NEXT[state]
        if i < self.n:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, role + 1
        if i < self.n:
            fault, initial = self.rows[i]
            if fault < BLANK:
                more = TRUNCATION if fault == TRUNCATED else 0
                if initial == role or (initial == SYSTEM and state == 0):
                    yield "K", KEEP + more, i + 1, initial + 1
                yield "R", REROLE + more, i + 1, role + 1

    def deeper(self, i: int, state: int, left: int, path: list[str]) -> int:
        """-1 if the goal can be reached for ``left``, with the edits in ``path`` from last to first; else the least that is needed."""
        if self.goal not in REACHES[state]:
            return NEVER
        least = self.need.get((i, state), self.rest[i])
        if least > left:
            return least
        if i == self.n and state == self.goal:
            return -1
        least = NEVER
        for edit, cost, to, then in self.moves(i, state):
            found = self.deeper(to, then, left - cost, path)
            if found < 0:
                path.append(edit)
                return -1
            least = min(least, found + cost)
        self.need[i, state] = least
        return least

    def from_state(self, state: int) -> tuple[int, str] | None:
        bound = self.rest[0]
        while bound < NEVER:
            path: list[str] = []
            found = self.deeper(0, state, bound, path)
            if found < 0:
                return bound, "".join(reversed(path))
            bound = found
        return None


@functools.lru_cache(maxsize=1 << 16)
def answers(letters: str) -> str:
    """cost and edits of each pair of states, as text; an empty one can't be reached."""
    by_goal = {goal: Search(letters, goal) for goal in range(4)}
    found = [by_goal[b].from_state(a) for a, b in PAIRS]
    return ";".join(f"{x[0]}:{x[1]}" if x else "" for x in found)


def _less(a: tuple | None, b: tuple | None) -> bool:
    """Order of two chains of texts (head, rest)."""
    x = y = ""
    while True:
        if not x and a:
            x, a = a
        if not y and b:
            y, b = b
        if not x or not y:
            return bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]
        if a is b and not x and not y:
            return False


def joined(tables: list[str]) -> tuple[int, str]:
    """cost and edits of a whole conversation, from the last segment to the first: the cheapest way to its end from each state, ties ASCII-least."""
    ways: list[tuple[int, tuple | None] | None] = [(0, None), None, None, (0, None)]
    for table in reversed(tables):
        before: list[tuple[int, tuple | None] | None] = [None] * 4
        for (a, b), found in zip(PAIRS, table.split(";"), strict=True):
            rest = ways[b]
            if found and rest:
                cost, _, edits = found.partition(":")
                way, old = (int(cost) + rest[0], (edits, rest[1])), before[a]
                if old is None or way[0] < old[0] or (way[0] == old[0] and _less(way[1], old[1])):
                    before[a] = way
        ways = before
    cost, chain = ways[0]
    edits = []
    while chain:
        edits.append(chain[0])
        chain = chain[1]
    return cost, "".join(edits)


class Repair:
    """One conversation on its way through a task: its segments first, then its rows in order."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.tables = conv_id, [], []
        self.audit, self.at, self.turns = None, 0, 0

    def start(self) -> None:
        letters = "".join(self.letters)
        faults = [LETTERS.index(c) >> 2 for c in letters]
        roles = [LETTERS.index(c) & 3 for c in letters]
        legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
        self.counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)] + [sum(p not in legal for p in zip(roles, roles[1:], strict=False))]
        self.cost, self.audit = joined(self.tables)
        self.letters = self.tables = None

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", self._next(), ""

    def _next(self) -> str:
        self.at, self.turns = self.at + 1, self.turns + 1
        return "user" if self.turns % 2 else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns up to this row that stay or come in."""
        yield from self._inserted()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        elif edit == "K":
            self.at += 1
            self.turns += not (role[:1] == "s" and self.turns == 0)
            yield "K", role, text
        else:
            yield "R", self._next(), text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Repair, tuple[str, str, str] | None]]:
    """Every turn of every repaired conversation, and (repair, None) at the end of each."""
    now = None
    for batch in batches:
        for conv_id, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now:
                    yield from ((now, t) for t in now.end())
                    yield now, None
                now = Repair(conv_id)
            if kind == 0:
                now.letters.append(role)
                now.tables.append(text)
            else:
                if now.audit is None:
                    now.start()
                yield from ((now, t) for t in now.row(role, text))
    if now:
        yield from ((now, t) for t in now.end())
        yield now, None


def _output(rows: Iterator[tuple], schema: StructType, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    kinds = [key, *(pa.string() if isinstance(f.dataType, StringType) else pa.int64() for f in schema.fields[1:])]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema.names)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str)) + 64
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def ordered(rows: DataFrame) -> DataFrame:
    """rows with pos, their place in the order of conv_id, turn (nulls first), role and text; a stored table."""
    n = parts_of(rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64)).first()[0] or 0, PART_BYTES)
    keys = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return stored(ranged.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _letters(rows: DataFrame) -> DataFrame:
    """conv_id, pos, letter of ordered rows."""
    blank = ~F.col("text").rlike(FOUND)
    last = F.regexp_extract("text", rf"({FOUND})[\x20\x09-\x0D]*\z", 1)
    key = F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit("\n"), F.length("role").cast("string"), F.lit("\n"), "role", "text"), 256)
    fault = F.when(blank, BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    flat = rows.select("conv_id", "pos", key.alias("key"), fault.alias("fault"), F.when(F.length("role") == 0, OTHER).when(initial == 0, OTHER).otherwise(initial - 1).alias("initial"))
    first = flat.where(F.col("fault") != BLANK).groupBy("key").agg(F.min("pos").alias("first"))
    marked = flat.join(first, "key", "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return marked.select("conv_id", "pos", F.substring(F.lit(LETTERS), (4 * fault + F.col("initial") + 1).cast("int"), F.lit(1)).alias("letter"))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = pa.array([answers(x) for x in batch.column("role").to_pylist()], pa.string())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", tables)


def _stream(rows: DataFrame) -> DataFrame:
    """conv_id, kind, ord, role, text: of each conversation its segments (letters as role, answers as text), then its rows; whole and in order in one partition."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    segments = _letters(rows).groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("ord")).agg(letters.alias("role"))
    segments = segments.select("conv_id", F.lit(0).alias("kind"), "ord", "role", F.lit("").alias("text"))
    found = segments.mapInArrow(_searched, segments.schema)
    both = found.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), F.col("pos").alias("ord"), "role", "text"))
    n = parts_of(rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64)).first()[0] or 0, PART_BYTES)
    return both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "ord")


def _named(rows: DataFrame, id_column: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col(id_column).alias("conv_id"), "turn", blank("role"), blank("text"))


def repaired_turns(rows: DataFrame, *, id_column: str = "conv_id") -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text of the repaired conversations; rows as in repair_report."""
    bounded_batches(rows.sparkSession)
    stream = _stream(ordered(_named(rows, id_column)))
    schema = StructType([StructField("conv_id", stream.schema["conv_id"].dataType), StructField("place", LongType()), *(StructField(c, StringType()) for c in ("edit", "role", "text"))])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for repair, turn in _walk(batches):
            if turn:
                yield repair.conv_id, place, *turn
                place += 1
            else:
                place = 0

    key = stream.schema["conv_id"].dataType
    return stream.mapInArrow(lambda batches: _output(turns(batches), schema, _arrow_type(key)), schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair_report(rows: DataFrame, conversations: DataFrame, *, id_column: str = "conv_id") -> DataFrame:
    """A row for each id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its rows.

    rows: id, turn, role, text; null roles and texts count as one blank. Rows of a null id are a conversation too. Rows of equal turn come in the order
    of role, then text, so copies are next to each other. Texts may be of any length; a conversation's own bound is its audit, one letter a row, which must
    fit one value. Since its hash is one pass over its rows, one task reads the repaired rows of a conversation, batch by batch.
    A conversation without rows has zeros and the hash of no text; empty tables give no rows. Other columns don't matter.
    """
    bounded_batches(rows.sparkSession)
    own = ordered(_named(rows, id_column))
    stream = _stream(own)
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    kind = stream.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *(StructField(c, LongType()) for c in counts), *(StructField(c, StringType()) for c in ("audit", "repaired_sha256"))])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, first = hashlib.sha256(), True
        for repair, turn in _walk(batches):
            if turn:
                digest.update(f"{'' if first else '\n'}{turn[1]}:{turn[2]}".encode())
                first = False
            else:
                yield repair.conv_id, *repair.counts, repair.cost, repair.audit, digest.hexdigest()
                digest, first = hashlib.sha256(), True

    found = stream.mapInArrow(lambda batches: _output(report(batches), schema, _arrow_type(kind)), schema)
    gaps = own.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    ids = conversations.select(F.col(id_column).alias("id")).distinct()
    out = ids.join(gaps, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *counts)]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
