import hashlib
import heapq
import random
import re
import zlib

import pytest

conv = pytest.importorskip("shelfspark.llm.conversations")


def plain_damage(rows):
    out = []
    for i, t, r, x in rows:
        r, x = r if r is not None else " ", x if x is not None else " "
        k = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            x = ""
        if k == 2:
            x = re.sub("[.!?]", "", x)
        if k == 4:
            r = "user"
        out += [(i, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows):
    """Uniform-cost search over (cost, audit): the first that accepts is the cheapest, ties ASCII-least."""
    seen, marks = set(), []
    for r, x in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", x)
        marks.append("blank" if not found else "duplicate" if (r, x) in seen else "truncated" if found[-1] not in ".!?" else "fine")
        seen.add((r, x))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, turns = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return marks, cost, audit, turns
        if (i, last) in done:
            continue
        done.add((i, last))
        role = "assistant" if last == "u" else "user"
        push = lambda c, e, j, z, t: heapq.heappush(queue, (cost + c, audit + e, j, z, t))
        push(5, "I", i, role[0], turns + ((role, ""),))
        if i < len(rows):
            push(2, "D", i + 1, last, turns)
            r, x = rows[i]
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                if r[:1] == role[0] or (r[:1] == "s" and last == ""):
                    push(more, "K", i + 1, r[:1], turns + ((r, x),))
                push(1 + more, "R", i + 1, role[0], turns + ((role, x),))


def brute(rows):
    after, out, texts = plain_damage(rows), [], {}
    for i in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == i), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        marks, cost, audit, new = cheapest([r[2:] for r in own])
        ini = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
        out.append((i, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in new).encode()).hexdigest()))
        texts[i] = list(new)
    return sorted(out, key=str), texts


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "2 AS kind", "3 AS ord", "4 AS key", "5 AS gaps")


def run(spark, rows):
    df = table(spark, rows)
    return sorted((tuple(r) for r in conv.repair_report(conv.damaged(df), df).collect()), key=str)


def made(n, longest, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher"]) if r.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((i, t + (r.random() < 0.1) * 3, role, r.choice(["Yes.", "no", "Why? ", " \t\n", "é日本!", "a.\x0b", "so\x00", f"text {r.random()}."])))
    return rows


def test_equals_uniform_cost_search(spark):
    rows = made(150, 12, 5)
    got, texts = run(spark, rows), brute(rows)
    assert got == texts[0]
    turns = {}
    for i, place, _, role, text in sorted((tuple(x) for x in conv.repaired_turns(conv.damaged(table(spark, rows))).collect()), key=lambda x: x[:2]):
        assert place == len(turns.setdefault(i, []))
        turns[i].append((role, text))
    assert turns == {i: x for i, x in texts[1].items() if x}


def test_long_conversations_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(conv, "PART_BYTES", 600)
    rows = made(4, 300, 8) + made(3, 40, 9)
    assert run(spark, rows) == brute(rows)[0]


def test_segments_of_any_size_agree():
    r = random.Random(2)
    for _ in range(60):
        letters = "".join(r.choice("BCBCBCBCAADEFGHIKLMNOP") for _ in range(r.randint(1, 40)))
        whole = conv.joined([conv.answers(letters)])
        for n in (1, 2, 7):
            assert conv.joined([conv.answers(letters[i : i + n]) for i in range(0, len(letters), n)]) == whole


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (1, None, "user", "A."), (1, None, "assistant", "B."), (2, 3, "system", None), (3, 2**40, "user", "x" * 200000 + "."), (3, 0, "assistant", "."), (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 1, "assistant", "same.")]
    rows += [(10 + i, 0, "user", "?") for i in range(60)]  # some lose their only row
    got = run(spark, rows)
    assert got == brute(rows)[0] and any(r[1:8] == (0, 0, 0, 0, 0, 0, "") for r in got)
    assert run(spark, []) == []
