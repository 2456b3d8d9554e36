"""The window history against one table of all its batches."""

import pytest

from shelfspark.llm import substring
from shelfspark.llm.history import WindowHistory
from shelfspark.llm.repeats import Rule
from tests.llm.test_repeats import brute_words, corpus

RULE = Rule(5, 2, True)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")


@pytest.mark.parametrize("seed", range(2))
def test_batches_give_what_one_table_gives(spark, tmp_path, seed):
    rows = sorted(((i, t) for i, t in corpus(seed, 90, ["aa", "b", "é", "dd", "x,", "y"], " ") if i is not None), key=lambda r: r[0])
    cuts = [0, 30, 34, 60, len(rows)]
    while any(rows[c - 1][0] == rows[c][0] for c in cuts[1:-1]):  # rows of one id are one document
        cuts = [c + (0 < c < len(rows)) for c in cuts]
    history, got, sizes = WindowHistory(spark, str(tmp_path / "h"), rule=RULE, buckets=4, shard_bytes=300), [], []
    for a, b in zip(cuts, cuts[1:]):
        got += map(tuple, history.add(frame(spark, rows[a:b])).collect())
        sizes.append([n for _, n in history.runs()])
    assert sorted(got, key=str) == brute_words(rows, 5)
    windows = {tuple(w[s : s + 5]) for _, t in rows for w in [(t or "").split()] for s in range(len(w) - 4)}
    assert sum(sizes[-1]) == len(windows)
    assert all(x > 2 * y for s in sizes for x, y in zip(s, s[1:]))


def test_known_batch_loses_all_and_edge_cases(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    history = WindowHistory(spark, str(tmp_path / "h"), buckets=2)
    assert history.add(frame(spark, [(5, text)]).limit(0)).count() == 0 and history.runs() == []
    first = history.add(frame(spark, [(5, text), (6, None), (7, "")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in first) == [(5, 30, 0), (6, 0, 0), (7, 0, 0)]
    # a smaller id, an equal one, and none, in a later batch; another session is told of the runs
    for name, _ in history.runs():
        spark.sql(f"DROP TABLE {name}")
    again = WindowHistory(spark, str(tmp_path / "h"), buckets=2)
    later = again.add(frame(spark, [(1, text), (5, text), (None, text), (9, "new " + text[:20])])).collect()
    assert sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in later) == [(0, 30, 0), (1, 30, 30), (5, 30, 30), (9, 8, 0)]
    assert len(again.runs()) == 1


def test_runs_are_not_shuffled(spark, tmp_path):
    history = WindowHistory(spark, str(tmp_path / "h"), rule=RULE, buckets=4)
    history.add(frame(spark, [(1, "a b c d e f g h i j")]))
    run = history._run(history.runs()[0][0])
    keys = run.groupBy("a", "b").count().hint("merge")
    plan = keys.join(run.hint("merge"), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_ids_are_ordered_by_rule(spark, tmp_path):
    with pytest.raises(ValueError):
        WindowHistory(spark, str(tmp_path), rule=Rule(5, 2, False))
    assert substring.RULE.ordered
