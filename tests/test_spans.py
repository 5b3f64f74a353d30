import random
from itertools import permutations

from pyspark.sql import functions as F

from graphloom.operators import evaluation as E
from graphloom.operators import spans as S


def test_tokens():
    assert S.tokens("The dog's 1,000 cats, don't (U.S. law).") == ["the", "dog", "'s", "1,000", "cats", ",", "do", "n't", "(", "u.s.", "law", ")", "."]


def counts(gold, predicted, tag, mode):
    c = S.compared(*S.laid_out(gold, predicted))[tag, mode]
    return tuple(c[k] for k in S.COUNTS)


def test_equal_and_absent_triples():
    for mode in S.MODES:
        assert counts("a b | r | c", "A b | r | c", "ALL", mode) == (3, 0, 0, 0, 0)
        assert counts("a | r | c", "", "ALL", mode) == (0, 0, 0, 3, 0)
        assert counts("", "a | r | c", "ALL", mode) == (0, 0, 0, 0, 3)
        assert counts("a | r | c", "x | y | z", "ALL", mode) == (0, 0, 0, 3, 3)
    assert S.pair_score("a | r | c", "a | r | c")[0] == 1.0


def test_part_of_a_name_is_partly_right():
    # two of three words: type right, boundaries partly, neither exact nor strict
    gold, predicted = "new york city | r | c", "new york | r | c"
    assert counts(gold, predicted, "SUB", "ent_type") == (1, 0, 0, 0, 0) and counts(gold, predicted, "SUB", "partial") == (0, 0, 1, 0, 0)
    assert counts(gold, predicted, "SUB", "exact") == (0, 1, 0, 0, 0) and counts(gold, predicted, "SUB", "strict") == (0, 1, 0, 0, 0)


def test_words_around_belong_to_the_run_they_touch():
    x = S.layout("york city".split(), "new york city hall".split(), "SUB", "SUB", 0)
    assert x.gold == [S.Span("SUB", 1, 2)] and x.predicted == [S.Span("SUB", 0, 3)] and x.size == 4
    # a word in the middle that is not found ends the span before it, and again the next one begins
    x = S.layout("a b c".split(), "a c".split(), "SUB", "SUB", 5)
    assert x.predicted == [S.Span("SUB", 5, 5), S.Span("SUB", 5, 6), S.Span("SUB", 7, 7)]


def test_crossed_subject_and_object():
    m = S.compared(*S.laid_out("anna | knows | ben", "ben | knows | anna"))
    # places agree, types don't
    assert m["SUB", "exact"]["correct"] == 1 and m["SUB", "ent_type"]["incorrect"] == 1 and m["OBJ", "strict"]["incorrect"] == 1


def test_best_pairs_beat_every_permutation():
    rng = random.Random(3)
    word = lambda: rng.choice("a b c d e f".split())
    triple = lambda: f"{word()} {word()} | {word()} | {word()}"
    for _ in range(25):
        gold, predicted = [triple() for _ in range(rng.randint(0, 4))], [triple() for _ in range(rng.randint(1, 4))]
        n = max(len(gold), len(predicted))
        a, b = gold + [""] * (n - len(gold)), predicted + [""] * (n - len(predicted))
        best = max(sum(S.pair_score(a[p[i]], b[i])[0] for i in range(n)) for p in permutations(range(n)))
        total, pairs = S.best_pairs(gold, predicted)
        assert abs(total - best) < 1e-9 and sorted(x for x, _, _ in pairs) == sorted(a) and [y for _, y, _ in pairs] == b


def test_totals(spark):
    e = spark.createDataFrame([(1, ["a | r | c"], ["a | r | x", "q | q | q"]), (2, None, None), (3, ["a | r | c"], [])], "entry long, gold array<string>, predicted array<string>")
    got = {(r["tag"], r["mode"]): r for r in S.system_scores(e).collect()}
    assert len(got) == 16
    r = got["ALL", "exact"]
    assert (r["correct"], r["missed"], r["spurious"], r["possible"], r["actual"]) == (2, 4, 4, 6, 6) and abs(r["recall"] - 2 / 9) < 1e-9
    scores = {r["entry"]: r["score"] for r in S.assignments(e).collect()}
    assert abs(scores[1] - 1 / 3) < 1e-9 and scores[2] == 0 and scores[3] == 0


def test_alignment_against_plain_search():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("wxyz") for _ in range(rng.randint(0, 9))] for _ in range(2))
        free_a, free_b, want = set(range(len(a))), set(range(len(b))), []
        for n in range(min(len(a), len(b)), 0, -1):
            for j in range(len(b) - n + 1):
                for i in range(len(a) - n + 1):
                    if a[i : i + n] == b[j : j + n] and free_a.issuperset(range(i, i + n)) and free_b.issuperset(range(j, j + n)):
                        free_a -= set(range(i, i + n))
                        free_b -= set(range(j, j + n))
                        want.append((i, j, n))
        assert E.align_runs(a, b) == want
    long = [str(i % 5000) for i in range(20000)]
    assert E.align_runs(long[:10000], long[:10000])[0] == (0, 0, 10000)


def test_equal_entries_are_scored_once(spark, tmp_path, monkeypatch):
    lists = [(["a b | has kind of | c d", "e | is | f"], ["e | is | g", "a | has kind of | c d"]), ([], ["x | y | z"]), (None, None), (["q | r | s"], [])]
    rows = [(i, *lists[i % 4]) for i in range(100)]
    e = spark.createDataFrame(rows, "entry long, gold array<string>, predicted array<string>")
    want = {r["entry"]: r["score"] for r in S.assignments(e).collect()}
    assert len(want) == 100 and all(want[i] == want[i % 4] for i in range(100))
    assert want[0] == S.best_pairs(*lists[0])[0] / 2 and want[2] == 0
    # the means are those over all pairs, and what is scored are the four different entries
    all_ = {(r["tag"], r["mode"]): r for r in S.pair_measures(e).groupBy("tag", "mode").agg(F.sum("correct").alias("n"), F.avg("f1").alias("f1")).collect()}
    seen = []
    plain = S.pair_measures
    monkeypatch.setattr(S, "pair_measures", lambda df: seen.append(df.count()) or plain(df))
    for r in S.system_scores(e).collect():
        assert r["correct"] == all_[r["tag"], r["mode"]]["n"] and abs(r["f1"] - all_[r["tag"], r["mode"]]["f1"]) < 1e-12
    assert seen == [4]
