import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation as E
from graphloom.operators import extraction as X
from graphloom.operators import graph as G
from graphloom.operators.models import StubClient
from graphloom.operators import retrieval as R


def kg(spark, *rows):
    return spark.createDataFrame(list(rows), "s string, r string, o string")


def test_upsert_keeps_old_values_where_new_ones_are_null(spark):
    old = spark.createDataFrame([("Food", "rice", 1.0), ("Food", "fish", 2.0)], "label string, name string, fat double")
    new = spark.createDataFrame([("Food", "rice", None), ("Entity", "rice", 5.0), ("Food", "fish", 3.0)], "label string, name string, fat double")
    got = {(r["label"], r["name"]): r["fat"] for r in G.upsert_nodes(old, new).collect()}
    assert got == {("Food", "rice"): 1.0, ("Entity", "rice"): 5.0, ("Food", "fish"): 3.0}
    twice = spark.createDataFrame([("Food", "rice", 7.0, 1), ("Food", "rice", None, 2), ("Food", "tea", 4.0, 3)], "label string, name string, fat double, at int")
    assert sorted(map(tuple, G.upsert_nodes(old, twice, order="at").collect())) == [("Food", "fish", 2.0), ("Food", "rice", 7.0), ("Food", "tea", 4.0)]


def test_self_loop_once_and_substring_on_either_side(spark):
    t = kg(spark, ("a", "r", "a"), ("a", "làm trầm trọng", "Bệnh GOUT"), ("gout", "Cần hạn chế ở", "rượu"), ("b", "other", "gout"))
    assert G.node_relations(t, "a").count() == 2
    assert sorted(r["item"] for r in G.avoid_list(t, "Gout").collect()) == ["a", "rượu"]


def test_edge_types_and_labels(spark):
    rows = spark.createDataFrame([("Là nguồn ",), ("contains much",), ("đ",), ("a-b c",)], "r string")
    assert [r[0] for r in rows.select(G.edge_type(F.col("r"))).collect()] == ["GIAU", "CONTAINS_MUCH", "RELATED_TO", "AB_C"]
    assert spark.range(1).select(G.node_label(F.lit("Other")), G.entity_class(F.lit(" Gout "), F.lit(False)), G.entity_class(F.lit("gout"), F.lit(True))).first()[:] == ("Entity", "Disease", "Food")


def test_all_classes_are_counted(spark):
    got = G.class_counts(spark.createDataFrame([("Food",), ("Food",), ("Other",)], "kind string")).collect()
    assert {r["kind"]: r["n"] for r in got} == {"Food": 2, "Disease": 0, "Nutrient": 0, "Other": 1}


def test_danglers_make_no_edge(spark):
    e = spark.createDataFrame([("L", "a", "T", "t", "L", "b"), ("L", "a", "T", "t", "L", "gone")], G.EDGE_KEY)
    nodes = spark.createDataFrame([("L", "a"), ("L", "b")], "label string, name string")
    assert G.upsert_edges(e.limit(0), e.union(e), nodes).count() == 1


def test_leaders_equal_the_sequential_rule(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    leaders, want = [], {}
    for i in range(60):
        want[i] = next((j for j in leaders if u[i] @ u[j] >= 0.6), i)
        if want[i] == i:
            leaders.append(i)
    assert {r["i"]: r["leader"] for r in R.leader_clusters(df, 0.6).collect()} == want


def test_leaders_need_no_pairs(spark, monkeypatch):
    import numpy as np

    # some hundred places with many copies each, decided in stretches of 50; a null vector leads itself alone
    monkeypatch.setattr(R, "similar_pairs", None)
    rng = np.random.default_rng(4)
    u = rng.normal(size=(100, 8))
    u = (u / np.linalg.norm(u, axis=1)[:, None])[rng.integers(0, 100, 4000)]
    leaders, want = [], {}
    for i in range(4000):
        want[i] = next((j for j in leaders if u[i] @ u[j] >= 0.7), i)
        if want[i] == i:
            leaders.append(i)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(u)]
    for stretch in (R.STRETCH, 50):
        got = R.leader_clusters(spark.createDataFrame([*rows, (9999, None)], "i long, v array<double>"), 0.7, stretch=stretch).collect()
        assert {r["i"]: r["leader"] for r in got} == {**want, 9999: 9999}
    assert not R.leader_clusters(spark.createDataFrame([], "i long, v array<double>"), 0.7).count()


@pytest.mark.parametrize(("n", "finish"), [(1000, R.FINISH), (5, 3)])
def test_leaders_of_a_path(spark, monkeypatch, n, finish):
    import math

    # each vector is similar only to its neighbours in order
    monkeypatch.setattr(R, "FINISH", finish)
    step = math.pi / n
    df = spark.createDataFrame([(i, [math.cos(i * step), math.sin(i * step)]) for i in range(n)], "i long, v array<double>")
    got = {r["i"]: r["leader"] for r in R.leader_clusters(df, math.cos(1.5 * step)).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_leaders_of_long_paths_and_random_pairs(spark):
    path = spark.range(100_000).select(F.col("id").alias("i"))
    pairs = spark.range(99_999).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert R.leaders_of(path, pairs).agg(F.count("*"), F.sum(F.col("i") % 2)).first() == (50_000, 0)
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(2500)})
    leads: set[int] = set()
    for n in range(300):
        if not any(i in leads for i, j in edges if j == n):
            leads.add(n)
    nodes, some = spark.range(300).select(F.col("id").alias("i")), spark.createDataFrame(edges, "i long, j long")
    for most in (60, 700, None):
        assert {r["i"] for r in R.leaders_of(nodes, some, most).collect()} == leads
    assert R.leaders_of(nodes.limit(0), some.limit(0)).count() == 0


def test_percentiles_by_ranges(spark):
    rng = random.Random(2)
    shares = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    lists = [[], [3.5], [1.0, 1.0, 1.0, 2.0], [rng.gauss(0, 1) for _ in range(500)], [rng.choice([0.1, 0.1 + 2**-55, 1e308, -1e308, 5e-324, 0.0]) for _ in range(400)], [float(rng.randint(0, 9)) for _ in range(300)] + [float("inf")] * 20 + [float("-inf")] * 9 + [float("nan")] * 4]
    for values in lists:
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        order = sorted(values, key=lambda x: (math.isnan(x), x))
        want = [order[max(1, math.ceil(s * len(order))) - 1] if order else None for s in shares]
        for n in (E.RANGES, 3):
            assert str(E.nearest_ranks(df, "x", shares, n)) == str(want)
    assert "percentile" not in E.latency(spark.range(100).select(F.col("id").alias("x")), "x")._jdf.queryExecution().toString()


def test_assignment_beats_every_permutation():
    import random
    from itertools import permutations

    rng = random.Random(1)
    for n in (1, 3, 5, 6):
        m = [[rng.randint(0, 4) / 4 for _ in range(n)] for _ in range(n)]
        best = max(sum(m[i][p[i]] for i in range(n)) for p in permutations(range(n)))
        assert abs(E.best_assignment(m)[0] - best) < 1e-9 and abs(E._augmented(m)[0] - best) < 1e-9


def test_alignment_takes_longest_runs_first():
    assert E.align_runs("a b c d".split(), "c d x a b c".split()) == [(0, 3, 3)] or E.align_runs("a b c d".split(), "c d x a b c".split())[0] == (0, 3, 3)
    assert E.align_runs(["a"], []) == []


def test_macro_scores_of_nothing_in_common(spark):
    g = spark.createDataFrame([(1, "A")], "entry int, triple string")
    p = spark.createDataFrame([(1, "b")], "entry int, triple string")
    assert E.macro_scores(g, p).first()[:] == (0.0, 0.0, 0.0)


def test_ascii_fold_of_long_texts_in_small_batches(spark, monkeypatch):
    from pyspark.sql import Row

    from graphloom.sources import work

    text = "Đường e\u0301\u0323 và plain " * 9
    want = "Duong e va plain " * 9
    for n in (1, 2, 7, 1 << 16):
        monkeypatch.setattr(E, "FOLD_CHARS", n)
        assert E._folded(text) == want
    assert E._folded(None) is None and E._folded("") == ""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        df = work.batched(spark.createDataFrame([Row(x=None), Row(x=text)]))
        assert spark.conf.get(key) == str(work.BATCH_BYTES)
        assert [r[0] for r in df.select(E.ascii_fold("x")).collect()] == [None, want]
    finally:
        spark.conf.unset(key)


def test_ascii_fold(spark):
    assert spark.createDataFrame([("Đường đỏ",)], "x string").select(E.ascii_fold("x")).first()[0] == "Duong do"


def test_canonical_relations_cost_no_call(spark):
    class Counting(StubClient):
        def complete(self, prompts):
            raise RuntimeError("no call expected")

    t = spark.createDataFrame([(1, 0, "a", "the", "b")], "chunk long, pos long, s string, r string, o string")
    schema = spark.createDataFrame([("the", "what the means", 0)], "relation string, definition string, ord long")
    d = spark.createDataFrame([(1, "the", "x")], "chunk long, relation string, definition string")
    got = X.canonicalize(t, d, schema, Counting()).first()
    assert (got["status"], got["canonical"]) == ("canonical", "the")


def test_failed_model_keeps_the_chunk(spark):
    class Broken(StubClient):
        def complete(self, prompts):
            raise OSError

    c = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y")], "doc string, chunk long, text string")
    assert [r["text"] for r in X.resolve_coreference(c, Broken()).orderBy("chunk").collect()] == ["x", "y"]


def test_relations_of_most_rows_do_not_meet_in_one_task(spark, monkeypatch):
    t = spark.range(3000).select(F.col("id").alias("k"), F.explode(F.array(F.lit("all"), F.concat(F.lit("r"), (F.col("id") % 7).cast("string")))).alias("r"))
    want = sorted(map(tuple, R.retriever_samples(t, "k").collect()))
    plan = R.retriever_samples(t, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    entries = t.groupBy("k").agg(F.collect_list(F.array(F.lit("s"), "r", F.lit("o"))).alias("triples")).select(F.col("k").alias("entry"), F.lit("s to o").alias("text"), "triples")
    defined = t.select(F.col("k").alias("entry"), F.col("r").alias("relation"), F.concat(F.lit("d "), "r").alias("definition"))
    samples = sorted(map(str, R.collect_samples(entries, defined).collect()))
    assert len(want) == len(samples) == 6000
    # a table too large for that is copied to shares of each relation's rows
    monkeypatch.setattr(R, "BESIDE_BYTES", 0)
    assert sorted(map(tuple, R.retriever_samples(t, "k").collect())) == want
    assert sorted(map(str, R.collect_samples(entries, defined).collect())) == samples
    shares = R._beside(t, R._relations(t)[0], ["r"])
    assert "_share" in shares._jdf.queryExecution().toString() and shares.count() == 6000


def test_pairs_of_stored_floats_in_blocks(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(8).normal(size=(90, 7)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i long, v array<float>")
    assert R._stored(df) == "array<float>" and R.BLOCK >= 4096
    w = v.astype(np.float64)
    n = np.sqrt((w * w).sum(1))
    s = w @ w.T / (n[:, None] * n[None, :] + 1e-9)
    want = {(i, j): round(s[i, j], 9) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.3}
    monkeypatch.setattr(R, "AT_ONCE", 5)
    for block in (16, R.BLOCK):
        assert {(r["i"], r["j"]): round(r["sim"], 9) for r in R.similar_pairs(df, 0.3, block).collect()} == want
