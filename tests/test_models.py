import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import advice as A
from graphloom.operators import extraction as X
from graphloom.operators import inner_products as I
from graphloom.operators import models as M
from graphloom.operators import retrieval as R


def counting(path, fail=0):
    """A client that notes the size of each call in a file, as workers are processes of their own, and fails at first."""

    class Counting(M.StubClient):
        def complete(self, prompts):
            with open(path, "a") as f:
                f.write(f"{len(prompts)}\n")
            with open(path) as f:
                if len(f.readlines()) <= fail:
                    raise OSError("down")
            return super().complete(prompts)

    return Counting()


def texts(spark, n):
    return spark.range(n).select(F.col("id").alias("chunk"), F.lit("One two three").alias("text")).coalesce(1)


def test_calls_are_small_and_tried_again(spark, tmp_path):
    assert X.extract(texts(spark, 120), counting(str(tmp_path / "a"))).count() == 120
    assert (tmp_path / "a").read_text().split() == ["50", "50", "20"]
    assert X.extract(texts(spark, 3), counting(str(tmp_path / "b"), 2)).count() == 3


def test_a_service_that_is_down_fails_loudly(spark, tmp_path):
    with pytest.raises(Exception, match="the model failed 3 times"):
        X.extract(texts(spark, 2), counting(str(tmp_path / "c"), 99)).count()
    asks = texts(spark, 2).withColumn("p", F.lit("standardise\n## text\nx"))
    got = M.asked(asks, counting(str(tmp_path / "d"), 99), "p", "answer", strict=False, wait=0).collect()
    assert all(r["answer"] is None and r["answer_error"] == "OSError: down" for r in got)


def test_few_shot_and_context_reach_the_client(spark):
    class Echo(M.StubClient):
        def complete(self, prompts):
            return [str([["a", "b", M.sections(p)[1]["examples"]]]) for p in prompts]

    got = X.extract(texts(spark, 1), Echo(), M.Prompts(few_shot={"extract": "shown"})).first()
    assert got["o"] == "shown"
    c = spark.createDataFrame([("d", 0, "Anna came."), ("d", 1, "Then it sat; it ran"), ("d", 2, "And it slept")], "doc string, chunk long, text string")
    assert [r["text"] for r in X.resolve_coreference(c, M.StubClient()).orderBy("chunk").collect()] == ["Anna came.", "Then Anna sat; Anna ran", "And Anna slept"]


def test_dispatch_by_name():
    a, b = M.StubClient(), M.StubClient()
    assert M.Dispatch("x/big", [("/", a), ("", b)]).client is a and M.Dispatch("big", [("/", a), ("", b)]).client is b
    with pytest.raises(ValueError, match="no client"):
        M.Dispatch("big", [("/", a)])


def test_coreference_goes_through_documents_side_by_side(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(d, k, rng.choice(["Anna came.", "Then it sat", "and it slept", " it ", ""])) for d in range(60) for k in range(rng.randint(1, 5))] + [(None, 0, "Bo is here"), (None, 1, "and it ran"), (900, 0, None)]
    want = []
    for d in {r[0] for r in rows}:
        before = ""
        for _, k, t in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            said = M.StubClient().complete([f"resolve\n## context\n{before}\n## text\n{t or ''}"])[0].strip(" \t\n\x0b\f\r")
            want.append((d, k, said))
            before = said
    c = spark.createDataFrame(rows, "doc long, chunk long, text string").repartition(3)
    got = X.resolve_coreference(c, M.StubClient())
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.columns == ["doc", "chunk", "text"]
    # 120 documents of 3 chunks in one task: three waves, each in calls of 50
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        many = spark.range(360).select((F.col("id") % 120).alias("doc"), F.floor(F.col("id") / 120).alias("chunk"), F.lit("it is").alias("text"))
        assert X.resolve_coreference(many, counting(str(tmp_path / "w"))).count() == 360
        assert (tmp_path / "w").read_text().split() == ["50", "50", "20"] * 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    down = X.resolve_coreference(c, counting(str(tmp_path / "x"), 10**6), errors=True, wait=0).collect()
    assert {r["error"] for r in down} == {"OSError: down"}
    assert sorted(str(tuple(r)[:3]) for r in down) == sorted(map(str, rows))


def test_enrich_takes_the_nearest_known_relation(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    schema = [(f"s{i}", rng.normal(size=5)) for i in range(4)]
    rows = [(i, f"r{rng.integers(0, 30)}" if i % 9 else "s2", rng.normal(size=5)) for i in range(60)]
    rows[10] = (10, "near", schema[1][1] + 0.01)
    unit = lambda v: v / np.linalg.norm(v)
    known, want, said = [(r, unit(v)) for r, v in sorted(schema)], {}, {r: r for r, _ in schema}
    for i, r, v in rows:
        if r not in said:
            best = max(known, key=lambda k: k[1] @ unit(v))
            said[r] = best[0] if best[1] @ unit(v) >= 0.6 else r
            if said[r] == r:
                known.append((r, unit(v)))
                want[i] = (r, True)
        want.setdefault(i, (said[r], False))
    df = spark.createDataFrame([(i, r, [float(x) for x in v]) for i, r, v in rows], "ord long, relation string, v array<double>")
    sc = spark.createDataFrame([(r, [float(x) for x in v]) for r, v in schema], "relation string, w array<double>")
    got = {r["ord"]: (r["canonical"], r["added"]) for r in X.enrich(df, sc, 0.6).collect()}
    assert got == want and got[10] == ("s1", False)


@pytest.mark.parametrize("seed", [0, 1])
def test_grown_schema_is_the_sequential_rule(spark, seed):
    import numpy as np

    client = M.StubClient()
    names = ["apple", "ant", "bear", "bat", "cat", "apple", "cow", "dog", "bat", "eel", "ant", "elk", "ape", "bee"]
    if seed:
        # few letters, so that what joins pushes others out of the nearest five again and again
        rng = random.Random(seed)
        names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(90)]
    triples = [(i // 3, i % 3, f"x{i}", n, "y") for i, n in enumerate(names)]
    schema = [("axe", "what axe means", 0), ("bear", "what bear means", 1)]
    known, want = list(schema), []
    for c, p, _, r, _ in triples:
        if r in {x[0] for x in known}:
            want.append((c, p, r))
            continue
        v = np.array(client.embed([f"what {r} means"])[0])
        best = sorted(known, key=lambda x: (-(v @ np.array(client.embed([x[1]])[0])), x[2]))[:5]
        found = next((x[0] for x in best if x[0][0] == r[0]), None)
        if found is None:
            known.append((r, f"what {r} means", len(known)))
        want.append((c, p, found or r))
    t = spark.createDataFrame(triples, "chunk long, pos long, s string, r string, o string")
    sc = spark.createDataFrame(schema, "relation string, definition string, ord long")
    got = X.canonicalize(t, X.define(t, client), sc, client, enrich=True).orderBy("chunk", "pos").collect()
    assert [(r["chunk"], r["pos"], r["canonical"]) for r in got] == want


def test_grown_schema_takes_few_rounds(spark, monkeypatch):
    # longer and longer words: each one that joins pushes the options of all after it
    from pyspark.sql import functions as F

    client, saves = M.StubClient(), []
    names = ["abcdefgh"[i % 8] + "e" * (i // 2) for i in range(48)]
    t = spark.createDataFrame([(i, 0, "x", n, "y") for i, n in enumerate(names)], "chunk long, pos long, s string, r string, o string")
    sc = spark.createDataFrame([("zz", "what zz means", 0)], "relation string, definition string, ord long")
    known, want = [("zz", "what zz means")], []
    for n in names:
        v = client.embed([f"what {n} means"])[0]
        best = sorted(range(len(known)), key=lambda i: (-sum(a * b for a, b in zip(v, client.embed([known[i][1]])[0])), i))[:5]
        found = n if n in {x[0] for x in known} else next((known[i][0] for i in best if known[i][0][0] == n[0]), None)
        if found is None:
            known.append((n, f"what {n} means"))
        want.append(found or n)
    plain = X.saved
    monkeypatch.setattr(X, "saved", lambda df: saves.append(1) or plain(df))
    got = X.canonicalize(t, X.define(t, client), sc, client, enrich=True).orderBy("chunk").collect()
    assert [r["canonical"] for r in got] == want
    assert len(saves) <= 8
    # over several stretches too, with the schema in order of joining
    pairs = M.embedded(t.select("chunk", "r", "pos", F.concat(F.lit("what "), "r", F.lit(" means")).alias("definition"), F.lit("t").alias("triple")), client, "definition", "v")
    picked, schema = X.grown_schema(pairs, M.embedded(sc, client, "definition", "w"), client, stretch=7)
    assert [r["picked"] for r in picked.orderBy("chunk").collect()] == want
    assert [(r["relation"], r["ord"]) for r in schema.orderBy("ord").collect()] == [(n, i) for i, (n, _) in enumerate(known)]


@pytest.mark.parametrize("options", [["a: b", "c: d"], [], ["x", None]])
def test_choices_of_one_list_are_those_of_a_column(spark, options):
    from pyspark.sql import functions as F

    from graphloom.functions import text as T

    o = F.array(*[F.lit(x).cast("string") for x in options]).cast("array<string>")
    df = spark.createDataFrame([(a,) for a in ("A", "B. x", "C", "", None, "é", "@")], "a string").select("a", T.choices(o).alias("c"), T.chosen(F.col("a"), o).alias("p"))
    assert all((r["c"], r["p"]) == (T.choices_of(options), T.chosen_of(r["a"], options)) for r in df.collect())


def test_substring_search_by_rarest_grams(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcđ ") for _ in range(rng.randint(0, n)))
    names = ["Tiểu đường tuýp 2", "đường", "xy", "ab", "aaaa", "", None, "AB ab"] + [word(14) for _ in range(150)]
    keys = ["tiểu đường", "đường", "b", "xy", "none", "", None, "aa", "aaaaa", "b a"] + [word(6) for _ in range(80)]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, item int")
    wanted = spark.createDataFrame([(k,) for k in keys], "key string")
    want = sorted((k, n, i) for k in {k for k in keys if k is not None} for i, n in enumerate(names) if n is not None and k in n.lower())
    for most in (A.GRAM_NAMES, 7):  # also with the names of most grams dealt out
        monkeypatch.setattr(A, "GRAM_NAMES", most)
        found = A.holding(wanted, table)
        assert sorted((r["key"], r["name"], r["item"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert A.holding(wanted.limit(0), table).count() == A.holding(wanted, table.limit(0)).count() == 0


def test_mapping_by_pages_of_names(spark):
    class Shy(M.StubClient):
        """As the stub, but a prompt may not list more than 60 bytes of names."""

        @staticmethod
        def _match(p):
            if len(p["nodes"].encode()) > 60:
                raise ValueError("too long a list")
            return M.StubClient._match(p)

    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    table = spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "name string")
    asks = [(1, " ".join(rng.sample(names, 50))), (2, names[5]), (3, "none of them"), (4, " ".join([names[0], names[-1], names[60]])), (5, None)]
    requests = spark.createDataFrame(asks, "id long, food string")
    whole = sorted(map(tuple, A.map_to_nodes(requests, table, M.StubClient()).collect()))
    paged = sorted(map(tuple, A.map_to_nodes(requests, table, Shy(), page_bytes=60).collect()))
    assert paged == whole
    assert [n for i, n, _ in sorted(paged, key=lambda r: (r[0], r[2])) if i == 4] == [names[0], names[60], names[-1]]
    assert A.map_to_nodes(requests, table.limit(0), M.StubClient()).count() == 0


def test_similar_pairs_of_many_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    v = np.concatenate([c + 0.2 * rng.normal(size=(30, 8)) for c in centres])
    ids = [int(i) * 10**13 for i in rng.permutation(len(v))]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "i long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(v)) for b in range(a) if u[a] @ u[b] >= 0.9}
    assert {(r["i"], r["j"]) for r in R.similar_pairs(df, 0.9, block=16).collect()} == want and len(want) > 100


def test_negatives(spark):
    t = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "c")], "k string, r string")
    assert {(r["k"], r["r"]) for r in R.negative_relations(t, "k").collect()} == {("k", "c"), ("l", "a"), ("l", "b")}


def test_largest_products_without_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 6))
    w = np.concatenate([(c + 0.15 * rng.normal(size=(30, 6))) * rng.uniform(0.2, 3) for c in centres])
    w = np.concatenate([w, w[:5], w[:5], np.zeros((3, 6)), rng.integers(-1, 2, size=(80, 6))])  # repeated, empty and tying targets
    v = np.concatenate([centres[:20] + 0.1 * rng.normal(size=(20, 6)), np.zeros((1, 6)), -centres[:4], rng.integers(-1, 2, size=(15, 6))])
    order = rng.permutation(len(w))
    targets = spark.createDataFrame([(f"t{i}", int(o), [float(x) for x in r]) for i, (o, r) in enumerate(zip(order, w, strict=True))] + [("none", -1, None)], "t string, ord long, w array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "q long, v array<double>")
    product = lambda a, b: float(np.add.accumulate(a * b)[-1])
    want = []
    for i, a in enumerate(v):
        best = sorted(((-product(a, b), int(o), f"t{j}") for j, (o, b) in enumerate(zip(order, w, strict=True))))[:7]
        want += [(i, t, -s, n + 1) for n, (s, _, t) in enumerate(best)]
    for part_bytes in (I.TARGET_BYTES, 6000):
        found = I.top_k(queries, targets, 7, part_bytes, 16)
        assert sorted(map(tuple, found.collect())) == sorted(want)
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    compared = I.searched(queries.limit(20), targets, 7, block=16).agg(F.sum("compared")).first()[0]
    assert 20 * 7 <= compared < 20 * len(w) / 2
    assert I.top_k(queries, targets, 2000).count() == len(v) * len(w)
    assert I.top_k(queries, targets.limit(0), 3).count() == I.top_k(queries.limit(0), targets, 3).count() == 0
