import pytest
from pyspark.sql import functions as F

from graphloom.sources import commits as C
from graphloom.sources import files as S
from graphloom.streaming import chunks


def test_schema_header_commas_and_last_wins(spark, tmp_path):
    (tmp_path / "s.csv").write_text("relation,definition\nchứa,holds, or contains\ngiàu,rich\nchứa,last\n", encoding="utf-8")
    got = {r["relation"]: r["definition"] for r in S.read_schema(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {"chứa": "last", "giàu": "rich"}
    assert S.read_schema(spark, str(tmp_path / "s.csv"), header=False).count() == 3


def test_triples_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "it's", "r", "o"), (0, 1, "a", "b", "c"), (1, 0, "x", "y", "z")], "chunk_no int, pos int, s string, r string, o string")
    S.write_chunk_triples(rows, str(tmp_path / "t"))
    got = S.read_triples(spark, str(tmp_path / "t" / "part-*")).orderBy("chunk_no", "pos").collect()
    assert [(r["s"], r["r"], r["o"]) for r in got] == [("it's", "r", "o"), ("a", "b", "c"), ("x", "y", "z")]
    S.write_flat_triples(rows, ["chunk_no", "pos"], str(tmp_path / "f"))
    assert S.read_triples(spark, str(tmp_path / "f" / "part-*")).count() == 3
    assert S.read_triples(spark, str(tmp_path / "f" / "part-*"), nested_only=True).count() == 0


def test_lines_keep_blanks_and_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\nthree\n")
    assert [(r["line_no"], r["text"]) for r in S.read_lines(spark, str(tmp_path / "a.txt")).collect()] == [(0, "one"), (1, ""), (2, "three")]


def test_food_last_row_wins(spark, tmp_path):
    (tmp_path / "f.csv").write_text('TÊN THỨC ĂN,Fat (g),Loại\nCơm,"8,6",a\ncơm ,x,b\n', encoding="utf-8")
    got = S.read_food(spark, str(tmp_path / "f.csv")).collect()
    assert [(r["key"], r["fat"], r["food_group"]) for r in got] == [("cơm", None, "b")]


def test_evaluation_xml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Id1", ["a | b | c", "d | e | f"]), ("Id2", [])], "entry string, triples array<string>")
    S.write_evaluation_xml(df, str(tmp_path / "x"), "gtriple")
    got = {r["entry"]: r["triples"] for r in S.read_evaluation_xml(spark, str(tmp_path / "x"), "gtriple").collect()}
    assert got == {"Id1": ["a | b | c", "d | e | f"], "Id2": []}


def test_graph_and_stages(spark, tmp_path):
    edges = spark.createDataFrame([("L", "a", "T", "t", "L", "b")], "s_label string, s_name string, rel_type string, relation string, o_label string, o_name string")
    nodes = spark.createDataFrame([("L", "a")], "label string, name string")
    S.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = S.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == 1 and e.where("rel_type = 'T'").count() == 1
    S.write_stages(nodes, str(tmp_path / "st"), 0)
    try:
        S.write_stages(nodes, str(tmp_path / "st"), 0)
        raise AssertionError("an existing iteration must be refused")
    except Exception as e:
        assert "exists" in str(e).lower()
    S.append_csv(nodes, str(tmp_path / "c"))
    S.append_csv(nodes, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_stream_upserts_each_triple_once(spark, tmp_path):
    spark.sql("SELECT 'a' AS s, 'r' AS r, 'b' AS o, timestamp'2024-01-01 00:00:00' AS at FROM range(3)").write.parquet(str(tmp_path / "in"))
    q = chunks.upsert_stream(chunks.triple_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_split_by_hash_of_the_key(spark, tmp_path):
    df = spark.range(4000).select("id", (F.col("id") % 7).alias("x"))
    S.write_split(df, str(tmp_path / "a"), key=["id"])
    S.write_split(df.unionByName(df.select((F.col("id") + 5000).alias("id"), "x")).repartition(3, "x"), str(tmp_path / "b"), key=["id"])
    read = lambda p, n: {r["id"] for r in spark.read.parquet(str(tmp_path / p / n)).collect()}
    sides = {n: read("a", n) for n in ("train", "valid", "test")}
    assert sorted(i for s in sides.values() for i in s) == list(range(4000))
    assert abs(len(sides["train"]) - 3000) < 150 and abs(len(sides["valid"]) - 500) < 100
    for n, ids in sides.items():
        assert {i for i in read("b", n) if i < 4000} == ids


def held(path):
    """The data files below a path, with their bytes."""
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*.parquet")}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.range(2000).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.when(F.col("id") % 3 > 0, F.lit("L")).alias("label"), F.col("id").alias("x"), F.lit(None).cast("double").alias("y"))
    store = C.KeyedTable.create(rows, str(path), ["label", "name"], 50)
    before, folders = held(path), dict(store.state["folders"])
    with pytest.raises(ValueError, match="there is a table"):
        C.KeyedTable.create(rows, str(path), ["label", "name"])
    new = spark.createDataFrame([("L", "n1", None, 7.5), ("L", "n2", 5, None), ("L", "brand new", 1, 1.0)], "label string, name string, x long, y double")
    after = store.upsert(new)
    got = {(r["label"], r["name"]): (r["x"], r["y"]) for r in after.read().collect()}
    assert len(got) == 2001 and got["L", "n1"] == (1, 7.5) and got["L", "n2"] == (5, None) and got["L", "brand new"] == (1, 1.0) and got[None, "n3"] == (3, None)
    moved = {b for b, f in after.state["folders"].items() if folders.get(b) != f}
    assert 1 <= len(moved) <= 3
    now = held(path)
    assert all(now[k] == v for k, v in before.items())
    # the old version is read until the new one is there, and a writer that comes too late is refused
    assert store.read().count() == 2000
    with pytest.raises(RuntimeError, match="another writer"):
        store.upsert(new)
    assert C.KeyedTable(spark, str(path)).version == 2
    after.vacuum()
    assert C.KeyedTable(spark, str(path)).read().count() == 2001
    assert after.upsert(new.limit(0)).version == 2


def test_a_broken_write_leaves_the_graph(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([("Food", "a")], "label string, name string")
    edges = spark.createDataFrame([("Food", "a", "R", "r", "Food", "a")], "s_label string, s_name string, rel_type string, relation string, o_label string, o_name string")
    S.save_graph(nodes, edges, path)
    with monkeypatch.context() as m:
        m.setattr(S, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            S.save_graph(nodes.limit(0), edges.limit(0), path)
    assert [x.count() for x in S.load_graph(spark, path)] == [1, 1]
    n, e = S.load_graph(spark, path)
    S.save_graph(n.unionByName(n.withColumn("name", F.lit("b"))), e, path)  # made from the graph that it replaces
    assert [x.count() for x in S.load_graph(spark, path)] == [2, 1]
    assert len([p for p in (tmp_path / "g").iterdir() if p.name.startswith("data-")]) == 1


def test_paragraphs_in_several_files_are_digested_piece_by_piece(spark, tmp_path, monkeypatch):
    import hashlib

    lines = [f"món {i} " + "x" * (i % 50) for i in range(95)]
    monkeypatch.setattr(S, "FILE_LINES", 30)
    monkeypatch.setattr(S, "PIECE_BYTES", 7)
    path = str(tmp_path / "paragraphs")
    S.write_paragraphs(spark.createDataFrame(list(enumerate(lines)), "id long, p string").repartition(5), "p", "id", path)
    want = "".join(x + ("\n\n" if i % 20 == 19 or i == 94 else "\n") for i, x in enumerate(lines))
    assert S.read_digest(spark, path).first()[:] == (4, hashlib.md5(want.encode()).hexdigest())
    assert spark.read.text(path).where("value = ''").count() == 5
