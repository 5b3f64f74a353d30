from pyspark.sql import functions as F

from graphloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_sentences_keep_decimals_and_units(spark):
    assert one(spark, "Dùng 0.8 g/kg mỗi ngày. Thêm 5 g. muối vào nước! Ngắn. Một câu đủ dài ở đây?", T.sentences) == ["Dùng 0.8 g/kg mỗi ngày.", "Thêm 5 g. muối vào nước!", "Một câu đủ dài ở đây?"]


def test_short_pieces_go_and_last_chunk_is_short(spark):
    assert one(spark, "abc. def.", T.sentences) == []
    got = spark.range(1).select(T.chunked(F.array(*map(F.lit, "abcd")), 3).alias("c"), T.chunked(F.array().cast("array<string>"), 3).alias("e")).first()
    assert got["c"] == ["a b c", "d"] and got["e"] == []


def test_decimals(spark):
    rows = spark.createDataFrame([("8,6",), (" 3.5 ",), ("",), ("n/a",), (None,)], "x string")
    got = rows.select(T.decimal(F.col("x")).alias("a"), T.decimal(F.col("x"), 0.0).alias("b")).collect()
    assert [r["a"] for r in got] == [8.6, 3.5, None, None, None] and [r["b"] for r in got] == [8.6, 3.5, 0.0, 0.0, 0.0]


def test_literals_nested_flat_empty_and_odd(spark):
    assert one(spark, "[['a', 'b', \"it's\"], ['x', 'y']]", T.triple_literals) == [["a", "b", "it's"]]
    assert one(spark, "['a', 'b', 'c']", T.triple_literals) == [["a", "b", "c"]]
    assert one(spark, "[]", T.triple_literals) == [] and one(spark, "no list", T.triple_literals) == []
    assert one(spark, "['a', 'b', 'c']", T.clean_triple_literals) == []
    assert one(spark, "[[' a ', 'b', 'c'], ['', 'b', 'c']]", T.clean_triple_literals) == [["a", "b", "c"]]


def test_model_answers(spark):
    assert one(spark, "ok [['a','b','c'], ['_','b','c'], ['a','b']]", T.answer_triples) == [["a", "b", "c"]]
    assert one(spark, "no list", T.answer_entities) == []
    assert [tuple(r) for r in one(spark, "a: one\nAnswer: x\nb: two: three\na: last", T.definition_rows)] == [("b", "two: three"), ("a", "last")]
    assert one(spark, "- chứa: bullet kept", T.definition_rows)[0]["name"] == "- chứa"
    assert one(spark, 'x ["p",\n"q"] ["r"]', T.first_json_array) == ["p", "q"]


def test_letters_out_of_range_choose_nothing(spark):
    options = F.array(F.lit("p"), F.lit("q"))
    for answer, want in (("A", "p"), ("B. q", "q"), ("C", None), ("@", None), ("", None), (None, None)):
        assert one(spark, answer, lambda c: T.chosen(c, options)) == want


def test_forms(spark):
    assert one(spark, "birthPlace_of  Town", T.evaluation_form) == "birth place of town"
    assert one(spark, "Rome (Italy)", T.without_parenthesis) == "Rome"
    assert one(spark, "Calories (kcal)", T.unit) == "kcal"
    assert one(spark, "Đoạn đã xử lý:  kết quả ", T.without_prefix) == "kết quả"
    assert one(spark, " Katsumi et al\n\nNội dung\n2/4\n[1] ref\nHết", T.clean_lines) == "Nội dung Hết"
