"""Queries over sources and sinks: each writes files to the shared folder and returns what reading them gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import advice, extraction, foods, graph
from graphloom.operators.cleaning import numbered
from graphloom.operators.models import Prompts, StubClient
from graphloom.plans import kg
from graphloom.plans.kg import EDGES_SQL, TRIPLES_SQL, table
from graphloom.plans.registry import registry
from graphloom.plans.text_queries import _FOOD_CELLS, _PARAGRAPHS, _food_cells
from graphloom.sources import files
from graphloom.sources.work import fresh_path
from graphloom.sources.xlsx import write_xlsx

QUERIES, ORACLE_SQL, query = registry()


def _benchmark(spark, d):
    return table(spark, d, "benchmark").select("item_id", "text")


@query(r"""WITH l AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents)) SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS line_no, text FROM l""")
def read_lines(spark, d):
    # all documents' lines through several files and back
    path = fresh_path(spark, "lines")
    files.write_lines(table(spark, d, "documents"), "text", ["doc_id"], path, 6)
    lines = files.read_lines(spark, path)
    return numbered(lines, ["file", "line_no"], "at").select(F.col("at").alias("line_no"), "text")


@query(r"""SELECT 1::BIGINT AS files, md5(string_agg(text, chr(10) ORDER BY item_id) || chr(10)) AS digest FROM benchmark""")
def whole_file(spark, d):
    path = fresh_path(spark, "prose")
    files.write_prose(_benchmark(spark, d).select(F.col("item_id").alias("doc"), "text"), path)
    return files.read_digest(spark, path)


_CELLS_SQL = "cells AS (SELECT p_partkey AS id, " + ", ".join(f'{x} AS "{h}"' for h, x in _FOOD_CELLS.items()) + " FROM part)"


def _food_file(spark, d):
    path = fresh_path(spark, "food")
    _food_cells(spark, d).coalesce(1).sortWithinPartitions("id").drop("id").write.option("header", True).option("escape", '"').csv(path)
    return path


@query(f"""WITH {_CELLS_SQL}, n AS (SELECT id, "TÊN THỨC ĂN" AS name, nullif("Loại", '') AS food_group, try_cast("Calories (kcal)" AS DOUBLE) AS calories, try_cast(replace("Fat (g)", ',', '.') AS DOUBLE) AS fat, try_cast(replace("Natri (mg)", ',', '.') AS DOUBLE) AS sodium, try_cast("Chất xơ (g)" AS DOUBLE) AS fiber, try_cast("Carbonhydrates (g)" AS DOUBLE) AS carbs FROM cells)
SELECT lower(name) AS key, name, food_group, calories, fat, sodium, fiber, carbs FROM n QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY id DESC) = 1""")
def food_table(spark, d):
    return files.read_food(spark, _food_file(spark, d)).select("key", "name", "food_group", "calories", "fat", "sodium", "fiber", "carbs")


@query(f"""WITH {_CELLS_SQL}, r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS row, * FROM cells)
{' UNION ALL '.join(f'''SELECT row, {i} AS col, '{h}' AS heading, nullif("{h}", '') AS value FROM r''' for i, h in enumerate(_FOOD_CELLS))}""")
def food_cells(spark, d):
    return files.read_cells(spark, _food_file(spark, d))


def _food_workbooks(spark, d):
    """The food table as workbooks of at most 300 rows, two of its columns as numbers."""
    path = fresh_path(spark, "food") + ".xlsx"
    cells = _food_cells(spark, d).withColumns({"Calories (kcal)": F.col("`Calories (kcal)`").cast("int"), "Carbonhydrates (g)": F.col("`Carbonhydrates (g)`").cast("double")})
    write_xlsx(cells.repartitionByRange(4, "id").sortWithinPartitions("id").drop("id"), path, rows="300")
    return path


@query(ORACLE_SQL["food_table"])
def xlsx_table(spark, d):
    return files.read_food(spark, _food_workbooks(spark, d)).select("key", "name", "food_group", "calories", "fat", "sodium", "fiber", "carbs")


@query(ORACLE_SQL["food_cells"])
def xlsx_cells(spark, d):
    return files.read_cells(spark, _food_workbooks(spark, d))


@query("""SELECT n_name AS relation, 'in ' || r_name || ', so far' AS definition, (row_number() OVER (ORDER BY n_nationkey))::BIGINT AS ord FROM nation JOIN region ON n_regionkey = r_regionkey""")
def schema_file(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat("n_name", F.lit(",in "), "r_name", F.lit(", so far"))
    rows = n.select(F.col("n_nationkey").alias("at"), line.alias("line")).unionByName(spark.createDataFrame([(-1, "relation,definition")], "at int, line string"))
    path = fresh_path(spark, "schema")
    files.write_lines(rows, "line", ["at"], path)
    return files.read_schema(spark, path)


# the triples of a key are a chunk
_CHUNKED = f"""{TRIPLES_SQL}, ch AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY r, o) - 1 AS pos FROM (SELECT DISTINCT s, r, o FROM kg)), no AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS chunk_no FROM (SELECT DISTINCT s FROM kg))"""


def _chunked(spark, d):
    from pyspark.sql import Window

    t = kg.triples(spark, d).select("s", "r", "o").distinct()
    no = numbered(t.select("s").distinct(), ["s"], "chunk_no")
    return t.withColumn("pos", F.row_number().over(Window.partitionBy("s").orderBy("r", "o")) - 1).join(no, "s")


def _through(rows):
    """rows of several files with their lines numbered through all of them."""
    lines = numbered(rows.select("src", "chunk_no").distinct(), ["src", "chunk_no"], "at")
    return rows.join(lines, ["src", "chunk_no"]).drop("chunk_no").withColumnRenamed("at", "chunk_no")


@query(f"WITH {_CHUNKED} SELECT chunk_no, pos, s, r, o FROM ch JOIN no USING (s)")
def nested_triples(spark, d):
    path = fresh_path(spark, "chunks")
    files.write_chunk_triples(_chunked(spark, d), path, 4)
    return _through(files.read_triples(spark, path, nested_only=True)).select("chunk_no", F.col("pos").cast("bigint").alias("pos"), "s", "r", "o")


@query(f"WITH {TRIPLES_SQL} SELECT row_number() OVER (ORDER BY s, r, o) - 1 AS chunk_no, s, r, o, 0::BIGINT AS nested FROM (SELECT DISTINCT s, r, o FROM kg)")
def flat_triples(spark, d):
    path = fresh_path(spark, "flat")
    files.write_flat_triples(kg.triples(spark, d).distinct(), ["s", "r", "o"], path, 4)
    # a flat list is no list of lists
    nested = files.read_triples(spark, path, nested_only=True).agg(F.count("*").alias("nested"))
    return _through(files.read_triples(spark, path)).select("chunk_no", "s", "r", "o").crossJoin(nested)


@query("SELECT text, 2::BIGINT AS n, 'it' AS first_subject FROM benchmark")
def json_lines(spark, d):
    t = F.array(F.array(F.lit("it"), F.lit("is"), F.lit('a "thing"')), F.array(F.lit("x"), F.lit("y")))
    path = fresh_path(spark, "json")
    _benchmark(spark, d).select(F.col("text").alias("sentence"), t.alias("triples")).write.json(path)
    return files.read_sentences(spark, path).select("text", F.size("triples").cast("bigint").alias("n"), F.get(F.get("triples", F.lit(0)), F.lit(0)).alias("first_subject"))


@query("SELECT item_id::VARCHAR AS item, text || chr(10) || '\"quoted\", and more' AS definitions FROM benchmark")
def csv_file(spark, d):
    path = fresh_path(spark, "csv")
    text = F.concat("text", F.lit('\n"quoted", and more'))
    _benchmark(spark, d).select(F.col("item_id").cast("string").alias("item"), text.alias("definitions")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_definitions(spark, path)


@query("""WITH b AS (SELECT item_id AS n FROM benchmark WHERE item_id % 3 <> 0 AND item_id % 4 < 3) SELECT kind, n::VARCHAR AS entry, CASE kind WHEN 'ref' THEN 'it''s | in | w' || n ELSE CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN 'it''s | in | v' || n ELSE 'it''s | in | v' || n || '; a | b | c' END END AS triples FROM b, (VALUES ('ref'), ('pred')) k(kind)""")
def evaluation_xml(spark, d):
    k = F.col("item_id")
    n = k.cast("string")
    one, more = F.concat(F.lit("[\"it's\", 'in', 'v"), n, F.lit("']")), F.lit(", ['a', 'b', 'c']")
    # every third prediction is no list of triples; those with three triples differ too much from the gold one
    line = F.when(k % 3 == 0, "[['a']]").when(k % 4 == 0, "[]").when(k % 4 == 1, F.concat(F.lit("["), one, F.lit("]"))).when(k % 4 == 2, F.concat(F.lit("["), one, more, F.lit("]"))).otherwise(F.concat(F.lit("["), one, more, more, F.lit("]")))
    b, path = _benchmark(spark, d), fresh_path(spark, "xml")
    gold = b.select(k.alias("line_no"), F.concat(F.lit("[[\"it's\", 'in', 'w"), n, F.lit("']]")).alias("text"))
    files.write_evaluation(b.select(k.alias("line_no"), line.alias("text")), gold, path, 1)
    read = lambda name, kind: files.read_evaluation_xml(spark, f"{path}/{name}", kind).select(F.lit(name).alias("kind"), F.col("entry").cast("string").alias("entry"), F.array_join("triples", "; ").alias("triples"))
    return read("ref", "mtriple").unionByName(read("pred", "gtriple"))


@query(f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS edges, (SELECT count(*) FROM nodes) AS nodes, 0::BIGINT AS after_clearing FROM edges GROUP BY rel_type")
def saved_graph(spark, d):
    path = fresh_path(spark, "graph")
    edges = kg.labelled(kg.triples(spark, d))
    files.save_graph(kg.nodes_of(edges), edges, path)
    # saved again from itself, as an upsert does
    files.save_graph(*files.load_graph(spark, path), path)
    nodes, edges = files.load_graph(spark, path)
    out = edges.groupBy("rel_type").agg(F.count("*").alias("edges")).crossJoin(nodes.agg(F.count("*").alias("nodes"))).collect()
    files.clear_graph(spark, path)
    left = len(spark.read.option("ignoreMissingFiles", True).schema("rel_type string").parquet(path).take(1)) if _exists(spark, path) else 0
    return spark.createDataFrame([(*r, left) for r in out], "rel_type string, edges bigint, nodes bigint, after_clearing bigint")


def _exists(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@query("SELECT item_id, 'extract' || chr(10) || '## examples' || chr(10) || 'one {braced} example' || chr(10) || '## entities' || chr(10) || chr(10) || '## relations' || chr(10) || chr(10) || '## text' || chr(10) || text AS prompt FROM benchmark")
def prompt_files(spark, d):
    path = fresh_path(spark, "prompts")
    for name, text in (("template", Prompts().extract), ("few_shot", "one {braced} example")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\u0003").text(f"{path}/{name}")
    read = lambda name: files.read_prompt(spark, f"{path}/{name}").rstrip("\u0003")
    prompts = Prompts(extract=read("template"), few_shot={"extract": read("few_shot")})
    return _benchmark(spark, d).select("item_id", prompts.fill("extract", input_text=F.col("text"), entities_hint=F.lit(""), relations_hint=F.lit("")).alias("prompt"))


@query(f"""WITH {TRIPLES_SQL}, bad AS (SELECT lower(s) AS ls, lower(o) AS lo, s, o FROM kg WHERE r IN ('has_brand', 'located_in'))
SELECT item, 'calories' AS needed, '{len(graph.METRICS)}' AS metrics, '' AS graph_path, 'stub' AS model FROM (SELECT s AS item FROM bad WHERE contains(lo, 'nation_3') UNION SELECT o FROM bad WHERE contains(ls, 'nation_3'))""")
def settings(spark, d):
    # what the session sets decides which relations a lookup avoids; the rest holds as it is by default
    spark.conf.set("spark.graphloom.avoid", "HAS_BRAND|located_in")
    try:
        found = advice.Settings.of(spark)
    finally:
        spark.conf.unset("spark.graphloom.avoid")
    items = graph.avoid_list(kg.triples(spark, d), "NATION_3", found.listed("avoid"))
    return items.select("item", F.lit(found.needed).alias("needed"), F.lit(str(len(found.listed("metrics")))).alias("metrics"), F.lit(found.graph_path).alias("graph_path"), F.lit(found.model).alias("model"))


@query(f"""WITH {_PARAGRAPHS}, p AS (SELECT *, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS total FROM said)
SELECT md5(string_agg(paragraph || CASE WHEN n % 20 = 0 OR n = total THEN chr(10) ELSE '' END, chr(10) ORDER BY n) || chr(10)) AS digest, ceil(max(total) / 20.0)::BIGINT AS groups FROM p""")
def paragraph_file(spark, d):
    path = fresh_path(spark, "paragraphs")
    rows = _food_cells(spark, d)
    files.write_paragraphs(rows.select("id", foods.paragraph(rows).alias("paragraph")), "paragraph", "id", path)
    # a blank line ends each group
    groups = spark.read.text(path).where("value = ''").agg(F.count("*").alias("groups"))
    return files.read_digest(spark, path).select("digest").crossJoin(groups)


@query("SELECT item_id AS chunk, text AS input_text, 'refused' AS again FROM benchmark")
def stage_files(spark, d):
    path = fresh_path(spark, "stages")
    chunks = _benchmark(spark, d).withColumnRenamed("item_id", "chunk")
    schema = spark.createDataFrame([("the", "what the means", 0)], "relation string, definition string, ord bigint")
    extraction.run_stages(chunks, schema, StubClient(), write=lambda n, records, triples: files.write_stages(records, path, n))
    try:
        files.write_stages(chunks, path, 0)
        again = "written"
    except Exception as e:  # the path exists
        again = "refused" if "exists" in str(e).lower() else str(e)
    return spark.read.json(f"{path}/iter=0").select("chunk", "input_text", F.lit(again).alias("again"))


@query("SELECT 2 * count(*) AS rows, count(*) AS items, count(*) FILTER (contains(text, chr(10))) * 2 AS with_lines FROM benchmark")
def appended_csv(spark, d):
    path = fresh_path(spark, "appended")
    rows = _benchmark(spark, d).withColumn("item_id", F.col("item_id").cast("string"))
    for _ in range(2):
        files.append_csv(rows, path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return back.agg(F.count("*").alias("rows"), F.count_distinct("item_id").alias("items"), F.sum(F.col("text").contains("\n").cast("bigint")).alias("with_lines"))


@query("SELECT count(*) AS rows, count(*) AS different, 3::BIGINT AS parts FROM documents")
def split_files(spark, d):
    path = fresh_path(spark, "split")
    files.write_split(table(spark, d, "documents").select("doc_id"), path)
    parts = [spark.read.parquet(f"{path}/{n}").withColumn("part", F.lit(n)) for n in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("different"), F.count_distinct("part").alias("parts"))


# two parts are loaded one after the other: the first knows the parts as foods, the second knows none
_REBUILT = f"""{TRIPLES_SQL}, p1 AS (SELECT DISTINCT s, r, o FROM kg WHERE r IN ('has_brand', 'has_type')), p2 AS (SELECT DISTINCT s, r, o FROM kg WHERE r IN ('located_in', 'part_of')),
f AS (SELECT lower(p_name) AS k FROM part),
n1 AS (SELECT DISTINCT name, CASE WHEN lower(name) IN (SELECT k FROM f) THEN 'Food' ELSE 'Entity' END AS label FROM (SELECT s AS name FROM p1 UNION SELECT o FROM p1)),
n2 AS (SELECT DISTINCT name, 'Entity' AS label FROM (SELECT s AS name FROM p2 UNION SELECT o FROM p2)),
e AS (SELECT a.label AS s_label, s, upper(r) AS rel_type, r, b.label AS o_label, o FROM p1 JOIN n1 a ON a.name = s JOIN n1 b ON b.name = o UNION SELECT 'Entity', s, upper(r), r, 'Entity', o FROM p2)"""


@query(f"WITH {_REBUILT} SELECT 'node' AS kind, label AS name, count(*) AS n FROM (SELECT * FROM n1 UNION SELECT * FROM n2) GROUP BY label UNION ALL SELECT 'edge', s_label || ' ' || rel_type || ' ' || o_label, count(*) FROM e GROUP BY ALL")
def rebuilt_graph(spark, d):
    return _rebuilt(spark, d, _food_file(spark, d))


@query(ORACLE_SQL["rebuilt_graph"])
def xlsx_graph(spark, d):
    return _rebuilt(spark, d, _food_workbooks(spark, d))


def _rebuilt(spark, d, food):
    path, t = fresh_path(spark, "rebuild"), kg.triples(spark, d).distinct()
    for name, relations in (("food", ("has_brand", "has_type")), ("place", ("located_in", "part_of"))):
        files.write_flat_triples(t.where(F.col("r").isin(*relations)), ["s", "r", "o"], f"{path}/{name}")
    files.rebuild_graph(spark, [(f"{path}/food", food), (f"{path}/place", None)], f"{path}/graph")
    nodes, edges = files.load_graph(spark, f"{path}/graph")
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.concat_ws(" ", "s_label", "rel_type", "o_label").alias("name")).agg(F.count("*").alias("n")))
