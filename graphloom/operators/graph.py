"""The property graph: node and edge tables, upserts, one-hop lookups, coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators.cleaning import first_of_each, mapped
from graphloom.sources.work import saved

# Names of diseases and nutrients, node labels, relations to be avoided, edge types, disease aliases.
DISEASES = ["tiểu đường", "đái tháo đường", "tiểu đường tuýp 2", "cao huyết áp", "tăng huyết áp", "gút", "gout", "béo phì", "thừa cân", "suy thận", "suy thận mãn tính", "bệnh tim mạch", "tim mạch", "xơ vữa động mạch", "gan nhiễm mỡ", "viêm gan", "trào ngược dạ dày", "trào ngược dạ dày thực quản", "táo bón", "thiếu máu", "thiếu máu thiếu sắt", "loãng xương", "còi xương", "ung thư", "scorbut"]
NUTRIENTS = ["protein", "chất béo", "carbohydrate", "chất xơ", "năng lượng", "calories", "calo", "canxi", "calcium", "phospho", "sắt", "natri", "kali", "magie", "kẽm", "selenium", "đồng", "mangan", "vitamin a", "vitamin b1", "vitamin b2", "vitamin b3", "vitamin b6", "vitamin b12", "vitamin c", "vitamin d", "vitamin e", "vitamin k", "beta caroten", "cholesterol", "omega-3", "omega-6", "purin", "axit uric", "axit folic", "folate", "chất béo bão hòa", "chất béo không bão hòa", "đường", "đường tinh luyện", "tinh bột", "muối", "nước"]
LABELS = {"Food": "Food", "Disease": "Disease", "Nutrient": "Nutrient", "Other": "Entity"}
AVOID = ["làm trầm trọng", "chống chỉ định với", "cần hạn chế ở", "là yếu tố nguy cơ của"]
EDGE_TYPES = {
    "chứa": "CHUA", "giàu": "GIAU", "thuộc nhóm": "THUOC_NHOM", "làm trầm trọng": "LAM_TRAM_TRONG", "được khuyến nghị cho": "DUOC_KHUYEN_NGHI_CHO", "cần hạn chế ở": "CAN_HAN_CHE_O", "phòng ngừa": "PHONG_NGUA", "nhiều": "NHIEU", "ít": "IT", "hỗ trợ": "HO_TRO", "ảnh hưởng đường huyết": "ANH_HUONG_DUONG_HUYET", "chống chỉ định với": "CHONG_CHI_DINH_VOI", "là nguồn": "GIAU", "thiếu hụt gây ra": "THIEU_HUT_GAY_RA", "tương tác với": "TUONG_TAC_VOI", "là yếu tố nguy cơ của": "LA_YEUTOCUA",
}
DISEASE_ALIASES = {"béo phì (obesity)": "béo phì", "tiểu đường type 2": "tiểu đường", "cao huyết áp": "tăng huyết áp", "suy thận": "bệnh thận"}
METRICS = ["calories", "carbs", "protein", "fat", "iron", "zinc", "fiber", "cholesterol", "calcium", "phosphorus", "potassium", "sodium", "vitamin_a", "vitamin_b1", "vitamin_c", "beta_carotene"]


def entity_class(name: Column, is_food: Column, diseases: list[str] = DISEASES, nutrients: list[str] = NUTRIENTS) -> Column:
    x = F.lower(strip(name))
    return F.when(is_food, "Food").when(x.isin(diseases), "Disease").when(x.isin(nutrients), "Nutrient").otherwise("Other")


def node_label(kind: Column) -> Column:
    return mapped(kind, LABELS, F.lit("Entity"))


def edge_type(relation: Column, types: dict[str, str] = EDGE_TYPES) -> Column:
    plain = F.upper(F.replace(strip(F.regexp_replace(relation, r"[^a-zA-Z0-9\s_]", "")), F.lit(" "), F.lit("_")))
    return mapped(F.lower(strip(relation)), types, F.coalesce(F.nullif(plain, F.lit("")), F.lit("RELATED_TO")))


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("name")).distinct()


CLASSES = ["Food", "Disease", "Nutrient", "Other"]


def class_counts(kinds: DataFrame) -> DataFrame:
    """(kind, n) of rows (kind): all four classes, those without rows too."""
    every = kinds.sparkSession.createDataFrame([(c,) for c in CLASSES], "kind string")
    return F.broadcast(every).join(kinds.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0, ["n"])


def upsert_nodes(nodes: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("label", "name"), order: str | None = None) -> DataFrame:
    """nodes with new rows merged in by key: a new value that is not null wins; columns of either side are kept.

    Repeated keys in new are one node: of each column the last value by order that is not null, or, without an order, the
    largest.
    """
    values = [c for c in new.columns if c not in keys and c != order]
    last = lambda c: F.max(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    new = new.groupBy(*keys).agg(*[last(c).alias(c) for c in values]) if values else new.select(*keys).distinct()
    a, b = nodes.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    columns = [*nodes.columns, *[c for c in new.columns if c not in nodes.columns]]
    pick = lambda c: F.coalesce(*[F.col(f"{t}.{c}") for t, d in (("b", new), ("a", nodes)) if c in d.columns]).alias(c)
    return a.join(b, on, "full").select(*[pick(c) for c in columns])


def with_properties(names: DataFrame, food: DataFrame) -> DataFrame:
    """names (name) with food's properties by lower-cased name, and is_food."""
    keyed = food.select(F.lower(strip(F.col("name"))).alias("_key"), *[c for c in food.columns if c not in ("name", "key")])
    keyed = first_of_each(keyed, [F.col("_key")], keyed.columns).withColumn("is_food", F.lit(True))
    return names.withColumn("_key", F.lower(strip(F.col("name")))).join(keyed, "_key", "left").drop("_key").fillna(False, ["is_food"])


EDGE_KEY = ["s_label", "s_name", "rel_type", "relation", "o_label", "o_name"]


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges of both tables; new ones only between nodes that exist."""
    known = nodes.select("label", "name").distinct()
    for side in ("s", "o"):
        new = new.join(known.select(F.col("label").alias(f"{side}_label"), F.col("name").alias(f"{side}_name")), [f"{side}_label", f"{side}_name"], "left_semi")
    return edges.select(*EDGE_KEY).unionByName(new.select(*EDGE_KEY)).distinct()


def violations(nodes: DataFrame, keys: tuple[str, ...] = ("label", "name")) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def avoid_list(triples: DataFrame, name: str, relations: list[str] = AVOID) -> DataFrame:
    """(item): what stands, by an avoid relation, on the other side of an endpoint that contains name."""
    t = triples.where(F.lower("r").isin([r.lower() for r in relations]))
    hit = lambda c: F.lower(F.col(c)).contains(name.lower())
    return t.where(hit("o")).select(F.col("s").alias("item")).union(t.where(hit("s")).select(F.col("o"))).distinct()


def node_relations(triples: DataFrame, name: str) -> DataFrame:
    """(subject, relation, object) of all edges at the node, a self-loop once."""
    cols = [F.col("s").alias("subject"), F.col("r").alias("relation"), F.col("o").alias("object")]
    return triples.where(F.col("s") == name).select(*cols).union(triples.where(F.col("o") == name).select(*cols)).distinct()


def food_lookup(nodes: DataFrame, triples: DataFrame, name: str, needed: str, columns: list[str]) -> DataFrame:
    """The first node (shortest name, then by name) that contains name and has the needed property, with its columns and
    connections: its outgoing edges as sorted (relation, target)."""
    one = nodes.where(F.lower("name").contains(name.lower()) & F.col(needed).isNotNull()).orderBy(F.length("name"), "name").limit(1)
    out = one.join(triples.select(F.col("s").alias("name"), F.struct(F.col("r").alias("relation"), F.col("o").alias("target")).alias("c")).distinct(), "name", "left")
    return out.groupBy("name", *columns).agg(F.array_sort(F.collect_list("c")).alias("connections"))


def graph_of(triples: DataFrame, food: DataFrame | None = None, diseases: list[str] = DISEASES, nutrients: list[str] = NUTRIENTS, types: dict[str, str] = EDGE_TYPES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples (s, r, o): entities classified, foods with their properties, relations typed."""
    named = entities(triples)
    if food is None:
        named = named.withColumn("is_food", F.lit(False))
    else:
        named = with_properties(named, food)
    kind = entity_class(F.col("name"), F.col("is_food"), diseases, nutrients)
    nodes = named.select(node_label(kind).alias("label"), "name", kind.alias("type"), *[c for c in named.columns if c not in ("name", "is_food")])
    label = nodes.select("name", "label")
    edges = triples.join(label.withColumnsRenamed({"name": "s", "label": "s_label"}), "s").join(label.withColumnsRenamed({"name": "o", "label": "o_label"}), "o")
    return nodes, edges.select("s_label", F.col("s").alias("s_name"), edge_type(F.col("r"), types).alias("rel_type"), F.col("r").alias("relation"), "o_label", F.col("o").alias("o_name")).distinct()


def import_food(nodes: DataFrame, edges: DataFrame, food: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a Food node a food (name, food_group, properties), a Category node a group, and BELONGS_TO
    edges between them; missing numbers are 0."""
    numbers = [c for c, t in food.dtypes if t in ("double", "float", "int", "bigint") and c != order]
    food = food.where("name IS NOT NULL").fillna(0, numbers)
    rows = food.select(F.lit("Food").alias("label"), "name", F.lit("Food").alias("type"), *numbers, *([order] if order else []))
    groups = food.where("food_group IS NOT NULL").select(F.lit("Category").alias("label"), F.col("food_group").alias("name"), F.lit("Category").alias("type")).distinct()
    nodes = upsert_nodes(upsert_nodes(nodes, rows, order=order), groups)
    belongs = food.where("food_group IS NOT NULL").select(F.lit("Food").alias("s_label"), F.col("name").alias("s_name"), F.lit("BELONGS_TO").alias("rel_type"), F.lit(None).cast("string").alias("relation"), F.lit("Category").alias("o_label"), F.col("food_group").alias("o_name"))
    return nodes, upsert_edges(edges, belongs, nodes)


def rebuild(parts: list[tuple[DataFrame, DataFrame | None]], types: dict[str, str] = EDGE_TYPES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an empty graph into which (triples, food table or None) are upserted one after the other."""
    nodes = edges = None
    for triples, food in parts:
        n, e = graph_of(triples, food, types=types)
        nodes = saved(n if nodes is None else upsert_nodes(nodes, n))
        edges = saved(e if edges is None else upsert_edges(edges, e, nodes))
    return nodes, edges


def coverage(nodes: DataFrame, expected: list[str], kind: str) -> DataFrame:
    return nodes.where(F.col("name").isin(expected)).groupBy(kind).agg(F.count("*").alias("n"))


def recall(gold: DataFrame, triples: DataFrame) -> DataFrame:
    """(found, total, recall) of gold triples (s, r, o) in the graph, 0 of none is 0."""
    known = triples.select("s", "r", "o").distinct().withColumn("hit", F.lit(1))
    counted = gold.join(known, ["s", "r", "o"], "left").agg(F.count("hit").alias("found"), F.count("*").alias("total"))
    return counted.withColumn("recall", F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(F.lit(0.0)))


def missing(gold: DataFrame, triples: DataFrame) -> DataFrame:
    return gold.join(triples, ["s", "r", "o"], "left_anti")
