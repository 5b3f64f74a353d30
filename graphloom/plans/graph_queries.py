"""Queries over the graph: lookups, upserts, coverage, cleaning, merging, advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import advice, cleaning, graph
from graphloom.operators.models import StubClient
from graphloom.plans import kg
from graphloom.plans.kg import EDGES_SQL, TRIPLES_SQL, table
from graphloom.plans.registry import registry
from graphloom.sources import files
from graphloom.sources.commits import KeyedTable
from graphloom.sources.work import fresh_path, saved

QUERIES, ORACLE_SQL, query = registry()
AVOID = ["has_brand", "has_type"]


def _edges(spark, d):
    return kg.labelled(kg.triples(spark, d))


def _saved(spark, d):
    """(nodes, edges) of the graph as saved: lookups read the files of the types and columns they need. It is saved anew for
    each query, so that no query answers from an older graph and its time holds the whole work."""
    path = fresh_path(spark, "graph")
    edges = saved(_edges(spark, d))
    sizes = table(spark, d, "part").groupBy(F.lit("Part").alias("label"), F.col("p_name").alias("name")).agg(F.min("p_size").cast("bigint").alias("size"), F.max("p_retailprice").alias("price"))
    files.save_graph(kg.nodes_of(edges).join(sizes, ["label", "name"], "left"), edges, path)
    return files.load_graph(spark, path)


def _typed(edges, relations):
    """Triples of the edges of these relations; only their files are read."""
    return files.triples_of(edges.where(F.col("rel_type").isin([r.upper() for r in relations])))


@query(f"""WITH {TRIPLES_SQL} SELECT s AS item FROM kg WHERE r IN ('has_brand', 'has_type') AND contains(lower(o), 'brand#1')
UNION SELECT o FROM kg WHERE r IN ('has_brand', 'has_type') AND contains(lower(s), 'brand#1')""")
def avoid_list(spark, d):
    return graph.avoid_list(_typed(_saved(spark, d)[1], AVOID), "Brand#1", AVOID)


@query(f"""WITH {TRIPLES_SQL} SELECT s AS subject, r AS relation, o AS object FROM kg WHERE s = 'NATION_3'
UNION SELECT s, r, o FROM kg WHERE o = 'NATION_3'""")
def node_relations(spark, d):
    return graph.node_relations(files.triples_of(_saved(spark, d)[1]), "NATION_3")


@query(f"""WITH {TRIPLES_SQL}, n AS (SELECT p_name AS name, min(p_size)::BIGINT AS size, max(p_retailprice) AS price FROM part GROUP BY p_name),
one AS (SELECT * FROM n WHERE contains(lower(name), 'ring') AND size IS NOT NULL ORDER BY length(name), name LIMIT 1)
SELECT name, size, price, coalesce(string_agg(r || '>' || o, '|' ORDER BY r, o), '') AS connections
FROM one LEFT JOIN (SELECT DISTINCT s, r, o FROM kg) k ON k.s = one.name GROUP BY name, size, price""")
def food_lookup(spark, d):
    nodes, edges = _saved(spark, d)
    found = graph.food_lookup(nodes.where("label = 'Part'"), files.triples_of(edges), "Ring", "size", ["size", "price"])
    said = F.transform("connections", lambda c: F.concat(c["relation"], F.lit(">"), c["target"]))
    return found.withColumn("connections", F.array_join(said, "|"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT name FROM nodes WHERE name IS NOT NULL")
def all_nodes(spark, d):
    return kg.nodes_of(_edges(spark, d)).where("name IS NOT NULL").select("name").distinct()


@query("SELECT s_name AS name, s_suppkey AS key, s_nationkey::BIGINT AS nation, s_acctbal AS balance FROM supplier WHERE s_name = 'Supplier#000000007'")
def node_props(spark, d):
    return table(spark, d, "supplier").where("s_name = 'Supplier#000000007'").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_acctbal").alias("balance"))


@query(f"WITH {EDGES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def kg_counts(spark, d):
    e = _edges(spark, d)
    return kg.nodes_of(e).agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges")))


@query(f"WITH {EDGES_SQL} SELECT o_name AS target, rel_type, count(*) AS n FROM edges WHERE o_name IN ('ASIA', 'AFRICA', 'BUILDING', 'NATION_1') GROUP BY ALL ORDER BY n DESC, target")
def coverage_by_target(spark, d):
    return _edges(spark, d).where(F.col("o_name").isin("ASIA", "AFRICA", "BUILDING", "NATION_1")).groupBy(F.col("o_name").alias("target"), "rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target")


@query(f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS n FROM edges GROUP BY ALL ORDER BY n DESC, rel_type")
def coverage_by_type(spark, d):
    return _edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_type")


@query(f"WITH {TRIPLES_SQL} SELECT s AS name, count(DISTINCT o) AS n FROM kg WHERE r = 'ordered_with' GROUP BY s HAVING count(DISTINCT o) = 5")
def full_coverage_nodes(spark, d):
    return kg.triples(spark, d).where("r = 'ordered_with'").groupBy(F.col("s").alias("name")).agg(F.count_distinct("o").alias("n")).where("n = 5")


_GOLD = "gold AS (SELECT DISTINCT s, r, CASE WHEN contains(s, '7') THEN o || '?' ELSE o END AS o FROM kg WHERE r IN ('located_in', 'part_of', 'in_segment'))"


def _gold(t):
    g = t.where(F.col("r").isin("located_in", "part_of", "in_segment"))
    return g.select("s", "r", F.when(F.col("s").contains("7"), F.concat("o", F.lit("?"))).otherwise(F.col("o")).alias("o")).distinct()


@query(f"""WITH {TRIPLES_SQL}, {_GOLD} SELECT count(*) FILTER (EXISTS (SELECT 1 FROM kg k WHERE k.s = g.s AND k.r = g.r AND k.o = g.o)) AS found, count(*) AS total,
count(*) FILTER (EXISTS (SELECT 1 FROM kg k WHERE k.s = g.s AND k.r = g.r AND k.o = g.o)) / count(*) AS recall FROM gold g""")
def kb_recall(spark, d):
    t = kg.triples(spark, d)
    return graph.recall(_gold(t), t)


@query(f"WITH {TRIPLES_SQL}, {_GOLD} SELECT s, r, o FROM gold g WHERE NOT EXISTS (SELECT 1 FROM kg k WHERE k.s = g.s AND k.r = g.r AND k.o = g.o)")
def missing_gold(spark, d):
    t = kg.triples(spark, d)
    return graph.missing(_gold(t), t)


@query(f"""WITH {TRIPLES_SQL}, e AS (SELECT s AS name FROM kg UNION SELECT o FROM kg),
c AS (SELECT name, CASE WHEN name IN (SELECT p_name FROM part) THEN 'Food' WHEN lower(trim(name)) IN ('asia', 'africa', 'europe') THEN 'Disease' WHEN lower(trim(name)) IN ('no such nutrient') THEN 'Nutrient' ELSE 'Other' END AS kind FROM e)
SELECT k.kind, CASE k.kind WHEN 'Other' THEN 'Entity' ELSE k.kind END AS label, count(c.name) AS n FROM (VALUES ('Food'), ('Disease'), ('Nutrient'), ('Other')) k(kind) LEFT JOIN c ON c.kind = k.kind GROUP BY ALL""")
def entity_classes(spark, d):
    foods = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("food", F.lit(True))
    e = graph.entities(kg.triples(spark, d)).join(foods, "name", "left")
    kind = graph.entity_class(F.col("name"), F.coalesce("food", F.lit(False)), ["asia", "africa", "europe"], ["no such nutrient"])
    return graph.class_counts(e.select(kind.alias("kind"))).select("kind", graph.node_label(F.col("kind")).alias("label"), "n")


@query(f"""WITH {TRIPLES_SQL} SELECT DISTINCT r AS relation, CASE lower(r) WHEN 'là nguồn' THEN 'GIAU' WHEN 'part_of' THEN 'THUOC_NHOM' ELSE coalesce(nullif(upper(replace(trim(regexp_replace(r, '[^a-zA-Z0-9\\s_]', '', 'g')), ' ', '_')), ''), 'RELATED_TO') END AS rel_type
FROM (SELECT r FROM kg UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT 'là nguồn' UNION ALL SELECT 'đ')""")
def edge_types(spark, d):
    more = table(spark, d, "orders").select(F.col("o_orderpriority").alias("r")).unionByName(spark.createDataFrame([("là nguồn",), ("đ",)], "r string"))
    types = graph.EDGE_TYPES | {"part_of": "THUOC_NHOM"}
    return kg.triples(spark, d).select("r").unionByName(more).distinct().select(F.col("r").alias("relation"), graph.edge_type(F.col("r"), types).alias("rel_type"))


@query("""WITH old AS (SELECT 'Part' AS label, p_name AS name, min(p_size)::BIGINT AS size, NULL::DOUBLE AS price FROM part GROUP BY p_name),
new AS (SELECT 'Part' AS label, name, arg_max(p_size, p_partkey) FILTER (p_size > 25)::BIGINT AS size, arg_max(p_retailprice, p_partkey) AS price FROM (SELECT *, p_name AS name FROM part UNION ALL SELECT *, p_type || ' ' || p_name FROM part) GROUP BY name)
SELECT coalesce(n.label, o.label) AS label, coalesce(n.name, o.name) AS name, coalesce(n.size, o.size) AS size, coalesce(n.price, o.price) AS price FROM old o FULL JOIN new n ON o.label = n.label AND o.name = n.name""")
def node_upsert(spark, d):
    p = table(spark, d, "part")
    old = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").cast("bigint").alias("size")).select(F.lit("Part").alias("label"), "name", "size", F.lit(None).cast("double").alias("price"))
    # every part twice, by name and by type and name, names repeated; small sizes are missing
    names = F.explode(F.array("p_name", F.concat_ws(" ", "p_type", "p_name"))).alias("name")
    new = p.select(F.lit("Part").alias("label"), names, F.when(F.col("p_size") > 25, F.col("p_size").cast("bigint")).alias("size"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("at"))
    return graph.upsert_nodes(old, new, order="at")


@query(f"""WITH {EDGES_SQL} SELECT s_label, s_name, rel_type, relation, o_label, o_name FROM edges WHERE s_name NOT LIKE '%9' AND o_name NOT LIKE '%9'
UNION SELECT s_label, s_name, rel_type, relation, o_label, o_name FROM edges WHERE relation IN ('located_in', 'part_of')""")
def edge_upsert(spark, d):
    # what is there stays, danglers too; new edges need both nodes
    e = _edges(spark, d)
    nodes = kg.nodes_of(e).where("name NOT LIKE '%9'")
    return graph.upsert_edges(e.where("relation IN ('located_in', 'part_of')"), e.unionByName(e), nodes)


@query(f"""WITH {EDGES_SQL} SELECT label, name, CASE WHEN name LIKE '%0' THEN 'changed' ELSE lower(label) END AS note FROM nodes UNION ALL SELECT 'Part', name || ' (new)', 'new' FROM nodes WHERE label = 'Part'""")
def bucket_upsert(spark, d):
    # a graph's nodes in buckets; some are changed and some are new, and only their buckets are written
    nodes = kg.nodes_of(_edges(spark, d))
    store = KeyedTable.create(nodes.withColumn("note", F.lower("label")), fresh_path(spark, "store"), ["label", "name"], 32)
    store = store.upsert(nodes.where("name LIKE '%0'").withColumn("note", F.lit("changed")))
    return store.upsert(nodes.where("label = 'Part'").select("label", F.concat("name", F.lit(" (new)")).alias("name"), F.lit("new").alias("note"))).read()


def _foods(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("name"), F.col("p_type").alias("food_group"), F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("size"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("at"))


def _imported(spark, d):
    e = _edges(spark, d).where("relation = 'has_brand'")
    return graph.import_food(kg.nodes_of(e), e, _foods(spark, d), order="at")


@query(f"""WITH {EDGES_SQL} SELECT s_label, s_name, rel_type, relation, o_label, o_name FROM edges WHERE relation = 'has_brand'
UNION SELECT 'Food', p_name, 'BELONGS_TO', NULL, 'Category', p_type FROM part""")
def category_upsert(spark, d):
    return _imported(spark, d)[1]


@query(f"""WITH {EDGES_SQL} SELECT s_label AS label, s_name AS name, NULL AS type, NULL::DOUBLE AS size, NULL::DOUBLE AS price FROM edges WHERE relation = 'has_brand' UNION SELECT o_label, o_name, NULL, NULL, NULL FROM edges WHERE relation = 'has_brand'
UNION SELECT 'Food', p_name, 'Food', arg_max(CASE WHEN p_size > 5 THEN p_size ELSE 0 END, p_partkey), arg_max(p_retailprice, p_partkey) FROM part GROUP BY p_name UNION SELECT 'Category', p_type, 'Category', NULL, NULL FROM part""")
def food_nodes(spark, d):
    return _imported(spark, d)[0].select("label", "name", "type", "size", "price")


@query(f"""WITH {TRIPLES_SQL}, f AS (SELECT lower(p_name) AS k, min(p_size)::DOUBLE AS size FROM part GROUP BY 1)
SELECT n.name, f.size, f.k IS NOT NULL AS is_food FROM (SELECT s AS name FROM kg UNION SELECT o FROM kg) n LEFT JOIN f ON f.k = lower(n.name)""")
def entity_properties(spark, d):
    food = table(spark, d, "part").groupBy(F.upper("p_name").alias("name")).agg(F.min("p_size").cast("double").alias("size"))
    return graph.with_properties(graph.entities(kg.triples(spark, d)), food)


@query(f"""WITH {EDGES_SQL} SELECT (SELECT count(*) FROM (SELECT label, name FROM nodes GROUP BY ALL HAVING count(*) > 1)) AS node_violations,
(SELECT count(*) FROM (SELECT s_label, s_name, rel_type, relation, o_label, o_name FROM edges GROUP BY ALL HAVING count(*) > 1)) AS edge_violations,
(SELECT count(*) FROM (SELECT name FROM nodes GROUP BY ALL HAVING count(*) > 1)) AS names_with_two_labels""")
def rebuild_checks(spark, d):
    e = _edges(spark, d)
    n = kg.nodes_of(e)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(graph.violations(n), "node_violations").crossJoin(count(graph.violations(e, tuple(graph.EDGE_KEY)), "edge_violations")).crossJoin(count(graph.violations(n, ("name",)), "names_with_two_labels"))


# rule cleaning: spellings, synonyms, abstract subjects, generic objects and inverted pairs made from the part table
_RAW = """raw AS (SELECT p_partkey AS ord,
  CASE WHEN p_partkey % 7 = 0 THEN '  ' || upper(p_name) WHEN p_partkey % 11 = 0 THEN 'CKD' WHEN p_partkey % 13 = 0 THEN 'Hướng dẫn ' || p_name ELSE p_name END AS s,
  CASE WHEN p_partkey % 5 = 0 THEN 'Giàu' ELSE 'has_type' END AS r,
  CASE WHEN p_partkey % 17 = 0 THEN 'cơ thể' WHEN p_partkey % 19 = 0 THEN '' ELSE p_type END AS o FROM part
  UNION ALL SELECT 1000000 + p_partkey, 'Canxi', 'giàu', p_name FROM part WHERE p_partkey % 10 = 3)"""
_STRIPPED = r"""st AS (SELECT ord, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s, regexp_replace(r, '^\s+|\s+$', '', 'g') AS r, regexp_replace(o, '^\s+|\s+$', '', 'g') AS o FROM raw),
sy AS (SELECT ord, CASE lower(s) WHEN 'ckd' THEN 'suy thận' ELSE s END AS s, r, o FROM st WHERE s <> '' AND r <> '' AND o <> ''),
ok AS (SELECT * FROM sy WHERE NOT starts_with(lower(s), 'hướng dẫn') AND lower(o) <> 'cơ thể'),
sw AS (SELECT ord, CASE WHEN lower(r) = 'giàu' AND lower(s) = 'canxi' AND lower(o) <> 'canxi' THEN o ELSE s END AS s, r, CASE WHEN lower(r) = 'giàu' AND lower(s) = 'canxi' AND lower(o) <> 'canxi' THEN s ELSE o END AS o FROM ok)"""


def _raw(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    s = F.when(k % 7 == 0, F.concat(F.lit("  "), F.upper("p_name"))).when(k % 11 == 0, "CKD").when(k % 13 == 0, F.concat(F.lit("Hướng dẫn "), "p_name")).otherwise(F.col("p_name"))
    o = F.when(k % 17 == 0, "cơ thể").when(k % 19 == 0, "").otherwise(F.col("p_type"))
    a = p.select(k.alias("ord"), s.alias("s"), F.when(k % 5 == 0, "Giàu").otherwise("has_type").alias("r"), o.alias("o"))
    b = p.where(k % 10 == 3).select((k + 1000000).alias("ord"), F.lit("Canxi").alias("s"), F.lit("giàu").alias("r"), F.col("p_name").alias("o"))
    return a.unionByName(b)


@query(f"WITH {_RAW}, {_STRIPPED} SELECT ord, s, r, o FROM sw QUALIFY row_number() OVER (PARTITION BY lower(s), lower(r), lower(o) ORDER BY ord) = 1")
def rule_clean(spark, d):
    return cleaning.rule_clean(_raw(spark, d), ["ord"])


@query(f"WITH {_RAW}, {_STRIPPED} SELECT count(*) AS n FROM ok WHERE lower(r) = 'giàu' AND lower(s) = 'canxi'")
def direction_fix(spark, d):
    t = _raw(spark, d).withColumns({c: cleaning.strip(F.col(c)) for c in "sro"}).where("s <> '' AND o <> ''")
    t = t.where(~cleaning.is_abstract(F.col("s")) & ~cleaning.is_generic(F.col("o"))).withColumn("was", F.col("s"))
    return cleaning.straightened(t).where("s <> was").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS ord, p_name AS s, 'has_brand' AS r, p_brand AS o FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1")
def dedup_exact(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("s"), F.lit("has_brand").alias("r"), F.col("p_brand").alias("o"))
    return cleaning.first_of_each(t, [F.col("s"), F.col("r"), F.col("o")], ["ord"])


@query("""WITH t AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS s FROM part), k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lower(s) ORDER BY ord) = 1)
SELECT (SELECT count(*) FROM t) AS before, (SELECT count(*) FROM k) AS after, (SELECT count(*) FROM t) - (SELECT count(*) FROM k) AS removed, (SELECT sum(ord)::BIGINT FROM k) AS kept_sum""")
def dedup_ci(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("s"))
    k = cleaning.first_of_each(t, [F.lower("s")], ["ord"])
    out = t.agg(F.count("*").alias("before")).crossJoin(k.agg(F.count("*").alias("after"), F.sum("ord").alias("kept_sum")))
    return out.select("before", "after", (F.col("before") - F.col("after")).alias("removed"), "kept_sum")


@query("SELECT doc_id, lang, before, after, before - after AS removed FROM (SELECT DISTINCT doc_id, lang FROM documents), (SELECT 2 * count(*) AS before, (SELECT count(*) FROM (SELECT DISTINCT doc_id, lang FROM documents)) AS after FROM documents)")
def merge_parts(spark, d):
    # two parts, each of all documents
    docs = table(spark, d, "documents").select("doc_id", "lang")
    both = docs.withColumn("part", F.lit(1)).unionByName(docs.withColumn("part", F.lit(2)))
    kept = cleaning.first_of_each(both, [F.col("doc_id"), F.col("lang")], ["part"]).drop("part")
    n = both.agg(F.count("*").alias("before")).crossJoin(kept.agg(F.count("*").alias("after")))
    return kept.crossJoin(F.broadcast(n.withColumn("removed", F.col("before") - F.col("after"))))


@query("SELECT part, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // ceil((SELECT count(*) FROM documents) / 7.0)::BIGINT)::BIGINT AS part FROM documents) GROUP BY part")
def split_parts(spark, d):
    return cleaning.split_parts(table(spark, d, "documents").select("doc_id"), "doc_id", 7).groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"""WITH {TRIPLES_SQL}, p AS (SELECT DISTINCT s, o, CASE WHEN r = 'has_brand' THEN 'avoid' WHEN r = 'has_type' THEN 'recommend' END AS kind FROM (SELECT s, r, CASE WHEN r = 'has_brand' AND contains(o, '1') THEN 'PROMO' ELSE o END AS o FROM kg)) SELECT s, o FROM p WHERE kind IS NOT NULL GROUP BY s, o HAVING count(DISTINCT kind) = 2""")
def contradictory_pairs(spark, d):
    t = kg.triples(spark, d).withColumn("o", F.when((F.col("r") == "has_brand") & F.col("o").contains("1"), "PROMO").otherwise(F.col("o")))
    return cleaning.contradictions(t, ["has_brand"], ["has_type"])


@query("SELECT percent_95 AS p95, percent_99 AS p99, mean, min, max FROM (SELECT quantile_disc(value, 0.95) AS percent_95, quantile_disc(value, 0.99) AS percent_99, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events)")
def latency_stats(spark, d):
    from graphloom.operators.evaluation import latency

    return latency(table(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("SELECT p_partkey AS id, least(p_size / 20.0 * 100, 100)::DOUBLE AS size_bar, least(p_retailprice / 2000 * 100, 100)::DOUBLE AS price_bar FROM part")
def daily_value_bars(spark, d):
    bar = lambda c, ref: F.least(F.col(c).cast("double") / F.lit(float(ref)) * 100, F.lit(100.0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), bar("p_size", 20).alias("size_bar"), bar("p_retailprice", 2000).alias("price_bar"))


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 25 THEN p_size::DOUBLE END, 0) AS calories, coalesce(CASE WHEN p_retailprice > 1000 THEN p_retailprice END, 0) AS fat, 0.0::DOUBLE AS zinc, 0.0::DOUBLE AS others FROM part")
def default_zero(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("calories"), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("fat"))
    others = [m for m in graph.METRICS if m not in ("calories", "fat", "zinc")]
    return advice.zeroed(p).select("id", "calories", "fat", "zinc", F.greatest(*others).alias("others"))


# advice: foods and diseases are searched by substring, all requests at once
_REQUESTS = """req AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'RING' WHEN 1 THEN c_name WHEN 2 THEN 'e Bolt' ELSE 'no such thing' END AS food, CASE c_custkey % 3 WHEN 0 THEN 'Promo alias ' WHEN 1 THEN 'brand#1' ELSE 'none' END AS disease FROM customer)"""
_ADVICE = """n AS (SELECT p_name AS name, max(p_size) AS size FROM part GROUP BY p_name),
t AS (SELECT DISTINCT s, r, o FROM kg),
ends AS (SELECT lower(o) AS name, s AS item FROM t WHERE r IN ('has_brand', 'has_type') UNION SELECT lower(s), o FROM t WHERE r IN ('has_brand', 'has_type')),
r2 AS (SELECT *, CASE lower(trim(disease)) WHEN 'promo alias' THEN 'promo' ELSE lower(disease) END AS target FROM req),
av AS (SELECT target, string_agg(DISTINCT item, '|' ORDER BY item) AS avoid FROM (SELECT DISTINCT target FROM r2) k JOIN ends ON contains(ends.name, k.target) GROUP BY target),
di AS (SELECT food, min_by(name, (length(name), name)) AS direct FROM (SELECT DISTINCT food FROM req) k JOIN n ON contains(lower(n.name), lower(k.food)) WHERE size IS NOT NULL GROUP BY food),
co AS (SELECT s, string_agg(o, '|' ORDER BY o) AS connections FROM (SELECT DISTINCT s, o FROM t) GROUP BY s),
re AS (SELECT name, string_agg(said, '|' ORDER BY said) AS relations FROM (SELECT s AS name, s || ' --[' || r || ']--> ' || o AS said FROM t UNION SELECT o, s || ' --[' || r || ']--> ' || o FROM t) GROUP BY name),
j AS (SELECT r2.*, avoid, direct, mapped, coalesce(direct, mapped) AS found FROM r2 LEFT JOIN av USING (target) LEFT JOIN di USING (food) LEFT JOIN m USING (id)),
s2 AS (SELECT *, CASE WHEN direct IS NOT NULL THEN 'OK_FOOD' WHEN mapped IS NOT NULL THEN 'OK_MAPPED' WHEN avoid IS NOT NULL THEN 'BLOCKED' ELSE 'NOT_FOUND' END AS status FROM j),
a2 AS (SELECT s2.id, food, disease, status, found, coalesce(avoid, '') AS avoid, coalesce(co.connections, '') AS connections, coalesce(re.relations, '') AS relations, CASE WHEN status = 'BLOCKED' THEN 0 ELSE n.size END::DOUBLE AS size,
  CASE WHEN starts_with(status, 'OK') THEN concat_ws(chr(10), 'Question: ' || food, 'Disease: ' || disease, CASE WHEN avoid IS NULL THEN '(nothing known to be avoided with ' || disease || ')' ELSE 'To be avoided with ' || disease || ':' || chr(10) || '  - ' || replace(avoid, '|', chr(10) || '  - ') END,
    CASE status WHEN 'OK_FOOD' THEN 'Node: ' || found || chr(10) || 'Connections:' || chr(10) || coalesce('  - ' || replace(co.connections, '|', chr(10) || '  - '), '')
    ELSE chr(39) || food || chr(39) || ' stands for node: ' || chr(39) || found || chr(39) || chr(10) || 'Relations:' || chr(10) || coalesce('  - ' || replace(re.relations, '|', chr(10) || '  - '), '') END) END AS context
  FROM s2 LEFT JOIN n ON n.name = found LEFT JOIN co ON co.s = found LEFT JOIN re ON re.name = found)"""
_ALIASES = {"promo alias": "PROMO"}


def _advice_nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size"))


def _plain(out):
    listed = {c: F.array_join(c, "|") for c in ("avoid", "connections", "relations")}
    return out.withColumns(listed).withColumn("size", F.col("nutrition.size")).drop("nutrition")


@query(f"WITH {TRIPLES_SQL}, {_REQUESTS}, m AS (SELECT id, food AS mapped FROM req WHERE id % 4 = 1), {_ADVICE} SELECT id, food, disease, status, found, avoid, connections, relations, size, context FROM a2")
def advice_batch(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    food = F.when(k % 4 == 0, "RING").when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, "e Bolt").otherwise("no such thing")
    req = c.select(k.alias("id"), food.alias("food"), F.when(k % 3 == 0, "Promo alias ").when(k % 3 == 1, "brand#1").otherwise("none").alias("disease"))
    # the model's answers: a name that has no relations, then the customer's own
    matches = c.where("c_custkey % 4 = 1").select(k.alias("id"), F.explode(F.array(F.struct(F.lit("nobody").alias("name"), F.lit(0).alias("ord")), F.struct(F.col("c_name").alias("name"), F.lit(1).alias("ord")))).alias("m")).select("id", "m.*")
    return _plain(advice.advise(req, _advice_nodes(spark, d), saved(kg.triples(spark, d).distinct()), AVOID, _ALIASES, "size", matches, ["size"]))


_ASKED = [(1, "ring", "brand#1"), (2, "please nation_3 and africa", "none"), (3, "what is it", "promo alias"), (4, "nothing", "none"), (5, "Nobody", "Brand#12")]
_ASKED_SQL = "req AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}', '{x}')" for i, q, x in _ASKED) + ") v(id, food, disease))"
_MATCHED_SQL = "m AS (SELECT id, min(name) AS mapped FROM req JOIN (SELECT s AS name FROM kg UNION SELECT o FROM kg) x ON list_contains(string_split(lower(food), ' '), lower(name)) GROUP BY id)"


def _asked(spark, d):
    triples = saved(kg.triples(spark, d).distinct())
    nodes = saved(triples.select(F.explode(F.array("s", "o")).alias("name")).distinct().join(_advice_nodes(spark, d), "name", "left"))
    return nodes, triples, {"avoid": AVOID, "aliases": _ALIASES, "needed": "size", "metrics": ["size"]}


@query(f"""WITH {TRIPLES_SQL}, {_ASKED_SQL}, {_MATCHED_SQL}, {_ADVICE} SELECT id, food, disease, status, found, avoid, connections, relations, size, context,
CASE status WHEN 'BLOCKED' THEN 'Nothing is known about ' || food || '; no advice is given.' WHEN 'NOT_FOUND' THEN 'Nothing is known about ' || food || ' or ' || disease || '.' ELSE food || ' / ' || disease || ': ' || context END AS response FROM a2""")
def advice_flow(spark, d):
    nodes, triples, options = _asked(spark, d)
    return _plain(advice.flow(spark.createDataFrame(_ASKED, "id bigint, food string, disease string"), nodes, triples, StubClient(), **options))


@query(f"""WITH {TRIPLES_SQL}, {_ASKED_SQL}, {_MATCHED_SQL}, {_ADVICE}, p AS (SELECT food || ' / ' || disease || ': ' || context AS said, found, size FROM a2 WHERE id = 1)
SELECT 'question' AS kind, said AS bot_response, found AS name, size FROM p UNION ALL SELECT 'image', said, found, size FROM p UNION ALL SELECT 'no image', 'No dish can be seen on the image.', NULL, NULL UNION ALL SELECT 'unknown', 'Nothing is known about nothing or none.', NULL, NULL""")
def ask(spark, d):
    import base64

    nodes, triples, options = _asked(spark, d)
    client, image = StubClient(), base64.b64encode(b"ring").decode()
    said = [("question", advice.ask(spark, "ring", "brand#1", nodes, triples, client, **options)), ("image", advice.ask_image(spark, image, "brand#1", nodes, triples, client, **options))]
    said += [("no image", files.answer_dict(advice.ask_image(spark, "?", "brand#1", nodes, triples, client, **options))), ("unknown", advice.ask(spark, "nothing", "none", nodes, triples, client, **options))]
    rows = [(k, a["bot_response"], (a["nutrition"] or {}).get("name"), (a["nutrition"] or {}).get("size")) for k, a in said]
    return spark.createDataFrame(rows, "kind string, bot_response string, name string, size double")
