"""Queries over vectors: retrieval, clustering, evaluation, retriever data."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import cleaning, evaluation, retrieval
from graphloom.plans import kg
from graphloom.plans.kg import TRIPLES_SQL, table
from graphloom.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
#: No two of the driver's vectors come near 0.9; at 0.30 clusters form.
THRESHOLD = 0.30
_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
_TOP = f"""q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id >= 45), t AS (SELECT vec_id AS t, embedding AS w FROM embeddings WHERE vec_id < 45),
s AS (SELECT q, t, {_DOT.format('v', 'w')} AS score FROM q, t), top AS (SELECT q, t, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM s)"""


def _top(spark, d, k):
    """The first 45 vectors are the schema; all others are queries."""
    e = table(spark, d, "embeddings")
    targets = e.where("vec_id < 45").select(F.col("vec_id").alias("t"), F.col("vec_id").alias("ord"), F.col("embedding").alias("w"))
    return retrieval.top_k(e.where("vec_id >= 45").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), targets, k)


@query(f"WITH {_TOP} SELECT q, t, round(score, 9) AS score, rank FROM top WHERE rank <= 5")
def top5_relations(spark, d):
    return _top(spark, d, 5).withColumn("score", F.round("score", 9))


@query(f"WITH {_TOP} SELECT q, t, round(score, 9) AS score, rank FROM top WHERE rank <= 10")
def top10_relations(spark, d):
    return _top(spark, d, 10).withColumn("score", F.round("score", 9))


@query(f"WITH s AS (SELECT a.vec_id AS q, b.vec_id AS t, {_DOT.format('a.embedding', 'b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT q, t, round(score, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM s QUALIFY rank <= 10")
def nearest_vectors(spark, d):
    """Every hundredth vector's nearest ones among all vectors, many blocks of them."""
    e = table(spark, d, "embeddings")
    targets = e.select(F.col("vec_id").alias("t"), F.col("vec_id").alias("ord"), F.col("embedding").alias("w"))
    found = retrieval.top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), targets, 10)
    return found.withColumn("score", F.round("score", 9))


@query(f"WITH {TRIPLES_SQL}, t AS (SELECT DISTINCT r FROM kg) SELECT r, CASE WHEN r IN ('has_brand', 'located_in') THEN 'canonical' WHEN r IN ('has_brand', 'part_of', 'in_segment') THEN 'match' ELSE 'undefined' END AS status, (SELECT count(*) FROM kg WHERE kg.r = t.r) AS n FROM t")
def canonical_split(spark, d):
    rel = lambda *x: spark.createDataFrame([(r,) for r in x], "relation string")
    split = retrieval.canonical_split(kg.triples(spark, d), rel("has_brand", "located_in"), rel("has_brand", "part_of", "in_segment"))
    return split.groupBy("r", "status").agg(F.count("*").alias("n"))


@query("SELECT vec_id, label::BIGINT AS label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM embeddings k WHERE k.vec_id % 2 = 0 AND k.vec_id = e.vec_id)")
def incremental_schema(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.missing_vectors(e, e.where("vec_id % 2 = 0"), "vec_id").select("vec_id", F.col("label").cast("bigint").alias("label"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))


_PAIRS = f"""e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings),
pairs AS (SELECT a.i, b.i AS j, list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9) AS sim FROM e a JOIN e b ON a.i < b.i WHERE list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9) >= {THRESHOLD})"""


@query(f"WITH {_PAIRS} SELECT i, j, round(sim, 9) AS sim FROM pairs")
def cosine_pairs(spark, d):
    return retrieval.similar_pairs(_vectors(spark, d), THRESHOLD).withColumn("sim", F.round("sim", 9))


# the sequential rule, one vector a step: its leader is the first earlier leader among its neighbours, else itself
_LEADERS = f"""RECURSIVE {_PAIRS}, n AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM e), before AS (SELECT j, list(i ORDER BY i) AS l FROM pairs GROUP BY j),
w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS leaders, NULL::BIGINT AS i, NULL::BIGINT AS leader
UNION ALL SELECT n.k, CASE WHEN len(list_intersect(w.leaders, coalesce(b.l, []))) = 0 THEN list_append(w.leaders, n.i) ELSE w.leaders END, n.i, coalesce(list_min(list_intersect(w.leaders, coalesce(b.l, []))), n.i) FROM w JOIN n ON n.k = w.k + 1 LEFT JOIN before b ON b.j = n.i)"""


@query(f"WITH {_LEADERS} SELECT i, leader FROM w WHERE k > 0")
def leader_clusters(spark, d):
    return retrieval.leader_clusters(_vectors(spark, d), THRESHOLD)


@query(f"""WITH {_LEADERS}, m AS (SELECT i, leader FROM w WHERE k > 0), t AS (SELECT vec_id AS ord, vec_id::VARCHAR AS s, 'near' AS r, (vec_id * 7 % (SELECT count(*) FROM embeddings))::VARCHAR AS o FROM embeddings),
x AS (SELECT ord, a.leader::VARCHAR AS s, r, b.leader::VARCHAR AS o FROM t JOIN m a ON a.i::VARCHAR = t.s JOIN m b ON b.i::VARCHAR = t.o)
SELECT ord, s, r, o FROM x WHERE s <> o QUALIFY row_number() OVER (PARTITION BY s, r, o ORDER BY ord) = 1""")
def semantic_dedup(spark, d):
    e = table(spark, d, "embeddings")
    n = e.count()
    t = e.select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("s"), F.lit("near").alias("r"), (F.col("vec_id") * 7 % n).cast("string").alias("o"))
    names = retrieval.leader_clusters(_vectors(spark, d), THRESHOLD).select(F.col("i").cast("string").alias("name"), F.col("leader").cast("string").alias("leader"))
    return cleaning.rewritten(t, names, ["ord"])


@query(f"WITH {TRIPLES_SQL} SELECT r, count(*) AS n, min_by(s, (s, o)) AS example_s, min_by(o, (s, o)) AS example_o FROM kg GROUP BY r")
def relation_examples(spark, d):
    return retrieval.relation_examples(kg.triples(spark, d), ["s", "o"])


@query(f"""WITH {TRIPLES_SQL}, prev AS (SELECT DISTINCT o AS chunk, r AS rel, CASE r WHEN 'located_in' THEN 0 WHEN 'part_of' THEN 1 ELSE 2 END AS pos FROM kg WHERE starts_with(o, 'NATION') OR o IN ('ASIA', 'AFRICA')),
ret AS (SELECT chunk, rel, pos FROM (SELECT DISTINCT chunk FROM prev), (VALUES ('part_of', 0), ('has_type', 1), ('unknown', 2), ('has_brand', 3)) v(rel, pos)),
b AS (SELECT chunk, rel, min((src, pos)) AS place FROM (SELECT *, 0 AS src FROM prev UNION ALL SELECT *, 1 FROM ret) WHERE rel <> 'unknown' GROUP BY ALL)
SELECT chunk, string_agg(rel, '|' ORDER BY place, rel) AS hints FROM b GROUP BY chunk""")
def refine_hints(spark, d):
    t = kg.triples(spark, d)
    pos = F.when(F.col("r") == "located_in", 0).when(F.col("r") == "part_of", 1).otherwise(2)
    prev = t.where(F.col("o").startswith("NATION") | F.col("o").isin("ASIA", "AFRICA")).select(F.col("o").alias("chunk"), F.col("r").alias("rel"), pos.alias("pos")).distinct()
    found = F.array(*[F.struct(F.lit(r).alias("rel"), F.lit(i).alias("pos")) for i, r in enumerate(("part_of", "has_type", "unknown", "has_brand"))])
    ret = prev.select("chunk").distinct().select("chunk", F.explode(found).alias("x")).select("chunk", "x.*")
    return retrieval.hints(prev, ret, t.select(F.col("r").alias("relation")))


_BY_SUBJECT = f"{TRIPLES_SQL}, t AS (SELECT DISTINCT s AS k, r FROM kg)"


def _by_subject(spark, d):
    return kg.triples(spark, d).select(F.col("s").alias("k"), "r")


@query(f"WITH {_BY_SUBJECT} SELECT k, r FROM (SELECT DISTINCT k FROM t), (SELECT DISTINCT r FROM t) EXCEPT SELECT k, r FROM t")
def negative_relations(spark, d):
    return retrieval.negative_relations(_by_subject(spark, d), "k")


@query(f"""WITH {_BY_SUBJECT}, neg AS (SELECT k, r FROM (SELECT DISTINCT k FROM t), (SELECT DISTINCT r FROM t) EXCEPT SELECT k, r FROM t),
p AS (SELECT k, r, row_number() OVER (PARTITION BY k ORDER BY r) - 1 AS idx FROM t), n AS (SELECT k, r, row_number() OVER (PARTITION BY k ORDER BY r) - 1 AS idx FROM neg)
SELECT p.k, p.idx, p.r AS positive, n.r AS negative FROM p JOIN n ON p.k = n.k AND p.idx = n.idx WHERE p.idx < 2""")
def retriever_samples(spark, d):
    return retrieval.retriever_samples(_by_subject(spark, d), "k", 2)


_EVAL = f"""gold AS (SELECT DISTINCT s AS entry, s || ' | ' || r || ' | ' || o AS triple FROM kg WHERE r IN ('has_brand', 'has_type')),
pred AS (SELECT DISTINCT entry, CASE WHEN length(triple) % 3 = 0 THEN upper(triple) WHEN length(triple) % 7 = 0 THEN triple || 's' ELSE triple END AS triple FROM gold WHERE length(triple) % 5 <> 0)"""


def _gold_and_predicted(spark, d):
    g = kg.triples(spark, d).where("r IN ('has_brand', 'has_type')").select(F.col("s").alias("entry"), F.concat_ws(" | ", "s", "r", "o").alias("triple")).distinct()
    n = F.length("triple")
    p = g.where(n % 5 != 0).withColumn("triple", F.when(n % 3 == 0, F.upper("triple")).when(n % 7 == 0, F.concat("triple", F.lit("s"))).otherwise(F.col("triple")))
    return g, p.distinct()


@query(f"""WITH {TRIPLES_SQL}, {_EVAL}, g AS (SELECT DISTINCT entry, lower(triple) AS t FROM gold), p AS (SELECT DISTINCT entry, lower(triple) AS t FROM pred),
c AS (SELECT coalesce(g.t, p.t) AS t, count(*) FILTER (g.t IS NOT NULL AND p.t IS NOT NULL) AS tp, count(*) FILTER (g.t IS NULL) AS fp, count(*) FILTER (p.t IS NULL) AS fn FROM g FULL JOIN p ON g.entry = p.entry AND g.t = p.t GROUP BY 1),
m AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c)
SELECT round(avg(pr), 9) AS precision, round(avg(rc), 9) AS recall, round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END), 9) AS f1 FROM m""")
def macro_f1(spark, d):
    s = evaluation.macro_scores(*_gold_and_predicted(spark, d))
    return s.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_ALIGNED = """a AS (SELECT p_partkey, p_name AS gs, 'has_type' AS gr, p_type AS go, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS ps, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'is_type' ELSE 'has_type' END END AS pr, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS po FROM part)"""


@query(f"""WITH {_ALIGNED}, t AS (SELECT 'SUB' AS tag, gs AS g, ps AS p FROM a UNION ALL SELECT 'PRED', gr, pr FROM a UNION ALL SELECT 'OBJ', go, po FROM a)
SELECT tag, count(*) FILTER (g = p) AS correct, count(*) FILTER (g <> p) AS incorrect, count(*) FILTER (p IS NULL AND g IS NOT NULL) AS missed, count(*) FILTER (g IS NULL AND p IS NOT NULL) AS spurious, count(g) AS possible, count(p) AS actual,
CASE WHEN count(p) > 0 THEN count(*) FILTER (g = p) / count(p) ELSE 0 END AS precision, CASE WHEN count(g) > 0 THEN count(*) FILTER (g = p) / count(g) ELSE 0 END AS recall FROM t GROUP BY tag""")
def span_totals(spark, d):
    k = F.col("p_partkey")
    g = F.struct(F.col("p_name").alias("s"), F.lit("has_type").alias("r"), F.col("p_type").alias("o"))
    p = F.when(k % 4 != 0, F.struct(F.col("p_name").alias("s"), F.when(k % 3 == 0, "is_type").otherwise("has_type").alias("r"), F.col("p_brand").alias("o")))
    return evaluation.span_totals(table(spark, d, "part").select(g.alias("g"), p.alias("p")))


@query(f"""WITH {TRIPLES_SQL}, {_EVAL}, g AS (SELECT entry, count(*) AS n FROM gold GROUP BY 1), p AS (SELECT entry, count(*) AS n FROM pred GROUP BY 1)
SELECT g.entry, g.n AS gold_n, coalesce(p.n, 0) AS predicted_n FROM g LEFT JOIN p USING (entry) WHERE abs(g.n - coalesce(p.n, 0)) <= 4""")
def length_filter(spark, d):
    g, p = _gold_and_predicted(spark, d)
    e = g.groupBy("entry").agg(F.collect_list("triple").alias("gold")).join(p.groupBy("entry").agg(F.collect_list("triple").alias("predicted")), "entry", "left")
    e = e.withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    return evaluation.length_filter(e, 4).select("entry", F.size("gold").cast("bigint").alias("gold_n"), F.size("predicted").cast("bigint").alias("predicted_n"))


@query(f"""WITH {_TOP}, l AS (SELECT vec_id, label FROM embeddings), r AS (SELECT top.q, rank, a.label = b.label AS hit, (SELECT count(*) FROM l x WHERE x.vec_id < 45 AND x.label = a.label) AS n FROM top JOIN l a ON a.vec_id = top.q JOIN l b ON b.vec_id = top.t WHERE rank <= 5),
m AS (SELECT q, count(*) FILTER (hit) AS h, max(n) AS n FROM r GROUP BY q) SELECT round(avg((h > 0)::INT), 9) AS hit_rate, round(avg(h / 5), 9) AS precision_at_k, round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 9) AS recall_at_k FROM m""")
def hit_rate(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    sizes = e.where("vec_id < 45").groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("total_relevant"))
    q, t = e.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("t"), F.col("label").alias("tl"))
    rows = _top(spark, d, 5).join(q, "q").join(t, "t").join(sizes, "ql", "left").select("q", "rank", (F.col("ql") == F.col("tl")).alias("relevant"), F.coalesce("total_relevant", F.lit(0)).alias("total_relevant"))
    return evaluation.hit_rate(rows, 5).select(*[F.round(c, 9).alias(c) for c in ("hit_rate", "precision_at_k", "recall_at_k")])


_NEIGHBOURS = """x AS (SELECT a.vec_id, a.embedding AS q, b.embedding AS p, c.embedding AS n, d.embedding AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 JOIN embeddings d ON d.vec_id = a.vec_id + 3)"""


def _neighbours(spark, d):
    e = table(spark, d, "embeddings")
    out = e.select("vec_id", F.col("embedding").alias("q"))
    for i, c in enumerate("pnm", 1):
        out = out.join(e.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(c)), "vec_id")
    return out


@query(f"WITH {_NEIGHBOURS} SELECT round(avg(({_DOT.format('q', 'p')} >= {_DOT.format('q', 'n')})::INT), 9) AS accuracy, count(*) AS n FROM x")
def retriever_accuracy(spark, d):
    right = V.dot(F.col("q"), F.col("p")) >= V.dot(F.col("q"), F.col("n"))
    return _neighbours(spark, d).agg(F.round(F.avg(right.cast("int")), 9).alias("accuracy"), F.count("*").alias("n"))


@query(f"WITH {_NEIGHBOURS}, s AS (SELECT {_DOT.format('q', 'p')} / 0.1 AS p, {_DOT.format('q', 'n')} / 0.1 AS n, {_DOT.format('q', 'm')} / 0.1 AS m FROM x) SELECT round(avg(-ln(exp(p) / (exp(p) + exp(n) + exp(m)))), 8) AS loss FROM s")
def info_nce(spark, d):
    loss = V.info_nce(V.dot(F.col("q"), F.col("p")), F.array(V.dot(F.col("q"), F.col("n")), V.dot(F.col("q"), F.col("m"))), 0.1)
    return _neighbours(spark, d).agg(F.round(F.avg(loss), 8).alias("loss"))


@query(f"SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS length, round(embedding[1]::DOUBLE / sqrt({_DOT.format('embedding', 'embedding')}), 6) AS first FROM embeddings")
def unit_vectors(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("length"), F.round(F.get(V.normalized(v), F.lit(0)), 6).alias("first"))


@query(f"""WITH {_NEIGHBOURS}, k AS (SELECT vec_id // 16 AS batch, vec_id AS q, q AS v, p AS w FROM x),
s AS (SELECT a.batch, a.q, b.q AS t, {_DOT.format('a.v', 'b.w')} / sqrt({_DOT.format('a.v', 'a.v')}) / sqrt({_DOT.format('b.w', 'b.w')}) / 0.1 AS s FROM k a JOIN k b ON a.batch = b.batch)
SELECT batch, q, round(ln(sum(exp(s))) - max(s) FILTER (q = t), 8) AS loss FROM s GROUP BY batch, q""")
def info_nce_batches(spark, d):
    rows = _neighbours(spark, d).select(F.floor(F.col("vec_id") / 16).cast("bigint").alias("batch"), F.col("vec_id").alias("q"), F.col("q").alias("v"), F.col("p").alias("w"))
    return V.info_nce_in_batch(rows).withColumn("loss", F.round("loss", 8))


@query(f"""WITH {_NEIGHBOURS}, u AS (SELECT embedding AS w FROM embeddings WHERE vec_id < 3), s AS (SELECT vec_id, {_DOT.format('q', 'p')} / 0.1 AS p, (SELECT sum(exp({_DOT.format('x.q', 'u.w')} / 0.1)) FROM u) AS n FROM x)
SELECT vec_id, round(-ln(exp(p) / (exp(p) + n)), 8) AS loss FROM s""")
def info_nce_unpaired(spark, d):
    # the same negatives for every query
    rows = table(spark, d, "embeddings").where("vec_id < 3").select("embedding").collect()
    negatives = F.array(*[V.dot(F.col("q"), F.lit([float(x) for x in r[0]])) for r in rows])
    loss = V.info_nce(V.dot(F.col("q"), F.col("p")), negatives, 0.1)
    return _neighbours(spark, d).select("vec_id", F.round(loss, 8).alias("loss"))


@query("SELECT vec_id, round(CASE vec_id % 4 WHEN 3 THEN NULL WHEN 2 THEN embedding[1]::DOUBLE ELSE embedding[2]::DOUBLE END, 6) AS first FROM embeddings")
def last_token(spark, d):
    # three tokens a text: the vector, the vector moved by one, the vector again; the mask ends at another place for each text
    e, k = F.col("embedding"), F.col("vec_id") % 4
    tokens = F.array(e, F.slice(e, F.lit(2), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1))
    mask = F.when(k == 0, F.array(F.lit(1), F.lit(1), F.lit(0))).when(k == 1, F.array(F.lit(1), F.lit(1), F.lit(1))).when(k == 2, F.array(F.lit(1), F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(V.last_token(tokens, mask), F.lit(0)).cast("double"), 6).alias("first"))


# entries with a triple or two and definitions, made from the parts
_ENTRIES = """ent AS (SELECT p_partkey AS entry, p_name || ' of ' || p_brand || ' is ' || p_type AS text, p_name, p_brand, p_type FROM part),
tr AS (SELECT entry, text, 0 AS pos, p_name AS s, 'made_by' AS r, upper(p_brand) AS o FROM ent UNION ALL SELECT entry, text, 1, p_name, 'kind_' || p_type, p_type FROM ent UNION ALL SELECT entry, text, 2, p_name, 'absent', 'not in it' FROM ent),
de AS (SELECT entry, r AS relation, CASE r WHEN 'made_by' THEN 'who makes ' || s ELSE 'what ' || s || ' is' END AS definition FROM tr)"""


def _entries(spark, d):
    p = table(spark, d, "part")
    t = lambda r, o: F.array(F.col("p_name"), r, o)
    triples = F.array(t(F.lit("made_by"), F.upper("p_brand")), t(F.concat(F.lit("kind_"), "p_type"), F.col("p_type")), t(F.lit("absent"), F.lit("not in it")))
    text = F.concat("p_name", F.lit(" of "), "p_brand", F.lit(" is "), "p_type")
    entries = p.select(F.col("p_partkey").alias("entry"), text.alias("text"), triples.alias("triples"))
    rows = entries.select("entry", F.explode("triples").alias("t")).select("entry", F.get("t", F.lit(0)).alias("s"), F.get("t", F.lit(1)).alias("relation"))
    said = F.when(F.col("relation") == "made_by", F.concat(F.lit("who makes "), "s")).otherwise(F.concat(F.lit("what "), "s", F.lit(" is")))
    return entries, rows.select("entry", "relation", said.alias("definition"))


@query(f"""WITH {_ENTRIES}, pos AS (SELECT tr.entry, text, tr.r, definition, '[' || s || ', ' || tr.r || ', ' || o || ']' AS t FROM tr JOIN de ON de.entry = tr.entry AND de.relation = tr.r WHERE contains(lower(text), lower(s)) AND contains(lower(text), lower(o))),
p AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY r) - 1 AS idx FROM pos), rel AS (SELECT relation, min(definition) AS nd FROM de GROUP BY 1),
n AS (SELECT entry, relation, nd, row_number() OVER (PARTITION BY entry ORDER BY relation) - 1 AS idx FROM (SELECT DISTINCT entry FROM pos) e, rel WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.entry = e.entry AND pos.r = rel.relation))
SELECT p.entry, p.idx, text AS sentence, p.r || ': ' || definition AS positive, n.relation || ': ' || nd AS negative, p.r AS positive_relation, n.relation AS negative_relation, t AS positive_triple FROM p JOIN n ON n.entry = p.entry AND n.idx = p.idx WHERE p.idx < 2""")
def collect_samples(spark, d):
    out = retrieval.collect_samples(*_entries(spark, d))
    said = F.array_join(F.transform("positive_triple", lambda t: F.concat(F.lit("["), F.array_join(t, ", "), F.lit("]"))), "; ")
    return out.withColumn("positive_triple", said)


@query(f"WITH {_ENTRIES} SELECT relation, array_to_string(list_sort(list(DISTINCT definition)), '|') AS definitions FROM de GROUP BY relation")
def definition_lists(spark, d):
    defs = _entries(spark, d)[1].withColumnRenamed("entry", "chunk")
    return retrieval.definition_lists(defs).withColumn("definitions", F.array_join("definitions", "|"))


@query(f"WITH {_ENTRIES} SELECT r, row_number() OVER (PARTITION BY r ORDER BY entry, pos) - 1 AS idx, text, s, o FROM tr")
def example_lists(spark, d):
    entries = _entries(spark, d)[0].withColumnRenamed("entry", "chunk")
    rows = entries.select("chunk", F.posexplode("triples").alias("pos", "t")).select("chunk", "pos", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("sro")])
    return retrieval.examples(rows, entries)
