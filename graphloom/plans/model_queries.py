"""Queries that run model calls (by a client that answers by fixed rules) or algorithms that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import evaluation, extraction, retrieval, spans
from graphloom.operators.models import StubClient, embedded
from graphloom.plans.kg import table
from graphloom.plans.registry import registry
from graphloom.plans.text_queries import _sentences
from graphloom.sources.work import batched

QUERIES, ORACLE_SQL, query = registry()

_SCHEMA = [("the", "what the means", 0), ("and", "what and means", 1), ("of", "what of means", 2), ("that", "what that means", 3), ("with", "what with means", 4), ("heen", "what heen means", 5)]


def _chunks(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("chunk"), "text")


def _schema(spark):
    return spark.createDataFrame(_SCHEMA, "relation string, definition string, ord bigint")


def _run(spark, d):
    client = StubClient()
    chunks = _chunks(spark, d)
    triples = extraction.extract(chunks, client)
    definitions = extraction.define(triples, client, chunks)
    return chunks, triples, definitions, extraction.canonicalize(triples, definitions, _schema(spark), client, 5, chunks)


# the client's rules in SQL: words by threes, definitions by name, letter counts as vectors, the first near option with the
# relation's first letter
_LETTERS = "list_transform(range(97, 123), lambda c: (length({0}) - length(replace({0}, chr(c::INT), '')))::DOUBLE)"
_THREES = r"""{n}t AS (SELECT chunk, i // 3 AS pos, w[i + 1] AS s, w[i + 2] AS r, w[i + 3] AS o FROM (SELECT chunk, w, unnest(range(0, len(w) - 2, 3)) AS i FROM {w}))"""
_DEFINED = """{n}d AS (SELECT DISTINCT chunk, r AS relation, 'what ' || r || ' means' AS definition FROM {n}t WHERE r <> 'Answer')"""
_CANON = (
    "sch AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', '{x}', {i})" for r, x, i in _SCHEMA)
    + ") v(relation, definition, ord))"
)
_PICKED = """{n}s AS (SELECT chunk, d.relation, s.relation AS option, row_number() OVER (PARTITION BY chunk, d.relation ORDER BY list_dot_product(%s, %s) DESC, ord) AS rank FROM {n}d d, sch s WHERE d.relation NOT IN (SELECT relation FROM sch)),
{n}p AS (SELECT chunk, relation, arg_min(option, rank) FILTER (option[1] = relation[1]) AS picked, string_agg(option, ',' ORDER BY rank) AS near FROM {n}s WHERE rank <= 5 GROUP BY chunk, relation),
{n}c AS (SELECT t.*, CASE WHEN t.r IN (SELECT relation FROM sch) THEN 'canonical' WHEN t.r IN (SELECT relation FROM {n}d) THEN 'match' ELSE 'undefined' END AS status, CASE WHEN t.r IN (SELECT relation FROM sch) THEN t.r ELSE picked END AS canonical, near FROM {n}t t LEFT JOIN {n}p p ON p.chunk = t.chunk AND p.relation = t.r)""" % (
    _LETTERS.format("d.definition"),
    _LETTERS.format("s.definition"),
)
_WORDS = r"w AS (SELECT item_id AS chunk, text, regexp_extract_all(text, '\p{L}+') AS w FROM benchmark)"
_ROUND = f"{_WORDS}, {_CANON}, {_THREES.format(n='x', w='w')}, {_DEFINED.format(n='x')}, {_PICKED.format(n='x')}"


@query(f"WITH {_ROUND} SELECT chunk, pos, s, r, o, status, canonical, coalesce(near, '') AS near FROM xc")
def pipeline_stub(spark, d):
    out = _run(spark, d)[3]
    return out.withColumn("near", F.coalesce(F.array_join(F.transform("candidates", lambda x: x["relation"]), ","), F.lit(""))).drop("candidates")


@query(f"WITH {_WORDS}, {_THREES.format(n='x', w='w')} SELECT chunk, pos, s, r, o FROM xt")
def open_extraction(spark, d):
    return extraction.extract(_chunks(spark, d), StubClient())


@query(f"WITH {_WORDS}, {_THREES.format(n='x', w='w')}, {_DEFINED.format(n='x')} SELECT chunk, relation, definition FROM xd")
def relation_definitions(spark, d):
    client, chunks = StubClient(), _chunks(spark, d)
    return extraction.define(extraction.extract(chunks, client), client, chunks)


def _said(c, missing="-"):
    return F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(" | ", x["s"], F.coalesce(x["r"], F.lit(missing)), x["o"])), "; "), F.lit(""))


def _flat(records):
    definitions = F.coalesce(F.array_join(F.transform("schema_definition", lambda x: F.concat(x["relation"], F.lit(": "), x["definition"])), "; "), F.lit(""))
    near = F.coalesce(F.array_join(F.transform("canonicalization_candidates", lambda x: F.coalesce(F.array_join(F.transform(x, lambda y: y["relation"]), ","), F.lit("-"))), "; "), F.lit(""))
    return records.select("chunk", "input_text", "entity_hint", _said(F.col("oie")).alias("oie"), definitions.alias("definitions"), near.alias("near"), _said(F.col("schema_canonicalization")).alias("canonical"))


_RECORDS = """SELECT w.chunk, w.text AS input_text, {hint} AS entity_hint, coalesce(o.oie, '') AS oie, coalesce(x.definitions, '') AS definitions, coalesce(k.near, '') AS near, coalesce(k.canonical, '') AS canonical FROM w
LEFT JOIN (SELECT chunk, string_agg(s || ' | ' || r || ' | ' || o, '; ' ORDER BY pos) AS oie FROM {n}t GROUP BY chunk) o USING (chunk)
LEFT JOIN (SELECT chunk, string_agg(relation || ': ' || definition, '; ' ORDER BY relation) AS definitions FROM {n}d GROUP BY chunk) x USING (chunk)
LEFT JOIN (SELECT chunk, string_agg(coalesce(near, '-'), '; ' ORDER BY pos) AS near, string_agg(s || ' | ' || coalesce(canonical, '-') || ' | ' || o, '; ' ORDER BY pos) AS canonical FROM {n}c GROUP BY chunk) k USING (chunk){join}"""


@query(f"WITH {_ROUND} {_RECORDS.format(hint=chr(39) * 2, n='x', join='')}")
def stage_record(spark, d):
    return _flat(extraction.run_stages(_chunks(spark, d), _schema(spark), StubClient())[1])


# the second round reads the text's words and then those of the hint: the entities of the surviving triples in order of
# name, then the text's capitalised words
_HINTED = r"""prev AS (SELECT chunk, e, row_number() OVER (PARTITION BY chunk ORDER BY e) AS i FROM (SELECT DISTINCT chunk, unnest([s, o]) AS e FROM xc WHERE canonical IS NOT NULL)),
caps AS (SELECT chunk, e, min(i) + 1000000 AS i FROM (SELECT chunk, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT chunk, regexp_extract_all(text, '[A-Z][a-z]+') AS l FROM w)) GROUP BY chunk, e),
hint AS (SELECT chunk, string_agg(e, '|' ORDER BY i) AS hint FROM (SELECT chunk, e, min(i) AS i FROM (SELECT * FROM prev UNION ALL SELECT * FROM caps) GROUP BY chunk, e) GROUP BY chunk),
w2 AS (SELECT w.chunk, text, w || coalesce(regexp_extract_all(hint, '\p{L}+'), []) AS w FROM w LEFT JOIN hint USING (chunk))"""
_SECOND = f"{_ROUND}, {_HINTED}, {_THREES.format(n='y', w='w2')}, {_DEFINED.format(n='y')}, {_PICKED.format(n='y')}"


@query(f"WITH {_SECOND} {_RECORDS.format(hint="coalesce(h.hint, '')", n='y', join=' LEFT JOIN hint h USING (chunk)')}")
def refinement(spark, d):
    return _flat(extraction.run_stages(_chunks(spark, d), _schema(spark), StubClient(), 1)[1])


@query(f"WITH {_SECOND} SELECT chunk, pos, s, canonical AS r, o FROM yc WHERE canonical IS NOT NULL")
def refined_triples(spark, d):
    return extraction.run_stages(_chunks(spark, d), _schema(spark), StubClient(), 1)[0]


# hints: relations of the surviving triples by name, then the ten nearest of the schema (all six); numbers count them all
_RELATIONS = f"""{_ROUND}, rels AS (SELECT chunk, rel, min(i) AS i FROM (SELECT chunk, rel, row_number() OVER (PARTITION BY chunk ORDER BY rel) AS i FROM (SELECT DISTINCT chunk, canonical AS rel FROM xc WHERE canonical IS NOT NULL)
 UNION ALL SELECT w.chunk, s.relation, 1000 + row_number() OVER (PARTITION BY w.chunk ORDER BY list_dot_product({_LETTERS.format('w.text')}, {_LETTERS.format('s.definition')}) DESC, ord) FROM w, sch s) GROUP BY chunk, rel),
ex AS (SELECT canonical AS rel, arg_min(struct_pack(s := s, o := o, text := text), (chunk, pos)) AS e FROM xc JOIN w USING (chunk) WHERE canonical IS NOT NULL GROUP BY canonical)"""


@query(f"""WITH {_RELATIONS} SELECT chunk, string_agg(no || '. ' || rel || ': ' || definition || chr(10) || coalesce('For example, [''' || e.s || ''', ''' || rel || ''', ''' || e.o || '''] can be extracted from "' || e.text || '"' || chr(10), ''), '' ORDER BY no) AS relation_hint
FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY i, rel) AS no FROM rels) JOIN sch ON sch.relation = rel LEFT JOIN ex USING (rel) GROUP BY chunk""")
def refinement_hints(spark, d):
    chunks, _, _, canonical = _run(spark, d)
    kept = canonical.where("canonical IS NOT NULL").select("chunk", "pos", "s", F.col("canonical").alias("r"), "o")
    return extraction.refinement_hints(chunks, kept, _schema(spark), StubClient()).select("chunk", "relation_hint")


@query(f"WITH {_ROUND}, e AS (SELECT DISTINCT chunk, unnest([s, o]) AS e FROM xt) SELECT chunk, (SELECT string_agg(e, '|' ORDER BY e) FROM e WHERE e.chunk = x.chunk) AS entities, string_agg(r, '|' ORDER BY r) AS relations FROM (SELECT DISTINCT chunk, r FROM xt) x GROUP BY chunk")
def previous_names(spark, d):
    return extraction.previous(extraction.extract(_chunks(spark, d), StubClient())).withColumns({c: F.array_join(c, "|") for c in ("entities", "relations")})


_CAPS = r"""caps AS (SELECT item_id, e, min(i) AS i FROM (SELECT item_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Z][a-z]+') AS l FROM benchmark)) GROUP BY item_id, e)"""


@query(rf"""WITH {_CAPS}, m AS (SELECT item_id, e, min(i) AS i FROM (SELECT item_id, e, i FROM caps UNION ALL SELECT item_id, 'Extra', 999999 FROM benchmark) GROUP BY item_id, e)
SELECT b.item_id AS chunk, coalesce((SELECT string_agg(e, '|' ORDER BY i) FROM caps WHERE caps.item_id = b.item_id), '') AS entities, (SELECT string_agg(e, '|' ORDER BY i) FROM m WHERE m.item_id = b.item_id) AS merged FROM benchmark b""")
def entity_merge(spark, d):
    chunks, client = _chunks(spark, d), StubClient()
    found = extraction.extract_entities(chunks, client)
    merged = extraction.merge_entities(chunks, found, chunks.select("chunk", F.array(F.lit("Extra")).alias("entities")), client)
    both = found.join(merged.withColumnRenamed("entities", "merged"), "chunk")
    return both.select("chunk", *[F.array_join(c, "|").alias(c) for c in ("entities", "merged")])


# every vector a relation; the schema's are the first twenty, and a name comes again after four hundred
_KNOWN = """k AS (SELECT vec_id, 'rel' || (vec_id % 400) AS relation, embedding::DOUBLE[] AS v FROM embeddings),
sc AS (SELECT relation, v FROM k WHERE vec_id < 20),
fi AS (SELECT relation, min(vec_id) AS ord, arg_min(v, vec_id) AS v FROM k WHERE relation NOT IN (SELECT relation FROM sc) GROUP BY relation),
nu AS (SELECT row_number() OVER (ORDER BY src, ord, relation) AS i, src, relation, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT 0 AS src, NULL AS ord, relation, v FROM sc UNION ALL SELECT 1, ord, relation, v FROM fi)),
pa AS (SELECT a.i, b.i AS j, list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9) AS sim FROM nu a JOIN nu b ON a.i < b.i AND b.src = 1 WHERE list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9) >= 0.3),
be AS (SELECT j, list(i ORDER BY i) AS l FROM pa GROUP BY j), st AS (SELECT list(i ORDER BY i) AS l, max(i) AS m FROM nu WHERE src = 0),
wa AS (SELECT m AS k, l AS leaders FROM st UNION ALL SELECT nu.i, CASE WHEN len(list_intersect(wa.leaders, coalesce(be.l, []))) = 0 THEN list_append(wa.leaders, nu.i) ELSE wa.leaders END FROM wa JOIN nu ON nu.i = wa.k + 1 LEFT JOIN be ON be.j = nu.i),
le AS (SELECT unnest(leaders) AS i FROM (SELECT leaders FROM wa ORDER BY k DESC LIMIT 1)),
ne AS (SELECT j, arg_max(pa.i, (sim, -pa.i)) AS to_ FROM pa JOIN le ON le.i = pa.i GROUP BY j),
de AS (SELECT nu.relation, CASE WHEN le.i IS NOT NULL THEN nu.relation ELSE t.relation END AS canonical, nu.src = 1 AND le.i IS NOT NULL AS added FROM nu LEFT JOIN le ON le.i = nu.i LEFT JOIN ne ON ne.j = nu.i LEFT JOIN nu t ON t.i = ne.to_)"""


@query(f"WITH RECURSIVE {_KNOWN} SELECT vec_id AS ord, k.relation, canonical, added AND vec_id = (SELECT min(vec_id) FROM k x WHERE x.relation = k.relation) AS added FROM k JOIN de ON de.relation = k.relation")
def enrich(spark, d):
    rel = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.concat(F.lit("rel"), (F.col("vec_id") % 400).cast("string")).alias("relation"), F.col("embedding").alias("v"))
    return extraction.enrich(rel, rel.where("ord < 20").select("relation", F.col("v").alias("w")), 0.30)


# pair after pair, with the relations so far and their vectors as lists
_GROWN = f"""g AS (SELECT row_number() OVER (ORDER BY d.chunk, pos, relation) AS k, d.chunk, relation, {_LETTERS.format('d.definition')} AS v FROM xd d JOIN (SELECT chunk, r, min(pos) AS pos FROM xt GROUP BY chunk, r) t ON t.chunk = d.chunk AND t.r = relation WHERE relation NOT IN (SELECT relation FROM sch)),
st AS (SELECT 0::BIGINT AS k, (SELECT list(relation ORDER BY ord) FROM sch) AS names, (SELECT list({_LETTERS.format('definition')} ORDER BY ord) FROM sch) AS vecs, NULL::VARCHAR AS picked
UNION ALL SELECT k, CASE WHEN picked IS NULL THEN list_append(names, relation) ELSE names END, CASE WHEN picked IS NULL THEN list_append(vecs, v) ELSE vecs END, coalesce(picked, relation)
FROM (SELECT g.k, g.relation, g.v, names, vecs, CASE WHEN list_contains(names, g.relation) THEN g.relation ELSE list_filter(list_sort(list_transform(range(1, len(names) + 1), lambda i: {{'s': -list_dot_product(vecs[i], g.v), 'i': i, 'n': names[i]}}))[1:5], lambda x: x.n[1] = g.relation[1])[1].n END AS picked FROM st JOIN g ON g.k = st.k + 1))"""


@query(f"""WITH RECURSIVE {_ROUND}, {_GROWN} SELECT t.chunk, pos, s, r, o, status, CASE status WHEN 'canonical' THEN r ELSE st.picked END AS canonical FROM xc t LEFT JOIN g ON g.chunk = t.chunk AND g.relation = r LEFT JOIN st ON st.k = g.k""")
def grown_schema(spark, d):
    # relations that no option fits join the schema as the model meets them
    client, chunks = StubClient(), _chunks(spark, d)
    triples = extraction.extract(chunks, client)
    return extraction.canonicalize(triples, extraction.define(triples, client, chunks), _schema(spark), client, 5, chunks, enrich=True).drop("candidates")


# each turn is read after the one before, as resolved: " it " stands for the last capitalised word there
_STRIPPED = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@query(rf"""WITH RECURSIVE c AS (SELECT conv_id AS doc, turn AS chunk, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT doc, chunk, k, {_STRIPPED.format('text')} AS text FROM c WHERE k = 1
UNION ALL SELECT c.doc, c.chunk, c.k, {_STRIPPED.format("CASE WHEN len(regexp_extract_all(r.text, '[A-Z][a-z]+')) > 0 THEN replace(c.text, ' it ', ' ' || regexp_extract_all(r.text, '[A-Z][a-z]+')[-1] || ' ') ELSE c.text END")} FROM r JOIN c ON c.doc = r.doc AND c.k = r.k + 1)
SELECT doc, chunk, text FROM r""")
def coreference(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk"), "text")
    return extraction.resolve_coreference(c, StubClient())


@query(r"""SELECT item_id AS doc, trim(regexp_replace(replace(text, '## ', ''), '[ \t\n\x0B\f\r|]+', ' ', 'g'), ' ') AS text FROM benchmark WHERE text <> ''""")
def standardise(spark, d):
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text")
    # a document of blanks alone comes back empty and is left out
    return extraction.standardise(docs.unionByName(spark.createDataFrame([(-1, " \n ")], docs.schema)), StubClient())


# lines cleaned, sentences cut and joined by threes, as the queries over text do
_CLEANED = _sentences(rf"""array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda l: {_STRIPPED.format('l')}), lambda l: l <> '' AND NOT regexp_matches(l, '{'|'.join(f'(?:{p})' for p in T.SKIPPED_LINES)}')), ' ')""")


@query(f"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {_CLEANED} AS l FROM documents)),
c AS (SELECT doc_id, (i // 3)::BIGINT AS chunk, string_agg(s, ' ' ORDER BY i) AS text FROM s GROUP BY ALL) SELECT doc_id AS doc, chunk, md5(text) AS digest FROM c""")
def prepare_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return extraction.prepare(docs).select("doc", "chunk", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS entry, p_name || ' ' || p_brand AS text, ['made_by_' || p_brand, 'kind_' || p_type] AS rels FROM part),
g AS (SELECT -1::BIGINT AS entry, []::VARCHAR[] AS seen UNION ALL (SELECT e.entry, list_distinct(g.seen || e.rels) FROM g JOIN e ON e.entry > g.entry AND len(list_intersect(g.seen, e.rels)) = 0 WHERE len(g.seen) < 5 ORDER BY e.entry LIMIT 1))
SELECT e.entry, text, rels[1] || '|' || rels[2] AS relations, rels[1] || ': what ' || rels[1] || ' means' || chr(10) || rels[2] || ': what ' || rels[2] || ' means' AS definitions FROM e JOIN g ON g.entry = e.entry""")
def crawl_definitions(spark, d):
    r = lambda prefix, c: F.concat(F.lit(prefix), c)
    t = lambda rel, o: F.array(F.col("p_name"), rel, o)
    triples = F.array(t(r("made_by_", "p_brand"), F.col("p_brand")), t(r("kind_", "p_type"), F.col("p_type")))
    entries = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), triples.alias("triples"))
    out = extraction.crawl_definitions(entries, StubClient())
    return out.select("entry", "text", F.array_join("relations", "|").alias("relations"), "definitions")


_PLACES = "places AS (SELECT n_nationkey AS key, n_name AS relation, lower(n_name || ' of ' || r_name) AS definition FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_PLACES} SELECT relation, array_to_string({_LETTERS.format('definition')}, ',') AS v FROM places")
def schema_vectors(spark, d):
    # every other relation of the schema has its vector; only the rest is embedded
    client = StubClient()
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    schema = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("relation"), F.lower(F.concat("n_name", F.lit(" of "), "r_name")).alias("definition"))
    have = embedded(schema.where("key % 2 = 0").drop("key"), client, "definition", "v")
    out = retrieval.updated_vectors(have, schema.drop("key"), "relation", lambda rows: embedded(rows, client, "definition", "v"))
    return out.select("relation", F.array_join(F.transform("v", lambda x: F.concat(x.cast("int").cast("string"), F.lit(".0"))), ",").alias("v"))


def _entries(spark, d):
    """Five parts an entry; a third of the predictions has another object, and the last one of each entry is missing."""
    p = table(spark, d, "part").withColumn("entry", F.floor(F.col("p_partkey") / 5).cast("bigint"))
    said = lambda o: F.array_sort(F.collect_list(F.struct("p_partkey", evaluation.normal_triple(F.concat_ws(" | ", "p_name", F.lit("hasKind_of"), o)).alias("t"))))
    e = p.groupBy("entry").agg(said(F.concat_ws(" ", "p_type", "p_brand")).alias("gold"), said(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))).alias("predicted"))
    lists = {c: F.transform(c, lambda x: x["t"]) for c in ("gold", "predicted")}
    return e.withColumns(lists).withColumn("predicted", F.slice("predicted", 1, 4))


@query()
def assignment_eval(spark, d):
    return spans.assignments(_entries(spark, d))


@query()
def system_scores(spark, d):
    return spans.system_scores(_entries(spark, d))


@query("SELECT doc_id, md5(strip_accents(replace(replace(lower(text), 'đ', 'd'), 'Đ', 'D'))) AS digest FROM documents")
def ascii_fold(spark, d):
    return batched(table(spark, d, "documents")).select("doc_id", F.md5(evaluation.ascii_fold(F.lower("text")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'))::BIGINT AS n FROM documents")
def word_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(evaluation.word_tokens(F.col("text"))).cast("bigint").alias("n"))


@query(r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark) SELECT item_id, CASE WHEN len(w) >= 5 THEN (SELECT min(i) FROM range(0, len(w) - 2) t(i) WHERE w[i + 1] = w[3] AND w[i + 2] = w[4] AND w[i + 3] = w[5]) END AS at FROM w""")
def sub_list(spark, d):
    w = table(spark, d, "benchmark").select("item_id", evaluation.word_tokens(F.col("text")).alias("w"))
    return w.select("item_id", F.when(F.size("w") >= 5, T.has_run(F.slice("w", 3, 3), F.col("w"))).cast("bigint").alias("at"))


# the longest run of free words, again and again
@query(r"""WITH RECURSIVE w AS (SELECT item_id, w, list_concat(w[4:], w[1:3]) AS b FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark)),
p AS (SELECT item_id, list({'i': i, 'j': j}) AS pairs FROM (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w) JOIN (SELECT item_id, unnest(b) AS y, generate_subscripts(b, 1) - 1 AS j FROM w) USING (item_id) WHERE x = y GROUP BY item_id),
a AS (SELECT item_id, w, b, pairs, []::BIGINT[] AS ti, []::BIGINT[] AS tj, []::VARCHAR[] AS runs FROM w JOIN p USING (item_id)
UNION ALL SELECT item_id, w, b, pairs, list_concat(ti, range(x.i, x.i - x.m)), list_concat(tj, range(x.j, x.j - x.m)), list_append(runs, '(' || x.i || ', ' || x.j || ', ' || -x.m || ')')
FROM (SELECT *, list_sort(list_transform(pairs, lambda q: {'m': -coalesce(list_min(list_filter(range(0, least(len(w) - q.i, len(b) - q.j)), lambda t: w[q.i + t + 1] <> b[q.j + t + 1] OR list_contains(ti, q.i + t) OR list_contains(tj, q.j + t))), least(len(w) - q.i, len(b) - q.j)), 'j': q.j, 'i': q.i}))[1] AS x FROM a) WHERE x.m < 0)
SELECT item_id, '[' || coalesce(array_to_string(arg_max(runs, len(runs)), ', '), '') || ']' AS runs FROM (SELECT item_id, runs FROM a UNION ALL SELECT item_id, []::VARCHAR[] FROM w) GROUP BY item_id""")
def ngram_align(spark, d):
    # the words of an item against the same words with the first three at the end
    items = table(spark, d, "benchmark").select("item_id", evaluation.word_tokens(F.col("text")).alias("w"))
    items = items.withColumn("back", F.concat(F.slice("w", F.lit(4), F.greatest(F.size("w") - 3, F.lit(0))), F.slice("w", 1, 3)))

    def work(frames):
        for pdf in frames:
            pdf["runs"] = [str(evaluation.align_runs(list(a), list(b))) for a, b in zip(pdf["w"], pdf["back"], strict=True)]
            yield pdf[["item_id", "runs"]]

    return items.mapInPandas(work, "item_id bigint, runs string")
