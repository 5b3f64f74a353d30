"""Queries over text functions: lines, sentences, chunks, literals, model answers, rows as prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import cleaning, evaluation, extraction, foods, retrieval
from graphloom.operators.cleaning import numbered
from graphloom.plans import kg
from graphloom.plans.kg import TRIPLES_SQL, table
from graphloom.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()

_STRIP = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def _sentences(column: str) -> str:
    x = rf"regexp_replace(regexp_replace({column}, '(\d)\.(\d)', '\1<DOT>\2', 'g'), '\b(g|mg|kg|ml|kcal|vs|Dr|PGS|GS)\.[ \t\n\x0B\f\r]', '\1<DOT> ', 'g')"
    parts = rf"string_split(regexp_replace({_STRIP.format(x)}, '([.!?])[ \t\n\x0B\f\r]+', '\1<SEP>', 'g'), '<SEP>')"
    return f"list_transform(list_filter(list_transform({parts}, lambda p: {_STRIP.format('p')}), lambda p: length(p) > 10), lambda p: replace(p, '<DOT>', '.'))"


@query(f"SELECT doc_id, len(l)::BIGINT AS n, array_to_string(l, '|') AS sentences FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents)")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("l"))
    return s.select("doc_id", F.size("l").cast("bigint").alias("n"), F.array_join("l", "|").alias("sentences"))


_CHUNKS = f"""s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents)),
c AS (SELECT doc_id, (i // 3)::BIGINT AS chunk, string_agg(s, ' ' ORDER BY i) AS text FROM s GROUP BY ALL)"""


def _chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.chunked(T.sentences(F.col("text")), 3)).alias("chunk", "text"))
    return docs.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "text")


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk, text FROM c")
def chunking(spark, d):
    return _chunks(spark, d)


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk, coalesce(string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM c")
def context_window(spark, d):
    return extraction.latest_context(_chunks(spark, d).withColumnRenamed("doc_id", "doc")).select(F.col("doc").alias("doc_id"), "chunk", "context")


@query(rf"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda l: {_STRIP.format('l')}), lambda l: l <> '' AND NOT regexp_matches(l, 'Apache') AND NOT regexp_matches(l, '^\[\d')), ' ') AS text FROM documents""")
def line_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_lines(F.col("text"), ["Apache", r"^\[\d"]).alias("text"))


@query("""SELECT p_partkey AS id, try_cast(v AS DOUBLE) AS as_null, coalesce(try_cast(v AS DOUBLE), 0) AS as_zero FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'n/a' WHEN p_partkey % 10 = 0 THEN NULL ELSE replace((p_partkey // 10)::VARCHAR || ',' || (p_partkey % 10)::VARCHAR, ',', '.') END AS v FROM part)""")
def decimal_parse(spark, d):
    k = F.col("p_partkey")
    v = F.when(k % 9 == 0, "n/a").when(k % 10 == 0, F.lit(None)).otherwise(F.concat(F.floor(k / 10).cast("string"), F.lit(","), (k % 10).cast("string")))
    return table(spark, d, "part").select(k.alias("id"), T.decimal(v).alias("as_null"), T.decimal(v, 0.0).alias("as_zero"))


@query(f"WITH {TRIPLES_SQL} SELECT s, r, o, count(*) AS n FROM kg GROUP BY ALL")
def parse_literals(spark, d):
    t = kg.triples(spark, d)
    one = F.concat(F.lit("['"), "s", F.lit("', \""), "r", F.lit("\", '"), "o", F.lit("']"))
    lines = t.select(F.when(F.col("r") == "part_of", one).otherwise(F.concat(F.lit("["), one, F.lit(", ['x', 'y']]"))).alias("line"))
    return lines.select(F.explode(T.triple_literals(F.col("line"))).alias("t")).groupBy(*[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("sro")]).agg(F.count("*").alias("n"))


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT s, r, o FROM kg")
def parse_triplets(spark, d):
    t = kg.triples(spark, d).distinct()
    answer = F.concat(F.lit("Sure: [['"), "s", F.lit("', '"), "r", F.lit("', '"), "o", F.lit("'], ['a', '_', 'b'], ['', 'c', 'd'], ['two', 'parts']] done]"))
    found = t.select(F.explode(T.answer_triples(answer)).alias("t"))
    return found.select(*[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("sro")])


@query(f"WITH {TRIPLES_SQL} SELECT s, o, 2::BIGINT AS n, s || '|' || o AS listed FROM (SELECT DISTINCT s, o FROM kg)")
def parse_entities(spark, d):
    t = kg.triples(spark, d).select("s", "o").distinct()
    found = t.select("s", "o", T.answer_entities(F.concat(F.lit("Entities: ['"), "s", F.lit("', '"), "o", F.lit("'] and [more]"))).alias("e"))
    return found.select("s", "o", F.size("e").cast("bigint").alias("n"), F.array_join("e", "|").alias("listed"))


@query("SELECT n_name AS name, 'in region ' || r_name || ': fine' AS definition FROM nation JOIN region ON n_regionkey = r_regionkey")
def parse_definitions(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("no colon here\nAnswer: skipped\n"), "n_name", F.lit(": an earlier one\n"), "n_name", F.lit(" : in region "), "r_name", F.lit(": fine "))
    return n.select(F.explode(T.definition_rows(text)).alias("x")).select("x.name", "x.definition")


@query("""SELECT event_id, json_extract_string(props, '$.k') || ',' || event_type AS listed FROM events""")
def first_json_array(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit("Here:\n[\""), F.get_json_object("props", "$.k"), F.lit("\",\n\""), "event_type", F.lit("\"] and [\"later\"]"))
    return e.select("event_id", F.array_join(T.first_json_array(text), ",").alias("listed"))


@query(rf"SELECT doc_id, {_STRIP.format('text')} AS text FROM documents")
def prefix_strip(spark, d):
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Đoạn đã xử lý: "), "text")).otherwise(F.concat(F.lit("Đoạn văn đã xử lý:"), "text"))
    return docs.select("doc_id", T.without_prefix(text).alias("text"))


@query("""SELECT p_partkey AS id, 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_type || chr(10) || 'D. None of the above.' || chr(10) AS choices,
CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS picked FROM part""")
def choice_text(spark, d):
    options = F.array("p_name", "p_brand", "p_type")
    answer = F.get(F.array(*map(F.lit, ("A", "B.", "C and more", "D", ""))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.choices(options).alias("choices"), T.chosen(answer, options).alias("picked"))


@query("SELECT item_id, 'Instruct: retrieve relations' || chr(10) || 'Query: Text: ' || text || chr(10) || 'Item: ' || item_id AS prompt FROM benchmark")
def prompt_fill(spark, d):
    filled = T.fill("Text: {input_text}\nItem: {item}", input_text=F.col("text"), item=F.col("item_id").cast("string"))
    return table(spark, d, "benchmark").select("item_id", T.instructed("retrieve relations", filled).alias("prompt"))


@query(r"""SELECT DISTINCT raw, lower(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(raw, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '^(.*?)\s\(.*?\)$', '\1')) AS form
FROM (SELECT p_name || 'Item_' || p_type || '  (' || p_brand || ')' AS raw FROM part UNION ALL SELECT o_orderpriority FROM orders)""")
def normalize_eval(spark, d):
    a = table(spark, d, "part").select(F.concat("p_name", F.lit("Item_"), "p_type", F.lit("  ("), "p_brand", F.lit(")")).alias("raw"))
    raw = a.unionByName(table(spark, d, "orders").select(F.col("o_orderpriority").alias("raw"))).distinct()
    return raw.select("raw", T.without_parenthesis(T.evaluation_form(F.col("raw"))).alias("form"))


@query(r"""WITH t AS (SELECT doc_id, lower(text) AS text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS words FROM t WHERE len(w) > 2 AND contains(text, lower(w[1])) AND contains(text, lower(CASE WHEN doc_id % 3 = 0 THEN 'nowhere~' ELSE w[3] END))""")
def mention_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)).alias("w"))
    o = F.when(F.col("doc_id") % 3 == 0, "nowhere~").otherwise(F.get("w", F.lit(2)))
    rows = docs.where(F.size("w") > 2).select("doc_id", "text", F.size("w").cast("bigint").alias("words"), F.array(F.array(F.get("w", F.lit(0)), F.lit("is"), o)).alias("triples"))
    return retrieval.mentioned(rows).select("doc_id", "words")


# parts as foods: amounts as text with a decimal comma, every third group missing
_FOOD_CELLS = {"TÊN THỨC ĂN": "p_name", "Loại": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END", "Calories (kcal)": "p_size::VARCHAR", "Fat (g)": "replace((p_size / 2.0)::VARCHAR, '.', ',')", "Natri (mg)": "replace(round(p_retailprice / 2, 1)::VARCHAR, '.', ',')", "Chất xơ (g)": "CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE (p_partkey % 7)::VARCHAR END", "Carbonhydrates (g)": "(p_size + 10)::VARCHAR"}


def _food_cells(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    cells = {"TÊN THỨC ĂN": F.col("p_name"), "Loại": F.when(k % 3 == 0, "").otherwise(F.col("p_type")), "Calories (kcal)": F.col("p_size").cast("string"), "Fat (g)": comma(F.col("p_size") / 2), "Natri (mg)": comma(F.round(F.col("p_retailprice") / 2, 1)), "Chất xơ (g)": F.when(k % 4 == 0, "n/a").otherwise((k % 7).cast("string")), "Carbonhydrates (g)": (F.col("p_size") + 10).cast("string")}
    return p.select(k.alias("id"), *[c.alias(n) for n, c in cells.items()])


def _paragraph_sql() -> str:
    """The sentences of foods.py over the cells above."""
    cell = {h: f"c{i}" for i, h in enumerate(_FOOD_CELLS)}
    number = {h: f"coalesce(try_cast(replace({c}, ',', '.') AS DOUBLE), 0)" for h, c in cell.items()}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    name, group = cell[foods.NAME], cell[foods.GROUP]

    def said(template, **fields):
        out = quote(template)
        for k, v in fields.items():
            out = f"replace({out}, '{{{k}}}', {v})"
        return out

    have = [(h, n, t) for h, n, t in foods.SOURCES if h in cell]
    unit = lambda h: h[h.index("(") + 1 : -1]
    held = "concat_ws(', ', " + ", ".join(f"CASE WHEN {number[h]} > 0 THEN {quote(n + ': ')} || replace({cell[h]}, ',', '.') || {quote(' ' + unit(h))} END" for h, n, _ in have) + ")"
    tags = "concat_ws(', ', " + ", ".join(f"CASE WHEN {number[h]} > 0 AND {number[h]} >= {t} THEN {quote(n)} END" for h, n, t in have) + ")"
    n = number
    lines = [
        f"CASE WHEN {group} NOT IN ('', 'None') THEN {said(foods.GROUPED, name=name, group=group)} ELSE {said(foods.UNGROUPED, name=name)} END",
        f"CASE WHEN {held} <> '' THEN {said(foods.HOLDS, name=name, items=held)} END",
        f"CASE WHEN {tags} <> '' THEN {said(foods.SOURCE, name=name, items=tags)} END",
        f"CASE WHEN {n['Natri (mg)']} > 400 THEN {said(foods.SODIUM, name=name, amount=cell['Natri (mg)'])} END",
        f"CASE WHEN {n['Fat (g)']} > 15 THEN {said(foods.FAT, name=name)} END",
        f"CASE WHEN {n['Carbonhydrates (g)']} > 50 THEN {said(foods.CARBS, name=name, amount=cell['Carbonhydrates (g)'])} END",
        f"CASE WHEN {n['Chất xơ (g)']} >= 3 THEN {said(foods.FIBRE, name=name, amount=cell['Chất xơ (g)'])} END",
    ]
    return f"cells AS (SELECT p_partkey AS id, {', '.join(f'{x} AS {cell[h]}' for h, x in _FOOD_CELLS.items())} FROM part), said AS (SELECT id, {tags} AS tags, concat_ws(' ', {', '.join(lines)}) AS paragraph FROM cells)"


_PARAGRAPHS = _paragraph_sql()


@query(f"WITH {_PARAGRAPHS} SELECT id, tags, 'kcal' AS first_unit FROM said")
def threshold_tags(spark, d):
    rows = _food_cells(spark, d)
    return rows.select("id", F.array_join(foods.source_tags(rows), ", ").alias("tags"), T.unit(F.lit(foods.SOURCES[0][0])).alias("first_unit"))


@query(f"WITH {_PARAGRAPHS} SELECT id, paragraph, ((row_number() OVER (ORDER BY id) - 1) // 20)::BIGINT AS paragraph_group FROM said")
def row_paragraph(spark, d):
    rows = _food_cells(spark, d)
    placed = numbered(rows.select("id", foods.paragraph(rows).alias("paragraph")), ["id"], "at")
    return placed.select("id", "paragraph", F.floor(F.col("at") / 20).cast("bigint").alias("paragraph_group"))


@query(r"""SELECT DISTINCT name, trim(replace(lower(name), '_', ' ')) AS form FROM (SELECT s_name || '_' || n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT ' ' || p_name || '_' FROM part)""")
def embedding_text(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("s_name", F.lit("_"), "n_name").alias("name"))
    names = s.unionByName(table(spark, d, "part").select(F.concat(F.lit(" "), "p_name", F.lit("_")).alias("name"))).distinct()
    return names.select("name", cleaning.embedding_text(F.col("name")).alias("form"))


# predictions of which every fifth is no list of triples of three strings; gold ones all are
@query("""SELECT item_id AS line_no, 'it''s | has | w' || item_id AS gold, CASE item_id % 5 WHEN 0 THEN '' ELSE 'it''s | has | v' || item_id || '|"q" | r | s' END AS predicted FROM benchmark WHERE item_id % 5 NOT IN (1, 2, 3)""")
def evaluation_rows(spark, d):
    k = F.col("item_id")
    b = table(spark, d, "benchmark")
    n = k.cast("string")
    good = F.concat(F.lit("[[\"it's\", 'has', 'v"), n, F.lit("'], ['\"q\"', 'r', \"s\"]]"))
    line = F.when(k % 5 == 0, "[]").when(k % 5 == 1, "[['a', 'b']]").when(k % 5 == 2, F.concat(F.lit("[['a', 'b', "), n, F.lit("]]"))).when(k % 5 == 3, "no list").otherwise(good)
    rows = evaluation.evaluation_rows(b.select(k.alias("line_no"), line.alias("text")), b.select(k.alias("line_no"), F.concat(F.lit("[[\"it's\", 'has', 'w"), n, F.lit("']]")).alias("text")))
    return rows.select("line_no", *[F.array_join(c, "|").alias(c) for c in ("gold", "predicted")])


@query(r"""SELECT DISTINCT raw, strip_accents(replace(lower(regexp_replace(regexp_replace(replace(regexp_replace(raw, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), 'đ', 'd')) AS form
FROM (SELECT p_name || 'Món_Đỏ | is_' || p_type || ' | ' || p_brand AS raw FROM part)""")
def normal_triple(spark, d):
    raw = table(spark, d, "part").select(F.concat("p_name", F.lit("Món_Đỏ | is_"), "p_type", F.lit(" | "), "p_brand").alias("raw")).distinct()
    with_note = F.concat("raw", F.lit(" (an_Ý note)"))
    return raw.select("raw", evaluation.normal_triple(with_note).alias("form"))
