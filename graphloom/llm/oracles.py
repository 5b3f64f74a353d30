"""DuckDB SQL of the queries that SQL can express. Generated from the operators' fixed values."""

from __future__ import annotations

from .divergence_rules import MAX_CHARS, MAX_WORDS, MIN_CHARS, MIN_WORDS, REFERENCES
from .license_diagonals import COVER, DRIFT, LEAST_VOTES, PHRASES, SHORT, TEMPLATES, words_of

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def near_duplicates() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id"""


def wand_search() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""WITH q AS (SELECT item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '{term}')) AS t FROM benchmark),
qt AS (SELECT item_id, t, count(*) AS reps FROM q GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_ASCII_LOWER}, '{term}') AS w FROM documents),
n AS (SELECT row, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
p AS (SELECT row, t, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY 1), s),
i AS (SELECT row, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS score FROM p JOIN w USING (t) JOIN n USING (row), s),
r AS (SELECT item_id, row, sum(reps * score)::BIGINT AS score FROM qt JOIN i USING (t) GROUP BY ALL HAVING sum(reps * score) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r JOIN n USING (row) QUALIFY rank <= 10"""


def source_mix() -> str:
    return rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS bits FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT x.level FROM v x WHERE x.cap >= x.level * x.w ORDER BY x.cap / x.w, x.source NULLS LAST LIMIT 1) AS fill FROM v),
t AS (SELECT source, source_size, CASE WHEN fill IS NULL THEN cap ELSE least(cap, fill * w) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, whole, target - whole * p.source_size AS left_,
  sum(size) OVER (PARTITION BY d.source ORDER BY bits) AS upto, sum(size) OVER (PARTITION BY d.source, bits) AS tie, count(*) OVER (PARTITION BY d.source, bits) AS tied, row_number() OVER (PARTITION BY d.source, bits) AS place FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (least(whole + CASE WHEN left_ > 0 AND (upto <= left_ OR (upto - tie <= left_ AND place <= ceil(round((left_ - (upto - tie)) * tied / tie - 0.5, 6)))) THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken FROM c"""


def divergence_rules() -> str:
    count = lambda c, pattern: f"length({c}) - length(regexp_replace({c}, '{pattern}', '', 'g'))"
    text = "coalesce(text, '')"
    every = sorted({x for _, words in REFERENCES.values() for x in words})
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (p[i] + q[i])) ELSE 0 END"
    distance = lambda p, q: f"(SELECT sqrt(greatest(0, sum({part('p[i]')} + {part('q[i]')}) / 2)) FROM (SELECT {p} AS p, {q} AS q), range(1, len({q}) + 1) g(i))"
    listed = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
    langs = list(REFERENCES)
    most = "greatest(" + ", ".join(f"in_{k}" for k in langs) + ")"
    nearest = "least(" + ", ".join(f"far_{k}" for k in langs) + ")"
    language = "coalesce(" + ", ".join([f"CASE WHEN {most} > 0 AND in_{k} = {most} THEN '{k}' END" for k in langs] + [f"CASE WHEN far_{k} = {nearest} THEN '{k}' END" for k in langs]) + ")"
    by_language = lambda f: "CASE language " + " ".join(f"WHEN '{k}' THEN {f(k)}" for k in langs) + " END"
    words = {k: list(REFERENCES[k][1]) for k in langs}
    expected = {k: [*REFERENCES[k][1].values(), 1 - sum(REFERENCES[k][1].values())] for k in langs}
    return rf"""WITH a AS (SELECT row_number() OVER () AS row, doc_id, {text} AS t, regexp_extract_all({text}, '{_WORD}') AS w,
  list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
dup AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, s) > 1),
cov AS (SELECT row, count(DISTINCT i + k) AS n FROM dup, range(0, 3) r(k) GROUP BY 1),
b AS (SELECT a.row, doc_id, t, w, len(w)::BIGINT AS n_words, length(t)::DOUBLE AS n_chars, ({count('t', r'[\x20\x09-\x0D]')})::DOUBLE AS blank,
  ({count('t', '[a-z]')})::DOUBLE AS low, ({count('t', '[A-Z]')})::DOUBLE AS up, ({count('t', '[0-9]')})::DOUBLE AS digit, ({count('t', '[#*$%&|<>]')})::DOUBLE AS symbol, ({count('t', "[.,;:!?''\"()\\-]")})::DOUBLE AS stop, ({count('t', r'[\x00-\x7F]')})::DOUBLE AS ascii,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, list_filter(w, lambda x: x IN ({', '.join(map(_text, every))})) AS common FROM a LEFT JOIN cov ON cov.row = a.row),
c AS (SELECT *, CASE WHEN n_chars > 0 THEN list_transform([low, up, digit, stop, ascii - low - up - digit - stop - blank, blank, n_chars - ascii], lambda x: x / n_chars) END AS chars,
  {', '.join(f"len(list_filter(common, lambda x: x IN ({', '.join(map(_text, words[k]))}))) AS in_{k}" for k in langs)} FROM b),
e AS (SELECT *, {', '.join(f"{distance('chars', listed(REFERENCES[k][0]))} AS far_{k}" for k in langs)} FROM c),
f AS (SELECT *, {language} AS language FROM e),
h AS (SELECT *, {by_language(lambda k: f"far_{k}")} AS far, CASE WHEN n_words > 0 THEN list_transform({by_language(lambda k: '[' + ', '.join(map(_text, words[k])) + ']')}, lambda v: len(list_filter(common, lambda x: x = v)) / n_words::DOUBLE) END AS found, {by_language(lambda k: listed(expected[k]))} AS expected FROM f),
j AS (SELECT *, list_append(found, 1 - list_sum(found)) AS seen FROM h),
k AS (SELECT *, CASE WHEN n_chars >= {MIN_CHARS} THEN far END AS char_distance, CASE WHEN n_words >= {MIN_WORDS} THEN {distance('seen', 'expected')} END AS word_distance, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, (n_chars - blank)::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {MAX_CHARS} AND coalesce(word_distance, 0) <= {MAX_WORDS} AS kept, language, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM k"""


def license_scan() -> str:
    rows = []
    for base, (label, text) in [*((True, (v, k)) for k, v in PHRASES.items()), *((False, t) for t in TEMPLATES)]:
        words = words_of(text)
        rows += [f"({_text(a)}, {_text(b)}, {_text(f'{label}:{text[:40]}')}, {_text(label)}, {str(base).lower()}, {len(words) - 1}, {i})" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return rf"""WITH p(w1, w2, template, label, is_base, length, place) AS (VALUES {', '.join(rows)}),
a AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT row, w, unnest(range(0, len(w) - 1)) AS pos FROM a WHERE len(w) > 1),
v AS (SELECT row, template, label, is_base, length, pos - place AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM x JOIN p ON w[pos + 1] = w1 AND w[pos + 2] = w2 GROUP BY row, template, label, is_base, length, pos - place
  HAVING CASE WHEN is_base THEN count(*) = length ELSE count(*) >= least({LEAST_VOTES}, length) END),
m AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS near FROM (SELECT *, CASE WHEN is_base OR diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {DRIFT} THEN 1 ELSE 0 END AS new FROM v)),
b AS (SELECT *, sum(back) OVER (PARTITION BY row, template, near ORDER BY lo, diagonal) AS span FROM (SELECT *, CASE WHEN lo > lag(hi) OVER o AND lo - diagonal > lag(hi - diagonal) OVER o THEN 0 ELSE 1 END AS back FROM m WINDOW o AS (PARTITION BY row, template, near ORDER BY lo, diagonal))),
s AS (SELECT row, template, label, is_base, length, near, span, sum(votes)::DOUBLE / length AS cover, min(lo) AS lo, max(hi) AS hi, min(diagonal) AS first FROM b GROUP BY row, template, label, is_base, length, near, span),
g AS (SELECT *, is_base OR (cover >= CASE WHEN length < {SHORT} THEN 1.0 ELSE {COVER} END AND hi - lo + 1 <= 2 * length) AS good FROM s)
SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word, max(first) FILTER (is_base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (good)), ','), '') AS labels, coalesce(max(cover) FILTER (good), 0) AS score
FROM a LEFT JOIN g USING (row) GROUP BY row, doc_id, w"""
