"""Quality rules: Jensen-Shannon distance of a document's histograms to language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shares of characters (a-z, A-Z, digits, sentence signs, other ASCII signs, white space, other characters)
# and of the commonest words among all words, per language.
REFERENCES = {
    "en": ((0.785, 0.025, 0.005, 0.022, 0.003, 0.158, 0.002), {"the": 0.060, "of": 0.034, "and": 0.028, "to": 0.026, "in": 0.022, "a": 0.022, "is": 0.011, "that": 0.010, "it": 0.009, "on": 0.008}),
    "fr": ((0.765, 0.022, 0.005, 0.024, 0.003, 0.156, 0.025), {"de": 0.045, "la": 0.028, "le": 0.021, "et": 0.021, "les": 0.020, "des": 0.018, "un": 0.012, "en": 0.014, "que": 0.012, "du": 0.011}),
    "de": ((0.765, 0.050, 0.005, 0.024, 0.003, 0.138, 0.015), {"der": 0.031, "die": 0.032, "und": 0.027, "in": 0.017, "den": 0.012, "das": 0.011, "zu": 0.012, "ist": 0.009, "von": 0.011, "mit": 0.009}),
    "es": ((0.775, 0.022, 0.005, 0.022, 0.003, 0.158, 0.015), {"de": 0.060, "la": 0.037, "que": 0.028, "el": 0.027, "en": 0.026, "y": 0.025, "los": 0.017, "las": 0.011, "un": 0.010, "por": 0.009}),
}
#: Distances above these fail; histograms of shorter texts are not judged.
MAX_CHARS, MAX_WORDS = 0.30, 0.34
MIN_CHARS, MIN_WORDS = 200, 60

_ALL = sorted({w for _, words in REFERENCES.values() for w in words})


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _numbers(xs) -> str:
    return "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"


def js_distance(p: str, q: str) -> str:
    """SQL: the Jensen-Shannon distance (root of the divergence in bits) of two arrays of shares."""
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (x + y)) ELSE 0D END"
    return f"sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (x, y) -> ({part('x')} + {part('y')}) / 2), 0D, (s, d) -> s + d)))"


def repeats(df: DataFrame) -> DataFrame:
    """df (with words and n_words) with n_repeat_words: words in 3-word windows that the text holds twice or more.

    Windows are compared by whole 64-bit hashes, whatever the text's length: where a text has equal ones, (hash, place)
    is sorted once, and equal neighbours mark their windows.
    """
    df = df.withColumn("w", F.expr("transform(words, x -> xxhash64(x))"))
    df = df.withColumn("g", F.expr("CASE WHEN n_words >= 3 THEN transform(slice(w, 1, cast(n_words - 2 AS int)), (h, i) -> xxhash64(h, w[i + 1], w[i + 2])) ELSE array() END"))
    df = df.withColumn("s", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (h, i) -> struct(h, cast(i AS bigint) AS i))) END"))
    same = "x.h = get(s, {}).h"
    df = df.withColumn("d", F.expr(f"sort_array(transform(filter(s, (x, i) -> coalesce({same.format('i - 1')}, false) OR coalesce({same.format('i + 1')}, false)), x -> x.i))"))
    covered = "aggregate(transform(d, (x, i) -> least(3L, coalesce(get(d, i + 1) - x, 3L))), 0L, (s, x) -> s + x)"
    return df.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).drop("w", "g", "s", "d")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, language, char_distance,
    word_distance) of every row.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. kept: not base_failed, and both
    histograms near the reference of the language whose common words the text holds most of (the nearest by characters
    where none is found). Texts under MIN_CHARS or MIN_WORDS are not judged by that histogram: its distance is null.
    Null and empty texts have no words and fail the base rule; an empty table gives no rows. Texts are counted whole, in
    time that grows with their length as a sort does. Each row is judged alone: repeated rows, null ids and
    extra columns change nothing, and no row is moved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("lines", F.expr(r"filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # each step leaves fewer characters for the next
    counts = []
    df = df.withColumn("t0", F.col("text"))
    for i, kind in enumerate((r"[a-z]+", r"[A-Z]+", r"[\x20\x09-\x0D]+", r"[0-9]+", r"[#*$%&|<>]+", r"[.,;:!?'\"()\-]+", r"[\x00-\x7F]+")):
        df = df.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", kind, "")).withColumn(f"c{i}", (F.length(f"t{i}") - F.length(f"t{i + 1}")).cast("double"))
        counts.append(f"c{i}")
    df = df.withColumn("n_chars_", F.length("text")).withColumn("c7", F.length("t7").cast("double"))
    df = repeats(df)
    df = df.withColumn("common", F.expr(f"filter(words, x -> x IN ({_quoted(_ALL)}))"))
    for k, (_, words) in REFERENCES.items():
        df = df.withColumn(f"in_{k}", F.expr(f"size(filter(common, x -> x IN ({_quoted(words)})))"))
    shares = F.expr("transform(array(c0, c1, c3, c5, c4 + c6, c2, c7), x -> x / n_chars_)")
    df = df.withColumn("chars", F.when(F.col("n_chars_") > 0, shares))
    for k, (chars, _) in REFERENCES.items():
        df = df.withColumn(f"far_{k}", F.expr(js_distance("chars", _numbers(chars))))
    most = F.greatest(*[F.col(f"in_{k}") for k in REFERENCES])
    nearest = F.least(*[F.col(f"far_{k}") for k in REFERENCES])
    language = F.coalesce(*[F.when((most > 0) & (F.col(f"in_{k}") == most), F.lit(k)) for k in REFERENCES], *[F.when(F.col(f"far_{k}") == nearest, F.lit(k)) for k in REFERENCES])
    df = df.withColumn("language", language)
    lists, expected = F.lit(None), F.lit(None)
    for k, (_, words) in REFERENCES.items():
        lists = F.when(F.col("language") == k, F.expr(f"array({_quoted(words)})")).otherwise(lists)
        expected = F.when(F.col("language") == k, F.expr(_numbers([*words.values(), 1 - sum(words.values())]))).otherwise(expected)
    df = df.withColumn("list", lists).withColumn("expected", expected)
    found = "transform(list, v -> size(filter(common, x -> x = v)) / n_words)"
    df = df.withColumn("found", F.when(F.col("n_words") > 0, F.expr(found)))
    df = df.withColumn("seen", F.expr("concat(found, array(1D - aggregate(found, 0D, (s, x) -> s + x)))"))
    far = F.coalesce(*[F.when(F.col("language") == k, F.col(f"far_{k}")) for k in REFERENCES])
    df = df.withColumn("char_distance", F.when(F.col("n_chars_") >= MIN_CHARS, far)).withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, F.expr(js_distance("seen", "expected"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHARS) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORDS)
    return df.select("doc_id", "n_words", (F.col("n_chars_") - F.col("c2")).cast("long").alias("word_chars"), F.col("c4").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "language", "char_distance", "word_distance")


