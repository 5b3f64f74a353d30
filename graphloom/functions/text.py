"""Column functions over text: cleaning, sentences, literals, model answers. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() takes off, as far as ASCII goes; Spark's trim() takes off blanks only.
EDGE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
# Lines of scientific articles that are no prose.
SKIPPED_LINES = [r"^Hướng dẫn Chế độ ăn uống", r"^Katsumi", r"Nutrients \d{4},", r"^\d+/\d+$", r"^\[\d"]
# Units and titles whose full stop ends no sentence.
UNITS = "g|mg|kg|ml|kcal|vs|Dr|PGS|GS"
# What a model may put before a resolved passage.
ANSWER_PREFIXES = ["Đoạn đã xử lý:", "Đoạn văn đã xử lý:"]
LITERALS = {"allowBackslashEscapingAnyCharacter": "true"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def decimal(c: Column, missing: float | None = None) -> Column:
    """A comma-decimal string as double; what is missing or no number becomes missing (None: null)."""
    x = strip(F.replace(c, F.lit(","), F.lit("."))).try_cast("double")
    return x if missing is None else F.coalesce(x, F.lit(float(missing)))


def clean_lines(c: Column, skipped: list[str] = SKIPPED_LINES) -> Column:
    """Non-empty lines, stripped, without those that match a pattern, joined by blanks."""
    lines = F.transform(F.split(c, "\r\n|\r|\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("|".join(f"(?:{p})" for p in skipped))), " ")


def sentences(c: Column, least: int = 10) -> Column:
    """Sentences longer than least characters, cut after . ! ? and white space, but not in decimals or after units."""
    x = F.regexp_replace(F.regexp_replace(c, r"(\d)\.(\d)", "$1<DOT>$2"), rf"\b({UNITS})\.\s", "$1<DOT> ")
    parts = F.transform(F.split(strip(x), r"(?<=[.!?])\s+"), strip)
    return F.transform(F.filter(parts, lambda s: F.length(s) > least), lambda s: F.replace(s, F.lit("<DOT>"), F.lit(".")))


def chunked(parts: Column, size: int = 3, glue: str = " ") -> Column:
    """An array joined in groups of size; the last may be short."""
    starts = lambda p: F.when(F.size(p) > 0, F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size))).otherwise(F.array().cast("array<bigint>"))
    return let(parts, lambda p: F.transform(starts(p), lambda i: F.array_join(F.slice(p, (i * size + 1).cast("int"), F.lit(size)), glue)))


def without_prefix(c: Column, prefixes: list[str] = ANSWER_PREFIXES) -> Column:
    return strip(F.regexp_replace(strip(c), "^(?:" + "|".join(prefixes) + ")", ""))


# A quoted string of a literal, with escapes.
_QUOTED = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
_TRIPLE = rf"\[\s*{_QUOTED}\s*,\s*{_QUOTED}\s*,\s*{_QUOTED}\s*,?\s*\]"


def is_triple_list(c: Column) -> Column:
    """Whether a line is a list of lists of three strings each; null is not."""
    return F.coalesce(c.rlike(rf"^\s*\[\s*(?:{_TRIPLE}\s*(?:,\s*{_TRIPLE}\s*)*,?\s*)?\]\s*$"), F.lit(False))


def triple_literals(c: Column) -> Column:
    """A line's triples, from a list of lists or one flat list, as array<array<string>>; anything else gives none."""
    nested = F.from_json(c, "array<array<string>>", LITERALS)
    flat = F.from_json(c, "array<string>", LITERALS)
    found = F.when(c.rlike(r"^\s*\[\s*\["), nested).when(c.rlike(r"^\s*\[\s*['\"]"), F.array(flat))
    return F.filter(F.coalesce(found, F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3)


def clean_triple_literals(c: Column) -> Column:
    """As triple_literals, nested lists only, members stripped, triples with an empty member dropped."""
    kept = F.when(c.rlike(r"^\s*\[\s*\["), triple_literals(c)).otherwise(F.array().cast("array<array<string>>"))
    return F.filter(F.transform(kept, lambda t: F.transform(t, strip)), lambda t: F.forall(t, lambda x: x != ""))


def answer_triples(c: Column) -> Column:
    """The innermost bracketed lists of a model's answer that are three strings, none of them empty or '_'."""
    lists = F.transform(F.regexp_extract_all(c, F.lit(r"\[[^\[\]]*\]"), F.lit(0)), lambda x: F.from_json(x, "array<string>", LITERALS))
    return F.filter(lists, lambda t: (F.size(t) == 3) & F.forall(t, lambda e: e.isNotNull() & (e != "") & (e != "_")))


def answer_entities(c: Column) -> Column:
    """The first bracketed list of a model's answer; none where there is no list."""
    return F.coalesce(F.from_json(F.regexp_extract(c, r"\[[^\]]*\]", 0), "array<string>", LITERALS), F.array().cast("array<string>"))


def definition_rows(c: Column) -> Column:
    """(name, definition) structs of 'name: definition' lines in order, without 'Answer'. A later name wins over an earlier."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.contains(":"))
    rows = F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, r"^([^:]*):", 1)).alias("name"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("definition")))
    rows = F.filter(rows, lambda r: r["name"] != "Answer")
    # names sorted with their places, so that a place is its name's last where the next one has another name
    last = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["name"] != x["name"], F.lit(True)))
    placed = lambda r: F.array_sort(F.transform(r, lambda x, i: F.struct(x["name"].alias("name"), i.alias("at"), x["definition"].alias("definition"))))
    ordered = lambda s: F.array_sort(F.transform(last(s), lambda x: F.struct(x["at"], x["name"], x["definition"])))
    return F.transform(let(placed(rows), ordered), lambda x: F.struct(x["name"], x["definition"]))


def first_json_array(c: Column) -> Column:
    return F.coalesce(F.from_json(F.regexp_extract(c, r"(?s)\[.*?\]", 0), "array<string>"), F.array().cast("array<string>"))


def choices(options: Column) -> Column:
    """'A. first', 'B. second', ... and last 'None of the above.', one a line."""
    letter = lambda i: F.char(i + 65)
    listed = F.transform(options, lambda x, i: F.concat(letter(i), F.lit(". "), x))
    return F.concat(F.array_join(F.concat(listed, F.array(F.concat(letter(F.size(options)), F.lit(". None of the above.")))), "\n"), F.lit("\n"))


def chosen(answer: Column, options: Column) -> Column:
    """The option named by the answer's first letter; null for any other answer."""
    at = F.ascii(F.substring(answer, 1, 1)) - 64
    return F.when((at >= 1) & (at <= F.size(options)), F.get(options, at - 1))


def choices_of(options: list[str | None]) -> str:
    """As choices(), of one list."""
    listed = [f"{chr((i + 65) % 256)}. {x}" for i, x in enumerate(options) if x is not None]
    return "\n".join([*listed, f"{chr((len(options) + 65) % 256)}. None of the above."]) + "\n"


def chosen_of(answer: str | None, options: list[str]) -> str | None:
    """As chosen(), of one answer."""
    at = ord(answer[0]) - 64 if answer else 0
    return options[at - 1] if 1 <= at <= len(options) else None


def fill(template: str, **values: Column) -> Column:
    """template with each {name} of values replaced; braces in the values stay as they are. A null value is empty."""
    parts = re.split("(" + "|".join(r"\{" + k + r"\}" for k in values) + ")", template) if values else [template]
    named = {"{" + k + "}": F.coalesce(v, F.lit("")) for k, v in values.items()}
    return F.concat(*[named.get(p, F.lit(p)) for p in parts if p])


def instructed(task: str, query: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def unit(name: Column) -> Column:
    return F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1)


def evaluation_form(c: Column) -> Column:
    """camelCase and '_' as words, white space collapsed, lower case."""
    x = F.regexp_replace(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.lower(strip(F.regexp_replace(x, r"\s+", " ")))


def without_parenthesis(c: Column) -> Column:
    return F.regexp_replace(c, r"^(.*?)\s\(.*?\)$", "$1")


def has_run(part: Column, whole: Column) -> Column:
    """Place (from 0) where the array part stands in the array whole, or null."""

    def places(x: Column) -> Column:
        last = F.size(x["w"]) - F.size(x["p"])
        return F.when((last >= 0) & (F.size(x["p"]) > 0), F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(x["w"], i + 1, F.size(x["p"])) == x["p"]))

    return F.get(let(F.struct(part.alias("p"), whole.alias("w")), places), F.lit(0))
