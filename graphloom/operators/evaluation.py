"""Scores of extracted triples against gold ones, retrieval measures and latency statistics."""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right, insort
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from graphloom.functions.text import evaluation_form, is_triple_list, let, triple_literals, without_parenthesis


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def macro_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(precision, recall, f1): unweighted means over classes (lower-cased triples) of (entry, triple); 0 for 0 / 0."""
    g = gold.select("entry", F.lower("triple").alias("triple")).distinct().withColumn("g", F.lit(1))
    p = predicted.select("entry", F.lower("triple").alias("triple")).distinct().withColumn("p", F.lit(1))
    both = g.join(p, ["entry", "triple"], "full")
    hit = lambda c: F.sum(c.cast("int"))
    c = both.groupBy("triple").agg(hit(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), hit(F.col("g").isNull()).alias("fp"), hit(F.col("p").isNull()).alias("fn"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.agg(F.avg(pr).alias("precision"), F.avg(rc).alias("recall"), F.avg(f1(pr, rc)).alias("f1"))


def length_filter(entries: DataFrame, most: int) -> DataFrame:
    """Entries whose numbers of gold and predicted triples differ by most at the most."""
    return entries.where(F.abs(F.size("gold") - F.size("predicted")) <= most)


def span_totals(pairs: DataFrame) -> DataFrame:
    """(tag, correct, incorrect, missed, spurious, possible, actual, precision, recall) of aligned pairs (g, p: s, r, o).

    A part is correct if equal, incorrect if both are there and differ; an absent side makes it missed or spurious.
    """
    names = {"SUB": "s", "PRED": "r", "OBJ": "o"}
    tags = pairs.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"g.{c}").alias("g"), F.col(f"p.{c}").alias("p")) for t, c in names.items()])).alias("x")).select("x.*")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    out = tags.groupBy("tag").agg(
        n(F.col("g") == F.col("p")).alias("correct"), n(F.col("g") != F.col("p")).alias("incorrect"), n(F.col("p").isNull() & F.col("g").isNotNull()).alias("missed"), n(F.col("g").isNull() & F.col("p").isNotNull()).alias("spurious"), n(F.col("g").isNotNull()).alias("possible"), n(F.col("p").isNotNull()).alias("actual")
    )
    return out.withColumns({"precision": ratio(F.col("correct"), F.col("actual")), "recall": ratio(F.col("correct"), F.col("possible"))})


def hit_rate(ranked: DataFrame, k: int) -> DataFrame:
    """(hit_rate, precision, recall at k) of rows (q, rank, relevant, total_relevant)."""
    q = ranked.where(F.col("rank") <= k).groupBy("q").agg(F.sum(F.col("relevant").cast("int")).alias("n"), F.max("total_relevant").alias("all"))
    return q.agg(F.avg((F.col("n") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("n") / F.lit(k)).alias("precision_at_k"), F.avg(ratio(F.col("n"), F.col("all"))).alias("recall_at_k"))


#: Ranges of values that are counted at once for each percentile.
RANGES = 1024


def nearest_ranks(df: DataFrame, value: str, shares: list[float], ranges: int = RANGES) -> list[float | None]:
    """For each share the value of rank ceil(share * n) among the n values that are not null, as doubles; None without any.

    Selection by histograms: the values are counted in ranges of equal width between least and largest, and only the range
    that holds the rank, from its least to its largest value, is counted again, until that is one value. Each pass reads the
    values between those bounds only and returns at most that many counts, whatever the number of values. NaN is larger
    than all others.
    """
    v = F.col(value).cast("double")
    nan, up, down = F.isnan(v), v == float("inf"), v == float("-inf")
    finite = F.when(~nan & ~up & ~down, v)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    r = df.where(v.isNotNull()).agg(F.count("*").alias("n"), count(down).alias("low"), count(up).alias("high"), count(nan).alias("nan"), F.min(finite).alias("least"), F.max(finite).alias("most")).first()
    found: list[float | None] = [None] * len(shares)
    open_: dict[int, tuple[int, float, float]] = {}
    for i, share in enumerate(shares):
        rank = max(1, math.ceil(share * r["n"]))
        if not r["n"]:
            continue
        if rank <= r["low"]:
            found[i] = float("-inf")
        elif rank <= r["n"] - r["high"] - r["nan"]:
            open_[i] = (rank - r["low"], r["least"], r["most"])
        else:
            found[i] = float("inf") if rank <= r["n"] - r["nan"] else float("nan")
    while open_:
        for i in [i for i, (_, least, most) in open_.items() if least == most]:
            found[i] = open_.pop(i)[1]
        if not open_:
            break
        inside, places = F.lit(False), []
        for i, (_, least, most) in open_.items():
            here = (v >= least) & (v <= most)
            inside = inside | here
            # in halves where the difference is more than a double holds
            share = (v - least) / (most - least) if most - least < float("inf") else (v / 2 - least / 2) / (most / 2 - least / 2)
            at = F.least(F.floor(share * ranges), F.lit(ranges - 1))
            places.append(F.when(here, F.struct(F.lit(i).alias("i"), at.alias("at"))))
        counts = df.where(inside).select(v.alias("v"), F.explode(F.array_compact(F.array(*places))).alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        by = sorted((x["p"]["i"], x["p"]["at"], x["n"], x["least"], x["most"]) for x in counts.collect())
        for i, (rank, _, _) in list(open_.items()):
            for _, _, n, least, most in (x for x in by if x[0] == i):
                if rank <= n:
                    open_[i] = (rank, least, most)
                    break
                rank -= n
    return found


def latency(df: DataFrame, value: str) -> DataFrame:
    """Mean, extremes and nearest-rank percentiles."""
    p95, p99 = nearest_ranks(df, value, [0.95, 0.99])
    said = lambda x: F.lit(x).cast("double")
    return df.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).withColumns({"p95": said(p95), "p99": said(p99)})


# --- what SQL cannot express: assignments, alignments, folding -------------------------------------------------------


#: Characters of a text that are folded at once.
FOLD_CHARS = 1 << 16


def _folded(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))
    # marks that a piece begins with are dropped like all others, so that pieces can be folded one by one
    return "".join(fold(text[n : n + FOLD_CHARS]) for n in range(0, len(text), FOLD_CHARS))


@arrow_udf(StringType())
def ascii_fold(s: pa.Array) -> pa.Array:
    """Letters without their marks; đ and Đ, which carry none, become d and D."""
    return pa.array((_folded(x.as_py()) for x in s), s.type)


def word_tokens(c: Column) -> Column:
    """Words of letters, digits and marks; punctuation is dropped."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def align_runs(reference: list[str], candidate: list[str]) -> list[tuple[int, int, int]]:
    """(start in reference, start in candidate, length) of equal runs, longest first, then leftmost in the candidate, then
    in the reference. A word takes part in one run at most.

    Every pair of equal words begins a run; a heap gives the longest one left. A run that others have shortened goes back
    with what is left of it, so each is looked at as often as it is shortened.
    """
    places: dict[str, list[int]] = {}
    for i, w in enumerate(reference):
        places.setdefault(w, []).append(i)
    heap: list[tuple[int, int, int]] = []
    behind: dict[int, int] = {}
    for j in range(len(candidate) - 1, -1, -1):
        here = {i: behind.get(i + 1, 0) + 1 for i in places.get(candidate[j], ())}
        heap += [(-n, j, i) for i, n in here.items()]
        behind = here
    heapify(heap)
    taken: tuple[list[tuple[int, int]], list[tuple[int, int]]] = ([], [])

    def free(side: int, at: int) -> int:
        """Places from at on before the next taken one."""
        k = bisect_right(taken[side], (at, 1 << 60))
        if k and taken[side][k - 1][1] > at:
            return 0
        return taken[side][k][0] - at if k < len(taken[side]) else 1 << 60

    out = []
    while heap:
        n, j, i = heappop(heap)
        left = min(-n, free(0, i), free(1, j))
        if left < -n:
            if left:
                heappush(heap, (-left, j, i))
            continue
        insort(taken[0], (i, i + left))
        insort(taken[1], (j, j + left))
        out.append((i, j, left))
    return out


def best_assignment(score: list[list[float]]) -> tuple[float, list[int]]:
    """The largest sum of score[i][p[i]] over permutations p; ties go to the smallest p.

    Up to 14 rows by subsets, which visits 2^n states in place of n! orders; beyond, by augmenting paths.
    """
    n = len(score)
    if n > 14:
        return _augmented(score)

    @cache
    def best(i: int, used: int) -> float:
        return 0.0 if i == n else max(score[i][j] + best(i + 1, used | 1 << j) for j in range(n) if not used >> j & 1)

    total, used, order = best(0, 0), 0, []
    for i in range(n):
        goal = best(i, used)
        j = next(j for j in range(n) if not used >> j & 1 and score[i][j] + best(i + 1, used | 1 << j) >= goal - 1e-12)
        order.append(j)
        used |= 1 << j
    return total, order


def _augmented(score: list[list[float]]) -> tuple[float, list[int]]:
    """Shortest augmenting paths with potentials, on negated scores."""
    n = len(score)
    row_of, u, v = [-1] * (n + 1), [0.0] * n, [0.0] * (n + 1)
    for i in range(n):
        row_of[n], j = i, n
        low, back, seen = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while row_of[j] != -1:
            seen[j], r, step, nxt = True, row_of[j], float("inf"), -1
            for k in range(n):
                if not seen[k]:
                    d = -score[r][k] - u[r] - v[k]
                    if d < low[k]:
                        low[k], back[k] = d, j
                    if low[k] < step:
                        step, nxt = low[k], k
            for k in range(n + 1):
                if seen[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                elif k < n:
                    low[k] -= step
            j = nxt
        while j != n:
            row_of[j], j = row_of[back[j]], back[j]
        row_of[n] = -1
    order = [0] * n
    for j in range(n):
        order[row_of[j]] = j
    return sum(score[i][order[i]] for i in range(n)), order


# --- rows and forms of an evaluation ---------------------------------------------------------------------------------


def evaluation_rows(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(line_no, gold, predicted) of two tables of lines (line_no, text), joined by line; triples as 's | r | o'.

    A line goes, with its gold, where the prediction is no list of triples of three strings or the gold is none.
    """
    read = lambda df, name: df.where(is_triple_list(F.col("text"))).select("line_no", F.transform(triple_literals(F.col("text")), lambda t: F.array_join(t, " | ")).alias(name))
    return read(gold, "gold").join(read(predicted, "predicted"), "line_no")


def normal_triple(c: Column) -> Column:
    """A triple 's | r | o' as it is compared: words of camelCase and '_' apart, lower case, without marks on letters and
    without a parenthesis at the end of its last part."""
    last = lambda p: without_parenthesis(F.element_at(p, -1))
    return let(F.split(ascii_fold(evaluation_form(c)), r" \| "), lambda p: F.array_join(F.concat(F.slice(p, F.lit(1), F.size(p) - 1), F.array(last(p))), " | "))
