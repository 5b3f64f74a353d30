"""Scores of a predicted triple against a gold one by labelled spans of words, in four modes, and totals over entries.

The words of both triples are laid out on one axis, part by part. A gold part is one span, and what its predicted part
shares with it lies on the same places, so that the spans tell full, partial and missing agreement apart. Spans are
compared in the four modes of SemEval 2013 task 9: by type, by boundaries with credit for overlaps, and exactly with and
without the type.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.evaluation import align_runs, best_assignment
from graphloom.sources.work import saved

TAGS = ("SUB", "PRED", "OBJ")
MODES = ("ent_type", "partial", "strict", "exact")
COUNTS = ("correct", "incorrect", "partial", "missed", "spurious")
_MARKS = re.escape(string.punctuation)
_apart = re.compile(r"([;@#$%&?!()\[\]{}<>\"]|--|\.\.\.)").sub
_stop = re.compile(r"([^.])(\.)([\])}>\"' ]*)\s*$").sub
_pause = re.compile(r"([:,])(?!\d)").sub
_ending = re.compile(r"([^' ])('s|'m|'d|'ll|'re|'ve|n't)(?= |$)").sub


def tokens(text: str) -> list[str]:
    """Words by the conventions of the Penn Treebank: punctuation apart, but not in numbers and abbreviations; endings apart."""
    x = _stop(r"\1 \2 \3", _pause(r" \1 ", _apart(r" \1 ", text.lower())))
    return re.sub(r"([^'])'(?= |$)", r"\1 '", _ending(r"\1 \2", x)).split()


@lru_cache(maxsize=1 << 15)
def _words(text: str, drop: str) -> list[str]:
    """Tokens without those that hold drop; kept for parts that recur, so not to be changed."""
    return [t for t in tokens(text) if not re.search(drop, t)]


@dataclass(frozen=True)
class Span:
    label: str
    start: int
    end: int


@dataclass(frozen=True)
class Layout:
    """Spans of a gold and a predicted part on an axis that is size long; found: they share a word."""

    found: bool
    gold: list[Span]
    predicted: list[Span]
    size: int


def layout(gold: list[str], predicted: list[str], gold_label: str, label: str, base: int) -> Layout:
    """Gold words take neighbouring places from base on; predicted words that are not among them lie behind.

    Runs of shared words lie on their gold words. Predicted words before the first run belong to it where it begins the
    gold part, and words after the last run where it ends it, and lie before and behind the gold part; all others lie at
    the end, each gap between runs as a span of its own. A span is reported again at each gold word that is not found
    behind it, up to there, and at the beginning of the next span.
    """
    g, p = len(gold), len(predicted)
    runs = align_runs(gold, predicted)
    if not runs:
        rest = g if g and p else 0
        return Layout(False, [Span(gold_label, base, base + g - 1)] if g else [], [Span(label, base + rest, base + rest + p - 1)] if p else [], g + p)
    who_gold: list[object] = [None] * g
    who: list[object] = [None] * p
    at = [-1] * p
    for k, (i, j, n) in enumerate(runs):
        who_gold[i : i + n] = [k] * n
        who[j : j + n] = [k] * n
        at[j : j + n] = range(i, i + n)
    first = next(j for j in range(p) if who[j] is not None)
    last = next(j for j in reversed(range(p)) if who[j] is not None)
    before = first if at[first] == 0 else 0
    after = p - 1 - last if at[last] == g - 1 else 0
    gaps: list[object] = []
    passed = 0
    for j in range(before, p - after):
        if who[j] is None:
            gaps.append(("gap", passed))
        else:
            passed += 1
    axis = [who[first]] * before + who_gold + [who[last]] * after + gaps
    # where each span begins: a place that is taken by another one than the last taken place before it
    begins: list[int] = []
    for k, x in enumerate(axis):
        if x is not None and (not begins or axis[begins[-1]] != x):
            begins.append(k)
    spans = []
    for k, nxt in zip(begins, [*begins[1:], len(axis)], strict=True):
        ends = [q - 1 for q in range(k + 1, nxt) if axis[q] is None]
        if nxt < len(axis) or axis[-1] is not None:
            ends.append(nxt - 1)
        spans += [Span(label, base + k, base + e) for e in ends]
    return Layout(True, [Span(gold_label, base + before, base + before + g - 1)], spans, len(axis))


@lru_cache(maxsize=1 << 15)
def _part(gold: str, predicted: str, drop: str, drop_predicted: str, gold_label: str, label: str) -> Layout:
    """layout() of the words of two parts from place 0; kept, as parts recur."""
    return layout(_words(gold, drop), _words(predicted, drop_predicted), gold_label, label, 0)


def _from(part: Layout, base: int) -> Layout:
    moved = lambda spans: [Span(s.label, s.start + base, s.end + base) for s in spans]
    return Layout(part.found, moved(part.gold), moved(part.predicted), part.size) if base else part


def laid_out(gold: str, predicted: str) -> tuple[list[Span], list[Span]]:
    """Spans of two triples 's | r | o', '' for none. Where two parts share no word with their counterparts, they are tried
    crosswise: subject and object, then subject and predicate, then predicate and object."""
    a, b = (t.split(" | ") if t else ["", "", ""] for t in (gold, predicted))
    parts: list[Layout] = []
    for k, tag in enumerate(TAGS):
        parts.append(_from(_part(a[k], b[k], rf"^[{_MARKS}]+$", rf"^[{_MARKS}]$", tag, tag), sum(q.size for q in parts)))
    for i, j in ((0, 2), (0, 1), (1, 2)):
        if parts[i].found or parts[j].found:
            continue
        crossed = list(parts)
        base = sum(q.size for q in parts[:i])
        crossed[i] = _from(_part(a[i], b[j], f"[{_MARKS}]", f"[{_MARKS}]", TAGS[i], TAGS[j]), base)
        between = sum(q.size for q in parts[i + 1 : j])
        crossed[j] = _from(_part(a[j], b[i], f"[{_MARKS}]", f"[{_MARKS}]", TAGS[j], TAGS[i]), base + crossed[i].size + between)
        if crossed[i].found or crossed[j].found:
            if (i, j) == (0, 2):
                # as in the published scores: with subject and object crossed, the predicate's spans are those of the object
                crossed[1] = _from(_part(a[2], b[0], f"[{_MARKS}]", f"[{_MARKS}]", "PRED", "PRED"), crossed[0].size)
            parts = crossed
            break
    return [s for q in parts for s in q.gold], [s for q in parts for s in q.predicted]


def compared(gold: list[Span], predicted: list[Span]) -> dict[tuple[str, str], dict[str, int]]:
    """Counts by (tag or 'ALL', mode): each predicted span against the first gold one that it equals or overlaps."""
    out = {(t, m): dict.fromkeys(COUNTS, 0) for t in ("ALL", *TAGS) for m in MODES}

    def add(tag: str, **said: str) -> None:
        for mode, what in said.items():
            out["ALL", mode][what] += 1
            out[tag, mode][what] += 1

    met: set[Span] = set()
    for p in predicted:
        if p in gold:
            met.add(p)
            add(p.label, **dict.fromkeys(MODES, "correct"))
            continue
        # two spans overlap where they share a place before the last one of each
        hit = next((t for t in gold if (t.start, t.end) == (p.start, p.end) or max(t.start, p.start) < min(t.end, p.end)), None)
        if hit is None:
            add(p.label, **dict.fromkeys(MODES, "spurious"))
            continue
        met.add(hit)
        same_place = (hit.start, hit.end) == (p.start, p.end)
        kind = "correct" if hit.label == p.label else "incorrect"
        add(hit.label, strict="incorrect", ent_type=kind, partial="correct" if same_place else "partial", exact="correct" if same_place else "incorrect")
    for t in gold:
        if t not in met:
            add(t.label, **dict.fromkeys(MODES, "missed"))
    return out


def measured(counts: dict[str, int], mode: str) -> dict[str, float]:
    """counts with possible, actual, precision, recall and f1; partial agreements count half in the modes that know them."""
    possible = counts["correct"] + counts["incorrect"] + counts["partial"] + counts["missed"]
    actual = counts["correct"] + counts["incorrect"] + counts["partial"] + counts["spurious"]
    right = counts["correct"] + (0.5 * counts["partial"] if mode in ("partial", "ent_type") else 0)
    precision, recall = right / actual if actual else 0.0, right / possible if possible else 0.0
    return {**counts, "possible": possible, "actual": actual, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}


@lru_cache(maxsize=4096)
def _counted(gold: str, predicted: str) -> tuple[float, dict[tuple[str, str], dict[str, int]]]:
    """(mean f1 of the four modes, counts by tag and mode) of two triples. A worker keeps the last few thousand pairs, as
    the same ones recur over entries; what it returns is shared and must not be changed."""
    counts = compared(*laid_out(gold, predicted))
    return sum(measured(counts["ALL", mode], mode)["f1"] for mode in MODES) / len(MODES), counts


def pair_score(gold: str, predicted: str) -> tuple[float, dict[tuple[str, str], dict[str, float]]]:
    """(mean f1 of the four modes, measures by tag and mode) of two triples."""
    score, counts = _counted(gold, predicted)
    return score, {k: measured(c, k[1]) for k, c in counts.items()}


def _paired(gold: list[str], predicted: list[str]) -> tuple[float, list[tuple[str, str]]]:
    n = max(len(gold), len(predicted))
    a, b = [*gold, *[""] * (n - len(gold))], [*predicted, *[""] * (n - len(predicted))]
    total, order = best_assignment([[_counted(x, y)[0] for x in a] for y in b])
    return total, [(a[j], b[i]) for i, j in enumerate(order)]


def best_pairs(gold: list[str], predicted: list[str]) -> tuple[float, list[tuple[str, str, dict]]]:
    """(sum of scores, (gold, predicted, measures) of each pair) of the best pairing; the shorter side is filled up with ''."""
    total, pairs = _paired(gold, predicted)
    return total, [(x, y, pair_score(x, y)[1]) for x, y in pairs]


def _key():
    """What entries with the same lists have in common."""
    return F.sha2(F.to_json(F.struct("gold", "predicted")), 256)


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries over all tasks: they are few bytes and much work, so their bytes must not decide how many tasks there are."""
    return entries.select("entry", "gold", "predicted").repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_MEASURES = (*COUNTS, "possible", "actual", "precision", "recall", "f1")


def pair_measures(entries: DataFrame) -> DataFrame:
    """(entry, pair, gold, predicted, tag, mode, counts and measures) of entries (entry, gold, predicted: arrays of
    's | r | o'), for each pair of the best pairing; null lists are empty."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for e, g, p in zip(pdf["entry"], pdf["gold"], pdf["predicted"], strict=True):
                for k, (x, y, m) in enumerate(best_pairs([] if g is None else list(g), [] if p is None else list(p))[1]):
                    rows += [(e, k, x, y, tag, mode, *(v[c] for c in _MEASURES)) for (tag, mode), v in m.items()]
            yield pd.DataFrame(rows, columns=["entry", "pair", "gold", "predicted", "tag", "mode", *_MEASURES])

    counts = ", ".join(f"`{c}` bigint" for c in (*COUNTS, "possible", "actual"))
    kind = entries.schema["entry"].dataType.simpleString()
    return _dealt(entries).mapInPandas(work, f"entry {kind}, pair bigint, gold string, predicted string, tag string, mode string, {counts}, `precision` double, recall double, f1 double")


def system_scores(entries: DataFrame) -> DataFrame:
    """(tag, mode, sums of the counts, means of precision, recall and f1 over pairs): 4 tags x 4 modes. Entries with the same
    lists are scored once and count as often as they occur."""
    once = entries.groupBy(_key().alias("_k")).agg(F.first("gold").alias("gold"), F.first("predicted").alias("predicted"), F.count("*").alias("entry"))
    m, n = pair_measures(once), F.col("entry")
    return m.groupBy("tag", "mode").agg(*[F.sum(F.col(c) * n).alias(c) for c in (*COUNTS, "possible", "actual")], *[(F.sum(F.col(c) * n) / F.sum(n)).alias(c) for c in ("precision", "recall", "f1")])


def assignments(entries: DataFrame) -> DataFrame:
    """(entry, score, gold_n, predicted_n) of entries (entry, gold, predicted: arrays of 's | r | o'): the best pairing's
    mean score over the longer side. Entries with the same lists are scored once."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for e, g, p in zip(pdf["entry"], pdf["gold"], pdf["predicted"], strict=True):
                g, p = [] if g is None else list(g), [] if p is None else list(p)
                rows.append((e, _paired(g, p)[0] / max(len(g), len(p), 1), len(g), len(p)))
            yield pd.DataFrame(rows, columns=["_k", "score", "gold_n", "predicted_n"])

    keyed = saved(entries.select("entry", "gold", "predicted", _key().alias("_k")))
    once = keyed.groupBy("_k").agg(F.first("gold").alias("gold"), F.first("predicted").alias("predicted")).withColumnRenamed("_k", "entry")
    scored = _dealt(once).mapInPandas(work, "_k string, score double, gold_n bigint, predicted_n bigint")
    return keyed.select("entry", "_k").join(scored, "_k").select("entry", "score", "gold_n", "predicted_n")
