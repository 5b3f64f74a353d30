"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, scores normalised by length.

The lexicon is a fixed list of insults plus entries learned from labelled documents: beginnings of words that stand in
toxic documents far more often than in others. An entry matches where a word begins; whole-word entries also need the
word to end. Folding maps homoglyphs to plain letters, and in words that hold letters also digits and signs that stand
for letters, and keeps every place; a 1 is read both as i and as l.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, bounded, lean

# Insults that count without any label, whole words.
INSULTS = """idiot moron imbecile stupid loser scum trash garbage worthless pathetic disgusting clown dumb fool jerk
crap bastard bitch asshole retard pig filth vermin scumbag idiota imbécil estúpido basura asqueroso patético payaso
escoria dummkopf idiotisch abschaum widerlich erbärmlich versager imbécile débile ordure pathétique dégoûtant
minable""".split()
# Phrases in which an entry is no insult.
EXCEPTIONS = """trash can;trash bin;trash bag;trash collection;garbage can;garbage truck;garbage collection;garbage collector;
clown fish;class clown;circus clown;dumb bell;dumb waiter;guinea pig;pig farm;fool proof;april fool;pond scum;soap scum""".replace("\n", "").split(";")

# Signs that stand for letters, and letters of other scripts that look like Latin ones.
_SIGNS = dict(zip("013457@$!", "oieastasi", strict=True))
_ALIKE = dict(zip("аеорсухіјѕԁһկոսΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhknuabezhikmnoptyxaeiknoptuxabekmhopctyxijs", strict=True))
_WIDE = {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}
_FOLD = str.maketrans(_ALIKE | _WIDE)
_FOLD_U = str.maketrans("уУυΥ", "uuuu")
_FOLD_SIGNS = str.maketrans(_SIGNS)
_FOLD_SIGNS_L = str.maketrans(_SIGNS | {"1": "l", "!": "l"})
_needs = re.compile("[" + "".join(map(re.escape, _ALIKE)) + "！-～]").search
# a sign that stands before a letter of its word, with another letter before or behind
_signed = re.compile(r"[013457@$!]+[^\W\d_]").search
_round = re.compile("[уУυΥ]").search
_word = re.compile(r"[^\s]+")
_ones = re.compile(r"[^\W\d_][1!]+[^\W\d_]|(?<!\S)[1!]+[^\W\d_]").search


#: Toxic documents that an entry must show for each other document that it hits.
PENALTY = 1.0
#: Toxic documents, and log odds, from which an entry is taken even where others speak for its documents.
SURE_DOCS, SURE_ODDS = 4, 2.5


def _plain(word: str, table: dict) -> str:
    """word with its signs read as letters, but for those after its last letter; words of one letter stay."""
    last = next((i for i in range(len(word) - 1, -1, -1) if word[i].isalpha()), -1)
    if sum(c.isalpha() for c in word) < 2 or not _signed(word):
        return word
    return word[: last + 1].translate(table) + word[last + 1 :]


def _letters(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # a few capitals grow when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_FOLD) if _needs(low) else low


def fold(text: str, signs: dict = _FOLD_SIGNS) -> str:
    """Lower case, homoglyphs and in-word signs replaced; every character keeps its place."""
    low = _letters(text)
    return _word.sub(lambda m: _plain(m[0], signs), low) if _signed(low) else low


def readings(text: str) -> list[str]:
    """The text's readings, as long as the text: letters alone, and with signs as letters, a 1 as i and as l. Letters that
    look like y are read as y and as u."""
    out = [_letters(text)]
    if _round(text):
        out.append(_letters(text.translate(_FOLD_U)))
    if _signed(out[0]):
        tables = (_FOLD_SIGNS, _FOLD_SIGNS_L) if _ones(out[0]) else (_FOLD_SIGNS,)
        out += [_word.sub(lambda m, t=t: _plain(m[0], t), low) for low in list(out) for t in tables]
    return out


def doubled(word: str) -> set[str]:
    """word with one of its vowels twice, as signs often stand twice."""
    return {word[:i] + c + word[i:] for i, c in enumerate(word) if c in "aeio" and word[i - 1 : i] != c and word[i + 1 : i + 2] != c}


class Lexicon:
    """Entries with weights in one automaton; whole: entries that must end with the word, and may also have a vowel twice
    where signs stand for letters."""

    def __init__(self, weights: dict[str, float], whole: set[str], exceptions: list[str] = EXCEPTIONS):
        self.auto = ahocorasick.Automaton()
        for e in sorted(whole & weights.keys()):
            for d in doubled(e) - weights.keys():
                self.auto.add_word(d, (d, weights[e], True, True))
        for e, w in weights.items():
            self.auto.add_word(e, (e, w, e in whole, False))
        for e in exceptions:
            self.auto.add_word(e, (e, 0.0, None, False))
        self.auto.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, entry, weight), the longest entry at each word's beginning, without those in exception phrases."""
        if not text:
            return []
        found: dict[int, tuple[int, int, str, float]] = {}
        free: list[tuple[int, int]] = []
        n = len(text)
        every = readings(text)
        for low in every:
            for last, (e, w, whole, signs) in self.auto.iter(low):
                end = last + 1
                start = end - len(e)
                if start and low[start - 1].isalpha():
                    continue
                if whole is None:
                    if end == n or not low[end].isalpha():
                        free.append((start, end))
                    continue
                if (whole and end < n and low[end].isalpha()) or (signs and every[0][start:end] == e):
                    continue
                have = found.get(start)
                if have is None or end > have[1]:
                    found[start] = (start, end, e, w)
        return [m for _, m in sorted(found.items()) if not any(a <= m[0] and m[1] <= b for a, b in free)]

    def features(self, text: str | None) -> list[float]:
        found = self.matches(text)
        length = len(text or "") / 6 + 1
        total = sum(m[3] for m in found)
        kinds = {}
        for m in found:
            kinds[m[2]] = max(kinds.get(m[2], 0.0), m[3])
        return [float(bool(found)), min(math.log1p(total), 5.0), min(200 * total / (length + 100), 12.0), min(sum(kinds.values()), 20.0) / 4, math.log(length) / 3]


def _beginnings(text: str) -> set[str]:
    words = {w.strip(".,;:!?\"'()*&%$#|") for w in fold(text).split()}
    return {w[:k] for w in words for k in range(4, min(len(w), 9) + 1)} | {f"{w} " for w in words if 3 <= len(w) <= 20}


def learn_lexicon(texts: list[str], toxic: np.ndarray, least: int = 3, entries: int = 300) -> tuple[dict[str, float], set[str]]:
    """Weights of INSULTS and of beginnings (or, with a blank at the end, whole words) that toxic texts hold far more often.

    Greedy: the entry that tells most goes first, and documents that hold it no longer speak for the next; then the surest
    of the others.
    """
    # texts are cut again in each pass: their beginnings together would not fit the driver
    up, down = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        if y:
            up.update(_beginnings(t))
    up = Counter({t: a for t, a in up.items() if a >= least})
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            down.update(_beginnings(t) & up.keys())
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    weights: dict[str, float] = {w: 3.0 for w in INSULTS}
    whole = set(INSULTS)
    good = {t: odds(a, down[t]) for t, a in up.items() if odds(a, down[t]) > 2 and a > down[t]}
    where: dict[str, list[int]] = {t: [] for t in good}
    for i, (t, y) in enumerate(zip(texts, toxic, strict=True)):
        if y:
            for e in _beginnings(t) & good.keys():
                where[e].append(i)
    open_ = {i for i, y in enumerate(toxic) if y}
    gain = {t: len(where[t]) - PENALTY * down[t] for t in good}
    heap = sorted(good, key=lambda t: (-gain[t], -len(t), t))
    while heap and len(weights) < entries + len(INSULTS):
        t = heap[0]
        docs = [i for i in where[t] if i in open_]
        if gain[t] < least:
            break
        rest = len(docs) - PENALTY * down[t]
        if rest < gain[t]:
            gain[t] = rest
            if rest < least:
                heap.pop(0)
            else:
                heap.sort(key=lambda t: (-gain[t], -len(t), t))
            continue
        heap.pop(0)
        word = t.rstrip(" ")
        weights[word] = max(weights.get(word, 0.0), min(good[t], 6.0))
        whole.discard(word)
        if t.endswith(" "):
            whole.add(word)
        open_ -= set(docs)
    # entries that tell as surely, though others already speak for their documents here: held-out texts may have them alone
    for t in sorted(good, key=lambda t: (len(t), t)):
        word = t.rstrip(" ")
        known = any(word[:k] in weights and word[:k] not in whole for k in range(3, len(word) + 1))
        if up[t] >= SURE_DOCS and good[t] > SURE_ODDS and not known:
            weights[word] = max(weights.get(word, 0.0), min(good[t], 6.0))
            if t.endswith(" "):
                whole.add(word)
            else:
                whole.discard(word)
    return weights, whole


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    keep = np.full(len(b), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - keep * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, bound: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of at most bound training rows of each label, those with the smallest hash of their id.

    Ids are chosen first, so only the sample's texts are read by the driver; of several texts of an id the smallest
    counts. Weights restore the labels' shares.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(train)
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in shares:
        one = rows.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(bound)
        picked = one if picked is None else picked.unionByName(one)
    if picked is None:
        return [], np.zeros(0), np.zeros(0)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(bounded(picked, 16), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], float)
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    return [r["text"] for r in got], y, np.array([shares[int(k)] / n[int(k)] for k in y])


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, train, bound: int = 1500) -> tuple[Lexicon, np.ndarray]:
    """A lexicon and the logistic weights of its features, from at most bound labelled rows of each label that pass train.

    Half of the sample teaches the lexicon that the other half is scored with, and the other way round, so that the
    weights do not trust chance entries; then the whole sample teaches the final one.
    """
    texts, y, weight = labelled_sample(docs, labels, "toxic", train, bound)
    if len(set(y.tolist())) < 2:
        return Lexicon({w: 3.0 for w in INSULTS}, set(INSULTS)), np.array([2.0, 0.5, 0.5, 0.5, 0.0, -3.0])
    half = np.arange(len(texts)) % 2 == 0
    x = np.zeros((len(texts), 5))
    for side in (half, ~half):
        own = Lexicon(*learn_lexicon([t for t, s in zip(texts, side, strict=True) if s], y[side]))
        for i in np.flatnonzero(~side):
            x[i] = own.features(texts[i])
    return Lexicon(*learn_lexicon(texts, y)), fit_logistic(x, y, weight / weight.mean())


def scorer(lexicon: Lexicon, coefficients: np.ndarray):
    """A column function from texts to scores from 0 to 1. Only the text goes to the worker, once; rows stay with Spark.

    Null and empty texts score as texts without matches.
    """
    b = np.asarray(coefficients)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def work(parts):
            for texts in parts:
                x = np.array([lexicon.features(t) for t in (v.as_py() for v in texts)]).reshape(-1, 5)
                yield pa.array(1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30))))

        yield from lean(work)(batches)

    return F.arrow_udf(each, "double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.3, bound: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learned from labels outside the held-out fold.

    Only the text is scored. Repeated rows score alike; labels without a document, null labels and null ids teach
    nothing; without labels of both kinds the fixed list alone is used. Null and empty texts score as texts without
    matches; of overlapping entries the automaton's longest at a place counts, and equal texts score alike, so there are no
    ties to break. Texts are scored whole, whatever their length. Other columns are ignored; an empty table gives no rows.
    """
    lexicon, b = fit(docs, labels, fold_of(F.col("doc_id"), folds) != held, bound)
    scored = batched(docs).select("doc_id", scorer(lexicon, b)("text").alias("score"))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.3, bound: int = 1500) -> DataFrame:
    """docs' rows, all columns, that score below cut.

    Null and empty texts score as texts without matches, so they stay wherever such texts do; repeated rows all stay or all
    go; an empty table gives no rows.
    """
    lexicon, b = fit(docs, labels, fold_of(F.col("doc_id"), folds) != held, bound)
    return batched(docs).where(scorer(lexicon, b)("text") < cut)
