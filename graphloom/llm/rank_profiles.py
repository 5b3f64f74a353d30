"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of a language's most frequent letter n-grams, by falling count. A document's own list is compared
with it by the out-of-place distance: for each of its n-grams the difference of the two ranks, or PROFILE where the
language's list lacks it. The language with the least sum is predicted.

N-grams have one to three letters, in lower case, within a word; a blank stands before and after each word. Counts of a
language are summed by Spark over all training documents; only the finished profiles, PROFILE rows a language, go to the
driver and to the workers, so their size follows the number of languages, not of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import batched, lean
from .toxicity_lexicon import fold_of

#: N-grams of a language's profile, and of a document's list.
PROFILE = 400
#: The prediction for texts without a letter.
NONE = "und"
#: Code points and n-grams counted at once; a longer text is counted in parts.
PART = 1 << 20
#: Texts, and texts x languages, of one count at most. Texts are numbered in 16 bits.
TEXTS, CELLS = 1 << 15, 1 << 22

_BLANK, _UNKNOWN = 1, 0xFFFF
#: The code of each code point, filled as they are met.
_codes = np.full(0x110000, _UNKNOWN, np.uint16)


def _code(point: int) -> int:
    """A letter's code: its lower-case form, or for letters beyond 16 bits a place in the private area; else _BLANK."""
    c = chr(point)
    if not c.isalpha():
        return _BLANK
    low = ord(c.lower()) if len(c.lower()) == 1 else point
    return low if low < 0xD800 or 0xF900 <= low < _UNKNOWN else 0xE000 + low % 0x1900


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text of each code): one code a letter, one _BLANK for what stands between words, also of two texts."""
    whole = "\n" + "\n".join(texts) + "\n"
    of = np.append(np.uint16(0), np.repeat(np.arange(len(texts), dtype=np.uint16), [len(t) + 1 for t in texts]))
    codes = np.empty(len(whole), np.uint16)
    for a in range(0, len(whole), PART):
        points = np.frombuffer(whole[a : a + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _codes[points]
        new = c == _UNKNOWN
        if new.any():
            for x in np.unique(points[new]).tolist():
                _codes[x] = _code(x)
            c = _codes[points]
        codes[a : a + PART] = c
    keep = (codes != _BLANK) | np.append(True, codes[:-1] != _BLANK)
    return codes[keep], of[keep]


def counted(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of all n-grams, ascending. An n-gram: three codes of 16 bits, 0 where there is none.

    They are sorted by keys of as few bits as the texts and the codes that occur need.
    """
    alphabet = np.append(0, np.flatnonzero(np.bincount(codes, minlength=1 << 16)))
    bits = int(len(alphabet) - 1).bit_length()
    kind = np.uint32 if 3 * bits + int(of.max(initial=0)).bit_length() <= 32 else np.uint64
    small = np.zeros(1 << 16, kind)
    small[alphabet] = np.arange(len(alphabet))
    blank, up = small[_BLANK], [kind(i * bits) for i in range(4)]
    keys, counts = np.zeros(0, kind), np.zeros(0, np.int64)
    for a in range(0, len(codes), PART):
        c, t = small[codes[a : a + PART + 2]], of[a : a + PART + 2].astype(kind) << up[3]
        n = min(PART, len(codes) - a)
        one = c[:n] != blank
        parts = [(t[:n] | c[:n] << up[2])[one]]
        n = min(n, len(c) - 1)
        two = c[:n] << up[2] | c[1 : n + 1] << up[1]
        parts.append(np.where(one[:n], t[:n], t[1 : n + 1]) | two)
        n = min(n, len(c) - 2)
        if n > 0:
            parts.append((t[1 : n + 1] | two[:n] | c[2 : n + 2])[c[1 : n + 1] != blank])
        every = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        new, size = every[first], np.diff(first, append=len(every))
        if len(keys):
            both = np.concatenate([keys, new])
            order = np.argsort(both, kind="stable")
            both, size = both[order], np.concatenate([counts, size])[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            new, size = both[first], np.add.reduceat(size, first)
        keys, counts = new, size
    each = [alphabet[(keys >> up[i] & kind((1 << bits) - 1)).astype(np.int64)] for i in (2, 1, 0)]
    return (keys >> up[3]).astype(np.int64), each[0] << 32 | each[1] << 16 | each[2], counts


def ranked(text: np.ndarray, gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank from 0) of each text's PROFILE most frequent n-grams; ties by the n-gram's codes.

    text ascends, and gram within it.
    """
    first = np.append(True, text[1:] != text[:-1])
    order = np.argsort((text << 32) - counts, kind="stable")
    rank = np.arange(len(text)) - np.maximum.accumulate(np.where(first, np.arange(len(text)), 0))
    top = rank < PROFILE
    return text[top], gram[order][top], rank[top]


def pieces(texts: list[str], rows: int = TEXTS):
    """(first, texts) of about PART code points and of rows texts at most."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if i > a and (n + len(t) > PART or i - a >= rows):
            yield a, texts[a:i]
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, texts[a:]


class Profiles:
    """Languages, in order of code points, and what each of their n-grams' ranks is."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        """rows: (language, n-gram, rank)."""
        self.langs = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        rows = sorted((g, number[x], r) for x, g, r in rows)
        gram = np.array([r[0] for r in rows], np.int64)
        self.lang, self.rank = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        self.grams, self.first = np.unique(gram, return_index=True)
        self.first = np.append(self.first, len(gram)).astype(np.int64)

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(out-of-place distance of each text to each language, n-grams of each text's list)."""
        text, gram, rank = ranked(*counted(*letters(texts)))
        n = np.bincount(text, minlength=len(texts))
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        known = np.flatnonzero(self.grams[at] == gram) if len(self.grams) else np.zeros(0, np.int64)
        at, text, rank = at[known], text[known], rank[known]
        size = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(text, size) * len(self.langs) + self.lang[entry]
        nearer = np.bincount(cell, np.abs(np.repeat(rank, size) - self.rank[entry]) - PROFILE, len(texts) * len(self.langs))
        return PROFILE * n[:, None] + nearer.reshape(len(texts), -1), n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text: the nearest one, the first of equals; 1 - its distance as a share of the largest."""
        if not self.langs:
            return [NONE] * len(texts), np.zeros(len(texts))
        out, scores = [], []
        for _, some in pieces([t or "" for t in texts], max(1, min(TEXTS, CELLS // len(self.langs)))):
            far, n = self.distances(some)
            best = far.argmin(1)
            out += [self.langs[b] if k else NONE for b, k in zip(best.tolist(), n.tolist(), strict=True)]
            scores.append(np.where(n > 0, 1 - far[np.arange(len(some)), best] / np.maximum(1, PROFILE * n), 0.0))
        return out, np.concatenate(scores) if scores else np.zeros(0)


def learn(docs: DataFrame, train: Column) -> Profiles:
    """The profiles of all languages that rows passing train name. Null texts and languages teach nothing."""

    def work(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, some in pieces(texts):
                names = langs[first : first + len(some)]
                known = sorted(set(names))
                number = np.array([known.index(x) for x in names], np.uint16)
                codes, of = letters(some)
                lang, gram, n = counted(codes, number[of])
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.string()).take(pa.array(lang)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    rows = batched(docs).where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = rows.mapInArrow(lean(work), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("rank", place - 1).where(F.col("rank") < PROFILE)
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in top.collect()])


def languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, learned from its rows outside the held-out fold.

    lang_pred is a language that a training row names (nothing is guessed from source, lang or id of the row itself), or
    "und", with score 0, if the text is null, empty or without a letter, or if no row teaches. Null ids are not held out and
    teach nothing. Equal distances: the first language by code point. Texts are counted whole, whatever their length.
    Repeated rows are predicted each; other columns are ignored; an empty table gives no rows.
    """
    fold = fold_of(F.col("doc_id"), folds)
    profiles = learn(docs, fold != held)

    def work(batches):
        for b in batches:
            lang, score = profiles.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = batched(docs).select(F.col("doc_id").cast("long"), "text", F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(lean(work), "doc_id bigint, held_out boolean, lang_pred string, score double")
