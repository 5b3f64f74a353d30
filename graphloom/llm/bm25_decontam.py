"""Benchmark decontamination: BM25 over an inverted index of test items, every training passage a query.

An item's score is divided by the score that its own text gets, so one threshold holds for all items. A posting list is
sorted by item and cut into blocks with their largest impact. Retrieval returns all items at or above the threshold:

* Items are filtered by a safe bound first, for a whole batch of passages at once: an item's lightest terms, which sum
  to less than SLACK, are assumed present; only the impacts of its other terms are added up.
* Passages with an item left are run against the index by block-max WAND.

Items of more than SEGMENT words are indexed in pieces of at most SEGMENT words, as even as can be, each normalised by the
score of its own words; a piece at or above the threshold retrieves its item.

Items retrieved are verified as a whole: the question's and the answer's word 3-grams must stand in the passage and what is
next to it. A part of one or two words counts as one gram of that length. Where neither part has three words, single words
would prove nothing: the item's words must stand there as a run, in order. An item whose question or answer has no word has
nothing to overlap and is never reported.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, bounded, chunks, lean, mix, word_hashes, written

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SLACK = 0.12
#: A passage is two neighbouring segments, so every run of SEGMENT words, and with it every piece, lies in one passage.
SEGMENT = 64
BLOCK = 16
#: Share of an item's question and of its answer that must be found.
QUESTION, ANSWER = 0.5, 0.5
#: Bytes of test items that one index holds; more items make more indexes, each run over all passages.
INDEX_BYTES = 8 << 20


def _grams(h: np.ndarray, n: int = 3) -> np.ndarray:
    n = min(n, len(h))
    if n == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total += h[i : i + len(total)] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return mix(total)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last line or, in an item of one line, the last sentence or, in one, the second half."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    body = text.strip()
    cut = max(body.rstrip(".!? ").rfind(x) for x in (". ", "! ", "? "))
    if cut > 0:
        return body[: cut + 1], body[cut + 2 :]
    words = body.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def _stands(words: np.ndarray, run: np.ndarray) -> bool:
    """Whether the few words of run stand one after the other."""
    n = len(words) - len(run) + 1
    if n <= 0:
        return False
    ok = np.ones(n, bool)
    for j, x in enumerate(run):
        ok &= words[j : j + n] == x
    return bool(ok.any())


def _hashes(text: str) -> np.ndarray:
    return word_hashes([text.encode("utf-8", "surrogatepass")], True)[0]


def statistics(items: list[tuple[int, str]]) -> tuple[int, float, dict[int, int]]:
    """(items with words, mean length of a piece, items that hold each term)."""
    hashed = [h for h in (_hashes(t) for _, t in items) if len(h)]
    pieces = sum(-(-len(h) // SEGMENT) for h in hashed)
    return len(hashed), sum(map(len, hashed)) / max(1, pieces), Counter(t for h in hashed for t in set(h.tolist()))


class Index:
    """Pieces' normalised BM25 impacts by term, and the items they are of. Items without words in question or answer are
    left out.

    known: the statistics of all items, of which these may be a part.
    """

    def __init__(self, items: list[tuple[int, str]], known: tuple[int, float, dict[int, int]] | None = None):
        hashed = [(i, _hashes(t), [_hashes(x) for x in split_item(t)]) for i, t in items]
        hashed = [x for x in hashed if all(map(len, x[2]))]
        self.ids = [x[0] for x in hashed]
        self.lengths = np.array([len(x[1]) for x in hashed], np.int64)
        pieces = [(i, p) for i, (_, h, _) in enumerate(hashed) for p in np.array_split(h, -(-len(h) // SEGMENT))]
        self.item_of = [i for i, _ in pieces]
        lengths = np.array([len(p) for _, p in pieces], np.int64)
        n, mean, df = known or statistics(items)
        mean = max(1.0, mean)
        counts = [Counter(p.tolist()) for _, p in pieces]
        terms = sorted({t for c in counts for t in c})
        self.terms = np.array(terms, np.uint64)
        number = {t: k for k, t in enumerate(terms)}
        idf = np.array([np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms])
        lists: list[list[tuple[int, float]]] = [[] for _ in terms]
        light = np.zeros(len(pieces))
        heavy: list[list[tuple[int, float]]] = [[] for _ in terms]
        for i, c in enumerate(counts):
            w = {number[t]: idf[number[t]] * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[i] / mean)) for t, f in c.items()}
            own = sum(w.values()) or 1.0
            for k, x in sorted(w.items(), key=lambda p: (p[1], p[0])):
                lists[k].append((i, x / own))
                if light[i] + x / own < SLACK:
                    light[i] += x / own
                else:
                    heavy[k].append((i, x / own))
        self.light = light
        self.postings = [(np.array([i for i, _ in sorted(p)], np.int64), np.array([x for _, x in sorted(p)])) for p in lists]
        self.tops = [float(p[1].max()) for p in self.postings]
        self.plain = [(p[0].tolist(), p[1].tolist()) for p in self.postings]
        self.block_ends = [p[0][BLOCK - 1 :: BLOCK] if len(p[0]) % BLOCK == 0 else np.append(p[0][BLOCK - 1 :: BLOCK], p[0][-1]) for p in self.postings]
        self.block_ends = [x.tolist() for x in self.block_ends]
        self.block_tops = [np.maximum.reduceat(p[1], np.arange(0, len(p[1]), BLOCK)).tolist() for p in self.postings]
        self.heavy_at = np.cumsum([0, *(len(p) for p in heavy)])
        self.heavy_item = np.array([i for p in heavy for i, _ in p], np.int64)
        self.heavy_impact = np.array([x for p in heavy for _, x in p])
        bits = np.zeros(1 << 20, bool)
        bits[self.terms & np.uint64((1 << 20) - 1)] = True
        self.bits = bits
        # grams of question and answer, and the whole where single words prove nothing
        self.parts = [(np.unique(_grams(q)), np.unique(_grams(a)), h if max(len(q), len(a)) < 3 else None) for _, h, (q, a) in hashed]

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, term numbers) of the words that are terms."""
        at = np.flatnonzero(self.bits[h & np.uint64((1 << 20) - 1)])
        k = np.searchsorted(self.terms, h[at])
        k[k == len(self.terms)] = 0
        real = self.terms[k] == h[at] if len(self.terms) else np.zeros(len(at), bool)
        return at[real], k[real]

    def wand(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (piece, score) at or above the threshold for a passage with these distinct terms, by block-max WAND."""
        end = len(self.item_of)
        items = [self.plain[t][0] for t in terms]
        impacts = [self.plain[t][1] for t in terms]
        at = [0] * len(terms)
        now = [p[0] for p in items]
        order = sorted(range(len(terms)), key=now.__getitem__)
        out = []

        def go(c: int, item: int) -> None:
            at[c] = bisect_left(items[c], item, at[c])
            now[c] = items[c][at[c]] if at[c] < len(items[c]) else end

        while True:
            bound, pivot = 0.0, -1
            for p, c in enumerate(order):
                if now[c] == end:
                    break
                bound += self.tops[terms[c]]
                if bound >= threshold - 1e-9:
                    pivot = p
                    break
            if pivot < 0:
                return out
            item = now[order[pivot]]
            while pivot + 1 < len(order) and now[order[pivot + 1]] == item:
                pivot += 1
            near, limit = 0.0, end
            for c in order[: pivot + 1]:
                ends = self.block_ends[terms[c]]
                b = bisect_left(ends, item)
                if b < len(ends):
                    near += self.block_tops[terms[c]][b]
                    limit = min(limit, ends[b] + 1)
            if near >= threshold - 1e-9:
                if now[order[0]] == item:
                    score = 0.0
                    for c in order[: pivot + 1]:
                        score += impacts[c][at[c]]
                        go(c, item + 1)
                    if score >= threshold - 1e-9:
                        out.append((item, score))
                else:
                    for c in order[:pivot]:
                        if now[c] < item:
                            go(c, item)
            else:
                # no item before the nearest block's end or the next list's item can reach the threshold
                if pivot + 1 < len(order):
                    limit = min(limit, now[order[pivot + 1]])
                for c in order[: pivot + 1]:
                    go(c, max(limit, item + 1))
            order.sort(key=now.__getitem__)

    def hits(self, h: np.ndarray, counts: np.ndarray):
        """(document, item, first word of the passage, score) of every verified item in a batch of documents."""
        starts = np.cumsum(counts) - counts
        at, term = self.numbers(h)
        if not len(at):
            return
        doc = np.searchsorted(starts, at, "right") - 1
        # empty documents share their start with the next one; the last of equal starts owns the word
        segments = np.maximum(1, -(-counts // SEGMENT))
        base = np.cumsum(segments) - segments
        seg = base[doc] + (at - starts[doc]) // SEGMENT
        both = np.unique(seg * np.int64(len(self.terms)) + term)
        seg, term = both // len(self.terms), both % len(self.terms)
        n = self.heavy_at[term + 1] - self.heavy_at[term]
        from_ = np.repeat(self.heavy_at[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(seg, n) * np.int64(len(self.item_of)) + self.heavy_item[from_]
        pair, place = np.unique(key, return_inverse=True)
        part = np.bincount(place, self.heavy_impact[from_], len(pair))
        # a passage sums its two segments; its heavy terms may all stand in the second one
        pieces = len(self.item_of)
        inner = ~np.isin(pair // pieces, base)
        passage = np.union1d(pair, pair[inner] - pieces)
        bound = self.light[passage % pieces]
        for side in (passage, passage + pieces):
            k = np.searchsorted(pair, side)
            k[k == len(pair)] = 0
            bound = bound + np.where(pair[k] == side, part[k], 0.0) if len(pair) else bound
        live = np.unique(passage[bound >= THRESHOLD - 1e-9] // pieces)
        lo, hi = np.searchsorted(seg, live), np.searchsorted(seg, live + 2)
        mid = np.searchsorted(seg, live + 1)
        owner = np.searchsorted(base, live, "right") - 1
        last = base[owner] + segments[owner] - 1
        done: dict[tuple[int, int], tuple] = {}
        for s, a, m, b, d, z in zip(live.tolist(), lo.tolist(), mid.tolist(), hi.tolist(), owner.tolist(), last.tolist(), strict=True):
            found = self.wand(np.unique(term[a : b if s < z else m]).tolist())
            if not found:
                continue
            first = int(starts[d]) + (s - int(base[d])) * SEGMENT
            for piece, score in found:
                item = self.item_of[piece]
                if done.get((d, item), (0, -1.0))[1] >= score:
                    continue
                reach = max(SEGMENT, int(self.lengths[item]))
                words = h[max(int(starts[d]), first - reach) : min(int(starts[d] + counts[d]), first + 2 * SEGMENT + reach)]
                q, x, run = self.parts[item]
                if run is not None and not _stands(words, run):
                    continue
                q_over, a_over = (float(np.isin(g, np.concatenate([_grams(words, k) for k in (1, 2, 3)])).mean()) for g in (q, x))
                if q_over >= QUESTION and a_over >= ANSWER:
                    done[d, item] = (first - int(starts[d]), score, q_over, a_over)
        for (d, item), x in done.items():
            yield d, self.ids[item], *x


def _search(index: Index):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage_start", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def work(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, encoded in chunks(b.column(1).to_pylist()):
                rows = [(ids[first + d], *x) for d, *x in index.hits(*word_hashes(encoded, True))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return work


_FOUND = "doc_id bigint, item_id bigint, passage_start bigint, score double, question_overlap double, answer_overlap double"


def _terms(items: DataFrame) -> DataFrame:
    """(term, words) of each item with words: its distinct terms; its number of words stands with the first of them."""

    def work(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                h = _hashes(t)
                u = np.unique(h)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.where(np.arange(len(u)) == 0, len(h), 0))], names=["term", "words"])

    return items.select("text").mapInArrow(lean(work), "term bigint, words bigint")


def _all_statistics(items: DataFrame) -> tuple[tuple[int, float], DataFrame]:
    """What statistics() gives, of a table of items: the numbers, and a table (term, df)."""
    terms = _terms(items)
    r = terms.where("words > 0").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum(F.ceil(F.col("words") / SEGMENT)).alias("pieces")).first()
    df = written(terms.groupBy("term").agg(F.count("*").alias("df")), "df")
    return (r["n"], (r["words"] or 0) / max(1, r["pieces"] or 0)), df


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage_start, score, question_overlap, answer_overlap): every document and test item in it.

    score: of the document's best passage for the item, as a share of the item's score for its own text, or, for an item
    of more than SEGMENT words, of its best piece's score for its own words; the overlaps are shares of the whole item's
    word 3-grams. Words are runs of ASCII letters and digits and of all other characters, A-Z in lower
    case. Null and empty texts, on either side, hold and match nothing; rows with a null id report it as null; repeated
    rows are reported each. Items without a question or an answer are never reported; items of which neither part has three
    words only where they stand as a run (see the module's text). passage_start is the first word of the best passage, the
    first of equally good ones. Other columns are ignored; no items or no documents give no rows. Texts are searched whole,
    whatever their length.

    The items are dealt by hash into parts of at most about INDEX_BYTES. A part is indexed on the driver with the
    statistics of all items, shipped to the workers and run over all documents; where there are several, each part's
    rows are written before the next one is built, so the driver never holds more than one.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-size // INDEX_BYTES)
    docs = batched(docs).select(F.col("doc_id").cast("long"), "text")
    out, known = None, None
    if parts > 1:
        items = written(items.distinct(), "items")
        total, terms = _all_statistics(items)
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).distinct()
        rows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if parts > 1:
            df = terms.join(bounded(_terms(part).select("term").distinct(), 16), "term").collect()
            known = (*total, {r["term"] & (1 << 64) - 1: r["df"] for r in df})
        index = Index(rows, known)
        if not index.ids:
            continue
        one = docs.mapInArrow(lean(_search(index)), _FOUND)
        one = written(one, "found") if parts > 1 else one
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], _FOUND) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs' rows, all columns, that hold no test item.

    Rows with a null id, and null and empty texts, stay; of repeated rows all stay or none. An empty table of docs gives no
    rows, one of items all rows of docs.
    """
    found = written(leaks(docs, items).where("doc_id IS NOT NULL").select("doc_id").distinct(), "leaks")
    return docs.join(bounded(found, 16), "doc_id", "left_anti").select(*docs.columns)
