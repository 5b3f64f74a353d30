"""Periodic runs of words: stretches in which a block of words follows itself again and again.

A run is a stretch whose words repeat with a smallest period q, at least `least` words and `times` periods long, that no
neighbouring word extends. Inside a run every word lies in a k-gram that occurs again q words on, with k the least overlap
of a run with itself (gram_length). So words outside the k-grams that a document repeats are masked, and only what
survives is searched by Main and Lorentz's divide and conquer: a run belongs to the one node of the halving whose centre it
contains; for each period, how far the words agree with those a period on, forward from the centre and backward from it,
gives the run. All nodes of one depth, over all segments of a batch, are worked on at once.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batched, cut, lean, mix

#: What a run needs: words, and periods.
LEAST, TIMES = 6, 4
_B = np.uint64(0x9E3779B97F4A7C15)
PRIME = (1 << 31) - 1


def gram_length(least: int = LEAST, times: int = TIMES) -> int:
    """The shortest overlap that a run has with itself, moved on by its period: its k-grams of that length occur twice."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document holds twice or more. doc: each word's document, ascending."""
    n = len(words) - k + 1
    covered = np.zeros(len(words) + 1, np.int64)
    if n <= 0:
        return covered[:-1].astype(bool)
    h = mix(doc[:n].astype(np.uint64) + np.uint64(1))
    for j in range(k):
        h = h * _B + words[j : j + n].astype(np.uint64)
    h = mix(h)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice & (doc[:n] == doc[k - 1 :]))
    covered[at] += 1
    covered[at + k] -= 1
    return np.cumsum(covered)[:-1] > 0


def segments(mask: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of every stretch of at least that many marked words of one document."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, doc[1:] != doc[:-1])
    before = np.append(False, mask[:-1]) & ~new
    after = np.append(mask[1:], False) & ~np.append(new[1:], True)
    first, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    long = end - first >= least
    return first[long], end[long]


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo PRIME for i up to n."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out


class _Stretches:
    """Tells whether stretches of words are equal, by two running hashes: modulo 2**64, and modulo a prime for words whose
    pattern cancels itself there."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        h = mix(words.astype(np.uint64))
        self.power = np.full(n + 1, _B, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        self.total = np.append(np.uint64(0), np.cumsum(h * self.power[:n], dtype=np.uint64))
        self.second = _powers(48271, n)
        some = (h >> np.uint64(34)) * self.second[:n] % np.uint64(PRIME)
        self.sums = np.append(np.uint64(0), np.cumsum(some, dtype=np.uint64) % np.uint64(PRIME))

    def same(self, a: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words from a on are, for size words, those from a + p on."""
        t, k = self.total, np.uint64(PRIME)
        ok = (t[a + size] - t[a]) * self.power[p] == t[a + p + size] - t[a + p]
        at = np.flatnonzero(ok)
        a, p, size, t = a[at], p[at], size[at], self.sums
        ok[at] = (t[a + size] + k - t[a]) % k * self.second[p] % k == (t[a + p + size] + k - t[a + p]) % k
        return ok


def _reach(most: np.ndarray, agrees) -> np.ndarray:
    """The largest size up to most for which agrees(size), for each of many."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        half = (low + high + 1) >> 1
        ok = agrees(half)
        low, high = np.where(ok, half, low), np.where(ok, high, half - 1)
    return low


def main_lorentz(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, ascending. lo, hi: the bounds of each word's segment; no run leaves one.

    Equal stretches are found by hashes; the runs are confirmed on the words themselves.
    """
    n = len(words)
    same = _Stretches(words).same
    found = []
    half = 1
    while half < n:
        centre = np.arange(half, n, 2 * half)
        centre = centre[lo[centre] < centre]
        periods = np.minimum(2 * half, hi[centre] - lo[centre]) // times
        m = np.repeat(centre, periods)
        p = np.arange(1, len(m) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
        # half of the run's periods, or more, lie on one side of the centre: that side agrees over all but one of them
        sure = (times * p + 1) // 2 - p
        for right in (True, False):
            fits = m + p + sure <= hi[m] if right else m - p - sure >= lo[m]
            q, s, c = p[fits], sure[fits], m[fits]
            ok = same(c if right else c - q - s, q, s)
            q, s, c = q[ok], s[ok], c[ok]
            while len(q):
                # the smallest period of each centre first: what lies in its run with two periods or more is the same run
                now = np.append(True, c[1:] != c[:-1]) if times >= 4 else np.ones(len(c), bool)
                x, pq, pc = (c if right else c - q)[now], q[now], c[now]
                on = _reach(hi[pc] - x - pq, lambda size, x=x, pq=pq: same(x, pq, size))
                back = _reach(x - lo[pc], lambda size, x=x, pq=pq: same(x - size, pq, size))
                good = on + back + pq >= np.maximum(least, times * pq)
                found.append(np.stack([(x - back)[good], (on + back + pq)[good], pq[good]]))
                of = np.cumsum(now) - 1
                inside = c + q + s <= (x + on + pq)[of] if right else c - q - s >= (x - back)[of]
                left = ~now & ~(inside & (s >= pq[of]))
                q, s, c = q[left], s[left], c[left]
        half *= 2
    if not found:
        return []
    start, length, period = np.concatenate(found, 1)
    order = np.lexsort((period, length, start))
    out = {}
    for s, z, q in zip(start[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True):
        if (s, z) in out:  # a multiple of the smallest period
            continue
        if not np.array_equal(words[s : s + z - q], words[s + q : s + z]):
            return plain_runs(words, lo, hi, least, times)  # two stretches of the same hashes
        out[s, z] = q
    return sorted((s, z, q) for (s, z), q in out.items())


def plain_runs(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """What main_lorentz gives, by comparing all words at every period."""
    out: dict[tuple[int, int], int] = {}
    for a in np.flatnonzero(np.append(True, lo[1:] != lo[:-1])).tolist():
        w = words[a : int(hi[a])]
        for q in range(1, len(w) // times + 1):
            equal = np.concatenate([[False], w[q:] == w[:-q], [False]])
            edge = np.flatnonzero(equal[1:] != equal[:-1])
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s + q >= max(least, times * q):
                    out.setdefault((a + s, e - s + q), q)
    return sorted((s, z, q) for (s, z), q in out.items())


def runs_of(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs, text without the repeats in them, words joined by one space) of each text, in UTF-8."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    first = np.cumsum(counts) - counts
    number: dict[bytes, int] = {}
    fresh = count()
    words = np.fromiter((number.setdefault(w, i) for w, i in zip(chain.from_iterable(split), fresh)), np.int64, int(counts.sum()))
    del number
    doc = np.repeat(np.arange(len(texts)), counts)
    begin, end = segments(repeated(words, doc, gram_length(least, times)), doc, least)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(begin):
        size = end - begin
        base = np.cumsum(size) - size
        shift = np.repeat(begin - base, size)
        place = np.arange(len(shift)) + shift
        for s, z, q in main_lorentz(words[place], np.repeat(base, size), np.repeat(base + size, size), least, times):
            d = int(doc[place[s]])
            runs[d].append((int(place[s]) - int(first[d]), z, q))
    out = []
    for w, r in zip(split, runs, strict=True):
        if r:
            keep = np.zeros(len(w) + 1, np.int64)
            for s, z, q in r:
                keep[s + q] += 1
                keep[s + z] -= 1
            keep = np.cumsum(keep)[:-1] == 0
            w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
        out.append((r, b" ".join(w)))
    return out


_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs by start, then period, and its text without their repeats.

    Words are what stands between ASCII white space, compared byte by byte; collapsed has them joined by one space,
    without those that any run holds after its first period. Null and empty texts have no runs and an empty text. Texts
    are searched whole, whatever their length, in memory of some 20 times the text. Repeated rows and null ids are
    reported each; other columns are ignored; an empty table gives no rows.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at, encoded in cut((v.as_py() or "").encode("utf-8", "surrogatepass") for v in texts):
                found = runs_of(encoded, least, times)
                sizes = np.cumsum([0, *(len(r) for r, _ in found)])
                flat = np.array([x for r, _ in found for x in r], np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(struct))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(found)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each), pa.array([t.decode("utf-8", "surrogatepass") for _, t in found], pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = batched(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lean(work), f"doc_id bigint, runs {_RUNS}, collapsed string")


def with_period(text: Column, doc_id: Column) -> Column:
    """text with a periodic end in the tenth of all documents that their id's checksum h chooses; null ids are left alone.

    Of n words, those from a = g % n on, g = h div 10, become the first p = 1 + (n - a) div (3 + g % 8) of them, repeated.
    """
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)
    # the words are bound to a name, so that they are taken from the text once
    words = F.array(F.struct(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), g.alias("g")))
    bound = F.transform(words, lambda s: F.struct(s["w"].alias("w"), (s["g"] % F.size(s["w"])).cast("int").alias("a"), s["g"].alias("g")))
    bound = F.transform(bound, lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (F.floor((F.size(s["w"]) - s["a"]) / (3 + s["g"] % 8)) + 1).cast("int").alias("p")))
    new = F.transform(bound, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.size(s["w"]) - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]))), " "))
    chosen = (F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(chosen, F.get(new, F.lit(0))).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Per row of periodic_runs(): number of runs, the longest one (ties: smallest start, then period), and checksums."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.withColumn("top", top)
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
