"""Language-model scoring with Elias-Fano n-gram tries.

The model is a bigram model with Dirichlet smoothing: P(w | v) = (c(v, w) + MU * P1(w)) / (c(v) + MU), where P1 gives
words of the training texts their share of KNOWN and any other word (1 - KNOWN) / N. Its log is a sum of a part that
depends on w's entries alone and of one that depends on c(v) alone, so the whole corpus is scored after one exchange:

1. A pass counts the training tokens, and the exact counts of a few hot tokens that a hashed sample has shown.
2. Each chunk of documents sends its (token, predecessor, document) triples, packed and sorted, to the token's shard; a
   hot token is spread over several shards by its predecessor.
3. A shard counts its training triples, takes the hot tokens' counts from step 1, builds a trie (token -> predecessors), maps it into memory and looks every
   distinct triple up: word by successor search, then its predecessor by successor search inside the word's pointers.
   It returns each chunk's sums per document.
4. Sums of a chunk meet again and give one row a document.

A trie holds only a shard's tokens, so memory is bounded by the shard's size however large the corpus is.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, chunks, cut, free, lean, word_hashes, written

MU, KNOWN = 200.0, 63 / 64
#: Triples that a shard holds on average, bytes of text of a chunk (a batch at most), bits of a predecessor's hash.
SHARD_TRIPLES, CHUNK, PRIOR_BITS = 2_000_000, 5 << 20, 40
#: A token with more than this share of a shard in the sample is hot; the sample's size in documents.
HOT_SHARE, SAMPLE = 0.25, 2000
_END, _BEGIN = np.uint64(0x51ED270B7F4A7C15), np.uint64(0xD1B54A32D192ED03)
_BYTE_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BYTE_SELECT = np.array([[([b for b in range(8) if i >> b & 1] + [0] * 8)[k] for k in range(8)] for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bits packed, high bits in unary, with a count every 8 bytes."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n) if n else np.zeros(0, np.int64)
        size = (int(high[-1]) + 64) // 64 * 8 if n else 0
        bits = np.zeros(size * 8, np.uint8)
        bits[high] = 1
        bits = np.packbits(bits, bitorder="little")
        counts = np.concatenate([[0], np.cumsum(_BYTE_COUNT[bits].reshape(-1, 8).sum(1))[:-1]]).astype("<u4") if size else np.zeros(0, "<u4")
        low = np.zeros((n * low_bits + 63) // 64 + 2, np.uint64)
        if low_bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            x = values & np.uint64((1 << low_bits) - 1)
            np.bitwise_or.at(low, word, x << shift)
            over = np.flatnonzero(shift + np.uint64(low_bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        return b"".join([struct.pack("<QQQQ", n, low_bits, len(low), size), low.tobytes(), bits.tobytes(), counts.tobytes()])

    @staticmethod
    def read(buffer, at: int) -> tuple[EliasFano, int]:
        n, low_bits, words, size = struct.unpack_from("<QQQQ", buffer, at)
        at += 32
        low = np.frombuffer(buffer, "<u8", words, at)
        high = np.frombuffer(buffer, np.uint8, size, at + 8 * words)
        counts = np.frombuffer(buffer, "<u4", size // 8, at + 8 * words + size)
        return EliasFano(n, low_bits, low, high, counts), at + 8 * words + size + size // 8 * 4

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.counts, i, "right") - 1
        rest = i - self.counts[word]
        at = word * 8
        for _ in range(7):  # the byte of the word that holds the wanted bit
            here = _BYTE_COUNT[self.high[at]]
            on = rest >= here
            if not on.any():
                break
            rest = np.where(on, rest - here, rest)
            at = at + on
        high = (at * 8 + _BYTE_SELECT[self.high[at], rest] - i).astype(np.uint64)
        if not self.low_bits:
            return high
        b = np.uint64(self.low_bits)
        bit = i.astype(np.uint64) * b
        w, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        x = self.low[w] >> shift
        far = shift > np.uint64(0)
        x = np.where(far, x | (self.low[w + 1] << ((np.uint64(64) - shift) & np.uint64(63))), x)
        return (high << b) | (x & np.uint64((1 << self.low_bits) - 1))

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each x, the first place in lo to hi - 1 whose value is not below it, or hi."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = self.get(mid) < x[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each x, or -1."""
        lo = np.zeros(len(x), np.int64) if lo is None else lo
        hi = np.full(len(x), self.n, np.int64) if hi is None else hi
        at = self.successor(x, lo, hi)
        on = np.flatnonzero(at < hi)
        out = np.full(len(x), -1, np.int64)
        here = at[on]
        hit = self.get(here) == x[on] if len(on) else np.zeros(0, bool)
        out[on[hit]] = here[hit]
        return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook of 256): bins of equal width, each read back as the mean of its values."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256, "<f8")
    low, high = float(x.min()), float(x.max())
    codes = np.minimum(255, (x - low) * (256 / max(high - low, 1e-12))).astype(np.int64)
    book = np.bincount(codes, x, 256) / np.maximum(np.bincount(codes, minlength=256), 1)
    return codes.astype(np.uint8), book.astype("<f8")


class Trie:
    """Two levels: words with smoothed values, and each word's predecessors with the values of the pairs.

    Predecessors are numbered in a directory; a word's numbers are stored relative to its own range (word number times
    the directory's size is added), which makes the whole level one monotone sequence. Pointers into it are monotone too.
    """

    def __init__(self, buffer):
        (tag,) = struct.unpack_from("<8s", buffer, 0)
        if tag != b"GLTRIE\0\1":
            raise ValueError("not a trie")
        at, self.levels = 8, []
        for _ in range(4):
            level, at = EliasFano.read(buffer, at)
            self.levels.append(level)
        self.words, self.pointers, self.directory, self.pairs = self.levels
        self.columns = []
        for n in (self.words.n, self.words.n, self.pairs.n):
            self.columns.append((np.frombuffer(buffer, np.uint8, n, at + 2048), np.frombuffer(buffer, "<f8", 256, at)))
            at += 2048 + n

    @staticmethod
    def pack(words, first, priors, prior_of, unseen, context, pair) -> bytes:
        """words: sorted; first: pointers; priors: sorted directory; prior_of: its number for each pair, sorted by word."""
        owner = np.repeat(np.arange(len(words), dtype=np.uint64), np.diff(first))
        parts = [b"GLTRIE\0\1", EliasFano.pack(words), EliasFano.pack(first), EliasFano.pack(priors), EliasFano.pack(owner * np.uint64(max(1, len(priors))) + prior_of.astype(np.uint64))]
        for x in (unseen, context, pair):
            codes, book = quantise(x)
            parts += [book.tobytes(), codes.tobytes()]
        return b"".join(parts)

    def value(self, column: int, at: np.ndarray) -> np.ndarray:
        codes, book = self.columns[column]
        return book[codes[at]]

    def pair_values(self, word_at: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """The stored value of each (word, predecessor), nan where the pair isn't stored. word_at: places of words."""
        number = self.directory.find(prior)
        out = np.full(len(word_at), np.nan)
        ok = np.flatnonzero(number >= 0)
        w = word_at[ok]
        base = w.astype(np.uint64) * np.uint64(max(1, self.directory.n))
        at = self.pairs.find(base + number[ok].astype(np.uint64), self.pointers.get(w).astype(np.int64), self.pointers.get(w + 1).astype(np.int64))
        hit = at >= 0
        out[ok[hit]] = self.value(2, at[hit])
        return out


def mapped(blob: bytes) -> Trie:
    """The trie, read from a memory-mapped file that is gone from its folder at once."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        return Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def tokens(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, predecessor, text's number): the words and one end of each text."""
    parts = [word_hashes(some) for _, some in cut(encoded)]
    h, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = counts + 1
    last = np.cumsum(n) - 1
    tok = np.full(int(n.sum()), _END, np.uint64)
    inner = np.ones(len(tok), bool)
    inner[last] = False
    tok[inner] = h
    prior = np.empty_like(tok)
    prior[1:] = tok[:-1]
    prior[last - counts] = _BEGIN
    return tok, prior, np.repeat(np.arange(len(encoded)), n)


def _is_train(doc_id, text_id: str, folds: int, held: int) -> bool:
    return zlib.crc32(text_id.encode()) % folds != held if doc_id is not None else True


def _shard_keys(spark, shards: int) -> np.ndarray:
    """A number for each shard that Spark's hash deals to the partition of that number, so that none gets two."""
    tries = shards * (12 + shards.bit_length())
    found = spark.range(tries).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(shards)).alias("s")).groupBy("s").agg(F.min("k").alias("k")).collect()
    keys = np.full(shards, -1, np.int64)
    keys[[r["s"] for r in found]] = [r["k"] for r in found]
    # a shard that no number was found for shares a partition with others
    lost = np.flatnonzero(keys < 0)
    keys[lost] = tries + lost
    return keys


def _send(shards: int, keys: np.ndarray, hot: np.ndarray, spread: np.ndarray, folds: int, held: int):
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("docs", pa.int32()), ("ids", pa.list_(pa.int64())), ("body", pa.binary())])

    def work(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for b in batches:
            every = b.column(0).to_pylist()
            for first, encoded in chunks(b.column(1).to_pylist(), CHUNK):
                ids = every[first : first + len(encoded)]
                tok, prior, doc = tokens(encoded)
                shard = (tok % np.uint64(shards)).astype(np.int64)
                if len(hot):
                    at = np.searchsorted(hot, tok)
                    at[at == len(hot)] = 0
                    on = np.flatnonzero(hot[at] == tok)
                    shard[on] = (shard[on] + (prior[on] >> np.uint64(20)).astype(np.int64) % spread[at[on]]) % shards
                prior = prior >> np.uint64(64 - PRIOR_BITS)
                order = np.lexsort((prior, tok, shard))
                tok, prior, doc, shard = tok[order], prior[order], doc[order], shard[order]
                train = np.packbits([_is_train(i, str(i), folds, held) for i in ids], bitorder="little").tobytes()
                ends = np.flatnonzero(np.append(shard[1:] != shard[:-1], True)) + 1
                a = 0
                for z in ends.tolist():
                    t, p, d = tok[a:z], prior[a:z], doc[a:z].astype("<u4" if len(ids) > 65535 else "<u2")
                    new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                    runs = np.diff(np.append(new, len(t))).astype("<u4")
                    body = b"".join([struct.pack("<III", len(new), len(t), d.itemsize), train, t[new].tobytes(), runs.tobytes(), p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PRIOR_BITS // 8].tobytes(), d.tobytes()])
                    # ids travel once, with the shard of the first triple
                    yield pa.RecordBatch.from_arrays([pa.array([int(keys[shard[a]])], pa.int32()), pa.array([chunk]), pa.array([len(ids)], pa.int32()), pa.array([ids if a == 0 else []], pa.list_(pa.int64())), pa.array([body])], schema=schema)
                    a = z
                chunk += 1

    return work


def _open(body: bytes, docs: int):
    words, n, size = struct.unpack_from("<III", body)
    at = 12
    k = -(-docs // 8)
    train = np.unpackbits(np.frombuffer(body, np.uint8, k, at), bitorder="little")[:docs].astype(bool)
    at += k
    tok = np.frombuffer(body, "<u8", words, at)
    at += 8 * words
    runs = np.frombuffer(body, "<u4", words, at)
    at += 4 * words
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : PRIOR_BITS // 8] = np.frombuffer(body, np.uint8, n * (PRIOR_BITS // 8), at).reshape(n, -1)
    at += n * (PRIOR_BITS // 8)
    return train, np.repeat(tok, runs), wide.view("<u8")[:, 0], np.frombuffer(body, f"<u{size}", n, at).astype(np.int64)


def _shard_sums(total: int, begins: int, hot: np.ndarray, hot_count: np.ndarray):
    """Step 3 of one shard."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("docs", pa.int32()), ("distinct", pa.int64()), ("body", pa.binary())])

    def work(_, table):
        rows = table.select(["chunk", "docs", "ids", "body"]).to_pylist()
        opened = [_open(r["body"], r["docs"]) for r in rows]
        for r in rows:
            r["body"] = None
        sizes = [len(x[1]) for x in opened]
        train = np.concatenate([x[0][x[3]] for x in opened])
        tok = np.concatenate([x[1] for x in opened])
        prior = np.concatenate([x[2] for x in opened])
        doc = [x[3] for x in opened]
        opened.clear()
        order = np.lexsort((prior, tok))
        tok, prior, train = tok[order], prior[order], train[order]
        new_pair = np.append(True, (tok[1:] != tok[:-1]) | (prior[1:] != prior[:-1])) if len(tok) else np.zeros(0, bool)
        start = np.flatnonzero(new_pair)
        pair_tok, pair_prior = tok[start], prior[start]
        count = np.add.reduceat(train.astype(np.int64), start)
        pair_of = np.empty(len(tok), np.int64)
        pair_of[order] = np.cumsum(new_pair) - 1
        del tok, prior, train, order, new_pair
        kept = count > 0
        words, at = np.unique(pair_tok[kept], return_index=True)
        first = np.append(at, int(kept.sum()))
        held = count[kept]
        c = np.add.reduceat(held, at) if len(at) else np.zeros(0, np.int64)
        if len(hot):
            # a hot token's training triples may all lie in its other shards; here it is known without pairs
            place = np.minimum(np.searchsorted(pair_tok, hot), len(pair_tok) - 1)
            more = np.setdiff1d(hot[(pair_tok[place] == hot) & (hot_count > 0)], words)
            place = np.searchsorted(words, more)
            words, first, c = np.insert(words, place, more), np.insert(first, place, first[place]), np.insert(c, place, 0)
        if len(hot) and len(words):
            k = np.searchsorted(hot, words)
            k[k == len(hot)] = 0
            is_hot = hot[k] == words
            c = np.where(is_hot, hot_count[k], c)
        p1 = MU * KNOWN * c / max(total, 1)
        priors, prior_of = np.unique(pair_prior[kept], return_inverse=True)
        trie = mapped(Trie.pack(words, first, priors, prior_of, np.log10(p1), np.log10(c + MU), np.log10(held + np.repeat(p1, np.diff(first)))))
        # every distinct triple is looked up once, in parts of bounded size
        unknown = float(np.log10(MU * (1 - KNOWN) / max(total, 1)))
        value, known, log_c = np.empty(len(pair_tok)), np.empty(len(pair_tok), bool), np.empty(len(pair_tok))
        for a in range(0, len(pair_tok), 1 << 17):
            t, p = pair_tok[a : a + (1 << 17)], pair_prior[a : a + (1 << 17)]
            new = np.append(True, t[1:] != t[:-1])
            w = trie.words.find(t[new])[np.cumsum(new) - 1]
            on = np.flatnonzero(w >= 0)
            v = np.full(len(t), unknown)
            pair = trie.pair_values(w[on], p[on])
            v[on] = np.where(np.isnan(pair), trie.value(0, w[on]), pair)
            # as the next token's predecessor this token divides by its count; the end has no next token
            v -= np.where(t == _END, 0.0, np.log10(MU))
            v[on] -= np.where(t[on] == _END, 0.0, trie.value(1, w[on]) - np.log10(MU))
            value[a : a + len(t)], known[a : a + len(t)] = v, w >= 0
            log_c[a : a + len(t)] = 0.0
            log_c[a + on] = np.log10(c[w[on]] + 1.0)
        value -= np.where(pair_prior == _BEGIN >> np.uint64(64 - PRIOR_BITS), np.log10(begins + MU), 0.0)
        out, a = [], 0
        for r, d, n in zip(rows, doc, sizes, strict=True):
            k = pair_of[a : a + n]
            a += n
            here, place = np.unique(d, return_inverse=True)
            sums = [np.bincount(place, minlength=len(here)).astype("<u4"), np.bincount(place, known[k]).astype("<u4"), np.bincount(place, log_c[k]).astype("<f8"), np.bincount(place, value[k]).astype("<f4")]
            out.append((r["chunk"], r["ids"], r["docs"], 0, b"".join([struct.pack("<I", len(here)), here.astype("<u4").tobytes(), *(s.tobytes() for s in sums)])))
        distinct = int((~is_hot).sum()) if len(hot) and len(words) else len(words)
        out.append((-1, [], 0, distinct, b""))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return work


def _gather(total: int, distinct: int, folds: int, held: int):
    """Step 4 of one chunk."""

    def work(_, table):
        docs = table.column("docs")[0].as_py()
        ids = max(table.column("ids").to_pylist(), key=len)
        n, known, log_c, value = np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs), np.zeros(docs)
        # in one order on every run, so that sums agree to the last bit
        for body in sorted(table.column("body").to_pylist()):
            (k,) = struct.unpack_from("<I", body)
            here = np.frombuffer(body, "<u4", k, 4)
            n[here] += np.frombuffer(body, "<u4", k, 4 + 4 * k)
            known[here] += np.frombuffer(body, "<u4", k, 4 + 8 * k)
            log_c[here] += np.frombuffer(body, "<f8", k, 4 + 12 * k)
            value[here] += np.frombuffer(body, "<f4", k, 4 + 20 * k)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": [not _is_train(i, str(i), folds, held) for i in ids], "n_tokens": n, "n_known": known, "train_tokens": np.full(docs, total), "base_score": log_c - n * np.log10(total + distinct + 1.0), "score": value})

    return work


def _sampled(docs: DataFrame, rows: int) -> list[tuple[int, float]]:
    """Shares of the commonest tokens in about SAMPLE documents; they only decide which tokens are spread."""
    step = max(1, rows // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)

    def work(batches):
        for b in batches:
            for _, encoded in chunks(b.column(1).to_pylist(), CHUNK):
                t, n = np.unique(tokens(encoded)[0], return_counts=True)
                top = np.argsort(-n, kind="stable")[:500]
                yield pa.RecordBatch.from_arrays([pa.array(t[top].view(np.int64)), pa.array(n[top]), pa.array(np.full(len(top), n.sum()) * (np.arange(len(top)) == 0))], names=["t", "n", "all"])

    counts = some.mapInArrow(lean(work), "t bigint, n bigint, all bigint").groupBy("t").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    total = counts.agg(F.sum("all")).first()[0] or 1
    return [(r["t"], r["n"] / total) for r in counts.orderBy(F.desc("n"), "t").limit(500).collect()]


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Training texts are those whose crc32(doc_id as text) mod folds is not held; rows with a null id are training texts.
    Null and empty texts are one end. Repeated rows count and are scored each. Other columns are ignored; an empty table
    gives no rows. base_score and the counts are exact (words are told apart by 64-bit hashes); score sums values that
    are stored in 256 steps.
    """
    docs = batched(docs).select(F.col("doc_id").cast("long"), "text")
    rows = docs.count()
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    shares = _sampled(docs, rows)

    def count(batches):
        watch = np.sort(np.array([t for t, _ in shares], np.int64).view(np.uint64))
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, encoded in chunks(b.column(1).to_pylist(), CHUNK):
                tok, _, doc = tokens(encoded)
                train = np.array([_is_train(i, str(i), folds, held) for i in ids[first : first + len(encoded)]])
                seen = tok[train[doc]]
                at = np.searchsorted(watch, seen)
                at[at == len(watch)] = 0
                hits = np.bincount(at[watch[at] == seen], minlength=len(watch)) if len(watch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(tok)]), pa.array([len(seen)]), pa.array([int(train.sum())]), pa.array([watch.view(np.int64)], pa.list_(pa.int64())), pa.array([hits], pa.list_(pa.int64()))], names=["every", "total", "begins", "t", "n"])

    first = docs.mapInArrow(lean(count), "every bigint, total bigint, begins bigint, t array<bigint>, n array<bigint>").agg(F.sum("every").alias("every"), F.sum("total").alias("total"), F.sum("begins").alias("begins"), *[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(shares))]).first()
    every, total, begins = first["every"], first["total"], first["begins"]
    watch = np.sort(np.array([t for t, _ in shares], np.int64).view(np.uint64))
    exact = np.array([first[f"n{i}"] for i in range(len(shares))], np.int64)
    share_of = {t & (1 << 64) - 1: s for t, s in shares}
    shards = max(1, -(-every // SHARD_TRIPLES))
    chosen = np.array([share_of[int(t)] * shards > HOT_SHARE for t in watch], bool) if len(watch) else np.zeros(0, bool)
    hot, hot_count = watch[chosen], exact[chosen]
    spread = np.array([max(1, min(shards, int(np.ceil(share_of[int(t)] * shards * 4)))) for t in hot], np.int64)

    sent = docs.mapInArrow(lean(_send(shards, _shard_keys(docs.sparkSession, shards), hot, spread, folds, held)), "shard int, chunk bigint, docs int, ids array<bigint>, body binary")
    sums = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard_sums(total, begins, hot, hot_count), "chunk bigint, ids array<bigint>, docs int, distinct bigint, body binary")
    sums = written(sums, "sums")
    distinct = (sums.agg(F.sum("distinct")).first()[0] or 0) + int((hot_count > 0).sum())
    return sums.where("chunk >= 0").groupBy("chunk").applyInArrow(_gather(total, distinct, folds, held), schema)
