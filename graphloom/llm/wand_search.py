"""Ranked lexical search: the best documents for each item of a query set, by WAND over shards of an inverted index.

Documents are read once and written as shards: posting lists of some SHARD_BYTES of text, with document lengths. Terms that
no item can have (by a bitmap of the items' terms, of fixed size) are left out. Spark sums the shards' statistics; only then
are weights and impacts known, so they are made when a shard is searched.

WAND (Broder et al.): each term of an item has a largest impact in the shard. The cursors of its lists are kept in order of
their documents; the first at which the running sum of largest impacts reaches the heap's threshold is the pivot. No document
before the pivot's can enter the heap: cursors before it skip to it, and only a document that all of them stand on is
scored. A task keeps its heaps, and with them its thresholds, from shard to shard; the tasks' heaps are merged by Spark.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batched, bounded, chunks, lean, word_hashes, written

#: Text of one shard, unless one document has more.
SHARD_BYTES = 16 << 20
#: Bits of the items' bitmap. Full, it leaves out nothing; it never leaves out an item's term.
BITS = 1 << 22
#: Text of items that are searched at once; more items are more searches of the same index.
ITEM_BYTES = 4 << 20
#: Groups in which the tasks' heaps are merged first.
GROUPS = 64
_LAST = 1 << 63


def _slot(terms: np.ndarray) -> np.ndarray:
    return terms & np.uint64(BITS - 1)


def _terms(items: DataFrame) -> DataFrame:
    """(term) of every item, its distinct words' hashes."""

    def work(batches):
        for b in batches:
            for _, encoded in chunks(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_hashes(encoded, True)[0]).view(np.int64))], names=["term"])

    return batched(items).select("text").mapInArrow(lean(work), "term bigint").distinct()


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which slots the terms fill. Spark makes the bitmap in pages of 4 KB, BITS bits in all."""
    slot = F.col("term").bitwiseAND(BITS - 1)
    pages = terms.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    found = np.zeros(BITS + 1, bool)
    for r in pages:
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little"))
        # page p holds the slots from (p - 1) * 32768 + 1 on; slot 0 belongs to page 0
        found[_page_slots(r["page"], bits)] = True
    return found[:BITS]


def _page_slots(page: int, bits: np.ndarray) -> np.ndarray:
    return bits if page == 0 else (page - 1) * (1 << 15) + 1 + bits


_SHARD = "n_docs bigint, n_words bigint, doc_ids array<bigint>, lengths array<int>, terms array<bigint>, sizes array<int>, places array<int>, counts array<int>"


def _indexed(bits: np.ndarray, shard_bytes: int):
    lists = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def shard(ids, lengths, hashes, places):
        h, at = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        new = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        tf = np.diff(first, append=len(h))
        h, at = h[first], at[first]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        n = np.concatenate(lengths)
        columns = [pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())]
        for values, kind in ((pa.array(ids, pa.int64()), pa.int64()), (n, pa.int32()), (h[first].view(np.int64), pa.int64()), (np.diff(first, append=len(h)), pa.int32()), (at, pa.int32()), (tf, pa.int32())):
            flat = values if isinstance(values, pa.Array) else pa.array(values.astype(kind.to_pandas_dtype()))
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.RecordBatch.from_arrays(columns, schema=lists)

    def work(batches):
        ids, lengths, hashes, places, size = [], [], [], [], 0
        for b in batches:
            names = b.column(0).to_pylist()
            for first, encoded in chunks(b.column(1).to_pylist()):
                h, n = word_hashes(encoded, True)
                some = np.flatnonzero(n > 0)
                number = np.cumsum(n > 0) - 1 + len(ids)
                hit = np.flatnonzero(bits[_slot(h)])
                doc = np.repeat(number, n)[hit]
                ids += [names[first + i] for i in some.tolist()]
                lengths.append(n[some])
                hashes.append(h[hit])
                places.append(doc)
                size += sum(map(len, encoded))
                if size >= shard_bytes and ids:
                    yield shard(ids, lengths, hashes, places)
                    ids, lengths, hashes, places, size = [], [], [], [], 0
        if ids:
            yield shard(ids, lengths, hashes, places)

    return work


def best_of_shard(lists: list[tuple[int, array, array]], ids: list[int], k: int, heap: list[tuple[int, int]]) -> int:
    """Puts the shard's best documents on heap, k entries (score, -id), by WAND; returns how many it scored.

    lists: for each term its weight, the places of its documents, ascending, and their impacts before the weight.
    """
    end = len(ids)
    weights = [x[0] for x in lists]
    places = [x[1] for x in lists]
    impacts = [x[2] for x in lists]
    tops = [x[0] * max(x[2]) for x in lists]
    at = [0] * len(lists)
    now = [p[0] for p in places]
    order = sorted(range(len(lists)), key=now.__getitem__)
    least = heap[0][0] if len(heap) == k else 1
    scored = 0
    while True:
        bound, pivot = 0, -1
        for p, c in enumerate(order):
            bound += tops[c]
            if bound >= least:
                pivot = p
                break
        if pivot < 0:
            return scored
        doc = now[order[pivot]]
        if doc == end:
            return scored
        if now[order[0]] == doc:
            score, p = 0, 0
            for c in order:
                if now[c] != doc:
                    break
                i = at[c]
                score += weights[c] * impacts[c][i]
                i += 1
                at[c] = i
                now[c] = places[c][i] if i < len(places[c]) else end
            scored += 1
            if score >= least:
                entry = (score, -(_LAST if ids[doc] is None else ids[doc]))
                if len(heap) < k:
                    heappush(heap, entry)
                elif entry > heap[0]:
                    heapreplace(heap, entry)
                if len(heap) == k:
                    least = heap[0][0]
        else:
            for c in order[:pivot]:
                if now[c] < doc:
                    i = bisect_left(places[c], doc, at[c])
                    at[c] = i
                    now[c] = places[c][i] if i < len(places[c]) else end
        order.sort(key=now.__getitem__)


def _searched(items: list[tuple[int | None, int, list[tuple[int, int]]]], terms: np.ndarray, n_docs: int, n_words: int, k: int):
    """items: (id, key, [(number of the term, weight)]); terms: the hashes, ascending."""

    def work(batches):
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        for b in batches:
            for row in range(b.num_rows):
                take = lambda c, row=row: b.column(c).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                have, sizes, places, tf = take("terms").view(np.uint64), take("sizes").astype(np.int64), take("places"), take("counts").astype(np.int64)
                ids = b.column("doc_ids").slice(row, 1).flatten().to_pylist()
                m = 25 + 75 * take("lengths").astype(np.int64) * n_docs // n_words
                first = np.cumsum(sizes) - sizes
                number = np.searchsorted(terms, have)
                number[number == len(terms)] = 0
                known = np.flatnonzero(terms[number] == have) if len(terms) else []
                impacts = (1_000_000_000 * tf // (1000 * tf + 8 * m[places])).astype(np.int32)
                lists = {int(number[i]): (array("i", places[first[i] : first[i] + sizes[i]].tobytes()), array("i", impacts[first[i] : first[i] + sizes[i]].tobytes())) for i in known}
                for (_, _, wanted), heap in zip(items, heaps, strict=True):
                    some = [(w, *lists[t]) for t, w in wanted if t in lists]
                    if some:
                        best_of_shard(some, ids, k, heap)
        rows = [(i, key, None if d == -_LAST else -d, s) for (i, key, _), heap in zip(items, heaps, strict=True) for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item_id", "item", "doc_id", "score"])

    return work


_FOUND = "item_id bigint, item bigint, doc_id bigint, score bigint"


def _best(df: DataFrame, by: list, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0; equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all other characters, A-Z in lower case. A term's weight is
    floor(1000 * ln((2N + 2) / (2 df + 1))); a document's score is the sum, over the item's terms, repeats included, of the
    weight times (10**9 tf) div (1000 tf + 8 m), with m = 25 + (75 n N) div L of its length n and the mean L / N.

    Null and empty texts, on either side, and items without a known term give no rows. Repeated rows of docs are documents
    of their own; null doc_ids are reported as null, last among equals. Equal items (id and text) are one; items of one id
    and different texts are ranked each by itself. Other columns are ignored; texts are indexed whole, whatever their
    length; without items or documents there are no rows.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct()
    items = items.withColumn("item", F.xxhash64("text", F.lit(1)))
    terms = written(_terms(items), "terms")
    bits = _bitmap(terms)
    shards = written(batched(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_indexed(bits, shard_bytes)), _SHARD), "shards")
    n_docs, n_words = shards.agg(F.sum("n_docs"), F.sum("n_words")).first()
    df = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    df = written(terms.join(df, "term"), "df")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    out = None
    for p in range(parts if n_docs else 0):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        rows = some.collect()
        own = df if parts == 1 else df.join(bounded(_terms(some), 16), "term")
        known = own.select("term", "df").toArrow()
        hashes = known.column("term").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], known.column("df").to_numpy()[order].tolist()
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in counts]
        wanted = []
        for r in rows:
            h, n = np.unique(word_hashes([r["text"].encode("utf-8", "surrogatepass")], True)[0], return_counts=True)
            at = np.searchsorted(hashes, h)
            each = [(t, weight[t] * int(c)) for t, x, c in zip(at.tolist(), h, n, strict=True) if t < len(hashes) and hashes[t] == x and weight[t] > 0]
            if each:
                wanted.append((r["item_id"], r["item"], each))
        if not wanted:
            continue
        one = shards.mapInArrow(lean(_searched(wanted, hashes, n_docs, n_words, k)), _FOUND)
        one = written(one, "found") if parts > 1 else one
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    some = _best(out.withColumn("group", F.spark_partition_id() % GROUPS), ["item_id", "item", "group"], k)
    return _best(some, ["item_id", "item"], k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
