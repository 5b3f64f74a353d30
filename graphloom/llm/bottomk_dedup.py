"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every document's distinct 5-word shingles are hashed once; its sketch is the SKETCH smallest hashes. Documents with
   equal sets form one class and go on as one representative.
2. Inverted lists of the retained values give candidates. A list of at most LIGHT representatives emits its pairs; the
   bottom-k of the union of two sketches estimates their similarity and drops the clearly different ones.
3. Longer lists emit no pairs. Two similar sets share at least SHARED retained values (or they would not pass step 2),
   so only representatives with that many values in long lists can have a partner that no short list shows. Each of
   them is tied to one pivot of each of its long lists.
4. Candidates that hang together form a group. Groups are cut into blocks, and the full sets of two blocks are compared
   at once by a matrix product: this confirms links exactly, and each block pair returns its components as stars. In large
   groups the middle block goes against all others first; then pairs of blocks already in one component are skipped.
5. Components of the confirmed links give each document its component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batched, bounded, chunks, components, deal, free, lean, mix, spent, word_hashes, written

SHINGLE = 5
SKETCH = 32
#: Retained values that two sets must share to be compared in full: for a similarity of 0.75, fewer among 32 has a
#: probability of about 2e-8.
SHARED = 10
LIGHT = 48
BLOCK = 128
_FACTORS = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64)) for i in range(SHINGLE)]


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """Each text's set, as sorted 64-bit hashes. With fewer than five words, the whole sequence is the one shingle."""
    for _, encoded in chunks(texts):
        h, counts = word_hashes(encoded)
        whole = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE):
            whole += h[i : i + len(whole)] * _FACTORS[i]
        whole = mix(whole)
        at = 0
        for n in counts.tolist():
            if n >= SHINGLE:
                yield np.unique(whole[at : at + n - SHINGLE + 1])
            elif n:
                with np.errstate(over="ignore"):
                    yield mix(np.array([sum((h[at + i] * _FACTORS[i] for i in range(n)), np.uint64(n))], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, set_key, n_shingles, sketch) of every row; set_key is a 128-bit hash of the set, null if it is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n_shingles", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def work(batches):
        for b in batches:
            keys, sizes, low = [], [], []
            for s in shingle_sets(b.column(1).to_pylist()):
                keys.append(_key(s) if len(s) else None)
                sizes.append(len(s))
                low.append(np.sort(s[:SKETCH].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(low, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id bigint, set_key binary, n_shingles bigint, sketch array<bigint>")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_key, items) of the wanted classes (doc_id, set_key): their texts are read again, no others shipped."""
    schema = pa.schema([("set_key", pa.binary()), ("items", pa.binary())])

    def work(batches):
        for b in batches:
            sets = [(_key(s) if len(s) else None, k, s) for k, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist()), strict=True)]
            # an id may stand for several texts: only the one with the wanted set counts
            sets = [(k, s) for k, want, s in sets if k is not None and want in (None, k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.binary()), pa.array([s.tobytes() for _, s in sets], pa.binary())], schema=schema)

    read = lambda df: df.select("set_key", "text").mapInArrow(lean(work), "set_key binary, items binary")
    out = read(docs.join(bounded(wanted.where("doc_id IS NOT NULL").select("doc_id", "set_key"), 40), "doc_id"))
    # a class without any id is read by its set alone
    lost = wanted.where("doc_id IS NULL").select("set_key")
    if lost.limit(1).count():
        out = out.unionByName(read(docs.where("doc_id IS NULL").withColumn("set_key", F.lit(None).cast("binary"))).join(bounded(lost, 32), "set_key", "left_semi"))
    return out.dropDuplicates(["set_key"])


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (u, v) of set_keys that need an exact comparison, from representatives (set_key, n_shingles, sketch)."""
    values = reps.select("set_key", "n_shingles", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    values = written(values.join(counts, "value"), "lists")

    light = values.where(F.col("df") <= LIGHT).select("value", "set_key", "n_shingles")
    a, b = light.alias("a"), light.alias("b")
    fits = (F.col("a.n_shingles") * 4 >= F.col("b.n_shingles") * 3) & (F.col("b.n_shingles") * 4 >= F.col("a.n_shingles") * 3)
    pairs = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.set_key") < F.col("b.set_key")) & fits)
    pairs = pairs.groupBy(F.col("a.set_key").alias("u"), F.col("b.set_key").alias("v")).agg(F.count("*").alias("shared"))
    # flipping the sign bit keeps the hashes' unsigned order
    sk = reps.select("set_key", F.expr("transform(sketch, x -> x ^ (-9223372036854775807L - 1))").alias("sketch"))
    pairs = pairs.join(sk.withColumnsRenamed({"set_key": "u", "sketch": "su"}), "u").join(sk.withColumnsRenamed({"set_key": "v", "sketch": "sv"}), "v")
    pairs = pairs.withColumn("both", F.array_intersect("su", "sv")).withColumn("union", F.slice(F.array_sort(F.array_union("su", "sv")), 1, SKETCH))
    pairs = pairs.withColumn("hits", F.size(F.array_intersect("union", "both")))
    # sketches that hold whole sets decide exactly; others are kept unless the estimate is far below
    exact = (F.size("su") < SKETCH) & (F.size("sv") < SKETCH) & (F.size(F.array_union("su", "sv")) <= SKETCH)
    pairs = pairs.where(F.when(exact, F.col("hits") * 4 >= F.size("union") * 3).otherwise(F.col("hits") >= SHARED)).select("u", "v")

    heavy = values.where(F.col("df") > LIGHT)
    # a representative's list has at most SKETCH values
    dense = heavy.groupBy("set_key").agg(F.collect_list("value").alias("vs"), F.first("n_shingles").alias("n")).withColumn("n_heavy", F.size("vs"))
    dense = dense.where((F.col("n_heavy") >= SHARED) | (F.col("n_heavy") * 4 >= F.col("n") * 3))
    dense = written(dense.select("set_key", "n_heavy", F.explode("vs").alias("value")), "dense")
    # the member with the most common values stands nearest to the others
    pivot = dense.groupBy("value").agg(F.max_by("set_key", F.struct("n_heavy", "set_key")).alias("v"))
    return pairs.unionByName(dense.select("value", F.col("set_key").alias("u")).join(pivot, "value").where("u <> v").select("u", "v"))


def _stars(links: np.ndarray, left: np.ndarray, right: np.ndarray, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(key, smallest key of its component) for the links between the places in left and right."""
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in links.tolist():
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            up[a if keys[b] < keys[a] else b] = b if keys[b] < keys[a] else a
    return [(keys[i], keys[root(i)]) for i in range(len(keys)) if up[i] != i]


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left's sets with right's: a product of 0/1 matrices over slices of the items."""
    items, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.bincount(place, minlength=len(items)) > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    row, col = row[keep], number[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for at in range(0, int(common.sum()), step):
        a, b = np.searchsorted(col, [at, at + step])
        m = np.zeros((len(sets), min(step, int(common.sum()) - at)), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out


def compare(table: pa.Table) -> pa.Table:
    """Confirmed links within block 'b', or between blocks 'l' and 'r', as stars (u, v); v is its component's smallest key."""
    keys, sets = table["set_key"].to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table["items"]]
    side = np.array(table["side"].to_pylist())
    left = np.flatnonzero(side != "r")
    right = np.flatnonzero(side != "l")
    n = np.array([len(s) for s in sets], np.int64)
    both = _overlaps(sets, left, right).astype(np.int64)
    yes = 100 * both >= 75 * (n[left][:, None] + n[right][None, :] - both)
    yes &= left[:, None] != right[None, :]
    stars = _stars(np.argwhere(yes), left, right, keys)
    if len(sets) >= BLOCK:
        free()
    return pa.table({"u": pa.array([u for u, _ in stars], pa.binary()), "v": pa.array([v for _, v in stars], pa.binary()), "single": pa.array([table["single"][0].as_py()] * len(stars), pa.bool_())})


def _compared(sides: DataFrame) -> DataFrame:
    """Links of sides (group, b1, b2, single, side, set_key, items)."""
    return sides.select("group", "b1", "b2", "single", "side", "set_key", "items").groupBy("group", "b1", "b2").applyInArrow(compare, "u binary, v binary, single boolean")


def _against_hubs(rows: DataFrame) -> DataFrame:
    """Links of small groups' only block, and in large groups of the middle block (the hub) with every block and itself.

    A hub's rows are dealt out before they are copied, so that no task writes all copies of a hub.
    """
    rows = rows.withColumn("b1", F.floor(F.col("last") / 2).cast("int")).withColumn("single", F.col("last") == 0)
    small = rows.where("single").select("*", F.col("block").alias("b2"), F.lit("b").alias("side"))
    hubs = rows.where("NOT single AND block = b1").repartition(deal(rows.sparkSession), "set_key").select("*", F.explode(F.sequence(F.lit(0), "last")).alias("b2"))
    hubs = hubs.withColumn("side", F.when(F.col("b2") == F.col("b1"), "b").otherwise("l"))
    others = rows.where("NOT single AND block <> b1").select("*", F.col("block").alias("b2"), F.lit("r").alias("side"))
    return _compared(small.unionByName(hubs).unionByName(others))


#: Tasks that share the copies of one block's rows.
SALTS = 16


def _block_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links of the block pairs (group, b1, b2) over rows (group, block, set_key, items)."""
    sides = pairs.select("group", "b1", "b2", F.col("b1").alias("block"), F.when(F.col("b1") == F.col("b2"), "b").otherwise("l").alias("side"))
    sides = sides.unionByName(pairs.where("b1 <> b2").select("group", "b1", "b2", F.col("b2").alias("block"), F.lit("r").alias("side")))
    sides = sides.select("*", F.lit(False).alias("single"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("set_key"), F.lit(SALTS)).cast("int"))
    return _compared(salted.join(sides.hint("shuffle_hash"), ["group", "block", "salt"]))


def _blocked(members: DataFrame, order: list) -> DataFrame:
    """members with block and last, their group's last block: at most BLOCK rows of a group each, in the given order.

    No group meets in one task: rows are ranked within range partitions, whose short list of sizes gives the offsets.
    """
    spread = members.repartitionByRange(deal(members.sparkSession), "group", *order).sortWithinPartitions("group", *order).withColumn("part", F.spark_partition_id())
    spread = written(spread, "blocked")
    rank = F.row_number().over(Window.partitionBy("part", "group").orderBy(*order)) - 1
    sizes = spread.groupBy("group", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("group")
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("last", F.floor((F.sum("n").over(whole) - 1) / BLOCK).cast("int"))
    placed = spread.withColumn("rank", rank).join(sizes.select("group", "part", "base", "last"), ["group", "part"])
    out = written(placed.withColumn("block", F.floor((F.col("rank") + F.col("base")) / BLOCK).cast("int")).drop("rank", "base", "part"), "rows")
    spent(spread)
    return out


def _again(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Links of those block pairs of large groups that the links so far do not show to be one component already."""
    found = written(components(links).select(F.col("node").alias("set_key"), F.col("label").alias("found")), "found")
    again = rows.where("last > 0").join(found, "set_key", "left").withColumn("label", F.coalesce("found", "set_key")).drop("found", "block", "last")
    # the largest component comes first, so that its blocks hold nothing else
    largest = again.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    again = again.join(bounded(largest, 64), "group").withColumn("rest", F.col("label") != F.col("largest")).drop("largest")
    again = _blocked(again, ["rest", "label", "n_shingles", "set_key"])
    facts = again.groupBy("group", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))
    a, b = facts.alias("a"), facts.alias("b")
    same = (F.col("a.first_label") == F.col("a.last_label")) & (F.col("a.first_label") == F.col("b.first_label")) & (F.col("a.first_label") == F.col("b.last_label"))
    fits = (F.col("a.hi") * 4 >= F.col("b.lo") * 3) & (F.col("b.hi") * 4 >= F.col("a.lo") * 3)
    more = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.block") <= F.col("b.block")) & ~same & fits).select(F.col("a.group").alias("group"), F.col("a.block").alias("b1"), F.col("b.block").alias("b2"))
    out = written(_block_pairs(again, more), "links")
    spent(found, again)
    return out


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, set_key, n_shingles, component, component_id) of every row; component: its set's component, by set_key."""
    docs = batched(docs).select(F.col("doc_id").cast("long"), "text")
    base = written(sketches(docs), "sketches")
    reps = base.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = written(reps, "classes")
    groups = written(components(candidates(reps)).select(F.col("node").alias("set_key"), F.col("label").alias("group")), "groups")
    members = groups.join(reps.select("set_key", "doc_id", "n_shingles"), "set_key")
    rows = _blocked(members.join(_sets_of(docs, members), "set_key").drop("doc_id"), ["n_shingles", "set_key"])
    links = written(_against_hubs(rows), "links")
    # a group of one block has its components already
    done = links.where("single").select(F.col("u").alias("set_key"), F.col("v").alias("component"))
    labels = done.unionByName(done.select(F.col("component").alias("set_key"), "component").distinct())
    used = [reps, groups, rows, links]
    if rows.where("last > 0").limit(1).count():
        rest = links.where("NOT single")
        more = _again(rows, rest)
        used.append(more)
        labels = labels.unionByName(components(rest.unionByName(more)).withColumnsRenamed({"node": "set_key", "label": "component"}))
    known = written(reps.select("set_key", "doc_id").join(labels, "set_key", "left").withColumn("component", F.coalesce("component", "set_key")), "known")
    spent(*used)
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = known.join(least, "component").select("set_key", "component", "component_id")
    out = base.join(final, "set_key", "left").withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "set_key", "n_shingles", "component", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; linked: 100 * intersection >= 75 * union.

    component_id is the smallest doc_id reachable by links, itself included; kept: it is the row's own. Null and empty
    texts have no shingles, component_id = doc_id, and are kept. Rows with a null doc_id take part, but give no id: they
    are kept only if their whole component has none. Repeated rows are one class and share its id, so all are kept where
    the id is theirs. Other columns are ignored; an empty table gives no rows.
    """
    return _classes(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _key_of():
    """A column function from texts to their sets' keys."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def work(parts):
            for texts in parts:
                yield pa.array([_key(s) if len(s) else None for s in shingle_sets((v.as_py() for v in texts))], pa.binary())

        yield from lean(work)(batches)

    return F.arrow_udf(each, "binary")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs' rows, all columns, without the duplicates: of each component one row with the smallest id stays.

    Rows with a null id name no group and stay. An id may stand for several texts: each is judged by its own set, and of
    the rows of an id that belong to one component the one with the smallest set and text stays.
    """
    found = written(_classes(docs).where("doc_id IS NOT NULL"), "found")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"))
    several = ids.where("n > 1").select("doc_id")
    out = docs.join(bounded(ids.where("n > 1 OR stays = 0").select("doc_id"), 16), "doc_id", "left_anti").select(*docs.columns)
    if several.limit(1).count():
        kept = found.join(several, "doc_id", "left_semi").where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("set_key").alias("set_key"))
        keys = kept.select(F.struct("doc_id", "set_key").alias("key"))
        rows = docs.join(several, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("text").alias("_text"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), _key_of()("text").alias("set_key")).alias("key"))
        rows = rows.join(keys, rows["key"].eqNullSafe(keys["key"]), "left_semi")
        out = out.unionByName(rows.groupBy("key").agg(F.min_by("row", F.struct(F.col("_text").isNotNull(), "_text")).alias("row")).select("row.*"))
    return out
