"""Top-k by dot product: a blocked search for largest inner products, exact, without meeting all pairs.

Targets are ordered by their nearest pivot and their angle to it and cut into blocks. A block knows its mean direction, the
widest angle of a member to it, and its members' least and largest norm; with the query's angle to that direction this gives
a bound on any member's product. Each query visits blocks by falling bound and stops at the first one that cannot reach its
k-th best product so far. Products near that are taken anew, in the order of the vectors' places, so that they, and ties,
are those of the column function dot().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from graphloom.sources.work import saved

#: Bytes of target vectors that are held at once; more are searched one part after the other.
TARGET_BYTES = 64 << 20
#: Vectors of a block, and directions that the targets are ordered by.
BLOCK, PIVOTS = 64, 32
#: Queries that visit blocks together.
TOGETHER = 2048


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((v * v).sum(1))
    return v / np.where(n > 0, n, 1.0)[:, None], n


class Blocks:
    """Targets in blocks. order: what breaks ties, ascending. since: queries up to that number do not see the target."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, block: int = BLOCK, since: np.ndarray | None = None):
        unit, norm = _unit(vectors)
        n = len(vectors)
        if n > block:
            pivots = unit[np.linspace(0, n - 1, min(PIVOTS, n)).astype(np.int64)]
            cos = unit @ pivots.T
            near = cos.argmax(1)
            self.at = np.lexsort((-cos[np.arange(n), near], near))
        else:
            self.at = np.arange(n)
        self.vectors, self.order = vectors[self.at], order[self.at]
        self.since = None if since is None else since[self.at]
        unit, norm = unit[self.at], norm[self.at]
        self.edges = list(range(0, n, block)) + [n]
        parts = list(zip(self.edges, self.edges[1:]))
        self.centre = _unit(np.array([unit[a:b].mean(0) for a, b in parts]))[0]
        self.width = np.array([np.arccos(np.clip(unit[a:b] @ c, -1, 1)).max() for (a, b), c in zip(parts, self.centre, strict=True)])
        self.most = np.array([norm[a:b].max() for a, b in parts])
        self.least = np.array([norm[a:b].min() for a, b in parts])
        # a vector without direction is at no angle: such a block's bound is that of its norms
        self.width[[i for i, (a, b) in enumerate(parts) if (norm[a:b] == 0).any()]] = np.pi

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block, what no member's product exceeds."""
        unit, norm = _unit(queries)
        angle = np.arccos(np.clip(unit @ self.centre.T, -1, 1)) - self.width - 1e-7
        cos = np.cos(np.maximum(angle, 0.0))
        return norm[:, None] * np.where(cos >= 0, self.most, self.least) * cos

    def search(self, queries: np.ndarray, k: int, known: list[list[float]] | None = None, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, target's place as given, product) of candidates that hold each query's k best, and the pairs compared.

        known: products that a query has already found elsewhere. numbers: of the queries, where targets have a since.
        """
        m = len(queries)
        bounds = self.bounds(queries)
        turn = np.argsort(-bounds, axis=1, kind="stable")
        best = np.full((m, k), -np.inf)
        for i, some in enumerate(known or []):
            some = sorted(some, reverse=True)[:k]
            best[i, : len(some)] = some
        slack = 1e-9 * (1.0 + _unit(queries)[1] * self.most.max(initial=0.0))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        compared, live = 0, np.arange(m)
        for step in range(turn.shape[1]):
            block = turn[live, step]
            keep = bounds[live, block] >= best[live].min(1) - slack[live]
            live, block = live[keep], block[keep]
            if not len(live):
                break
            by = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by])) + 1
            for group in np.split(by, cuts):
                b, who = int(block[group[0]]), live[group]
                low, high = self.edges[b], self.edges[b + 1]
                near = queries[who] @ self.vectors[low:high].T
                compared += near.size
                passes = near >= (best[who].min(1) - slack[who])[:, None]
                if self.since is not None:
                    passes &= self.since[None, low:high] < numbers[who][:, None]
                i, j = np.nonzero(passes)
                product = np.add.accumulate(queries[who[i]] * self.vectors[low + j], axis=1)[:, -1] if queries.shape[1] else np.zeros(len(i))
                found.append((who[i], low + j, product))
                both = np.concatenate([best[who], np.full((len(who), high - low), -np.inf)], 1)
                both[i, k + j] = product
                best[who] = -np.sort(-both, axis=1)[:, :k]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), compared
        q, t, s = (np.concatenate([f[i] for f in found]) for i in range(3))
        keep = s >= best.min(1)[q]
        return q[keep], self.at[t[keep]], s[keep], compared


_BEST = "best"


def _searched(blocks: Blocks, names: pa.Array, order: pa.Array, k: int, out: pa.Schema):
    def work(batches):
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                some = b.slice(a, TOGETHER)
                v = np.array(some.column("v").to_pylist(), np.float64).reshape(some.num_rows, -1)
                held = some.column(_BEST)
                before = [[x["score"] for x in r] for r in held.to_pylist()]
                q, t, s, compared = blocks.search(v, k, before, some.column("at").to_numpy())
                by = np.lexsort((blocks.order[np.argsort(blocks.at)][t], -s, q))
                q, t, s = q[by], t[by], s[by]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                top = rank < k
                q, t, s = q[top], t[top], s[top]
                # what was known and what is new, k of each at most; the best of both are taken in the end
                old = held.flatten()
                sizes = np.array([len(r) for r in before], np.int64)
                new = np.bincount(q, minlength=some.num_rows)
                fresh = pa.StructArray.from_arrays([names.take(pa.array(t)), order.take(pa.array(t)), pa.array(s)], fields=list(held.type.value_type))
                every = pa.concat_arrays([old, fresh])
                starts_old, starts_new = np.cumsum(sizes) - sizes, np.cumsum(new) - new + len(old)
                pick = np.concatenate([np.concatenate([np.arange(o, o + n), np.arange(p, p + w)]) for o, n, p, w in zip(starts_old, sizes, starts_new, new, strict=True)]) if some.num_rows else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes + new)), pa.int32()), every.take(pa.array(pick.astype(np.int64)))).cast(held.type)
                done = pa.array(np.append(compared, np.zeros(some.num_rows - 1, np.int64)) if some.num_rows else np.zeros(0, np.int64))
                total = pa.compute.add(some.column("compared"), done)
                yield pa.RecordBatch.from_arrays([some.column("q"), some.column("v"), some.column("at"), total, lists], schema=out)

    return work


def searched(queries: DataFrame, targets: DataFrame, k: int, part_bytes: int = TARGET_BYTES, block: int = BLOCK) -> DataFrame:
    """(q, compared, best) of queries (q, v) with targets (t, ord, w): best holds (t, ord, score) of the k best at least;
    compared, summed over all rows, is the number of pairs whose product was taken.

    Targets go to the workers in parts of counted size, one after the other; between parts the queries' lists are saved, so
    that a worker holds one part at a time, and later parts are pruned by what earlier ones gave. Rows without a vector are
    left out; all vectors have one length. Where queries have a column at and targets a column since, both numbers, a query
    sees only targets whose since lies below its at.
    """
    timed = "since" in targets.columns and "at" in queries.columns
    targets = targets.where("w IS NOT NULL").select("t", "ord", F.col("w").cast("array<double>").alias("w"), *([F.col("since").cast("bigint").alias("since")] if timed else []))
    r = targets.agg(F.count("*").alias("n"), F.max(F.size("w")).alias("width")).first()
    parts = max(1, -(-r["n"] * (r["width"] or 0) * 8 // part_bytes))
    item = StructType([StructField("t", targets.schema["t"].dataType), StructField("ord", targets.schema["ord"].dataType), StructField("score", DoubleType())])
    schema = StructType([StructField("q", queries.schema["q"].dataType), StructField("v", ArrayType(DoubleType())), StructField("at", LongType()), StructField("compared", LongType()), StructField(_BEST, ArrayType(item))])
    empty = F.array().cast(ArrayType(item))
    out = queries.where("v IS NOT NULL").select("q", F.col("v").cast("array<double>").alias("v"), (F.col("at") if timed else F.lit(0)).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("compared"), empty.alias(_BEST))
    arrow = to_arrow_schema(schema)
    for p in range(parts):
        some = targets if parts == 1 else targets.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == p)
        held = some.orderBy("ord").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        column = lambda c, held=held: held.column(c).combine_chunks() if isinstance(held.column(c), pa.ChunkedArray) else held.column(c)
        vectors = np.array(column("w").to_pylist(), np.float64).reshape(held.num_rows, -1)
        blocks = Blocks(vectors, np.arange(held.num_rows), block, column("since").to_numpy() if timed else None)
        out = out.mapInArrow(_searched(blocks, column("t"), column("ord"), k, arrow), schema)
        out = saved(out) if p < parts - 1 else out
    return out.select("q", "compared", _BEST)


def top_k(queries: DataFrame, targets: DataFrame, k: int, part_bytes: int = TARGET_BYTES, block: int = BLOCK) -> DataFrame:
    """(q, t, score, rank): each query's k best targets by dot product, ties by the targets' order."""
    found = searched(queries, targets, k, part_bytes, block)
    by = F.array_sort(F.transform(_BEST, lambda x: F.struct((-x["score"]).alias("s"), x["ord"].alias("ord"), x["t"].alias("t"), x["score"].alias("score"))))
    rows = found.select("q", F.posexplode(F.slice(by, 1, k)).alias("pos", "x"))
    return rows.select("q", F.col("x.t").alias("t"), F.col("x.score").alias("score"), (F.col("pos") + 1).cast("bigint").alias("rank"))
