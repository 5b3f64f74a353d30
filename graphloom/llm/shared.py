"""What several training-data operators need: tables, the shared work folder, word hashes, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once; each numpy column over them takes eight times as much.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only for a local master that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors.

    In zstd, unless options say otherwise: its native buffers go when a page is done; snappy's stay until the JVM collects
    their owners.
    """
    spark = df.sparkSession
    at = f"{work_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def spent(*frames: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of texts that go to a worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def batched(docs: DataFrame) -> DataFrame:
    """docs, whose session sends BATCH_BYTES to Python at once, where it has kept Spark's own default of 64 MB: JVM and
    worker each hold a batch several times, and keep that memory."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) in ("64m", "67108864b", str(64 << 20)):
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def free() -> None:
    """Gives memory that this process has freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: What a worker drops before it turns to another operator: functions that empty its caches.
HELD: list = []


def lean(work, keep: bool = False):
    """work over an iterator of batches, with free() at its end; without keep, caches of other operators go first."""

    def run(batches):
        if not keep:
            for drop in HELD:
                drop()
        yield from work(batches)
        free()

    return run


#: Bytes that may be broadcast.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df for the small side of a join: broadcast if its rows, counted, stay under the limit; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def deal(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- words ---------------------------------------------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but digits and letters.
_SIGN = np.ones(256, bool)
_SIGN[128:] = False
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        ones = np.full(max(n, 4096), base, np.uint64)
        ones[0] = 1
        have = np.cumprod(ones, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:  # those of a very long text are not kept
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the input changes every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts, size: int = CHUNK_BYTES):
    """(first row, encoded texts) of as many rows as make about size bytes; None counts as empty. A text is never cut."""
    return cut((b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts), size)


def cut(encoded, size: int = CHUNK_BYTES):
    """(first row, rows) of as many rows as make about size bytes."""
    at, held, n = 0, [], 0
    for i, b in enumerate(encoded):
        if held and n + len(b) > size:
            yield at, held
            at, held, n = i, [], 0
        held.append(b)
        n += len(b) + 1
    if held:
        yield at, held


def word_hashes(encoded: list[bytes], signs_part: bool = False):
    """(hash of each word, number of words of each text), with A-Z lower-cased.

    Words are runs of bytes other than ASCII white space or, with signs_part, than ASCII non-alphanumerics. The hash is
    a polynomial over the bytes, taken from one running sum and shifted back to the word's start.
    """
    data = b"\n".join(encoded).lower() + b"\n"
    a = np.frombuffer(data, np.uint8)
    gap = (_SIGN if signs_part else _SPACE)[a]
    before = np.empty_like(gap)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(gap & ~before)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _power(_STEP, len(a)), dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * _power(_BACK, len(a))[starts]
    h = mix(h + np.uint64(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(b) + 1 for b in encoded])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return h, counts


# --- components ----------------------------------------------------------------------------------------------------


#: Edges that one task of a round handles.
EDGES_A_TASK = 250_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for edges (u, v) of any ordered type: label is the smallest node reachable. Nulls and loops go.

    Every edge points from its larger node to its smaller one. A round moves each edge's target on to that node's
    smallest target (large star), then ties all targets of a node to their smallest (small star), until nothing moves.
    Both steps are an aggregation and a join whose hot keys Spark can split; a round ends in a written table, so neither
    lineage nor any group is held in one place.
    """
    now = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    left = now.count()
    for _ in range(rounds):
        if not left:
            break
        was = now
        # as many tasks as the counted edges need, whatever the number of shuffle partitions
        tasks = max(4, -(-left // EDGES_A_TASK))
        seen, size = Observation(), Observation()
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        large = now.join(low.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")).coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").coalesce(tasks).observe(seen, F.sum((F.col("moved") | (F.col("v") != F.col("m"))).cast("int")).alias("moves"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = small.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct().coalesce(tasks)
        now = written(now.observe(size, F.count(F.lit(1)).alias("n")), "edges")
        spent(was)
        left = size.get["n"] if seen.get["moves"] else 0
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
