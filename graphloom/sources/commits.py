"""Tables that change by commits: a folder's state is what its last commit says, so a crash at any moment loses nothing.

Data are written to folders of their own first; a commit is a small file under _commits, whose number is the state's version,
created only if nobody else has made it. What no commit names any more is deleted afterwards.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import upsert_nodes
from graphloom.sources.work import saved


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def last_commit(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(version, what it says) of the folder's last commit; (0, {}) without one."""
    fs, at = _fs(spark, f"{path}/_commits")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return 0, {}
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(at, names[-1]))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return int(names[-1].removesuffix(".json")), json.loads(text)


def commit(spark: SparkSession, path: str, version: int, says: dict) -> None:
    """Makes version the folder's state; fails if it exists, as another writer was faster."""
    fs, at = _fs(spark, f"{path}/_commits/{version:020d}.json")
    # written beside and renamed, so that no reader sees half of it; a rename never replaces
    beside = at.suffix(f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    try:
        stream.write(json.dumps(says).encode())
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(beside, at):
        fs.delete(beside, False)
        raise RuntimeError(f"{path} has been changed by another writer since version {version - 1}")


def tidy(spark: SparkSession, path: str, keep: set[str]) -> None:
    """Deletes the folder's data that keep does not name, and all commits but the last."""
    fs, at = _fs(spark, path)
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        if name.startswith("data-") and name not in keep:
            fs.delete(s.getPath(), True)
    fs, at = _fs(spark, f"{path}/_commits")
    for s in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName())[:-1] if fs.exists(at) else []:
        fs.delete(s.getPath(), False)


def fresh_data() -> str:
    return f"data-{uuid.uuid4().hex}"


class KeyedTable:
    """A table of unique keys in buckets by the keys' hash; an upsert reads and writes only the buckets that it touches.

    A commit names each bucket's folder. The number of buckets is chosen once: as many as keep a bucket in one task's memory.
    Null keys hash as any other value. Rows of a bucket are written by one task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.version, self.state = last_commit(spark, path)
        if not self.version:
            raise ValueError(f"no table at {path}")

    @staticmethod
    def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedTable:
        """A new table of df, whose keys must be unique; an existing one is refused."""
        spark = df.sparkSession
        if last_commit(spark, path)[0]:
            raise ValueError(f"there is a table at {path}")
        says = {"keys": list(keys), "buckets": buckets, "folders": {}, "schema": df.schema.jsonValue()}
        says["folders"] = _write(df, path, says, range(buckets))
        commit(spark, path, 1, says)
        return KeyedTable(spark, path)

    def schema(self):
        from pyspark.sql.types import StructType

        return StructType.fromJson(self.state["schema"])

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all, or of some, buckets."""
        folders = [f for b, f in self.state["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(*[f"{self.path}/{f}" for f in folders])

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> KeyedTable:
        """The table with new merged in; merge(old rows, new rows) is upsert_nodes over the keys unless given.

        It sees the touched buckets only and must keep rows in their keys' buckets. The table's columns stay as they are.
        """
        new = saved(new)
        touched = sorted(r[0] for r in new.select(_bucket(self.state)).distinct().collect())
        if not touched:
            return self
        old = self.read(touched)
        merged = upsert_nodes(old, new, tuple(self.state["keys"])) if merge is None else merge(old, new)
        fields = self.schema()
        says = dict(self.state)
        says["folders"] = {b: f for b, f in self.state["folders"].items() if int(b) not in touched}
        says["folders"] |= _write(merged.select(*[F.col(f"`{c.name}`").cast(c.dataType) for c in fields]), self.path, says, touched)
        commit(self.spark, self.path, self.version + 1, says)
        return KeyedTable(self.spark, self.path)

    def vacuum(self) -> None:
        """Deletes what earlier versions and broken writers left."""
        tidy(self.spark, self.path, {f.split("/")[0] for f in self.state["folders"].values()})


def _bucket(state: dict):
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in state["keys"]]), F.lit(state["buckets"])).cast("int")


def _write(df: DataFrame, path: str, state: dict, buckets) -> dict[str, str]:
    """Writes df by bucket and returns the folder of each bucket that has rows."""
    at = fresh_data()
    name = "_bucket"
    df.withColumn(name, _bucket(state)).repartition(min(len(buckets), 1000), name).write.partitionBy(name).parquet(f"{path}/{at}")
    fs, where = _fs(df.sparkSession, f"{path}/{at}")
    found = {s.getPath().getName() for s in fs.listStatus(where)}
    return {str(b): f"{at}/{name}={b}" for b in buckets if f"{name}={b}" in found}
