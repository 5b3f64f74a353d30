"""The folder for intermediate results that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of texts that go to a worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def batched(df: DataFrame) -> DataFrame:
    """df, whose session sends BATCH_BYTES to Python at once, where it has kept Spark's own default of 64 MB: JVM and worker
    each hold a batch several times, and keep that memory."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) in ("64m", "67108864b", str(64 << 20)):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df
