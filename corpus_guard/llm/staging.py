"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_guard.plans.staging import shared_dir

#: Rows of (id) up to which a lookup side is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch of texts. A task holds several copies of one on both sides of the pipe, and Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def fresh(name: str, *taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it, whatever the case."""
    known = {c.lower() for columns in taken for c in columns}
    while name.lower() in known:
        name = "_" + name
    return name


def bound_batches(spark: SparkSession) -> None:
    """Have the session cut Arrow batches at BATCH_BYTES, unless it has a bound already. A row is never cut, so a longer text is a batch of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors, gives size statistics."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight=None) -> DataFrame:
    """``df`` (staged) with a broadcast hint when its counted rows, or the sum of ``weight``, are at most ``rows``."""
    n = df.limit(rows + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= rows else df
