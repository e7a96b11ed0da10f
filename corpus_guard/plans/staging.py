"""Tables written once and read again, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted lookup side is broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset on a local master only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once and read back, in folders by columns that readers ask for: readers share one computation, and lost executors do not lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A lookup side, staged and counted: broadcast up to ``rows``, so that a join on few, hot keys does not deal the large side by them; a shuffle join beyond."""
    side = stage(df, name)
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
