"""Tables of intermediate results in the folder that a cluster shares: they cut long plans and outlive lost executors."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions that name no shared folder and run on one machine (tests, a laptop).
LOCAL = "file:///tmp/checkpoints/spanforge"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or LOCAL).rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """The frame, written and read again: what is built on it several times is computed and planned once."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input files behind a task of a step that sorts and groups in memory.
PART_BYTES = 8 << 20


def by_key(df: DataFrame, key: list[str]) -> DataFrame:
    """The frame dealt by key over as many parts as its input files want, so that a task's memory does not grow with the
    input; small or unknown inputs are left to the planner."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = math.ceil(sum(s for s in sizes if s < 1 << 50) / PART_BYTES)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *key) if n > 1 else df
