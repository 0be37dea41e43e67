"""Reading tables, and cutting lineage in storage that survives a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes a task below which an input is spread out.
SPREAD_BYTES = 64 << 20
#: Rows of a few numbers each up to which a side of a join may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table `name` under `root`, one Parquet file or folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    On a cluster it is the shared folder named in spark.checkpoint.dir, and it must be named:
    a folder of the driver's machine is no place that executors share. Only a local session
    without that setting makes a temporary folder, which goes with the process.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodetrace-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the checkpoint folder; what follows reads the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, of narrow rows, marked for broadcast if it has at most `most` of them; else as it is,
    for a shuffled join. Computed once for the count and the join."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def null_safe_hash(*cols: Column) -> Column:
    """A 64-bit hash in which a null differs from any value and cannot trade places with one."""
    return F.xxhash64(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}))


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as the cluster runs tasks.

    For expensive per-row work on an input of few files. The number of files and the
    optimizer's estimate of the size decide, so nothing is run; an input of as many files as
    tasks or of more than `SPREAD_BYTES` a task, as any large one, is not shuffled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= tasks or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SPREAD_BYTES * tasks:
        return df
    return df.repartition(tasks)
