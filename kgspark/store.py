"""The shared folder: where lineage is cut and streams keep their state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the session names. Where it names none, a local master gets a
    temporary one, which goes when Python ends; on a cluster, whose disks aren't shared, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="kgspark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = "file://" + local
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes rows that several branches of a plan need, and reads them again: they are computed once,
    and a lost executor costs a reread only."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer files and splits than there are cores is dealt out to all of them;
    a large one is left as it is, so this never shuffles more than a split for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df._jdf.queryExecution().toRdd().getNumPartitions() <= cores:
        return df.repartition(cores)
    return df
