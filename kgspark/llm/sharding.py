"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import fresh

N_SHARDS = 1000


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The bucket of each 64-bit key: a walk of about ln(n_shards) jumps, all keys at once."""
    key, bucket, live = keys.astype(np.uint64, copy=True), np.zeros(len(keys), np.int64), np.arange(len(keys))
    jumped = np.zeros(len(keys), np.int64)
    while len(live):
        bucket[live] = jumped[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        jumped[live] = np.floor((bucket[live] + 1) * (2147483648.0 / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[jumped[live] < n_shards]
    return bucket


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard of a stable key: the first 64 bits of its text's MD5, jumped. Only two numbers go to Python."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")

    @F.pandas_udf("int")
    def shard(high: pd.Series, low: pd.Series) -> pd.Series:
        keys = (high.to_numpy(np.uint64) << np.uint64(32)) | low.to_numpy(np.uint64)
        return pd.Series(jump(keys, n_shards).astype(np.int32))

    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return shard(*[F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9)])


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, *, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row; appending shards moves only the share that they take.

    No shuffle and no ring table: a row's shard depends on its key and the number of shards alone.
    Null keys share one shard, that of the empty string. Repeated keys get the same shard. Texts are
    not looked at. Empty table: empty result. If docs has a column of that name, it stays and the
    new one gets an underscore.
    """
    return docs.withColumn(fresh(docs, name)[0], shard_of(F.col(key), n_shards))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, *, key: str = "doc_id") -> None:
    """One folder for each shard; one shuffle brings a shard's rows together."""
    name = fresh(docs, "shard")[0]
    assign_shards(docs, n_shards, key=key, name=name).repartition(name).write.partitionBy(name).parquet(path)
