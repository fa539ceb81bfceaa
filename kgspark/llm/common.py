"""Session plumbing that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.store import spread as spread_rows

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a local master gets a temporary one,
    which goes when Python ends; on a cluster that is an error, as executors don't share their disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="kgspark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: lineage ends, an executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that no plan reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to all cores where it comes in one small file."""
    return spread_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(*cols: Column | str) -> Column:
    """A seeded order that has nothing to do with the order of ids."""
    return F.xxhash64(*cols, F.lit(17))


def sample_keys(keys: DataFrame, group: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct keys (_k) of each group, by a hash of the key: the same for any partitioning.

    Distinct keys are counted first (a sketch, with partial sums), and the hash leaves about four times
    the limit of each group, so no task and no sort ever holds more, however many keys there are.
    """
    counts = [(r[group], r["n"]) for r in keys.groupBy(group).agg(F.approx_count_distinct("_k").alias("n")).collect()]
    if not counts:
        return keys.select(group, "_k")
    share = F.create_map(*[x for g, n in counts for x in (F.lit(g), F.lit(int(min(1.0, (4 * limit + 64) / max(1, n)) * (1 << 30)) + 1))])
    few = keys.where(F.pmod(spread("_k"), F.lit(1 << 30)) < share[F.col(group)]).select(group, "_k").distinct()
    return few.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(spread("_k"), "_k"))).where(F.col("_n") <= limit).drop("_n")


def labelled(docs: DataFrame, labels: DataFrame, target: str, per_class: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """At most ``per_class`` labelled keys of each class as (_k, _t, _y): the bounded training sample.

    Only keys and labels are counted and ranked; the texts are fetched afterwards. Of rows that repeat
    a key, the least text is taken.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(target).cast("int").alias("_y")).where("_k is not null and _y in (0, 1)").distinct()
    chosen = sample_keys(known, "_y", per_class)
    found = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).join(F.broadcast(chosen), "_k")
    return found.groupBy("_k", "_y").agg(F.min("_t").alias("_t")).select("_k", "_t", "_y")


class BitTable:
    """Bits by which most keys outside a set of 64-bit keys are known to be outside. A key's place is its
    low bits: least hashes, as anchors are, have high bits of zero."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & self.mask).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


BLOCK_BITS = 16


def bit_table(keys: DataFrame, max_bytes: int) -> BitTable:
    """A table over keys (one long column): about 64 bits for each, ``max_bytes`` in all at most.

    Beyond that it tells less apart, but never denies a key. Tasks set the bits of blocks of 8 KB;
    only blocks, never keys, come to the driver.
    """
    name = keys.columns[0]
    n = keys.count()
    size = min(max(BLOCK_BITS, (64 * max(1, n)).bit_length()), (8 * max_bytes).bit_length() - 1)
    slots = keys.select(F.col(name).bitwiseAND(F.lit((1 << size) - 1)).alias("slot"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.unique(batch.column(0).to_numpy())
            head = np.flatnonzero(np.diff(slot >> BLOCK_BITS, prepend=-1))
            for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(slot)]):
                own = blocks.setdefault(int(slot[lo] >> BLOCK_BITS), np.zeros(1 << (BLOCK_BITS - 3), np.uint8))
                at = slot[lo:hi] & ((1 << BLOCK_BITS) - 1)
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.record_batch([pa.array([*blocks], pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"])

    packed = slots.repartition(F.shiftrightunsigned("slot", BLOCK_BITS)).mapInArrow(pack, "block int, bits binary").toArrow()
    bits = np.zeros(1 << (size - 3), np.uint8)
    for block, own in zip(packed.column("block").to_pylist(), packed.column("bits").to_pylist()):
        lo = block << (BLOCK_BITS - 3)
        bits[lo : lo + (1 << (BLOCK_BITS - 3))] = np.frombuffer(own, np.uint8)
    return BitTable(bits)
