"""Structured Streaming over event logs and folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators import lifecycle as L
from kgspark.store import shared_folder

STATE = "node_id string, hid_at long, hid_by string, restored_at long"


def partial_fold(batch: DataFrame) -> DataFrame:
    """What a batch says of each node: its last hiding event and its last restore. Partials merge in any
    order, so a batch that comes twice changes nothing."""
    hides = F.col("event_type").isin(L.DELETE, L.PURGE)
    last = F.max(F.when(hides, F.struct("sequence", "event_type")))
    return batch.groupBy("node_id").agg(last.alias("l"), F.max(F.when(F.col("event_type") == L.RESTORE, F.col("sequence"))).alias("restored_at")).select("node_id", F.col("l.sequence").alias("hid_at"), F.col("l.event_type").alias("hid_by"), "restored_at")


def merge_folds(partials: DataFrame) -> DataFrame:
    last = F.max(F.when(F.col("hid_at").isNotNull(), F.struct("hid_at", "hid_by")))
    folded = partials.groupBy("node_id").agg(last.alias("l"), F.max("restored_at").alias("r"))
    live = (F.col("l.hid_by") == L.PURGE) | F.col("r").isNull() | (F.col("r") < F.col("l.hid_at"))
    return folded.where(F.col("l").isNotNull() & live).select("node_id", F.when(F.col("l.hid_by") == L.PURGE, "purged").otherwise("deleted").alias("state"))


def fold_stream(spark: SparkSession, path: str, kinds: dict[str, str], *, location: str | None = None) -> DataFrame:
    """The erasure fold over all that is in a folder of events now, through a stream.

    ``location`` keeps the stream's checkpoint and partial folds: started again there, it reads only what
    is new and the fold is that of all it ever read. Without one, it starts anew.

    Each micro-batch writes its partial fold under its batch id (a repeated batch overwrites itself);
    the state is the merge of the partials.
    """
    at = (location or shared_folder(spark)).rstrip("/")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()], F.lit("source.seeded"))
    found = spark.read.parquet(path)
    reader = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 8)
    if not any(f.rstrip("/").rpartition("/")[0].endswith(path.rstrip("/").rpartition("/")[2]) for f in found.inputFiles()):
        parent, _, name = path.rstrip("/").rpartition("/")  # one file: a stream reads its folder
        reader, path = reader.option("pathGlobFilter", name), parent
    stream = reader.parquet(path).select(F.col("event_id").cast("long").alias("sequence"), kind.alias("event_type"), F.col("user_id").cast("string").alias("node_id"))

    def write(batch: DataFrame, number: int) -> None:
        partial_fold(batch).write.mode("overwrite").parquet(f"{at}/state/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return merge_folds(spark.read.schema(STATE).parquet(f"{at}/state").select("node_id", "hid_at", "hid_by", "restored_at"))


def windowed_counts(stream: DataFrame, *, ts: str = "ts", late: str = "10 minutes", size: str = "10 minutes") -> DataFrame:
    """An extension: counts by event type in tumbling windows, with a bound on lateness."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_counts(stream: DataFrame, *, ts: str = "ts", key: str = "user_id", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """An extension: counts by session."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def watch(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], *, every: str = "30 seconds", once: bool = False, location: str | None = None) -> StreamingQuery:
    """New files of a folder as (path, length, modificationTime, content), in micro-batches. With the same
    ``location`` for its checkpoint a watch that starts again goes on where it stopped."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", (location or shared_folder(spark)).rstrip("/") + "/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
