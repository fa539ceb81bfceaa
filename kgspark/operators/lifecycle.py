"""Event log, erasure, publication, scopes and change feeds as folds over append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.store import cut

DELETE, RESTORE, PURGE = "node.deleted", "node.restored", "node.purged"
SOURCE_DELETE, SOURCE_PURGE = "source.deleted", "source.purged"
PUBLISH, UNPUBLISH = "node.published", "node.unpublished"
SOURCE_PUBLISH, SOURCE_UNPUBLISH = "source.published", "source.unpublished"
CHANGES = ("source.upserted", "source.removed")
#: Rows that one task numbers.
RANGE = 500_000


def append(events: DataFrame, new: DataFrame, *, observed_at: str) -> DataFrame:
    """Rows for new (event_type, object_type, object_id, payload, ord) that continue the log: numbered
    on from its last sequence, each chained to its object's last digest.

    The log's one writer numbers one batch; only the batch is ordered, not the log. It is dealt out by
    ranges of ``ord``, of at most about RANGE rows, written once; a range's numbers follow those before it.
    """
    cores = new.sparkSession.sparkContext.defaultParallelism
    new = cut(new.repartitionByRange(int(max(cores, new.count() // RANGE + 1)), "ord").withColumn("_range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in sorted(new.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_range"]):
        offsets.append((r["_range"], before))
        before += r["n"]
    new = new.join(F.broadcast(new.sparkSession.createDataFrame(offsets, "_range int, _before long")), "_range")
    last = events.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("base"))
    tip = events.groupBy("object_id").agg(F.max_by("new_digest", "sequence").alias("tip"))
    digest = F.sha2(X.text("payload"), 256)
    by = W.partitionBy("object_id").orderBy("ord")
    rows = new.crossJoin(F.broadcast(last)).withColumn("sequence", F.col("base") + F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy("ord"))).withColumn("new_digest", digest)
    rows = rows.join(tip, "object_id", "left").withColumn("prior_digest", F.coalesce(F.lag("new_digest").over(by), "tip", F.lit("")))
    at = F.lit(observed_at)
    eid = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in ("sequence", "event_type", "object_type", "object_id", "prior_digest", "new_digest")], at)), 256)
    return rows.select("sequence", eid.alias("event_id"), "event_type", "object_type", "object_id", "prior_digest", "new_digest", at.alias("observed_at"), "payload")


def chain_violations(events: DataFrame) -> DataFrame:
    """(sequence, violation): gaps in the numbering, broken chains, payloads that were altered."""
    by = W.partitionBy("object_id").orderBy("sequence")
    # a gap shows in an aggregate: distinct numbers from 1 to n
    span = events.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sequence").alias("d"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
    gaps = span.where("n > 0 and (n <> d or lo <> 1 or hi <> n)").select(F.lit(None).cast("long").alias("sequence"), F.lit("sequence has gaps").alias("violation"))
    chained = events.withColumn("before", F.coalesce(F.lag("new_digest").over(by), F.lit("")))
    found = F.filter(F.array(
        F.when(X.text("prior_digest") != F.col("before"), F.lit("broken chain")),
        F.when(F.col("new_digest") != F.sha2(X.text("payload"), 256), F.lit("altered payload")),
    ), lambda x: x.isNotNull())
    return chained.select(F.col("sequence").cast("long").alias("sequence"), F.explode(found).alias("violation")).unionByName(gaps)


def erasure(events: DataFrame, key: str, *, delete: str = DELETE, purge: str = PURGE, restore: str = RESTORE) -> DataFrame:
    """(key, state) of what is hidden: the last deletion or purge decides; a later restore undoes a
    deletion only. One aggregate, no order of events is kept."""
    own = events.where(F.col("event_type").isin(delete, purge, restore) & (X.text(key) != ""))
    hides = F.col("event_type").isin(delete, purge)
    folded = own.groupBy(key).agg(
        F.max(F.when(hides, F.struct("sequence", "event_type"))).alias("last"),
        F.max(F.when(F.col("event_type") == restore, F.col("sequence"))).alias("restored"),
    )
    kept = (F.col("last.event_type") == purge) | F.col("restored").isNull() | (F.col("restored") < F.col("last.sequence"))
    return folded.where(F.col("last").isNotNull() & kept).select(key, F.when(F.col("last.event_type") == purge, "purged").otherwise("deleted").alias("state"))


def publication(events: DataFrame, key: str, *, publish: str = PUBLISH, unpublish: str = UNPUBLISH) -> DataFrame:
    """(key) of what its last publication event published."""
    last = events.where(F.col("event_type").isin(publish, unpublish)).groupBy(key).agg(F.max_by("event_type", "sequence").alias("t"))
    return last.where(F.col("t") == publish).select(key)


def hide(docs: DataFrame, nodes: DataFrame, sources: DataFrame, *, doc_id: str = "doc_id", urn: str = "canonical_urn", by: tuple[str, ...] = ()) -> DataFrame:
    """docs without hidden nodes and without all of hidden sources.

    Ids may be short digests that nodes share by chance; columns of both, named in ``by``, tell such apart.
    """
    named = nodes.select(F.col("node_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in by])
    meet = F.col(doc_id) == F.col("_id")
    for c in by:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return docs.join(named, meet, "left_anti").join(sources.select(urn), urn, "left_anti")


def published_only(docs: DataFrame, nodes: DataFrame, sources: DataFrame, *, doc_id: str = "doc_id", urn: str = "canonical_urn") -> DataFrame:
    by_node = nodes.select(F.col("node_id").alias(doc_id)).distinct().withColumn("_a", F.lit(True))
    by_source = sources.select(urn).distinct().withColumn("_b", F.lit(True))
    return docs.join(by_node, doc_id, "left").join(by_source, urn, "left").where("_a or _b").drop("_a", "_b")


def changes_since(events: DataFrame, watermark: int, *, types: tuple[str, ...] = CHANGES) -> DataFrame:
    """(object_id, claim_ids) of what changed after the watermark."""
    own = events.where((F.col("sequence") > watermark) & F.col("event_type").isin(*types))
    flat = own.select("object_id", F.explode_outer("affected_claim_ids").alias("c"))
    return flat.groupBy("object_id").agg(F.array_sort(F.collect_set("c")).alias("claim_ids"))


def replay(events: DataFrame) -> DataFrame:
    """(object_id, payload) of each object that its last event leaves in being."""
    last = events.groupBy("object_id").agg(F.max(F.struct("sequence", "event_type", "payload")).alias("e"))
    return last.where(~F.col("e.event_type").isin("source.removed", SOURCE_PURGE, PURGE)).select("object_id", F.col("e.payload").alias("payload"))


def strip_node(transactions: DataFrame, node_id: str) -> DataFrame:
    """Transactions (txn_id, nodes, relations) without a node and what touches it; empty ones go."""
    touches = lambda r: (r["source"] == node_id) | (r["target"] == node_id)
    out = transactions.withColumn("nodes", F.filter("nodes", lambda n: n["node_id"] != node_id)).withColumn("relations", F.filter("relations", lambda r: ~touches(r)))
    return out.where(F.size("nodes") > 0)


def ancestors(path: Column) -> Column:
    """All proper prefixes of a folder path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scope_docs(docs: DataFrame, folder: str, published: DataFrame | None = None) -> DataFrame:
    """Own documents, those of folders below, and published ones of folders above; of equal ids the
    own one, then by path. docs have (folder, doc_id, …), published (doc_id)."""
    parts = folder.split("/")
    above = ["/".join(parts[:i]) for i in range(1, len(parts))]
    rank = F.when(F.col("folder") == folder, 0).when(F.startswith("folder", F.lit(folder + "/")), 1).when(F.col("folder").isin(*above), 2)
    seen = docs.withColumn("_r", rank).where("_r is not null")
    if published is not None:
        marks = published.select("doc_id").distinct().withColumn("_p", F.lit(True))
        seen = seen.join(marks, "doc_id", "left").where("_r < 2 or _p").drop("_p")
    best = W.partitionBy("doc_id").orderBy("_r", "folder")
    return seen.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_r")


def sync_plan(disk: DataFrame, state: DataFrame) -> DataFrame:
    """(path, action) from disk (path, size, mtime, sha1) and state: hashes matter where size or time
    differ."""
    both = disk.alias("d").join(state.alias("s"), "path", "full")
    same = (F.col("d.size") == F.col("s.size")) & (F.col("d.mtime") == F.col("s.mtime"))
    action = F.when(F.col("s.sha1").isNull(), "new").when(F.col("d.sha1").isNull(), "removed").when(same | (F.col("d.sha1") == F.col("s.sha1")), "unchanged").otherwise("changed")
    return both.select("path", action.alias("action"))
