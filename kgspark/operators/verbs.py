"""Requests to delete, restore, purge, publish and unpublish, as batches: guards, events, folds, strips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.operators import lifecycle as L

NODE_KINDS = ("claim", "concept", "sink")
#: (verb, whether a source is meant) -> event type.
EVENTS = {
    ("delete", False): L.DELETE, ("restore", False): L.RESTORE, ("purge", False): L.PURGE, ("publish", False): L.PUBLISH, ("unpublish", False): L.UNPUBLISH,
    ("delete", True): L.SOURCE_DELETE, ("restore", True): L.RESTORE, ("purge", True): L.SOURCE_PURGE, ("publish", True): L.SOURCE_PUBLISH, ("unpublish", True): L.SOURCE_UNPUBLISH,
}
SCOPE = "descendants"
ERASURES = (L.DELETE, L.RESTORE, L.PURGE, L.SOURCE_DELETE, L.SOURCE_PURGE)
PUBLICATIONS = (L.PUBLISH, L.UNPUBLISH, L.SOURCE_PUBLISH, L.SOURCE_UNPUBLISH)


def hidden(events: DataFrame) -> DataFrame:
    """(kind, id, state) of all hidden nodes and sources, over events with node_id and canonical_urn.

    A restore carries a node or a source; it undoes a deletion, never a purge."""
    nodes = L.erasure(events, "node_id").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "state")
    sources = L.erasure(events, "canonical_urn", delete=L.SOURCE_DELETE, purge=L.SOURCE_PURGE)
    return nodes.unionByName(sources.select(F.lit("source").alias("kind"), F.col("canonical_urn").alias("id"), "state"))


def distributed(events: DataFrame) -> DataFrame:
    """(kind, id) of what is published now."""
    nodes = L.publication(events, "node_id").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    return nodes.unionByName(L.publication(events, "canonical_urn", publish=L.SOURCE_PUBLISH, unpublish=L.SOURCE_UNPUBLISH).select(F.lit("source").alias("kind"), F.col("canonical_urn").alias("id")))


def audit(events: DataFrame, types: tuple[str, ...] = ERASURES) -> DataFrame:
    """The audit records of erasures (or publications): what was done to what, why, by whom, and which
    claims it touched."""
    shown = ("sequence", "node_id", "canonical_urn", "target_type", "target_id", "reason", "actor", "affected_claim_ids")
    return events.where(F.col("event_type").isin(*types)).select(F.col("event_type").alias("grade"), *[c for c in shown if c in events.columns])


def requests(asked: DataFrame, claims: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, refused) of requests (ord, verb, target, reason, actor).

    A target is "claim:…", "concept:…" or "sink:…", or a source's urn. Restoring what was purged or isn't
    deleted is refused, as is an unknown verb or an empty target; unpublishing what isn't published is
    no error. State is ``hidden``'s. Events are rows for the log: type, object, payload as JSON with
    sorted keys, affected claims.
    """
    prefix = F.regexp_extract("target", r"^([a-z]+):", 1)
    is_node = prefix.isin(*NODE_KINDS)
    own = asked.withColumn("_node", is_node).withColumn("_kind", F.when(is_node, prefix).otherwise("source"))
    own = own.withColumn("_id", F.when(is_node, F.regexp_replace("target", "^[a-z]+:", "")).otherwise(F.col("target")))
    # sink nodes are hidden by their bare id, claims and concepts by the prefixed one
    own = own.withColumn("_key", F.when(F.col("_kind") == "sink", F.col("_id")).otherwise(F.col("target")))
    was = state.select(F.when(F.col("kind") == "node", F.lit(True)).otherwise(F.lit(False)).alias("_node"), F.col("id").alias("_key"), F.col("state").alias("_state"))
    per_claim = claims.groupBy(F.col("item_id").alias("_id")).agg(F.min("canonical_urn").alias("_of")).withColumn("_kind", F.lit("claim"))
    per_source = claims.groupBy(F.col("canonical_urn").alias("_id")).agg(F.array_sort(F.collect_set("item_id")).alias("_affected")).withColumn("_kind", F.lit("source"))
    joined = own.join(was, ["_node", "_key"], "left").join(per_claim, ["_kind", "_id"], "left").join(per_source, ["_kind", "_id"], "left")
    why = (
        F.when(~F.col("verb").isin(*{v for v, _ in EVENTS}), "unknown verb")
        .when(X.text("_id") == "", "empty target")
        .when((F.col("verb") == "restore") & (F.col("_state") == "purged"), "was purged")
        .when((F.col("verb") == "restore") & F.col("_state").isNull(), "is not deleted")
    )
    judged = joined.withColumn("why", why)
    kind = F.lit(None).cast("string")
    for (verb, source), event in EVENTS.items():
        kind = F.when((F.col("verb") == verb) & (F.col("_node") == F.lit(not source)), F.lit(event)).otherwise(kind)
    none = F.array().cast("array<string>")
    affected = F.when(F.col("verb") == "restore", none).when(F.col("_kind") == "claim", F.array("_id")).otherwise(F.coalesce("_affected", none))
    urn = F.when(F.col("_kind") == "source", F.col("_id")).otherwise(X.text("_of"))
    fields = {
        "actor": X.text("actor"), "affected_claim_ids": affected, "canonical_urn": urn, "node_id": F.when(F.col("_node"), F.col("_key")).otherwise(""), "reason": X.text("reason"),
        "recoverable": F.col("verb") != "purge", "scope": F.when(F.col("verb") == "publish", F.lit(SCOPE)).otherwise(""), "target_id": F.when(F.col("_node"), F.col("_id")).otherwise(""), "target_type": F.when(F.col("_node"), F.col("_kind")).otherwise(""),
    }
    good = judged.where("why is null")
    events = good.select(
        "ord", kind.alias("event_type"), F.when(F.col("_node"), "node").otherwise("source").alias("object_type"), F.concat(F.when(F.col("_node"), "node:").otherwise("source:"), F.col("_key")).alias("object_id"),
        F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())])).alias("payload"), fields["node_id"].alias("node_id"), urn.alias("canonical_urn"), affected.alias("affected_claim_ids"),
    )
    return events, judged.where("why is not null").select("ord", "verb", "target", "why")


def strip_claims(claims: DataFrame, gone: DataFrame) -> DataFrame:
    """claims without the purged ones (id: "claim:…") and those of purged sources, for (kind, id, state)."""
    purged = gone.where("state = 'purged'")
    ids = purged.where("kind = 'node' and startswith(id, 'claim:')").select(F.regexp_replace("id", "^claim:", "").alias("item_id"))
    urns = purged.where("kind = 'source'").select(F.col("id").alias("canonical_urn"))
    return claims.join(ids, "item_id", "left_anti").join(urns, "canonical_urn", "left_anti").select(*claims.columns)


def strip_concepts(concepts: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.where("state = 'purged' and kind = 'node' and startswith(id, 'concept:')").select(F.regexp_replace("id", "^concept:", "").alias("concept_id"))
    return concepts.join(ids, "concept_id", "left_anti").select(*concepts.columns)


def strip_envelopes(envelopes: DataFrame, gone: DataFrame) -> DataFrame:
    """Envelopes without purged nodes, what touches them, and purged sources; those left empty go, the
    others are sealed again by whoever writes their digest.

    Only envelopes that hold a purged node are rewritten: the nodes meet the purged ids in a join.
    """
    purged = gone.where("state = 'purged'")
    ids = purged.where("kind = 'node'").select(F.col("id").alias("_n")).distinct()
    held = envelopes.select("idempotency_key", F.explode("nodes").alias("n")).select("idempotency_key", F.col("n.node_id").alias("_n")).join(ids, "_n", "left_semi")
    lost = held.groupBy("idempotency_key").agg(F.collect_set("_n").alias("_lost"))
    kept = envelopes.join(purged.where("kind = 'source'").select(F.col("id").alias("source_id")), "source_id", "left_anti").join(lost, "idempotency_key", "left")
    in_lost = lambda c: F.coalesce(F.array_contains(F.col("_lost"), c), F.lit(False))
    out = kept.withColumn("nodes", F.filter("nodes", lambda n: ~in_lost(n["node_id"]))).withColumn("relations", F.filter("relations", lambda r: ~(in_lost(r["source"]) | in_lost(r["target"]))))
    return out.where(F.size("nodes") > 0).select(*envelopes.columns)


def read_state(spark, path_or_json: str | bytes) -> DataFrame:  # noqa: ANN001
    """(kind, id, state) out of a stored erasure projection, by its path or as its bytes; none if absent."""
    names = {"deleted_nodes": ("node", "deleted"), "purged_nodes": ("node", "purged"), "deleted_sources": ("source", "deleted"), "purged_sources": ("source", "purged")}
    schema = ", ".join(f"{n} array<string>" for n in names)
    if isinstance(path_or_json, bytes):
        rows = spark.createDataFrame([(path_or_json.decode("utf-8", "replace"),)], "j string").select(F.from_json("j", schema).alias("s")).select("s.*")
    else:
        try:
            rows = spark.read.schema(schema).option("multiLine", True).json(path_or_json)
        except Exception as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            rows = spark.createDataFrame([], schema)
    parts = [rows.select(F.lit(kind).alias("kind"), F.explode(name).alias("id"), F.lit(state).alias("state")) for name, (kind, state) in names.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def written_state(state: DataFrame) -> DataFrame:
    """The projection as one JSON object of sorted lists, as ``read_state`` takes it."""
    pick = lambda kind, st: F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & (F.col("state") == st), F.col("id"))))
    lists = {f"{st}_{kind}s": pick(kind, st) for kind in ("node", "source") for st in ("deleted", "purged")}
    one: list[Column] = [c.alias(n) for n, c in sorted(lists.items())]
    return state.agg(*one).select(F.to_json(F.struct(*sorted(lists))).alias("json"))
