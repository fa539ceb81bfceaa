"""A library kept in step with its files: plan, claims, events, state and totals, as tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.operators import extract
from kgspark.operators.lifecycle import sync_plan
from kgspark.profiles import Profile
from kgspark.store import cut

STATE = "library string, path string, domain string, canonical_urn string, size long, mtime long, sha1 string"
DEFAULTS = {"profile_id": "generic", "exclude_prefixes": ["_"], "watch_interval_seconds": 30, "libraries": [], "overlay": False, "nd_systems": []}
LIBRARY_DEFAULTS = {"registry_csv": None, "registry_path_prefix": "", "urn_namespace": None}


class Pass(NamedTuple):
    """What one pass does: rows to add, sources whose old rows go, events for the log, the state after."""

    plan: DataFrame  #: (path, action)
    claims: DataFrame  #: claims of new and changed files
    gone: DataFrame  #: (canonical_urn, domain) whose earlier rows go
    events: DataFrame  #: (event_type, object_type, object_id, payload, affected_claim_ids, ord)
    state: DataFrame  #: state after the pass
    totals: DataFrame  #: (library, new, changed, removed, unchanged, claims, reuse, mint)


def config(text: str) -> dict:
    """A configuration (JSON) with its defaults; what libraries leave out they take from the top."""
    import json

    found = DEFAULTS | json.loads(text)
    found["libraries"] = [LIBRARY_DEFAULTS | {"exclude_prefixes": found["exclude_prefixes"]} | lib for lib in found["libraries"]]
    return found


def walk(disk: DataFrame, exclude: tuple[str, ...] = ("_",)) -> DataFrame:
    """disk (path, …) without hidden parts and excluded first parts, with ``domain``: the first folder."""
    parts = F.split("path", "/")
    out = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    for prefix in exclude:
        out = out | F.startswith(parts[0], F.lit(prefix))
    return disk.where(~out).withColumn("domain", F.when(F.size(parts) > 1, parts[0]).otherwise("_root"))


def profile_for(domains: DataFrame, by_library: dict[str, str], by_domain: dict[str, str], default: str) -> DataFrame:
    """(library, domain) with the profile of "library:domain", else of the domain, else the default."""
    look = lambda d, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key) if d else F.lit(None).cast("string")
    return domains.withColumn("profile", F.coalesce(look(by_library, F.concat_ws(":", "library", "domain")), look(by_domain, F.col("domain")), F.lit(default)))


def one_pass(library: str, disk: DataFrame, state: DataFrame, claims: DataFrame, profile: Profile, *, known: DataFrame | None = None, force: bool = False) -> Pass:
    """Brings a library in step: disk (path, size, mtime, sha1, text, domain) against its state.

    A file's urn is that of the registry (known: path, canonical_urn), else minted from its path. New and
    changed files are extracted, changed and removed ones take back their earlier claims (item_id,
    canonical_urn). A pass over what it left finds nothing to do.
    """
    own = state.where(F.col("library") == library)
    plan = cut(sync_plan(disk, own.select("path", "size", "mtime", "sha1")))
    if force:
        plan = plan.withColumn("action", F.when(F.col("action") == "unchanged", "changed").otherwise(F.col("action")))
    named = disk if known is None else disk.join(known.select("path", F.col("canonical_urn").alias("_r")), "path", "left")
    minted = X.source_urn(F.regexp_replace("path", r"\.[^.]+$", ""), profile.namespace)
    named = named.withColumn("canonical_urn", minted if known is None else F.coalesce("_r", minted)).withColumn("reused", F.lit(False) if known is None else F.col("_r").isNotNull())
    todo = named.join(plan.where("action in ('new', 'changed')"), "path")
    found = cut(extract.claims(todo, profile, key="path", urn=F.col("canonical_urn"), carry=("canonical_urn", "domain")).withColumn("library", F.lit(library)))
    before = own.join(plan.where("action in ('changed', 'removed')"), "path")
    gone = before.select("canonical_urn", "domain")
    none = F.array().cast("array<string>")
    old_ids = claims.groupBy("canonical_urn").agg(F.array_sort(F.collect_set("item_id")).alias("old"))
    new_ids = found.groupBy("canonical_urn").agg(F.array_sort(F.collect_set("item_id")).alias("new"))
    acted = todo.select("path", "action", "canonical_urn", "domain", "sha1").unionByName(before.where("action = 'removed'").select("path", "action", "canonical_urn", "domain", F.lit("").alias("sha1")))
    events = acted.join(old_ids, "canonical_urn", "left").join(new_ids, "canonical_urn", "left")
    touched = F.array_sort(F.array_union(F.coalesce("old", none), F.coalesce("new", none)))
    payload = F.to_json(F.struct(touched.alias("affected_claim_ids"), "canonical_urn", "domain", F.lit(library).alias("library"), F.col("path").alias("relpath"), "sha1"))
    events = events.select(
        F.when(F.col("action") == "removed", "source.removed").otherwise("source.upserted").alias("event_type"), F.lit("source").alias("object_type"),
        F.concat_ws(":", F.lit("source"), F.lit(library), "path").alias("object_id"), payload.alias("payload"), touched.alias("affected_claim_ids"), F.col("path").alias("ord"),
    )
    kept = own.join(plan.where("action = 'unchanged'"), "path", "left_semi")
    after = state.where(F.col("library") != library).unionByName(kept.select(*state.columns)).unionByName(todo.select(F.lit(library).alias("library"), "path", "domain", "canonical_urn", "size", "mtime", "sha1").select(*state.columns))
    counts = plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("new", "changed", "removed", "unchanged")])
    totals = counts.crossJoin(found.agg(F.count(F.lit(1)).alias("claims"))).crossJoin(todo.agg(F.count_if("reused").alias("reuse"), F.count_if(~F.col("reused")).alias("mint")))
    return Pass(plan, found, gone, events, after, totals.select(F.lit(library).alias("library"), "*"))


def apply(claims: DataFrame, done: Pass) -> DataFrame:
    """The claims after a pass: without those that it takes back, with those that it found."""
    return claims.join(done.gone.select("canonical_urn").distinct(), "canonical_urn", "left_anti").select(*claims.columns).unionByName(done.claims.select(*claims.columns))


def seed(library: str, disk: DataFrame, profile: Profile, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, events) that take a library as it is: nothing is extracted, a later pass sees it unchanged."""
    named = disk if known is None else disk.join(known.select("path", F.col("canonical_urn").alias("_r")), "path", "left")
    minted = X.source_urn(F.regexp_replace("path", r"\.[^.]+$", ""), profile.namespace)
    rows = named.select(F.lit(library).alias("library"), "path", "domain", (minted if known is None else F.coalesce("_r", minted)).alias("canonical_urn"), "size", "mtime", "sha1")
    events = rows.select(F.lit("source.seeded").alias("event_type"), F.lit("source").alias("object_type"), F.concat_ws(":", F.lit("source"), "library", "path").alias("object_id"), F.to_json(F.struct("canonical_urn", "domain", "library", F.col("path").alias("relpath"), "sha1")).alias("payload"), F.col("path").alias("ord"))
    return rows, events


def claim_ids(claims: DataFrame, urn: str) -> DataFrame:
    return claims.where(F.col("canonical_urn") == urn).select("item_id").distinct().orderBy("item_id")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of a store; none if there is no state yet."""
    try:
        rows = spark.read.schema(STATE + ", version long").parquet(path)
        newest = rows.agg(F.max("version")).first()[0]
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        newest = None
    return spark.createDataFrame([], STATE) if newest is None else rows.where(F.col("version") == newest).drop("version")


def write_state(state: DataFrame, path: str) -> None:
    """Writes a state as the next version: readers see the old one or the new one, never a part."""
    spark = state.sparkSession
    try:
        newest = spark.read.schema(STATE + ", version long").parquet(path).agg(F.max("version")).first()[0] or 0
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        newest = 0
    state.withColumn("version", F.lit(newest + 1)).write.mode("append").partitionBy("version").parquet(path)
