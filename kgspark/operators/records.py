"""Dimensioned subgraphs: envelopes, idempotent sink, records and runtime facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.profiles import DIMENSIONS
from kgspark.store import cut

NODE = "struct<node_id:string,node_type:string,dimensions:map<string,string>,properties:map<string,string>>"
RELATION = "struct<relation_id:string,relation_type:string,source:string,target:string,dimension:string,evidence_ids:array<string>>"
EVIDENCE = "struct<evidence_id:string,source_id:string,locator:string,content_digest:string>"
ENVELOPE = f"idempotency_key string, source_id string, content_digest string, axes array<string>, evidence array<{EVIDENCE}>, nodes array<{NODE}>, relations array<{RELATION}>"


def envelope_violations(envelopes: DataFrame) -> DataFrame:
    """(idempotency_key, violation): repeated ids, references that lead nowhere, axes not declared."""
    ids = lambda c, f: F.transform(c, lambda x: x[f])
    repeated = lambda c, f: F.size(F.array_distinct(ids(c, f))) < F.size(c)
    nodes, evidence = ids("nodes", "node_id"), ids("evidence", "evidence_id")
    checks = [
        (X.text("idempotency_key") == "", "idempotency_key is empty"),
        (~F.col("content_digest").rlike("^[0-9a-f]{64}$"), "content_digest is no sha256"),
        (repeated("nodes", "node_id"), "node ids repeat"),
        (repeated("relations", "relation_id"), "relation ids repeat"),
        (repeated("evidence", "evidence_id"), "evidence ids repeat"),
        (F.exists("nodes", lambda n: ~F.forall(F.map_keys(n["dimensions"]), lambda k: F.array_contains(F.col("axes"), k))), "node has an undeclared axis"),
        (F.exists("relations", lambda r: ~F.array_contains(nodes, r["source"]) | ~F.array_contains(nodes, r["target"])), "relation has an unknown end"),
        (F.exists("relations", lambda r: ~r["dimension"].isin(*DIMENSIONS)), "relation has an unknown dimension"),
        (F.exists("relations", lambda r: F.exists(r["evidence_ids"], lambda e: ~F.array_contains(evidence, e))), "relation has unknown evidence"),
        (F.exists("evidence", lambda e: e["source_id"] != F.col("source_id")), "evidence of another source"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in checks]), lambda x: x.isNotNull())
    return envelopes.select("idempotency_key", F.explode(found).alias("violation"))


def digest(envelopes: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(envelopes.columns) if c not in ("txn_id", "digest")])), 256)


def upsert(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(idempotency_key, digest, status) of each envelope: created, unchanged, or conflict if the key is
    there with other content."""
    new = incoming.select("idempotency_key", digest(incoming).alias("digest"))
    per_key = new.groupBy("idempotency_key").agg(F.min("digest").alias("digest"), F.countDistinct("digest").alias("k"))
    old = store.select("idempotency_key", F.col("digest").alias("_old"))
    status = F.when((F.col("k") > 1) | (F.col("_old") != F.col("digest")), "conflict").when(F.col("_old").isNotNull(), "unchanged").otherwise("created")
    return per_key.join(old, "idempotency_key", "left").select("idempotency_key", "digest", status.alias("status"))


def nodes(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("idempotency_key", "source_id", F.posexplode("nodes").alias("pos", "n")).select("idempotency_key", "source_id", "pos", "n.*")


def records(envelopes: DataFrame) -> DataFrame:
    """One row for each node with the relations that touch it and its transaction's evidence, from within
    its envelope, so nothing is shuffled. Relations are put under their ends once, so an envelope costs
    its nodes and relations, not their product."""
    ends = F.flatten(F.transform("relations", lambda r: F.transform(F.array_distinct(F.array(r["source"], r["target"])), lambda e: F.struct(e.alias("e"), r.alias("r")))))
    keyed = envelopes.withColumn("_ends", F.array_sort(F.transform(ends, lambda x, i: F.struct(x["e"].alias("e"), i.alias("i"), x["r"].alias("r")))))
    # runs of one end: where each begins, by the end before it
    heads = F.filter(F.transform("_ends", lambda x, i: F.when((i == 0) | (F.get("_ends", F.greatest(i - 1, F.lit(0)))["e"] != x["e"]), F.struct(x["e"].alias("e"), i.alias("lo")))), lambda h: h.isNotNull())
    keyed = keyed.withColumn("_heads", heads)
    spans = F.transform("_heads", lambda h, k: F.struct(h["e"].alias("key"), F.struct(h["lo"].alias("lo"), F.coalesce(F.get("_heads", k + 1)["lo"], F.size("_ends")).alias("hi")).alias("value")))
    e = keyed.withColumn("_at", F.map_from_entries(spans)).select("*", F.explode("nodes").alias("n"))
    at = F.try_element_at("_at", F.col("n.node_id"))
    none = F.array().cast(envelopes.schema["relations"].dataType)
    touching = F.when(at.isNull(), none).otherwise(F.transform(F.slice("_ends", at["lo"] + 1, at["hi"] - at["lo"]), lambda x: x["r"]))
    return e.select("idempotency_key", F.col("n.node_id").alias("node_id"), F.col("n.node_type").alias("node_type"), F.col("n.dimensions").alias("dimensions"), F.col("n.properties").alias("properties"), "source_id", touching.alias("relations"), "evidence")


def latest_records(rows: DataFrame, version: Column, *, arrival: str = "arrival") -> DataFrame:
    """Of records with a version the greatest of each node, the first that came among equals; records
    without one all stay."""
    rows = rows.withColumn("_v", version)
    best = W.partitionBy("node_id").orderBy(F.desc("_v"), arrival)
    numbered = rows.where("_v is not null").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return rows.where("_v is null").unionByName(numbered).drop("_v")


def touching(relations: DataFrame, node_id: str) -> DataFrame:
    return relations.where((F.col("source") == node_id) | (F.col("target") == node_id))


VERSION = "_version"


def current(envelopes: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """``records`` of all envelopes as they stand now: of identity records (a node with a _version) the
    latest, first come among equals by idempotency key; without hidden nodes and sources (kind, id, state)."""
    rows = latest_records(records(envelopes).withColumn("_a", F.col("idempotency_key")), F.try_element_at("properties", F.lit(VERSION)), arrival="_a").drop("_a")
    if gone is None:
        return rows
    nodes = gone.where("kind = 'node'").select(F.col("id").alias("node_id")).distinct()
    sources = gone.where("kind = 'source'").select(F.col("id").alias("source_id")).distinct()
    return rows.join(nodes, "node_id", "left_anti").join(sources, "source_id", "left_anti").select(*rows.columns)


def get_record(envelopes: DataFrame, node_id: str, gone: DataFrame | None = None) -> DataFrame:
    """The whole record of one node, or no row. Envelopes without the node aren't unfolded."""
    held = envelopes.where(F.exists("nodes", lambda n: n["node_id"] == node_id))
    return current(held, gone).where(F.col("node_id") == node_id).orderBy("idempotency_key").limit(1)


def node_docs(envelopes: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Search documents, one for each node as it stands now."""
    return record_docs(current(envelopes, gone))


def record_docs(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node_id").alias("doc_id"), F.col("node_type").alias("type"), F.array_join(F.array_sort(F.map_values("properties")), " ").alias("text"), F.col("dimensions").alias("facets"), F.col("source_id").alias("canonical_urn"))


def search_records(envelopes: DataFrame, query: str | dict, *, k: int = 10, gone: DataFrame | None = None) -> DataFrame:
    """The whole records of the k nodes most like the query by Jaccard, with ``score``: records are made
    once, and only the k hits meet them again."""
    from kgspark.operators import retrieve

    rows = cut(current(envelopes, gone))
    hits = retrieve.search_similar(record_docs(rows), query, k=k).select(F.col("doc_id").alias("node_id"), "score")
    one = rows.join(F.broadcast(hits), "node_id").withColumn("_n", F.row_number().over(W.partitionBy("node_id").orderBy("idempotency_key"))).where("_n = 1").drop("_n")
    return one.orderBy(F.desc("score"), "node_id")


def from_transactions(rows: DataFrame, *, json: str = "json") -> DataFrame:
    """Envelopes out of transactions in memory, as JSON texts: a transaction with its envelope inside or
    the envelope itself. What can't be read or breaks a rule is skipped."""
    bare = F.from_json(F.coalesce(F.get_json_object(json, "$.envelope"), F.col(json)), ENVELOPE, {"mode": "PERMISSIVE"})
    read = rows.select(bare.alias("e")).where("e is not null and e.idempotency_key is not null and e.nodes is not null").select("e.*")
    empty = {"axes": "array<string>", "evidence": f"array<{EVIDENCE}>", "relations": f"array<{RELATION}>"}
    read = read.withColumns({c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in empty.items()})
    return read.join(envelope_violations(read).select("idempotency_key").distinct(), "idempotency_key", "left_anti").select(*read.columns)


def facet_text(json: Column) -> Column:
    """All scalar values of nested facets (JSON), trimmed, in their order, with a blank between."""
    leaf = F.regexp_extract_all(F.regexp_replace(X.text(json), r'"(?:[^"\\]|\\.)*"\s*:', ""), F.lit(r'"((?:[^"\\]|\\.)*)"|(-?[0-9][0-9.eE+-]*|true|false)'), F.lit(0))
    plain = F.transform(leaf, lambda v: F.trim(F.when(F.startswith(v, F.lit('"')), F.substring(v, F.lit(2), F.length(v) - 2)).when(v == "true", "True").when(v == "false", "False").otherwise(v)))
    return F.array_join(F.filter(plain, lambda v: v != ""), " ")


def evidence_entries(actor: Column, seed: Column, observed_at: Column, captures: Column) -> Column:
    """Evidence of a runtime assertion: the assertion itself, marked as such by a fixed digest, then each
    capture (kind, content, locator) under the digest of its content. Captures without content are left out."""
    source = F.concat(F.lit("runtime:"), X.slug(actor))
    stamp = F.coalesce(F.nullif(observed_at, F.lit("")), F.lit("-"))
    row = lambda ident, locator, digest: F.struct(ident.alias("evidence_id"), source.alias("source_id"), locator.alias("locator"), digest.alias("content_digest"))
    first = row(F.concat(F.lit("evidence:runtime:"), F.substring(F.sha2(F.concat_ws("\x1f", source, seed), 256), 1, 10)), F.concat_ws(":", F.lit("runtime"), X.slug(actor), stamp), F.sha2(F.lit("runtime-assertion"), 256))
    kind = lambda c: F.coalesce(F.nullif(X.slug(c["kind"]), F.lit("")), F.lit("capture"))
    place = lambda c, i: F.coalesce(F.nullif(c["locator"], F.lit("")), F.concat(F.concat_ws(":", F.lit("runtime"), kind(c), X.slug(actor), stamp), F.lit("#"), i))
    fine = F.filter(F.coalesce(captures, F.array().cast("array<struct<kind:string,content:string,locator:string>>")), lambda c: X.text(c["content"]) != "")
    more = F.transform(fine, lambda c, i: row(F.concat(F.lit("evidence:"), kind(c), F.lit(":"), F.substring(F.sha2(F.concat_ws("\x1f", c["content"], i.cast("string")), 256), 1, 10)), place(c, i), F.sha2(c["content"], 256)))
    return F.concat(F.array(first), more)


CAPTURE = "kind string, content string, locator string"


def record_envelopes(rows: DataFrame, *, identity: bool = False) -> DataFrame:
    """Envelopes of runtime records (id, record as JSON, summary, body, facets as JSON, dimension, actor,
    version, observed_at, captures): one node each, which carries the whole record.

    Rows are one envelope if all that their key is made of is equal; the key itself is a short digest, which
    others may share by chance. By content: a changed record is another node. By identity (a version is needed, rows without one are
    an error): one node for each id, whose versions are transactions of their own; readers take the latest.
    """
    if identity:
        rows = rows.withColumn("version", F.when(F.trim(X.text("version")) == "", F.raise_error(F.lit("an identity record needs a version"))).otherwise(F.col("version")))
    text = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (X.text("summary"), X.text("body"), facet_text(F.col("facets")))])
    short = F.substring(F.sha2("record", 256), 1, 10)
    ident = F.coalesce(F.nullif(F.trim(X.text("id")), F.lit("")), F.concat(F.lit("record:"), short))
    node_id = F.concat(F.lit("record:"), X.slug(ident)) if identity else F.concat(F.lit("record:"), X.slug(ident), F.lit(":"), short)
    seal = F.concat_ws("\x1f", "record", "dimension", "actor", *(["version"] if identity else []))
    key = F.concat(F.lit("runtime-record:"), F.substring(F.sha2(seal, 256), 1, 10))
    source = F.concat(F.lit("runtime:"), X.slug(F.col("actor")))
    named = {"name": ident, "statement": F.coalesce(F.nullif(text, F.lit("")), ident), "kind": F.lit("runtime-record"), "grounding": F.lit("runtime"), "actor": F.col("actor"), "record": F.col("record")} | ({VERSION: F.col("version")} if identity else {})
    node = F.struct(node_id.alias("node_id"), F.lit("record").alias("node_type"), F.create_map(F.col("dimension"), ident).alias("dimensions"), F.create_map(*[x for n, c in named.items() for x in (F.lit(n), c)]).alias("properties"))
    once = rows.withColumn("_seal", F.sha2(seal, 256)).dropDuplicates(["_seal"])
    return once.select(
        key.alias("idempotency_key"), source.alias("source_id"), F.sha2(F.concat(F.lit("source:"), source), 256).alias("content_digest"), F.array("dimension").alias("axes"),
        evidence_entries(F.col("actor"), key, F.col("observed_at"), F.col("captures")).alias("evidence"), F.array(node).alias("nodes"), F.array().cast(f"array<{RELATION}>").alias("relations"),
    )


def fact_ids(subject: Column, obj: Column) -> Column:
    term = lambda c: F.concat(F.lit("entity:"), X.slug(c), F.lit("-"), F.substring(F.sha2(c, 256), 1, 10))
    return F.struct(term(subject).alias("source"), term(obj).alias("target"))


def facts(rows: DataFrame) -> DataFrame:
    """Two nodes and their relation for each (subject, predicate, object, dimension, actor)."""
    ids = rows.withColumn("f", fact_ids(F.col("subject"), F.col("object")))
    key = F.sha2(F.concat_ws("\x1f", "subject", "predicate", "object", "dimension", "actor"), 256)
    return ids.select(key.alias("idempotency_key"), "f.source", "f.target", F.col("predicate").alias("relation_type"), "dimension", "actor")


def inference_path(rows: DataFrame) -> DataFrame:
    """(path_id, n, source, target): the steps between neighbours of a path (path_id, path)."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("source"), F.element_at("path", i + 1).alias("target")))
    return rows.where(F.size("path") > 1).select("path_id", F.posexplode(steps).alias("n", "s")).select("path_id", "n", "s.*")


def _depth(json: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested: brackets outside of its strings."""
    marks = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    count = lambda c, at: F.when(c.isin("{", "["), at + 1).otherwise(at - 1)
    walked = F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("top")), lambda s, c: X.bind(count(c, s["at"]), lambda at: F.struct(at.alias("at"), F.greatest(s["top"], at).alias("top"))))
    return walked["top"]


def structure(rows: DataFrame, *, key: str = "doc_id", json: str = "json") -> DataFrame:
    """(key, path, value): every leaf of a JSON document by its path.

    Each level of nesting is one step of a plan over all rows, so neither rows nor depth are limited by
    a recursion; levels are written down every ten steps. How many there are is an aggregate over the texts.
    """
    depth = rows.agg(F.max(_depth(F.col(json)))).first()[0] or 0
    v = rows.select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.parse_json(json).alias("v"))
    for level in range(depth):
        # a leaf stays as it is; a container gives way to what it holds, an empty one to nothing
        inner = v.sparkSession.sql("SELECT r._key, r.path, r.v, e.pos, e.key, e.value FROM {rows} r, LATERAL variant_explode_outer(r.v) e", rows=v)
        held = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        step = F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), "pos", F.lit("]"))))
        v = inner.where(F.coalesce(~held, F.lit(True)) | F.col("pos").isNotNull()).select("_key", F.when(held, step).otherwise(F.col("path")).alias("path"), F.when(held, F.col("value")).otherwise(F.col("v")).alias("v"))
        if level % 10 == 9:
            v = cut(v)
    leaf = ~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    return v.where(leaf).select(F.col("_key").alias(key), "path", F.col("v").cast("string").alias("value"))
