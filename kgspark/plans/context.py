"""Queries over context axes, identity, lifecycle events and subgraph records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.operators import identity as I
from kgspark.operators import lifecycle as L
from kgspark.operators import nd as N
from kgspark.operators import records as R
from kgspark.operators.graph import latest
from kgspark.plans.base import table
from kgspark.store import cut

LATEST = 2030
KINDS = {"view": "source.seeded", "click": L.DELETE, "error": L.PURGE, "signup": L.RESTORE, "purchase": "source.upserted"}


def _events(spark, sf):  # noqa: ANN001
    """The event table as a log: users are objects, event ids number them."""
    e = table(spark, sf, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()], F.lit("source.seeded"))
    rank = F.col("event_id").cast("long")
    return e.select(rank.alias("sequence"), kind.alias("event_type"), F.col("user_id").cast("string").alias("object_id"), F.col("user_id").cast("string").alias("node_id"), F.col("props").alias("payload"), F.array(F.concat(F.lit("c"), F.pmod(rank, F.lit(7)))).alias("affected_claim_ids"))


def event_fold_erasure(spark, sf):  # noqa: ANN001
    return L.erasure(_events(spark, sf), "node_id")


def event_fold_publish(spark, sf):  # noqa: ANN001
    return L.publication(_events(spark, sf), "node_id", publish="source.upserted", unpublish=L.DELETE)


def change_feed(spark, sf):  # noqa: ANN001
    return L.changes_since(_events(spark, sf), 500, types=("source.upserted",)).select("object_id", F.array_join("claim_ids", ",").alias("claim_ids"))


def event_replay(spark, sf):  # noqa: ANN001
    return L.replay(_events(spark, sf))


def events_chain_check(spark, sf):  # noqa: ANN001
    """A log appended from the table has no violation; one with a row taken out and one altered has."""
    e = _events(spark, sf)
    empty = spark.createDataFrame([], "sequence long, object_id string, new_digest string")
    new = e.select("event_type", F.lit("user").alias("object_type"), "object_id", "payload", F.col("sequence").alias("ord"))
    log = cut(L.append(empty, new, observed_at="2024-01-01T00:00:00Z"))
    bad = log.where("sequence <> 100").withColumn("payload", F.when(F.col("sequence") == 200, F.lit("altered")).otherwise(F.col("payload")))
    return L.chain_violations(log).groupBy("violation").agg(F.count(F.lit(1)).alias("n")).withColumn("log", F.lit("good")).unionByName(L.chain_violations(bad).groupBy("violation").agg(F.count(F.lit(1)).alias("n")).withColumn("log", F.lit("bad")))


def latest_wins(spark, sf):  # noqa: ANN001
    e = table(spark, sf, "events").select(F.col("user_id").alias("node_id"), F.col("value").alias("version"), F.col("event_id").alias("arrival"))
    return R.latest_records(e.withColumn("version", F.when(F.col("version") > 1, F.round("version", 0))), F.col("version")).where("version is not null")


def erased_docs(spark, sf):  # noqa: ANN001
    """Documents whose node or source isn't hidden by the folded log."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("canonical_urn"))
    hidden = L.erasure(_events(spark, sf), "node_id")
    sources = spark.createDataFrame([("src2",), ("src11",)], "canonical_urn string")
    return L.hide(docs, hidden, sources)


def hierarchy_scope(spark, sf):  # noqa: ANN001
    """Pages by host and path: what the first language folder of every host sees of its own and below."""
    p = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    docs = p.select(F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.col("page_id").alias("doc_id"))
    up = docs.select("doc_id", F.explode(L.ancestors(F.col("folder"))).alias("ancestor"))
    return up.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


def nd_relation(spark, sf):  # noqa: ANN001
    """Whether regions contain nations: attested from the tables, asked both ways."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    ontology = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("place").alias("axis"), F.col("r_name").alias("left"), F.col("n_name").alias("right"), F.lit("contains").alias("relation"))
    axes = spark.createDataFrame([("place", ["equal", "contains", "disjoint"])], "axis string, primitives array<string>")
    asked = n.select(F.lit("place").alias("axis"), F.col("n_name").alias("lv")).crossJoin(r.select(F.col("r_name").alias("rv"))).withColumn("primitive", F.lit("contained_by"))
    return N.relation(asked, axes, ontology).select("lv", "rv", "truth")


def nd_scope_select(spark, sf):  # noqa: ANN001
    """Suppliers by their nation against one region: selected if inside, unknown if nothing is attested,
    excluded if their nation's region is attested disjoint."""
    r, n, s = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "supplier")
    inside = r.join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    ontology = inside.select(F.lit("place").alias("axis"), F.col("r_name").alias("left"), F.col("n_name").alias("right"), F.lit("contains").alias("relation")).unionByName(
        inside.where("r_name = 'EUROPE'").select(F.lit("place").alias("axis"), F.col("n_name").alias("left"), F.lit("ASIA").alias("right"), F.lit("disjoint").alias("relation"))
    )
    axes = spark.createDataFrame([("place", ["equal", "contains", "disjoint"])], "axis string, primitives array<string>")
    scopes = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("claim_id"), F.lit("place").alias("axis"), F.col("n_name").alias("value"))
    wanted = spark.createDataFrame([("place", "ASIA")], "axis string, value string")
    return N.select_by_scope(N.scope_compatibility(scopes, wanted, axes, ontology))


def nd_binding_gaps(spark, sf):  # noqa: ANN001
    """Labelled documents lack the slot "jurisdiction" unless they are toxic."""
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("claim_id"), "toxic")
    rules = spark.createDataFrame([("jurisdiction", True), ("time", False)], "form_slot string, required boolean")
    return N.binding_gaps(l, rules, l.where("toxic = 1").select("claim_id", F.lit("jurisdiction").alias("form_slot")))


def dim_compose_closure(spark, sf):  # noqa: ANN001
    return N.composition_table(spark)


def nd_value_checks(spark, sf):  # noqa: ANN001
    """Order priorities against a closed vocabulary that lacks one, keys as non-negative integers."""
    o = table(spark, sf, "orders")
    words = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")])
    none = F.lit(None).cast("string")
    a = o.select(N.value_violation(F.col("o_orderpriority"), F.lit("string"), words, F.lit("closed"), none).alias("v"))
    b = o.select(N.value_violation((F.col("o_orderkey") - 1000).cast("string"), F.lit("non_negative_integer"), words, F.lit("open"), none).alias("v"))
    return a.unionByName(b).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def _turns(spark, sf):  # noqa: ANN001
    c = table(spark, sf, "conversations")
    part = F.struct(F.lit("step").alias("role"), F.concat_ws(":", "conv_id", "turn").alias("target_id"), F.array(F.col("role")).alias("evidence_ids"), F.col("turn").alias("position"))
    return c.groupBy(F.col("conv_id").cast("string").alias("composition_id")).agg(F.lit("process").alias("kind"), F.sort_array(F.collect_list(part)).alias("participants"))


def trajectory_steps(spark, sf):  # noqa: ANN001
    return N.steps_of(_turns(spark, sf))


def readings_grounded_by(spark, sf):  # noqa: ANN001
    return N.grounded_by(_turns(spark, sf), "system")


def composition_checks(spark, sf):  # noqa: ANN001
    return N.composition_violations(_turns(spark, sf)).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def composition_edges(spark, sf):  # noqa: ANN001
    return N.composition_rows(_turns(spark, sf)).select("edge_id", "src_id", "dst_id", "semantic_role")


def _envelopes(spark, sf):  # noqa: ANN001
    """A conversation as an envelope: turns are nodes, neighbours are related."""
    c = table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    node = lambda x: F.struct(x["id"].alias("node_id"), x["role"].alias("node_type"), F.create_map(F.lit("role"), x["role"]).alias("dimensions"), F.create_map(F.lit("text"), x["text"]).alias("properties"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "id", "role", "text")))
    g = c.groupBy("conv_id").agg(F.transform(rows, node).alias("nodes"))
    pair = F.filter(F.transform("nodes", lambda n, i: F.when(i > 0, F.struct(
        F.concat(F.lit("r"), i).alias("relation_id"), F.lit("follows").alias("relation_type"), F.get(F.col("nodes"), F.greatest(i - 1, F.lit(0)))["node_id"].alias("source"), n["node_id"].alias("target"),
        F.lit("temporal").alias("dimension"), F.array(F.lit("e1")).alias("evidence_ids")))), lambda x: x.isNotNull())
    source = F.col("conv_id").cast("string")
    evidence = F.array(F.struct(F.lit("e1").alias("evidence_id"), source.alias("source_id"), F.lit("").alias("locator"), F.lit("").alias("content_digest")))
    return g.select(source.alias("idempotency_key"), source.alias("source_id"), F.sha2(source, 256).alias("content_digest"), F.array(F.lit("role")).alias("axes"), evidence.alias("evidence"), "nodes", pair.alias("relations"))


def subgraph_nodes(spark, sf):  # noqa: ANN001
    return R.nodes(_envelopes(spark, sf)).select("idempotency_key", "pos", "node_id", "node_type")


def subgraph_checks(spark, sf):  # noqa: ANN001
    """Envelopes of which the axes are left out are in violation."""
    e = _envelopes(spark, sf)
    bad = e.withColumn("axes", F.array().cast("array<string>"))
    return R.envelope_violations(e.unionByName(bad)).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def subgraph_upsert(spark, sf):  # noqa: ANN001
    """A store of the even conversations meets all of them, those by tens with other content."""
    e = _envelopes(spark, sf)
    store = e.where("cast(idempotency_key as int) % 2 = 0").select("idempotency_key", R.digest(e).alias("digest"))
    new = e.withColumn("source_id", F.when(F.expr("cast(idempotency_key as int) % 10 = 0"), F.lit("other")).otherwise(F.col("source_id")))
    return R.upsert(store, new).select("idempotency_key", "status")


def record_touching_relations(spark, sf):  # noqa: ANN001
    return R.records(_envelopes(spark, sf)).select("node_id", F.size("relations").alias("n_relations"), F.size("evidence").alias("n_evidence"))


def runtime_facts(spark, sf):  # noqa: ANN001
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.facts(n.select(F.col("n_name").alias("subject"), F.lit("part of").alias("predicate"), F.col("r_name").alias("object"), F.lit("structural").alias("dimension"), F.lit("a").alias("actor")))


def dedup_capture(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.format_string("%08d.txt", "doc_id").alias("path"), F.sha1("text").alias("sha1"))
    return I.capture(d)


def duplicate_families(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.md5("text").alias("canonical_urn"), F.concat("source", F.lit("/"), F.col("doc_id")).alias("path"))
    return I.duplicate_families(d)


def sync_plan(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id")).alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.sha1("text").alias("sha1"), "source")
    state = d.where("source <> 'src1'").withColumn("size", F.when(F.col("source") == "src2", F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha1", F.when(F.col("source").isin("src2", "src3"), F.lit("x")).otherwise(F.col("sha1")))
    return L.sync_plan(d.where("source <> 'src4'").drop("source"), state.drop("source"))


def year_from_text(spark, sf):  # noqa: ANN001
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("filed 1234 on "), F.col("o_orderdate").cast("string"), F.lit(" of 9999")).alias("t"))
    return o.select(X.year_from_text(F.col("t"), LATEST).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def url_identity(spark, sf):  # noqa: ANN001
    return table(spark, sf, "pages").select("page_id", X.url_urn(F.col("url"), "web").alias("urn"))


def registry_reuse(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.concat(F.lit("./"), "source", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("relpath"), "doc_id")
    known = table(spark, sf, "documents").where("lang in ('de', 'fr')").select(F.when(F.col("lang") == "de", F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt"))).otherwise(F.concat(F.lit("old/"), F.col("doc_id"), F.lit(".txt"))).alias("relpath"), F.concat(F.lit("urn:x:"), F.col("doc_id")).alias("canonical_urn"))
    return I.reuse(d, known).select("doc_id", "canonical_urn", "provenance")


def missing_from_registry(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("relpath"), F.col("doc_id").alias("ord"))
    known = table(spark, sf, "documents").where("lang <> 'en'").select(F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("relpath"), F.concat(F.lit("urn:x:"), F.col("doc_id")).alias("canonical_urn"))
    return I.missing(d, known)


def evidence_verify(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_urn"), "text")
    refs = d.select("source_urn", F.lit(2).alias("start"), F.lit(30).alias("end"), F.when(F.col("source_urn").cast("int") % 3 == 0, F.lit("0")).otherwise(F.sha2(F.substring("text", 3, 28), 256)).alias("digest"))
    return I.verify_evidence(refs, d).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def window_tumbling_ext(spark, sf):  # noqa: ANN001
    """An extension: events in ten-minute windows."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def stream_fold_equals_batch(spark, sf):  # noqa: ANN001
    """The erasure fold of a stream of the event table, batch by batch."""
    from kgspark.streaming import events as S

    return S.fold_stream(spark, f"{sf}/events.parquet", KINDS)


def latest_order(spark, sf):  # noqa: ANN001
    return latest(table(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


QUERIES = (
    event_fold_erasure, event_fold_publish, change_feed, event_replay, events_chain_check, latest_wins, erased_docs, hierarchy_scope, nd_relation, nd_scope_select, nd_binding_gaps,
    dim_compose_closure, nd_value_checks, trajectory_steps, readings_grounded_by, composition_checks, composition_edges, subgraph_nodes, subgraph_checks, subgraph_upsert, record_touching_relations,
    runtime_facts, dedup_capture, duplicate_families, sync_plan, year_from_text, url_identity, registry_reuse, missing_from_registry, evidence_verify, window_tumbling_ext, stream_fold_equals_batch, latest_order,
)

_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'source.seeded' END"
_LOG = f"WITH log AS (SELECT event_id AS sequence, {_KIND} AS event_type, user_id::VARCHAR AS object_id, props AS payload FROM events) "
_FOLD = _LOG + ", f AS (SELECT object_id AS node_id, max(sequence) FILTER (WHERE event_type IN ('node.deleted', 'node.purged')) AS s, arg_max(event_type, sequence) FILTER (WHERE event_type IN ('node.deleted', 'node.purged')) AS t, max(sequence) FILTER (WHERE event_type = 'node.restored') AS r FROM log GROUP BY 1), hidden AS (SELECT node_id, CASE WHEN t = 'node.purged' THEN 'purged' ELSE 'deleted' END AS state FROM f WHERE s IS NOT NULL AND (t = 'node.purged' OR r IS NULL OR r < s)) "
_TURN = "WITH c AS (SELECT *, conv_id::VARCHAR || ':' || turn::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations) "
_SLUG = "substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) || '-' || substr(sha256({0}), 1, 10)"

ORACLES = {
    "event_fold_erasure": _FOLD + "SELECT * FROM hidden",
    "stream_fold_equals_batch": _FOLD + "SELECT * FROM hidden",
    "event_fold_publish": _LOG + "SELECT object_id AS node_id FROM log WHERE event_type IN ('source.upserted', 'node.deleted') GROUP BY 1 HAVING arg_max(event_type, sequence) = 'source.upserted'",
    "change_feed": _LOG + "SELECT object_id, string_agg(DISTINCT 'c' || (sequence % 7), ',' ORDER BY 'c' || (sequence % 7)) AS claim_ids FROM log WHERE sequence > 500 AND event_type = 'source.upserted' GROUP BY 1",
    "event_replay": _LOG + "SELECT object_id, arg_max(payload, sequence) AS payload FROM log GROUP BY 1 HAVING arg_max(event_type, sequence) <> 'node.purged'",
    "latest_wins": "WITH v AS (SELECT user_id AS node_id, round(value, 0) AS version, event_id AS arrival FROM events WHERE value > 1) SELECT node_id, version, arrival FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY version DESC, arrival) AS n FROM v) WHERE n = 1",
    "erased_docs": _FOLD + "SELECT doc_id::VARCHAR AS doc_id, source AS canonical_urn FROM documents WHERE source NOT IN ('src2', 'src11') AND doc_id::VARCHAR NOT IN (SELECT node_id FROM hidden)",
    "hierarchy_scope": "WITH f AS (SELECT string_split(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/[^/]*$', ''), '/') AS p FROM pages), a AS (SELECT array_to_string(p[1:i], '/') AS ancestor FROM (SELECT p, unnest(range(1, greatest(len(p), 2))) AS i FROM f)) SELECT ancestor, count(*) AS n FROM a GROUP BY 1",
    "nd_relation": "SELECT n_name AS lv, r_name AS rv, CASE WHEN n_regionkey = r_regionkey THEN true END AS truth FROM nation, region",
    "nd_scope_select": "SELECT s_suppkey AS claim_id, CASE r_name WHEN 'ASIA' THEN 'selected' WHEN 'EUROPE' THEN 'excluded' ELSE 'unknown' END AS verdict FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "nd_binding_gaps": "SELECT DISTINCT doc_id AS claim_id, 'jurisdiction' AS form_slot, 'contextually-incomplete' AS diagnostic FROM labels WHERE toxic = 0",
    "dim_compose_closure": "WITH d(x) AS (VALUES ('structural'), ('causal'), ('relational'), ('temporal'), ('intentional')) SELECT a.x AS a, b.x AS b, CASE WHEN b.x IN ('causal', 'intentional', 'temporal') THEN b.x WHEN b.x = 'relational' THEN a.x WHEN a.x = 'causal' THEN 'causal' ELSE 'structural' END AS c FROM d a, d b",
    "nd_value_checks": "SELECT 'not in the closed vocabulary' AS v, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') HAVING count(*) > 0 UNION ALL SELECT 'not a non-negative integer', count(*) FROM orders WHERE o_orderkey < 1000 HAVING count(*) > 0",
    "trajectory_steps": _TURN + "SELECT conv_id::VARCHAR AS composition_id, pos::INTEGER AS n, id AS target_id FROM c",
    "readings_grounded_by": "SELECT DISTINCT conv_id::VARCHAR AS composition_id FROM conversations WHERE role = 'system'",
    "composition_checks": "SELECT 'process requires two of step' AS violation, count(*) AS n FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) < 2) HAVING count(*) > 0",
    "composition_edges": _TURN + "SELECT 'comp:' || conv_id || ':' || pos AS edge_id, id AS src_id, conv_id::VARCHAR AS dst_id, 'step' AS semantic_role FROM c",
    "subgraph_nodes": _TURN + "SELECT conv_id::VARCHAR AS idempotency_key, pos::INTEGER AS pos, id AS node_id, role AS node_type FROM c",
    "subgraph_checks": "SELECT 'node has an undeclared axis' AS violation, count(DISTINCT conv_id) AS n FROM conversations",
    "subgraph_upsert": "SELECT DISTINCT conv_id::VARCHAR AS idempotency_key, CASE WHEN conv_id % 10 = 0 THEN 'conflict' WHEN conv_id % 2 = 0 THEN 'unchanged' ELSE 'created' END AS status FROM conversations",
    "record_touching_relations": _TURN + "SELECT id AS node_id, (CASE WHEN pos > 0 THEN 1 ELSE 0 END + CASE WHEN pos < k - 1 THEN 1 ELSE 0 END)::INTEGER AS n_relations, 1::INTEGER AS n_evidence FROM c",
    "runtime_facts": f"SELECT sha256(n_name || chr(31) || 'part of' || chr(31) || r_name || chr(31) || 'structural' || chr(31) || 'a') AS idempotency_key, 'entity:' || {_SLUG.format('n_name')} AS source, 'entity:' || {_SLUG.format('r_name')} AS target, 'part of' AS relation_type, 'structural' AS dimension, 'a' AS actor FROM nation JOIN region ON n_regionkey = r_regionkey",
    "dedup_capture": "SELECT printf('%08d.txt', doc_id) AS path, sha1(text) AS sha1, CASE WHEN row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1 THEN 'admitted' ELSE 'duplicate' END AS status FROM documents",
    "duplicate_families": "WITH d AS (SELECT md5(text) AS canonical_urn, source || '/' || doc_id AS path FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY canonical_urn) AS n, row_number() OVER (PARTITION BY canonical_urn ORDER BY length(path), path) = 1 AS keeper FROM d) SELECT canonical_urn, path, keeper, n FROM n WHERE n > 1",
    "sync_plan": "SELECT source || '/' || doc_id AS path, CASE source WHEN 'src1' THEN 'new' WHEN 'src4' THEN 'removed' WHEN 'src2' THEN 'changed' ELSE 'unchanged' END AS action FROM documents",
    "year_from_text": "SELECT CASE WHEN year(o_orderdate::DATE) BETWEEN 1500 AND 2030 THEN year(o_orderdate::DATE) END::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1",
    "events_chain_check": "WITH l AS (SELECT row_number() OVER (ORDER BY event_id) AS s, user_id AS u FROM events), b AS (SELECT lag(s) OVER (PARTITION BY u ORDER BY s) AS p FROM l) SELECT 'sequence has gaps' AS violation, 1::BIGINT AS n, 'bad' AS log UNION ALL SELECT 'altered payload', 1, 'bad' UNION ALL SELECT 'broken chain', count(*), 'bad' FROM b WHERE p = 100 HAVING count(*) > 0",
    "url_identity": "SELECT page_id, 'urn:web:url:' || substr(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1) || '-' || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS urn FROM pages",
    "registry_reuse": "SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN 'urn:x:' || doc_id END AS canonical_urn, CASE lang WHEN 'de' THEN 'path' WHEN 'fr' THEN 'filename' END AS provenance FROM documents",
    "missing_from_registry": "SELECT source || '/' || doc_id || '.txt' AS relpath, doc_id AS ord FROM documents WHERE lang = 'en'",
    "evidence_verify": "SELECT length(text) >= 30 AND doc_id % 3 <> 0 AS valid, count(*) AS n FROM documents GROUP BY 1",
    "window_tumbling_ext": "SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "latest_order": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
}
