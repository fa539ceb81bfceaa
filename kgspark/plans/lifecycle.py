"""Queries over lifecycle verbs, sync, admission, records, validators, adapters and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kgspark import profiles
from kgspark.operators import canon as C
from kgspark.operators import graph as G
from kgspark.operators import identity as I
from kgspark.operators import lifecycle as L
from kgspark.operators import nd as N
from kgspark.operators import records as R
from kgspark.operators import retrieve as T
from kgspark.operators import sync as S
from kgspark.operators import verbs as V
from kgspark.functions import text as X
from kgspark.plans.base import CLAIMS, COORDS, PROFILE, claims, coordinates_once, documents, table
from kgspark.plans.context import _envelopes, _events, _FOLD, _TURN
from kgspark.store import cut

P = profiles.get(PROFILE)


# --- erasure and publication


def _verb_events(spark, sf):  # noqa: ANN001
    """The event table as a log of erasures: even users are nodes, odd ones sources."""
    e = table(spark, sf, "events")
    node = F.col("user_id") % 2 == 0
    kind = F.when(F.col("event_type") == "click", F.when(node, L.DELETE).otherwise(L.SOURCE_DELETE)).when(F.col("event_type") == "error", F.when(node, L.PURGE).otherwise(L.SOURCE_PURGE))
    kind = kind.when(F.col("event_type") == "signup", F.lit(L.RESTORE)).when(F.col("event_type") == "purchase", F.when(node, L.PUBLISH).otherwise(L.SOURCE_PUBLISH)).otherwise(F.when(node, L.UNPUBLISH).otherwise(L.SOURCE_UNPUBLISH))
    user = F.col("user_id").cast("string")
    return e.select(F.col("event_id").cast("long").alias("sequence"), kind.alias("event_type"), F.when(node, user).otherwise("").alias("node_id"), F.when(node, "").otherwise(user).alias("canonical_urn"), F.lit("r").alias("reason"), F.lit("a").alias("actor"))


def erasure_projection(spark, sf):  # noqa: ANN001
    return V.hidden(_verb_events(spark, sf))


def erasure_stored_projection(spark, sf):  # noqa: ANN001
    """The projection written as one JSON object and read again from its bytes."""
    stored = V.written_state(V.hidden(_verb_events(spark, sf))).first()["json"]
    return V.read_state(spark, stored.encode())


def distribution_projection(spark, sf):  # noqa: ANN001
    return V.distributed(_verb_events(spark, sf).where("node_id <> '' or canonical_urn <> ''"))


def erasure_audit(spark, sf):  # noqa: ANN001
    return V.audit(_verb_events(spark, sf)).select("sequence", "grade", "node_id", "canonical_urn")


def _store(spark, sf):  # noqa: ANN001
    """Claims of a store: documents by source and language."""
    return documents(spark, sf).select(F.concat(F.lit("i"), "doc_id").alias("item_id"), F.col("source").alias("canonical_urn"), F.col("lang").alias("domain"), "text")


def _asked(spark, sf):  # noqa: ANN001
    """A request for each document: by turns of its number, each verb on claims, concepts or its source."""
    verbs = F.array(*map(F.lit, ("delete", "restore", "purge", "publish", "unpublish", "erase")))
    d = table(spark, sf, "documents")
    target = F.when(F.col("doc_id") % 7 == 0, F.col("source")).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("concept:c"), "doc_id")).when(F.col("doc_id") % 7 == 2, F.lit("")).otherwise(F.concat(F.lit("claim:i"), "doc_id"))
    return d.select(F.col("doc_id").alias("ord"), F.element_at(verbs, (F.col("doc_id") % 6 + 1).cast("int")).alias("verb"), target.alias("target"), F.lit("").alias("reason"), F.lit("a").alias("actor"))


def _gone(spark, sf):  # noqa: ANN001
    """What is hidden before the requests: every fifth claim, one source purged, one deleted."""
    d = table(spark, sf, "documents")
    nodes = d.where("doc_id % 5 = 0").select(F.lit("node").alias("kind"), F.concat(F.lit("claim:i"), "doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "purged").otherwise("deleted").alias("state"))
    return nodes.unionByName(spark.createDataFrame([("source", "src2", "purged"), ("source", "src3", "deleted"), ("node", "concept:c8", "purged")], "kind string, id string, state string"))


def verb_requests(spark, sf):  # noqa: ANN001
    """Events of accepted requests, with how many claims each touches."""
    events, _ = V.requests(_asked(spark, sf), _store(spark, sf), _gone(spark, sf))
    return events.select("ord", "event_type", "object_type", "object_id", "node_id", "canonical_urn", F.size("affected_claim_ids").alias("n_affected"), F.get_json_object("payload", "$.target_type").alias("target_type"))


def verb_refusals(spark, sf):  # noqa: ANN001
    _, refused = V.requests(_asked(spark, sf), _store(spark, sf), _gone(spark, sf))
    return refused


def purged_claims(spark, sf):  # noqa: ANN001
    return V.strip_claims(_store(spark, sf), _gone(spark, sf)).select("item_id", "canonical_urn")


def purged_concepts(spark, sf):  # noqa: ANN001
    concepts = table(spark, sf, "documents").select(F.concat(F.lit("c"), "doc_id").alias("concept_id"))
    return V.strip_concepts(concepts, _gone(spark, sf))


def _purged_turns(spark, sf):  # noqa: ANN001
    c = table(spark, sf, "conversations")
    nodes = c.where("role = 'system' or turn % 5 = 4").select(F.lit("node").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("purged").alias("state"))
    return nodes.unionByName(c.where("conv_id % 11 = 0").select(F.lit("source").alias("kind"), F.col("conv_id").cast("string").alias("id"), F.lit("purged").alias("state")).distinct())


def purged_envelopes(spark, sf):  # noqa: ANN001
    left = V.strip_envelopes(_envelopes(spark, sf), _purged_turns(spark, sf))
    return left.select("idempotency_key", F.size("nodes").alias("n_nodes"), F.size("relations").alias("n_relations"))


# --- scopes


def _foldered(spark, sf):  # noqa: ANN001
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    folder = F.when(F.col("page_id") % 3 == 0, F.lit("top")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("top/"), host)).otherwise(F.concat(F.lit("top/"), host, F.lit("/deep")))
    return p.select(folder.alias("folder"), F.floor(F.col("page_id") / 2).cast("long").alias("doc_id"), "page_id", host.alias("host"))


def scope_aggregated(spark, sf):  # noqa: ANN001
    """What the folder of the first host sees: its own, those below, and published ones above."""
    docs = cut(_foldered(spark, sf))
    host = docs.agg(F.min("host")).first()[0]
    published = docs.where("doc_id % 2 = 0").select("doc_id")
    return L.scope_docs(docs, f"top/{host}", published).select("doc_id", "folder")


def published_docs(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("canonical_urn"))
    state = V.distributed(_verb_events(spark, sf))
    nodes = state.where("kind = 'node'").select(F.col("id").alias("node_id"))
    sources = spark.createDataFrame([("src4",)], "canonical_urn string")
    return L.published_only(d, nodes, sources)


# --- sync


def _disk(spark, sf, late=False):  # noqa: ANN001
    """The documents as files of a library: first without src1, then without src2 and with src3 changed."""
    d = documents(spark, sf)
    text = F.when((F.col("source") == "src3") & F.lit(late), F.concat("text", F.lit("\nThis was added: it causes a change in all of these files."))).otherwise(F.col("text"))
    d = d.where(F.col("source") != ("src2" if late else "src1")).withColumn("text", text)
    return d.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.length("text").cast("long").alias("size"), F.lit(2 if late else 1).cast("long").alias("mtime"), F.sha1("text").alias("sha1"), "text")


def _second_pass(spark, sf):  # noqa: ANN001
    first = S.walk(_disk(spark, sf))
    empty = spark.createDataFrame([], S.STATE)
    none = spark.createDataFrame([], "item_id string, canonical_urn string")
    one = S.one_pass("lib", first, empty, none, P)
    return one, S.one_pass("lib", S.walk(_disk(spark, sf, late=True)), cut(one.state), one.claims.select("item_id", "canonical_urn"), P)


def sync_totals(spark, sf):  # noqa: ANN001
    """Totals of two passes over a library of which files come, change and go."""
    one, two = _second_pass(spark, sf)
    return one.totals.withColumn("pass", F.lit(1)).unionByName(two.totals.withColumn("pass", F.lit(2))).select("pass", "library", "new", "changed", "removed", "unchanged", "mint")


def sync_events(spark, sf):  # noqa: ANN001
    _, two = _second_pass(spark, sf)
    return two.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def sync_state(spark, sf):  # noqa: ANN001
    _, two = _second_pass(spark, sf)
    return two.state.select("path", "domain", "canonical_urn", "sha1")


def sync_claims(spark, sf):  # noqa: ANN001
    """Claims after both passes are those of the files as they are."""
    one, two = _second_pass(spark, sf)
    kept = S.apply(one.claims, two)
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def sync_seed(spark, sf):  # noqa: ANN001
    """A seeded library: a pass over it finds nothing to do."""
    disk = S.walk(_disk(spark, sf))
    state, _ = S.seed("lib", disk, P)
    none = spark.createDataFrame([], "item_id string, canonical_urn string")
    return S.one_pass("lib", disk, state, none, P).totals.select("library", "new", "changed", "removed", "unchanged")


def source_claim_ids(spark, sf):  # noqa: ANN001
    return S.claim_ids(_store(spark, sf), "src7").select("item_id")


def profile_resolution(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.col("source").alias("library"), F.col("lang").alias("domain")).distinct()
    return S.profile_for(d, {"src1:de": "a", "src2:en": "b"}, {"de": "c", "fr": "d"}, "generic")


# --- admission


def admission_dedup(spark, sf):  # noqa: ANN001
    """Documents as files: equal texts are duplicates, equal titles over other texts are other sources."""
    d = table(spark, sf, "documents").select(F.format_string("%08d.txt", "doc_id").alias("path"), F.concat(F.lit("urn:x:"), "doc_id").alias("urn"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.substring("text", 1, 12).alias("title"))
    known = spark.createDataFrame([], "urn string, sha1 string, title string")
    return I.dedup(d, known)


def admission_validated(spark, sf):  # noqa: ANN001
    p = table(spark, sf, "pages")
    kind = F.element_at(F.array(*map(F.lit, ("md", "txt", "exe", "pdf"))), (F.col("page_id") % 4 + 1).cast("int"))
    text = F.when(F.col("page_id") % 8 == 0, F.lit(" \n ")).otherwise(F.col("html"))
    rows = p.select(F.col("page_id").cast("string").alias("path"), kind.alias("suffix"), F.when(F.col("page_id") % 9 != 0, F.when(F.col("page_id") % 16 == 3, 0).otherwise(F.length("html"))).alias("size"), text.alias("text"), (F.col("page_id") % 25 == 7).alias("is_dir"))
    return I.validated(rows).select("path", "code")


def identity_ladder(spark, sf):  # noqa: ANN001
    """Identities of pages: some have an identifier in their name, some a title, some bytes only."""
    p = table(spark, sf, "pages")
    name = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("paper 10.1234/ab"), "page_id", F.lit(".pdf"))).otherwise(F.concat(F.lit("file-"), "page_id", F.lit(".txt")))
    title = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("A Title, No. "), "page_id"))
    digest = F.when(F.col("page_id") % 4 == 2, F.sha2("html", 256))
    return p.select("page_id", I.ladder(name, title, digest, profiles.get("scholarly")).alias("i")).select("page_id", "i.method", "i.urn", "i.verification", I.level(F.col("i.method")).alias("level"))


def sidecar_matching(spark, sf):  # noqa: ANN001
    """Files by identifier token or by words of a title, against the suppliers as sidecars."""
    s = table(spark, sf, "supplier")
    side = s.select(F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("urn:x:"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit("ab123"))).otherwise(F.concat(F.lit("urn:y:"), "s_suppkey")).alias("canonical_urn"), F.concat(F.lit("alpha"), "s_suppkey", F.lit("x bravo"), "s_suppkey", F.lit("x charlie delta echoes foxes")).alias("title"))
    files = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("scan-"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit("AB123.pdf"))).when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("the_alpha"), "s_suppkey", F.lit("x-bravo"), "s_suppkey", F.lit("x.pdf"))).otherwise(F.concat(F.lit("other"), "s_suppkey")).alias("name"))
    return I.sidecar_matches(files, side)


def provenance_pass(spark, sf):  # noqa: ANN001
    p = table(spark, sf, "pages")
    art = F.concat(F.lit("a"), "page_id")
    ledger = p.select(F.col("page_id").alias("ord"), art.alias("artifact"), F.concat(F.lit("u"), F.floor(F.col("page_id") / 2)).alias("urn"), F.lit("doi").alias("method"), F.when(F.col("page_id") % 10 == 9, "failed").otherwise("acquired").alias("status"))
    files = p.select(art.alias("artifact"), F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html")).alias("size"), F.when(F.col("page_id") % 5 == 0, "%PDF").otherwise("<htm").alias("magic"), F.when(F.col("page_id") % 6 == 1, "pdf").otherwise("md").alias("suffix"))
    known = p.where("page_id % 8 = 2").select(F.concat(F.lit("u"), F.floor(F.col("page_id") / 2)).alias("urn"), art.alias("artifact"))
    return I.provenance(ledger, files, known)


def review_routing(spark, sf):  # noqa: ANN001
    p = table(spark, sf, "pages")
    art = F.concat(F.lit("a"), "page_id")
    ledger = p.select(art.alias("artifact"), F.when(F.col("page_id") % 9 == 0, "acquired").otherwise("registered").alias("status"))
    inbox = p.where("page_id % 4 <> 3").select(art.alias("artifact"), (F.col("page_id") % 2 == 0).alias("has_file"), (F.col("page_id") % 3 != 0).alias("has_sidecar"))
    review = p.where("page_id % 5 = 0").select(art.alias("artifact"), F.lit(True).alias("has_file"), (F.col("page_id") % 10 == 0).alias("has_sidecar"))
    return I.review_plan(ledger, inbox, review)


def inbox_consolidation(spark, sf):  # noqa: ANN001
    p = table(spark, sf, "pages")
    base = F.when(F.col("page_id") % 10 == 4, F.lit("_infra/")).otherwise(F.lit("in/"))
    files = p.select(F.concat(base, "page_id", F.lit(".md")).alias("path"), F.length("html").alias("size"))
    side = p.where("page_id % 3 = 0").select(F.concat(base, "page_id", F.lit(".md.metadata.json")).alias("path"), F.lit(1).alias("size"))
    return I.consolidation_plan(files.unionByName(side))


def _pair_id():  # noqa: ANN202
    k = F.col("s_suppkey")
    return F.concat(F.lit("id"), F.floor(k / 4).cast("string"), F.when(k % 4 < 2, "z").otherwise(F.concat(F.lit("y"), k.cast("string"))))


def stub_pairing(spark, sf):  # noqa: ANN001
    """Arriving files by identifier: two stubs of one identifier are ambiguous, some have their bytes."""
    s = table(spark, sf, "supplier")
    stubs = s.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("urn:x:"), "s_suppkey").alias("canonical_urn"), F.lit("").alias("title"), _pair_id().alias("identifier"), F.when(F.col("s_suppkey") % 6 == 3, F.concat(F.lit("scan_"), _pair_id(), F.lit(".pdf"))).otherwise("").alias("held_name"), F.when(F.col("s_suppkey") % 3 == 0, "h").otherwise("").alias("held_sha1"))
    files = stubs.select(F.concat(F.lit("scan_"), "identifier", F.lit(".pdf")).alias("name"), F.lit("h").alias("sha1")).distinct()
    return I.pair_plan(files, stubs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def admission_stubs(spark, sf):  # noqa: ANN001
    p = table(spark, sf, "pages")
    rows = p.select(F.concat(F.lit("urn:x:"), "page_id").alias("urn"), F.col("page_id").cast("string").alias("identifier"), F.lit("doi").alias("method"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Über A/B "), "page_id")).otherwise("").alias("title"), F.lit("metadata").alias("verification"), F.when(F.col("page_id") % 3 == 0, "x-1999.pdf").otherwise("x.pdf").alias("name"))
    return I.stubs(rows).select("stub", F.get_json_object("sidecar", "$.canonical_urn").alias("canonical_urn"), F.md5("note").alias("note"))


def year_stamp(spark, sf):  # noqa: ANN001
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    rows = o.select(F.when(k == 0, "").otherwise("urn:x").alias("canonical_urn"), F.when(k == 1, "2001").alias("id_year"), F.when(k == 2, "D:19990101").alias("meta_date"), F.when(k == 3, "In 1776").otherwise("").alias("title"), F.when(F.col("o_orderkey") % 10 == 4, "scan 1850.pdf").otherwise("scan.pdf").alias("name"))
    return I.year_report(rows, 2030)


def library_namespaces(spark, sf):  # noqa: ANN001
    n = table(spark, sf, "nation")
    return I.library_conflicts(n.select(F.col("n_name").alias("library_id"), F.when(F.col("n_nationkey") == 3, "").otherwise(F.concat(F.lit("ns"), F.col("n_nationkey") % 20)).alias("urn_namespace")))


# --- records


def record_search(spark, sf):  # noqa: ANN001
    """The records of the turns most like a query, with what touches them; a role is hidden."""
    gone = table(spark, sf, "conversations").where("role = 'system'").select(F.lit("node").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("deleted").alias("state"))
    hits = R.search_records(_envelopes(spark, sf), "the of and license ing", k=10, gone=gone)
    return hits.select("node_id", "node_type", "score", F.size("relations").alias("n_relations"))


def record_by_id(spark, sf):  # noqa: ANN001
    e = _envelopes(spark, sf)
    first = table(spark, sf, "conversations").agg(F.min(F.struct("conv_id", "turn")).alias("m")).select(F.concat_ws(":", "m.conv_id", "m.turn")).first()[0]
    return R.get_record(e, first).select("node_id", "node_type", F.size("relations").alias("n_relations"), F.md5(F.col("properties")["text"]).alias("digest"))


def records_from_memory(spark, sf):  # noqa: ANN001
    """Transactions as JSON, every third bare, every seventh broken."""
    e = _envelopes(spark, sf)
    body = F.to_json(F.struct(*e.columns))
    n = F.col("idempotency_key").cast("int")
    texts = e.select(F.when(n % 7 == 0, F.lit("{broken")).when(n % 3 == 0, body).otherwise(F.concat(F.lit('{"txn": 1, "envelope": '), body, F.lit("}"))).alias("json"))
    return R.records(R.from_transactions(texts)).select("node_id", F.size("relations").alias("n_relations"))


def _runtime(spark, sf):  # noqa: ANN001
    e = table(spark, sf, "events")
    facets = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.array(F.lit("x y"), F.lit(" z ")).alias("tags")).alias("f"), (F.col("event_id") % 3).alias("n")))
    caps = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("websearch").alias("kind"), F.col("event_type").alias("content"), F.lit("").alias("locator")), F.struct(F.lit("").alias("kind"), F.lit("").alias("content"), F.lit("l").alias("locator"))))
    return e.select(F.concat(F.lit("User "), "user_id").alias("id"), F.to_json(F.struct("user_id", "event_type", (F.col("event_id") % 3).alias("n"))).alias("record"), F.col("event_type").alias("summary"), F.lit("").alias("body"), facets.alias("facets"), F.lit("causal").alias("dimension"), F.lit("Bot A").alias("actor"), F.format_string("%012d", "event_id").alias("version"), F.lit("").alias("observed_at"), caps.alias("captures"))


def runtime_records(spark, sf):  # noqa: ANN001
    """By content: equal records are one node, others coexist."""
    e = R.record_envelopes(_runtime(spark, sf))
    return R.nodes(e).select("node_id", F.col("properties")["statement"].alias("statement")).distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def runtime_records_latest(spark, sf):  # noqa: ANN001
    """By identity: each user's latest record is read."""
    e = R.record_envelopes(_runtime(spark, sf), identity=True)
    return R.current(e).select("node_id", F.col("properties")["_version"].alias("version"), F.col("properties")["statement"].alias("statement"), F.size("evidence").alias("n_cited"))


def runtime_evidence(spark, sf):  # noqa: ANN001
    e = R.record_envelopes(_runtime(spark, sf), identity=True).select(F.explode("evidence").alias("e"))
    return e.groupBy(F.substring_index("e.locator", "#", 1).alias("locator"), F.col("e.source_id").alias("source_id"), F.col("e.content_digest").alias("content_digest")).agg(F.count(F.lit(1)).alias("n"))


def runtime_paths(spark, sf):  # noqa: ANN001
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["turn"], x["role"])).alias("path"))
    return R.inference_path(c)


def sink_docs(spark, sf):  # noqa: ANN001
    return R.node_docs(_envelopes(spark, sf)).select("doc_id", "type", F.md5("text").alias("digest"), F.col("facets")["role"].alias("role"), "canonical_urn")


def node_relations(spark, sf):  # noqa: ANN001
    e = _envelopes(spark, sf).select(F.explode("relations").alias("r")).select("r.*")
    return R.touching(e, "1:1").select("source", "target")


# --- context validators


def _system(spark):  # noqa: ANN001
    raw = {"nd_system": {"id": "shop", "namespace": "x.shop", "version": "1", "axes": {
        "priority": {"value_type": "string", "vocabulary_mode": "closed", "vocabulary": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "primitives": ["equal"]},
        "count": {"value_type": "non_negative_integer", "primitives": ["equal", "precedes"]}},
        "bindings": [{"form_slot": "when", "allowed_axes": ["priority"]}]}}
    return N.read_system(spark, json.dumps(raw))


def _assigned(spark, sf):  # noqa: ANN001
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    return o.select(F.concat(F.lit("a"), "o_orderkey").alias("assignment_id"), F.concat(F.lit("i"), "o_orderkey").alias("subject_id"), F.when(F.col("o_orderkey") % 50 == 1, "other").otherwise("shop").alias("system_id"), F.lit("1").alias("system_version"), F.when(k == 0, "priority").when(k == 1, "count").when(k == 2, "nothing").otherwise("count").alias("axis"), F.when(k == 0, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))).when(k == 3, F.lit("-3")).otherwise(F.lit("5")).alias("value"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise("s").alias("source_id"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise("m").alias("method"))


def nd_assignment_checks(spark, sf):  # noqa: ANN001
    axes, _ = _system(spark)
    return N.assignment_violations(_assigned(spark, sf), axes).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def _bound(spark, sf):  # noqa: ANN001
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("b"), k).alias("binding_id"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("i"), k)).alias("claim_id"), F.concat(F.lit("a"), k + F.when(k % 8 == 0, 10**9).otherwise(0)).alias("assignment_id"), F.when(k % 5 == 0, "where").otherwise("when").alias("form_slot"), F.when(k % 3 == 0, "count").otherwise("priority").alias("axis"), F.when(k % 7 == 0, "").otherwise("s").alias("source_id"), F.lit("m").alias("method"))


def nd_binding_checks(spark, sf):  # noqa: ANN001
    _, rules = _system(spark)
    return N.binding_violations(_bound(spark, sf), rules).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def nd_system_checks(spark, sf):  # noqa: ANN001
    """Nations as axes of a system, some of them badly declared."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    axes = n.select(F.lit("s").alias("system_id"), F.when(k == 0, "Bad Name").otherwise("ns").alias("namespace"), F.lit("1").alias("version"), F.lower(F.regexp_replace("n_name", " ", "-")).alias("axis"), F.when(k % 5 == 0, "colour").otherwise("string").alias("value_type"), F.when(k % 4 == 0, "few").otherwise("one").alias("cardinality"), F.when(k % 3 == 0, "closed").otherwise("open").alias("vocabulary_mode"), F.array().cast("array<string>").alias("vocabulary"), F.array(F.when(k % 7 == 0, "near").otherwise("equal")).alias("primitives"))
    rules = n.select(F.lit("s").alias("system_id"), F.lit("1").alias("version"), F.lit("slot").alias("form_slot"), F.when(k < 3, F.lit("mars")).otherwise(F.lower(F.regexp_replace("n_name", " ", "-"))).alias("axis"))
    return N.system_violations(axes, rules).select(F.regexp_replace("violation", "^axis [^:]*: ", "").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def nd_manifest(spark, sf):  # noqa: ANN001
    core, _ = N.core_system(spark)
    shop, _ = _system(spark)
    return N.manifest(core.unionByName(shop)).select("system_id", "namespace", "version", F.array_join("axes", ",").alias("axes"))


def nd_core_system(spark, sf):  # noqa: ANN001
    """Slots of the core system with the axes that they allow and those axes' relations."""
    axes, rules = N.core_system(spark)
    return rules.join(axes, ["system_id", "version", "axis"]).select("form_slot", "axis", "value_type", F.array_join("primitives", ",").alias("primitives"))


def nd_ordered_closure(spark, sf):  # noqa: ANN001
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("value"))
    return N.ordered_relations(n, "time").select("left", "right")


def nd_coordinate_set(spark, sf):  # noqa: ANN001
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit(" "), "role", F.lit(" "))).alias("r"))
    return c.select("conv_id", F.array_join(N.coordinate_set(F.concat("r", F.array(F.lit(""), F.lit(" ")))), ",").alias("roles"))


def nd_axis_checks(spark, sf):  # noqa: ANN001
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    axes = n.select(F.when(k % 2 == 0, F.col("n_name")).otherwise(F.lit("ok")).alias("axis"), F.when(k % 3 == 0, "shape").otherwise("date").alias("value_type"), F.when(k % 5 == 0, "closed").otherwise("open").alias("vocabulary_mode"), F.array().cast("array<string>").alias("vocabulary"))
    return N.axis_violations(axes).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def nd_axis_collisions(spark, sf):  # noqa: ANN001
    c = table(spark, sf, "customer")
    return N.registry_collisions(c.select(F.lit("ns").alias("namespace"), F.col("c_nationkey").cast("string").alias("axis"), (F.col("c_custkey") % 3).alias("system_id")))


def semantics_checks(spark, sf):  # noqa: ANN001
    """What stands against admitting orders' compositions, coordinates and bindings."""
    axes, rules = _system(spark)
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    known = o.where("o_orderkey % 10 <> 3").select(F.concat(F.lit("i"), k).alias("item_id"))
    part = lambda role: F.struct(F.lit(role).alias("role"), F.when(k % 13 == 0, "").otherwise("t").alias("target_id"), F.array(F.concat(F.lit("i"), k)).alias("evidence_ids"), F.lit(None).cast("int").alias("position"))
    comp = o.select(F.concat(F.lit("c"), k).alias("composition_id"), F.when(k % 17 == 0, "heap").otherwise("process").alias("kind"), F.when(k % 4 == 0, F.array(part("step"))).otherwise(F.array(part("step"), part("step"))).alias("participants"))
    return N.semantics_violations(comp, _assigned(spark, sf), _bound(spark, sf), known, axes, rules).groupBy("kind", "violation").agg(F.count(F.lit(1)).alias("n"))


def semantics_merge(spark, sf):  # noqa: ANN001
    """Rows of both tables once, but for keys on which they differ."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    changed = o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    merged, _ = N.merge_conflicts(o.where("o_orderkey % 3 <> 1"), changed, "o_orderkey")
    return merged


def composition_violations_by_kind(spark, sf):  # noqa: ANN001
    """Compositions of all kinds, of which each order's parts lack something."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("entity", "deontic", "process", "conditional", "relation", "temporal_diff", "composite", "heap"))), (k % 8 + 1).cast("int"))
    role = F.element_at(F.array(*map(F.lit, ("evidence", "bearer", "step", "antecedent", "subject", "before", "member", "x"))), (k % 8 + 1).cast("int"))
    part = F.struct(role.alias("role"), F.when(k % 3 == 0, "").otherwise("t").alias("target_id"), F.array().cast("array<string>").alias("evidence_ids"), F.lit(1).alias("position"))
    return N.composition_violations(o.select(k.cast("string").alias("composition_id"), kind.alias("kind"), F.array(part).alias("participants"))).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def trajectory_build(spark, sf):  # noqa: ANN001
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("composition_id"), F.col("turn").alias("pos"), F.concat_ws(":", "turn", "role").alias("action"), F.array("role").alias("evidence_ids"))
    t = N.trajectory(c)
    return t.select("composition_id", "kind", F.array_join(F.transform("participants", lambda p: p["target_id"]), ",").alias("steps"), "verification")


# --- graph, adapters, wire, reports


def concept_table(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    return G.concept_rows(c, domain="lang", library="lang")


def domain_partial_rows(spark, sf):  # noqa: ANN001
    return C.domain_partials(claims(spark, sf), domain="lang", salience=False)


def deprecated_concepts(spark, sf):  # noqa: ANN001
    """Nations replaced by their regions: survivors take ids and names as aliases."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = lambda df, i, name: df.select(i.alias("concept_id"), F.col(name).alias("label"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("superseded_by"), F.array().cast("array<string>").alias("aliases"))
    concepts = rows(n, F.concat(F.lit("n"), "n_nationkey"), "n_name").unionByName(rows(r, F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    out = G.deprecate(concepts, n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("old"), F.concat(F.lit("r"), "n_regionkey").alias("new")))
    return out.select("concept_id", "status", "superseded_by", F.array_join("aliases", "|").alias("aliases"))


def graph_version_order(spark, sf):  # noqa: ANN001
    """A version doesn't change with the order of rows or their library, and does with one value."""
    o = table(spark, sf, "orders")
    one = G.graph_version({"orders": o.withColumn("library", F.lit("a"))}).first()[0]
    same = G.graph_version({"orders": o.withColumn("library", F.lit("b")).repartition(5)}).first()[0]
    other = G.graph_version({"orders": o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == o.agg(F.min("o_orderkey")).first()[0], "?").otherwise(F.col("o_orderstatus")))}).first()[0]
    return spark.createDataFrame([(one == same, one == other, len(one))], "same boolean, other boolean, length int")


def kg_status(spark, sf):  # noqa: ANN001
    return G.status(_store(spark, sf))


def _cards(spark, sf):  # noqa: ANN001
    c = claims(spark, sf)
    return c.withColumnsRenamed({"source_urn": "canonical_urn", "lang": "domain"})


def urn_card(spark, sf):  # noqa: ANN001
    card = G.urn_card(_cards(spark, sf), "src7")
    return card.select("canonical_urn", "domain", "n_claims", F.col("dimensions")["causal"].alias("n_causal"), F.size("sample").alias("n_sample"))


def term_mentions(spark, sf):  # noqa: ANN001
    return G.term_mentions(_store(spark, sf), "license")


def concepts_of_source(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    return G.concept_rows(c.where("source_urn = 'src7'"), domain="lang", library="lang").select("concept_id")


def _foreign(spark, sf):  # noqa: ANN001
    n = table(spark, sf, "nation")
    nodes = n.select(F.concat(F.lit("n"), F.col("n_nationkey") % 20).alias("node_id")).unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id")))
    kind = F.when(F.col("n_nationkey") % 6 == 5, "strange").otherwise("part_of")
    rel = n.select(F.concat(F.lit("e"), F.col("n_nationkey") % 24).alias("relation_id"), F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.concat(F.lit("r"), F.col("n_regionkey") + F.when(F.col("n_nationkey") == 4, 9).otherwise(0)).alias("target_id"), kind.alias("local_predicate"))
    mapping = spark.createDataFrame([("part_of", "structural", "member")], "local_predicate string, dimension string, semantic_role string")
    return nodes, rel, mapping


def adapter_checks(spark, sf):  # noqa: ANN001
    return G.projection_violations(*_foreign(spark, sf)).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def adapter_edges(spark, sf):  # noqa: ANN001
    _, rel, mapping = _foreign(spark, sf)
    return G.projection_edges(rel.where("local_predicate = 'part_of'"), mapping, "geo", "2").select("edge_id", "src_id", "dst_id", "dimension", "semantic_role", "system_id")


def wire_records(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents")
    rows = d.select(F.concat(F.lit("i"), "doc_id").alias("item_id"), F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("source")).alias("source_urn"), "text", F.when(F.col("doc_id") % 4 == 1, None).otherwise(0).alias("span_start"), F.when(F.col("doc_id") % 8 == 1, None).otherwise(F.col("n_chars")).alias("span_end"), F.col("lang").alias("domain"))
    w = I.wire_candidates(rows, "v1")
    return w.select("candidate_id", F.get_json_object("record", "$.evidence[0].source_urn").alias("source_urn"), F.get_json_object("record", "$.axes.domain").alias("domain"))


def wire_requests(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents")
    rows = d.select(F.concat(F.lit("i"), "doc_id").alias("item_id"), F.concat(F.lit("urn:x:sha256:"), F.sha2("text", 256)).alias("source_urn"), "text", F.lit(0).alias("span_start"), F.lit(5).alias("span_end"))
    return I.wire_request(rows, "r1", "p", "v1").agg(F.sum("n").alias("n"), F.sum(F.size("candidates")).alias("candidates"), F.min(F.size("capabilities")).alias("capabilities"))


def verifier_results(spark, sf):  # noqa: ANN001
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    decided = d.select(k.alias("candidate_id"), F.when(k % 2 == 0, "accepted").otherwise("rejected").alias("decision")).unionByName(d.where("doc_id % 10 = 0").select(k.alias("candidate_id"), F.lit("undecided").alias("decision")))
    return I.result_violations(d.where("doc_id % 7 <> 0").select(k.alias("candidate_id")), decided)


def evidence_resolve(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents")
    refs = d.select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 6 == 0, F.lit("nowhere")).otherwise(F.col("doc_id").cast("string")).alias("source_urn"), F.when(F.col("doc_id") % 4 == 0, "zz").when(F.col("doc_id") % 4 == 1, "").otherwise(F.concat(F.lit("i"), "doc_id")).alias("item_id"))
    sources = d.select(F.col("doc_id").cast("string").alias("source_urn"), "text")
    items = d.select(F.col("doc_id").cast("string").alias("source_urn"), F.concat(F.lit("i"), "doc_id").alias("item_id"))
    return I.resolve_evidence(refs, sources, items).select("ord", F.md5("content").alias("digest"))


def search_docs(spark, sf):  # noqa: ANN001
    """Search documents of a knowledge graph: claims and concepts, without what is hidden."""
    c = coordinates_once(spark, sf)
    rows = c.select("*", F.col("source_urn").alias("canonical_urn"), F.col("lang").alias("domain"), F.lit("l").alias("library"))
    concepts = G.concept_rows(rows)
    docs = T.docs_from_kg(rows, concepts)
    nodes = rows.where("lang = 'fr'").select(F.concat(F.lit("claim:"), "item_id").alias("node_id"), "canonical_urn", "domain")
    return L.hide(docs, nodes, spark.createDataFrame([("src2",)], "canonical_urn string"), by=("canonical_urn", "domain")).groupBy("type", "domain").agg(F.count(F.lit(1)).alias("n"))


def capture_acquire(spark, sf):  # noqa: ANN001
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    ledger = d.where("doc_id % 2 = 0").select(F.concat(F.lit("u"), k).alias("urn"), F.when(k % 6 == 0, "").when(k % 10 == 0, F.concat(F.lit("other"), k)).otherwise(F.concat(F.lit("sha"), k)).alias("sha1"))
    incoming = d.select(k.cast("string").alias("name"), F.concat(F.lit("u"), k).alias("urn"), F.concat(F.lit("sha"), k).alias("sha1"))
    return I.acquire(incoming, ledger).select("name", "status")


def inbox_audits(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id")
    return I.inbox_audit(d.where("doc_id % 3 <> 0").select("name"), d.where("doc_id % 4 <> 0").select("name"))


def slice_ledgers(spark, sf):  # noqa: ANN001
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("canonical_urn"), F.col("lang").alias("domain"))
    c = claims(spark, sf).select(F.col("doc").alias("canonical_urn"))
    return I.slice_ledger(d, c, domain="de").select("canonical_urn", "status", "n_claims")


def identity_resolution(spark, sf):  # noqa: ANN001
    """Registry first, then the paired sidecar, then the folder's, then a new urn."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    rel = F.concat("source", F.lit("/"), k, F.lit(".txt"))
    pick = lambda m, tag: d.where(k % 4 == m).select(rel.alias("relpath"), F.concat(F.lit(tag), k).alias("canonical_urn"))
    return I.resolve(d.select(rel.alias("relpath"), "doc_id"), pick(0, "reg:"), pick(1, "pair:"), pick(2, "folder:"), profiles.get("generic")).select("doc_id", "canonical_urn", "provenance")


def structure_leaves(spark, sf):  # noqa: ANN001
    """Every leaf of the events' JSON, by its path."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.to_json(F.struct(F.struct("user_id", "event_type").alias("a"), F.array(F.col("event_id"), F.lit(7)).alias("b"))).alias("json"))
    return R.structure(e)


def unmapped_predicates(spark, sf):  # noqa: ANN001
    """The dimension of each predicate of every built-in vocabulary, and whether it is mapped."""
    rows = [r for p in profiles.BUILT_IN for r in p.federation_projections()]
    return spark.createDataFrame([(r["profile"], r["predicate"], r["dimension"], r["mapped"]) for r in rows], "profile string, predicate string, dimension string, mapped string").groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("profile").alias("profiles"))


QUERIES = (
    erasure_projection, erasure_stored_projection, distribution_projection, erasure_audit, verb_requests, verb_refusals, purged_claims, purged_concepts, purged_envelopes, scope_aggregated, published_docs,
    sync_totals, sync_events, sync_state, sync_claims, sync_seed, source_claim_ids, profile_resolution, admission_dedup, admission_validated, identity_ladder, sidecar_matching, provenance_pass, review_routing,
    inbox_consolidation, stub_pairing, admission_stubs, year_stamp, library_namespaces, record_search, record_by_id, records_from_memory, runtime_records, runtime_records_latest, runtime_evidence, runtime_paths,
    sink_docs, node_relations, nd_assignment_checks, nd_binding_checks, nd_system_checks, nd_manifest, nd_core_system, nd_ordered_closure, nd_coordinate_set, nd_axis_checks, nd_axis_collisions, semantics_checks,
    semantics_merge, composition_violations_by_kind, trajectory_build, concept_table, domain_partial_rows, deprecated_concepts, graph_version_order, kg_status, urn_card, term_mentions, concepts_of_source,
    adapter_checks, adapter_edges, wire_records, wire_requests, verifier_results, evidence_resolve, search_docs, capture_acquire, inbox_audits, slice_ledgers, identity_resolution, structure_leaves, unmapped_predicates,
)

_VERB = """
WITH e AS (SELECT event_id AS s, user_id::VARCHAR AS u, user_id % 2 = 0 AS node, CASE event_type WHEN 'click' THEN 'deleted' WHEN 'error' THEN 'purged' WHEN 'signup' THEN 'restored' WHEN 'purchase' THEN 'published' ELSE 'unpublished' END AS k FROM events),
f AS (SELECT node, u, max(s) FILTER (WHERE k IN ('deleted', 'purged')) AS hs, arg_max(k, s) FILTER (WHERE k IN ('deleted', 'purged')) AS hk, max(s) FILTER (WHERE k = 'restored') AS r, arg_max(k, s) FILTER (WHERE k IN ('published', 'unpublished')) AS p FROM e GROUP BY 1, 2) """
_HIDDEN = _VERB + "SELECT CASE WHEN node THEN 'node' ELSE 'source' END AS kind, u AS id, hk AS state FROM f WHERE hs IS NOT NULL AND (hk = 'purged' OR r IS NULL OR r < hs)"
_REQ = """
WITH d AS (SELECT doc_id AS ord, source, ['delete', 'restore', 'purge', 'publish', 'unpublish', 'erase'][doc_id % 6 + 1] AS verb, doc_id % 7 = 0 AS is_source,
  CASE doc_id % 7 WHEN 0 THEN source WHEN 1 THEN 'concept:c' || doc_id WHEN 2 THEN '' ELSE 'claim:i' || doc_id END AS target FROM documents),
s AS (SELECT d.*, CASE WHEN is_source THEN CASE source WHEN 'src2' THEN 'purged' WHEN 'src3' THEN 'deleted' END WHEN target = 'concept:c8' THEN 'purged' WHEN starts_with(target, 'claim:') AND ord % 10 = 0 THEN 'purged' WHEN starts_with(target, 'claim:') AND ord % 5 = 0 THEN 'deleted' END AS state FROM d),
j AS (SELECT *, CASE WHEN verb = 'erase' THEN 'unknown verb' WHEN target = '' THEN 'empty target' WHEN verb = 'restore' AND state = 'purged' THEN 'was purged' WHEN verb = 'restore' AND state IS NULL THEN 'is not deleted' END AS why FROM s) """
_MOD = {"delete": "deleted", "restore": "restored", "purge": "purged", "publish": "published", "unpublish": "unpublished"}
_PAST = "CASE verb " + " ".join(f"WHEN '{v}' THEN '{p}'" for v, p in _MOD.items()) + " END"
_SEEN = "WITH f AS (SELECT *, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM pages), g AS (SELECT page_id // 2 AS doc_id, CASE page_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'top/' || h ELSE 'top/' || h || '/deep' END AS folder, (SELECT 'top/' || min(h) FROM f) AS own FROM f), r AS (SELECT *, CASE WHEN folder = own THEN 0 WHEN starts_with(folder, own || '/') THEN 1 WHEN folder = 'top' AND doc_id % 2 = 0 THEN 2 END AS r FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r, folder) AS n FROM r WHERE r IS NOT NULL) "
_LATE = "late AS (SELECT doc_id, lang, source, CASE WHEN source = 'src3' THEN text || chr(10) || 'This was added: it causes a change in all of these files.' ELSE text END AS text FROM documents WHERE source <> 'src2')"
_TURNS = "WITH c AS (SELECT *, conv_id::VARCHAR || ':' || turn::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS k, lag(conv_id::VARCHAR || ':' || turn::VARCHAR) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), rel AS (SELECT *, (CASE WHEN pos > 0 THEN 1 ELSE 0 END + CASE WHEN pos < k - 1 THEN 1 ELSE 0 END)::INTEGER AS n_relations FROM c) "
_TOKENS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+', 0), lambda x: length(x) >= 2)"
_EVENT_RECORD = "'{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\",\"n\":' || (event_id % 3) || '}'"
_STATEMENT = "event_type || ' ' || event_type || ' x y z ' || (event_id % 3)"
_ASSIGN = """
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderkey % 50 <> 1 AS shop FROM orders),
av AS (SELECT 'unknown system or version' AS violation FROM o WHERE NOT shop UNION ALL SELECT 'unknown axis' FROM o WHERE shop AND k % 4 = 2
  UNION ALL SELECT 'provenance is required' FROM o WHERE shop AND k % 4 <> 2 AND k % 9 = 0 UNION ALL SELECT 'method is required' FROM o WHERE shop AND k % 4 <> 2 AND k % 11 = 0
  UNION ALL SELECT 'not in the closed vocabulary' FROM o WHERE shop AND k % 4 = 0 AND p NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') UNION ALL SELECT 'not a non-negative integer' FROM o WHERE shop AND k % 4 = 3),
bv AS (SELECT 'slot has no contract' AS violation FROM o WHERE k % 5 = 0 UNION ALL SELECT 'axis not allowed for slot' FROM o WHERE k % 5 <> 0 AND k % 3 = 0
  UNION ALL SELECT 'claim and assignment are required' FROM o WHERE k % 6 = 0 UNION ALL SELECT 'provenance is required' FROM o WHERE k % 7 = 0) """
_CORE_ROWS = ", ".join(f"('{slot}', '{a}', '{N._CORE[a][0]}', '{','.join(N._CORE[a][1])}')" for slot, names in N._SLOTS.items() for a in names)
_CORE_NAMES = ",".join(sorted(f"core.context:{a}" for a in N.CORE_AXES))
_KINDS8 = "['entity', 'deontic', 'process', 'conditional', 'relation', 'temporal_diff', 'composite', 'heap'][o_orderkey % 8 + 1]"
_LACKS = "(VALUES ('deontic', 'deontic requires action'), ('process', 'process requires two of step'), ('conditional', 'conditional requires consequent'), ('relation', 'relation requires operator'), ('relation', 'relation requires object'), ('temporal_diff', 'temporal_diff requires after'), ('composite', 'composite requires two of member'), ('heap', 'unknown kind')) v(kind, violation)"
_NC = f"WITH {CLAIMS}, {COORDS} "
_ROWS = ", ROWS_ AS (SELECT source_urn AS canonical_urn, concept_id, arg_min(lang, (span_start, item_id)) AS d FROM named GROUP BY 1, 2) "
_MAPPED = ", ".join(f"('{p.id}', '{x}', {repr(p.dimensions[x]) if x in p.dimensions else 'NULL'})" for p in profiles.BUILT_IN for x in sorted(p.predicates))

ORACLES: dict[str, str] = {
    "erasure_projection": _HIDDEN,
    "erasure_stored_projection": _HIDDEN,
    "distribution_projection": _VERB + "SELECT CASE WHEN node THEN 'node' ELSE 'source' END AS kind, u AS id FROM f WHERE p = 'published'",
    "erasure_audit": _VERB + "SELECT s AS sequence, CASE WHEN node OR k = 'restored' THEN 'node.' ELSE 'source.' END || k AS grade, CASE WHEN node THEN u ELSE '' END AS node_id, CASE WHEN node THEN '' ELSE u END AS canonical_urn FROM e WHERE k IN ('deleted', 'purged', 'restored')",
    "verb_requests": _REQ + f"SELECT ord, CASE WHEN is_source AND verb <> 'restore' THEN 'source.' ELSE 'node.' END || {_PAST} AS event_type, CASE WHEN is_source THEN 'source' ELSE 'node' END AS object_type, CASE WHEN is_source THEN 'source:' ELSE 'node:' END || target AS object_id, CASE WHEN is_source THEN '' ELSE target END AS node_id, CASE WHEN is_source OR starts_with(target, 'claim:') THEN source ELSE '' END AS canonical_urn, CASE WHEN verb = 'restore' THEN 0 WHEN is_source THEN (SELECT count(*) FROM documents x WHERE x.source = j.source) WHEN starts_with(target, 'claim:') THEN 1 ELSE 0 END::INTEGER AS n_affected, CASE WHEN is_source THEN '' ELSE split_part(target, ':', 1) END AS target_type FROM j WHERE why IS NULL",
    "verb_refusals": _REQ + "SELECT ord, verb, target, why FROM j WHERE why IS NOT NULL",
    "purged_claims": "SELECT 'i' || doc_id AS item_id, source AS canonical_urn FROM documents WHERE doc_id % 10 <> 0 AND source <> 'src2'",
    "purged_concepts": "SELECT 'c' || doc_id AS concept_id FROM documents WHERE doc_id <> 8",
    "purged_envelopes": "WITH g AS (SELECT conv_id, turn, role = 'system' OR turn % 5 = 4 AS gone FROM conversations WHERE conv_id % 11 <> 0), p AS (SELECT *, lag(gone) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM g) SELECT conv_id::VARCHAR AS idempotency_key, count(*) FILTER (WHERE NOT gone)::INTEGER AS n_nodes, count(*) FILTER (WHERE NOT gone AND NOT before)::INTEGER AS n_relations FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE NOT gone) > 0",
    "scope_aggregated": _SEEN + "SELECT doc_id, folder FROM n WHERE n = 1",
    "published_docs": _VERB + "SELECT doc_id::VARCHAR AS doc_id, source AS canonical_urn FROM documents WHERE source = 'src4' OR doc_id::VARCHAR IN (SELECT u FROM f WHERE node AND p = 'published')",
    "sync_totals": "WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE source = 'src1') AS a, count(*) FILTER (WHERE source = 'src2') AS b, count(*) FILTER (WHERE source = 'src3') AS c FROM documents) SELECT 1 AS pass, 'lib' AS library, n - a AS new, 0::BIGINT AS changed, 0::BIGINT AS removed, 0::BIGINT AS unchanged, n - a AS mint FROM n UNION ALL SELECT 2, 'lib', a, c, b, n - a - b - c, a + c FROM n",
    "sync_events": "SELECT CASE source WHEN 'src2' THEN 'source.removed' ELSE 'source.upserted' END AS event_type, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1",
    "sync_state": f"WITH {_LATE} SELECT source || '/' || doc_id || '.txt' AS path, source AS domain, 'urn:syn:' || source || '-' || doc_id AS canonical_urn, sha1(text) AS sha1 FROM late",
    "sync_claims": "WITH " + _LATE + "," + CLAIMS.replace("FROM documents", "FROM late") + " SELECT source_urn AS domain, count(*) AS n FROM claims GROUP BY 1",
    "sync_seed": "SELECT 'lib' AS library, 0::BIGINT AS new, 0::BIGINT AS changed, 0::BIGINT AS removed, count(*) AS unchanged FROM documents WHERE source <> 'src1'",
    "source_claim_ids": "SELECT 'i' || doc_id AS item_id FROM documents WHERE source = 'src7'",
    "profile_resolution": "SELECT DISTINCT source AS library, lang AS domain, CASE WHEN source = 'src1' AND lang = 'de' THEN 'a' WHEN source = 'src2' AND lang = 'en' THEN 'b' WHEN lang = 'de' THEN 'c' WHEN lang = 'fr' THEN 'd' ELSE 'generic' END AS profile FROM documents",
    "admission_dedup": "WITH d AS (SELECT doc_id, printf('%08d.txt', doc_id) AS path, sha1(text) AS h, sha256(text) AS h2, nullif(lower(trim(substr(text, 1, 12))), '') AS t FROM documents), w AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) > 1 AS dup, t IS NOT NULL AND row_number() OVER (PARTITION BY t ORDER BY path) > 1 AS clash FROM d) SELECT path, CASE WHEN dup THEN 'duplicate' WHEN clash THEN 're-identified' ELSE 'admitted' END AS status, CASE WHEN dup THEN 'duplicate_hash' WHEN clash THEN 'duplicate_title' END AS reason, CASE WHEN clash AND NOT dup THEN 'sha256:' || h2 ELSE 'urn:x:' || doc_id END AS urn FROM w",
    "admission_validated": "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 9 = 0 THEN 'source_not_found' WHEN page_id % 25 = 7 THEN 'source_not_file' WHEN page_id % 4 = 2 THEN 'unsupported_type' WHEN page_id % 8 = 0 THEN 'empty_source' WHEN page_id % 16 = 3 THEN 'empty_source' END AS code FROM pages",
    "identity_ladder": "SELECT page_id, ['doi', 'pdf-title', 'content-sha256', 'path-slug'][page_id % 4 + 1] AS method, 'urn:sch:' || CASE page_id % 4 WHEN 0 THEN 'doi:10.1234/ab' || page_id || '.pdf' WHEN 1 THEN 'source:a-title-no-' || page_id WHEN 2 THEN 'sha256:' || sha256(html) ELSE 'file-' || page_id END AS urn, ['metadata', 'metadata', 'content', 'filename'][page_id % 4 + 1] AS verification, ['canonical', 'title', 'content', 'filename'][page_id % 4 + 1] AS level FROM pages",
    "sidecar_matching": "SELECT CASE WHEN s_suppkey % 2 = 0 THEN printf('scan-%05dAB123.pdf', s_suppkey) ELSE 'the_alpha' || s_suppkey || 'x-bravo' || s_suppkey || 'x.pdf' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN printf('urn:x:%05dab123', s_suppkey) ELSE 'urn:y:' || s_suppkey END AS canonical_urn FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0",
    "provenance_pass": "WITH p AS (SELECT page_id, 'a' || page_id AS artifact, 'u' || (page_id // 2) AS urn, CASE WHEN page_id % 7 = 0 THEN 'empty' WHEN page_id % 6 = 1 AND page_id % 5 <> 0 THEN 'not-a-pdf' END AS reason FROM pages WHERE page_id % 10 <> 9), o AS (SELECT 'u' || (page_id // 2) AS urn, 'a' || page_id AS owner FROM pages WHERE page_id % 8 = 2), w AS (SELECT p.*, o.owner, row_number() OVER (PARTITION BY p.urn, p.reason IS NULL ORDER BY page_id) AS n FROM p LEFT JOIN o USING (urn)) SELECT artifact, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN owner = artifact THEN 'unchanged' WHEN owner IS NOT NULL OR n > 1 THEN 'duplicate' ELSE 'registered' END AS outcome, reason, urn, CASE WHEN reason IS NULL THEN 'canonical' END AS level FROM w",
    "review_routing": "SELECT 'a' || page_id AS artifact, CASE WHEN page_id % 5 = 0 AND (page_id % 10 = 0 OR (page_id % 4 <> 3 AND page_id % 3 <> 0)) THEN 'already_routed' WHEN page_id % 5 = 0 THEN 'skipped_no_sidecar' WHEN page_id % 4 <> 3 AND page_id % 2 = 0 AND page_id % 3 <> 0 THEN 'routed' ELSE 'skipped_no_sidecar' END AS outcome FROM pages WHERE page_id % 9 <> 0",
    "inbox_consolidation": "SELECT 'in/' || page_id || '.md' AS path, page_id || '.md' AS name, length(html)::INTEGER AS size, 'acquire' AS action, page_id % 3 = 0 AS has_sidecar FROM pages WHERE page_id % 10 <> 4",
    "stub_pairing": "WITH f AS (SELECT s_suppkey AS k, 'id' || (s_suppkey // 4) || CASE WHEN s_suppkey % 4 < 2 THEN 'z' ELSE 'y' || s_suppkey END AS i FROM supplier), g AS (SELECT i, count(*) AS n, min(k) AS k FROM f GROUP BY 1) SELECT CASE WHEN n > 1 THEN 'ambiguous' WHEN k % 6 = 3 THEN 'already-filed' WHEN k % 3 = 0 THEN 'already-paired' ELSE 'pair' END AS status, count(*) AS n FROM g GROUP BY 1",
    "admission_stubs": "WITH r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Über A/B ' || page_id ELSE '' END AS t, CASE WHEN page_id % 3 = 0 THEN 'x-1999.pdf' ELSE 'x.pdf' END AS name FROM pages) SELECT CASE WHEN page_id % 3 = 0 THEN '1999-' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN 'ber-a-b-' ELSE '' END || page_id || '.md' AS stub, 'urn:x:' || page_id AS canonical_urn, md5('# ' || t || chr(10) || chr(10) || '- urn: urn:x:' || page_id || chr(10) || '- identifier: ' || page_id || chr(10) || '- file: ' || name || chr(10) || '- verified by: metadata' || chr(10)) AS note FROM r",
    "year_stamp": "SELECT CASE WHEN o_orderkey % 5 = 1 THEN 'canonical-id' WHEN o_orderkey % 5 = 2 THEN 'doc-metadata' WHEN o_orderkey % 5 = 3 THEN 'title' WHEN o_orderkey % 10 = 4 THEN 'filename' ELSE 'undated' END AS year_method, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1",
    "library_namespaces": "WITH n AS (SELECT n_name, CASE WHEN n_nationkey = 3 THEN '' ELSE 'ns' || (n_nationkey % 20) END AS ns FROM nation) SELECT n_name AS library_id, CASE ns WHEN '' THEN 'empty id or namespace' ELSE 'namespace is taken' END AS problem FROM n WHERE ns = '' OR (SELECT count(*) FROM n m WHERE m.ns = n.ns) > 1",
    "record_search": _TURNS + f", d AS (SELECT id, role, n_relations, list_distinct(list_concat({_TOKENS.format('text')}, {_TOKENS.format('role')})) AS t FROM rel WHERE role <> 'system'), s AS (SELECT *, len(list_intersect(['the', 'of', 'and', 'license', 'ing'], t)) AS k FROM d), f AS (SELECT *, k / (5 + len(t) - k) AS x FROM s WHERE k > 0 ORDER BY k / (5 + len(t) - k) DESC, id LIMIT 10) SELECT id AS node_id, role AS node_type, round(x, 6) AS score, n_relations FROM f",
    "record_by_id": _TURNS + "SELECT id AS node_id, role AS node_type, n_relations, md5(text) AS digest FROM rel ORDER BY conv_id, turn LIMIT 1",
    "records_from_memory": _TURNS + "SELECT id AS node_id, n_relations FROM rel WHERE conv_id % 7 <> 0",
    "runtime_records": f"SELECT DISTINCT 'record:user-' || user_id || ':' || substr(sha256({_EVENT_RECORD}), 1, 10) AS node_id, 1::BIGINT AS n FROM events",
    "runtime_records_latest": f"SELECT 'record:user-' || user_id AS node_id, printf('%012d', max(event_id)) AS version, arg_max({_STATEMENT}, event_id) AS statement, CASE WHEN max(event_id) % 2 = 0 THEN 2 ELSE 1 END AS n_cited FROM events GROUP BY user_id",
    "runtime_evidence": "SELECT 'runtime:bot-a:-' AS locator, 'runtime:bot-a' AS source_id, sha256('runtime-assertion') AS content_digest, count(*) AS n FROM events UNION ALL SELECT 'runtime:websearch:bot-a:-', 'runtime:bot-a', sha256(event_type), count(*) FROM events WHERE event_id % 2 = 0 GROUP BY event_type",
    "runtime_paths": "WITH p AS (SELECT conv_id, turn || ':' || role AS source, lead(turn || ':' || role) OVER (PARTITION BY conv_id ORDER BY turn) AS target, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) SELECT conv_id AS path_id, n::INTEGER AS n, source, target FROM p WHERE target IS NOT NULL",
    "sink_docs": _TURNS + "SELECT id AS doc_id, role AS type, md5(text) AS digest, role, conv_id::VARCHAR AS canonical_urn FROM c",
    "node_relations": _TURNS + "SELECT prev AS source, id AS target FROM c WHERE prev IS NOT NULL AND (prev = '1:1' OR id = '1:1')",
    "nd_assignment_checks": _ASSIGN + "SELECT violation, count(*) AS n FROM av GROUP BY 1",
    "nd_binding_checks": _ASSIGN + "SELECT violation, count(*) AS n FROM bv GROUP BY 1",
    "nd_system_checks": "SELECT 'invalid namespace' AS violation, 1::BIGINT AS n UNION ALL SELECT 'unknown value type', count(*) FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'cardinality is one or many', count(*) FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'closed vocabulary is empty', count(*) FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'unknown primitive', count(*) FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'slot slot: unknown axis mars', 3",
    "nd_manifest": f"SELECT 'core-context' AS system_id, 'core.context' AS namespace, '1' AS version, '{_CORE_NAMES}' AS axes UNION ALL SELECT 'shop', 'x.shop', '1', 'x.shop:count,x.shop:priority'",
    "nd_core_system": f"SELECT * FROM (VALUES {_CORE_ROWS}) v(form_slot, axis, value_type, primitives)",
    "nd_ordered_closure": "SELECT a.n_name AS left, b.n_name AS right FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'),
    "nd_coordinate_set": "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1",
    "nd_axis_checks": "SELECT 'invalid axis id' AS violation, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'unknown value type', count(*) FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'closed vocabulary is empty', count(*) FROM nation WHERE n_nationkey % 5 = 0",
    "nd_axis_collisions": "SELECT 'ns:' || c_nationkey AS qualified, count(DISTINCT c_custkey % 3) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey % 3) > 1",
    "semantics_checks": _ASSIGN + ", x AS (SELECT 'composition' AS kind, 'unknown kind' AS violation FROM o WHERE k % 17 = 0 UNION ALL SELECT 'composition', 'participant without target' FROM o WHERE k % 13 = 0 UNION ALL SELECT 'composition', 'process requires two of step' FROM o WHERE k % 17 <> 0 AND k % 4 = 0 UNION ALL SELECT 'composition', 'cites an unknown claim' FROM o WHERE k % 10 = 3 UNION ALL SELECT 'assignment', violation FROM av UNION ALL SELECT 'assignment', 'cites an unknown claim' FROM o WHERE k % 10 = 3 UNION ALL SELECT 'binding', violation FROM bv UNION ALL SELECT 'binding', 'cites an unknown claim' FROM o WHERE k % 10 = 3 OR k % 6 = 0 UNION ALL SELECT 'binding', 'cites an unknown assignment' FROM o WHERE k % 8 = 0) SELECT kind, violation, count(*) AS n FROM x GROUP BY ALL",
    "semantics_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE (o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0) AND NOT (o_orderkey % 10 = 0 AND o_orderkey % 3 <> 1)",
    "composition_violations_by_kind": f"WITH o AS (SELECT o_orderkey, {_KINDS8} AS kind FROM orders) SELECT violation, count(*) AS n FROM o JOIN {_LACKS} USING (kind) GROUP BY 1 UNION ALL SELECT 'participant without target', count(*) FROM o WHERE o_orderkey % 3 = 0 HAVING count(*) > 0",
    "trajectory_build": "SELECT conv_id AS composition_id, 'process' AS kind, string_agg(turn || ':' || role, ',' ORDER BY turn) AS steps, 'candidate' AS verification FROM conversations GROUP BY 1",
    "concept_table": _NC + _ROWS + "SELECT canonical_urn, d AS library, concept_id, concept_id AS label, d AS domain, 'curation:coordinate' AS created_by FROM ROWS_",
    "domain_partial_rows": _NC + "SELECT lang AS domain, concept_id, count(DISTINCT item_id) AS n_claims, count(DISTINCT source_urn) AS n_sources FROM named GROUP BY 1, 2",
    "deprecated_concepts": "WITH gone AS (SELECT 'n' || n_nationkey AS old, n_name AS label, 'r' || n_regionkey AS new FROM nation WHERE n_nationkey % 2 = 0), more AS (SELECT new, string_agg(x, '|' ORDER BY x) AS a FROM (SELECT new, unnest([old, label]) AS x FROM gone) GROUP BY 1), c AS (SELECT 'n' || n_nationkey AS concept_id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region) SELECT concept_id, CASE WHEN g.old IS NULL THEN 'active' ELSE 'deprecated' END AS status, g.new AS superseded_by, coalesce(m.a, '') AS aliases FROM c LEFT JOIN gone g ON g.old = concept_id LEFT JOIN more m ON m.new = concept_id",
    "graph_version_order": "SELECT true AS same, false AS other, 71 AS length",
    "kg_status": "SELECT * FROM (SELECT lang AS domain, count(*) AS n_claims, count(DISTINCT source) AS n_works FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) UNION ALL SELECT NULL, count(*), count(DISTINCT source) FROM documents",
    "urn_card": f"WITH {CLAIMS} SELECT source_urn AS canonical_urn, min(lang) AS domain, count(*) AS n_claims, nullif(count(*) FILTER (WHERE dimension = 'causal'), 0) AS n_causal, least(5, count(*))::INTEGER AS n_sample FROM claims WHERE source_urn = 'src7' GROUP BY 1",
    "term_mentions": "SELECT source AS canonical_urn, min(lang) AS domain, count(*) AS n FROM documents WHERE contains(lower(text), 'license') GROUP BY 1",
    "concepts_of_source": _NC + "SELECT DISTINCT concept_id FROM named WHERE source_urn = 'src7'",
    "adapter_checks": "WITH n AS (SELECT 'n' || (n_nationkey % 20) AS id FROM nation), e AS (SELECT 'e' || (n_nationkey % 24) AS id FROM nation) SELECT 'node id repeats' AS violation, count(*) AS n FROM (SELECT id FROM n GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'relation id repeats', count(*) FROM (SELECT id FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown source_id', count(*) FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'unknown target_id', count(*) FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'predicate has no mapping', count(*) FROM nation WHERE n_nationkey % 6 = 5",
    "adapter_edges": "SELECT 'e' || (n_nationkey % 24) AS edge_id, 'n' || n_nationkey AS src_id, 'r' || (n_regionkey + CASE WHEN n_nationkey = 4 THEN 9 ELSE 0 END) AS dst_id, 'structural' AS dimension, 'member' AS semantic_role, 'geo' AS system_id FROM nation WHERE n_nationkey % 6 <> 5",
    "wire_records": "SELECT 'i' || doc_id AS candidate_id, source AS source_urn, lang AS domain FROM documents WHERE doc_id % 9 <> 0 AND trim(text) <> '' AND (doc_id % 8 = 1 OR (doc_id % 4 <> 1 AND n_chars > 0))",
    "wire_requests": "SELECT count(*) AS n, count(*) AS candidates, 3 AS capabilities FROM documents WHERE trim(text) <> ''",
    "verifier_results": "SELECT doc_id AS candidate_id, 'unknown candidate' AS violation FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'partitions overlap' FROM documents WHERE doc_id % 10 = 0",
    "evidence_resolve": "SELECT doc_id AS ord, CASE WHEN doc_id % 6 <> 0 AND doc_id % 4 <> 0 THEN md5(text) END AS digest FROM documents",
    "search_docs": _NC + _ROWS + ", x AS (SELECT 'claim' AS type, lang AS domain FROM claims WHERE lang <> 'fr' AND source_urn <> 'src2' UNION ALL SELECT 'concept', d FROM ROWS_ WHERE canonical_urn <> 'src2') SELECT type, domain, count(*) AS n FROM x GROUP BY ALL",
    "capture_acquire": "SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 2 = 1 THEN 'new' WHEN doc_id % 6 = 0 THEN 'upgraded' WHEN doc_id % 10 = 0 THEN 'conflict' ELSE 'duplicate' END AS status FROM documents",
    "inbox_audits": "SELECT doc_id::VARCHAR AS name, 'no file' AS problem FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0 UNION ALL SELECT doc_id::VARCHAR, 'no row' FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0",
    "slice_ledgers": f"WITH {CLAIMS} SELECT d.doc_id::VARCHAR AS canonical_urn, CASE WHEN count(c.item_id) > 0 THEN 'processable' ELSE 'citation-only' END AS status, count(c.item_id) AS n_claims FROM documents d LEFT JOIN claims c ON c.doc = d.doc_id::VARCHAR WHERE d.lang = 'de' GROUP BY 1",
    "identity_resolution": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reg:' || doc_id WHEN 1 THEN 'pair:' || doc_id WHEN 2 THEN 'folder:' || doc_id ELSE 'urn:kg:' || source || '-' || doc_id || '-txt' END AS canonical_urn, ['kg-registry', 'kg-canonical', 'kg-sidecar', 'minted'][doc_id % 4 + 1] AS provenance FROM documents",
    "structure_leaves": "SELECT event_id AS doc_id, p AS path, CASE p WHEN '$.a.user_id' THEN user_id::VARCHAR WHEN '$.a.event_type' THEN event_type WHEN '$.b[0]' THEN event_id::VARCHAR ELSE '7' END AS value FROM events, (VALUES ('$.a.user_id'), ('$.a.event_type'), ('$.b[0]'), ('$.b[1]')) v(p)",
    "unmapped_predicates": f"SELECT coalesce(d, '{profiles.DEFAULT_DIMENSION}') AS dimension, count(*) AS n, count(DISTINCT p) AS profiles FROM (VALUES {_MAPPED}) v(p, x, d) GROUP BY 1",
}
