"""Ids are short digests: rows that share one by chance stay apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.operators import lifecycle as L
from kgspark.operators import records as R

CLAIM = "item_id string, source_urn string, concept_id string, text string"


def shared(spark):
    """One id in two sources, each with its own concept."""
    return spark.createDataFrame([("item-1", "a", "x", "t" * 90), ("item-1", "b", "y", "other"), ("item-2", None, "z", "t")], CLAIM)


def test_a_source_holds_its_own_concepts_only(spark):
    c = shared(spark)
    edges = c.select(F.lit("e").alias("edge_id"), F.col("item_id").alias("src_id"), F.col("concept_id").alias("dst_id"), F.lit("grounds").alias("edge_type"), F.col("source_urn").alias("canonical_urn"))
    assert {tuple(r) for r in G.models_for_source(c, edges).collect()} == {("a", "x"), ("b", "y"), (None, "z")}
    assert [tuple(r) for r in G.models_for_source(c, edges, "b").collect()] == [("b", "y")]
    assert [r[0] for r in G.sources_for_model(c, edges, "x").collect()] == ["a"]
    assert {tuple(r) for r in G.models_for_source(c, edges.drop("canonical_urn")).collect()} >= {("a", "y"), ("b", "x")}


def test_nodes_that_share_an_id_stay(spark):
    c = shared(spark).unionByName(shared(spark))
    rows = [tuple(r) for r in G.payload_nodes(c, c.select("concept_id", F.col("concept_id").alias("label")), c.select("source_urn").distinct()).collect()]
    assert len(rows) == len(set(rows)) and {r for r in rows if r[1] == "claim"} == {("item-1", "claim", "t" * 79 + "…"), ("item-1", "claim", "other"), ("item-2", "claim", "t")}


def test_nodes_are_hidden_with_their_source(spark):
    docs = spark.createDataFrame([("claim:1", "a", "de"), ("claim:1", "a", "fr"), ("claim:1", None, "fr"), ("claim:2", "a", "fr"), ("claim:3", "gone", "de")], "doc_id string, canonical_urn string, domain string")
    gone = spark.createDataFrame([("claim:1", "a", "fr")], "node_id string, canonical_urn string, domain string")
    sources = spark.createDataFrame([("gone",)], "canonical_urn string")
    left = L.hide(docs, gone, sources, by=("canonical_urn", "domain"))
    assert sorted(map(tuple, left.select(docs.columns).collect()), key=str) == [("claim:1", "a", "de"), ("claim:1", None, "fr"), ("claim:2", "a", "fr")]
    assert [tuple(r) for r in L.hide(docs, gone, sources).select(docs.columns).collect()] == [("claim:2", "a", "fr")]


def test_records_whose_keys_are_equal_by_chance_stay(spark, monkeypatch):
    """Every short digest is made one and the same."""
    part = F.substring
    monkeypatch.setattr(R.F, "substring", lambda c, at, n: F.lit("0" * 10) if [str(at), str(n)] == ["1", "10"] else part(c, at, n))
    rows = [(f"user {i}", f'{{"u":{i}}}', "s", "", "{}", "causal", "bot", v, "", None) for i in range(3) for v in ("1", "2", "2")]
    d = spark.createDataFrame(rows, "id string, record string, summary string, body string, facets string, dimension string, actor string, version string, observed_at string, captures array<struct<kind:string,content:string,locator:string>>")
    e = R.record_envelopes(d, identity=True)
    assert e.count() == 6 and e.select("idempotency_key").distinct().count() == 1
    assert {(r["node_id"], r["properties"]["_version"]) for r in R.current(e).collect()} == {(f"record:user-{i}", "2") for i in range(3)}
    assert {r["node_id"] for r in R.nodes(R.record_envelopes(d)).collect()} == {f"record:user-{i}:{'0' * 10}" for i in range(3)}
