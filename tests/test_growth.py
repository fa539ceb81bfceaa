"""Steps whose cost must follow the input."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgspark import catalogue
from kgspark.operators import identity as I
from kgspark.operators import lifecycle as L
from kgspark.plans.base import coordinates

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_a_batch_is_numbered_by_many_tasks(spark):
    old = spark.createDataFrame([(7, "o1", "tip")], "sequence long, object_id string, new_digest string")
    new = spark.range(1000).select(F.lit("t").alias("event_type"), F.lit("user").alias("object_type"), F.concat(F.lit("o"), F.col("id") % 3).alias("object_id"), F.col("id").cast("string").alias("payload"), (-F.col("id")).alias("ord"))
    log = L.append(old, new, observed_at="now")
    rows = {r["sequence"]: r for r in log.collect()}
    assert [rows[s]["payload"] for s in range(8, 1008)] == [str(i) for i in range(999, -1, -1)]
    assert rows[8]["prior_digest"] == "" and rows[9]["prior_digest"] == "" and rows[10]["prior_digest"] == "tip" and rows[11]["prior_digest"] == rows[8]["new_digest"]
    assert "windowspecdefinition(ord" not in log._jdf.queryExecution().optimizedPlan().toString()
    assert L.append(old, new.limit(0), observed_at="now").count() == 0


def test_words_of_titles_meet_names_by_whole_words(spark):
    """A thousand titles whose words begin alike: no more rows are joined than words stand in names."""
    side = spark.range(1000).selectExpr("id AS ord", "concat('urn:y:', id) AS canonical_urn", "concat('alpha', id, 'x bravo', id, 'x charlie delta echoes foxes') AS title")
    files = spark.range(1000).selectExpr("concat('the_alpha', id, 'x-bravo', id, 'xAndMore.pdf') AS name")
    got = I.sidecar_matches(files, side)
    assert {(r["name"], r["canonical_urn"]) for r in got.collect()} == {(f"the_alpha{i}x-bravo{i}xAndMore.pdf", f"urn:y:{i}") for i in range(1000)}
    assert "word" in {a.name() for a in _join_keys(got)}


def _join_keys(df):
    plan, keys = [df._jdf.queryExecution().optimizedPlan()], []
    while plan:
        node = plan.pop()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Join":
            refs = node.condition().get().references().toSeq()
            keys += [refs.apply(i) for i in range(refs.size())]
    return keys


@needs_tables
def test_concepts_of_few_sources_are_counted(spark):
    want = {}
    for r in coordinates(spark, SF).collect():
        want.setdefault(r["concept_id"], set()).add(r["source_urn"])
    got = {r["concept_id"]: r["n_sources"] for r in catalogue.queries()["sources_for_model"](spark, SF).collect()}
    assert got == {c: len(s) for c, s in want.items()} and min(got.values()) == 1


def test_texts_without_capitals_or_quotes_are_turned_away(spark):
    from kgspark.functions import text as X

    texts = ["plain words of nothing", "the Market Order\tAct is", "Den „Größe of Daten“ nennt", "a\n\nÄrger Amt", "x Öl", "", None, "a ‹thing› it"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["k"] for r in rows.orderBy("i").select(X.key_term(F.col("t")).alias("k")).collect()]
    assert got == ["nothing", "market-order-act", "gr-e-of-daten", "rger-amt", "x-l", "", "", "thing"]
    assert "\\s[A-ZÄÖÜ]" in rows.select(X.key_term(F.col("t")))._jdf.queryExecution().analyzed().toString()


def test_blocks_of_vectors_grow_with_the_rows(spark):
    """A hundred rows in blocks of two at least: nine blocks, not fifty."""
    from kgspark.operators import retrieve as T

    rows = spark.range(100).selectExpr("id AS vec_id", "array(float(id), float(1)) AS embedding")
    assert "sequence(0, 8," in T.nearest_vectors(rows, block_rows=2)._jdf.queryExecution().analyzed().toString()
