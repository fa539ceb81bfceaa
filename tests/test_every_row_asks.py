"""Queries over every row and the whole of it, against brute force."""

import math
from pathlib import Path

import numpy as np
import pytest

from kgspark import catalogue
from kgspark.operators import canon as C
from kgspark.operators import mining as M
from kgspark.operators import records
from kgspark.operators import retrieve as R
from kgspark.plans import context
from kgspark.plans.base import coordinates

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def brute(ids, vectors, k):
    m = np.array(vectors, float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm == 0, 1, norm)
    out = {}
    for q, v in zip(ids, m):
        scored = sorted((-round(float(v @ w), 12), i) for i, w in zip(ids, m))[:k]
        out |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_vectors_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (60, 6)).astype(float).tolist() + [[0.0] * 6, [1.0] * 6, [2.0] * 6]
    rows = spark.createDataFrame([*((100 - i, v) for i, v in enumerate(vectors)), (None, [1.0] * 6), (7, None)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in R.nearest_vectors(rows, k=4, block_rows=block_rows).collect()}
    want = brute([100 - i for i in range(len(vectors))], vectors, 4)
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)
    assert R.nearest_vectors(rows.limit(0)).count() == 0


@needs_tables
def test_every_embedding_asks(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], 10)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in catalogue.queries()["dense_cosine_topk_all"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x][1] - want[x][1]) < 1e-8 for x in want)
    assert sum(got[x][0] != want[x][0] for x in want) == 0
    one = {(r["vec_id"], r["score"]) for r in catalogue.queries()["dense_cosine_topk"](spark, SF).collect()}
    assert {v for (q, _), v in got.items() if q == 0} == one


def test_every_source_is_placed_as_by_definition(spark):
    held = {"a": "xyz", "b": "xy", "c": "z", "d": "wq", "e": "wx", "old": "xw"}
    rows = [(u, "_archive" if u == "old" else u, c) for u, cs in held.items() for c in cs + "0"]
    live = {u: set(cs + "0") for u, cs in held.items() if u != "old"}
    idf = {c: math.log(len(live) / sum(c in x for x in live.values())) for c in "xyzwq0"}
    want = {}
    for q, cs in held.items():
        for u in live.keys() - {q}:
            dot = sum(idf[c] ** 2 for c in set(cs) & live[u])
            if dot > 0:
                want[q, u] = dot / math.sqrt(sum(idf[c] ** 2 for c in cs) * sum(idf[c] ** 2 for c in live[u]))
    h = spark.createDataFrame(rows, "urn string, domain string, concept_id string")
    scores = M.all_source_scores(h)
    got = {(r["query"], r["urn"]): r["score"] for r in scores.collect()}
    assert got == pytest.approx(want)
    near = {(r["query"], r["urn"]) for r in M.nearest_sources(scores, 2, by=("query",)).collect()}
    assert near == {x for q in held for x in sorted((x for x in want if x[0] == q), key=lambda x: (round(want[x], 9), x[1]))[-2:]}


@needs_tables
def test_the_placed_source_of_the_sql_is_one_of_all(spark):
    q = catalogue.queries()
    sources = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().collect()}
    for name in ("placement_nearest_sources", "placement_rank_domains", "placement_tier"):
        all_ = q[f"{name}_all"](spark, SF).collect()
        one = q[name](spark, SF)
        assert {tuple(r[c] for c in one.columns) for r in all_ if r["query"] == "src4"} == {tuple(r) for r in one.collect()}
        assert {r["query"] for r in all_} <= sources and (name != "placement_tier" or len(all_) == len(sources))


@needs_tables
def test_edges_of_every_source_are_checked(spark):
    urns = [r[0] for r in C.edges(coordinates(spark, SF)).select("canonical_urn").collect()]
    odd = sum(int(u.removeprefix("src")) % 2 for u in urns)
    got = {r["violation"]: r["n"] for r in catalogue.queries()["edge_contract_violations_all"](spark, SF).collect()}
    assert len(set(urns)) > 2 and got == {"semantic_role required": odd, "type invalid for family": len(urns) - odd}


def test_a_turn_that_differs_after_forty_characters_is_changed(spark, tmp_path):
    digests = []
    for tail in ("one", "two"):
        spark.createDataFrame([(1, 0, "user", "x" * 40 + tail), (1, 1, "bot", "y")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/{tail}/conversations.parquet")
        digests.append(context._envelopes(spark, f"{tmp_path}/{tail}").select(records.digest(context._envelopes(spark, f"{tmp_path}/{tail}"))).first()[0])
    assert digests[0] != digests[1]


@needs_tables
def test_every_concept_has_its_sources(spark):
    want = {(r["concept_id"], r["source_urn"]) for r in coordinates(spark, SF).collect()}
    rows = [(r["concept_id"], r["source_urn"]) for r in catalogue.queries()["sources_for_model_all"](spark, SF).collect()]
    assert set(rows) == want and len(rows) == len(want)
    numbers = {c: len({s for x, s in want if x == c}) for c, _ in want}
    assert min(numbers.values()) < 15
    assert {(r["concept_id"], r["n_sources"]) for r in catalogue.queries()["sources_for_model"](spark, SF).collect()} == {(c, n) for c, n in numbers.items() if n >= 15}
