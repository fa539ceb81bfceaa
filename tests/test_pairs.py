"""Pairs of concepts against their definition, in blocks and joins of all kinds."""

from __future__ import annotations

import itertools
import random

import pytest

from kgspark.operators import canon as C


@pytest.mark.parametrize(("block", "broadcast"), [(500, 10**6), (3, 0)])
def test_pairs_equal_their_definition(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "BROADCAST", broadcast)
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(5)}", f"u{rng.randrange(3)}", f"c{int(rng.random() ** 2 * 40)}") for _ in range(400)] + [("s1", "", "c1"), (None, "u1", "c2")]
    rows += [(f"s{s}", "u9", f"same{c}") for s in (1, 2) for c in range(9)]
    units = {}
    for s, u, c in rows:
        if s and u:
            units.setdefault(c, set()).add((s, u))
    want = {}
    for a, b in itertools.combinations(sorted(units), 2):
        n = len({s for s, _ in units[a] & units[b]})
        if n >= 2:
            want[a, b] = n
    got = C.pairs(spark.createDataFrame(rows, "source_urn string, unit_id string, concept_id string")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["n_sources"] for r in got} == want


def test_a_pair_is_made_once_not_for_each_source(spark, monkeypatch):
    """Concepts of one source, most by far, meet nobody: what is joined follows the pairs that come out."""
    rows = [(f"s{s}", "u", f"c{s}-{i}") for s in range(4) for i in range(1500)] + [(f"s{s}", "u", c) for s in range(4) for c in ("x", "y")]
    made = []
    monkeypatch.setattr(C, "cut", lambda df: made.append(df.localCheckpoint()) or made[-1])
    assert [(r["a"], r["b"], r["n_sources"]) for r in C.pairs(spark.createDataFrame(rows, "source_urn string, unit_id string, concept_id string")).collect()] == [("x", "y", 4)]
    assert [d.count() for d in made] == [1, 1]
