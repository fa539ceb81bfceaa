"""Leaves of JSON, of any depth and number."""

from __future__ import annotations

import json

from kgspark.operators import records as R


def leaves(x, path="$"):
    if isinstance(x, dict):
        return [l for k, v in x.items() for l in leaves(v, f"{path}.{k}")]
    if isinstance(x, list):
        return [l for i, v in enumerate(x) for l in leaves(v, f"{path}[{i}]")]
    return [(path, None if x is None else str(x).lower() if isinstance(x, bool) else str(x))]


def test_leaves_of_any_depth(spark):
    deep = 7
    for i in range(130):
        deep = {"d": deep} if i % 3 else [deep, i]
    docs = [{"a": {"b": [1, "x", {}, []]}, "c": None}, [], {}, 5, "x{[", None, True, {"k\\\"{": [{"z": "]]]"}, [[["q"]]]]}, {"]\"]]": {"x": {"y": [1]}}}, deep]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, None)]
    got = sorted(((r["doc_id"], r["path"], r["value"]) for r in R.structure(spark.createDataFrame(rows, "doc_id int, json string")).collect()), key=str)
    assert got == sorted(((i, p, v) for i, d in enumerate(docs) for p, v in leaves(d)), key=str)
    assert R.structure(spark.createDataFrame([], "doc_id int, json string")).count() == 0


def test_leaves_are_not_limited_by_rows(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('[', id, ',[1,2]]') AS json")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        assert R.structure(rows).count() == 9000
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
