from __future__ import annotations

import json

from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.sources import files


def test_listing_records_what_is_skipped(spark, tmp_path):
    for name in ("law/a.md", "law/b.txt", "top.pdf", "law/.hidden/x.md", "law/pic.png", "stub.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("text\x00 here\x07")
    (tmp_path / "stub.md.metadata.json").write_text(json.dumps({"canonical_urn": "urn:x:1", "title": "T"}))
    rows = {r["relpath"]: (r["domain"], r["skipped"]) for r in files.listing(spark, str(tmp_path)).collect()}
    assert rows["law/a.md"] == ("law", None) and rows["top.pdf"] == ("_root", None) and "law/.hidden/x.md" not in rows
    assert rows["law/pic.png"][1] == "unsupported" and rows["stub.md"][1] == "stub"
    assert {r["text"] for r in files.texts(spark, str(tmp_path)).collect()} == {"text here"}
    assert [(r["canonical_urn"], r["title"]) for r in files.sidecars(spark, str(tmp_path)).collect()] == [("urn:x:1", "T")]


def test_csv_tables_keep_empty_cells_and_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x ""y""\nz",\n')
    assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / "t.csv")).collect()] == [('x "y"\nz', "")]


def test_a_source_leaves_its_domain_only(spark, tmp_path):
    at = str(tmp_path / "claims")
    rows = spark.createDataFrame([("law", "u1", 1), ("law", "u2", 2), ("ml", "u1", 3)], "domain string, canonical_urn string, n int")
    files.write_claims(rows, at)
    files.remove_source(spark, at, "u1", "law")
    assert sorted(r["n"] for r in spark.read.parquet(at).collect()) == [2, 3]


def test_overlays_and_exports_are_exact_and_idempotent(spark, tmp_path):
    claims = spark.createDataFrame([("i1", "s1", 5, "causes", "B."), ("i2", "s1", 0, "means", "A <b>.")], "item_id string, source_urn string, span_start int, predicate string, text string")
    notes = G.overlay_notes(claims)
    assert files.write_overlay(notes, tmp_path / "o") == {"new": 1, "changed": 0, "removed": 0}
    assert (tmp_path / "o/s1.md").read_text() == "# s1\n\n- **means** A <b>.\n- **causes** B.\n"
    assert files.write_overlay(notes, tmp_path / "o") == {"new": 0, "changed": 0, "removed": 0}
    assert files.write_overlay(notes.limit(0), tmp_path / "o") == {"new": 0, "changed": 0, "removed": 1}
    concepts = spark.createDataFrame([("c1", "x" * 90)], "concept_id string, label string")
    edges = spark.createDataFrame([("i1", "c1", "grounds")], "src_id string, dst_id string, edge_type string")
    data = files.payload(G.payload_nodes(claims, concepts, claims.select("source_urn").distinct()), G.payload_edges(claims, edges))
    assert data["counts"] == {"nodes": 4, "edges": 3} and any(n["label"].endswith("…") and len(n["label"]) == 80 for n in data["nodes"])
    files.write_graphml(data, tmp_path / "g.graphml")
    assert "A &lt;b&gt;." in (tmp_path / "g.graphml").read_text()
    assert files.write_json(data, tmp_path / "g.json") and not files.write_json(data, tmp_path / "g.json")


def test_a_broken_envelope_stops_the_read(spark, tmp_path):
    import pytest

    (tmp_path / "e.json").write_text(json.dumps({"idempotency_key": "k", "source_id": "s", "content_digest": "x", "axes": [], "evidence": [], "nodes": [], "relations": []}))
    with pytest.raises(Exception, match="content_digest is no sha256"):
        files.read_envelopes(spark, str(tmp_path)).collect()


def test_streams_count_in_windows(spark, tmp_path):
    from kgspark.streaming import events as S

    spark.createDataFrame([(1, "2024-01-01 00:00:01", "a"), (1, "2024-01-01 00:05:00", "a"), (2, "2024-01-01 03:00:00", "b")], "user_id int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id int, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = S.windowed_counts(stream).writeStream.format("memory").queryName("w1").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("w1").collect()] == [2]
    assert S.session_counts(stream).isStreaming


def test_a_watched_folder_hands_over_new_files_once(spark, tmp_path):
    from kgspark.streaming import events as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    seen = []
    S.watch(spark, str(tmp_path / "in"), lambda batch, n: seen.extend(r["length"] for r in batch.collect()), once=True).awaitTermination()
    assert seen == [1]
