"""The corpus pipeline, the queries with SQL, and language sizes, against their definitions."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline as P
from kgspark.llm import decontaminate, language_id, line_crf, mixing, queries, sharding, simhash
from kgspark.llm import kernels as K

from .conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, make_docs, rng, tmp_path):
    """A corpus of good texts, junk, copies and benchmark passages, as a folder of tables."""
    item = prose(rng, 30)
    good = [prose(rng, rng.randint(40, 120)).capitalize() + ".\n" + prose(rng, 20) + "." for _ in range(80)]
    junk = [" | ".join(prose(rng, 30).upper().split()) for _ in range(40)]
    texts = good + junk + good[:10] + [good[20] + " " + item + " " + prose(rng, 60), item, None, "", " "]
    docs = make_docs(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), texts, item


def test_the_run_is_its_stages_by_brute_force(spark, tables):
    sf, texts, item = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = line_crf.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = []
    for i, t in enumerate(texts):
        features, size, _, _ = line_crf.lines(pa.array([t or ""]), model.known)
        label = model.viterbi(features, np.array([0, len(features)]))
        if len(features) and (size * label).sum() / size.sum() >= line_crf.MIN_CONTENT_SHARE:
            kept.append(i)
    assert set(range(80)) <= set(kept) and not set(kept) & set(range(80, 120))
    sketch = {i: [int(x[0]) for x in simhash.sketches(pa.array([texts[i]]))] for i in kept}
    root = {i: i for i in kept}
    for i in kept:
        for j in kept:
            (a, b, m), (c, d, n) = sketch[i], sketch[j]
            if i < j and (a ^ c).bit_count() <= simhash.BUDGET and (b ^ d).bit_count() <= simhash.BUDGET_PAIRS and min(m, n) >= simhash.MIN_LENGTH_RATIO * max(m, n):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    kept = [i for i in kept if root[i] == i]
    assert not set(kept) & set(range(120, 130))
    grams = {tuple(K.words(item)[k : k + 8]) for k in range(len(K.words(item)) - 7)}
    left = {}
    for i in kept:
        w = K.words(texts[i])
        bad = {j for k in range(len(w) - 7) if tuple(w[k : k + 8]) in grams for j in range(k, k + 8)}
        if len(bad) < decontaminate.DROP_SHARE * len(w):
            left[i] = [x for j, x in enumerate(w) if j not in bad]
    got = P.run(spark, sf).collect()
    rates = {}
    size = {f"s{k}": 0 for k in range(3)}
    by_id = {r["doc_id"]: r for r in got}
    assert set(by_id) <= set(left)
    for r in got:
        assert K.words(r["text"]) == left[r["doc_id"]] and r["shard"] == sharding.jump(np.frombuffer(__import__("hashlib").md5(str(r["doc_id"]).encode()).digest()[:8], ">u8"), sharding.N_SHARDS)[0]
        assert r["n_chars"] == len(r["text"]) or r["text"] == texts[r["doc_id"]]
        rates.setdefault(r["source"], {}).setdefault(r["doc_id"], 0)
        rates[r["source"]][r["doc_id"]] += 1
    stage = spark.createDataFrame([(i, texts[i] if left[i] == K.words(texts[i]) else by_id[i]["text"] if i in by_id else " ".join(left[i]), f"s{i % 3}") for i in left], "doc_id long, text string, source string")
    want = {r["source"]: r["rate"] for r in mixing.source_rates(stage).collect()}
    for s, n in rates.items():
        assert all(k in (want[s] // mixing.UNIT, want[s] // mixing.UNIT + 1) for k in n.values())
    assert set(size) == set(rates)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_every_stage_takes_odd_rows(spark, make_docs, tables, name):
    sf, _, item = tables
    odd = make_docs([(1, None), (None, "x y z"), (None, None), (2, ""), (3, " \n"), (4, "word " * 20000), (5, item), (5, item), (6, "a b.\na b.")])
    odd = odd.unionByName(odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars"))
    odd = odd.selectExpr("*", "1 as _gone", "2 as keep", "3 as removed_words", "4 as shard", "5 as copy")
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, sf)
    extra = ["shard_"] if name == "sharding" else []
    assert out.columns == odd.columns + extra and out.count() >= 0
    assert stage(spark, odd.limit(0), sf).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr(list(r)) for r in want)


def test_language_is_that_of_plain_compression(spark, rng):
    speak = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, speak(("abcde", "fghij", "klmab")[i % 3], rng.randint(1, 1500)), "xyz"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 30"))
    got = {r["doc_id"]: (r["language"], r["margin"]) for r in language_id.identify(docs, model).collect()}
    for i, text, _ in rows:
        raw, sizes = " ".join(K.words(text)).encode(), {}
        for name, content in model.contents.items():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = 0
            for at in range(0, len(raw), language_id.PIECE_BYTES):
                coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[name] += len(coder.compress(raw[at : at + language_id.PIECE_BYTES]))
        first, second = sorted(sizes.values())[:2]
        margin = (second - first) / first
        assert got[i] == (min(sizes, key=lambda k: (sizes[k], k)) if margin >= language_id.MIN_MARGIN else "und", margin)


def test_samples_hold_distinct_keys_with_one_row_each(spark):
    from kgspark.llm.common import labelled, sample_keys

    keys = spark.createDataFrame([(1, "a")] * 2000 + [(k, "b") for k in range(500)], "_k long, g string")
    rows = sample_keys(keys, "g", 5).collect()
    assert sorted(r["g"] for r in rows) == ["a", *["b"] * 5] and len({tuple(r) for r in rows}) == 6
    docs = spark.createDataFrame([(1, "x")] * 200 + [(2, "y"), (2, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    assert sorted(map(tuple, labelled(docs, labels, "quality", 5).collect())) == [(1, "x", 1), (2, "y", 0)]
