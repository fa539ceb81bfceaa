import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import html_extract as H
from kgspark.llm import kernels as K
from kgspark.llm import language_id as L
from kgspark.llm import line_dedup as N
from kgspark.llm import mixing as M
from kgspark.llm import sharding as J
from kgspark.llm import suffix_dedup as X

from .conftest import prose


# --- HTML


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=12))
def test_best_region_is_the_best_of_all(scores):
    lo, hi, total = H.best_region(np.array(scores, float))
    want = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert total == want and sum(scores[lo:hi]) == want


def page(rng, body):
    nav = "".join(f"<li><a href='/{k}'>{prose(rng, 1)}</a></li>" for k in range(8))
    return f"<html><head><title>t</title><script>a<b</script></head><body><nav><ul>{nav}</ul></nav><!-- x > y --><div>{prose(rng, 9)}</div><article><h1>Top &amp; head</h1>{body}</article><footer>{prose(rng, 14)}</footer></body></html>"


def test_regions_of_labelled_pages_are_found_again(spark, rng):
    texts = [[prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    pages = spark.createDataFrame([(i, f"u{i}", page(rng, "".join(f"<p>{p}</p>" for p in t))) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_pages(pages).collect()}
    assert np.mean([got[i] == "\n".join(["Top & head", *t]) for i, t in enumerate(texts)]) >= 0.95


def test_html_edges(spark):
    rows = [(1, None), (2, ""), (3, "<br><hr>"), (4, "plain words &lt;only"), (5, "<p>a <b"), (6, "<script>never ends"), (7, "x" * 9 + "<i>" * 4000), (7, "x" * 9 + "<i>" * 4000), (None, "<p>y</p>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "html", "'mine' as text")
    got = H.extract_pages(pages).collect()
    assert sorted((str(r["page_id"]), r["text_"]) for r in got) == [("1", ""), ("2", ""), ("3", ""), ("4", "plain words <only"), ("5", "a"), ("6", ""), ("7", "x" * 9), ("7", "x" * 9), ("None", "y")]
    assert got[0]["text"] == "mine" and H.extract_pages(pages.limit(0)).count() == 0


# --- language


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    syllables = {"aa": "ka ro mi tun sel", "bb": "oth ing esh wend arl", "cc": "que ción ados ez lla"}
    speak = lambda s, n: " ".join("".join(rng.choice(s.split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, speak(syllables[l], rng.randint(20, 300)), l) for i, l in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs.where("doc_id < 90"))
    got = {r["doc_id"]: r["language"] for r in L.identify(docs, model).collect()}
    assert np.mean([got[i] == l for i, _, l in rows if i >= 90]) >= 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "!!", None), (4, "x " * 9000, "a"), (4, "x " * 9000, "a"), (None, "x", "a")], "doc_id long, text string, lang string")
    got = L.identify(docs.withColumnRenamed("lang", "margin"), L.train(docs)).collect()
    by = Counter((r["doc_id"], r["language"]) for r in got)
    assert by == {(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "a"): 2, (None, "a"): 1} and "margin_" in got[0].asDict()
    assert {r["language"] for r in L.language_id(docs.where("doc_id < 4")).collect()} == {"und"}
    assert L.language_id(docs.limit(0)).count() == 0


def test_narrow_margins_and_ties_are_rejected():
    model = L.Model({"a": b"same words here", "b": b"same words here"})
    assert model.classify(b"same words here") == ("und", 0.0)
    assert L.joined_words(__import__("pyarrow").array(["Ab, c\n d", "", None, "É"])) == [b"ab c d", b"", b"", "é".encode()]


# --- lines


def test_hash_is_minimal_perfect_and_rejects_strangers():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        counts = r.integers(1, 400, len(keys))
        shard = N.Shard.build(keys, counts)
        assert sorted(shard.number(keys).tolist()) == list(range(len(keys)))
        assert (shard.count(keys) == np.minimum(counts, 255)).all()
        assert (shard.count(r.integers(0, 2**63, 20000, dtype=np.uint64)) > 0).mean() < 0.001


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lines_go_as_counted_by_brute_force(spark, make_docs, rng, limit):
    common = [prose(rng, 5) for _ in range(4)]
    texts = ["\n".join(rng.choice([*common[:3], prose(rng, 4), "", " " + common[0] + "\t"]) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    texts += [None, "", "\n\n", common[3] + "\n" + common[3], "z" * 40000]
    n = Counter(x.strip(" \t") for t in texts for x in (t or "").split("\n"))
    keep = lambda t: "\n".join(x for x in t.split("\n") if not x.strip(" \t") or n[x.strip(" \t")] <= 6)
    docs = make_docs(texts).withColumnRenamed("lang", "removed_lines")
    got = {r["doc_id"]: r for r in N.dedup_lines(docs, shard_keys=16, max_broadcast_bytes=limit).collect()}
    for i, t in enumerate(texts):
        lost = sum(bool(x.strip(" \t")) and n[x.strip(" \t")] > 6 for x in (t or "").split("\n"))
        assert got[i]["text"] == (None if t is None else keep(t)), i
        assert got[i]["removed_lines_"] == lost
    assert N.dedup_lines(docs.limit(0)).count() == 0


# --- mixing


def fill(sizes, weights, budget, cap):
    """Water-filling as it is told: clamp, redistribute, until feasible."""
    clamped = set()
    while True:
        rest = budget - sum(cap * sizes[s] for s in clamped)
        total = sum(weights[s] for s in weights if s not in clamped)
        over = {s for s in weights if s not in clamped and rest * weights[s] > cap * sizes[s] * total}
        if not over:
            return {s: cap * 1_000_000 if s in clamped else min(cap * 1_000_000, max(0, rest) * weights[s] * 1_000_000 // (sizes[s] * total)) for s in weights}
        clamped |= over


@pytest.mark.parametrize("share", [0.3, 1.0, 3.0, 9.0])
def test_rates_are_those_of_the_loop(spark, share):
    rng = random.Random(5)
    sizes = {f"s{k}": rng.randint(1, 4000) for k in range(9)}
    weights = {s: rng.randint(1, 50) for s in sizes}
    docs = spark.createDataFrame([(i, "x" * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r["source"]: r["rate"] for r in M.source_rates(docs, weights, budget_share=share).collect()}
    assert got == fill(sizes, weights, int(sum(sizes.values()) * share), 4)


def test_mix_draws_whole_and_fractional_repetitions(spark):
    rows = [(i, "x" * 10, "big") for i in range(3000)] + [(5000 + i, "x" * 10, "small") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = M.mix(docs, {"big": 1, "small": 1}).collect()
    n = Counter(r["source"] for r in a)
    assert n["small"] == 400 and abs(n["big"] - 2700) < 100
    assert sorted(map(tuple, a)) == sorted(map(tuple, M.mix(docs.repartition(7), {"big": 1, "small": 1}, max_broadcast_sources=0).collect()))
    assert {r["doc_id"] for r in M.mix(docs, {"big": 1, "small": 1}, seed=1).collect()} != {r["doc_id"] for r in a}


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "xx", None), (3, "xx", None), (None, "yyyy", "b")], "doc_id long, text string, source string").selectExpr("*", "1 as copy")
    got = M.mix(docs).collect()
    assert {r["source"] for r in got} == {None, "b"} and "copy_" in got[0].asDict()
    assert sum(r["doc_id"] == 3 for r in got) % 2 == 0
    assert M.mix(docs.limit(0)).count() == 0 and M.mix(docs, {}).count() == 0


# --- shards


def one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop_and_moves_only_what_it_must():
    keys = np.random.default_rng(0).integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (1, 2, 10, 1000):
        assert J.jump(keys, n).tolist() == [one(int(k), n) for k in keys]
    a, b = J.jump(keys, 50), J.jump(keys, 60)
    assert set(b[a != b]) <= set(range(50, 60)) and abs((a != b).mean() - 10 / 60) < 0.03
    assert np.bincount(a, minlength=50).min() > 25


def test_shard_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (1, "x"), (None, ""), (None, "y" * 9999)], "doc_id long, text string").selectExpr("*", "0 as shard")
    got = J.assign_shards(docs, 7).collect()
    assert len({(r["doc_id"], r["shard_"]) for r in got}) == 2 and all(r["shard"] == 0 for r in got)
    assert J.assign_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        J.assign_shards(docs, 0)
    J.write_shards(docs.drop("shard"), str(tmp_path / "s"), 7)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


# --- suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_is_sorted(text):
    assert X.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_passages(texts, m):
    at = {}
    for i, t in texts:
        w = K.words(t)
        for k in range(len(w) - m + 1):
            at.setdefault(tuple(w[k : k + m]), []).append((i, k))
    spans = {}
    for spots in at.values():
        if len({i for i, _ in spots}) > 1:
            for i, k in spots:
                spans.setdefault((i, (i, k) == min(spots)), set()).update([k])
    out = set()
    for (i, first), ks in spans.items():
        for k in sorted(ks):
            if k - 1 not in ks:
                e = k
                while e + 1 in ks:
                    e += 1
                out.add((i, k, e + m - 1, first))
    return out


def test_passages_equal_brute_force(spark, make_docs, rng):
    shared = [prose(rng, n) for n in (50, 51, 120, 49, 300)]
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(20)]
    texts += [prose(rng, rng.randint(0, 90)) + " " + rng.choice(shared).title() + ", " + prose(rng, 60) for _ in range(30)]
    texts += [texts[0], "to " * 400, "to " * 200, shared[2] + " " + shared[2], None, ""]
    texts += [texts[21], "again " + shared[4] + " " + shared[4], "again " + shared[4] + " " + shared[4]]
    want = brute_passages([(i, t) for i, t in enumerate(texts) if t], 50)
    for limit, most in ((64 << 20, 50_000), (0, 50_000), (64 << 20, 3), (0, 0)):
        got = [tuple(r) for r in X.repeated_passages(make_docs(texts), max_broadcast_bytes=limit, max_contexts=most).collect()]
        assert set(got) == want and len(got) == len(want)
    named = make_docs(texts).selectExpr("'u/' || lpad(doc_id, 4, '0') as doc_id", "text")
    assert {(int(r[0][2:]), *r[1:]) for r in map(tuple, X.repeated_passages(named).collect())} == want


def test_a_window_has_one_original_when_each_anchor_is_alone(spark, make_docs, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 0)
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        passage = prose(rng, 120).split()
        texts += [prose(rng, rng.randint(1, 30)) + " " + " ".join(passage[rng.randint(0, 35) : rng.randint(85, 120)]) + " " + prose(rng, rng.randint(1, 30)) for _ in range(6)]
    want = brute_passages(list(enumerate(texts)), 50)
    for limit in (64 << 20, 0):
        got = [tuple(r) for r in X.repeated_passages(make_docs(texts), max_broadcast_bytes=limit).collect()]
        assert set(got) == want and len(got) == len(want)


def test_only_stretches_that_others_have_in_part_are_sorted(monkeypatch, rng):
    line = prose(rng, 20).split()
    texts = [prose(rng, 30).split() + line + prose(rng, 30).split() for _ in range(300)]  # the line, and else nothing
    texts += [prose(rng, 25).split() + texts[k][5:] for k in range(20)]  # 75 words of one other text, which are the same in both
    texts += [prose(rng, 10).split() + texts[30][10:], texts[30][:70] + prose(rng, 10).split()]  # parts of one text that overlap
    number = {}
    words = [X.packed(K.mix(np.array([number.setdefault(w, len(number)) for w in t], np.uint64))) for t in texts]
    sorted_words = []
    real = X.suffix_array
    monkeypatch.setattr(X, "suffix_array", lambda text: sorted_words.append(len(text)) or real(text))
    anchor, ident, pos = np.full(len(texts), 7), np.arange(len(texts))[::-1].copy(), np.full(len(texts), 3)
    got = set()
    for found in X.passages_of(anchor, ident, pos, words, np.array([ident[50]]), 50):
        got |= {(d, k, first) for d, lo, hi, first in zip(*(x.tolist() for x in found)) for k in range(lo, hi)}
    want = {(d, k, first) for d, a, z, first in brute_passages([(int(i), " ".join(t)) for i, t in zip(ident, texts)], 50) for k in range(a + 3, z - 50 + 5)}
    own = {(int(ident[50]), k, True) for k in range(3, 3 + len(texts[50]) - 49)}  # a copied text repeats as a whole
    assert got == want | own
    assert sum(sorted_words) < 400  # all 25,000 were, before


def test_passage_edges(spark, make_docs, rng):
    t = prose(rng, 80)
    docs = make_docs([(1, t), (None, t), (2, None), (3, "")])
    assert X.repeated_passages(docs.union(docs)).count() == 0
    assert X.repeated_passages(docs.limit(0)).count() == 0
    for texts in ([(1, t), (2, t), (2, t + " more")], [(1, t), (2, t + " x"), (2, "no " * 60)]):
        rows = {tuple(r)[0] for r in X.repeated_passages(make_docs(texts)).collect()}
        assert rows in (set(), {1, 2})
    two = make_docs([(1, t), (5, t), (5, t)]).withColumnRenamed("lang", "original")
    assert {tuple(r) for r in X.repeated_passages(two).collect()} == {(1, 0, 79, True), (5, 0, 79, False)}
