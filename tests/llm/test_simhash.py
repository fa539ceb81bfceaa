import time

import numpy as np
import pytest

from kgspark.llm import simhash as S

from .conftest import prose


def edit(rng, text, share):
    w = text.split()
    return " ".join(prose(rng, 1) if rng.random() < share else x for x in w)


@pytest.mark.parametrize("budget", [0, 3, 10])
def test_trie_join_equals_all_pairs(budget):
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = keys[:200] ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64))
    keys = np.concatenate([keys, near, near[:20], np.zeros(3, np.uint64)])
    group = r.integers(0, 3, len(keys))
    order = np.lexsort((keys, group))
    keys, group = keys[order], group[order]
    i, j = S.trie_pairs(keys, group, budget)
    want = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if group[a] == group[b] and int(keys[a] ^ keys[b]).bit_count() <= budget}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("leaf", [1, 48, S.LEAF])
def test_trie_join_of_neighbouring_kinds(leaf):
    r = np.random.default_rng(5)
    keys = np.repeat(r.integers(0, 2**63, 40, dtype=np.uint64), 30) ^ (np.uint64(1) << r.integers(0, 64, 1200, dtype=np.uint64))
    group, kind = r.integers(0, 2, 1200), r.integers(0, 6, 1200)
    kind[(group == 0) & (kind == 3)] = 5  # kinds 2 and 4 of group 0 follow each other, but are no neighbours
    order = np.lexsort((keys, kind, group))
    keys, group, kind = keys[order], group[order], kind[order]
    i, j = S.trie_pairs(keys, group, 10, kind, leaf)
    near = np.bitwise_count(keys[:, None] ^ keys) <= 10
    near &= (group[:, None] == group) & (np.abs(kind[:, None] - kind) <= 1)
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    assert len(i) == len(want) > 1000 and set(zip(i.tolist(), j.tolist())) == want


def test_length_classes_part_no_lengths_of_a_kind():
    n = np.arange(1, 3000)
    c = S.length_classes(n)
    for w in n.tolist():
        most = n[w >= S.MIN_LENGTH_RATIO * n].max()
        assert c[most - 1] - c[w - 1] <= 1
    assert len(S.length_classes(n[:0])) == 0


def test_large_tries_cost_little_a_pair():
    # tries of a table of 6 GB hold thousands of keys, which no trie tells apart before its leaves
    r = np.random.default_rng(6)
    keys = np.sort(r.integers(0, 2**64, 12_000, dtype=np.uint64))
    began = time.process_time()
    S.trie_pairs(keys, np.zeros(len(keys), np.int64), 10)
    assert time.process_time() - began < 1.2  # 72 million pairs; at 43 ns each it was 3 s


def test_blocks_miss_no_pair_within_the_budget(spark):
    r = np.random.default_rng(4)
    sig = r.integers(0, 2**63, 400, dtype=np.uint64)
    for k in range(200, 400):
        for b in r.choice(64, r.integers(0, 14), replace=False):
            sig[k] ^= np.uint64(1) << np.uint64(b) if k % 2 else 0
        if k % 2:
            sig[k] = sig[k - 200]
            for b in r.choice(64, r.integers(0, 14), replace=False):
                sig[k] ^= np.uint64(1) << np.uint64(b)
    rows = [(i, int(x.view(np.int64)), 0, 20) for i, x in enumerate(sig)]
    edges = S.near_edges(spark.createDataFrame(rows, "id long, sig long, more long, words int")).collect()
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = [(a, b) for a in range(400) for b in range(a + 1, 400) if int(sig[a] ^ sig[b]).bit_count() <= S.BUDGET]
    for a, b in want:
        root[max(find(a), find(b))] = min(find(a), find(b))
    expect = [find(x) for x in range(400)]
    root = list(range(400))
    for e in edges:
        a, b = find(e["src"]), find(e["dst"])
        root[max(a, b)] = min(a, b)
    assert [find(x) for x in range(400)] == expect and len(want) > 60


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["id"]: r["root"] for r in S.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}
    assert S.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_planted_copies_are_found_and_clean_texts_are_not(spark, make_docs, rng):
    base = [prose(rng, rng.randint(60, 400)) for _ in range(80)]
    texts = [*base, *base[:20], *(edit(rng, t, 0.04) for t in base[:40]), *([base[79]] * 50)]
    found = {r["doc_id"]: r["duplicate_of"] for r in S.duplicates(make_docs(texts)).collect()}
    copies = [(80 + k, k) for k in range(20)] + [(100 + k, k) for k in range(40)] + [(140 + k, 79) for k in range(50)]
    assert np.mean([found.get(c) == o for c, o in copies]) >= 0.95
    assert all(found[c] == o for c, o in copies if c < 100 or c >= 140)
    assert not [c for c in found if c < 80]


def test_edges_of_the_input(spark, make_docs):
    texts = [(1, None), (2, None), (3, ""), (4, ""), (5, "Short text."), (6, "short TEXT"), (7, "short words"), (None, "short text"), (8, "a " * 9000), (9, "a " * 9000)]
    docs = make_docs(texts).withColumnRenamed("lang", "duplicate_of")
    found = sorted((r["doc_id"], r["duplicate_of"], r["group_size"]) for r in S.duplicates(docs).collect())
    assert found == [(6, 5, 2), (9, 8, 2)]
    kept = S.deduplicate(docs.union(docs))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "None", "None"])
    assert kept.columns == docs.columns
    assert S.duplicates(docs.limit(0)).count() == 0 and S.deduplicate(docs.limit(0)).count() == 0


def test_keys_of_any_type_and_a_column_named_gone(spark, make_docs):
    texts = ["one two three four five six seven eight nine ten eleven twelve thirteen"] * 3 + ["other words"]
    docs = make_docs(texts).selectExpr("concat('u/', 9 - doc_id) as doc_id", "text", "lang as _gone", "source", "n_chars")
    assert {tuple(r) for r in S.duplicates(docs).collect()} == {("u/8", "u/7", 3), ("u/9", "u/7", 3)}
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {"u/7", "u/6"}
    assert S.duplicates(docs.selectExpr("named_struct('a', doc_id) as doc_id", "text")).count() == 2
