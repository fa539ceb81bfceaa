from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from kgspark.llm import line_crf as C
from kgspark.llm import subword_classifier as S

from .conftest import prose

ODD = [None, "", " \n \n", "one line", "\n", "|" * 3000, "a\n" * 500]


def brute_viterbi(model, features):
    best, kept = -np.inf, None
    score = model.scores(features)
    for labels in product((0, 1), repeat=len(features)):
        s = model.first[labels[0]] + sum(score[t, y] for t, y in enumerate(labels)) + sum(model.step[a, b] for a, b in zip(labels, labels[1:]))
        if s > best + 1e-12:
            best, kept = s, labels
    return list(kept)


def test_viterbi_equals_all_label_sequences():
    r = np.random.default_rng(0)
    model = C.Crf(r.normal(size=(C.N_FEATURES + 1, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    sizes = [1, 6, 0, 9, 3]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    features = np.stack([base + r.integers(0, w, ptr[-1]) for base, w in zip(C.BASES, C.WIDTHS)], axis=1)
    got = model.viterbi(features, ptr)
    for k, n in enumerate(sizes):
        if n:
            assert got[ptr[k] : ptr[k + 1]].tolist() == brute_viterbi(model, features[ptr[k] : ptr[k + 1]])


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(1)
    model = C.Crf(r.normal(size=(C.N_FEATURES + 1, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    ptr = np.array([0, 3, 3, 4, 9])
    features = np.stack([base + r.integers(0, w, 9) for base, w in zip(C.BASES, C.WIDTHS)], axis=1)
    gold = r.integers(0, 2, 9)
    _, emit, step, first = model.gradient(features, ptr, gold)
    for param, grad in ((model.emit, emit), (model.step, step), (model.first, first)):
        at = tuple(r.integers(0, n) for n in param.shape) if param is not model.emit else (features[0, 0], 1)
        old = param[at]
        param[at] = old + 1e-5
        up = model.gradient(features, ptr, gold)[0]
        param[at] = old - 1e-5
        down = model.gradient(features, ptr, gold)[0]
        param[at] = old
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def corpus(rng, n):
    good = ["\n".join(prose(rng, 30).capitalize() + "." for _ in range(rng.randint(1, 5))) for _ in range(n)]
    kinds = [lambda t: " | ".join(t.split()), lambda t: " ".join(w + "***" for w in t.split()), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + " " + w + " " + w for w in t.split())]
    bad = [kinds[k % 4](prose(rng, 40)) for k in range(n)]
    return good, bad


@pytest.fixture
def trained(spark, make_docs, rng):
    good, bad = corpus(rng, 120)
    docs = make_docs(good + bad)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240) if i % 8 < 4], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_of_both_models(trained):
    docs, labels = trained
    for rows in (C.quality(docs, labels), S.quality_scores(docs, labels)):
        got = {r["doc_id"]: r["keep"] for r in rows.collect()}
        held_out = [got[i] == (i < 120) for i in range(240) if i % 8 >= 4]
        assert len(got) == 240 and np.mean(held_out) >= 0.97


def test_edges_of_the_input(trained, make_docs):
    docs, labels = trained
    odd = make_docs(ODD + ODD).withColumnRenamed("lang", "keep")
    model = C.train(docs, labels)
    rows = C.judge(odd, model).orderBy("doc_id").collect()
    assert [r["n_lines"] for r in rows[:7]] == [0, 0, 0, 1, 0, 1, 500] and [tuple(r)[1:2] + tuple(r)[5:] for r in rows[:7]] == [tuple(r)[1:2] + tuple(r)[5:] for r in rows[7:]]
    assert not any(rows[k]["keep_"] for k in (0, 1, 2, 4)) and "keep" in rows[0].asDict()
    assert C.judge(odd, model, reject=True).columns == odd.columns
    assert C.judge(docs.limit(0), model).count() == 0 and C.train(docs, labels.limit(0)) is None
    assert sum(r["keep_"] for r in C.judge(odd, None).collect()) == 6
    scored = S.classify(odd, S.train(docs, labels)).orderBy("doc_id").collect()
    assert [scored[k]["p_quality"] for k in (0, 1, 2, 4)] == [0.0] * 4
    assert S.train(docs, labels.limit(0)) is None and S.classify(docs.limit(0), None).count() == 0
    assert sum(r["keep_"] for r in S.classify(odd, None).collect()) == 6


def test_boilerplate_lines_planted_in_good_documents_are_labelled(spark, make_docs, rng):
    good, bad = corpus(rng, 300)
    planted = [prose(rng, n).capitalize() + "." for n in (3, 6, 9, 12, 8)]
    mixed, truth = [], {}
    for i, t in enumerate(good):
        lines = [(x, 1) for x in t.split("\n")]
        for _ in range(i % 3):
            lines.insert(rng.randint(0, len(lines)), (rng.choice(planted), 0))
        mixed.append("\n".join(x for x, _ in lines))
        truth[i] = [y for _, y in lines]
    copies = [mixed[0] + " again" * k for k in range(1, 9)]  # lines of copies recur, but are no boilerplate
    docs = make_docs(mixed + bad + copies)
    labels = spark.createDataFrame([(i, int(i < 300 or i >= 600), 0) for i in range(608) if i % 2 == 0], "doc_id long, quality int, toxic int")
    model = C.train(docs, labels)
    held = [i for i in range(300) if i % 2]
    features, _, ptr, _ = C.lines(pa.array([mixed[i] for i in held]), model.known)
    got = model.viterbi(features, ptr)
    want = np.array([y for i in held for y in truth[i]])
    hit = ((got == 0) & (want == 0)).sum()
    assert hit >= 0.9 * (got == 0).sum() and hit >= 0.9 * (want == 0).sum() > 0
    share = {r["doc_id"]: r["content_share"] for r in C.judge(docs, model).collect()}
    assert np.mean([0 < share[i] < 1 for i in held if 0 in truth[i]]) >= 0.9 and np.mean([share[i] == 1 for i in held if 0 not in truth[i]]) >= 0.9
    assert share[600] > 0.5


def test_letters_whose_lower_case_has_another_length_are_read(spark, make_docs, trained):
    docs, labels = trained
    odd = make_docs(["\ua7cb\ua7dc\u0130\u1e9e" * 9, "x \ua7cb\n\ua7dc y"])
    assert [r["n_lines"] for r in C.judge(odd, C.train(docs, labels)).orderBy("doc_id").collect()] == [1, 2]


def test_score_is_the_mean_over_features():
    bucket, row = S.features(pa.array(["ab abcd abcd", "", "xyz"]))
    table = np.arange(S.N_BUCKETS, dtype=np.float32) / S.N_BUCKETS
    p, n = S.probability(pa.array(["ab abcd abcd", "", "xyz"]), table, 0.5)
    for r in range(3):
        own = table[bucket[row == r]]
        assert p[r] == pytest.approx(1 / (1 + np.exp(-((own.mean() if len(own) else 0) + 0.5))))
    assert n.tolist() == [3 + 2 + (2 + 1) + 2 * (4 + 3), 0, 1 + 3 + 2]


def plain_features(text):
    """Words, pairs of words, and marked character n-grams, as strings."""
    words = text.split()
    grams = [m[i : i + n] for w in words for m in ["\x02" + w + "\x03"] for n in (3, 4) for i in range(len(m) - n + 1)]
    return words, [(a, b) if a != b else "same" for a, b in zip(words, words[1:])], grams


def test_features_are_those_of_plain_python():
    texts = ["grüße né ß", "ab abcd abcd", "", " x ", "漢字 漢字かな é", "a\nb c", "naïve naïve"]
    bucket, row = S.features(pa.array(texts))
    seen, back = {}, {}
    for r, t in enumerate(texts):
        words, pairs, grams = plain_features(t)
        own = bucket[row == r].tolist()
        assert len(own) == len(words) + len(pairs) + len(grams)
        got = [own[: len(words)], own[len(words) : len(words) + len(pairs)], own[len(words) + len(pairs) :]]
        grams = [g for n in (3, 4) for g in grams if len(g) == n]
        for kind, (names, ids) in enumerate(zip((words, pairs, grams), got)):
            for name, i in zip(names, ids):
                assert seen.setdefault((kind, name), i) == i
                back.setdefault((kind, i), set()).add(name)
    assert all(len(names) == 1 for names in back.values())


def test_one_step_of_descent_is_that_of_plain_python():
    model, other = S.Model(3), S.Model(3)
    r = np.random.default_rng(0)
    for m in (model, other):
        m.out[:] = np.linspace(-1, 1, m.out.size).reshape(m.out.shape)
    ids, share = np.array([5, 9, 77]), np.array([0.5, 0.25, 0.25], np.float32)
    model.fit([(ids, share)], np.array([1]), epochs=1)
    mean = [sum(float(share[k]) * float(other.vectors[i, d]) for k, i in enumerate(ids)) for d in range(S.DIM)]
    score = [sum(mean[d] * float(other.out[d, c]) for d in range(S.DIM)) + float(other.bias[c]) for c in (0, 1)]
    total = sum(np.exp(score))
    p = [np.exp(score[0]) / total, np.exp(score[1]) / total - 1]
    for d in range(S.DIM):
        back = sum(float(other.out[d, c]) * p[c] for c in (0, 1))
        for k, i in enumerate(ids):
            assert model.vectors[i, d] == pytest.approx(float(other.vectors[i, d]) - S.RATE * min(share[k] * 3, 4) * back, abs=1e-5)
        for c in (0, 1):
            assert model.out[d, c] == pytest.approx(float(other.out[d, c]) - S.RATE * 0.1 * mean[d] * p[c], abs=1e-5)
    untouched = r.integers(100, S.N_BUCKETS, 50)
    assert (model.vectors[untouched] == other.vectors[untouched]).all()
