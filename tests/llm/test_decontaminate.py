import re

import pytest

from kgspark.llm import decontaminate as D
from kgspark.llm import kernels as K

from .conftest import prose

ITEMS = "item_id long, text string"


def brute(text, items, n=8):
    """Words of the text that lie in a gram of an item."""
    grams = {tuple(w[i : i + min(n, len(w))]) for w in map(K.words, items) if len(w) >= 5 for i in range(len(w) - min(n, len(w)) + 1)}
    w = K.words(text)
    return {j for g in grams for i in range(len(w) - len(g) + 1) if tuple(w[i : i + len(g)]) == g for j in range(i, i + len(g))}


@pytest.fixture
def case(rng):
    items = [prose(rng, n) for n in (40, 12, 6)] + ["too short", "", None]
    base = [prose(rng, 60) for _ in range(6)]
    texts = [
        base[0],
        base[1] + " " + items[0] + ". " + base[2],
        re.sub(" ", ", ", items[1].upper()),
        base[3] + "\n" + items[2].title() + "!\n" + base[4],
        base[5] + " " + " ".join(items[0].split()[:7]),
        None,
        "",
        "É " + base[0] + " " + " ".join(items[0].split()[5:20]),
        "x " * 3000 + items[1] + " y" * 3000,
    ]
    return texts, items


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_same_as_brute_force(spark, make_docs, case, limit):
    texts, items = case
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    docs = make_docs(texts)
    got = {r["doc_id"]: r for r in D.decontaminate(docs, bench, max_broadcast_grams=limit).collect()}
    for i, t in enumerate(texts):
        bad = brute(t, [x for x in items if x]) if t else set()
        if bad and len(bad) >= 0.5 * len(K.words(t)):
            assert i not in got
            continue
        assert got[i]["removed_words"] == len(bad)
        assert K.words(got[i]["text"]) == [w for k, w in enumerate(K.words(t)) if k not in bad]
        if not bad:
            assert got[i]["text"] == t
    assert set(range(len(texts))) - set(got) == {2}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_a_cut_that_joins_a_passage_is_cut_again(spark, make_docs, limit):
    item = "one two three four five six seven eight"
    other = "red green blue black white pink grey brown"
    text = "keep " * 40 + "one two three four " + other + " five six seven eight" + " tail" * 40
    bench = spark.createDataFrame([(1, item), (2, other)], ITEMS)
    row = D.decontaminate(make_docs([text]), bench, max_broadcast_grams=limit).first()
    assert row["removed_words"] == 16 and set(row["text"].split()) == {"keep", "tail"}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_a_passage_joined_by_cuts_is_cut_whatever_the_number_of_grams(spark, make_docs, limit):
    item = "one two three four five six seven eight"
    other = "red green blue black white pink grey brown"
    third = "north south east west up down left right"
    inner = "five six " + third + " seven eight"
    texts = [
        "keep " * 40 + "one two three four " + other + " five six seven eight" + " tail" * 40,
        "keep " * 60 + "one two " + other + " three four " + inner.replace("five six", "five " + other + " six") + " tail" * 60,
        "keep one two three four " + other + " five six seven eight tail",
        "keep " * 9 + "one two three four five six seven",
        None,
    ]
    bench = spark.createDataFrame([(1, item), (2, other), (3, third)], ITEMS)
    got = {r["doc_id"]: r for r in D.decontaminate(make_docs(texts), bench, max_broadcast_grams=limit).collect()}
    assert {i: (r["removed_words"], r["removed_spans"]) for i, r in got.items()} == {0: (16, 2), 1: (32, 4), 3: (0, 0), 4: (0, 0)}
    assert all(set(got[i]["text"].split()) == {"keep", "tail"} for i in (0, 1)) and got[3]["text"] == texts[3]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_letters_whose_lower_case_has_another_length_move_no_cut(spark, make_docs, limit):
    item = "one two three four five six seven eight"
    odd = "\ua7cb\ua7dc\u0130\u1e9e\u212a"
    bench = spark.createDataFrame([(1, item)], ITEMS)
    row = D.decontaminate(make_docs([odd * 3 + " keep " * 30 + item + " end here" + odd]), bench, max_broadcast_grams=limit).first()
    assert row["text"].split() == [odd * 3, *["keep"] * 30, "end", "here" + odd] and row["removed_words"] == 8


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_empty_tables_repeats_and_clashing_names(spark, make_docs, limit):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], ITEMS)
    docs = make_docs(["x y", "x y"]).withColumnRenamed("lang", "removed_words")
    out = D.decontaminate(docs.union(docs), bench, max_broadcast_grams=limit)
    assert out.count() == 4 and out.columns[-2:] == ["removed_words_", "removed_spans"]
    assert D.decontaminate(docs.limit(0), bench, max_broadcast_grams=limit).count() == 0
    assert D.decontaminate(docs, bench.limit(0), max_broadcast_grams=limit).count() == 2


def test_random_order_of_rows_changes_nothing(spark, make_docs, case):
    texts, items = case
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    docs = make_docs(texts)
    rows = lambda d: sorted(map(str, D.decontaminate(d, bench).collect()))
    assert rows(docs) == rows(docs.repartition(3).orderBy("n_chars"))
