import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import kernels as K

ODD = [None, "", " ", "İstanbul ẞTRASSE — “Quote” É x²y", "a\nb  c", "漢字、かな", "Ωmega ΚΑΛΗΣ", "x" * 5000]


def check(texts):
    w = K.split_words(pa.array(texts, pa.string()))
    h = w.hashes()
    seen = {}
    for r, t in enumerate(texts):
        at = slice(w.ptr[r], w.ptr[r + 1])
        got = [bytes(w.data[s:e]).decode() for s, e in zip(w.start[at], w.end[at])]
        assert got == K.words(t)
        for word, x in zip(got, h[at].tolist()):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_words_of_odd_texts():
    check(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_match_their_definition(texts):
    check(texts)


def test_grams_and_rows_depend_on_their_words_only():
    w = K.split_words(pa.array(["a b c d", "x a b c", "", "a b c d"]))
    g = K.gram_hashes(w.hashes(), 3)
    inside = K.whole(w.ptr, 3, len(w.start))
    assert inside.tolist() == [True, True, False, False, True, True, False, False, True, True]
    assert g[0] == g[5] == g[8] and g[1] == g[9] and g[0] != g[1]
    rows = K.row_hashes(w.hashes(), w.ptr)
    assert rows[0] == rows[3] != rows[1] and rows[2] == 0


def test_slices_keep_every_row():
    batch = pa.record_batch([pa.array(["a" * n for n in (10, 0, 900, 5, 5)] + [None])], ["t"])
    assert [x for b in K.slices(iter([batch, batch.slice(0, 0)]), "t", 100) for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_lines_and_blanks():
    data, off = K.buffers(pa.array(["a \n\n b", "", "c\n", "\n"]))
    start, end = K.line_spans(data, off)
    assert [bytes(data[s:e]) for s, e in zip(start, end)] == [b"a ", b"", b" b", b"c", b""]
    lo, hi = K.stripped(data, start, end)
    assert [bytes(data[s:e]) for s, e in zip(lo, hi)] == [b"a", b"", b"b", b"c", b""]


def test_folding_moves_no_byte_and_splits_alike_for_every_code_point():
    chars = ["a" + chr(c) + "b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = pa.array(chars)
    folded = K.fold_array(texts).to_pylist()
    assert all(len(x.encode()) == len(y.encode()) and K.fold(x) == y for x, y in zip(chars, folded))
    w = K.split_words(texts)
    at = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.ptr, w.ptr[1:])]
    assert all(got == K.words(t) for got, t in zip(at, chars))
