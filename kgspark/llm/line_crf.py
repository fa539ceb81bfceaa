"""Quality rules as line sequence labelling: a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm import kernels as K
from kgspark.llm.common import fresh, labelled

#: Labelled documents of each class that the model is fitted on, at most.
TRAIN_PER_CLASS = 1500
#: A document stays if so much of its text (bytes of its lines) is labelled content.
MIN_CONTENT_SHARE = 0.25
EPOCHS, RATE, RIDGE = 200, 0.25, 3e-5
#: A line that stands in so many training documents that are not copies of each other is boilerplate.
MIN_RECURRENCE = 3
#: Documents that share so much of their words are copies of each other: their lines recur for that reason.
MAX_LIKENESS = 0.5
#: Known lines are rare each, so their weights are held back less.
LINE_RIDGE = 1e-5

_UPPER, _LOWER, _DIGIT, _SPACE, _PLAIN, _ODD, _PIPE = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 11, 12, 13, 32]] = True
_PLAIN[[ord(c) for c in ".,;:'\"?-()"]] = True
_PIPE[ord("|")] = True
_ODD[33:127] = True
_ODD &= ~(_UPPER | _LOWER | _DIGIT | _PLAIN)
_ODD[ord("!")] = False
_END = np.full(256, 2)
_END[[ord(c) for c in ".!?:;\"')"]] = 1
_END[65:91] = _END[97:123] = _END[128:] = 0

BINS = [
    np.array(b)
    for b in (
        [0.1, 0.3, 0.6],  # capitals among letters
        [0.004, 0.02, 0.06, 0.15, 0.3],  # odd symbols
        [0.005, 0.03, 0.07, 0.15],  # ordinary punctuation
        [0.01, 0.1, 0.3],  # digits
        [0.02, 0.1, 0.3, 0.6],  # words that repeat the one before
        [2.5, 3.5, 5, 7, 10, 16],  # bytes in a word
        [1, 2, 4, 8, 16, 40, 100, 300],  # words
        [0.005, 0.02],  # bars
        [0.5, 1.5],  # last byte: letter, stop, other
        [0.02, 0.1],  # exclamation marks to words
        [0.5, 1.5],  # how many of: capitals, odd symbols, repeats, bars, shouts
    )
]
WIDTHS = np.array([len(b) + 1 for b in BINS])
BASES = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
#: After the binned features: no line beside it is a known one, or one is.
BESIDE = int(WIDTHS.sum())
N_FEATURES = BESIDE + 2


def lines(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (n, 13), bytes, row pointers and keys of the lines that are not blank.

    The last but one tells whether a line beside it is among the ``known`` keys (sorted), the last is
    the line itself, if it is among them, else "unknown".
    """
    texts = texts.fill_null("")
    data, off = K.buffers(texts)
    n = len(data)
    start, end = K.line_spans(data, off)
    word = K.split_words(texts)
    if len(word.data) != n:  # folding keeps byte positions
        raise AssertionError("folding moved bytes")

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[start]).astype(np.float64)

    size = (end - start).astype(np.float64)
    blank = count(_SPACE[data]) >= size
    upper, lower, odd = count(_UPPER[data]), count(_LOWER[data]), count(_ODD[data])
    plain, digits, bars, shouts = count(_PLAIN[data]), count(_DIGIT[data]), count(_PIPE[data]), count(data == ord("!"))
    first, last = np.searchsorted(word.start, start), np.searchsorted(word.start, end)
    n_words = (last - first).astype(np.float64)
    token = word.hashes()
    same = np.zeros(len(token) + 1, np.int64)
    if len(token) > 1:
        same[2:] = np.cumsum(token[1:] == token[:-1])
    lo = np.minimum(first + 1, len(token))
    repeats = np.where(last > first, same[last] - same[lo], 0)
    in_words = np.zeros(len(token) + 1)
    np.cumsum(word.end - word.start, out=in_words[1:])
    per = lambda x, of: x / np.maximum(of, 1)
    tail = _END[data[np.maximum(end - 1, 0)]] if n else np.zeros(0)
    raw = [per(upper, upper + lower), per(odd, size), per(plain, size), per(digits, size), per(repeats, n_words - 1), per(in_words[last] - in_words[first], n_words), n_words, per(bars, size), tail, per(shouts, n_words)]
    raw.append(sum((raw[k] > x).astype(np.int64) for k, x in ((0, 0.6), (1, 0.02), (4, 0.1), (7, 0.005), (9, 0.1))))
    keep = ~blank
    lo, hi = K.stripped(data, start, end)
    key = K.span_hashes(word.data, lo[keep], hi[keep])
    columns = [np.searchsorted(b, x[keep], "right") + base for b, x, base in zip(BINS, raw, BASES)] if n else [np.zeros(0, np.int64)] * len(BINS)
    ptr = np.searchsorted(start[keep], off)
    return np.stack([*columns, *marks(key, ptr, known)], axis=1), size[keep], ptr, key


def marks(key: np.ndarray, ptr: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The features that rest on known lines: is one beside it, and which is it. Without the first, a
    line that good and rejected documents share would draw its neighbours to its own label."""
    at = place(key, known)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    beside = np.zeros(len(at), np.int64)
    link = row[1:] == row[:-1]
    beside[1:] |= (at[:-1] > 0) & link
    beside[:-1] |= (at[1:] > 0) & link
    return BESIDE + beside, N_FEATURES + at


def place(keys: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """1 + the place of each key among the known ones; 0 for others."""
    if known is None or not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at + 1, 0)


def recurring(key: np.ndarray, ptr: np.ndarray, word_sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lines that stand in MIN_RECURRENCE texts at least (sorted), and which of these do so
    in texts that aren't copies of each other."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    pairs = np.unique(np.stack([key, row.astype(np.uint64)], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
    known, head, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    often = count >= MIN_RECURRENCE
    known, head, count = known[often], head[often], count[often]
    apart = np.zeros(len(known), bool)
    for k, (a, n) in enumerate(zip(head.tolist(), count.tolist())):
        picked: list[np.ndarray] = []
        for r in pairs[a : a + n, 1].astype(np.int64).tolist():
            own = word_sets[r]
            if all(np.isin(own, x, assume_unique=True).sum() <= MAX_LIKENESS * max(1, min(len(own), len(x))) for x in picked):
                picked.append(own)
                if len(picked) >= MIN_RECURRENCE:
                    apart[k] = True
                    break
    return known, apart


class Crf:
    """Two labels (0 boilerplate, 1 content); weights of features, of the first label and of steps, and
    the known lines, which are features of their own."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None, first: np.ndarray | None = None, known: np.ndarray | None = None) -> None:
        self.known = np.zeros(0, np.uint64) if known is None else known
        self.emit = np.zeros((N_FEATURES + 1 + len(self.known), 2)) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step
        self.first = np.zeros(2) if first is None else first

    @staticmethod
    def order(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences, longest first, and how many reach each position."""
        size = np.diff(ptr)
        by_size = np.argsort(-size, kind="stable")
        longest = int(size.max()) if len(size) else 0
        return by_size, np.searchsorted(-size[by_size], -np.arange(1, longest + 1), "right")

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)

    def viterbi(self, features: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The best label sequence of each row; equal scores choose content."""
        score, (seq, reach) = self.scores(features), self.order(ptr)
        label, back = np.zeros(len(features), np.int8), np.zeros((len(features), 2), np.int8)
        if not len(reach):
            return label
        size, head = np.diff(ptr)[seq], ptr[:-1][seq]
        best = np.zeros((len(seq), 2))
        for t, m in enumerate(reach):
            at = head[:m] + t
            if t == 0:
                best[:m] = self.first + score[at]
                continue
            via = best[:m, :, None] + self.step
            came = (via[:, 1, :] >= via[:, 0, :]).astype(np.int8)
            back[at] = came
            best[:m] = np.where(came == 1, via[:, 1, :], via[:, 0, :]) + score[at]
        now = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(len(reach) - 1, -1, -1):
            m = reach[t]
            at = head[:m] + t
            label[at] = now[:m]
            inner = size[:m] > 0
            now[:m] = np.where(inner, back[at, now[:m]], now[:m]) if t else now[:m]
        return label

    def gradient(self, features: np.ndarray, ptr: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood and its gradient by the forward-backward algorithm."""
        score, (seq, reach) = self.scores(features), self.order(ptr)
        head, n = ptr[:-1][seq], len(features)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        total = 0.0
        for t, m in enumerate(reach):
            at = head[:m] + t
            alpha[at] = score[at] + (self.first if t == 0 else np.logaddexp.reduce(alpha[at - 1][:, :, None] + self.step, axis=1))
        for t in range(len(reach) - 2, -1, -1):
            at = head[: reach[t + 1]] + t
            beta[at] = np.logaddexp.reduce(self.step + (score[at + 1] + beta[at + 1])[:, None, :], axis=2)
        z = np.zeros(n)
        some = np.flatnonzero(np.diff(ptr) > 0)
        z_row = np.logaddexp.reduce(alpha[ptr[1:][some] - 1], axis=1)
        z = np.repeat(z_row, np.diff(ptr)[some])
        p = np.exp(alpha + beta - z[:, None])
        hot = np.eye(2)[gold]
        emit = np.zeros_like(self.emit)
        diff = hot - p
        for c in range(features.shape[1]):
            for y in (0, 1):
                emit[:, y] += np.bincount(features[:, c], diff[:, y], len(emit))
        starts = ptr[:-1][some]
        inner = np.ones(n, bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        pair = np.exp(alpha[at - 1][:, :, None] + self.step + (score[at] + beta[at])[:, None, :] - z[at][:, None, None])
        step = np.zeros((2, 2))
        np.add.at(step, (gold[at - 1], gold[at]), 1)
        total = score[np.arange(n), gold].sum() + self.first[gold[starts]].sum() + self.step[gold[at - 1], gold[at]].sum() - z_row.sum()
        return total, emit, step - pair.sum(axis=0), diff[starts].sum(axis=0)

    def fit(self, features: np.ndarray, ptr: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS) -> Crf:
        """Maximum likelihood with a ridge, by Adam over the whole sample."""
        if not len(features):
            return self
        params = [self.emit, self.step, self.first]
        ridge = [np.where(np.arange(len(self.emit)) > N_FEATURES, LINE_RIDGE, RIDGE)[:, None], RIDGE, RIDGE]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, epochs + 1):
            _, *grads = self.gradient(features, ptr, gold)
            for p, g, a, b, hold in zip(params, grads, m, v, ridge):
                g = g / len(features) - hold * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += RATE * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-9)
        return self


def gold_labels(key: np.ndarray, ptr: np.ndarray, quality: np.ndarray, word_sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(label of each line, known lines). Lines of good documents are content but for those that recur
    in documents that aren't copies of each other; all lines of the others are boilerplate."""
    known, apart = recurring(key, ptr, word_sets)
    label = np.repeat(quality, np.diff(ptr))
    label[np.isin(key, known[apart])] = 0
    return label, known


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = TRAIN_PER_CLASS, text: str = "text", key: str = "doc_id") -> Crf | None:
    """A field fitted on labelled documents, each distinct text once, with labels for each line.

    None if a class has no document: nothing can be learned, and nothing is to be rejected.
    """
    rows = labelled(docs, labels, "quality", per_class, text, key).toPandas().sort_values(["_k", "_t"], kind="stable", na_position="first")
    if rows["_y"].nunique() < 2:
        return None
    return fitted(rows.drop_duplicates(["_t", "_y"]))


def fitted(rows: pd.DataFrame) -> Crf:
    """A field fitted on texts (_t) and their quality (_y). Texts are read by slices: only lines and
    distinct words are held of all of them."""
    texts = pa.record_batch([pa.array(rows["_t"].tolist(), pa.string())], ["text"])
    features, size, keys, words = [], [], [], []
    for batch in K.slices([texts], "text"):
        column = batch.column(0)
        own, _, ptr, key = lines(column)
        w = K.split_words(column)
        token = w.hashes()
        words += [np.unique(token[a:b]) for a, b in zip(w.ptr, w.ptr[1:])]
        features.append(own), size.append(np.diff(ptr)), keys.append(key)
    all_features, key, ptr = np.concatenate(features), np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(size))])
    gold, known = gold_labels(key, ptr, rows["_y"].to_numpy(np.int64), words)
    all_features[:, -2:] = np.stack(marks(key, ptr, known), axis=1)
    return Crf(known=known).fit(all_features, ptr, gold)


def judge(docs: DataFrame, model: Crf | None, *, min_share: float = MIN_CONTENT_SHARE, text: str = "text", reject: bool = False) -> DataFrame:
    """docs with ``n_lines``, ``n_content``, ``content_share`` and ``keep`` for each row.

    Lines end at line feeds; blank ones aren't labelled. Boilerplate is what looks like the lines of
    rejected documents, or stands where such lines do, or recurred among the training documents. The
    share is of bytes in content lines among those of all lines. With ``reject`` only rows that stay
    come back, with docs' columns alone.

    Null, empty or blank text: no lines, share 0, rejected. One very long line is one label. Rows are
    judged each by itself, so repeated rows agree. Without a model every row that has a line stays.
    Empty table: empty result. New names that clash get underscores.
    """
    names = fresh(docs, "n_lines", "n_content", "content_share", "keep")
    kinds = (T.IntegerType(), T.IntegerType(), T.DoubleType(), T.BooleanType())
    schema = docs.schema if reject else T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text):
            features, size, ptr, _ = lines(batch.column(text), None if model is None else model.known)
            label = np.ones(len(features), np.int8) if model is None else model.viterbi(features, ptr)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ptr])
            share = total(size * label) / np.maximum(total(size), 1)
            keep = (share >= min_share) & (np.diff(ptr) > 0)
            if reject:
                yield batch.filter(pa.array(keep))
            else:
                new = [np.diff(ptr).astype(np.int32), total(label.astype(np.int64)).astype(np.int32), share, keep]
                yield pa.record_batch([*batch.columns, *map(pa.array, new)], schema.names)

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_content, content_share, keep) for every document."""
    model = train(docs, labels, text=text, key=key)
    return judge(docs.select(F.col(key), F.col(text)), model, text=text).drop(text)
