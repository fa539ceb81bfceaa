"""Benchmark decontamination: hash windows of the training text against benchmark n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm import kernels as K
from kgspark.llm.common import bit_table, fresh, materialize

#: Words in an n-gram. An item of fewer words is one gram of its own length.
GRAM_WORDS = 8
#: Items of fewer words can't be told from ordinary language and are not searched for.
MIN_ITEM_WORDS = 5
#: A document goes as a whole once this share of its words lies in benchmark passages.
DROP_SHARE = 0.5
#: Up to so many grams (about 100 bytes each) are broadcast; more are joined by hash.
MAX_BROADCAST_GRAMS = 1_000_000
#: Bits that tell windows of text from grams before the join; more grams than these serve only make
#: more windows meet them.
MAX_TABLE_BYTES = 64 << 20

GRAMS = T.StructType([T.StructField("hash", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.StringType())])


def item_grams(benchmark: DataFrame, text: str, n: int, min_words: int) -> DataFrame:
    """(hash, size, words) of every gram of every item, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                w = K.words(t)
                if len(w) >= min_words:
                    size = min(n, len(w))
                    found |= {" ".join(w[i : i + size]): size for i in range(len(w) - size + 1)}
            sizes = list(found.values())
            hashes = np.zeros(len(found), np.uint64)
            if found:
                grams = K.split_words(pa.array(list(found)), folded=True)
                token = grams.hashes()
                for size in set(sizes):
                    own = np.flatnonzero(np.array(sizes) == size)
                    at = K.gram_hashes(token, size)
                    hashes[own] = at[grams.ptr[own]]
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(sizes, pa.int32()), pa.array(list(found), pa.string())], ["hash", "size", "words"])

    return benchmark.select(F.col(text).cast("string")).mapInArrow(run, GRAMS).distinct()


class Grams:
    """The hash set: a bit table to turn nearly all windows away, then exact hashes, then the words."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, words: list[str]) -> None:
        self.sizes = sorted(set(sizes.tolist()))
        self.known = {s: np.unique(hashes[sizes == s]) for s in self.sizes}
        self.shift = np.uint64(64 - max(10, int(len(words) * 64).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[hashes >> self.shift] = True
        self.words = frozenset(words)

    def hits(self, w: K.Words) -> list[tuple[int, int, int]]:
        """(row, first word, word after) of every verified window, by row and first word."""
        token, out = w.hashes(), []
        for size in self.sizes:
            h = K.gram_hashes(token, size)
            at = np.flatnonzero(self.table[h >> self.shift])
            at = at[np.isin(h[at], self.known[size])]
            row = np.searchsorted(w.ptr, at, "right") - 1
            keep = at + size <= w.ptr[row + 1]
            for r, i in zip(row[keep].tolist(), at[keep].tolist()):
                gram = " ".join(bytes(w.data[s:e]).decode() for s, e in zip(w.start[i : i + size], w.end[i : i + size]))
                if gram in self.words:
                    out.append((r, i, i + size))
        return sorted(out)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the byte spans; blanks that meet at a cut become one."""
    raw, at, out = text.encode(), 0, b""
    for lo, hi in [*spans, (len(raw), len(raw))]:
        piece = raw[at:lo]
        if at and out[-1:].isspace():
            piece = piece.lstrip(b" ")
        out += piece
        at = hi
    return out.decode()


def merged(found: list[tuple[int, int, int]]) -> dict[int, list[list[int]]]:
    """Word spans of each row, overlaps joined."""
    rows: dict[int, list[list[int]]] = {}
    for r, lo, hi in found:
        spans = rows.setdefault(r, [])
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return rows


def scanned(texts: pa.Array, hits: Callable[[K.Words], list[tuple[int, int, int]]]) -> tuple[np.ndarray, dict[int, tuple[int, int, str]]]:
    """Words of each row; removed words, spans and new text of the rows in which one scan finds something."""
    w = K.split_words(texts)
    found = {}
    for r, spans in merged(hits(w)).items():
        left = cut(texts[r].as_py(), [(int(w.start[lo] - w.offsets[r]), int(w.end[hi - 1] - w.offsets[r])) for lo, hi in spans])
        found[r] = sum(hi - lo for lo, hi in spans), len(spans), left
    return np.diff(w.ptr), found


def cleaned(texts: pa.Array, hits: Callable[[K.Words], list[tuple[int, int, int]]], drop_share: float) -> tuple[dict[int, str], np.ndarray, np.ndarray, np.ndarray]:
    """New texts of the rows that change; for each row its removed words, spans and whether it goes.

    A cut may bring a passage together, so what was cut is scanned again until nothing is found.
    """
    n = len(texts)
    changed: dict[int, str] = {}
    removed, cuts, drop, total = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, np.int64)
    which, again = np.arange(n), texts
    while len(which):
        count, found = scanned(again, hits)
        if not total.any():
            total = count
        for r, (gone, spans, left) in found.items():
            i = int(which[r])
            removed[i] += gone
            cuts[i] += spans
            changed[i] = left
            drop[i] = removed[i] >= drop_share * total[i]
        which = which[sorted(found)]
        again = pa.array([changed[int(i)] for i in which], pa.string())
    return changed, removed, cuts, drop


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, n: int = GRAM_WORDS, min_item_words: int = MIN_ITEM_WORDS, drop_share: float = DROP_SHARE,
    max_broadcast_grams: int = MAX_BROADCAST_GRAMS, text: str = "text", item_text: str = "text",
) -> DataFrame:
    """docs without benchmark passages, plus ``removed_words`` and ``removed_spans`` for each row.

    Words are compared in lower case without punctuation. Every window of ``n`` words of every
    document is looked up; a hit counts once its words are equal, not just their hash. The union of
    the windows is cut out; documents of which that is ``drop_share`` or more go.

    Null or empty text: the row stays as it is. Null or short items find nothing. Repeated rows and
    ties: each row is judged alone. Empty benchmark or documents: nothing changes. Other columns pass
    unchanged; a column named like a new one keeps its name and the new one gets an underscore.
    """
    grams = item_grams(benchmark, item_text, n, min_item_words)
    removed_col, spans_col = fresh(docs, "removed_words", "removed_spans")
    schema = T.StructType([*docs.schema.fields, T.StructField(removed_col, T.IntegerType()), T.StructField(spans_col, T.IntegerType())])
    rows = grams.limit(max_broadcast_grams + 1).toArrow()
    if len(rows) > max_broadcast_grams:
        return _joined(docs, grams, text, drop_share, schema)
    hashes, sizes, known = rows.column("hash").to_numpy().view(np.uint64), rows.column("size").to_numpy().astype(np.int64), rows.column("words").to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast((hashes, sizes, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(*shared.value)
        for batch in K.slices(batches, text):
            yield _apply(batch, text, grams.hits, drop_share, schema.names)

    return docs.mapInArrow(run, schema)


def _replaced(column: pa.Array, changed: dict[int, str]) -> pa.Array:
    if not changed:
        return column
    values = column.to_pylist()
    for i, value in changed.items():
        values[i] = value
    return pa.array(values, column.type)


def _apply(batch: pa.RecordBatch, text: str, hits: Callable, drop_share: float, names: list[str]) -> pa.RecordBatch:
    k = batch.schema.get_field_index(text)
    changed, removed, cuts, drop = cleaned(batch.column(k), hits, drop_share)
    columns = list(batch.columns)
    columns[k] = _replaced(columns[k], changed)
    out = pa.record_batch([*columns, pa.array(removed), pa.array(cuts)], names)
    return out.filter(pa.array(~drop)) if drop.any() else out


def _joined(docs: DataFrame, grams: DataFrame, text: str, drop_share: float, schema: T.StructType) -> DataFrame:
    """The same for gram sets beyond a broadcast: window hashes of texts meet the grams in a join.

    A bit table of the grams, of bounded size, goes to all tasks. Texts none of whose windows it knows
    pass without a shuffle; of the others only the known windows are joined. The grams that a text holds
    come back to it by its digest and are cut by one scan. What was cut is joined again, as a cut may
    bring together a passage whose grams no text had before.
    """
    removed_col, spans_col = schema.names[-2:]
    d1, d2, found, again = fresh(docs.select("*", F.lit(0).alias(removed_col), F.lit(0).alias(spans_col)), "_d1", "_d2", "_found", "_again")
    sizes = [r[0] for r in grams.select("size").distinct().collect()]
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(grams.select("hash"), MAX_TABLE_BYTES))
    marked = T.StructType([*schema.fields, T.StructField(again, T.BooleanType())])

    def known(w: K.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, first word, row, hash) of the windows that may be grams."""
        token, table = w.hashes(), shared.value
        for size in sizes:
            h = K.gram_hashes(token, size)
            at = np.flatnonzero(table.has(h) & K.whole(w.ptr, size, len(token)))
            yield size, at, np.searchsorted(w.ptr, at, "right") - 1, h[at]

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text):
            some = np.zeros(batch.num_rows, bool)
            for _, _, row, _ in known(K.split_words(batch.column(text))):
                some[row] = True
            yield pa.record_batch([*batch.columns, pa.array(some)], marked.names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "t"):
            for size, _, row, h in known(K.split_words(batch.column("t"))):
                row = pa.array(row)
                yield pa.record_batch([batch.column("d1").take(row), batch.column("d2").take(row), pa.array(h.view(np.int64)), pa.array(np.full(len(h), size, np.int32))], ["d1", "d2", "hash", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text):
            # all grams of a row's text are among its own, so those of its neighbours find nothing more in it
            rows = [x for r in batch.column(found).to_pylist() for x in r or ()]
            own = Grams(np.array([x["hash"] for x in rows], np.int64).view(np.uint64), np.array([x["size"] for x in rows], np.int64), [x["words"] for x in rows])
            words, hit = scanned(batch.column(text), own.hits)
            columns = {name: batch.column(name) for name in names}
            columns[text] = _replaced(columns[text], {r: left for r, (_, _, left) in hit.items()})
            before = columns[removed_col].to_numpy()
            removed, cuts, changed = before.copy(), columns[spans_col].to_numpy().copy(), np.zeros(len(words), bool)
            for r, (gone, spans, _) in hit.items():
                removed[r] += gone
                cuts[r] += spans
                changed[r] = True
            columns |= {removed_col: pa.array(removed), spans_col: pa.array(cuts), again: pa.array(changed)}
            drop = changed & (removed >= drop_share * (words + before))
            yield pa.record_batch(list(columns.values()), list(columns)).filter(pa.array(~drop))

    todo = docs.withColumns({removed_col: F.lit(0), spans_col: F.lit(0)})
    done = []
    while True:
        flagged = todo.mapInArrow(flag, marked)
        done.append(flagged.where(~F.col(again)).select(*names))
        keyed = flagged.where(again).select(*names, F.xxhash64(text).alias(d1), F.xxhash64(F.lit(1), text).alias(d2))
        seen = keyed.select(F.col(d1).alias("d1"), F.col(d2).alias("d2"), F.col(text).cast("string").alias("t")).mapInArrow(windows, "d1 long, d2 long, hash long, size int").distinct()
        per_text = seen.join(grams.hint("shuffle_hash"), ["hash", "size"]).groupBy(F.col("d1").alias(d1), F.col("d2").alias(d2)).agg(F.collect_set(F.struct("hash", "size", "words")).alias(found))
        per_text = materialize(per_text)
        if per_text.isEmpty():
            done.append(keyed.select(*names))
            break
        cut_now = materialize(keyed.join(per_text, [d1, d2], "left").mapInArrow(run, marked))
        done.append(cut_now.where(~F.col(again)).select(*names))
        todo = cut_now.where(again).select(*names)
    return reduce(DataFrame.unionByName, done)
