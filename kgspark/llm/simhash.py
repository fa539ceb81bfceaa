"""SimHash near-duplicates by a self-join over binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm import kernels as K
from kgspark.llm.common import discard, fresh, materialize

#: Errors allowed among the 64 bits of the trie.
BUDGET = 10
#: Errors allowed among 64 bits that sketch the pairs of neighbouring words, checked where tries meet.
BUDGET_PAIRS = 16
#: The shorter of two near-duplicates has so much of the other's words at least.
MIN_LENGTH_RATIO = 0.75
#: Texts of fewer words say too little for a sketch; they match exact copies only.
MIN_WORDS = 12
#: Two of 12 blocks agree in any pair within 10 errors, so each pair meets in a trie of two blocks.
N_BLOCKS = 12
SPREAD = 3
#: Node pairs of at most so many leaf pairs are compared at once; those of more than a row's worth as a block.
LEAF = 1 << 14
BLOCK_PAIRS = 1 << 10


def _blocks() -> list[tuple[int, int]]:
    cuts = np.linspace(0, 64, N_BLOCKS + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


BLOCKS = _blocks()
COMBOS = list(combinations(range(N_BLOCKS), 2))


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit SimHashes for each row, of its words and of its word pairs, and its number of words.

    Words are weighted by the square of their bytes beyond three, so that the function words which all
    texts share hardly count; the longest count like 13 bytes. Pairs of neighbours weigh the same.
    """
    w = K.split_words(texts)
    token, n_words = w.hashes(), np.diff(w.ptr)
    sig = K.row_hashes(token, w.ptr)
    more = K.mix(sig ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    long = n_words >= MIN_WORDS
    weight = np.clip(w.end - w.start - SPREAD, 0, 10).astype(np.int16) ** 2
    use = np.flatnonzero((weight > 0) & np.repeat(long, n_words))
    _simhash(sig, w.rows()[use], token[use], weight[use])
    pairs = K.gram_hashes(token, 2)
    use = np.flatnonzero(K.whole(w.ptr, 2, len(token)) & np.repeat(long, n_words)[: len(pairs)])
    _simhash(more, w.rows()[use], pairs[use], None)
    return sig, more, n_words


def _simhash(out: np.ndarray, row: np.ndarray, token: np.ndarray, weight: np.ndarray | None) -> None:
    """Write the sign of each bit's weighted sum to out[row]; tokens come by row."""
    head = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(head[1:], len(row))
    rounds = np.cumsum(ends - head) // 8192
    cuts = np.flatnonzero(np.diff(rounds, prepend=-1, append=rounds[-1] + 1 if len(rounds) else -1))
    for lo, hi in zip(cuts, cuts[1:]):
        a, b, at = head[lo], ends[hi - 1], head[lo:hi] - head[lo]
        bits = np.unpackbits(token[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        if weight is None:
            ones, total = np.add.reduceat(bits, at, axis=0, dtype=np.int32), (ends - head)[lo:hi]
        else:
            v = weight[a:b].astype(np.int32)
            ones, total = np.add.reduceat(bits * v[:, None], at, axis=0), np.add.reduceat(v, at)
        out[row[head[lo:hi]]] = np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel()


def length_classes(words: np.ndarray) -> np.ndarray:
    """A class for each number of words, such that numbers within MIN_LENGTH_RATIO are in one class or in neighbouring ones."""
    cuts = [1]
    while len(words) and cuts[-1] <= words.max():
        cuts.append(int(cuts[-1] / MIN_LENGTH_RATIO) + 1)
    return np.searchsorted(cuts, words, "right")


def trie_pairs(keys: np.ndarray, group: np.ndarray, budget: int, kind: np.ndarray | None = None, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one group whose keys differ in at most ``budget`` bits; with ``kind``, only those
    whose kinds differ by 1 at most.

    Groups follow each other, so do the kinds in a group, and the keys of a kind are sorted: a node of
    its binary trie is a range of keys. All tries are walked together, level by level, as pairs of nodes
    with the bits in which they differ so far; a pair goes once it has more errors than the budget.
    """
    n = len(keys)
    kind = np.zeros(n, np.int64) if kind is None else kind
    head = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)) if n else np.zeros(0, np.int64)
    tail = np.append(head[1:], n) if n else head
    by = np.flatnonzero((np.diff(group[head]) == 0) & (np.diff(kind[head]) == 1))
    a0, a1, b0, b1 = (np.concatenate(x) for x in ((head, head[by]), (tail, tail[by]), (head, head[by + 1]), (tail, tail[by + 1])))
    err = np.zeros(len(a0), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(65):
        small = (a1 - a0) * (b1 - b0) <= leaf if level < 64 else np.ones(len(a0), bool)
        if small.any():
            found += _leaves(keys, *(x[small] for x in (a0, a1, b0, b1)), budget)
        rest = ~small
        if not rest.any():
            break
        a0, a1, b0, b1, err = (x[rest] for x in (a0, a1, b0, b1, err))
        ones = np.zeros(n + 1, np.int64)
        np.cumsum((keys >> np.uint64(63 - level)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        nxt = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + 1),
            tuple(x[~same] for x in (am, a1, b0, bm, err + 1)),
        ]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*nxt))
        live = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, err = (x[live] for x in (a0, a1, b0, b1, err))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _leaves(keys: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    large = (a1 - a0) * (b1 - b0) > BLOCK_PAIRS
    for lo, hi, first, after in zip(*(x[large].tolist() for x in (a0, a1, b0, b1))):
        wide = after - first
        step = max(1, (1 << 18) // wide)
        for at in range(lo, hi, step):
            near = np.bitwise_count(keys[at : min(hi, at + step), None] ^ keys[first:after]) <= budget
            k = np.flatnonzero(near)
            i, j = at + k // wide, first + k % wide
            out.append((i[i < j], j[i < j]) if lo == first else (i, j))
    a0, a1, b0, b1 = (x[~large] for x in (a0, a1, b0, b1))
    # each key of the left node with a range of keys of the right one
    size = a1 - a0
    row = np.arange(size.sum()) + np.repeat(a0 - np.cumsum(size) + size, size)
    last = np.repeat(b1, size)
    first = np.where(np.repeat(a0 == b0, size), row + 1, np.repeat(b0, size))
    wide = last - first
    total = np.cumsum(wide)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, 1 << 20)), len(row)))
    for lo, hi in zip([0, *cuts], cuts):
        if hi <= lo:
            continue
        w = wide[lo:hi]
        j = np.arange(w.sum()) + np.repeat(first[lo:hi] - np.cumsum(w) + w, w)
        k = np.flatnonzero(np.bitwise_count(np.repeat(keys[row[lo:hi]], w) ^ keys[j]) <= budget)
        out.append((np.repeat(row[lo:hi], w)[k], j[k]))
    return out


def alike(more_i: np.ndarray, more_j: np.ndarray, words_i: np.ndarray, words_j: np.ndarray, budget_pairs: int) -> np.ndarray:
    """What a pair that met in a trie must hold besides: near pair sketches, lengths of a kind."""
    near = np.bitwise_count(more_i ^ more_j) <= budget_pairs
    return near & (np.minimum(words_i, words_j) >= MIN_LENGTH_RATIO * np.maximum(words_i, words_j))


def star(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the graph: what is to be known of it, in fewer edges."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def sketch_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, sig, more, words) of each row that has a key and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            sig, more, n = sketches(batch.column("text"))
            new = [sig.view(np.int64), more.view(np.int64), n.astype(np.int32)]
            out = pa.record_batch([batch.column("id"), *map(pa.array, new)], ["id", "sig", "more", "words"])
            yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    numbers = (("sig", T.LongType()), ("more", T.LongType()), ("words", T.IntegerType()))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, k) for n, k in numbers)]))


def near_edges(distinct: DataFrame, budget: int = BUDGET, budget_pairs: int = BUDGET_PAIRS) -> DataFrame:
    """Edges that join the sketches (id, sig, more, words) within both budgets; enough to connect each group.

    Each sketch goes to the trie of each two of its 12 blocks, keyed by their bits: any pair within
    the budget of 10 agrees in two blocks at least, so no pair is missed. (A budget of 11 or more
    would need fewer blocks and is refused.) In a trie, sketches meet those of their own or a
    neighbouring class of length only.
    """
    if budget > N_BLOCKS - 2:
        raise ValueError("pairs within this budget need not share two blocks")
    shift = [(64 - hi, hi - lo) for lo, hi in BLOCKS]
    part = [F.shiftrightunsigned("sig", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in shift]
    keys = F.array(*[(F.lit(c).cast("long") * 4096 + part[i] * 64 + part[j]).cast("int") for c, (i, j) in enumerate(COMBOS)])
    keyed = distinct.select(F.explode(keys).alias("trie"), "id", "sig", "more", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ident = pa.concat_arrays(t.column("id").chunks)
        trie, sig, more, words = (t.column(c).to_numpy() for c in ("trie", "sig", "more", "words"))
        sig, more = sig.view(np.uint64), more.view(np.uint64)
        kind = length_classes(words)
        order = np.lexsort((sig, kind, trie))
        trie, kind, sig, more, words = (x[order] for x in (trie, kind, sig, more, words))
        at = np.flatnonzero(np.diff(trie, prepend=-1))
        ends = np.append(at[1:], len(trie))
        rounds = np.cumsum(ends - at) // 200_000
        for r in np.unique(rounds):
            lo, hi = at[rounds == r][0], ends[rounds == r][-1]
            i, j = trie_pairs(sig[lo:hi], trie[lo:hi], budget, kind[lo:hi])
            near = alike(more[lo:hi][i], more[lo:hi][j], words[lo:hi][i], words[lo:hi][j], budget_pairs)
            i, j = i[near], j[near]
            if len(i):
                a, b = star(hi - lo, i, j)
                yield pa.record_batch([ident.take(pa.array(order[lo:hi][x])) for x in (a, b)], ["src", "dst"])

    kind = distinct.schema["id"].dataType
    return keyed.repartition("trie").mapInArrow(run, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])).where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): each node with the least node of its component, by alternating stars.

    Every round hooks neighbours to the least of them and halves paths; it ends when no edge changes,
    after a number of rounds that grows with the logarithm of the longest chain.
    """
    now = materialize(edges.select(F.greatest("src", "dst").alias("id"), F.least("src", "dst").alias("root")).where("id <> root").distinct())
    while True:
        both = now.unionByName(now.select(F.col("root").alias("id"), F.col("id").alias("root")))
        least = both.groupBy("id").agg(F.min("root").alias("low"), F.collect_set("root").alias("all"))
        large = least.select(F.explode("all").alias("id"), F.least("low", "id").alias("root"), F.col("id").alias("own")).where("id > own").select("id", "root")
        small = large.where("id <> root").groupBy("id").agg(F.min("root").alias("low"), F.collect_set("root").alias("all"))
        linked = small.select(F.explode(F.array_union("all", F.array("id"))).alias("id"), F.col("low").alias("root")).where("id <> root").distinct()
        after = materialize(linked)
        same = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        discard(now)
        if same:
            return after
        now = after


def duplicates(docs: DataFrame, *, budget: int = BUDGET, budget_pairs: int = BUDGET_PAIRS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, duplicate_of, group_size): each document that copies another, with the one that stays.

    Documents are linked if their word sketches differ in ``budget`` bits at most, their pair sketches
    in ``budget_pairs`` and their lengths by a quarter; groups are the connected components, and the
    least id of a group stays. Equal sketches are joined to their least
    id at once, so thousands of copies cost as many edges, not their square.

    Keys are of any type that has an order. Null keys, and null or wordless texts, are nobody's copies. Texts of under 12 words match texts of
    the same words only. Rows that repeat a key are one document; whoever filters by the result has to
    collapse them (``deduplicate`` does). Empty table: empty result. Other columns aren't read.
    """
    rows = materialize(sketch_table(docs, text, key))
    heads = rows.groupBy("sig", "more", "words").agg(F.min("id").alias("head"))
    heads = materialize(heads)
    edges = near_edges(heads.select(F.col("head").alias("id"), "sig", "more", "words"), budget, budget_pairs)
    roots = components(edges)
    member = (
        rows.join(heads, ["sig", "more", "words"])
        .join(roots.withColumnRenamed("id", "head"), "head", "left")
        .groupBy("id").agg(F.min(F.coalesce("root", "head")).alias("root"))
    )
    sized = member.groupBy("root").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    found = member.join(sized, "root").where("id <> root")
    return found.select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"), F.col("group_size").cast("long"))


def deduplicate(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near-duplicates, columns unchanged.

    Copies go by an anti-join on their ids. Keys that stand in several rows keep one row each (the
    least by its columns' digest); only those rows are grouped. Null keys stay.
    """
    mark, digest, out = fresh(docs, "_repeated", "_digest", "_gone")
    gone = duplicates(docs, text=text, key=key).select(F.col("doc_id").alias(out))
    twice = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(mark)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(mark)
    kept = docs.join(gone, F.col(key) == F.col(out), "left_anti")
    many = materialize(twice)
    if many.isEmpty():
        return kept
    single = kept.join(many, F.col(key) == F.col(mark), "left_anti")
    order = F.sha2(F.to_json(F.struct(*[F.col(c) for c in docs.columns])), 256)
    again = kept.join(many, F.col(key) == F.col(mark), "left_semi").withColumn(digest, F.row_number().over(W.partitionBy(key).orderBy(order)))
    return single.unionByName(again.where(F.col(digest) == 1).drop(digest))
