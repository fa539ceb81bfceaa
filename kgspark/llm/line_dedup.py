"""Line dedup: a sharded minimal perfect hash over distinct lines, with fingerprints and counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm import kernels as K
from kgspark.llm.common import bit_table, fresh, materialize

#: Lines that occur more often than this in the corpus go wherever they stand.
MAX_COUNT = 6
#: Keys of one shard, about; shards are built and probed independently.
SHARD_KEYS = 1 << 16
#: Arrays of up to so many bytes are broadcast; beyond, each shard's probes are sent to it.
MAX_BROADCAST_BYTES = 64 << 20
#: Bits that tell frequent lines from others before they are sent.
MAX_TABLE_BYTES = 64 << 20
GAMMA = 1.5
#: Parts that the probes of one shard are divided into when they are sent to it.
SALTS = 8

SHARDS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("bits", T.BinaryType()), T.StructField("marks", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (K.mix(keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)) % np.uint64(size)).astype(np.int64)


class Shard:
    """Minimal perfect hash by levels of bit arrays: a key takes the first level at which nobody else
    wants its bit; its number is the rank of that bit. Fingerprints tell other keys apart."""

    def __init__(self, sizes: list[int], bits: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> None:
        self.sizes, self.bits, self.marks, self.counts = list(sizes), bits, marks, counts
        self.bases = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        words = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
        words[: len(bits)] = bits
        self.words = words.view("<u8")
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Shard:
        """Over distinct 64-bit keys; counts above 255 are kept as 255."""
        rest, parts, sizes = keys, [], []
        while len(rest):
            size = max(64, int(len(rest) * GAMMA))
            at = _place(rest, len(sizes), size)
            wanted = np.bincount(at, minlength=size)
            parts.append(wanted == 1)
            sizes.append(size)
            rest = rest[wanted[at] != 1]
        bits = np.packbits(np.concatenate(parts), bitorder="little") if parts else np.zeros(0, np.uint8)
        out = cls(sizes, bits, np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint8))
        number = out.number(keys)
        out.marks[number] = (keys >> np.uint64(48)).astype(np.uint16)
        out.counts[number] = np.minimum(counts, 255)
        return out

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0 … n - 1 for the keys it was built from; for others any of these or -1."""
        out, live = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.bases[level] + _place(keys[live], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[live[hit]] = self.rank[word[hit]] + below
            live = live[~hit]
            if not len(live):
                break
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """How often each key occurs, at most 255; 0 for keys whose fingerprint is another's."""
        at = self.number(keys)
        known = at >= 0
        known[known] = self.marks[at[known]] == (keys[known] >> np.uint64(48)).astype(np.uint16)
        out = np.zeros(len(keys), np.uint8)
        out[known] = self.counts[at[known]]
        return out


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(n_shards)).astype(np.int64)


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets, line starts and ends, a key for each line without its outer blanks, and
    which lines are not blank."""
    data, off = K.buffers(pc.fill_null(texts, ""))
    start, end = K.line_spans(data, off)
    lo, hi = K.stripped(data, start, end)
    return data, off, start, end, K.span_hashes(data, lo, hi), hi > lo


def count_lines(docs: DataFrame, text: str) -> DataFrame:
    """(key, n) of each distinct line over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "t"):
            *_, keys, some = line_keys(batch.column("t"))
            key, n = np.unique(keys[some], return_counts=True)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row of compact arrays for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        keys, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
        shard = shard_of(keys, n_shards)
        for s in np.unique(shard).tolist():
            built = Shard.build(keys[shard == s], n[shard == s])
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([built.sizes], pa.list_(pa.int32())), pa.array([built.bits.tobytes()], pa.binary()), pa.array([built.marks.tobytes()], pa.binary()), pa.array([built.counts.tobytes()], pa.binary())], SHARDS.names)

    place = F.expr(f"key & 4294967295L").cast("long") % n_shards
    return counts.withColumn("shard", place.cast("int")).repartition("shard").select("key", "n").mapInArrow(run, SHARDS)


def load(row: dict) -> Shard:
    return Shard(row["sizes"], np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["marks"], np.uint16), np.frombuffer(row["counts"], np.uint8))


def without(texts: pa.Array, keys: tuple, drop: np.ndarray) -> tuple[dict[int, str], np.ndarray]:
    """New texts of rows that lose lines, and how many each loses."""
    data, off, start, end, _, _ = keys
    row = np.searchsorted(off, start, "right") - 1
    lost = np.bincount(row[drop], minlength=len(texts)).astype(np.int32)
    new: dict[int, str] = {}
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    for r in np.flatnonzero(lost).tolist():
        kept = [bytes(data[start[i] : end[i]]) for i in range(first[r], first[r + 1]) if not drop[i]]
        if off[r + 1] > off[r] and data[off[r + 1] - 1] == 10:
            kept.append(b"")
        new[r] = b"\n".join(kept).decode()
    return new, lost


def dedup_lines(docs: DataFrame, *, max_count: int = MAX_COUNT, shard_keys: int = SHARD_KEYS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, text: str = "text") -> DataFrame:
    """docs without lines that occur more than ``max_count`` times, plus ``removed_lines``.

    Lines end at line feeds and are compared without outer blanks (tab, CR, space …), as 64-bit keys.
    All distinct lines of all documents are in the hash, so a probe always finds its own count.
    Counts are occurrences, within a document as well; max_count is below 255.

    Blank lines are never counted and stay. Null text stays null, empty text empty; a text of which no
    line is left becomes empty (or its blank lines). Rows that repeat count again. Very long lines are
    lines. Empty table: empty result. Names that clash get underscores.
    """
    if not 0 < max_count < 255:
        raise ValueError("max_count is from 1 to 254")
    counts = materialize(count_lines(docs, text))
    n_lines = counts.count()
    n_shards = max(1, -(-n_lines // shard_keys))
    shards = materialize(build_shards(counts, n_shards))
    name = fresh(docs, "removed_lines")[0]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.IntegerType())])
    if 4 * n_lines <= max_broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in shards.collect()])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = {r["shard"]: load(r) for r in shared.value}
            for batch in K.slices(batches, text):
                got = line_keys(batch.column(text))
                yield _apply(batch, text, got, _too_many(got[4], arrays, n_shards, max_count) & got[5], schema.names)

        return docs.mapInArrow(probe, schema)
    return _routed(docs, counts, shards, n_shards, max_count, text, schema)


def _too_many(keys: np.ndarray, arrays: dict[int, Shard], n_shards: int, max_count: int) -> np.ndarray:
    shard, out = shard_of(keys, n_shards), np.zeros(len(keys), bool)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        if s in arrays:
            at = order[cuts[s] : cuts[s + 1]]
            out[at] = arrays[s].count(keys[at]) > max_count
    return out


def _apply(batch: pa.RecordBatch, text: str, keys: tuple, drop: np.ndarray, names: list[str]) -> pa.RecordBatch:
    k = batch.schema.get_field_index(text)
    new, lost = without(batch.column(k), keys, drop)
    columns = list(batch.columns)
    if new:
        values = columns[k].to_pylist()
        for r, value in new.items():
            values[r] = value
        columns[k] = pa.array(values, columns[k].type)
    return pa.record_batch([*columns, pa.array(lost)], names)


def _routed(docs: DataFrame, counts: DataFrame, shards: DataFrame, n_shards: int, max_count: int, text: str, schema: T.StructType) -> DataFrame:
    """The same when the arrays are too large to send everywhere: probes go to their shard.

    A bit table of the frequent keys, of bounded size, goes to all tasks. Documents none of whose lines
    it knows pass as they are, without a shuffle; of the others only the known lines are probed. A probe
    carries its document's digest (128 bits), and its shard answers with the lines that are too many.
    """
    d1, d2, bad, some = fresh(docs, "_d1", "_d2", "_bad", "_some")
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(counts.where(F.col("n") > max_count).select("key"), MAX_TABLE_BYTES))
    marked = T.StructType([*docs.schema.fields, T.StructField(some, T.BooleanType())])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text):
            _, off, start, _, keys, full = line_keys(batch.column(text))
            hit = full & shared.value.has(keys)
            seen = np.bincount(np.searchsorted(off, start[hit], "right") - 1, minlength=batch.num_rows) > 0
            yield pa.record_batch([*batch.columns, pa.array(seen)], marked.names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "t"):
            _, off, start, _, keys, full = line_keys(batch.column("t"))
            hit = full & shared.value.has(keys)
            row = pa.array(np.searchsorted(off, start[hit], "right") - 1)
            yield pa.record_batch([pa.array(shard_of(keys[hit], n_shards).astype(np.int32)), batch.column("d1").take(row), batch.column("d2").take(row), pa.array(keys[hit].view(np.int64))], ["shard", "d1", "d2", "key"])

    flagged = docs.mapInArrow(flag, marked)
    clean = flagged.where(~F.col(some)).drop(some).withColumn(schema.names[-1], F.lit(0))
    keyed = flagged.where(some).drop(some).withColumns({d1: F.xxhash64(text), d2: F.xxhash64(F.lit(1), text)})
    probes = keyed.select(F.col(d1).alias("d1"), F.col(d2).alias("d2"), F.col(text).cast("string").alias("t")).mapInArrow(emit, "shard int, d1 long, d2 long, key long").distinct()

    blob = [c for c in SHARDS.names if c != "shard"]
    empty = lambda kind: F.lit(None).cast(kind)
    asked = probes.withColumn("salt", F.pmod("d1", F.lit(SALTS)).cast("int")).select("shard", "salt", F.lit(1).alias("kind"), "d1", "d2", "key", *[empty(SHARDS[c].dataType).alias(c) for c in blob])
    held = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("shard", "salt", F.lit(0).alias("kind"), *[empty("long").alias(c) for c in ("d1", "d2", "key")], *blob)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict[int, Shard] = {}
        for batch in batches:
            kind, shard = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            cuts = [0, *np.flatnonzero(kind == 0).tolist(), len(kind)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi and kind[lo] == 0:
                    row = {c: batch.column(c)[lo].as_py() for c in SHARDS.names}
                    arrays, lo = {int(shard[lo]): load(row)}, lo + 1
                if lo < hi:
                    part = batch.slice(lo, hi - lo).select(["d1", "d2", "key"])
                    yield part.filter(pa.array(_too_many(part.column("key").to_numpy().view(np.uint64), arrays, n_shards, max_count)))

    # a shard comes before its probes; only one is held at a time, and a frequent line's probes are salted
    found = held.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(answer, "d1 long, d2 long, key long")
    per_text = found.groupBy(F.col("d1").alias(d1), F.col("d2").alias(d2)).agg(F.collect_set("key").alias(bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text):
            got = line_keys(batch.column(text))
            row = np.searchsorted(got[1], got[2], "right") - 1
            drop = np.zeros(len(row), bool)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for r, keys in enumerate(batch.column(bad).to_pylist()):
                if keys:
                    own = slice(first[r], first[r + 1])
                    drop[own] = np.isin(got[4][own], np.array(keys, np.int64).view(np.uint64))
            yield _apply(batch.select([f for f in batch.schema.names if f not in (d1, d2, bad)]), text, got, drop & got[5], schema.names)

    return clean.unionByName(keyed.join(per_text, [d1, d2], "left").mapInArrow(run, schema))
