"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm import kernels as K
from kgspark.llm.common import fresh, sample_keys

#: Labelled documents of each language that its dictionary is made of, at most.
TRAIN_PER_LANGUAGE = 300
DICTIONARY_BYTES = 1 << 16
LEVEL = 6
#: Texts are encoded in pieces, each with a fresh dictionary, so that a long text's own words don't
#: take over from the dictionary.
PIECE_BYTES = 4096
#: The best language must be smaller than the next by this share of its size, else it is "und".
MIN_MARGIN = 0.01


class Model:
    """A raw-content dictionary for each language; compressors are made where they are used."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        self.contents = dict(sorted(contents.items()))
        self.languages = list(self.contents)
        self._coders: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": None}

    def coders(self) -> list:
        if self._coders is None:
            self._coders = []
            for content in self.contents.values():
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=LEVEL)
                self._coders.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._coders

    def sizes(self, folded: bytes) -> list[int]:
        """Bytes after compression for each language, over all pieces of the text."""
        pieces = [folded[i : i + PIECE_BYTES] for i in range(0, len(folded), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders()]

    def classify(self, folded: bytes) -> tuple[str, float]:
        """(language, margin); "und" if there is nothing to tell by or the margin is narrow."""
        if not folded or not self.languages:
            return "und", 0.0
        sizes = self.sizes(folded)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / best if len(sizes) > 1 else 1.0
        return (self.languages[order[0]] if margin >= MIN_MARGIN else "und"), margin


def make_dictionary(texts: list[str]) -> bytes:
    """Folded words for a dictionary: an equal share from the middle of each text, so that no text's
    own passages fill it, then the words of several texts, the most frequent last, where zstandard
    reaches them most cheaply."""
    counts = Counter(w for t in texts for w in set(K.words(t)))
    common, size = [], 0
    for word, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        size += len(word.encode()) + 1
        if n < 2 or size > DICTIONARY_BYTES // 4:
            break
        common.append(word)
    tail = " ".join(reversed(common)).encode()
    each = max(1, (DICTIONARY_BYTES - len(tail) - 1) // max(1, len(texts)))
    parts = []
    for t in texts:
        raw = " ".join(K.words(t)).encode()
        at = max(0, (len(raw) - each) // 2)
        parts.append(raw[at : at + each])
    return b" ".join(filter(None, [*parts, tail]))[-DICTIONARY_BYTES:]


def train(docs: DataFrame, *, per_language: int = TRAIN_PER_LANGUAGE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A dictionary for each language among the labels, from a bounded sample chosen by a hash of the key."""
    keys = docs.select(F.col(key).alias("_k"), F.col(lang).cast("string").alias("l")).where("_k is not null and l is not null and l <> '' and l <> 'und'")
    chosen = sample_keys(keys, "l", per_language)
    rows = docs.select(F.col(key).alias("_k"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where("t is not null").join(F.broadcast(chosen), ["_k", "l"])
    found = rows.groupBy("l", F.col("_k").alias("k")).agg(F.min("t").alias("t")).toPandas().sort_values(["l", "k", "t"], kind="stable")
    contents = {str(l): make_dictionary(g["t"].tolist()) for l, g in found.groupby("l")}
    return Model({l: c for l, c in contents.items() if c})


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs without ``text`` but with ``language`` and ``margin`` (share by which the best is smaller).

    Text is folded to its words, then encoded whole with every language's dictionary; the smallest
    wins, the first by name among equals, if the margin is not narrow.

    Null, empty and wordless texts, and an untrained model: "und", margin 0. With one language in the
    model the margin is 1. Each row is judged alone. Empty table: empty result. Names that clash get
    underscores.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    names = fresh(docs.drop(text), "language", "margin")
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text):
            got = [model.classify(t) for t in joined_words(batch.column(text))]
            new = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.record_batch([*(batch.column(f.name) for f in kept), *new], schema.names)

    return docs.mapInArrow(run, schema)


def joined_words(texts: pa.Array) -> list[bytes]:
    """Each row's folded words with one space between, as bytes."""
    w = K.split_words(texts)
    size = w.end - w.start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 32, np.uint8)
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] = 1
    np.subtract.at(inside, w.end, 1) if len(w.end) else None
    where = np.flatnonzero(np.cumsum(inside[:-1]))
    where_out = np.ones(at[-1], bool)
    where_out[at[1:] - 1] = False
    out[where_out] = w.data[where]
    raw = out.tobytes()
    edge = at[w.ptr]
    return [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def language_id(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(doc_id, language, margin) for every document."""
    return identify(docs.select(F.col(key), F.col(text)), train(docs, text=text, lang=lang, key=key), text=text)
