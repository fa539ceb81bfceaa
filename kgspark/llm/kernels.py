"""Vectorised text kernels over Arrow buffers.

Text is case-folded without moving a single byte, then split into words: maximal
runs of ``0-9 a-z`` and of letters beyond Latin-1 punctuation. Every step is a
numpy pass over the UTF-8 buffer of a whole slice of rows, so cost per word is
some tens of nanoseconds and no Python object is made per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by one worker; bounds its temporary arrays.
SLICE_BYTES = 1 << 19
WORD_RE = re.compile("[0-9a-zÀ-῿぀-\U0010ffff]+")


def _lower_cases() -> tuple[dict[int, str], str]:
    """Arrow's lower case of each code point that has one of the same length in UTF-8, and the code
    points whose lower case is longer or shorter: those stay as they are. No letter beyond U+1FFFF has
    a case."""
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x20000))]
    pairs = [(c, x) for c, x in zip(chars, pc.utf8_lower(pa.array(chars)).to_pylist()) if c != x]
    same = {ord(c): x for c, x in pairs if len(c.encode()) == len(x.encode())}
    return same, "".join(c for c, _ in pairs if ord(c) not in same)


LOWER, ODD = _lower_cases()
ODD_RE = f"[{ODD}]"

_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
GRAM_INV = np.uint64(pow(int(GRAM), -1, 2**64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 11, 12, 13, 32]] = True
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def fold(text: str) -> str:
    """Lower case, character by character; no character changes its byte length."""
    return text.translate(LOWER)


def words(text: str | None) -> list[str]:
    """The words of one text: the definition that the vectorised path follows."""
    return WORD_RE.findall(fold(text or ""))


def fold_array(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    odd = pc.match_substring_regex(texts, ODD_RE)
    lowered = pc.utf8_lower(texts)
    if pc.any(odd).as_py():
        lowered = pa.array([fold(t.as_py()) if o.as_py() else x.as_py() for t, o, x in zip(texts, odd, lowered)], texts.type)
    return lowered


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets into them (int64, first is 0)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each holds about ``limit`` bytes (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        bin_no = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(bin_no)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; kept for sizes that recur."""
    key = (int(base), max(SLICE_BYTES * 2, 1 << (max(1, n) - 1).bit_length()))
    if key not in _POWERS:
        out = np.full(key[1], base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if key[1] > SLICE_BYTES * 2:
            return out[:n]
        _POWERS[key] = out
    return _POWERS[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    data: np.ndarray  #: folded bytes of all rows
    offsets: np.ndarray  #: row offsets into data
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    ptr: np.ndarray  #: row r has the words ptr[r]:ptr[r + 1]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every line of every row; the line feed belongs to none. Empty rows have none."""
    n = len(data)
    start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    start = start[start < n]
    if not n:
        return start, start
    end = np.append(start[1:], n)
    return start, end - (data[np.maximum(end - 1, 0)] == 10)


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without blanks (tab, VT, FF, CR, space) at either end; blank spans become empty."""
    seen = np.flatnonzero(~_IS_BLANK[data])
    lo, hi = np.searchsorted(seen, start), np.searchsorted(seen, end)
    some = hi > lo
    first, last = np.where(some, seen[np.minimum(lo, max(0, len(seen) - 1))] if len(seen) else start, start), start
    if len(seen):
        last = np.where(some, seen[np.maximum(hi - 1, 0)] + 1, start)
    return first, last


def split_blanks(texts: pa.Array) -> Words:
    """Runs of bytes between blanks and line feeds, as they stand."""
    data, offsets = buffers(pc.fill_null(texts, ""))
    return _runs(data, offsets, ~(_IS_BLANK[data] | (data == 10)))


def split_words(texts: pa.Array, folded: bool = False) -> Words:
    data, offsets = buffers(texts if folded else fold_array(texts))
    n = len(data)
    inside = _IS_WORD[data]
    if n and data.max() >= 0x80:
        two, three = np.flatnonzero(data == 0xC2), np.flatnonzero(data == 0xE2)
        cjk = np.flatnonzero(data == 0xE3)
        cjk = cjk[data[np.minimum(cjk + 1, n - 1)] == 0x80]
        for at, width in ((two, 2), (three, 3), (cjk, 3)):
            for k in range(width):
                inside[at + k] = False
    return _runs(data, offsets, inside)


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], whatever stands around them."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, n), out=total[1:])
    out = (total[end] - total[start]) * powers(BASE_INV, n)[start]
    return mix(out ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def gram_hashes(token: np.ndarray, size: int) -> np.ndarray:
    """Hash of token[i : i + size] for each i; rows are for the caller to keep apart."""
    n = len(token)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(token * powers(GRAM, n), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(GRAM_INV, n)[: n - size + 1])


def whole(ptr: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which windows of ``size`` tokens, by their first token, stay within one row."""
    last = np.repeat(ptr[1:], np.diff(ptr))[: max(0, n - size + 1)]
    return np.arange(len(last)) + size <= last


def row_hashes(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One order-sensitive hash for each row's words; rows without words have 0."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(GRAM, len(hashes)), out=total[1:])
    if not len(hashes):
        return np.zeros(len(ptr) - 1, np.uint64)
    first = np.minimum(ptr[:-1], len(hashes) - 1)
    out = mix((total[ptr[1:]] - total[ptr[:-1]]) * powers(GRAM_INV, len(hashes))[first])
    out[ptr[1:] == ptr[:-1]] = 0
    return out
