"""HTML extraction: the contiguous region whose words outweigh its tags most."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm import kernels as K
from kgspark.llm.common import fresh, materialize, sample_keys

#: Pages that the weights are fitted on, at most.
TRAIN_PAGES = 1000
#: Markup by which an author marks a page's content: pages that have it are the labelled ones.
LABEL_TAGS = ("article", "main")
#: Least amounts: every word scores this or more, every tag its negative or less.
LEAST = 0.01
#: Words of one text come together, so their odds count for less: the share is the one of these that
#: finds the labelled regions best.
WORD_SHARES = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02)
#: Weights where no page is labelled.
DEFAULT = {"": 0.1, "p": -LEAST, "br": -LEAST, "b": -LEAST, "i": -LEAST, "em": -LEAST, "strong": -LEAST, "h1": -LEAST, "h2": -LEAST, "h3": -LEAST, "?": -3.0}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^<>]*>(?:.*?</\1\s*>|.*\Z)|<[/!?]?([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>?", re.S | re.I)
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul".split())
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def tags(page: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of all that isn't text: tags by their name in lower case, whole scripts and
    styles by theirs, comments as "!"."""
    return [(m.start(), m.end(), (m[1] or m[2] or "!").lower()) for m in _TOKEN.finditer(page)]


def word_counts(page: str, found: list[tuple[int, int, str]]) -> np.ndarray:
    """Words in the text before each tag, and after the last."""
    at = [0, *(e for _, e, _ in found)], [*(s for s, _, _ in found), len(page)]
    return np.array([len(page[a:b].split()) for a, b in zip(*at)], np.int64)


def fit(pages: list[str]) -> dict[str, float]:
    """Log-odds of a word (key "") and of each tag in content against outside, kept to their sign."""
    inside, outside = Counter(), Counter()
    for page in pages:
        found = tags(page)
        n = word_counts(page, found)
        depth = 0
        for k, (s, _, name) in enumerate(found):
            (inside if depth else outside)[""] += int(n[k])
            if name in LABEL_TAGS:
                depth = max(0, depth + (-1 if page[s + 1 : s + 2] == "/" else 1))
            else:
                (inside if depth else outside)[name] += 1
        (inside if depth else outside)[""] += int(n[-1])
    if not inside[""] or not outside:
        return dict(DEFAULT)
    names = {*inside, *outside}
    n_in, n_out = sum(inside.values()) + len(names), sum(outside.values()) + len(names)
    odds = {t: float(np.log((inside[t] + 1) / n_in) - np.log((outside[t] + 1) / n_out)) for t in names}
    weights = {t: min(-LEAST, w) for t, w in odds.items() if t}
    weights |= {"?": float(np.mean([*weights.values()] or [-1.0]))} | dict.fromkeys(LABEL_TAGS, -LEAST)
    tries = [weights | {"": max(LEAST, odds[""] * share)} for share in WORD_SHARES]
    return max(tries, key=lambda w: sum(overlap(page, w) for page in pages))


def overlap(page: str, weights: dict[str, float]) -> float:
    """Characters of the labelled region and the found one in common, as a share of those in either."""
    found = tags(page)
    own = [(s, e) for s, e, name in found if name in LABEL_TAGS]
    if not own:
        return 0.0
    a, b = own[0][1], own[-1][0] if len(own) > 1 else len(page)
    _, lo, hi, _ = extract(page, weights)
    return max(0, min(b, hi) - max(a, lo)) / max(1, max(b, hi) - min(a, lo))


def best_region(scores: np.ndarray) -> tuple[int, int, float]:
    """The contiguous run with the greatest sum as (first, after, sum), by one scan; (0, 0, 0.0) if
    none is positive. Of equal sums the one that ends first, then the longest."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return 0, 0, 0.0
    return int(np.argmax(total[: end + 1] == low[end])), end, float(gain[end])


def extract(page: str | None, weights: dict[str, float]) -> tuple[str, int, int, float]:
    """(text, start, end, score): the best region's text and where it stands in the page."""
    if not page:
        return "", 0, 0, 0.0
    found = tags(page)
    n = word_counts(page, found)
    other = weights["?"]
    scores = np.empty(2 * len(found) + 1)
    scores[::2] = n * weights[""]
    scores[1::2] = [weights.get(name, other) for _, _, name in found]
    lo, hi, score = best_region(scores)
    if not score:
        return "", 0, 0, 0.0
    edges = [0, *(x for s, e, _ in found for x in (s, e)), len(page)]
    parts = []
    for k in range(lo, hi):
        if k % 2:
            parts.append("\n" if found[k // 2][2] in _BLOCK else "")
        else:
            parts.append(page[edges[k] : edges[k + 1]].replace("\n", " "))
    text = _LINES.sub("\n", _SPACE.sub(" ", entities.unescape("".join(parts)))).strip()
    return text, edges[lo], edges[hi], score


def train(pages: DataFrame, *, limit: int = TRAIN_PAGES, html: str = "html", key: str = "page_id") -> dict[str, float]:
    """Weights from at most ``limit`` labelled pages, chosen by a hash of the key. Keys of labelled
    pages are written down first; only the chosen pages are sent to the driver, one for each key (the
    least of those that repeat it)."""
    marked = F.lower(F.col(html)).rlike("<(" + "|".join(LABEL_TAGS) + ")[\\s>]")
    keys = materialize(pages.where(marked).select(F.col(key).alias("_k"), F.lit(1).alias("g")).where("_k is not null"))
    chosen = sample_keys(keys, "g", limit).select("_k")
    rows = pages.select(F.col(key).alias("_k"), F.col(html).alias("h")).join(F.broadcast(chosen), "_k").groupBy("_k").agg(F.min("h").alias("h")).collect()
    return fit([h for _, h in sorted((r["_k"], r["h"]) for r in rows if r["h"])])


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """pages without ``html`` but with ``text``, ``start``, ``end`` and ``score`` of the content region.

    Words score positive, tags negative; a linear scan finds the best region. Scripts, styles and
    comments are one tag each; block tags end a line of the text; entities are decoded afterwards.

    Null, empty and tag-only pages: empty text at 0-0, score 0. A page without tags is content as a
    whole. Broken tags are text. Every row gives one row, each judged alone: repeated rows agree, any
    length is scanned as a whole. Without labelled pages, default weights hold. Empty table: empty
    result. New names that clash get underscores.
    """
    model = train(pages, html=html, key=key) if weights is None else weights
    kept = [f for f in pages.schema.fields if f.name != html]
    names = fresh(pages.drop(html), "text", "start", "end", "score")
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.IntegerType(), T.IntegerType(), T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, html):
            got = [extract(p, model) for p in batch.column(html).to_pylist()]
            text, start, end, score = zip(*got)
            new = [pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())]
            yield pa.record_batch([*(batch.column(f.name) for f in kept), *new], schema.names)

    return pages.mapInArrow(run, schema)
