"""Facets, BM25, dense and Jaccard search over documents (doc_id, type, text, facets, …)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.store import cut

K1, B, ALPHA = 1.5, 0.75, 0.6
FACET_FIELDS = ("type", "polarity", "predicate", "modality", "quantification", "dimension", "domain", "library", "concept_id", "m")


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def facet_filter(docs: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Documents of which every facet has the given value, as text; an unknown field matches none."""
    return docs.where(facet_condition(filters)) if filters else docs


def facet_condition(filters: dict[str, object]) -> Column:
    out = F.lit(True)
    for field, value in filters.items():
        out = out & F.lit(field in FACET_FIELDS) & (F.try_element_at("facets", F.lit(field)) == str(value))
    return out


def facet_counts(docs: DataFrame) -> DataFrame:
    """(field, value, n) over all documents."""
    pairs = docs.select(F.explode("facets").alias("field", "value")).where("value <> ''")
    return pairs.where(F.col("field").isin(*FACET_FIELDS)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def query_terms(session: SparkSession, query: str) -> list[str]:
    return [r[0] for r in session.range(1).select(F.explode(X.tokenize(F.lit(query))).alias("t")).collect()]


def _term_counts(tokens: Column, terms: list[str]) -> list[Column]:
    """Length and count of each distinct term of a document's tokens, made of the tokens once."""
    row = X.bind(tokens, lambda tk: F.struct(F.size(tk).alias("dl"), F.filter(tk, lambda t: t.isin(*terms)).alias("own")))
    fields = X.bind(row, lambda r: F.struct(r["dl"].alias("dl"), *[F.size(F.filter(r["own"], _equals(t))).alias(f"f{i}") for i, t in enumerate(terms)]))
    return [fields.alias("_c")]


def _scored(counted: DataFrame, terms: list[str], weights: dict[str, float] | None) -> DataFrame:
    """counted (…, dl, f0, f1, …) with ``raw``, NULL where no term stands; statistics are over all rows."""
    distinct = list(dict.fromkeys(terms))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    part = lambda i, t: (
        F.lit(terms.count(t) * float((weights or {}).get(t, 1.0)))
        * F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        * (F.col(f"f{i}") * (K1 + 1))
        / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    )
    total, hit = F.lit(0.0), F.lit(False)
    for i, t in enumerate(distinct):
        total = total + F.when(F.col(f"f{i}") > 0, part(i, t)).otherwise(0.0)
        hit = hit | (F.col(f"f{i}") > 0)
    return counted.crossJoin(F.broadcast(stats)).withColumn("raw", F.when(hit, total))


def bm25(docs: DataFrame, query: str, *, weights: dict[str, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, raw) of every document that has a query term; statistics are over all documents.

    The query's few terms are literals, so texts are read and split once into counts of the terms, which
    are written down: statistics and scores come from there. A term that the query repeats counts each
    time.
    """
    terms = query_terms(docs.sparkSession, query)
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return docs.select(key, F.lit(0.0).alias("raw")).limit(0)
    counted = cut(docs.select(key, *_term_counts(X.tokenize(F.col(text)), distinct)).select(key, "_c.*"))
    return _scored(counted, terms, weights).where("raw is not null").select(key, "raw")


def search(
    docs: DataFrame, query: str = "", *, filters: dict[str, object] | None = None, k: int = 10, alpha: float = ALPHA,
    dense: Callable[[Column], Column] | None = None, weights: dict[str, float] | None = None,
) -> DataFrame:
    """Facets first, then BM25 divided by the best candidate's, fused with a dense cosine if there is
    one; hits above 0 by score and doc_id, scores to six places. A query without a token finds every
    candidate with score 1.

    Texts are read once for the counts (and the cosine of candidates); the k hits then fetch what is shown.
    """
    own = facet_condition(filters or {})
    out = ("doc_id", "type", "canonical_urn", "domain", "library", "concept_id", F.substring("text", 1, 200).alias("snippet"))
    shown = [c for c in out if not isinstance(c, str) or c in docs.columns]
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.where(own).select(F.lit(1.0).alias("score"), *shown).orderBy("doc_id").limit(k)
    cosine = F.when(own, X.cosine(dense(F.col("text")), dense(F.lit(query)))) if dense else F.lit(None).cast("double")
    counted = cut(docs.select("doc_id", F.coalesce(own, F.lit(False)).alias("_own"), cosine.alias("_ds"), *_term_counts(X.tokenize(F.col("text")), list(dict.fromkeys(terms)))).select("doc_id", "_own", "_ds", "_c.*"))
    hits = _scored(counted, terms, weights).where("_own")
    best = hits.agg(F.max("raw").alias("best"))
    bm = F.coalesce(F.col("raw") / F.nullif(F.col("best"), F.lit(0.0)), F.lit(0.0))
    score = bm if dense is None else alpha * bm + (1 - alpha) * F.col("_ds")
    top = hits.crossJoin(F.broadcast(best)).select("doc_id", score.alias("_exact")).where("_exact > 0").orderBy(F.desc("_exact"), "doc_id").limit(k)
    found = docs.join(F.broadcast(top), "doc_id").where(own)
    return found.orderBy(F.desc("_exact"), "doc_id").limit(k).select(F.round("_exact", 6).alias("score"), *shown)


def doc_tokens(text: Column, facets: Column | None = None) -> Column:
    """The token set of a document: its text and its facets' values."""
    own = X.tokenize(text)
    if facets is not None:
        own = F.concat(own, F.flatten(F.transform(F.coalesce(F.map_values(facets), F.array()), X.tokenize)))
    return F.array_distinct(own)


def query_tokens(query: str | dict) -> Column:
    """Token set of a query: a text, or {summary, keywords, facets} of texts, lists and mappings."""

    def flat(value: object) -> list[str]:
        if isinstance(value, dict):
            return [x for v in value.values() for x in flat(v)]
        if isinstance(value, (list, tuple, set)):
            return [x for v in value for x in flat(v)]
        return [] if value in (None, "") else [str(value)]

    texts = [query] if isinstance(query, str) else flat(query.get("summary", "")) + flat(query.get("keywords")) + flat(query.get("facets"))
    return F.array_distinct(X.tokenize(F.lit(" ".join(texts))))


def search_similar(docs: DataFrame, query: str | dict, *, k: int = 10, filters: dict[str, object] | None = None) -> DataFrame:
    """Documents by the Jaccard similarity of token sets; ties by recency, then doc_id."""
    q = query_tokens(query)
    facets = F.col("facets") if "facets" in docs.columns else None
    recency = F.col("recency") if "recency" in docs.columns else F.lit(0.0)

    def similarity(own: Column) -> Column:
        shared = lambda d: F.size(F.array_intersect(q, d))
        return X.bind(own, lambda d: X.bind(shared(d), lambda n: F.when(n > 0, n / (F.size(q) + F.size(d) - n))))

    top = facet_filter(docs, filters or {}).select("doc_id", similarity(doc_tokens(F.col("text"), facets)).alias("score"), recency.alias("_r")).where("score > 0")
    top = top.orderBy(F.desc("score"), F.desc("_r"), "doc_id").limit(k)
    found = docs.join(F.broadcast(top), "doc_id").orderBy(F.desc("score"), F.desc("_r"), "doc_id").limit(k)
    return found.select(*docs.columns, F.round("score", 6).alias("score"))


def set_join(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, k: int) -> DataFrame:
    """Top k of right for every row of left by Jaccard, by joining on shared tokens: (left, right, sim).

    Both sides are (key, tokens) with distinct tokens. Only pairs that share a token exist; sizes come
    along, so no set is built again.
    """
    a = left.select(F.col(left_key).alias("l"), F.size("tokens").alias("nl"), F.explode("tokens").alias("t"))
    b = right.select(F.col(right_key).alias("r"), F.size("tokens").alias("nr"), F.explode("tokens").alias("t"))
    pairs = a.join(b, "t").groupBy("l", "r", "nl", "nr").agg(F.count(F.lit(1)).alias("both"))
    sim = F.col("both") / (F.col("nl") + F.col("nr") - F.col("both"))
    best = W.partitionBy("l").orderBy(F.desc("sim"), "r")
    return pairs.select("l", "r", sim.alias("sim")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def update(index: DataFrame, docs: DataFrame, remove_ids: DataFrame) -> DataFrame:
    """The index without what is removed or replaced, and with the new rows (of equal ids the last
    one that arrives, by ``ord`` if there is one)."""
    order = [F.desc("ord")] if "ord" in docs.columns else [F.desc(F.md5(F.to_json(F.struct(*docs.columns))))]
    new = docs.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where("_n = 1").drop("_n", "ord")
    kept = index.join(remove_ids.select("doc_id"), "doc_id", "left_anti").join(new.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(new.select(*index.columns))


def update_counts(index: DataFrame, docs: DataFrame, remove_ids: DataFrame) -> DataFrame:
    """(added, replaced, removed, total) of an update."""
    gone = index.select("doc_id").join(remove_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    left = index.select("doc_id").join(gone, "doc_id", "left_anti")
    marks = left.withColumn("old", F.lit(1)).join(docs.select("doc_id").distinct().withColumn("new", F.lit(1)), "doc_id", "full")
    counts = marks.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("replaced"), F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(gone.agg(F.count(F.lit(1)).alias("removed"))).select("added", "replaced", "removed", "total")


def docs_from_kg(claims: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Search documents: one for each claim, one for each concept of a source."""
    f = lambda *names: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[X.text(n) for n in names]))
    from_claims = claims.select(
        F.concat(F.lit("claim:"), "item_id").alias("doc_id"), F.lit("claim").alias("type"), "text",
        F.map_concat(F.create_map(F.lit("type"), F.lit("claim")), f("polarity", "predicate", "modality", "quantification", "dimension", "domain", "library")).alias("facets"),
        "canonical_urn", "domain", "library", F.lit("").alias("concept_id"), F.lit(0.0).alias("recency"),
    )
    if concepts is None:
        return from_claims
    return from_claims.unionByName(
        concepts.select(
            F.concat_ws(":", F.lit("concept"), "canonical_urn", "concept_id").alias("doc_id"), F.lit("concept").alias("type"), F.col("label").alias("text"),
            F.create_map(F.lit("type"), F.lit("concept"), F.lit("concept_id"), F.col("concept_id")).alias("facets"),
            "canonical_urn", "domain", "library", "concept_id", F.lit(0.0).alias("recency"),
        )
    )


#: The largest block of vectors, and how many of it ask at a time.
BLOCK_ROWS, AT_ONCE = 16384, 256


def nearest_vectors(vectors: DataFrame, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors nearest to every vector by cosine, itself included.

    Exact: every block of rows meets every block, each pair in one task that keeps k for each query, some
    queries at a time. Each row travels to as many tasks as there are blocks, so blocks grow with the rows,
    from ``block_rows`` to BLOCK_ROWS.
    A zero vector's norm counts as 1. Scores equal in 12 digits are ties; they fall to the least key.
    Null keys and vectors take no part; keys are unique and vectors of one length.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    n = rows.count()
    blocks = max(1, -(-n // min(max(block_rows, BLOCK_ROWS), max(block_rows, n // 8))))
    placed = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def unit(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_numpy()).astype(float)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norm == 0, 1.0, norm)

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, whole, asked, parts = c["id"].to_numpy(), unit(c["v"]).T, q["id"].to_numpy(), []
        top = min(k, len(c))
        for lo in range(0, len(q), AT_ONCE):
            score = np.round(unit(q["v"].iloc[lo : lo + AT_ONCE]) @ whole, 12)
            least = np.partition(score, -top, axis=1)[:, -top]
            row, col = np.nonzero(score >= least[:, None])
            got = score[row, col]
            order = np.lexsort((ids[col], -got, row))
            row, col, got = row[order], col[order], got[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            parts.append(pd.DataFrame({"query_id": asked[lo + row[keep]], "vec_id": ids[col[keep]], "score": got[keep]}))
        return pd.concat(parts)

    asked = placed.select("id", "v", F.col("own").alias("a"), F.col("other").alias("b")).groupBy("a", "b")
    held = placed.select("id", "v", F.col("other").alias("a"), F.col("own").alias("b")).groupBy("a", "b")
    found = asked.cogroup(held).applyInPandas(pair, "query_id long, vec_id long, score double")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
