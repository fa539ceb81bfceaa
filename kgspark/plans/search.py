"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.operators import retrieve as R
from kgspark.plans.base import documents, table, tokens_sql, urn_docs

QUERY = "license apache the the"
WEIGHTS = {"the": 0.25, "version": 2.0}


def _docs(spark, sf):  # noqa: ANN001
    return urn_docs(documents(spark, sf))


def _score(df):  # noqa: ANN001
    return df.select("doc_id", "score", "snippet")


def bm25_topk(spark, sf):  # noqa: ANN001
    """Top 10 documents by BM25; a repeated query term counts twice."""
    return _score(R.search(_docs(spark, sf), QUERY))


def bm25_weighted(spark, sf):  # noqa: ANN001
    return _score(R.search(_docs(spark, sf), "version the license", weights=WEIGHTS))


def bm25_facet_filter(spark, sf):  # noqa: ANN001
    """Facets narrow the candidates, not the statistics."""
    return _score(R.search(_docs(spark, sf), "licence license apache mit", filters={"domain": "fr"}))


def facet_browse(spark, sf):  # noqa: ANN001
    return R.search(_docs(spark, sf), filters={"domain": "de", "library": "src3"}).select("doc_id", "score", "snippet")


def facet_counts(spark, sf):  # noqa: ANN001
    return R.facet_counts(_docs(spark, sf))


def jaccard_topk(spark, sf):  # noqa: ANN001
    return R.search_similar(_docs(spark, sf), {"summary": "the license of the apache version", "keywords": ["mit", "was"]}).select("doc_id", "score")


def jaccard_facet(spark, sf):  # noqa: ANN001
    return R.search_similar(_docs(spark, sf), "der die das nicht und", filters={"domain": "de"}).select("doc_id", "score")


def jaccard_set_join(spark, sf):  # noqa: ANN001
    """The three nearest benchmark items of every conversation turn, by shared tokens."""
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.array_distinct(X.tokenize(F.col("text"))).alias("tokens"))
    items = table(spark, sf, "benchmark").select("item_id", F.array_distinct(X.tokenize(F.col("text"))).alias("tokens"))
    return R.set_join(turns, items, left_key="id", right_key="item_id", k=3).select("l", "r", F.round("sim", 9).alias("sim"), "rank")


def hybrid_fusion_hashing(spark, sf):  # noqa: ANN001
    return _score(R.search(_docs(spark, sf), "license apache", dense=X.hashing_embedding))


def dense_cosine_topk(spark, sf):  # noqa: ANN001
    """The ten vectors nearest to the first one."""
    e = table(spark, sf, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = e.crossJoin(F.broadcast(probe)).select("vec_id", X.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return near.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 9).alias("score"))


def dense_cosine_topk_all(spark, sf):  # noqa: ANN001
    """The ten vectors nearest to every vector; dense_cosine_topk, as its SQL, asks for the first one only."""
    return R.nearest_vectors(table(spark, sf, "embeddings")).select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


def index_update_counts(spark, sf):  # noqa: ANN001
    """Documents of two sources are removed, two come again and one is new."""
    d = _docs(spark, sf)
    new = d.where("library in ('src1', 'src2')").select("doc_id").unionByName(d.limit(1).select(F.lit(-1).cast("long").alias("doc_id")))
    return R.update_counts(d, new, d.where("library in ('src2', 'src5')").select("doc_id"))


def index_update(spark, sf):  # noqa: ANN001
    d = _docs(spark, sf)
    new = d.where("library = 'src1'").withColumn("text", F.concat(F.lit("new "), "text"))
    return R.update(d, new, d.where("library = 'src5'").select("doc_id")).select("doc_id", F.md5("text").alias("digest"))


QUERIES = (bm25_topk, bm25_weighted, bm25_facet_filter, facet_browse, facet_counts, jaccard_topk, jaccard_facet, jaccard_set_join, hybrid_fusion_hashing, dense_cosine_topk, dense_cosine_topk_all, index_update_counts, index_update)


def _bm25_sql(terms: list[str], where: str = "true", weights: dict | None = None, dense: str = "") -> str:
    distinct = list(dict.fromkeys(terms))
    f = ", ".join(f"len(list_filter(tk, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(distinct))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS df{i}" for i in range(len(distinct)))
    part = " + ".join(
        f"CASE WHEN f{i} > 0 THEN {terms.count(t) * float((weights or {}).get(t, 1.0))} * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (f{i} * 2.5) / (f{i} + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0.0 END"
        for i, t in enumerate(distinct)
    )
    hit = " OR ".join(f"f{i} > 0" for i in range(len(distinct)))
    final = "raw / nullif(best, 0)" if not dense else f"0.6 * coalesce(raw / nullif(best, 0), 0) + 0.4 * ({dense})"
    return f"""
WITH tok AS (SELECT *, {tokens_sql("text")} AS tk FROM documents), counted AS (SELECT *, len(tk)::DOUBLE AS dl, {f} FROM tok),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM counted),
scored AS (SELECT doc_id, text, lang, source, tk, CASE WHEN {hit} THEN {part} END AS raw FROM counted, stats),
cand AS (SELECT *, max(raw) OVER () AS best FROM scored WHERE {where}),
final AS (SELECT doc_id, {final} AS s, text FROM cand)
SELECT doc_id, round(s, 6) AS score, substr(text, 1, 200) AS snippet FROM final WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 10"""


_SLOT = "('0x' || substr(sha1(t), 39, 2))::INTEGER % 64"
_DENSE = f"""(SELECT coalesce(sum(a.c * b.c), 0) FROM (SELECT {_SLOT} AS k, count(*) AS c FROM (SELECT unnest(tk) AS t) GROUP BY 1) a JOIN (SELECT {_SLOT} AS k, count(*) AS c FROM (VALUES ('license'), ('apache')) v(t) GROUP BY 1) b USING (k))
 / (coalesce(nullif((SELECT sqrt(sum(c * c)) FROM (SELECT count(*) AS c FROM (SELECT {_SLOT} AS k FROM (SELECT unnest(tk) AS t)) GROUP BY k)), 0), 1) * (SELECT sqrt(sum(c * c)) FROM (SELECT count(*) AS c FROM (VALUES ('license'), ('apache')) v(t) GROUP BY {_SLOT})))"""


def _jaccard_sql(tokens: list[str], where: str = "true") -> str:
    q = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    return f"""
WITH d AS (SELECT doc_id, list_distinct(list_concat({tokens_sql("text")}, list_concat(['claim'], list_concat({tokens_sql("lang")}, {tokens_sql("source")})))) AS t FROM documents WHERE {where}),
s AS (SELECT doc_id, len(list_intersect({q}, t)) AS k, len(t) AS n FROM d)
SELECT doc_id, round(k / ({len(tokens)} + n - k), 6) AS score FROM s WHERE k > 0 ORDER BY k / ({len(tokens)} + n - k) DESC, doc_id LIMIT 10"""


ORACLES = {
    "bm25_topk": _bm25_sql(QUERY.split()),
    "bm25_weighted": _bm25_sql(["version", "the", "license"], weights=WEIGHTS),
    "bm25_facet_filter": _bm25_sql(["licence", "license", "apache", "mit"], "lang = 'fr'"),
    "facet_browse": "SELECT doc_id, 1.0::DOUBLE AS score, substr(text, 1, 200) AS snippet FROM documents WHERE lang = 'de' AND source = 'src3' ORDER BY doc_id LIMIT 10",
    "facet_counts": "SELECT 'type' AS field, 'claim' AS value, count(*) AS n FROM documents UNION ALL SELECT 'domain', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'library', source, count(*) FROM documents GROUP BY source",
    "jaccard_topk": _jaccard_sql(["the", "license", "of", "apache", "version", "mit", "was"]),
    "jaccard_facet": _jaccard_sql(["der", "die", "das", "nicht", "und"], "lang = 'de'"),
    "jaccard_set_join": f"""
WITH a AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS l, list_distinct({tokens_sql("text")}) AS t FROM conversations), b AS (SELECT item_id AS r, list_distinct({tokens_sql("text")}) AS t FROM benchmark),
p AS (SELECT l, r, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS x, len(b.t) AS y FROM a, b),
s AS (SELECT l, r, k / (x + y - k) AS sim FROM p WHERE k > 0), n AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY sim DESC, r) AS rank FROM s)
SELECT l, r, round(sim, 9) AS sim, rank FROM n WHERE rank <= 3""",
    "hybrid_fusion_hashing": _bm25_sql(["license", "apache"], dense=_DENSE),
    "dense_cosine_topk": """
WITH p AS (SELECT e.vec_id, list_transform(e.embedding, lambda x: x::DOUBLE) AS a, list_transform(q.embedding, lambda x: x::DOUBLE) AS b FROM embeddings e, embeddings q WHERE q.vec_id = 0)
SELECT vec_id, round(list_dot_product(a, b) / (coalesce(nullif(sqrt(list_dot_product(a, a)), 0), 1) * coalesce(nullif(sqrt(list_dot_product(b, b)), 0), 1)), 9) AS score FROM p ORDER BY list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) DESC, vec_id LIMIT 10""",
    "dense_cosine_topk_all": """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, coalesce(nullif(sqrt(list_dot_product(v, v)), 0), 1) AS len FROM u),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v) / (a.len * b.len), 12) AS s FROM n a, n b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(s, 9) AS score, rank FROM r WHERE rank <= 10""",
    "index_update_counts": """
SELECT count(*) FILTER (WHERE source = 'src2') + 1 AS added, count(*) FILTER (WHERE source = 'src1') AS replaced, count(*) FILTER (WHERE source IN ('src2', 'src5')) AS removed,
       count(*) FILTER (WHERE source <> 'src5') + 1 AS total FROM documents""",
    "index_update": "SELECT doc_id, md5(CASE WHEN source = 'src1' THEN 'new ' || text ELSE text END) AS digest FROM documents WHERE source <> 'src5'",
}
