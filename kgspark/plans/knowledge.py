"""Queries over claims: extraction, canon, mining, placement, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark import profiles
from kgspark.functions import text as X
from kgspark.operators import canon as C
from kgspark.operators import extract as E
from kgspark.operators import graph as G
from kgspark.operators import mining as M
from kgspark.plans.base import CANON_WORDS, CLAIMS, COORDS, PROFILE, STRIP, _C as _CAPS, _edges, _Q, claims, coordinates, coordinates_once, documents, slug_sql, sql_list, table
from kgspark.store import cut

P = profiles.get(PROFILE)


def segment_units(spark, sf):  # noqa: ANN001
    u = E.units(documents(spark, sf))
    return u.select("doc_id", "unit_id", "unit_type", "start", "end", F.md5("text").alias("digest"))


def claims_extract(spark, sf):  # noqa: ANN001
    return claims(spark, sf).select("item_id", "doc", "source_urn", "span_start", "span_end", "marker", "text", "polarity", "type", "predicate", "modality", "quantification", "dimension")


def claims_by_predicate(spark, sf):  # noqa: ANN001
    return claims(spark, sf).groupBy("lang", "predicate", "polarity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs"))


def quantification_hist(spark, sf):  # noqa: ANN001
    return claims(spark, sf).groupBy("quantification").agg(F.count(F.lit(1)).alias("n"))


def definitions_scan(spark, sf):  # noqa: ANN001
    """Definitions before the documents' texts, as the prose itself defines nothing: of quoted terms with
    stopwords at their edges, an umlaut, a second definition of the same slug, and one of too many words."""
    kinds = ("The “the Data Subject” means x. “data subject” means y.", "“Größe of Daten” is defined as z; “Größe” means w.", "“one two three four five” means v.", "“Of” means u. “Data by” means t.")
    docs = documents(spark, sf).withColumn("text", F.concat(F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("\n"), "text"))
    return E.definitions(docs, profiles.get("generic")).select("source_urn", "term", "term_slug")


def candidate_terms(spark, sf):  # noqa: ANN001
    docs = documents(spark, sf)
    return docs.select("doc_id", F.explode(X.candidate_terms(F.col("text"))).alias("c")).groupBy("c.quoted").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c.term").alias("terms"))


def key_terms(spark, sf):  # noqa: ANN001
    return coordinates(spark, sf).select("item_id", "surface")


def fingerprint_hist(spark, sf):  # noqa: ANN001
    f = G.fingerprints(claims(spark, sf), {"predicate": sorted(P.predicates), "polarity": ["D", "N"]})
    return f.select("source_urn", "n_claims", *[F.col("predicate")[p].alias(f"n_{p}") for p in sorted(P.predicates)], F.col("polarity")["N"].alias("n_normative"))


def federation_5d_hist(spark, sf):  # noqa: ANN001
    f = G.fingerprint(claims(spark, sf), "dimension", list(profiles.DIMENSIONS))
    return f.select("source_urn", F.explode("histogram").alias("dimension", "n"))


def canon_concepts(spark, sf):  # noqa: ANN001
    c = C.concepts(coordinates(spark, sf))
    return c.select("concept_id", "label", "n_claims", "n_sources", "dominant_modality", "dominant_quantification", F.array_join("aliases", "|").alias("aliases"))


def canon_salient(spark, sf):  # noqa: ANN001
    """Concepts that corpus salience lets stand: quoted, or in two sources."""
    return C.coordinates(cut(claims(spark, sf))).groupBy("surface").agg(F.countDistinct("item_id").alias("n_claims"), F.countDistinct("source_urn").alias("n_sources"))


def canon_unclustered(spark, sf):  # noqa: ANN001
    all_ = cut(claims(spark, sf))
    return all_.join(C.coordinates(all_).select("item_id").distinct(), "item_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def canon_edges(spark, sf):  # noqa: ANN001
    return C.edges(coordinates(spark, sf))


def canon_entries_top(spark, sf):  # noqa: ANN001
    return C.entries(C.concepts(coordinates(spark, sf))).limit(50).select("concept_id", "n_sources", "n_claims")


def canon_morph(spark, sf):  # noqa: ANN001
    """Inflected subjects fall together: concepts by stem, with how many surfaces each has."""
    c = C.coordinates(claims(spark, sf), salience=False, morph=True)
    return c.groupBy("concept_id").agg(F.countDistinct("surface").alias("surfaces"), F.countDistinct("item_id").alias("n_claims")).where("surfaces > 1")


def canon_pairs_m2(spark, sf):  # noqa: ANN001
    return C.pairs(coordinates_once(spark, sf))


def canon_composition_edges(spark, sf):  # noqa: ANN001
    return C.composition_edges(C.pairs(coordinates_once(spark, sf)))


def convergence_curve(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    return C.convergence(c, c).select("source_urn", "n_claims", "n_new", "n_distinct", F.round("mint_rate", 9).alias("mint_rate"))


def convergence_global(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    return C.convergence(c, c, order=("lang", "source_urn")).select("lang", "source_urn", "n_new", "n_distinct")


def canon_merge_domains(spark, sf):  # noqa: ANN001
    per = coordinates(spark, sf).groupBy(F.col("lang").alias("domain"), "concept_id").agg(F.countDistinct("source_urn").alias("n_sources"), F.countDistinct("item_id").alias("n_claims"))
    return C.merge_domains(per).where("n_domains > 1").select("concept_id", "n_domains", "n_sources", "n_claims", F.array_join("domains", ",").alias("domains"))


def mint_curve(spark, sf):  # noqa: ANN001
    c = coordinates(spark, sf).select(F.col("doc").cast("long").alias("ord"), "concept_id").distinct()
    return M.mint_curve(c)


def mine_ngrams_maximal(spark, sf):  # noqa: ANN001
    m = M.mine_terms(claims(spark, sf), M.marker_tokens([PROFILE]))
    return m.select("concept_id", "label", "n_claims", "n_sources")


def _labels(spark):  # noqa: ANN001
    words = ["license", "apache license", "loser", "version", "moron", "trash"]
    return spark.createDataFrame([(w.replace(" ", "-"), w) for w in words], "concept_id string, label string")


def mention_edges(spark, sf):  # noqa: ANN001
    return M.mention_edges(M.mentions(claims(spark, sf), _labels(spark)))


def suggest_confirm_min2(spark, sf):  # noqa: ANN001
    return M.confirm(M.support(claims(spark, sf), _labels(spark)), min_sources=2)


def _holdings(spark, sf):  # noqa: ANN001
    """(urn, domain, concept_id), written once: placement reads it for weights, norms and products."""
    return cut(coordinates(spark, sf).select(F.col("source_urn").alias("urn"), F.col("source_urn").alias("domain"), "concept_id").distinct())


def _scores(spark, sf):  # noqa: ANN001
    h = _holdings(spark, sf)
    return M.source_scores(h, h.where("urn = 'src4'").select("concept_id"), exclude="src4")


def placement_nearest_sources(spark, sf):  # noqa: ANN001
    return M.nearest_sources(_scores(spark, sf)).select("urn", F.round("score", 6).alias("score"))


def placement_rank_domains(spark, sf):  # noqa: ANN001
    return M.rank_domains(_scores(spark, sf)).select("domain", F.round("score", 6).alias("score"), "nearest_source")


def placement_tier(spark, sf):  # noqa: ANN001
    return M.recommend_tier(M.rank_domains(_scores(spark, sf)))


def placement_nearest_sources_all(spark, sf):  # noqa: ANN001
    """Every source placed; the queries without ``_all``, as their SQL, place src4 only."""
    return M.nearest_sources(M.all_source_scores(_holdings(spark, sf)), by=("query",)).select("query", "urn", F.round("score", 6).alias("score"))


def placement_rank_domains_all(spark, sf):  # noqa: ANN001
    return M.rank_domains(M.all_source_scores(_holdings(spark, sf)), by=("query",)).select("query", "domain", F.round("score", 6).alias("score"), "nearest_source")


def placement_tier_all(spark, sf):  # noqa: ANN001
    """Sources without any neighbour have a tier as well."""
    every = table(spark, sf, "documents").select(F.col("source").alias("query")).where("query is not null").distinct()
    ranked = M.rank_domains(M.all_source_scores(_holdings(spark, sf)), by=("query",))
    return M.recommend_tier(every.join(ranked, "query", "left"), by=("query",))


def eval_prf1(spark, sf):  # noqa: ANN001
    """Documents of six lines or more, as a guess at quality, against the labels."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    found = docs.where(F.size(F.split("text", "\n")) >= 6).select(F.col("doc_id").alias("slug"))
    gold = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("slug"))
    return M.prf(found, gold).select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def concept_audit(spark, sf):  # noqa: ANN001
    found = coordinates(spark, sf).select(F.col("surface").alias("concept_id")).where("surface <> ''").distinct()
    return M.concept_audit(found).select("norm", "n", F.array_join("ids", ",").alias("ids"))


def escalation_budget(spark, sf):  # noqa: ANN001
    all_ = cut(claims(spark, sf))
    return M.escalation_candidates(all_, C.coordinates(all_), budget=100).select("item_id")


def models_for_source(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    return G.models_for_source(c, C.edges(c), "src7")


def sources_for_model(spark, sf):  # noqa: ANN001
    """Every concept with the number of its sources; sources_for_model_all has the sources themselves."""
    c = coordinates_once(spark, sf)
    return G.models_for_source(c, C.edges(c)).groupBy("concept_id").agg(F.countDistinct("source_urn").alias("n_sources"))


def sources_for_model_all(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    return G.models_for_source(c, C.edges(c)).select("concept_id", "source_urn")


def orphan_claims(spark, sf):  # noqa: ANN001
    known = table(spark, sf, "documents").select(F.col("source").alias("source_urn")).where("source <> 'src3'").distinct()
    return G.orphan_claims(claims(spark, sf), known).select("item_id", "source_urn")


def orphan_edges(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    known = c.where("polarity = 'D'").select("concept_id").distinct()
    return G.orphan_edges(c.where("lang <> 'fr'"), known, C.edges(c))


def edge_contract_violations(spark, sf):  # noqa: ANN001
    e = C.edges(coordinates(spark, sf)).where("canonical_urn in ('src1', 'src2')")
    kinds = e.withColumn("edge_family", F.when(F.col("canonical_urn") == "src1", "grounding").otherwise("binding")).withColumn("dimension", F.lit("causal")).withColumn("semantic_role", F.when(F.col("canonical_urn") == "src1", F.lit("")).otherwise(F.lit("slot")))
    return G.edge_contract_violations(kinds).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def edge_contract_violations_all(spark, sf):  # noqa: ANN001
    """Edges of every source; edge_contract_violations, as its SQL, checks those of src1 and src2 only.

    Family and role are made up from the source's number: odd ones ground without a role, the others
    (and sources without a number) bind with one.
    """
    odd = F.substring(F.regexp_extract("canonical_urn", "[0-9]+", 0), -1, 1).isin(*"13579")
    odd = F.coalesce(odd, F.lit(False))
    kinds = C.edges(coordinates(spark, sf)).withColumns({"edge_family": F.when(odd, "grounding").otherwise("binding"), "dimension": F.lit("causal"), "semantic_role": F.when(odd, "").otherwise("slot")})
    return G.edge_contract_violations(kinds).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def concept_id_checks(spark, sf):  # noqa: ANN001
    found = coordinates(spark, sf).select(F.when(F.col("predicate") == "causes", F.concat(F.lit("urn:x:"), "concept_id")).otherwise(F.col("concept_id")).alias("concept_id")).distinct()
    return G.concept_id_violations(found).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def materialize_claims(spark, sf):  # noqa: ANN001
    sources = table(spark, sf, "documents").select(F.col("source").alias("source_urn"), F.concat(F.lit("urn:x:"), "source").alias("canonical_urn"), F.lit("lib").alias("library")).where("source <> 'src9'").distinct()
    good, _ = G.materialize(claims(spark, sf), sources)
    return good.groupBy("canonical_urn", "library").agg(F.count(F.lit(1)).alias("n"))


def graph_nodes(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    concepts = c.select("concept_id", F.col("concept_id").alias("label")).distinct()
    return G.payload_nodes(c, concepts, c.select("source_urn").distinct())


def graph_edges(spark, sf):  # noqa: ANN001
    c = coordinates_once(spark, sf)
    return G.payload_edges(c, C.edges(c)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("ends"))


QUERIES = (
    segment_units, claims_extract, claims_by_predicate, quantification_hist, definitions_scan, candidate_terms, key_terms, fingerprint_hist, federation_5d_hist,
    canon_concepts, canon_salient, canon_unclustered, canon_edges, canon_entries_top, canon_morph, canon_pairs_m2, canon_composition_edges, convergence_curve, convergence_global,
    canon_merge_domains, mint_curve, mine_ngrams_maximal, mention_edges, suggest_confirm_min2, placement_nearest_sources, placement_rank_domains, placement_tier, placement_nearest_sources_all, placement_rank_domains_all, placement_tier_all, eval_prf1,
    concept_audit, escalation_budget, models_for_source, sources_for_model, sources_for_model_all, orphan_claims, orphan_edges, edge_contract_violations, edge_contract_violations_all, concept_id_checks, materialize_claims, graph_nodes, graph_edges,
)

_C, _N = f"WITH {CLAIMS} ", f"WITH {CLAIMS}, {COORDS} "
_STEM = "CASE WHEN length(w) < 4 THEN lower(w) WHEN w LIKE '%es' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%en' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%e' AND length(w) >= 5 THEN w[:-2] WHEN w LIKE '%s' AND length(w) >= 5 THEN w[:-2] ELSE w END"
_EDGE = "'grd-' || substr(sha1(item_id || '->' || concept_id), 1, 12)"

def _pairs(tail: str) -> str:
    return _N + ", own AS (SELECT DISTINCT source_urn, unit_id, concept_id FROM named), p AS (SELECT x.concept_id AS a, y.concept_id AS b, count(DISTINCT x.source_urn) AS n_sources FROM own x JOIN own y ON x.source_urn = y.source_urn AND x.unit_id = y.unit_id AND x.concept_id < y.concept_id GROUP BY 1, 2 HAVING count(DISTINCT x.source_urn) >= 2), q AS (SELECT a, b, 'm2-' || substr(sha1(a || '|' || b), 1, 12) AS concept_id, n_sources FROM p) " + tail


_MODE = "(SELECT arg_min(v, (-n, v)) FROM (SELECT {c} AS v, count(*) AS n FROM named m WHERE m.concept_id = b.concept_id GROUP BY 1))"
_MENTION = " OR ".join(f"(l.label = '{w}' AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w.replace(' ', chr(92) + 's+')}s?($|[^\\p{{L}}\\p{{N}}_])'))" for w in ("license", "apache license", "loser", "version", "moron", "trash"))
_MENTIONS = f", l AS (SELECT * FROM (VALUES ('license', 'license'), ('apache-license', 'apache license'), ('loser', 'loser'), ('version', 'version'), ('moron', 'moron'), ('trash', 'trash')) v(concept_id, label)), men AS (SELECT DISTINCT item_id, source_urn, concept_id FROM claims, l WHERE {_MENTION}) "
_SCORES = _N + """, h AS (SELECT DISTINCT source_urn AS urn, concept_id FROM named), k AS (SELECT concept_id, ln((SELECT count(DISTINCT urn) FROM h) / count(*)) AS w FROM h GROUP BY 1),
q AS (SELECT concept_id, w FROM h JOIN k USING (concept_id) WHERE urn = 'src4'), sn AS (SELECT urn, sqrt(sum(w * w)) AS sn FROM h JOIN k USING (concept_id) GROUP BY 1),
d AS (SELECT h.urn, sum(q.w * q.w) AS dot FROM h JOIN q USING (concept_id) GROUP BY 1), sc AS (SELECT urn, dot / (sn * (SELECT sqrt(sum(w * w)) FROM q)) AS score FROM d JOIN sn USING (urn) WHERE urn <> 'src4' AND dot > 0) """

_WORD35 = "[^-]{35,}"
_FINE = f"x <> '' AND x NOT IN ({CANON_WORDS}) AND NOT regexp_matches(x, '{_WORD35}')"


def _candidates(rows: str) -> str:
    """(…, terms) of rows with a text: quoted terms, then capitalised phrases that aren't quoted, as structs."""
    return f"""
found_ AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{_Q}', 1), lambda y: {slug_sql(_edges("y"))}), lambda x: {_FINE})) AS qs,
  list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(text, '{_CAPS}', 1), lambda y: {_edges("y")}), lambda y: contains(y, ' ')), lambda y: {slug_sql("y")}), lambda x: {_FINE})) AS cs FROM {rows}),
cand_ AS (SELECT * EXCLUDE (qs, cs), unnest(list_concat(list_transform(qs, lambda x: {{'term': x, 'quoted': true}}), list_transform(list_filter(cs, lambda x: NOT list_contains(qs, x)), lambda x: {{'term': x, 'quoted': false}}))) AS c FROM found_)"""


_SALIENT = "WITH " + CLAIMS + "," + _candidates("claims") + """, term_ AS (SELECT c.term AS term FROM cand_ GROUP BY 1 HAVING bool_or(c.quoted) OR count(DISTINCT source_urn) >= 2),
pick_ AS (SELECT item_id, source_urn, lang, arg_min(c.term, (-length(c.term), c.term)) AS surface FROM cand_ WHERE c.term IN (SELECT term FROM term_) GROUP BY ALL) """
_MINED = sorted(profiles.MINING_WORDS | M.marker_tokens([PROFILE]))
_PLAIN = "strip_accents(replace(replace(replace(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'))"
_MINE = "WITH " + CLAIMS + f""", tok AS MATERIALIZED (SELECT item_id, source_urn, regexp_extract_all(text, '[\\p{{L}}]+', 0) AS o FROM claims),
worded AS (SELECT * FROM tok WHERE len(o) > 0), tot AS (SELECT count(*) AS total FROM worded),
freq AS (SELECT t FROM (SELECT item_id, unnest(list_distinct(list_transform(o, lambda x: lower(x)))) AS t FROM worded) GROUP BY 1 HAVING count(*) > (SELECT total FROM tot) / 3.0),
word AS (SELECT item_id, source_urn, i, w, lower(w) AS w0 FROM (SELECT item_id, source_urn, unnest(o) AS w, generate_subscripts(o, 1) AS i FROM worded)),
flag AS (SELECT item_id, source_urn, i, w AS o, length(w0) >= 3 AS l, length(w0) >= 3 AND w0 NOT IN ({sql_list(_MINED)}) AND {_PLAIN.format("w0")} NOT IN ({sql_list(_MINED)}) AND w0 NOT IN (SELECT t FROM freq) AS e, (SELECT {_STEM} FROM (SELECT w0 AS w)) AS st FROM word),
g AS (SELECT item_id, source_urn, i, 1 AS n, st AS gram, o AS variant FROM flag WHERE e
  UNION ALL SELECT a.item_id, a.source_urn, a.i, 2, a.st || ' ' || b.st, a.o || ' ' || b.o FROM flag a JOIN flag b ON a.item_id = b.item_id AND b.i = a.i + 1 WHERE a.e AND b.e
  UNION ALL SELECT a.item_id, a.source_urn, a.i, 3, a.st || ' ' || b.st || ' ' || c.st, a.o || ' ' || b.o || ' ' || c.o FROM flag a JOIN flag b ON a.item_id = b.item_id AND b.i = a.i + 1 JOIN flag c ON a.item_id = c.item_id AND c.i = a.i + 2 WHERE a.e AND b.l AND c.e),
s AS (SELECT gram, n, count(DISTINCT item_id) AS n_claims, count(DISTINCT source_urn) AS n_sources FROM g GROUP BY 1, 2),
good AS (SELECT * FROM s, tot WHERE n_sources >= 2 AND n_claims >= 3 AND n_claims / total <= 1 / 3 AND total >= 3),
k3 AS (SELECT * FROM good WHERE n = 3), k2 AS (SELECT * FROM good a WHERE n = 2 AND NOT EXISTS (SELECT 1 FROM k3 b WHERE (b.gram LIKE a.gram || ' %' OR b.gram LIKE '% ' || a.gram) AND b.n_claims >= 0.8 * a.n_claims)),
up AS (SELECT * FROM k3 UNION ALL SELECT * FROM k2), k1 AS (SELECT * FROM good a WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM up b WHERE list_contains(string_split(b.gram, ' '), a.gram) AND b.n_claims >= 0.8 * a.n_claims)),
best AS (SELECT * FROM (SELECT * FROM up UNION ALL SELECT * FROM k1) ORDER BY n_sources DESC, n_claims DESC, string_split(gram, ' ') LIMIT 40),
f AS (SELECT gram, variant, count(*) AS c FROM (SELECT item_id, gram, arg_min(variant, i) AS variant FROM g WHERE gram IN (SELECT gram FROM best) GROUP BY 1, 2) GROUP BY 1, 2)
SELECT substr(regexp_replace(regexp_replace({_PLAIN.format("gram")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS concept_id, (SELECT arg_min(variant, (-c, variant)) FROM f WHERE f.gram = best.gram) AS label, n_claims, n_sources FROM best"""
_ALL_SCORES = _N + """, h AS (SELECT DISTINCT source_urn AS urn, concept_id FROM named), k AS (SELECT concept_id, ln((SELECT count(DISTINCT urn) FROM h) / count(*)) AS w FROM h GROUP BY 1),
hw AS (SELECT urn, concept_id, w * w AS w FROM h JOIN k USING (concept_id) WHERE w > 0), nn AS (SELECT urn, sqrt(sum(w)) AS n FROM hw GROUP BY 1), d AS (SELECT a.urn AS query, b.urn, sum(a.w) AS dot FROM hw a JOIN hw b ON a.concept_id = b.concept_id AND a.urn <> b.urn GROUP BY 1, 2),
sc AS (SELECT query, d.urn, dot / (x.n * y.n) AS score FROM d JOIN nn x ON x.urn = d.query JOIN nn y ON y.urn = d.urn) """

ORACLES = {
    "definitions_scan": "SELECT doc_id::VARCHAR AS source_urn, CASE doc_id % 4 WHEN 0 THEN 'Data Subject' ELSE t END AS term, CASE doc_id % 4 WHEN 0 THEN 'data-subject' ELSE g END AS term_slug FROM documents LEFT JOIN (VALUES (1, 'Größe of Daten', 'groesse-of-daten'), (1, 'Größe', 'groesse')) v(k, t, g) ON k = doc_id % 4 WHERE doc_id % 4 IN (0, 1)",
    "candidate_terms": "WITH " + _candidates("documents") + " SELECT c.quoted AS quoted, count(*) AS n, count(DISTINCT c.term) AS terms FROM cand_ GROUP BY 1",
    "canon_salient": _SALIENT + "SELECT surface, count(DISTINCT item_id) AS n_claims, count(DISTINCT source_urn) AS n_sources FROM pick_ GROUP BY 1",
    "canon_unclustered": _SALIENT + "SELECT lang, count(*) AS n FROM claims WHERE item_id NOT IN (SELECT item_id FROM pick_) GROUP BY 1",
    "escalation_budget": _SALIENT + "SELECT item_id FROM claims ORDER BY item_id IN (SELECT item_id FROM pick_), item_id LIMIT 100",
    "mine_ngrams_maximal": _MINE,
    "placement_nearest_sources_all": _ALL_SCORES + "SELECT query, urn, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, urn DESC) AS n FROM sc) WHERE n <= 5",
    "placement_rank_domains_all": _ALL_SCORES + "SELECT query, urn AS domain, round(score, 6) AS score, urn AS nearest_source FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, urn) AS n FROM sc) WHERE n <= 5",
    "placement_tier_all": _ALL_SCORES + ", t AS (SELECT query, list(score ORDER BY score DESC) AS s FROM sc GROUP BY 1), q AS (SELECT DISTINCT source AS query FROM documents WHERE source IS NOT NULL) SELECT query, CASE WHEN coalesce(s[1], 0) < 0.02 THEN 'local-llm' WHEN s[1] - coalesce(s[2], 0) >= 0.5 * s[1] THEN 'regex' ELSE 'local-llm' END AS tier FROM q LEFT JOIN t USING (query)",
    "sources_for_model_all": _N + "SELECT DISTINCT concept_id, source_urn FROM named",
    "edge_contract_violations_all": _C + "SELECT CASE WHEN substr(regexp_extract(source_urn, '[0-9]+'), -1, 1) IN ('1', '3', '5', '7', '9') THEN 'semantic_role required' ELSE 'type invalid for family' END AS violation, count(*) AS n FROM claims GROUP BY 1",
    "segment_units": f"SELECT doc_id, 'para-0' AS unit_id, 'paragraph' AS unit_type, 0 AS start, length(text)::INTEGER AS \"end\", md5({STRIP.format('text')}) AS digest FROM documents WHERE length({STRIP.format('text')}) >= 40",
    "claims_extract": _C + "SELECT item_id, doc, source_urn, span_start, span_end, marker, text, polarity, type, predicate, modality, quantification, dimension FROM claims",
    "claims_by_predicate": _C + "SELECT lang, predicate, polarity, count(*) AS n, count(DISTINCT doc) AS docs FROM claims GROUP BY ALL",
    "quantification_hist": _C + "SELECT quantification, count(*) AS n FROM claims GROUP BY 1",
    "key_terms": _N + "SELECT item_id, surface FROM named",
    "fingerprint_hist": _C + "SELECT source_urn, count(*) AS n_claims, " + ", ".join(f"count(*) FILTER (WHERE predicate = '{p}') AS n_{p}" for p in sorted(P.predicates)) + ", count(*) FILTER (WHERE polarity = 'N') AS n_normative FROM claims GROUP BY 1",
    "federation_5d_hist": _C + "SELECT s.source_urn, d.dimension, count(c.item_id) AS n FROM (SELECT DISTINCT source_urn FROM claims) s CROSS JOIN (VALUES ('structural'), ('causal'), ('relational'), ('temporal'), ('intentional')) d(dimension) LEFT JOIN claims c ON c.source_urn = s.source_urn AND c.dimension = d.dimension GROUP BY 1, 2",
    "canon_concepts": _N + f""", b AS (SELECT concept_id, min(polarity) AS polarity, min(predicate) AS predicate, min(key_term) AS key_term, count(DISTINCT item_id) AS n_claims, count(DISTINCT source_urn) AS n_sources,
  array_to_string(list_sort(list_distinct(list(nullif(surface, '')))), '|') AS aliases FROM named GROUP BY 1)
SELECT concept_id, coalesce(nullif(trim(replace(coalesce(nullif({_MODE.format(c="surface")}, ''), key_term), '-', ' ')), ''), '(unnamed)') || ' — ' || predicate || CASE WHEN polarity = 'D' THEN ' (is)' ELSE ' (ought)' END AS label,
  n_claims, n_sources, {_MODE.format(c="modality")} AS dominant_modality, {_MODE.format(c="quantification")} AS dominant_quantification, coalesce(aliases, '') AS aliases FROM b""",
    "canon_edges": _N + f"SELECT {_EDGE} AS edge_id, item_id AS src_id, concept_id AS dst_id, 'grounds' AS edge_type, source_urn AS canonical_urn FROM named",
    "canon_entries_top": _N + "SELECT concept_id, count(DISTINCT source_urn) AS n_sources, count(DISTINCT item_id) AS n_claims FROM named GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50",
    "canon_morph": _N + f", st AS (SELECT *, array_to_string(list_filter(list_transform(string_split(surface, '-'), lambda w: {_STEM}), lambda x: x <> ''), '-') AS ident FROM named), f AS (SELECT *, 'm-' || array_to_string(list_filter([lower(polarity), lower(predicate), ident], lambda x: x <> ''), '-') AS cid FROM st) SELECT cid AS concept_id, count(DISTINCT surface) AS surfaces, count(DISTINCT item_id) AS n_claims FROM f GROUP BY 1 HAVING count(DISTINCT surface) > 1",
    "canon_pairs_m2": _pairs("SELECT * FROM q"),
    "canon_composition_edges": _pairs("SELECT 'cmp-' || substr(sha1(m || '->' || concept_id), 1, 12) AS edge_id, m AS src_id, concept_id AS dst_id, 'composes' AS edge_type, 'member:' || k AS semantic_role FROM (SELECT a AS m, 1 AS k, concept_id FROM q UNION ALL SELECT b, 2, concept_id FROM q)"),
    "convergence_curve": _N + ", f AS (SELECT concept_id, min(source_urn) AS source_urn FROM named GROUP BY 1), n AS (SELECT source_urn, count(*) AS n_new FROM f GROUP BY 1), c AS (SELECT source_urn, count(*) AS n_claims FROM claims GROUP BY 1) SELECT source_urn, n_claims, coalesce(n_new, 0) AS n_new, sum(coalesce(n_new, 0)) OVER (ORDER BY source_urn)::BIGINT AS n_distinct, round(coalesce(n_new, 0) / n_claims, 9) AS mint_rate FROM c LEFT JOIN n USING (source_urn)",
    "convergence_global": _N + ", f AS (SELECT concept_id, min((lang, source_urn)) AS s FROM named GROUP BY 1), n AS (SELECT s[1] AS lang, s[2] AS source_urn, count(*) AS n_new FROM f GROUP BY 1, 2), c AS (SELECT DISTINCT lang, source_urn FROM claims) SELECT lang, source_urn, coalesce(n_new, 0) AS n_new, sum(coalesce(n_new, 0)) OVER (ORDER BY lang, source_urn)::BIGINT AS n_distinct FROM c LEFT JOIN n USING (lang, source_urn)",
    "canon_merge_domains": _N + ", p AS (SELECT lang, concept_id, count(DISTINCT source_urn) AS n_sources, count(DISTINCT item_id) AS n_claims FROM named GROUP BY 1, 2) SELECT concept_id, count(*) AS n_domains, sum(n_sources)::BIGINT AS n_sources, sum(n_claims)::BIGINT AS n_claims, string_agg(lang, ',' ORDER BY lang) AS domains FROM p GROUP BY 1 HAVING count(*) > 1",
    "mint_curve": _N + ", s AS (SELECT DISTINCT doc::BIGINT AS ord, concept_id FROM named), f AS (SELECT concept_id, min(ord) AS ord FROM s GROUP BY 1) SELECT d.ord, count(f.concept_id) AS n_new FROM (SELECT DISTINCT ord FROM s) d LEFT JOIN f USING (ord) GROUP BY 1",
    "mention_edges": _C + _MENTIONS + "SELECT 'sug-' || substr(sha1(item_id || concept_id), 1, 10) AS edge_id, item_id AS src_id, concept_id AS dst_id, 'grounds' AS edge_type, 'mention' AS rationale, '' AS confidence, 'suggested' AS verification FROM men",
    "suggest_confirm_min2": _C + _MENTIONS + "SELECT concept_id, count(DISTINCT item_id) AS n_claims, count(DISTINCT source_urn) AS n_sources FROM men GROUP BY 1 HAVING count(DISTINCT source_urn) >= 2",
    "placement_nearest_sources": _SCORES + "SELECT urn, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, urn DESC LIMIT 5",
    "placement_rank_domains": _SCORES + "SELECT urn AS domain, round(score, 6) AS score, urn AS nearest_source FROM sc ORDER BY sc.score DESC, urn LIMIT 5",
    "placement_tier": _SCORES + ", t AS (SELECT list(score ORDER BY score DESC) AS s FROM (SELECT score FROM sc ORDER BY score DESC LIMIT 5)) SELECT CASE WHEN coalesce(s[1], 0) < 0.02 THEN 'local-llm' WHEN s[1] - coalesce(s[2], 0) >= 0.5 * s[1] THEN 'regex' ELSE 'local-llm' END AS tier FROM t",
    "eval_prf1": "WITH f AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE len(string_split(text, chr(10))) >= 6), g AS (SELECT doc_id FROM labels WHERE quality = 1), n AS (SELECT count(*) FILTER (WHERE f.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE f.doc_id IS NULL) AS fn FROM f FULL JOIN g USING (doc_id)), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS q FROM n) SELECT tp, fp, fn, round(p, 9) AS precision, round(q, 9) AS recall, round(2 * p * q / (p + q), 9) AS f1 FROM r",
    "concept_audit": _N + f", s AS (SELECT DISTINCT surface AS c FROM named WHERE surface <> ''), t AS (SELECT c, array_to_string(list_filter(list_transform(string_split(c, '-'), lambda w: {_STEM}), lambda x: x <> ''), '-') AS norm FROM s) SELECT norm, count(*) AS n, string_agg(c, ',' ORDER BY c) AS ids FROM t GROUP BY 1 HAVING count(*) > 1",
    "models_for_source": _N + "SELECT DISTINCT source_urn, concept_id FROM named WHERE source_urn = 'src7'",
    "sources_for_model": _N + "SELECT concept_id, count(DISTINCT source_urn) AS n_sources FROM named GROUP BY 1",
    "orphan_claims": _C + "SELECT item_id, source_urn FROM claims WHERE source_urn = 'src3'",
    "orphan_edges": _N + f", d AS (SELECT DISTINCT concept_id FROM named WHERE polarity = 'D'), c AS (SELECT DISTINCT item_id FROM claims WHERE lang <> 'fr'), e AS (SELECT {_EDGE} AS edge_id, item_id, concept_id FROM named) SELECT edge_id, 'src_id' AS endpoint, item_id AS value FROM e WHERE item_id NOT IN (SELECT item_id FROM c) UNION ALL SELECT edge_id, 'dst_id', concept_id FROM e WHERE concept_id NOT IN (SELECT concept_id FROM d)",
    "edge_contract_violations": _C + "SELECT 'semantic_role required' AS violation, count(*) AS n FROM claims WHERE source_urn = 'src1' UNION ALL SELECT 'type invalid for family', count(*) FROM claims WHERE source_urn = 'src2'",
    "concept_id_checks": _N + ", u AS (SELECT DISTINCT concept_id FROM named WHERE predicate = 'causes') SELECT v AS violation, count(*) AS n FROM u, (VALUES ('not a bare slug'), ('is a urn')) t(v) GROUP BY 1",
    "materialize_claims": _C + "SELECT 'urn:x:' || source_urn AS canonical_urn, 'lib' AS library, count(*) AS n FROM claims WHERE source_urn <> 'src9' GROUP BY ALL",
    "graph_nodes": _N + ", n AS (SELECT DISTINCT source_urn AS id, 'source' AS kind, source_urn AS label FROM claims UNION SELECT item_id, 'claim', text FROM claims UNION SELECT concept_id, 'concept', concept_id FROM named) SELECT id, kind, CASE WHEN length(label) > 80 THEN substr(label, 1, 79) || '…' ELSE label END AS label FROM n",
    "graph_edges": _N + "SELECT 'anchors' AS kind, count(DISTINCT (item_id, source_urn)) AS n, count(DISTINCT source_urn) AS ends FROM claims UNION ALL SELECT 'grounds', count(DISTINCT (item_id, concept_id)), count(DISTINCT concept_id) FROM named",
}
