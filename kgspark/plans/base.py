"""Tables, views and SQL fragments that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import profiles
from kgspark.operators import canon, extract
from kgspark.store import cut, spread

PROFILE = "synthetic"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores where they come in one small file."""
    return spread(table(spark, sf_dir, "documents"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the documents; item ids come from the document, sources from its source column."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    found = extract.claims(docs, profiles.get(PROFILE), carry=("source", "lang"))
    return found.withColumnRenamed("source_urn", "doc").withColumnRenamed("source", "source_urn")


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.coordinates(claims(spark, sf_dir), salience=False)


def coordinates_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims with their coordinates, written once for plans that read them several times."""
    return cut(coordinates(spark, sf_dir))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LOOK = r"(^|[^\p{{L}}\p{{N}}_]){}($|[^\p{{L}}\p{{N}}_])"


def _markers() -> str:
    p = profiles.get(PROFILE)
    rows = [f"({m.ord}, '{m.pattern}', '{m.predicate}', '{m.modality}', '{'N' if m.modality in p.normative else 'D'}', '{p.dimension_for(m.predicate)}')" for m in p.markers]
    return "(VALUES " + ", ".join(rows) + ") AS m(ord, marker, predicate, modality, polarity, dimension)"


def _seen() -> str:
    """Markers of a sentence as a list; constant patterns compile once."""
    hits = [f"CASE WHEN regexp_matches(lb, '{LOOK.format(m.pattern.lower())}') THEN {m.ord} END" for m in profiles.get(PROFILE).markers]
    return "[" + ", ".join(hits) + "]"


def _quant(c: str) -> str:
    out = "CASE"
    for value, cues in profiles.get(PROFILE).cues:
        out += " WHEN " + " OR ".join(f"contains(lower({c}), '{x}')" for x in cues) + f" THEN '{value}'"
    return out + " ELSE 'null' END"


CLAIMS = f"""
unit_ AS (SELECT doc_id, lang, source, {STRIP.format("text")} AS t FROM documents WHERE length({STRIP.format("text")}) >= 40),
piece_ AS (SELECT doc_id, lang, source, unnest(string_split(t, '.')) AS b, generate_subscripts(string_split(t, '.'), 1) AS i, len(string_split(t, '.')) AS n FROM unit_),
placed_ AS (SELECT *, coalesce(sum(length(b) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS s FROM piece_),
sentence_ AS (SELECT *, (s + length(b) + CASE WHEN i < n THEN 1 ELSE 0 END)::INTEGER AS e, {STRIP.format("b || CASE WHEN i < n THEN '.' ELSE '' END")} AS sentence FROM placed_),
seen_ AS (SELECT *, unnest({_seen()}) AS o FROM (SELECT *, lower(b) AS lb FROM sentence_ WHERE length(sentence) >= 8)),
hit_ AS (SELECT q.*, m.* FROM seen_ q JOIN {_markers()} ON q.o = m.ord),
first_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i, predicate ORDER BY ord) AS rn FROM hit_),
claims AS (
  SELECT 'item-' || substr(sha1(doc_id::VARCHAR || '[' || s || ', ' || e || ']' || predicate), 1, 10) AS item_id, doc_id::VARCHAR AS doc, source AS source_urn, lang,
         'para-0' AS unit_id, s AS span_start, e AS span_end, marker, substr(sentence, 1, 400) AS text, polarity,
         CASE WHEN polarity = 'D' THEN 'is' ELSE 'ought' END AS type, predicate, modality, {_quant("sentence")} AS quantification, dimension
  FROM first_ WHERE rn = 1)
"""

CANON_WORDS = ", ".join(f"'{w}'" for w in sorted(profiles.CANON_WORDS))
#: The subject of a claim by its longest word (generated prose has hardly any quoted or capitalised term).
_Q = "[‘''\"“„«‹]([^’''\"”“»›]{2,60})[’''\"”“»›]"
_C = r"([\p{L}][\p{L}\p{N}_-]*(?:\s+[A-ZÄÖÜ][\p{L}\p{N}_-]*){1,3})"


def slug_sql(c: str, size: int = 48) -> str:
    return f"substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {size})"


def _edges(c: str) -> str:
    """A phrase without function words at its edges, as SQL."""
    parts = f"list_filter(regexp_split_to_array({STRIP.format(c)}, '\\s+'), lambda w: w <> '')"
    kept = f"list_filter(range(1, len({parts}) + 1), lambda i: lower(({parts})[i]) NOT IN ({CANON_WORDS}))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string(({parts})[list_min({kept}):list_max({kept})], ' ') ELSE '' END"


COORDS = f"""
quoted_ AS (SELECT c.*, regexp_extract(text, '{_Q}', 1) AS q0 FROM claims c),
phrase_ AS (SELECT *, {_edges("q0")} AS q1, list_filter(list_transform(regexp_extract_all(text, '{_C}', 1), lambda x: {_edges("x")}), lambda x: contains(x, ' ')) AS ph,
   list_filter(regexp_extract_all(lower(text), '[\\p{{L}}]{{4,}}', 0), lambda x: x NOT IN ({CANON_WORDS})) AS tok FROM quoted_),
chosen_ AS (SELECT *, {slug_sql("q1")} AS qs,
   {slug_sql("list_sort(list_filter(ph, lambda x: length(x) = list_max(list_transform(ph, lambda y: length(y)))))[-1]")} AS cs,
   {slug_sql("list_sort(list_filter(tok, lambda x: length(x) = list_max(list_transform(tok, lambda y: length(y)))))[1]")} AS ts FROM phrase_),
coords AS (SELECT * EXCLUDE (q0, q1, ph, tok, qs, cs, ts), CASE WHEN qs <> '' AND qs NOT IN ({CANON_WORDS}) THEN qs WHEN len(ph) > 0 AND cs <> '' AND cs NOT IN ({CANON_WORDS}) THEN cs ELSE coalesce(ts, '') END AS surface FROM chosen_),
named AS (SELECT *, surface AS key_term, 'm-' || array_to_string(list_filter([lower(polarity), lower(predicate), surface], lambda x: x <> ''), '-') AS concept_id FROM coords)
"""


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+', 0), lambda x: length(x) >= 2)"


def urn_docs(docs: DataFrame) -> DataFrame:
    """Documents as search documents: language is their domain, source their canonical urn."""
    return docs.select(
        F.col("doc_id"), F.lit("claim").alias("type"), "text", F.create_map(F.lit("type"), F.lit("claim"), F.lit("domain"), F.col("lang"), F.lit("library"), F.col("source")).alias("facets"),
        F.col("source").alias("canonical_urn"), F.col("lang").alias("domain"), F.col("source").alias("library"), F.lit("").alias("concept_id"),
    )
