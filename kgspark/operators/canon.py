"""The canon: claims cluster into concepts by their coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.store import cut

AXES = ("polarity", "predicate", "key_term")
MIN_DF, MIN_SUPPORT = 2, 2
#: Concepts in a block of pairs, pairs that one task writes, and rows of concepts or their units that are broadcast.
BLOCK, PER_TASK, BROADCAST = 500, 4_000_000, 2_000_000


def salient_terms(claims: DataFrame, *, min_df: int = MIN_DF, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, term) of terms that may name a concept: quoted somewhere, or in min_df sources."""
    terms = claims.select(*by, "source_urn", F.explode(X.candidate_terms(F.col("text"))).alias("c"))
    df = terms.groupBy(*by, F.col("c.term").alias("term")).agg(F.countDistinct("source_urn").alias("df"), F.max("c.quoted").alias("quoted"))
    return df.where(F.col("quoted") | (F.col("df") >= min_df)).select(*by, "term")


def coordinate_id(polarity: Column, predicate: Column, key_term: Column) -> Column:
    parts = F.filter(F.array(X.slug(polarity), X.slug(predicate), X.text(key_term)), lambda p: p != "")
    tail = F.array_join(parts, "-")
    return F.when(tail != "", F.concat(F.lit("m-"), tail)).otherwise(F.lit("m-x"))


def label(term: Column, predicate: Column, polarity: Column) -> Column:
    head = F.coalesce(F.nullif(F.trim(F.replace(X.text(term), F.lit("-"), F.lit(" "))), F.lit("")), F.lit("(unnamed)"))
    pol = F.when(F.upper(polarity) == "D", "(is)").otherwise("(ought)")
    return F.when(X.text(predicate) != "", F.concat(head, F.lit(" — "), predicate, F.lit(" "), pol)).otherwise(F.concat(head, F.lit(" "), pol))


def coordinates(claims: DataFrame, *, salience: bool = True, min_df: int = MIN_DF, morph: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """claims with ``surface`` and ``concept_id``; under salience, claims without a salient subject go."""
    if salience:
        terms = salient_terms(claims, min_df=min_df, by=by)
        own = claims.select("item_id", *by, F.explode(F.transform(X.candidate_terms(F.col("text")), lambda c: c["term"])).alias("term")).distinct()
        picked = own.join(terms, [*by, "term"], "left_semi").groupBy("item_id").agg(F.min(F.struct((-F.length("term")).alias("n"), "term")).alias("t"))
        named = claims.join(picked.select("item_id", F.col("t.term").alias("surface")), "item_id")
    else:
        named = claims.withColumn("surface", X.key_term(F.col("text")))
    ident = X.normalize_slug(F.col("surface")) if morph else F.col("surface")
    polarity = F.coalesce(X.absent("polarity"), F.lit("D"))
    return named.withColumn("concept_id", coordinate_id(polarity, F.col("predicate"), ident)).withColumn("key_term", ident)


def _mode(counted: DataFrame, value: str) -> DataFrame:
    """Most frequent value of each concept, the least of equals: two aggregates, no sort."""
    n = counted.groupBy("concept_id", value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("concept_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select("concept_id", F.col("m.v").alias(f"top_{value}"))


def concepts(coords: DataFrame, *, domain: str | None = None) -> DataFrame:
    """One row for each concept: sets, support, dominant axes, modal surface, label and example.

    The coordinates are written once; four aggregates read the columns they need of them.
    """
    needed = ("concept_id", "polarity", "predicate", "key_term", "text", "source_urn", "span_start", "item_id", "surface", "modality", "quantification")
    coords = cut(coords.select(*needed, *([domain] if domain else [])))
    axes = [F.min("polarity").alias("polarity"), F.min("predicate").alias("predicate"), F.min("key_term").alias("key_term")]
    example = F.min(F.when(F.col("text") != "", F.struct("source_urn", "span_start", "item_id", F.substring("text", 1, 200).alias("t"))))
    base = coords.groupBy("concept_id").agg(
        *axes, F.countDistinct("item_id").alias("n_claims"), F.countDistinct("source_urn").alias("n_sources"),
        F.array_sort(F.collect_set(F.nullif(F.col("surface"), F.lit("")))).alias("aliases"), example.alias("e"),
        *([F.array_sort(F.collect_set(domain)).alias("domains")] if domain else []),
    )
    tops = base
    for axis in ("modality", "quantification", "surface"):
        tops = tops.join(_mode(coords, axis), "concept_id")
    named = F.coalesce(F.nullif(F.col("top_surface"), F.lit("")), F.col("key_term"))
    return tops.select(
        "concept_id", label(named, F.col("predicate"), F.col("polarity")).alias("label"), "polarity", "predicate", "key_term", "n_claims", "n_sources", "aliases",
        *(["domains"] if domain else []),
        F.col("top_modality").alias("dominant_modality"), F.col("top_quantification").alias("dominant_quantification"), F.coalesce("e.t", F.lit("")).alias("example"),
    )


def entries(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("n_sources"), F.desc("n_claims"), "concept_id")


def edges(coords: DataFrame) -> DataFrame:
    """A grounds edge for each claim."""
    return coords.select(X.edge_id(F.col("item_id"), F.col("concept_id")).alias("edge_id"), F.col("item_id").alias("src_id"), F.col("concept_id").alias("dst_id"), F.lit("grounds").alias("edge_type"), F.col("source_urn").alias("canonical_urn"))


def convergence(claims: DataFrame, coords: DataFrame, *, order: tuple[str, ...] = ("source_urn",)) -> DataFrame:
    """(…order, n_new, n_distinct, n_claims, mint_rate): how many concepts are new at each source, in order.

    The running total orders one row for each source, after both aggregates.
    """
    first = coords.groupBy("concept_id").agg(F.min(F.struct(*order)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n_new")).select(*[F.col(f"s.{c}").alias(c) for c in order], "n_new")
    per = claims.groupBy(*order).agg(F.count(F.lit(1)).alias("n_claims"))
    joined = per.join(first, list(order), "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    total = F.sum("n_new").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined.select(*order, "n_claims", "n_new", total.alias("n_distinct"), (F.col("n_new") / F.col("n_claims")).alias("mint_rate"))


def pairs(coords: DataFrame, *, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Concepts that stand together in one unit of min_support sources: (a, b, concept_id, n_sources).

    Concepts of too few sources have no partner and go first. Concepts of the same units form a group;
    groups meet in their units, and only those with enough common sources are written out as pairs. So
    each pair is made once, by blocks of BLOCK concepts that are dealt out to tasks by themselves.
    """
    cores = coords.sparkSession.sparkContext.defaultParallelism
    own = coords.where("unit_id <> '' and source_urn is not null").select("source_urn", "unit_id", "concept_id").distinct()
    held = own.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("source_urn", "unit_id"))).alias("units"))
    held = held.where(F.size(F.array_distinct("units.source_urn")) >= min_support).withColumn("g", F.xxhash64("units"))
    # a group in blocks, evened out by a hash of the concept; two groups of one hash would be an error
    sized = held.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("g"))).withColumn("i", F.pmod(F.xxhash64("concept_id"), F.ceil(F.col("n") / BLOCK)))
    one = F.when(F.min("units") == F.max("units"), F.min("units")).otherwise(F.raise_error(F.lit("two groups share a hash")))
    blocks = cut(sized.groupBy("g", "i").agg(F.collect_list("concept_id").alias("cs"), one.alias("units")))
    small = blocks.agg(F.sum(F.size("units")), F.sum(F.size("cs"))).first()
    near = lambda df, n: F.broadcast(df) if (n or 0) <= BROADCAST else df
    spots = blocks.groupBy("g").agg(F.min("units").alias("units")).select("g", F.explode("units").alias("u")).select("g", "u.*")
    x, y = spots.repartition(8 * cores, "g").alias("x"), near(spots, small[0]).alias("y")
    meet = x.join(y, (F.col("x.source_urn") == F.col("y.source_urn")) & (F.col("x.unit_id") == F.col("y.unit_id")) & (F.col("x.g") <= F.col("y.g")))
    groups = meet.groupBy(F.col("x.g").alias("g"), F.col("y.g").alias("h")).agg(F.countDistinct("x.source_urn").alias("n_sources")).where(F.col("n_sources") >= min_support)
    ids = blocks.select("g", "i", F.size("cs").cast("double").alias("k"))
    left, right = near(ids, small[1]), near(ids.toDF("h", "j", "l"), small[1])
    both = cut(groups.join(left, "g").join(right, "h").where("g < h or i <= j").select("g", "i", "h", "j", "n_sources", (F.col("k") * F.col("l")).alias("w")))
    tasks = int(max(cores, (both.agg(F.sum("w")).first()[0] or 0) // PER_TASK + 1))
    found = both.repartition(tasks).join(near(blocks.select("g", "i", F.col("cs").alias("x")), small[1]), ["g", "i"]).join(near(blocks.select(F.col("g").alias("h"), F.col("i").alias("j"), F.col("cs").alias("y")), small[1]), ["h", "j"])
    found = found.withColumn("same", F.expr("g = h and i = j")).select("n_sources", "same", F.explode("x").alias("x"), "y").select("n_sources", "same", "x", F.explode("y").alias("y")).where("not same or x < y")
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n_sources")
    return found.select("a", "b", F.concat(F.lit("m2-"), F.substring(F.sha1(F.concat_ws("|", "a", "b")), 1, 12)).alias("concept_id"), "n_sources")


def composition_edges(found: DataFrame) -> DataFrame:
    members = found.select("concept_id", F.posexplode(F.array("a", "b")).alias("pos", "member"))
    return members.select(
        F.concat(F.lit("cmp-"), F.substring(F.sha1(F.concat(F.col("member"), F.lit("->"), F.col("concept_id"))), 1, 12)).alias("edge_id"),
        F.col("member").alias("src_id"), F.col("concept_id").alias("dst_id"), F.lit("composes").alias("edge_type"),
        F.concat(F.lit("member:"), F.col("pos") + 1).alias("semantic_role"),
    )


def domain_partials(claims: DataFrame, *, domain: str = "domain", salience: bool = True) -> DataFrame:
    """(domain, concept_id, n_claims, n_sources): a canon of each domain by itself, salience within the
    domain, as rows that ``merge_domains`` adds up."""
    c = coordinates(claims, salience=salience, by=(domain,) if salience else ())
    return c.groupBy(F.col(domain).alias("domain"), "concept_id").agg(F.countDistinct("item_id").alias("n_claims"), F.countDistinct("source_urn").alias("n_sources"))


def merge_domains(partials: DataFrame) -> DataFrame:
    """One row for each concept out of rows for each domain: (concept_id, n_domains, n_sources, n_claims, domains)."""
    return partials.groupBy("concept_id").agg(F.countDistinct("domain").alias("n_domains"), F.sum("n_sources").alias("n_sources"), F.sum("n_claims").alias("n_claims"), F.array_sort(F.collect_set("domain")).alias("domains"))
