"""Units, sentences, claims and definitions out of text, by expressions alone: no UDF, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.profiles import DEFAULT_DIMENSION, Profile

ARTICLE = r"(?m)^\s*(?:Article|Artikel)\s+(\d+[a-z]?)(?![\p{L}\p{N}_])"
RECITAL = r"(?m)^\s*\((\d{1,3})\)\s"
BREAK = r"\n\s*\n"
MIN_PARAGRAPH, MIN_SENTENCE, MAX_SENTENCE = 40, 8, 400
STRIP = ("the", "a", "an", "and", "or", "by", "of", "to", "for", "such", "any")
JOINERS = ("and", "by", "for", "of", "or", "to")


SUMMED = 256


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, k: a + k)


def with_offsets(sizes: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body(offset), where offset(i) is the sum of the first i sizes.

    Sums of blocks are made first, so that an offset adds up a block's sizes at most: many pieces of a
    long text don't cost their square.
    """

    def summed(sizes: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(sizes) / SUMMED).cast("int"))
        blocks = F.transform(numbers, lambda b: _total(F.slice(sizes, b * SUMMED + 1, F.lit(SUMMED))))
        before = X.bind(blocks, lambda bs: F.transform(bs, lambda _, b: _total(F.slice(bs, F.lit(1), b))))
        at = lambda before: lambda i: F.get(before, F.floor(i / SUMMED).cast("int")) + _total(F.slice(sizes, (F.floor(i / SUMMED) * SUMMED + 1).cast("int"), (i % SUMMED).cast("int")))
        return X.bind(before, lambda b: body(at(b)))

    return X.bind(sizes, summed)


def _starts(pieces: Column, gaps: Column | None = None) -> Column:
    """Where each piece begins, given the pieces and what stood between them."""
    sizes = F.transform(pieces, F.length)
    if gaps is not None:
        sizes = F.zip_with(sizes, F.transform(gaps, F.length), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return with_offsets(sizes, lambda offset: F.transform(pieces, lambda _, i: offset(i)))


def _headed(c: Column, pattern: str, kind: str, prefix: str) -> Column:
    """Units from one match of a heading to the next."""
    pieces = F.split(c, r"(?m)(?<!\n[^\S\n]{0,99}\n)(?<!\A\s{1,99})(?=" + pattern.removeprefix("(?m)") + ")")
    at = _starts(pieces)
    rows = F.zip_with(pieces, at, lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    rows = F.filter(rows, lambda r: F.regexp_extract(r["p"], r"\A" + pattern.removeprefix("(?m)^"), 1) != "")
    return F.transform(
        rows,
        lambda r: F.struct(
            F.concat(F.lit(prefix), F.regexp_extract(r["p"], r"\A" + pattern.removeprefix("(?m)^"), 1)).alias("unit_id"),
            F.lit(kind).alias("unit_type"), r["s"].cast("int").alias("start"),
            (r["s"] + F.length(r["p"])).cast("int").alias("end"), _strip(r["p"]).alias("text"),
        ),
    )


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def units_of(c: Column) -> Column:
    """Units of a text as an array: articles if there are three headings, else recitals if there are
    five, else paragraphs of 40 characters or more."""
    def paragraphs(pieces: Column, gaps: Column) -> Column:
        rows = F.zip_with(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"), _strip(p).alias("t"))), _starts(pieces, gaps), lambda p, s: F.struct(p["p"].alias("p"), p["i"].alias("i"), p["t"].alias("t"), s.alias("s")))
        return F.transform(
            F.filter(rows, lambda r: F.length(r["t"]) >= MIN_PARAGRAPH),
            lambda r: F.struct(
                F.concat(F.lit("para-"), r["i"]).alias("unit_id"), F.lit("paragraph").alias("unit_type"), r["s"].cast("int").alias("start"),
                (r["s"] + F.length(r["p"])).cast("int").alias("end"), r["t"].alias("text"),
            ),
        )

    def of(c: Column) -> Column:
        # a plain search turns nearly all texts away before a heading is counted
        articles = F.contains(c, F.lit("Arti")) & (F.regexp_count(c, F.lit(ARTICLE)) >= 3)
        recitals = F.contains(c, F.lit("(")) & (F.regexp_count(c, F.lit(RECITAL)) >= 5)
        by_break = X.bind(F.struct(F.split(c, BREAK).alias("p"), F.regexp_extract_all(c, F.lit(BREAK), F.lit(0)).alias("g")), lambda x: paragraphs(x["p"], x["g"]))
        return F.when(articles, _headed(c, ARTICLE, "article", "Article-")).when(recitals, _headed(c, RECITAL, "recital", "Recital-")).otherwise(by_break)

    return X.bind(X.text(c), of)


def units(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit_id, unit_type, start, end, text), one row for each unit."""
    return docs.select(key, F.explode(units_of(F.col(text))).alias("u")).select(key, "u.*")


def first_markers(low: Column, profile: Profile) -> Column:
    """For each predicate the first marker, in profile order, that stands in the lower-case sentence.

    One pattern of all markers turns most sentences away before any is looked for by itself.
    """
    found = []
    for predicate in dict.fromkeys(m.predicate for m in profile.markers):
        hit = F.lit(None)
        for m in reversed([m for m in profile.markers if m.predicate == predicate]):
            seen = F.contains(low, F.lit(m.pattern.lower())) & low.rlike(X.marker_pattern(m.pattern))
            row = F.struct(
                F.lit(m.ord).alias("ord"), F.lit(m.pattern).alias("marker"), F.lit(m.predicate).alias("predicate"),
                F.lit(m.modality).alias("modality"), F.lit("N" if m.modality in profile.normative else "D").alias("polarity"),
                F.lit(profile.dimension_for(m.predicate)).alias("dimension"),
            )
            hit = F.when(seen, row).otherwise(hit)
        found.append(hit)
    bare = [m.pattern.lower() for m in profile.markers]
    if all(p[:1].isalnum() and p[-1:].isalnum() for p in bare):
        some = low.rlike(rf"(?<!{X.WORD})(?:" + "|".join(r"\Q" + p + r"\E" for p in bare) + rf")(?!{X.WORD})")
    else:
        some = low.rlike("|".join(X.marker_pattern(p) for p in bare))
    return F.when(some, F.filter(F.array(*found), lambda m: m.isNotNull()))


def marked_sentences(unit: Column, profile: Profile) -> Column:
    """(s, e, sentence, m) of the sentences of a unit in which markers stand; m are their first markers.

    A sentence is what stands between full stops, with the one that ends it. Offsets are summed for
    marked sentences only.
    """

    def of(bodies: Column) -> Column:
        n = F.size(bodies)
        seen = F.transform(bodies, lambda b, i: F.struct(i.alias("i"), b.alias("b"), X.bind(F.lower(b), lambda low: first_markers(low, profile)).alias("m")))
        marked = F.filter(seen, lambda x: x["m"].isNotNull() & (F.size(x["m"]) > 0))

        def placed(offset: Callable[[Column], Column]) -> Column:
            start = lambda i: (offset(i) + i).cast("int")
            return F.transform(marked, lambda x: X.bind(start(x["i"]), lambda s: F.struct(
                s.alias("s"), (s + F.length(x["b"]) + F.when(x["i"] < n - 1, 1).otherwise(0)).alias("e"),
                _strip(F.when(x["i"] < n - 1, F.concat(x["b"], F.lit("."))).otherwise(x["b"])).alias("sentence"), x["m"].alias("m"),
            )))

        return with_offsets(F.transform(bodies, F.length), placed)

    return X.bind(F.split(unit, r"\."), of)


def claims(docs: DataFrame, profile: Profile, *, key: str = "doc_id", text: str = "text", urn: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each predicate and sentence of which a marker stands in it, with closed axes.

    The urn names the source (the key as text by default); ``carry`` columns come along.
    """
    base = docs.withColumn("source_urn", urn if urn is not None else F.col(key).cast("string"))
    u = base.select("source_urn", *carry, F.explode(units_of(F.col(text))).alias("u")).select("source_urn", *carry, "u.unit_id", "u.unit_type", "u.start", "u.text")
    s = u.select("source_urn", *carry, "unit_id", "unit_type", "start", F.explode(marked_sentences(F.col("text"), profile)).alias("x")).select("source_urn", *carry, "unit_id", "unit_type", "start", "x.*")
    m = s.where(F.length("sentence") >= MIN_SENTENCE).withColumn("m", F.explode("m"))
    start, end = F.col("start") + F.col("s"), F.col("start") + F.col("e")
    return m.select(
        X.item_id(F.col("source_urn"), start, end, F.col("m.predicate")).alias("item_id"), "source_urn", *carry, "unit_id", "unit_type",
        start.alias("span_start"), end.alias("span_end"), F.col("m.marker").alias("marker"), F.substring("sentence", 1, MAX_SENTENCE).alias("text"),
        F.col("m.polarity").alias("polarity"), F.when(F.col("m.polarity") == "D", "is").otherwise("ought").alias("type"),
        F.col("m.predicate").alias("predicate"), F.col("m.modality").alias("modality"), X.quantification(F.col("sentence"), profile).alias("quantification"),
        F.lit(None).cast("string").alias("principle"), F.lit("null").alias("judicial_canon"), F.lit("unspecified").alias("inference_rule"),
        F.lit(None).cast("string").alias("confidence"), F.lit("candidate").alias("verification"), F.lit(profile.id).alias("profile"),
        F.coalesce(F.col("m.dimension"), F.lit(DEFAULT_DIMENSION)).alias("dimension"),
    )


def clean_term(raw: Column) -> Column:
    """A term without stopwords at its edges; NULL if nothing is left, it has more than four words or
    ends in a joiner."""
    parts = F.split(F.regexp_replace(F.trim(raw), r"\s+", " "), " ")
    numbered = F.transform(parts, lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i")))
    lo = F.array_min(F.transform(F.filter(numbered, lambda x: ~X.is_in(x["w"], STRIP)), lambda x: x["i"]))
    trailing = [w for w in STRIP if w not in JOINERS]
    hi = F.array_max(F.transform(F.filter(numbered, lambda x: ~X.is_in(x["w"], trailing)), lambda x: x["i"]))
    kept = F.slice(parts, lo + 1, hi - lo + 1)
    fine = lo.isNotNull() & (F.size(kept) <= 4) & ~X.is_in(F.lower(F.element_at(kept, -1)), JOINERS)
    return F.when(fine, F.array_join(kept, " "))


def definitions(docs: DataFrame, profile: Profile, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(source_urn, term, term_slug): quoted terms before a definitional verb, the first of each slug."""
    if not profile.verbs:
        return docs.limit(0).select(F.col(key).cast("string").alias("source_urn"), F.lit("").alias("term"), F.lit("").alias("term_slug"), F.lit(0).alias("span_start"), F.lit(0).alias("span_end"))
    verbs = "|".join(r"\Q" + v + r"\E" for v in sorted(profile.verbs, key=len, reverse=True))
    quoted = rf"(?iU)[‘'\"“]([A-Za-zÄÖÜäöüß][\w .\-]{{2,40}}?)[’'\"”]\s+(?:{verbs})\b"
    # the text up to each match, so that spans are known
    hits = F.regexp_extract_all(X.text(text), F.lit(quoted), F.lit(0))
    walked = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,hit:string>>").alias("out")),
        lambda acc, h: F.struct(
            (F.call_function("locate", h, X.text(text), acc["at"] + 1) + F.length(h) - 1).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct((F.call_function("locate", h, X.text(text), acc["at"] + 1) - 1).cast("int").alias("at"), h.alias("hit")))).alias("out"),
        ),
    )
    rows = docs.select(F.col(key).cast("string").alias("source_urn"), F.posexplode(walked["out"]).alias("n", "h"))
    raw = F.regexp_extract("h.hit", quoted, 1)
    found = rows.select("source_urn", "n", clean_term(raw).alias("term"), (F.col("h.at") + 1).alias("span_start"), (F.col("h.at") + 1 + F.length(raw)).alias("span_end"))
    slugged = found.where("term is not null").withColumn("term_slug", X.term_slug(F.col("term"))).where("term_slug <> ''")
    return slugged.groupBy("source_urn", "term_slug").agg(F.min(F.struct("n", "term", "span_start", "span_end")).alias("f")).select("source_urn", "f.term", "term_slug", "f.span_start", "f.span_end")


def line_text(glyphs: Column) -> Column:
    """A PDF line's text from its glyphs (x0, x1, size, text), with blanks where the gap stands out
    from the line's own: its 35 % lowest gap plus the larger of 0.45 points and 5 % of the glyph size."""
    row = F.array_sort(glyphs)
    n = F.size(row)
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(row, i + 1)["x0"] - F.element_at(row, i)["x1"])
    low = F.element_at(F.array_sort(gaps), (F.floor(F.lit(0.35) * (n - 2)) + 1).cast("int"))
    sizes = F.array_sort(F.transform(row, lambda g: g["size"]))
    limit = low + F.greatest(F.lit(0.45), F.element_at(sizes, (F.floor(n / 2) + 1).cast("int")) * 0.05)
    spaced = F.transform(row, lambda g, i: F.when((i > 0) & (F.get(gaps, F.greatest(i - 1, F.lit(0))) > limit), F.concat(F.lit(" "), g["text"])).otherwise(g["text"]))
    return F.when(n < 2, F.array_join(F.transform(row, lambda g: g["text"]), "")).otherwise(F.array_join(spaced, ""))


def in_table(line: Column, boxes: Column) -> Column:
    """Whether a line's box (x0, top, x1, bottom) has its middle in a table's, or half of its height."""
    mid_x, mid_y = (line["x0"] + line["x1"]) / 2, (line["top"] + line["bottom"]) / 2
    height = F.greatest(line["bottom"] - line["top"], F.lit(1e-9))

    def inside(b: Column) -> Column:
        overlap = F.least(line["bottom"], b["bottom"]) - F.greatest(line["top"], b["top"])
        across = mid_x.between(b["x0"], b["x1"])
        return across & (mid_y.between(b["top"], b["bottom"]) | (overlap / height >= 0.5))

    return F.exists(boxes, inside)
