"""Text, slug, stem and identifier expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark import profiles

WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}]+"
DIGRAPHS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa"}


def _accents() -> tuple[str, str]:
    """Letters that decompose into a basic one and accents, with that basic one."""
    pairs = {}
    for c in map(chr, range(0xC0, 0x250)):
        low = c.lower()
        if len(low) == 1 and low not in DIGRAPHS:
            base = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
            if len(base) == 1 and base != low:
                pairs[low] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: an expression named twice is else computed twice,
    and once for each element if a lambda names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def absent(c: Column | str) -> Column:
    """NULL for blank strings; the literal 'null' stays what it is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def clean_text(c: Column) -> Column:
    """Without control characters, but for tabs and line feeds."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters and digits of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)


def transliterate(c: Column) -> Column:
    """Digraphs first (ü is ue), then accents off."""
    out = F.lower(text(c))
    for letter, pair in DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.regexp_replace(F.translate(out, ACCENTED, PLAIN), r"\p{M}", "")


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(c: Column, size: int = 48) -> Column:
    """Coordinates' slug: umlauts split words (für is f-r)."""
    return F.substring(_dashed(F.lower(text(c))), 1, size)


def term_slug(c: Column) -> Column:
    return _dashed(transliterate(c))


def seed_slug(c: Column, size: int = 60) -> Column:
    return F.substring(term_slug(c), 1, size)


def source_slug(c: Column) -> Column:
    return F.substring(_dashed(F.lower(text(c))), 1, 80)


def source_urn(stem: Column, namespace: str) -> Column:
    return F.concat(F.lit(f"urn:{namespace}:"), source_slug(stem))


def suffix_stem(word: Column) -> Column:
    """Off goes the first of es, en, e, s that leaves four letters."""
    low = F.lower(word)
    out = low
    for suffix in ("s", "e", "en", "es"):
        fits = F.endswith(low, F.lit(suffix)) & (F.length(low) >= 4 + len(suffix))
        out = F.when(fits, F.substring(low, F.lit(1), F.length(low) - len(suffix))).otherwise(out)
    return out


def stem_word(word: Column) -> Column:
    return F.when(F.length(word) < 4, F.lower(word)).otherwise(suffix_stem(word))


def normalize_slug(c: Column) -> Column:
    """Every word of a slug stemmed."""
    return F.array_join(F.filter(F.transform(F.split(text(c), "-+"), stem_word), lambda w: w != ""), "-")


def is_in(c: Column, words: Iterable[str]) -> Column:
    return c.isin(sorted(words))


def strip_edges(phrase: Column, words: Iterable[str]) -> Column:
    """The phrase without function words at either end, single blanks between its words."""

    def cut(parts: Column) -> Column:
        kept = F.filter(F.transform(parts, lambda w, i: F.when(~is_in(F.lower(w), words), i)), lambda i: i.isNotNull())
        return bind(kept, lambda k: F.when(F.size(k) > 0, F.array_join(F.slice(parts, k[0] + 1, F.element_at(k, -1) - k[0] + 1), " ")).otherwise(F.lit("")))

    return bind(F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: w != ""), cut)


QUOTED = "[‘'\"“„«‹]([^’'\"”“»›]{2,60})[’'\"”“»›]"
CAPS = r"(?<![\p{L}\p{N}_])(\p{L}[\p{L}\p{N}_-]*(?:\s+[A-ZÄÖÜ][\p{L}\p{N}_-]*){1,3})"
CONTENT = r"\p{L}{4,}"
TERM = "struct<term:string,quoted:boolean>"
#: What every match of the two holds; short searches that turn nearly all texts away.
MAY_QUOTE, MAY_CAPS = "[‘'\"“„«‹]", r"\s[A-ZÄÖÜ]"


def is_glob(c: Column) -> Column:
    """Words that ran together: 35 characters without a hyphen."""
    return c.rlike("[^-]{35,}")


def candidate_terms(c: Column) -> Column:
    """(term, quoted) of quoted terms and capitalised phrases, each slug once, quoted first."""
    words = profiles.CANON_WORDS
    quoted = F.transform(F.regexp_extract_all(text(c), F.lit(QUOTED), F.lit(1)), lambda x: slug(strip_edges(x, words)))
    phrases = F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(CAPS), F.lit(1)), lambda x: strip_edges(x, words)), lambda x: F.instr(x, " ") > 0)
    caps = F.transform(phrases, lambda x: slug(x))
    fine = lambda x: (x != "") & ~is_in(x, words) & ~is_glob(x)
    flag = lambda value: lambda x: F.struct(x.alias("term"), F.lit(value).alias("quoted"))
    return bind(F.array_distinct(F.filter(quoted, fine)), lambda first: F.concat(F.transform(first, flag(True)), F.transform(F.array_except(F.filter(caps, fine), first), flag(False))))


def longest(c: Column, descending_ties: bool = False) -> Column:
    """The longest string of an array; of equals the least (or greatest)."""
    if descending_ties:
        return F.array_max(F.transform(c, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.array_min(F.transform(c, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]


def key_term(c: Column) -> Column:
    """A claim's subject: the first quoted term, else the longest capitalised phrase, else the longest
    word that is no function word; "" if there is none."""
    words = profiles.CANON_WORDS
    quoted = F.when(text(c).rlike(MAY_QUOTE), slug(strip_edges(F.regexp_extract(text(c), QUOTED, 1), words))).otherwise(F.lit(""))
    phrases = F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(CAPS), F.lit(1)), lambda x: strip_edges(x, words)), lambda x: F.instr(x, " ") > 0)
    caps = F.when(text(c).rlike(MAY_CAPS), slug(longest(phrases, descending_ties=True))).otherwise(F.lit(""))
    token = slug(longest(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit(CONTENT), F.lit(0)), lambda x: ~is_in(x, words))))
    usable = lambda x: bind(x, lambda v: F.when((v != "") & ~is_in(v, words), v))
    return F.coalesce(usable(quoted), usable(caps), token, F.lit(""))


def quantification(sentence: Column, profile: profiles.Profile) -> Column:
    """The first quantity of which a cue stands in the sentence, else 'null'."""
    low, out = F.lower(sentence), F.lit("null")
    for value, cues in reversed(profile.cues):
        hit = F.lit(False)
        for cue in cues:
            hit = hit | F.contains(low, F.lit(cue))
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def marker_pattern(pattern: str) -> str:
    """A marker between word boundaries, for lower-case text."""
    low = pattern.lower()
    left = rf"(?<!{WORD})" if low[:1].isalnum() else ""
    right = rf"(?!{WORD})" if low[-1:].isalnum() else ""
    return left + r"\Q" + low + r"\E" + right


def mention_pattern(label: str) -> str:
    """A label between word boundaries, any blanks inside, a plural s allowed."""
    return rf"(?i)(?<!{WORD})" + r"\s+".join(r"\Q" + p.replace("\\E", "") + r"\E" for p in label.split()) + rf"s?(?!{WORD})"


def edge_id(src: Column, dst: Column) -> Column:
    return F.concat(F.lit("grd-"), F.substring(F.sha1(F.concat(src, F.lit("->"), dst)), 1, 12))


def item_id(urn: Column, start: Column, end: Column, predicate: Column) -> Column:
    return F.concat(F.lit("item-"), F.substring(F.sha1(F.concat(urn, F.lit("["), start, F.lit(", "), end, F.lit("]"), predicate)), 1, 10))


def year_from_text(c: Column, latest: int) -> Column:
    """The latest year from 1500 to ``latest`` that stands in the text by itself."""
    years = F.transform(F.regexp_extract_all(text(c), F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(1500, latest)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector's norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda v: dot(v["a"], v["b"]) / (norm(v["a"]) * norm(v["b"])))


def hashing_embedding(c: Column, dim: int = 64) -> Column:
    """Token counts by SHA-1 modulo a power of two up to 256."""
    slots = F.transform(tokenize(c), lambda t: F.pmod(F.conv(F.substring(F.sha1(t), 39, 2), 16, 10).cast("int"), F.lit(dim)))
    count = lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(all_, lambda s: s == i)).cast("double"))
    return bind(slots, count)


def norm_path(c: Column) -> Column:
    """Leading dots and slashes off."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^[./]+", "")


def fully_unquoted(url: Column, rounds: int = 5) -> Column:
    """URL-decoded until nothing changes (or so many times)."""
    for _ in range(rounds):
        url = F.coalesce(F.try_url_decode(url), url)
    return url


def identifier_urn(c: Column, profile: profiles.Profile) -> Column:
    """urn:namespace:scheme:id by the first scheme that matches, else NULL."""
    found = []
    for scheme in profile.schemes:
        got = F.regexp_extract(text(c), profiles.SCHEMES[scheme], 1)
        found.append(F.when(got != "", F.concat(F.lit(f"urn:{profile.namespace}:{scheme}:"), F.lower(got))))
    return F.coalesce(*found, F.lit(None).cast("string"))


def url_urn(url: Column, namespace: str) -> Column:
    """A placeholder identity of host and path."""
    parts = F.concat(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.lit("-"), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.concat(F.lit(f"urn:{namespace}:url:"), F.substring(_dashed(F.lower(parts)), 1, 80))


def canonical_json(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of strings with sorted keys and no blanks."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(pairs)]), {"ignoreNullFields": "false"})
