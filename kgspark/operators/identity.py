"""Who a document is: identity ladder, registry reuse, duplicates, years, evidence, wire checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.profiles import SCHEMES, Profile


FALLBACKS = ("content-sha256", "path-slug")
IDENTIFIER_TOKEN = "[0-9]{5}[a-z]{1,2}[0-9]{3,4}"


def ladder(name: Column, title: Column, digest: Column, profile: Profile) -> Column:
    """(urn, identifier, method, verification): an identifier scheme in the name or the title, else the
    title, else the content's digest, else (no bytes) the name without its suffix."""
    hay = F.concat_ws("\n", X.fully_unquoted(name), X.text(title))
    found = F.lit(None)
    for scheme in reversed(profile.schemes):
        got = F.regexp_replace(F.lower(F.regexp_extract(hay, SCHEMES[scheme], 1)), r"\.+$", "")
        found = F.when(got != "", F.struct(F.lit(scheme).alias("method"), got.alias("id"), F.lit(scheme).alias("kind"), F.lit("metadata").alias("how"))).otherwise(found)
    has_title, stem = F.trim(X.text(title)) != "", F.regexp_replace(name, r"\.[^.]+$", "")
    row = lambda method, ident, kind, how: F.struct(F.lit(method).alias("method"), ident.alias("id"), F.lit(kind).alias("kind"), F.lit(how).alias("how"))
    chosen = F.coalesce(
        found, F.when(has_title, row("pdf-title", X.source_slug(title), "source", "metadata")), F.when(X.text(digest) != "", row("content-sha256", digest, "sha256", "content")),
        row("path-slug", X.source_slug(stem), "", "filename"),
    )
    return X.bind(chosen, lambda c: F.struct(F.concat_ws(":", F.lit("urn"), F.lit(profile.namespace), F.nullif(c["kind"], F.lit("")), c["id"]).alias("urn"), c["id"].alias("identifier"), c["method"].alias("method"), c["how"].alias("verification")))


def escalated(rows: DataFrame, resolver: Callable[[list[dict]], list[dict | None]]) -> DataFrame:
    """rows (name, title, ident as the ladder's struct) in which only identities of the fallback rungs are
    put to the resolver, in batches; what it can't tell stays."""
    hard = rows.where(F.col("ident.method").isin(*FALLBACKS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = resolver([{"name": n, "title": t} for n, t in zip(b["name"], b["title"])])
            for (k, row), found in zip(enumerate(b["ident"]), told):
                if found and found.get("urn"):
                    b.at[b.index[k], "ident"] = {**row, "urn": found["urn"], "identifier": found.get("identifier", ""), "method": found.get("method", "ladder"), "verification": "metadata"}
            yield b

    return rows.where(~F.col("ident.method").isin(*FALLBACKS)).unionByName(hard.mapInPandas(run, hard.schema))


def level(method: Column) -> Column:
    """How strong an identity is: that of a scheme is canonical."""
    return F.when(method == "content-sha256", "content").when(method == "pdf-title", "title").when(method == "path-slug", "filename").otherwise("canonical")


def reuse(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (relpath) with canonical_urn by path, else by a file name that only one urn has."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    path = X.norm_path(F.col("relpath"))
    by_path = registry.groupBy(X.norm_path(F.col("relpath")).alias("_p")).agg(F.min("canonical_urn").alias("_u"))
    by_name = registry.groupBy(base(F.col("relpath")).alias("_f")).agg(F.min("canonical_urn").alias("_v"), F.countDistinct("canonical_urn").alias("_n")).where("_n = 1").drop("_n")
    out = files.withColumn("_p", path).withColumn("_f", base(F.col("relpath"))).join(by_path, "_p", "left").join(by_name, "_f", "left")
    return out.withColumn("canonical_urn", F.coalesce("_u", "_v")).withColumn("provenance", F.when(F.col("_u").isNotNull(), "path").when(F.col("_v").isNotNull(), "filename")).drop("_p", "_f", "_u", "_v")


def missing(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(relpath, ord) of files that nothing in the registry names, each at its first place."""
    gone = reuse(files, registry).where("canonical_urn is null")
    return gone.groupBy("relpath").agg(F.min("ord").alias("ord"))


def resolve(files: DataFrame, registry: DataFrame, paired: DataFrame, folder: DataFrame, profile: Profile) -> DataFrame:
    """files with (canonical_urn, provenance): registry, then the paired sidecar, then one of the
    folder, then a new one from the path."""
    out = reuse(files, registry).withColumnRenamed("canonical_urn", "_r").drop("provenance")
    out = out.join(paired.select(F.col("relpath"), F.col("canonical_urn").alias("_s")), "relpath", "left").join(folder.select(F.col("relpath"), F.col("canonical_urn").alias("_f")), "relpath", "left")
    minted = X.source_urn(F.col("relpath"), profile.namespace)
    how = F.when(F.col("_r").isNotNull(), "kg-registry").when(F.col("_s").isNotNull(), "kg-canonical").when(F.col("_f").isNotNull(), "kg-sidecar").otherwise("minted")
    return out.withColumn("canonical_urn", F.coalesce("_r", "_s", "_f", minted)).withColumn("provenance", how).drop("_r", "_s", "_f")


def sidecar_matches(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(name, canonical_urn): the first sidecar (by ``ord``) whose urn holds an identifier token of the
    file's name; else the first of whose title's words of five letters and more a third, and two at
    least, stand in the name.

    Tokens meet in an equi-join of tokens of both sides. Words may stand within a name's words, so all
    pieces of a name that are as long as some word meet the words themselves: only true hits are joined.
    """
    low = lambda c: F.lower(X.fully_unquoted(c))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(IDENTIFIER_TOKEN), F.lit(0)))
    names = files.select("name", low(F.col("name")).alias("low"))
    a = names.select("name", F.explode(tokens(F.col("low"))).alias("w"))
    # a urn's tokens may overlap: all pieces of a token's length that are one are looked at
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    parts = F.array_distinct(F.filter(F.flatten(F.array(*[pieces(F.lower("canonical_urn"), n) for n in (9, 10, 11)])), lambda x: x.rlike(f"^{IDENTIFIER_TOKEN}$")))
    b = sidecars.select("ord", "canonical_urn", F.explode(parts).alias("w"))
    by_token = a.join(b, "w").select("name", F.lit(0).alias("rung"), "ord", "canonical_urn")
    words = F.filter(F.split(F.lower(X.text("title")), "[^a-z0-9]+"), lambda w: F.length(w) > 4)
    titled = sidecars.select("ord", "canonical_urn", words.alias("ws")).where(F.size("ws") > 0)
    heads = titled.select("ord", "canonical_urn", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "word"))
    longest = names.agg(F.max(F.length("low"))).first()[0] or 0
    sizes = sorted(r[0] for r in heads.select(F.length("word").alias("n")).where(F.col("n") <= longest).distinct().collect())
    runs = F.filter(F.split("low", "[^a-z0-9]+"), lambda w: F.length(w) > 4)
    cuts = F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: F.flatten(F.transform(runs, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n)))))
    spots = names.select("name", F.explode(F.array_distinct(F.flatten(cuts))).alias("word"))
    hits = spots.join(heads, "word").groupBy("name", "ord", "canonical_urn", "n").agg(F.countDistinct("pos").alias("k"))
    by_title = hits.where(F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3))).select("name", F.lit(1).alias("rung"), "ord", "canonical_urn")
    best = by_token.unionByName(by_title).groupBy("name").agg(F.min(F.struct("rung", "ord", "canonical_urn")).alias("f"))
    return best.select("name", F.col("f.canonical_urn").alias("canonical_urn"))


def capture(files: DataFrame) -> DataFrame:
    """files (path, sha1) with ``status``: the first path of each content is admitted."""
    n = F.row_number().over(W.partitionBy("sha1").orderBy("path"))
    return files.withColumn("status", F.when(n == 1, "admitted").otherwise("duplicate"))


def validated(files: DataFrame) -> DataFrame:
    """files (path, suffix, size, text, is_dir) with ``code``: why a source can't be admitted, or NULL."""
    text_like = F.col("suffix").isin("md", "txt")
    code = (
        F.when(F.col("size").isNull(), "source_not_found").when(F.col("is_dir"), "source_not_file").when(~F.col("suffix").isin("pdf", "md", "txt") | F.col("suffix").isNull(), "unsupported_type")
        .when(text_like & F.col("text").isNull(), "unreadable_source").when(text_like & (F.trim(F.regexp_replace("text", r"\s+", " ")) == ""), "empty_source").when(~text_like & (F.col("size") == 0), "empty_source")
    )
    return files.withColumn("code", code)


def dedup(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (path, urn, sha1, sha256, title) against registry (urn, sha1, title), with ``status``,
    ``reason`` and the ``urn`` under which each is kept.

    Equal bytes are a duplicate. The same urn or title over other bytes is another source: it is kept
    under its content's digest. Files that come together count too, in the order of their paths.
    """
    title = lambda c: F.nullif(F.lower(F.trim(X.text(c))), F.lit(""))
    old = registry.select(F.lit(0).alias("_new"), F.lit("").alias("path"), "urn", "sha1", F.lit(None).cast("string").alias("sha256"), "title")
    both = old.unionByName(files.select(F.lit(1).alias("_new"), "path", "urn", "sha1", "sha256", "title")).withColumn("_t", title("title"))
    order = [F.col("_new"), F.col("path"), F.col("sha1")]
    n = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    seen = both.withColumn("_h", (n("sha1") > 1) & F.col("sha1").isNotNull()).withColumn("_u", n("urn") > 1).withColumn("_l", (n("_t") > 1) & F.col("_t").isNotNull()).where("_new = 1")
    status = F.when(F.col("_h"), "duplicate").when(F.col("_u") | F.col("_l"), "re-identified").otherwise("admitted")
    urn = F.when(~F.col("_h") & (F.col("_u") | F.col("_l")), F.concat(F.lit("sha256:"), "sha256")).otherwise(F.col("urn"))
    return seen.select("path", status.alias("status"), F.when(F.col("_h"), "duplicate_hash").when(F.col("_u"), "duplicate_urn").when(F.col("_l"), "duplicate_title").alias("reason"), urn.alias("urn"))


def stubs(rows: DataFrame, latest: int = 2100) -> DataFrame:
    """(stub, note, sidecar) of admitted sources (urn, identifier, method, title, verification, name)."""
    year = X.year_from_text(F.col("name"), latest).cast("string")
    base = F.concat_ws("-", year, F.coalesce(F.nullif(F.substring(X.source_slug(F.col("title")), 1, 60), F.lit("")), F.col("identifier")))
    note = F.concat(F.lit("# "), "title", F.lit("\n\n- urn: "), "urn", F.lit("\n- identifier: "), "identifier", F.lit("\n- file: "), "name", F.lit("\n- verified by: "), "verification", F.lit("\n"))
    sidecar = F.struct(F.col("urn").alias("canonical_urn"), "identifier", F.col("method").alias("identity_method"), F.col("name").alias("source_file"), "title", "verification")
    return rows.select(F.concat(base, F.lit(".md")).alias("stub"), note.alias("note"), F.to_json(sidecar).alias("sidecar"))


def provenance(ledger: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """(artifact, outcome, reason, urn, level) of a provenance pass: ledger rows (ord, artifact, urn,
    method, status) that were acquired or registered and whose files (artifact, size, magic, suffix) are
    there. Broken files fail and are to be moved aside; a urn that a sidecar (known: urn, artifact) or an
    earlier row has is a duplicate; a sidecar of its own leaves it unchanged."""
    rows = ledger.where(F.col("status").isin("acquired", "registered")).join(files, "artifact")
    broken = F.when(F.col("size").isNull(), "unreadable").when(F.col("size") == 0, "empty").when((F.col("suffix") == "pdf") & ~F.startswith("magic", F.lit("%PDF")), "not-a-pdf")
    judged = rows.withColumn("reason", broken).join(known.groupBy("urn").agg(F.min("artifact").alias("_owner")), "urn", "left")
    fine = judged.where("reason is null").withColumn("_n", F.row_number().over(W.partitionBy("urn").orderBy("ord")))
    outcome = F.when(F.col("_owner") == F.col("artifact"), "unchanged").when(F.col("_owner").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("registered")
    failed = judged.where("reason is not null").select("artifact", F.lit("failed").alias("outcome"), "reason", "urn", F.lit(None).cast("string").alias("level"))
    return failed.unionByName(fine.select("artifact", outcome.alias("outcome"), "reason", "urn", level(F.col("method")).alias("level")))


def review_plan(ledger: DataFrame, inbox: DataFrame, review: DataFrame) -> DataFrame:
    """(artifact, outcome) of routing to the review queue: both the file and its sidecar (artifact,
    has_file, has_sidecar) must be there; a file that is in the queue already only fetches its sidecar."""
    rows = ledger.where(F.col("status").isin("registered", "review")).select("artifact").where(X.text("artifact") != "")
    there = review.select("artifact", F.col("has_file").alias("_rf"), F.col("has_sidecar").alias("_rs"))
    out = rows.join(inbox, "artifact", "left").join(there, "artifact", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = F.when(yes("_rf") & (yes("_rs") | yes("has_sidecar")), "already_routed").when(yes("_rf"), "skipped_no_sidecar").when(yes("has_file") & yes("has_sidecar"), "routed").otherwise("skipped_no_sidecar")
    return out.select("artifact", outcome.alias("outcome"))


def consolidation_plan(listing: DataFrame) -> DataFrame:
    """(path, name, size, action, has_sidecar) of a folder's files (path, size), none of them moved;
    hidden and infrastructure parts ("." or "_" first) are left out, sidecars go with their files."""
    name = F.element_at(F.split("path", "/"), -1)
    seen = listing.where(~F.exists(F.split("path", "/"), lambda p: p.rlike("^[._]")))
    side = seen.where(F.endswith("path", F.lit(".metadata.json"))).select(F.regexp_replace("path", r"\.metadata\.json$", "").alias("path"), F.lit(True).alias("_s")).distinct()
    files = seen.where(~F.endswith("path", F.lit(".metadata.json")))
    return files.join(side, "path", "left").select("path", name.alias("name"), "size", F.lit("acquire").alias("action"), F.coalesce("_s", F.lit(False)).alias("has_sidecar"))


def pair_plan(files: DataFrame, stubs: DataFrame) -> DataFrame:
    """(name, status, canonical_urn) of files (name, sha1) that arrive for citation stubs (ord,
    canonical_urn, title, identifier, held_name, held_sha1): by identifier in the name, else by title.
    Several stubs are ambiguous; a stub that has bytes takes no others."""
    low = F.lower("name")
    ids = stubs.where(X.text("identifier") != "").select("canonical_urn", F.lower("identifier").alias("w"))
    tokens = F.array_distinct(F.filter(F.split(F.regexp_replace(low, r"\.[a-z0-9]+$", ""), "[^a-z0-9.-]+"), lambda w: w != ""))
    by_id = files.select("name", F.explode(tokens).alias("w")).join(ids, "w").select("name", "canonical_urn", F.lit(0).alias("rung")).distinct()
    by_title = sidecar_matches(files, stubs).select("name", "canonical_urn", F.lit(1).alias("rung"))
    best = by_id.unionByName(by_title).groupBy("name", "rung").agg(F.collect_set("canonical_urn").alias("us")).groupBy("name").agg(F.min(F.struct("rung", "us")).alias("m"))
    out = files.join(best, "name", "left").withColumn("canonical_urn", F.when(F.size("m.us") == 1, F.get("m.us", F.lit(0))))
    out = out.join(stubs.select("canonical_urn", "held_name", "held_sha1"), "canonical_urn", "left")
    status = (
        F.when(F.octet_length("name") > 240, "name-too-long").when(F.col("m").isNull(), "no-match").when(F.size("m.us") > 1, "ambiguous")
        .when(X.text("held_sha1") == "", "pair").when((F.col("held_sha1") == F.col("sha1")) & (F.col("held_name") == F.col("name")), "already-filed").otherwise("already-paired")
    )
    return out.select("name", status.alias("status"), "canonical_urn")


def year_report(rows: DataFrame, latest: int) -> DataFrame:
    """(year_method, n) of stamping the year on all sidecars that have a urn."""
    return resolve_year(rows.where(X.text("canonical_urn") != ""), latest).groupBy("year_method").agg(F.count(F.lit(1)).alias("n"))


def library_conflicts(libraries: DataFrame) -> DataFrame:
    """(library_id, problem): empty ids or namespaces, and namespaces that several libraries use."""
    empty = libraries.where("coalesce(library_id, '') = '' or coalesce(urn_namespace, '') = ''").select("library_id", F.lit("empty id or namespace").alias("problem"))
    shared = libraries.where("coalesce(urn_namespace, '') <> ''").groupBy("urn_namespace").agg(F.collect_set("library_id").alias("ids")).where(F.size("ids") > 1)
    return empty.unionByName(shared.select(F.explode("ids").alias("library_id"), F.lit("namespace is taken").alias("problem")))


def duplicate_families(files: DataFrame, key: str = "canonical_urn") -> DataFrame:
    """(key, path, keeper, n) of identities with several files; the shortest path, then the least, stays."""
    by = W.partitionBy(key)
    out = files.withColumn("n", F.count(F.lit(1)).over(by)).where("n > 1")
    first = F.row_number().over(by.orderBy(F.length("path"), "path"))
    return out.select(key, "path", (first == 1).alias("keeper"), "n")


def resolve_year(rows: DataFrame, latest: int) -> DataFrame:
    """rows with (year, year_method): of the identifier, the metadata (D:YYYY…), the title, the name."""
    fine = lambda y: F.when(y.between(1500, latest), y)
    ident = fine(F.expr("try_cast(id_year as int)"))
    meta = fine(F.expr("try_cast(nullif(regexp_extract(meta_date, '(\\\\d{4})', 1), '') as int)"))
    title, name = X.year_from_text(F.col("title"), latest), X.year_from_text(F.col("name"), latest)
    how = F.when(ident.isNotNull(), "canonical-id").when(meta.isNotNull(), "doc-metadata").when(title.isNotNull(), "title").when(name.isNotNull(), "filename").otherwise("undated")
    return rows.withColumn("year", F.coalesce(ident.cast("string"), meta.cast("string"), title.cast("string"), name.cast("string"), F.lit("undated"))).withColumn("year_method", how)


def admissible(content: Column, suffix: Column) -> Column:
    """Why a file can't be taken in, or NULL."""
    pdf = (suffix == "pdf") & (F.substring(F.hex(F.substring(content, 1, 4)), 1, 8) != "25504446")
    return F.when(F.length(content) == 0, "empty").when(pdf, "not-a-pdf").when(~suffix.isin("pdf", "md", "txt"), "unsupported")


def verify_evidence(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """refs (source_urn, start, end, digest) with ``valid``: known source, span inside, digest equal."""
    out = refs.join(sources.select("source_urn", F.col("text").alias("_t")), "source_urn", "left")
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("_t"))
    piece = F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start"))
    return out.withColumn("valid", F.coalesce(inside & (F.sha2(piece, 256) == F.col("digest")), F.lit(False))).drop("_t")


def slice_ledger(registry: DataFrame, indexed: DataFrame, *, domain: str = "") -> DataFrame:
    """registry rows of a domain with whether their bytes are there and how many claims they gave."""
    own = registry.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c) for c in registry.columns])), F.lit(domain.lower())))
    out = own.join(indexed.groupBy("canonical_urn").agg(F.count(F.lit(1)).alias("n_claims")), "canonical_urn", "left")
    return out.withColumn("status", F.when(F.col("n_claims").isNotNull(), "processable").otherwise("citation-only")).withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))


def inbox_audit(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, problem): rows without a file, files without a row."""
    rows = ledger.join(listing, "name", "left_anti").select("name", F.lit("no file").alias("problem"))
    return rows.unionByName(listing.join(ledger, "name", "left_anti").select("name", F.lit("no row").alias("problem")))


def acquire(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """incoming (name, urn, sha1) with ``status``: duplicate by content, known by urn with other bytes
    (an upgrade if the ledger has none), else new."""
    by_sha = ledger.where(X.text("sha1") != "").groupBy("sha1").agg(F.min("urn").alias("_u"))
    by_urn = ledger.groupBy("urn").agg(F.max(X.text("sha1")).alias("_s"))
    out = incoming.join(by_sha, "sha1", "left").join(by_urn, "urn", "left")
    status = F.when(F.col("_u").isNotNull(), "duplicate").when(F.col("_s") == "", "upgraded").when(F.col("_s").isNotNull(), "conflict").otherwise("new")
    return out.withColumn("status", status).drop("_u", "_s")


def wire_violation() -> Column:
    """Why a claim can't be a wire candidate, or NULL."""
    lo, hi = F.col("span_start"), F.col("span_end")
    span = (lo.isNull() != hi.isNull()) | (lo.isNotNull() & ~((lo >= 0) & (lo < hi)))
    return F.when(F.trim(X.text("source_urn")) == "", "no source identity").when(F.trim(X.text("item_id")) == "", "no item identity").when(F.trim(X.text("text")) == "", "empty text").when(span, "span incomplete or invalid")


WIRE_AXES = ("predicate", "modality", "quantification", "polarity", "domain")


def wire_candidates(claims: DataFrame, version: str) -> DataFrame:
    """(candidate_id, record) as JSON wire records of the claims that can be candidates; the version
    token has 1 to 256 characters. Axes without a value are left out."""
    if not 1 <= len(version.strip()) <= 256:
        raise ValueError("graph version has 1 to 256 characters")
    digest = F.when(F.contains("source_urn", F.lit(":sha256:")), F.concat(F.lit("sha256:"), F.substring_index("source_urn", ":sha256:", -1))).otherwise("")
    ref = F.struct("source_urn", "item_id", "span_start", "span_end", digest.alias("content_digest"), F.lit(version).alias("graph_version"))
    axes = F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in WIRE_AXES if c in claims.columns])
    fine = claims.where(wire_violation().isNull())
    return fine.select(F.col("item_id").alias("candidate_id"), F.to_json(F.struct(F.col("item_id").alias("candidate_id"), F.trim("text").alias("claim"), F.array(ref).alias("evidence"), axes.alias("axes"))).alias("record"))


def wire_request(claims: DataFrame, request_id: str, problem: str, version: str, *, required: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, part, n, capabilities, candidates): the request in parts of bounded size, each a list
    of wire records, as a request of all claims would be one object of any size."""
    rows = wire_candidates(claims, version).withColumn("part", F.pmod(F.xxhash64("candidate_id"), F.lit(max(1, -(-claims.count() // REQUEST_PART)))))
    full = F.forall(F.collect_list("record"), lambda r: F.get_json_object(r, "$.evidence[0].content_digest") != "")
    able = F.when(full, F.array(*map(F.lit, ("span-grounding", "structural-evidence", "content-digests")))).otherwise(F.array(*map(F.lit, ("span-grounding", "structural-evidence"))))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), able.alias("capabilities"), F.array_sort(F.collect_list("record")).alias("candidates")).select(F.lit(request_id).alias("request_id"), F.lit(problem).alias("problem"), F.array(*map(F.lit, required)).cast("array<string>").alias("required"), "part", "n", "capabilities", "candidates")


REQUEST_PART = 256


def result_violations(submitted: DataFrame, decisions: DataFrame) -> DataFrame:
    """(candidate_id, violation) of a verifier's decisions (candidate_id, decision): only submitted
    candidates, each in one partition."""
    unknown = decisions.join(submitted.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", F.lit("unknown candidate").alias("violation")).distinct()
    twice = decisions.groupBy("candidate_id").agg(F.countDistinct("decision").alias("n")).where("n > 1").select("candidate_id", F.lit("partitions overlap").alias("violation"))
    return unknown.unionByName(twice)


def resolve_evidence(refs: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """refs (ord, source_urn, item_id, graph_version) with the content of their source, in their order;
    NULL where the source or the item isn't known."""
    known = items.select("source_urn", "item_id", F.lit(True).alias("_i")).distinct()
    out = refs.join(sources.select("source_urn", F.col("text").alias("content")), "source_urn", "left").join(known, ["source_urn", "item_id"], "left")
    fine = (X.text("item_id") == "") | F.col("_i")
    return out.withColumn("content", F.when(fine, F.col("content"))).drop("_i")
