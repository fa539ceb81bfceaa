"""Folders, registries, sidecars and tables on disk."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions import text as X
from kgspark.operators.nd import composition_violations
from kgspark.operators.records import ENVELOPE, digest, envelope_violations, upsert
from kgspark.operators.verbs import strip_envelopes
from kgspark.store import cut, shared_folder

SUFFIXES = ("pdf", "md", "txt")
CLAIM_COLUMNS = (
    "item_id", "source_urn", "unit_id", "unit_type", "span_start", "span_end", "marker", "text", "polarity", "type", "predicate", "modality",
    "quantification", "principle", "judicial_canon", "inference_rule", "confidence", "verification", "profile", "dimension",
)
CLAIMS = T.StructType([T.StructField(c, T.IntegerType() if c.startswith("span_") else T.StringType()) for c in CLAIM_COLUMNS])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, relpath, domain, suffix, size, mtime, skipped) of all files below a folder.

    Metadata only: the bytes aren't read. ``skipped`` says why a file is left out, or is NULL; domain
    is the first folder, "_root" for files at the top. Names that start with a dot or underscore are
    not seen by Spark at all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace("path", "^(file:)?/*" + base.lstrip("/").replace(".", r"\.") + "/", "")
    parts = F.split(rel, "/")
    suffix = F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1))
    stub = files.select(F.regexp_replace("path", r"\.metadata\.json$", "").alias("_stub")).where(F.endswith(files["path"], F.lit(".metadata.json"))).withColumn("_s", F.lit(True))
    out = files.withColumn("relpath", rel).withColumn("suffix", suffix).withColumn("domain", F.when(F.size(parts) > 1, parts[0]).otherwise("_root"))
    out = out.join(stub, F.col("path") == F.col("_stub"), "left")
    why = F.when(F.exists(F.split("relpath", "/"), lambda p: F.startswith(p, F.lit("."))), "hidden").when(F.col("_s") & (F.col("suffix") == "md"), "stub").when(~F.col("suffix").isin(*SUFFIXES), "unsupported")
    return out.select("path", "relpath", "domain", "suffix", "size", "mtime", why.alias("skipped"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, sha1, sha256) of Markdown and text files, control characters out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(root)
    return raw.select("path", X.clean_text(F.decode("content", "UTF-8")).alias("text"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with a header, quoted line breaks and no NUL bytes; empty cells stay "" if no schema
    is given, and are NULL in typed columns."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    if schema is None:
        df = reader.csv(path)
        return df.select(*[F.coalesce(F.regexp_replace(F.col(c), "\x00", ""), F.lit("")).alias(c) for c in df.columns])
    return reader.schema(schema).csv(path)


def write_claims(claims: DataFrame, path: str, *, domain: str = "domain") -> None:
    """One folder for each domain; a domain that is written again replaces its own rows only."""
    claims.repartition(domain).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(domain).parquet(path)


def append_source(claims: DataFrame, path: str, *, domain: str = "domain") -> None:
    """Adds one source's claims to their domains, next to what is there."""
    claims.write.mode("append").partitionBy(domain).parquet(path)


def remove_source(spark: SparkSession, path: str, canonical_urn: str, domain: str) -> None:
    """Takes a source's rows out of its domain. The rest is written aside first: a table can't be
    overwritten while it is read."""
    rest = spark.read.parquet(path).where((F.col("domain") == domain) & (F.col("canonical_urn") != canonical_urn))
    aside = shared_folder(spark)
    rest.write.parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(file, canonical_urn, title, …) of all *.metadata.json below a folder."""
    schema = "canonical_urn string, title string, topic string, jurisdiction string, year string, identity_method string, identifier string"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.metadata.json").json(root)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.metadata\.json$", "").alias("file"), "*").where(X.text("canonical_urn") != "")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(slug) of a gold file: one in a line; blank lines and comments after # don't count."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("slug")).where("slug <> ''").distinct()


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Subgraph envelopes; the first that breaks a rule ends the job."""
    rows = spark.read.schema(ENVELOPE).json(path)
    bad = envelope_violations(rows).groupBy("idempotency_key").agg(F.array_join(F.array_sort(F.collect_set("violation")), "; ").alias("why"))
    checked = rows.join(bad, "idempotency_key", "left")
    stop = F.when(F.col("why").isNotNull(), F.raise_error(F.concat(F.lit("envelope "), "idempotency_key", F.lit(": "), "why"))).otherwise(F.lit(True))
    return checked.where(F.coalesce(stop.cast("boolean"), F.lit(True))).drop("why")


def append_envelopes(store: str, incoming: DataFrame) -> DataFrame:
    """Appends envelopes whose key is new, once each, and returns (idempotency_key, digest, status).
    A key with other content ends the job before anything is written.

    A store has one writer at a time. Keys meet in joins; only the names of ten conflicts reach the driver.
    """
    spark = incoming.sparkSession
    old = existing(spark, store)
    old = incoming.limit(0).withColumn("digest", F.lit("")) if old is None else old
    receipts = cut(upsert(old, incoming))
    conflicts = [r["idempotency_key"] for r in receipts.where("status = 'conflict'").select("idempotency_key").orderBy("idempotency_key").limit(10).collect()]
    if conflicts:
        raise ValueError(f"other content under the same key: {', '.join(conflicts)}")
    new = incoming.withColumn("digest", digest(incoming)).dropDuplicates(["idempotency_key"])
    new.join(receipts.where("status = 'created'").select("idempotency_key"), "idempotency_key", "left_semi").write.mode("append").parquet(store)
    return receipts


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone) and "UNABLE_TO_INFER_SCHEMA" not in str(gone):
            raise
        return None


def rewrite_envelopes(store: str, gone: DataFrame) -> None:
    """Takes purged nodes and sources (kind, id, state) out of a store and seals what is left again."""
    spark = gone.sparkSession
    left = strip_envelopes(spark.read.parquet(store).drop("digest"), gone)
    aside = cut(left.withColumn("digest", digest(left)))
    aside.write.mode("overwrite").parquet(store)


REGISTRY = (
    "library", "relpath", "filename", "canonical_urn", "identifier", "identity_method", "title", "year", "domain", "topic", "jurisdiction", "doc_type", "sha256",
    "duplicate_group", "duplicate_group_size", "size_bytes", "status", "verification", "notes",
)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry's rows in its 19 columns; those that a file lacks are empty, sizes are numbers."""
    rows = csv_table(spark, path)
    typed = lambda c: F.expr(f"try_cast(nullif(`{c}`, '') as bigint)") if c in ("duplicate_group_size", "size_bytes") else F.col(c)
    return rows.select(*[(typed(c) if c in rows.columns else F.lit(None if c in ("duplicate_group_size", "size_bytes") else "").cast("bigint" if c in ("duplicate_group_size", "size_bytes") else "string")).alias(c) for c in REGISTRY])


def typed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates or bindings from CSV with ``value`` as JSON text and ``typed`` as VARIANT; a value that
    is no JSON is the text itself."""
    rows = csv_table(spark, path)
    value = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.to_json(F.array("value")))
    bare = F.when(F.try_parse_json("value").isNotNull(), value).otherwise(F.regexp_replace(value, r"^\[|\]$", ""))
    return rows.withColumn("value", bare).withColumn("typed", F.try_parse_json("value"))


PARTICIPANT = "struct<role:string,target_id:string,evidence_ids:array<string>,position:int>"
COMPOSITIONS = f"composition_id string, kind string, participants array<{PARTICIPANT}>"


def read_compositions(spark: SparkSession, path: str) -> DataFrame:
    """Compositions from JSON lines; one that breaks a rule ends the job."""
    rows = spark.read.schema(COMPOSITIONS).json(path)
    return _sound(rows)


def _sound(rows: DataFrame) -> DataFrame:
    bad = composition_violations(rows).groupBy("composition_id").agg(F.array_join(F.array_sort(F.collect_set("violation")), "; ").alias("why"))
    checked = rows.join(bad, "composition_id", "left")
    stop = F.when(F.col("why").isNotNull(), F.raise_error(F.concat(F.lit("composition "), "composition_id", F.lit(": "), "why"))).otherwise(F.lit(True))
    return checked.where(F.coalesce(stop.cast("boolean"), F.lit(True))).select(*rows.columns)


def write_compositions(rows: DataFrame, path: str) -> None:
    """Writes compositions as JSON lines in the order of their ids; broken ones and ids that stand on
    several contents are errors."""
    rows = cut(_sound(rows.distinct()))
    if not rows.groupBy("composition_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("a composition id stands on several contents")
    rows.orderBy("composition_id").write.mode("overwrite").json(path)


def save_index(docs: DataFrame, path: str) -> None:
    """A search index is its documents: statistics are made of them when it is searched."""
    docs.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """A CSV table in the order of its keys, then of all columns, so the same rows give the same bytes."""
    rows.orderBy(*order, *[c for c in rows.columns if c not in order]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_or_quarantine(path: Path) -> dict:
    """A JSON object from a file; a file that isn't one is moved aside under a new name, not lost."""
    if not path.exists():
        return {}
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except ValueError:
        found = None
    if isinstance(found, dict):
        return found
    n = 0
    while (aside := path.with_name(f"{path.name}.corrupt{n or ''}")).exists():
        n += 1
    path.replace(aside)
    return {}


def write_stubs(rows: DataFrame, folder: Path) -> int:
    """Writes the stubs (stub, note, sidecar) of a batch of admissions; counts those that are new or changed."""
    return sum(write_if_changed(folder / r["stub"], r["note"].encode()) | write_if_changed(folder / (r["stub"] + ".metadata.json"), r["sidecar"].encode()) for r in rows.toLocalIterator())


def copy_in(source: Path, folder: Path) -> Path:
    """Copies a file into a folder without overwriting another: equal bytes are left, other bytes of the
    same name get their digest before it."""
    import hashlib

    if folder in source.parents:
        return source
    data = source.read_bytes()
    target = folder / source.name
    if target.exists() and target.read_bytes() != data:
        target = folder / f"{hashlib.sha1(data, usedforsecurity=False).hexdigest()[:12]}-{source.name}"
    write_if_changed(target, data)
    return target


def quarantine(outcomes: DataFrame, inbox: Path) -> int:
    """Moves the failed artifacts of a provenance pass aside and notes why."""
    failed = outcomes.where("outcome = 'failed'").select("artifact", "reason").orderBy("artifact").collect()
    aside = inbox / "_failed"
    for r in failed:
        aside.mkdir(parents=True, exist_ok=True)
        if (inbox / r["artifact"]).exists():
            (inbox / r["artifact"]).replace(aside / r["artifact"])
        with (inbox / "_failed.csv").open("a", encoding="utf-8") as log:
            log.write(f"{r['artifact']},{r['reason']}\n")
    return len(failed)


def export(nodes: DataFrame, edges: DataFrame, path: Path, kind: str = "json") -> Path:
    """Writes a graph as "json" or "graphml"."""
    if kind not in ("json", "graphml"):
        raise ValueError(f"unknown export {kind!r}")
    data = payload(nodes, edges)
    write_json(data, path) if kind == "json" else write_graphml(data, path)
    return path


def write_if_changed(path: Path, data: bytes) -> bool:
    """Replaces a file by atomic rename, unless it has these bytes already."""
    if path.exists() and path.read_bytes() == data:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(path.name + ".new")
    aside.write_bytes(data)
    aside.replace(path)
    return True


def write_overlay(notes: DataFrame, folder: Path) -> dict[str, int]:
    """Makes a folder hold exactly the notes (path, note): counts of new, changed and removed files."""
    want = {r["path"]: r["note"].encode() for r in notes.toLocalIterator()}
    have = {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()} if folder.exists() else set()
    changed = [p for p, data in want.items() if write_if_changed(folder / p, data)]
    for p in have - set(want):
        (folder / p).unlink()
    return {"new": len(set(changed) - have), "changed": len(set(changed) & have), "removed": len(have - set(want))}


def payload(nodes: DataFrame, edges: DataFrame) -> dict:
    """A graph export for a viewer: it fits in one file, so it is collected."""
    n = [r.asDict() for r in nodes.orderBy("id").toLocalIterator()]
    e = [r.asDict() for r in edges.orderBy("src", "dst", "kind").toLocalIterator()]
    return {"version": 1, "counts": {"nodes": len(n), "edges": len(e)}, "nodes": n, "edges": e}


def write_graphml(data: dict, path: Path) -> None:
    from xml.sax.saxutils import escape, quoteattr

    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="kind" for="all" attr.name="kind" attr.type="string"/>', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<graph edgedefault="directed">']
    lines += [f'<node id={quoteattr(n["id"])}><data key="kind">{escape(n["kind"])}</data><data key="label">{escape(n["label"] or "")}</data></node>' for n in data["nodes"]]
    lines += [f'<edge source={quoteattr(e["src"])} target={quoteattr(e["dst"])}><data key="kind">{escape(e["kind"])}</data></edge>' for e in data["edges"]]
    write_if_changed(path, "\n".join([*lines, "</graph>", "</graphml>", ""]).encode())


def write_json(data: dict, path: Path) -> bool:
    return write_if_changed(path, json.dumps(data, ensure_ascii=False, sort_keys=True).encode())
