"""Seams for what comes from outside: embedders, deepeners, verifiers, fetchers. No network here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.store import cut

MAX_BATCH = 256


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Deepener(Protocol):
    def deepen(self, text: str) -> dict | None: ...


class Verifier(Protocol):
    def manifest(self) -> dict: ...
    def verify(self, request: dict) -> dict: ...


class EvidenceProvider(Protocol):
    def resolve(self, ref: dict) -> dict | None: ...
    def verify(self, ref: dict) -> bool: ...


class Fetcher(Protocol):
    def fetch(self, url: str) -> bytes | None: ...


class NullDeepener:
    def deepen(self, text: str) -> dict | None:
        return None


def dense(embedder: Embedder) -> Callable[[Column], Column]:
    """An embedder as a column function, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.tolist()))

    return embed


def deepen(claims: DataFrame, deepener: Deepener) -> DataFrame:
    """(item_id, deepening) as JSON for the claims on which the deepener has something to say."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, deepener.deepen(t)) for i, t in zip(b["item_id"], b["text"])]
            yield pd.DataFrame([(i, json.dumps(d, sort_keys=True)) for i, d in found if isinstance(d, dict)], columns=["item_id", "deepening"])

    return claims.select("item_id", "text").mapInPandas(run, "item_id string, deepening string")


def coerced(deepening: Column) -> Column:
    """A deepening (JSON) in its shape: a list of relations, texts of sub-claims, an object as model;
    what is of another kind is empty, and NULL if it is no object at all."""
    kind = lambda path, mark: F.startswith(F.trim(F.coalesce(F.get_json_object(deepening, path), F.lit(""))), F.lit(mark))
    part = lambda path, mark, none: F.when(kind(path, mark), F.get_json_object(deepening, path)).otherwise(F.lit(none))
    relations = part("$.relations", "[", "[]")
    claims = F.from_json(part("$.sub_claims", "[", "[]"), "array<string>")
    model = part("$.mental_model", "{", "{}")
    shaped = F.struct(relations.alias("relations"), F.coalesce(claims, F.array().cast("array<string>")).alias("sub_claims"), model.alias("mental_model"))
    return F.when(F.startswith(F.trim(deepening), F.lit("{")) & F.try_parse_json(deepening).isNotNull(), shaped)


def promotion_plan(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """records (canonical_urn, item_id, deepening) with ``verdict`` and ``reason``: only what has its
    identities and its shape, and what the verifier accepts (item_id), is promoted."""
    out = records.join(accepted.select("item_id").distinct().withColumn("_a", F.lit(True)), "item_id", "left")
    shape = coerced(F.col("deepening"))
    urn = F.trim(F.coalesce("canonical_urn", F.lit(""))) if "canonical_urn" in records.columns else F.lit("-")
    reason = (
        F.when(urn == "", "missing-source-identity").when(F.trim(F.coalesce("item_id", F.lit(""))) == "", "missing-item-identity").when(shape.isNull(), "deepening-not-object")
        .when(F.col("_a").isNull(), "verification-failed")
    )
    return out.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNull(), "accepted").when(F.col("reason") == "verification-failed", "rejected").otherwise("malformed")).drop("_a")


def promote(records: DataFrame, verifier: Callable[[dict], bool] | None, sink: Callable[[DataFrame], None]) -> DataFrame:
    """Puts records to the verifier, in Arrow batches, gives what it accepts to the sink and returns the
    plan. There is no verifier by default; one that fails accepts nothing."""
    if verifier is None:
        raise ValueError("promotion needs a verifier")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = []
            for row in b.to_dict("records"):
                try:
                    kept.append(bool(verifier(row)))
                except Exception:  # whatever a verifier raises, its record isn't accepted
                    kept.append(False)
            yield b.loc[kept, ["item_id"]]

    plan = cut(promotion_plan(records, records.mapInPandas(run, "item_id string")))
    sink(plan.where("verdict = 'accepted'"))
    return plan


GROUNDED = frozenset({"resolve", "type_span", "judge_merge", "classify_domain"})


def checked_decoding(task: str, settings: dict) -> None:
    """Tasks that write to the graph decode at temperature 0 into a constrained format."""
    if task not in GROUNDED:
        return
    if settings.get("temperature") != 0:
        raise ValueError(f"task {task!r} decodes at temperature 0")
    if not (isinstance(settings.get("format"), dict) or settings.get("format") == "json"):
        raise ValueError(f"task {task!r} needs a constrained format")


def policy(found: dict | str | None) -> dict:
    """An effort policy with its defaults, from a mapping (or its ``effort`` part) or a JSON file."""
    import json
    from pathlib import Path

    from kgspark.operators.mining import POLICY

    if isinstance(found, str):
        found = json.loads(Path(found).read_text()) if Path(found).exists() else None
    given = (found or {}).get("effort", found or {})
    return POLICY | {k: given[k] for k in POLICY if k in given}


class SystemAdapter(Protocol):
    """A foreign system: who it is, and its nodes and relations as tables."""

    def identity(self) -> dict: ...
    def nodes(self) -> DataFrame: ...
    def relations(self) -> DataFrame: ...


class Adapters:
    """Adapters by system and by adapter id; an id that another adapter holds is an error."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], SystemAdapter] = {}

    def register(self, adapter: SystemAdapter) -> SystemAdapter:
        who = adapter.identity()
        keys = [(kind, who[kind]) for kind in ("system_id", "adapter_id")]
        for key in keys:
            if key in self._known and self._known[key].identity() != who:
                raise ValueError(f"{key[0]} {key[1]!r} belongs to another adapter")
        self._known |= dict.fromkeys(keys, adapter)
        return adapter

    def for_system(self, system_id: str) -> SystemAdapter:
        return self._known["system_id", system_id]

    def for_adapter(self, adapter_id: str) -> SystemAdapter:
        return self._known["adapter_id", adapter_id]

    def identities(self) -> list[dict]:
        return [a.identity() for (kind, _), a in sorted(self._known.items(), key=lambda x: x[0]) if kind == "system_id"]


class Libraries:
    """Libraries by id; a namespace belongs to one of them only."""

    def __init__(self, libraries: dict[str, dict] | None = None) -> None:
        self._known: dict[str, dict] = {}
        for name, lib in (libraries or {}).items():
            self.add(name, lib["root_path"], lib["urn_namespace"])

    def add(self, library_id: str, root_path: str, urn_namespace: str) -> None:
        if not library_id or not urn_namespace:
            raise ValueError("a library has an id and a namespace")
        if any(lib["urn_namespace"] == urn_namespace for name, lib in self._known.items() if name != library_id):
            raise ValueError(f"namespace {urn_namespace!r} is taken")
        self._known[library_id] = {"root_path": str(root_path), "urn_namespace": urn_namespace}

    def get(self, library_id: str) -> dict:
        return self._known[library_id]

    def ids(self) -> list[str]:
        return list(self._known)


def submit(verifier: Verifier, request: dict) -> dict:
    """Negotiates and submits a request: a peer that isn't a verifier is an error, one that lacks a
    capability escalates, and a result must answer this request about its candidates only."""
    peer = verifier.manifest()
    if "verifier" not in peer.get("roles", ()):
        raise ValueError("the peer is no verifier")
    lacking = missing_capabilities(peer.get("capabilities", []), request.get("required_capabilities", []))
    if lacking:
        return {"request_id": request["request_id"], "status": "escalate", "missing": lacking, "accepted": [], "undecided": [], "rejected": []}
    result = verifier.verify(request)
    if result.get("request_id") != request["request_id"]:
        raise ValueError("the result answers another request")
    parts = [set(result.get(k, ())) for k in ("accepted", "undecided", "rejected")]
    if not set().union(*parts) <= {c["candidate_id"] for c in request["candidates"]}:
        raise ValueError("the result names unknown candidates")
    if sum(map(len, parts)) != len(set().union(*parts)):
        raise ValueError("the result's parts overlap")
    return result


def guarded_batch(refs: list[dict]) -> list[dict]:
    if len(refs) > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} references at once")
    return refs


def missing_capabilities(offered: list[str], required: list[str]) -> list[str]:
    return sorted(set(required) - set(offered))
