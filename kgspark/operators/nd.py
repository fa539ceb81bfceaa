"""Typed context axes with attested, three-valued relations; NULL is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.profiles import DIMENSIONS

INVERSE = {"contains": "contained_by", "contained_by": "contains", "precedes": "succeeds", "succeeds": "precedes"}
POSITIVE = ("equal", "overlaps", "contains", "contained_by")
VALUE_TYPES = ("string", "controlled_identifier", "concept_reference", "entity_reference", "integer", "non_negative_integer", "number", "boolean", "date", "interval", "quantity")
CORE_AXES = ("jurisdiction", "time", "instrument", "domain", "language", "version", "actor", "fact_scope", "scenario", "purpose")


def compose(a: Column, b: Column) -> Column:
    """Composition of two dimensions: a causal, intentional or temporal second one wins; a relational
    one leaves the first; a structural one keeps causal and is structural else."""
    return (
        F.when(b.isin("causal", "intentional", "temporal"), b)
        .when(b == "relational", a)
        .when((b == "structural") & (a == "causal"), F.lit("causal"))
        .when(b == "structural", F.lit("structural"))
    )


def composition_table(session) -> DataFrame:  # noqa: ANN001
    one = session.createDataFrame([(d,) for d in DIMENSIONS], "a string")
    return one.crossJoin(one.withColumnRenamed("a", "b")).select("a", "b", compose(F.col("a"), F.col("b")).alias("c"))


def closure(ontology: DataFrame) -> DataFrame:
    """(axis, lv, rv, primitive): what is attested, and the inverse of it."""
    pairs = [x for kv in INVERSE.items() for x in map(F.lit, kv)]
    base = ontology.select("axis", F.col("left").alias("lv"), F.col("right").alias("rv"), F.col("relation").alias("primitive"))
    turned = base.select("axis", F.col("rv").alias("lv"), F.col("lv").alias("rv"), F.try_element_at(F.create_map(*pairs), F.col("primitive")).alias("primitive")).where("primitive is not null")
    return base.unionByName(turned).distinct()


def supports(axes: DataFrame) -> DataFrame:
    """(axis, primitive) that may be asked: declared ones and the inverses of those."""
    pairs = [x for kv in INVERSE.items() for x in map(F.lit, kv)]
    declared = axes.select("axis", F.explode("primitives").alias("primitive"))
    turned = declared.select("axis", F.try_element_at(F.create_map(*pairs), F.col("primitive")).alias("primitive")).where("primitive is not null")
    return declared.unionByName(turned).distinct()


def relation(questions: DataFrame, axes: DataFrame, ontology: DataFrame) -> DataFrame:
    """questions (axis, lv, rv, primitive) with ``truth``: true if attested; equal is decided; anything
    that isn't known, or that the axis doesn't declare, is NULL."""
    asked = questions.join(supports(axes).withColumn("_s", F.lit(True)), ["axis", "primitive"], "left")
    known = closure(ontology).withColumn("_k", F.lit(True))
    out = asked.join(known, ["axis", "lv", "rv", "primitive"], "left")
    truth = F.when(F.col("_s").isNull(), F.lit(None).cast("boolean")).when(F.col("primitive") == "equal", F.col("lv") == F.col("rv")).when(F.col("_k"), F.lit(True))
    return out.withColumn("truth", truth).drop("_s", "_k")


def scope_compatibility(claims: DataFrame, constraint: DataFrame, axes: DataFrame, ontology: DataFrame) -> DataFrame:
    """(claim_id, compatible): scopes are rows (claim_id, axis, value), the constraint (axis, value).

    False as soon as one pair is attested disjoint; true if each shared axis has a positive pair;
    NULL else, and for claims that share no axis.
    """
    ids = claims.select("claim_id").distinct()
    pairs = claims.select("claim_id", "axis", F.col("value").alias("lv")).join(F.broadcast(constraint.select("axis", F.col("value").alias("rv"))), "axis")
    questions = pairs.withColumn("primitive", F.explode(F.array(*[F.lit(p) for p in ("disjoint", *POSITIVE)])))
    answered = relation(questions, axes, ontology)
    per_axis = answered.groupBy("claim_id", "axis").agg(
        F.max(F.coalesce((F.col("primitive") == "disjoint") & F.col("truth"), F.lit(False))).alias("apart"),
        F.max(F.coalesce((F.col("primitive") != "disjoint") & F.col("truth"), F.lit(False))).alias("near"),
    )
    per_claim = per_axis.groupBy("claim_id").agg(F.max("apart").alias("apart"), F.min("near").alias("near"))
    return ids.join(per_claim, "claim_id", "left").select("claim_id", F.when(F.col("apart"), F.lit(False)).when(F.col("near"), F.lit(True)).alias("compatible"))


def select_by_scope(compatibility: DataFrame) -> DataFrame:
    return compatibility.select("claim_id", F.when(F.col("compatible"), "selected").when(~F.col("compatible"), "excluded").otherwise("unknown").alias("verdict"))


def binding_gaps(claims: DataFrame, rules: DataFrame, bindings: DataFrame) -> DataFrame:
    """(claim_id, form_slot, diagnostic) of required slots that nothing is bound to."""
    wanted = claims.select("claim_id").crossJoin(F.broadcast(rules.where("required").select("form_slot")))
    return wanted.join(bindings.select("claim_id", "form_slot").distinct(), ["claim_id", "form_slot"], "left_anti").withColumn("diagnostic", F.lit("contextually-incomplete"))


def value_violation(value: Column, value_type: Column, vocabulary: Column, mode: Column, unit: Column) -> Column:
    """Why a value (as JSON text) doesn't fit its axis, or NULL. Dates and intervals aren't parsed."""
    bare = F.trim(F.regexp_replace(value, '^"|"$', ""))
    return (
        F.when((mode == "closed") & ~F.array_contains(vocabulary, bare), "not in the closed vocabulary")
        .when((value_type == "integer") & ~value.rlike(r"^-?\d+$"), "not an integer")
        .when((value_type == "non_negative_integer") & ~value.rlike(r"^\d+$"), "not a non-negative integer")
        .when((value_type == "number") & ~value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "not a number")
        .when((value_type == "boolean") & ~value.isin("true", "false"), "not a boolean")
        .when((value_type == "quantity") & F.try_to_number(F.get_json_object(value, "$.amount"), F.lit("999999999999D999999")).isNull(), "quantity needs an amount")
        .when((value_type == "quantity") & unit.isNotNull() & ~F.get_json_object(value, "$.unit").eqNullSafe(unit), "quantity has another unit")
    )


def axis_violations(axes: DataFrame) -> DataFrame:
    """(axis, violation) of axis declarations."""
    found = F.filter(F.array(
        F.when(~F.coalesce("axis", F.lit("")).rlike("^[a-z][a-z0-9_.-]*$"), F.lit("invalid axis id")),
        F.when(~F.col("value_type").isin(*VALUE_TYPES), F.lit("unknown value type")),
        F.when((F.col("vocabulary_mode") == "closed") & (F.size("vocabulary") == 0), F.lit("closed vocabulary is empty")),
    ), lambda x: x.isNotNull())
    return axes.select("axis", F.explode(found).alias("violation"))


def registry_collisions(systems: DataFrame) -> DataFrame:
    """(qualified, n): axes that several systems (namespace, axis, system_id) claim."""
    return systems.groupBy(F.concat_ws(":", "namespace", "axis").alias("qualified")).agg(F.countDistinct("system_id").alias("n")).where("n > 1")


ID = "^[a-z][a-z0-9_.-]*$"
PRIMITIVES = ("equal", "contains", "contained_by", "overlaps", "disjoint", "precedes", "succeeds")
_OPEN = ("equal",)
_CORE = {
    "jurisdiction": ("controlled_identifier", (*_OPEN, "contains", "overlaps", "disjoint")), "time": ("interval", (*_OPEN, "contains", "overlaps", "disjoint", "precedes")),
    "instrument": ("controlled_identifier", _OPEN), "domain": ("concept_reference", (*_OPEN, "contains", "overlaps")), "language": ("controlled_identifier", _OPEN),
    "version": ("controlled_identifier", (*_OPEN, "precedes")), "actor": ("concept_reference", (*_OPEN, "contains")), "fact_scope": ("concept_reference", (*_OPEN, "contains", "overlaps", "disjoint")),
    "scenario": ("concept_reference", _OPEN), "purpose": ("concept_reference", (*_OPEN, "contains", "overlaps")),
}
_SLOTS = {"quantification.range": ("actor", "fact_scope"), "predicate.agent": ("actor",), "predicate.patient": ("actor", "fact_scope"), "modality.bearer": ("actor",), "condition.antecedent": ("fact_scope",)}
AXES = "system_id string, namespace string, version string, axis string, value_type string, cardinality string, vocabulary_mode string, vocabulary array<string>, primitives array<string>, unit string, provenance_required boolean"
RULES = "system_id string, version string, form_slot string, axis string, required boolean"


def core_system(session) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(axes, rules) of the ten context axes that need no package, and their five binding slots."""
    axes = [("core-context", "core.context", "1", a, kind, "one", "open", [], list(p), "", True) for a, (kind, p) in _CORE.items()]
    return session.createDataFrame(axes, AXES), session.createDataFrame([("core-context", "1", slot, a, False) for slot, names in _SLOTS.items() for a in names], RULES)


def read_system(session, text: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(axes, rules) of a declared system, a JSON object; one that breaks a rule is an error."""
    import json

    raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("a system is an object")
    raw = raw.get("nd_system", raw)
    key = tuple(str(raw.get(k, "")) for k in ("id", "namespace", "version"))
    needs = bool((raw.get("validation") or {}).get("provenance_required", True))
    axes = [
        (*key, str(a), str(v.get("value_type", "string")), str(v.get("cardinality", "one")), str(v.get("vocabulary_mode", "open")), [str(x) for x in v.get("vocabulary", ())], [str(x) for x in v.get("primitives", ())], str(v.get("unit", "")), needs or bool(v.get("provenance_required", False)))
        for a, v in (raw.get("axes") or {}).items()
    ]
    rules = [(key[0], key[2], str(b.get("form_slot", "")), str(a), bool(b.get("required", False))) for b in raw.get("bindings", ()) for a in b.get("allowed_axes", ())]
    found = session.createDataFrame(axes, AXES), session.createDataFrame(rules, RULES)
    if not axes:
        raise ValueError("a system declares at least one axis")
    wrong = [r["violation"] for r in system_violations(*found).collect()]
    if wrong:
        raise ValueError("invalid system: " + "; ".join(sorted(wrong)))
    return found


def _found(rows: DataFrame, keys: tuple[str, ...], checks: list[tuple[Column, str | Column]]) -> DataFrame:
    marks = F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in checks])
    return rows.select(*keys, F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("violation"))


def system_violations(axes: DataFrame, rules: DataFrame) -> DataFrame:
    """(system_id, violation): of the system's names, of each axis, and of slots that name no axis."""
    named = _found(axes.select("system_id", "namespace", "version").distinct(), ("system_id",), [
        (~F.coalesce("system_id", F.lit("")).rlike(ID), "invalid system id"), (~F.coalesce("namespace", F.lit("")).rlike(ID), "invalid namespace"), (F.coalesce("version", F.lit("")) == "", "missing version"),
    ])
    at = lambda what: F.concat(F.lit("axis "), F.col("axis"), F.lit(": " + what))
    each = _found(axes, ("system_id",), [
        (~F.coalesce("axis", F.lit("")).rlike(ID), at("invalid id")), (~F.col("value_type").isin(*VALUE_TYPES), at("unknown value type")), (~F.col("cardinality").isin("one", "many"), at("cardinality is one or many")),
        (~F.col("vocabulary_mode").isin("open", "closed", "external"), at("unknown vocabulary mode")), ((F.col("vocabulary_mode") == "closed") & (F.size("vocabulary") == 0), at("closed vocabulary is empty")),
        (F.exists("primitives", lambda p: ~p.isin(*PRIMITIVES)), at("unknown primitive")),
    ])
    strange = rules.join(axes.select("system_id", "version", "axis"), ["system_id", "version", "axis"], "left_anti")
    unknown = strange.select("system_id", F.concat(F.lit("slot "), "form_slot", F.lit(": unknown axis "), "axis").alias("violation"))
    return named.unionByName(each).unionByName(unknown).unionByName(rules.where("coalesce(form_slot, '') = ''").select("system_id", F.lit("rule without a slot").alias("violation")))


def assignment_violations(assignments: DataFrame, axes: DataFrame) -> DataFrame:
    """(assignment_id, violation) of coordinates (assignment_id, system_id, system_version, axis, value as
    JSON text, source_id, method) against the axes of their system."""
    known = axes.select("system_id", F.col("version").alias("system_version"), "axis", "value_type", "vocabulary_mode", "vocabulary", "unit", "provenance_required", F.lit(True).alias("_a"))
    systems = axes.select("system_id", F.col("version").alias("system_version")).distinct().withColumn("_s", F.lit(True))
    rows = assignments.join(F.broadcast(known), ["system_id", "system_version", "axis"], "left").join(F.broadcast(systems), ["system_id", "system_version"], "left")
    here, blank = F.col("_a").isNotNull(), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    unit = F.nullif(F.col("unit"), F.lit(""))
    wrong = value_violation(F.col("value"), F.col("value_type"), F.col("vocabulary"), F.col("vocabulary_mode"), unit)
    return _found(rows, ("assignment_id",), [
        (F.col("_s").isNull(), "unknown system or version"), (F.col("_s").isNotNull() & ~here, "unknown axis"),
        (here & F.col("provenance_required") & blank("source_id"), "provenance is required"), (here & blank("method"), "method is required"), (here & wrong.isNotNull(), wrong),
    ])


def binding_violations(bindings: DataFrame, rules: DataFrame) -> DataFrame:
    """(binding_id, violation) of bindings (binding_id, claim_id, assignment_id, form_slot, axis, source_id,
    method) against the slots' contracts."""
    allowed = rules.groupBy("form_slot").agg(F.collect_set("axis").alias("_axes"))
    rows, blank = bindings.join(F.broadcast(allowed), "form_slot", "left"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return _found(rows, ("binding_id",), [
        (F.col("_axes").isNull(), "slot has no contract"), (F.col("_axes").isNotNull() & ~F.array_contains("_axes", F.col("axis")), "axis not allowed for slot"),
        (blank("claim_id") | blank("assignment_id"), "claim and assignment are required"), (blank("source_id") | blank("method"), "provenance is required"),
    ])


def manifest(axes: DataFrame) -> DataFrame:
    """(system_id, namespace, version, axes) with qualified, sorted axis names."""
    return axes.groupBy("system_id", "namespace", "version").agg(F.array_sort(F.collect_set(F.concat_ws(":", "namespace", "axis"))).alias("axes"))


def ordered_relations(values: DataFrame, axis: str) -> DataFrame:
    """(axis, left, right, relation): every earlier value precedes every later one, for (pos, value) of
    an ontology's few values."""
    few = F.broadcast(values.select(F.col("pos").alias("_p"), F.col("value").alias("right")))
    return values.join(few, F.col("pos") < F.col("_p")).select(F.lit(axis).alias("axis"), F.col("value").alias("left"), "right", F.lit("precedes").alias("relation"))


def coordinate_set(values: Column) -> Column:
    """Trimmed, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))))


def confidence(a: Column, b: Column) -> Column:
    """Confidences multiply along a path."""
    return a * b


def merge_conflicts(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): rows of both, each once, and the keys under which different contents stand."""
    both = existing.unionByName(incoming).distinct()
    twice = both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return both.join(twice, key, "left_anti").select(*both.columns), twice


def semantics_violations(compositions: DataFrame, assignments: DataFrame, bindings: DataFrame, claims: DataFrame, axes: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, id, violation): all that stands against admitting compositions, coordinates and bindings;
    only if there is nothing may they be merged. Evidence, subjects and bound claims must be claims
    (item_id), and a binding's assignment one of those that come along."""
    ids = claims.select("item_id").distinct()
    tag = lambda kind, df, key, what=None: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), (F.lit(what) if what else F.col("violation")).alias("violation"))
    cited = compositions.select("composition_id", F.explode("participants").alias("p")).select("composition_id", F.explode("p.evidence_ids").alias("item_id"))
    out = tag("composition", composition_violations(compositions), "composition_id").unionByName(tag("composition", cited.join(ids, "item_id", "left_anti").select("composition_id").distinct(), "composition_id", "cites an unknown claim"))
    out = out.unionByName(tag("assignment", assignment_violations(assignments, axes), "assignment_id")).unionByName(tag("assignment", assignments.join(ids, F.col("subject_id") == ids["item_id"], "left_anti"), "assignment_id", "cites an unknown claim"))
    out = out.unionByName(tag("binding", binding_violations(bindings, rules), "binding_id")).unionByName(tag("binding", bindings.join(ids, F.col("claim_id") == ids["item_id"], "left_anti"), "binding_id", "cites an unknown claim"))
    loose = bindings.join(assignments.select("assignment_id").distinct(), "assignment_id", "left_anti")
    return out.unionByName(tag("binding", loose, "binding_id", "cites an unknown assignment"))


# --- compositions: claims that stand together in roles

ROLES = {"entity": ("evidence",), "deontic": ("bearer", "action"), "process": ("step",), "conditional": ("antecedent", "consequent"), "relation": ("subject", "operator", "object"), "temporal_diff": ("before", "after"), "composite": ("member",)}
AT_LEAST_TWO = {"process": "step", "composite": "member"}


def _equals(value: str):  # noqa: ANN202
    return lambda x: x == value


def composition_violations(compositions: DataFrame) -> DataFrame:
    """(composition_id, violation) by kind, for rows (composition_id, kind, participants of
    (role, target_id, evidence_ids, position))."""
    roles = F.transform("participants", lambda p: p["role"])
    checks = [F.when(~F.col("kind").isin(*ROLES), F.lit("unknown kind")), F.when(F.exists("participants", lambda p: F.coalesce(p["target_id"], F.lit("")) == ""), F.lit("participant without target"))]
    for kind, needed in ROLES.items():
        for role in needed:
            checks.append(F.when((F.col("kind") == kind) & ~F.array_contains(roles, role), F.lit(f"{kind} requires {role}")))
    for kind, role in AT_LEAST_TWO.items():
        checks.append(F.when((F.col("kind") == kind) & (F.size(F.filter(roles, _equals(role))) < 2), F.lit(f"{kind} requires two of {role}")))
    return compositions.select("composition_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("violation"))


def composition_rows(compositions: DataFrame) -> DataFrame:
    """Edges from each participant to its composition."""
    p = compositions.select("composition_id", F.posexplode("participants").alias("n", "p"))
    return p.select(
        F.concat_ws(":", F.lit("comp"), "composition_id", F.col("n").cast("string")).alias("edge_id"), F.col("p.target_id").alias("src_id"), F.col("composition_id").alias("dst_id"),
        F.lit("composes").alias("edge_type"), F.col("p.role").alias("semantic_role"), F.array_sort("p.evidence_ids").alias("evidence_ids"),
    )


def steps_of(compositions: DataFrame) -> DataFrame:
    """(composition_id, n, target_id): steps by position if all have one, else as they stand."""
    steps = F.filter("participants", lambda p: p["role"] == "step")
    keyed = F.transform(steps, lambda p, i: F.struct(F.when(F.forall(steps, lambda q: q["position"].isNotNull()), p["position"]).otherwise(i).alias("k"), i.alias("i"), p["target_id"].alias("t")))
    return compositions.select("composition_id", F.posexplode(F.array_sort(keyed)).alias("n", "s")).select("composition_id", "n", F.col("s.t").alias("target_id"))


def trajectory(steps: DataFrame) -> DataFrame:
    """Compositions of ordered steps (composition_id, pos, action, evidence_ids): processes whose
    participants are the actions in the caller's order; as candidates, not validated here."""
    part = F.struct(F.col("pos").alias("position"), F.lit("step").alias("role"), F.col("action").cast("string").alias("target_id"), "evidence_ids")
    rows = F.transform(F.array_sort(F.collect_list(part)), lambda p: F.struct(p["role"].alias("role"), p["target_id"].alias("target_id"), p["evidence_ids"].alias("evidence_ids"), p["position"].alias("position")))
    return steps.groupBy("composition_id").agg(rows.alias("participants")).select("composition_id", F.lit("process").alias("kind"), "participants", F.lit("candidate").alias("verification"))


def grounded_by(compositions: DataFrame, evidence_id: str) -> DataFrame:
    """Compositions of which a participant rests on the evidence."""
    return compositions.where(F.exists("participants", lambda p: F.array_contains(p["evidence_ids"], evidence_id))).select("composition_id").distinct()
