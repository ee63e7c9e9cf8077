"""Design hypotheses: required checks, applied state, discriminators, confidence, arbitration.

A builder declares its anchors and three sets of column conditions over the anchor's evidence (a table with finding_id and boolean or numeric
columns); one projection evaluates a builder for all its anchors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States and the ladder of confidence.
STATES = ("ausente", "parcial", "ya-aplicado", "aplicado-eludido")
LADDER = ("baja", "media", "alta")


@dataclass(frozen=True)
class Hypothesis:
    id: str
    layer: str
    anchors: tuple[str, ...]
    ceiling: str
    required: dict[str, str]
    discriminators: dict[str, str]
    applied: str = "false"
    eluded: str = "false"
    partial: str = "false"
    registered: bool = True
    needs: tuple[str, ...] = ()


HYPOTHESES: dict[str, Hypothesis] = {}


def _add(id, layer, anchors, ceiling, required, discriminators, **more):
    HYPOTHESES[id] = Hypothesis(id, layer, tuple(anchors), ceiling, required, discriminators, **more)


P, R = "patron", "refactorizacion"
_add("abstract-factory", P, ["hardwired-subtype-combination"], "media", {"families": "families >= 2 AND sites >= 2"}, {"touching": "families_touch", "spread": "files >= 2"}, applied="has_factory")
_add("builder", P, ["long-parameter-list", "data-clump"], "alta", {"constructor": "is_constructor", "assembly": "branches > 0 OR sub_objects >= 2"}, {"optional": "optional_parameters >= 2", "callers": "call_sites >= 3"}, applied="has_builder")
_add("chain-of-responsibility", P, ["many-returns", "exclusive-dispatch-ladder"], "media", {"guards": "guards >= 3", "diverse": "discriminants > 1"}, {"repeated": "similar_places >= 1", "short": "short_arms"}, applied="has_handlers")
_add("command", P, ["distributed-duplication", "invariant-scaffold-varying-call"], "alta", {"own_call": "own_callees = 1", "files": "files >= 2", "unrelated": "NOT common_ancestor"}, {"arity": "same_arity", "many": "places >= 4"}, applied="has_command")
_add("composite", P, ["distributed-duplication", "recursive-collection-descent"], "media", {"recursion": "own_collection AND recursive_calls >= 1"}, {"operations": "operations >= 2"}, registered=False)
_add("consolidate-conditional", R, ["complexity", "conditional-chain", "duplication"], "alta", {"same_bodies": "equal_bodies >= 2", "pure": "NOT side_effects"}, {"adjacent": "adjacent", "many": "equal_bodies >= 3"})
_add("decompose-conditional", R, ["boolean-complexity"], "alta", {"terms": "composite_terms >= 2", "pure": "NOT side_effects"}, {"long": "terms >= 4", "repeated": "similar_places >= 1"})
_add("decorator", P, ["flag-accumulator", "boolean-complexity", "refused-bequest", "homonymous-delegation", "optional-behavior-flags"], "media", {"layers": "layers >= 2 OR forwards >= 1 OR capabilities >= 2"}, {"independent": "independent_layers", "shared_type": "common_ancestor"}, applied="has_wrapper")
_add("extract-class", R, ["large-class", "divergent-change"], "media", {"cohesion": "tcc < 1.0 / 3", "cluster": "cluster_members >= 2"}, {"fields": "cluster_fields >= 2", "isolated": "shared_fields = 0"})
_add("extract-class-from-temporary-fields", R, ["temporary-field"], "media", {"few_users": "2 * using_members <= members", "not_built": "NOT set_in_constructor"}, {"several": "fields >= 2", "together": "used_together"})
_add("extract-duplicated-method", R, ["duplication"], "alta", {"one_file": "files = 1", "no_jumps": "jumps = 0"}, {"copies": "copies >= 3", "long": "lines >= 10"})
_add("extract-method", R, ["long-function", "complexity"], "media", {"blocks": "nested_blocks >= 2", "code": "2 * comment_lines < lines"}, {"deep": "max_nesting >= 3", "named": "comment_blocks >= 1"})
_add("extract-variable", R, ["complexity", "long-function"], "media", {"repeated": "repeated_chains >= 2", "stable": "NOT reassigned"}, {"long": "chain_links >= 3", "many": "repeated_chains >= 4"})
_add("facade", P, ["fanout-without-cohesion", "god-component", "repeated-collaborator-set"], "media", {"wide": "fan_out >= 4", "files": "places >= 1"}, {"set": "shared_set >= 4", "loose": "clustering <= 0.2"}, applied="has_facade")
_add("factory-method", P, ["conditional-chain", "repeated-switch", "homonymous-divergent-construction"], "alta", {"products": "products >= 2", "no_creator": "NOT creation_member"}, {"siblings": "siblings >= 2", "shared": "shared_steps >= 2"}, applied="has_creator")
_add("form-template-method", R, ["homonymous-divergent-sequence", "parallel-hierarchies", "refused-bequest"], "media", {"members": "steps_are_members", "ancestor": "ancestor_visible AND ancestor_members > 0"}, {"many": "siblings >= 3"})
_add("guard-clauses", R, ["complexity", "long-function"], "alta", {"arrow": "spine_depth >= 3", "last": "last_in_level", "lines": "deep_lines >= 10"}, {"no_else": "else_arms = 0", "deep": "spine_depth >= 4"})
_add("handle-empty-catch", R, ["empty-catch"], "alta", {"empty": "handler_statements = 0", "stays": "NOT protected_exits"}, {"broad": "broad_type", "repeated": "similar_places >= 1"})
_add("iterator", P, ["distributed-duplication", "exposed-container-traversal"], "media", {"cursor": "cursor_sites >= 2"}, {"files": "files >= 3"}, registered=False)
_add("lookup-table", R, ["complexity", "conditional-chain", "many-returns", "repeated-switch"], "alta", {"subject": "subjects = 1", "literals": "all_literals"}, {"arms": "arms >= 4", "repeated": "similar_places >= 1"})
_add("move-member", R, ["feature-envy-intra", "feature-envy-inter", "inappropriate-intimacy"], "media", {"writes": "foreign_writes >= 2 AND foreign_writes > own_uses"}, {"one": "providers = 1"}, registered=False)
_add("null-object", P, ["distributed-duplication", "duplication", "repeated-absence-check"], "media", {"protocol": "messages >= 2"}, {"covered": "covers_protocol"}, registered=False, applied="has_neutral")
_add("observer", P, ["manual-notification", "hard-wired-notification"], "media", {"state": "changes_state", "targets": "targets >= 2"}, {"list": "keeps_list"}, registered=False)
_add("parameter-object", R, ["long-parameter-list", "data-clump"], "alta", {"half": "2 * clump >= parameters", "new": "NOT existing_class"}, {"repeats": "repeats >= 3", "together": "travel_together"})
_add("prototype", P, ["duplication", "repeated-configured-assembly"], "alta", {"preset": "coincident >= 2", "differs": "varying >= 1"}, {"places": "places >= 3", "cost": "deep_assembly"}, applied="has_clone")
_add("proxy", P, ["duplication", "scattered-instantiation", "lazy-init-repetida", "repeated-access-control"], "alta", {"sites": "guard_sites >= 2 OR full_forwarding"}, {"same_guard": "same_condition", "files": "files >= 2"}, applied="has_proxy")
_add("remove-dead-code", R, ["unreachable-code", "unused-symbol", "unused-variable"], "alta", {"dead": "outside_uses = 0"}, {"whole": "whole_unit", "private": "NOT exported"})
_add("remove-flag-argument", R, ["boolean-flag-param"], "alta", {"only_condition": "only_as_condition", "single": "flags = 1"}, {"literals": "callers_pass_literals", "arms": "arms_differ"})
_add("singleton", P, ["scattered-instantiation"], "media", {"one": "stored_instances = 1"}, {"accessor": "has_accessor"}, registered=False)
_add("split-phase", R, ["complexity", "long-function"], "media", {"halves": "first_half >= 5 AND second_half >= 5", "one": "crossing_locals = 1"}, {"types": "different_types"})
_add("state", P, ["repeated-switch", "conditional-chain", "type-switch"], "media", {"own_field": "discriminant_is_own_field", "changes": "field_writes >= 1"}, {"repeated": "similar_places >= 1", "transitions": "writes_in_arms >= 1"}, applied="has_state_types")
_add("strategy", P, ["conditional-chain", "repeated-switch", "type-switch", "complexity", "long-function"], "media", {"one_subject": "subjects = 1", "values": "values >= 2", "differ": "arm_operations >= 2", "not_own": "NOT discriminant_is_own_field"}, {"repeated": "similar_places >= 1", "arms": "arms >= 4"}, applied="has_strategy_types")
_add("template-method", P, ["distributed-duplication", "parallel-hierarchies", "refused-bequest", "homonymous-divergent-sequence", "large-class", "inheritance-family"], "alta", {"skeleton": "common_steps >= 2", "varies": "own_steps >= 1"}, {"units": "units >= 3", "ancestor": "common_ancestor"}, applied="has_template")
_add("unify-alternative-interfaces", R, ["homonymous-divergent-sequence", "homonymous-divergent-construction"], "media", {"arities": "arities > 1", "called": "outside_calls >= 1"}, {"siblings": "siblings >= 2"})
_add("value-object", R, ["primitive-obsession"], "media", {"spread": "signatures >= 2"}, {"validated": "repeated_checks >= 1", "files": "files >= 2"})


def _named(expression: str) -> set[str]:
    """Columns that a condition names."""
    return set(re.findall(r"\b[a-z_]+\b", expression)) - {"false", "true"}


def _truth(expression: str) -> Column:
    """The condition, false where the evidence of a finding is null."""
    return F.coalesce(F.expr(expression), F.lit(False))


def missing_evidence(spec: Hypothesis, columns: set[str]) -> list[str]:
    """Columns without which a builder cannot decide: those of its required checks and of its states."""
    return sorted({c for x in (*spec.required.values(), spec.applied, spec.eluded, spec.partial) for c in _named(x)} - columns)


def build(spec: Hypothesis, evidence: DataFrame) -> DataFrame:
    """finding_id, pattern, layer, state, confidence, checks of every anchor that passes all required checks.

    evidence: finding_id, kind, and the columns that the conditions name. Without a column of a required check or a state it raises an error; a discriminator
    without its columns is null in ``checks``, neither true nor false, and confirms nothing.
    """
    cols = set(evidence.columns)
    if lost := missing_evidence(spec, cols):
        raise ValueError(f"{spec.id}: no evidence of {', '.join(lost)}")
    required = F.lit(True)
    for c in spec.required.values():
        required = required & _truth(c)
    found = {k: _truth(c) if _named(c) <= cols else F.lit(None).cast("boolean") for k, c in spec.discriminators.items()}
    confirmed = F.lit(0)
    for c in found.values():
        confirmed = confirmed + F.coalesce(c, F.lit(False)).cast("int")
    state = F.when(_truth(spec.eluded), F.lit(STATES[3])).when(_truth(spec.applied), F.lit(STATES[2])).when(_truth(spec.partial), F.lit(STATES[1])).otherwise(F.lit(STATES[0]))
    step = F.least(confirmed, F.lit(LADDER.index(spec.ceiling)))
    confidence = F.when(F.col("state").isin("ausente", "parcial"), F.element_at(F.array(*map(F.lit, LADDER)), step + 1))
    checks = F.create_map(*[x for k, c in found.items() for x in (F.lit(k), c)]) if found else F.create_map().cast("map<string,boolean>")
    return evidence.filter(F.col("kind").isin(*spec.anchors)).filter(required).withColumn("state", state).select("finding_id", F.lit(spec.id).alias("pattern"), F.lit(spec.layer).alias("layer"), "state", confidence.alias("confidence"), checks.alias("checks"))


def missing_capability(spec: Hypothesis, evidence: DataFrame) -> DataFrame:
    """What an anchor gets where the language lacks what the builder needs: absent, without a confidence."""
    return evidence.filter(F.col("kind").isin(*spec.anchors)).select("finding_id", F.lit(spec.id).alias("pattern"), F.lit(spec.layer).alias("layer"), F.lit("ausente").alias("state"), F.lit(None).cast("string").alias("confidence"), F.create_map().cast("map<string,boolean>").alias("checks"))


HYPOTHESIS = "finding_id string, pattern string, layer string, state string, confidence string, checks map<string,boolean>"


def attach(evidence: DataFrame, capabilities: set[str] = frozenset(), extra: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, coverage) of all registered builders. coverage: pattern, status, missing.

    A builder runs (``corrio``) where the evidence has its columns, and else gives nothing but a row of coverage
    (``sin-evidencia``) that names what is missing; where the language lacks a capability its anchors are marked absent (``sin-capacidad``).
    """
    out, cover, cols = evidence.sparkSession.createDataFrame([], HYPOTHESIS), [], set(evidence.columns)
    for spec in HYPOTHESES.values():
        if not (spec.registered or extra):
            continue
        if not set(spec.needs) <= set(capabilities):
            cover.append((spec.id, "sin-capacidad", sorted(set(spec.needs) - set(capabilities))))
            out = out.unionByName(missing_capability(spec, evidence))
        elif lost := missing_evidence(spec, cols):
            cover.append((spec.id, "sin-evidencia", lost))
        else:
            cover.append((spec.id, "corrio", sorted({c for x in spec.discriminators.values() for c in _named(x)} - cols)))
            out = out.unionByName(build(spec, evidence))
    return out, evidence.sparkSession.createDataFrame(cover, "pattern string, status string, missing array<string>")


def arbitrate(hypotheses: DataFrame, places: DataFrame) -> DataFrame:
    """Drops an opportunity whose subject meets that of another pattern confirmed for the same finding. places: finding_id, pattern, file, start_line, end_line."""
    confirmed = hypotheses.filter(F.col("state").isin("ya-aplicado", "aplicado-eludido")).select("finding_id", F.col("pattern").alias("rival")).distinct()
    open_ = hypotheses.filter(F.col("state").isin("ausente", "parcial")).select("finding_id", "pattern").distinct()
    pairs = open_.join(confirmed, "finding_id").filter("pattern <> rival")
    a = places.select("finding_id", "pattern", "file", F.col("start_line").alias("a1"), F.col("end_line").alias("a2"))
    b = places.select("finding_id", F.col("pattern").alias("rival"), F.col("file").alias("file_b"), F.col("start_line").alias("b1"), F.col("end_line").alias("b2"))
    j = pairs.join(a, ["finding_id", "pattern"], "left").join(b, ["finding_id", "rival"], "left")
    meet = F.col("file").isNull() | F.col("file_b").isNull() | ((F.col("file") == F.col("file_b")) & (F.col("a1") <= F.col("b2")) & (F.col("b1") <= F.col("a2")))
    lost = j.filter(meet).select("finding_id", "pattern").distinct()
    return hypotheses.join(lost, ["finding_id", "pattern"], "left_anti")


def pattern_coverage(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.groupBy("pattern", "layer", "state").agg(F.count("*").alias("n"))


#: Fixed rules of advice by finding kind: (condition, advice).
ADVICE = {
    "duplication": (("copies >= 3", "extract the repeated block"), ("copies >= 2", "unify both copies")),
    "conditional-chain": (("chain >= 8", "replace the ladder by a table or types"), ("chain >= 5", "simplify the ladder")),
    "complexity": (("cognitive >= 30", "split the function"), ("cognitive >= 15", "extract the nested part")),
    "long-function": (("lines >= 90", "split the function by phases"), ("lines >= 45", "extract a step")),
}


def advise(findings: DataFrame) -> DataFrame:
    """Adds advice from the measures of a finding, the first rule that holds."""
    out = F.lit(None).cast("string")
    for kind, rules in ADVICE.items():
        for condition, text in reversed(rules):
            name, _, least = condition.split()
            out = F.when((F.col("detector_id") == kind) & (F.element_at("measures", name) >= float(least)), F.lit(text)).otherwise(out)
    return findings.withColumn("advice", out)
