"""Closed scenario manifests: every rule as a violation column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .closed_schema import ByTag, Listed, Record, Text, Whole

# Fixed values of the closed schema.
MUTATION_TYPES = ("base", "observation_mask", "source_conflict", "retraction_branch")
GOLD_TRACKS = ("source_grounded", "conditional_binding", "synthetic_control")
TASKS = ("T01", "T02", "T03", "T04", "T05", "T06", "T07")
FOUNDATIONS = ("state", "event", "aggregate", "bridge", "entity_resolution", "policy_version")
SEED = 42
REQUIRED_SPEC = {
    "observation_mask": ("closure_policy", "invariant_refs", "removed_record_ids", "seed_record_ids"),
    "source_conflict": ("added_record_ids", "invariant_refs", "logical_fact_id", "removed_record_ids"),
    "retraction_branch": ("added_record_ids", "invariant_refs", "removed_record_ids", "target_assertion_ids"),
}
NON_EMPTY_SPEC = {
    "observation_mask": ("invariant_refs", "removed_record_ids", "seed_record_ids"),
    "source_conflict": ("added_record_ids", "invariant_refs"),
    "retraction_branch": ("added_record_ids", "invariant_refs", "target_assertion_ids"),
}
ID_ARRAYS = ("public_snapshot_refs", "semantic_case_ids", "query_ids")


def _sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values)) == values


def _bad_spec(mutation: Column, spec: Column) -> Column:
    """The JSON object does not have exactly the keys and contents its type requires."""
    keys = F.array_sort(F.json_object_keys(spec))
    bad = F.lit(False)
    for kind, required in REQUIRED_SPEC.items():
        exact_keys = keys == F.array(*[F.lit(k) for k in required])
        filled = F.lit(True)
        for name in NON_EMPTY_SPEC[kind]:
            filled = filled & (F.coalesce(F.json_array_length(F.get_json_object(spec, f"$.{name}")), F.lit(0)) > 0)
        if kind == "observation_mask":
            filled = filled & (F.get_json_object(spec, "$.closure_policy") == "remove_dependents")
        bad = bad | ((mutation == kind) & ~F.coalesce(exact_keys & filled, F.lit(False)))
    return bad


def checks() -> dict[str, Column]:
    """Rule name to the condition under which a manifest breaks it."""
    base = F.col("mutation_type") == "base"
    no_parent = F.col("parent_variant_id").isNull()
    outside = lambda c, allowed: F.col(c).isNotNull() & ~F.col(c).isin(*allowed)
    rules = {
        "unknown mutation type": ~F.col("mutation_type").isin(*MUTATION_TYPES),
        "unknown gold track": ~F.col("gold_track").isin(*GOLD_TRACKS),
        "unknown task": outside("task_id", TASKS),
        "unknown foundation task": outside("foundation_task", FOUNDATIONS),
        "another seed": F.col("seed") != SEED,
        "neither one task nor one foundation task": F.col("task_id").isNull() == F.col("foundation_task").isNull(),
        "a base has a parent or a mutation":
            base & (~no_parent | (F.size(F.json_object_keys("mutation_spec")) > 0)),
        "a mutation without a parent": ~base & no_parent,
        "mutation details do not fit the type": _bad_spec(F.col("mutation_type"), F.col("mutation_spec")),
    }
    for name in ID_ARRAYS:
        rules[f"{name} is empty"] = F.size(name) == 0
        rules[f"{name} is not sorted without repeats"] = ~_sorted_unique(F.col(name))
    return rules


def violations(manifests: DataFrame, key: str = "scenario_id") -> DataFrame:
    """One row per manifest and broken rule."""
    broken = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(True)), name) for name, cond in checks().items()]),
                      lambda v: v.isNotNull())
    return manifests.select(key, F.explode(broken).alias("violation"))


def unknown_keys(lines: DataFrame, allowed: list[str], json: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON lines carrying a key the closed schema does not have."""
    extra = F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed]))
    return lines.select(*(keep or [json]), F.explode(extra).alias("unknown_key"))


def manifest_schema(dataset_version: str, schema_version: str = "1.1", spec_version: str = "0.2.0") -> Record:
    """The closed schema of a manifest for one version of a dataset, nested objects included."""
    ids, some = Listed(Text()), Listed(Text(), least=1)
    spec = {
        "base": Record({}),
        "observation_mask": Record({"seed_record_ids": some, "removed_record_ids": some, "closure_policy": Text(("remove_dependents",)),
                                    "invariant_refs": some}),
        "source_conflict": Record({"logical_fact_id": Text(), "removed_record_ids": ids, "added_record_ids": some, "invariant_refs": some}),
        "retraction_branch": Record({"target_assertion_ids": some, "removed_record_ids": ids, "added_record_ids": some, "invariant_refs": some}),
    }
    policy = Record({"kind": Text(("real_snapshot", "synthetic_version")), "id": Text(least=1)})
    return Record({
        "schema_version": Text((schema_version,)), "release_spec_version": Text((spec_version,)), "dataset_version": Text((dataset_version,)),
        "world_id": Text(), "scenario_id": Text(), "scenario_variant_id": Text(), "parent_variant_id": Text(nullable=True),
        "mutation_type": Text(MUTATION_TYPES), "mutation_spec": ByTag("mutation_type", spec), "ledger_id": Text(), "scope_id": Text(),
        "gold_track": Text(GOLD_TRACKS), "task_id": Text(TASKS, nullable=True), "foundation_task": Text(FOUNDATIONS, nullable=True),
        "policy_snapshot_refs": Listed(policy), "public_snapshot_refs": some, "semantic_case_ids": some, "query_ids": some,
        "split_group": Text(), "seed": Whole((SEED,)),
    })
