"""Findings of the closed schema against a plain recursive check."""

import json
import random

from chronofact.operators import closed_schema as cs, manifest

SCHEMA = cs.Record({
    "name": cs.Text(least=2), "kind": cs.Text(("a", "b")), "n": cs.Whole((1, 2), nullable=True), "m": cs.Whole(),
    "tags": cs.Listed(cs.Text(nullable=True), least=1),
    "parts": cs.Listed(cs.Record({"id": cs.Text(least=1), "sub": cs.Listed(cs.Whole())}), nullable=True),
    "spec": cs.ByTag("kind", {"a": cs.Record({}), "b": cs.Record({"x": cs.Listed(cs.Record({"y": cs.Text()}))})})})


def kind(value):
    if value is None:
        return "null"
    return {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(value)]


def plain(value, node, path="$"):
    want = cs._name(node)
    if node.nullable and value is None:
        return []
    if kind(value) != want.removesuffix(" or null"):
        return [(path, "type", want, kind(value))]
    if isinstance(node, cs.Text):
        if len(value) < node.least:
            return [(path, "length", f"at least {node.least}", str(len(value)))]
        return [(path, "value", "|".join(node.choices), value)] if node.choices and value not in node.choices else []
    if isinstance(node, cs.Whole):
        return [(path, "value", "|".join(map(str, node.choices)), str(value))] if node.choices and value not in node.choices else []
    if isinstance(node, cs.Listed):
        if len(value) < node.least:
            return [(path, "length", f"at least {node.least}", str(len(value)))]
        return [f for i, x in enumerate(value) for f in plain(x, node.item, f"{path}[{i}]")]
    out = [(f"{path}.{k}", "unknown key", "nothing", "a value") for k in value if k not in node.fields]
    for name, child in node.fields.items():
        if name not in value:
            out.append((f"{path}.{name}", "missing", cs._name(child), None))
        elif isinstance(child, cs.ByTag):
            case = child.cases.get(value[child.tag]) if isinstance(value.get(child.tag), str) else None
            out += plain(value[name], case, f"{path}.{name}") if case else []
        else:
            out += plain(value[name], child, f"{path}.{name}")
    return out


def spoiled(value, rng):
    """``value`` with something replaced, dropped or added somewhere."""
    if rng.random() < 0.25:
        return rng.choice([None, 7, 2.5, True, "", "a", [], {}, [1], {"z": 1}])
    if isinstance(value, dict):
        out = {k: spoiled(v, rng) if rng.random() < 0.4 else v for k, v in value.items() if rng.random() > 0.07}
        return out | ({"extra": rng.choice([None, 1, {}])} if rng.random() < 0.15 else {})
    if isinstance(value, list):
        return [spoiled(v, rng) if rng.random() < 0.4 else v for v in value]
    return value


def test_findings_equal_a_plain_check(spark):
    rng = random.Random(6)
    fine = [{"name": "xx", "kind": "a", "n": None, "m": 5, "tags": ["t", None], "parts": None, "spec": {}},
            {"name": "yy", "kind": "b", "n": 2, "m": -1, "tags": ["é"], "parts": [{"id": "i", "sub": [1, 2]}, {"id": "j", "sub": []}], "spec": {"x": [{"y": "q"}]}}]
    docs = [*fine, *[spoiled(rng.choice(fine), rng) for _ in range(200)]]
    texts = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{"), (902, "")]
    rows = cs.schema_findings(spark.createDataFrame(texts, "id int, value string"), SCHEMA, keep=("id",)).collect()
    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    want = {i: sorted(plain(d, SCHEMA), key=str) for i, d in enumerate(docs)} | {i: [("$", "syntax", "JSON", None)] for i in (900, 901, 902)}
    assert {i: sorted(f, key=str) for i, f in got.items()} == {i: f for i, f in want.items() if f}
    assert not plain(fine[0], SCHEMA) and not plain(fine[1], SCHEMA)


def test_every_rule_of_the_manifest_is_closed():
    schema = manifest.manifest_schema("d")
    assert set(schema.fields["mutation_spec"].cases) == set(manifest.MUTATION_TYPES)
    for kind_, required in manifest.REQUIRED_SPEC.items():
        case = schema.fields["mutation_spec"].cases[kind_]
        assert tuple(sorted(case.fields)) == required
        assert {n for n, c in case.fields.items() if isinstance(c, cs.Listed) and c.least} == set(manifest.NON_EMPTY_SPEC[kind_])
