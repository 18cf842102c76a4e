"""Closed schemas of JSON documents, checked at every depth.

A schema is a small tree of nodes. It is compiled to one expression over a
parsed document, which gives a finding for every place that differs: a value
of another type, a value outside those allowed, a list or text that is too
short, a key that is missing and a key that the schema does not know. Lists of
objects are walked element by element inside the row.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let

FINDING = "array<struct<path:string,problem:string,expected:string,found:string>>"


@dataclass(frozen=True)
class Text:
    """A string: one of ``choices`` if there are any, of at least ``least`` characters."""

    choices: tuple[str, ...] = ()
    least: int = 0
    nullable: bool = False


@dataclass(frozen=True)
class Whole:
    """An integer, one of ``choices`` if there are any."""

    choices: tuple[int, ...] = ()
    nullable: bool = False


@dataclass(frozen=True)
class Listed:
    """A list of at least ``least`` items of one kind."""

    item: Node
    least: int = 0
    nullable: bool = False


@dataclass(frozen=True)
class Record:
    """An object with exactly these keys."""

    fields: Mapping[str, Node] = field(default_factory=dict)
    nullable: bool = False


@dataclass(frozen=True)
class ByTag:
    """Another node for each value of a text beside it; other values have findings of their own and leave this one unread."""

    tag: str
    cases: Mapping[str, Node] = field(default_factory=dict)
    nullable: bool = False


Node = Text | Whole | Listed | Record | ByTag


def _name(node: Node) -> str:
    kind = {Text: "string", Whole: "integer", Listed: "array", Record: "object", ByTag: "object"}[type(node)]
    return f"{kind} or null" if node.nullable else kind


def kind_of(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``integer``, ``number``, ``boolean`` or ``null``; null where there is no value."""
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null",
             "BIGINT": "integer", "INT": "integer", "SMALLINT": "integer", "TINYINT": "integer"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return let(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0),
               lambda name: F.coalesce(F.try_element_at(table, name), F.when(name.isNotNull(), "number")))


def _none() -> Column:
    return F.array().cast(FINDING)


def _one(path: Column, problem: str, expected: str, found: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem"), F.lit(expected).alias("expected"), found.cast("string").alias("found"))).cast(FINDING)


def findings(value: Column, node: Node, path: Column) -> Column:
    """The findings of a variant that is there, as an array."""
    want = _name(node).removesuffix(" or null")
    if isinstance(node, Text):
        text = F.try_variant_get(value, "$", "string")
        inside = F.when(F.length(text) < node.least, _one(path, "length", f"at least {node.least}", F.length(text)))
        if node.choices:
            inside = inside.when(~text.isin(*node.choices), _one(path, "value", "|".join(node.choices), text))
        inside = inside.otherwise(_none())
    elif isinstance(node, Whole):
        number = F.try_variant_get(value, "$", "bigint")
        inside = F.when(~number.isin(*node.choices), _one(path, "value", "|".join(map(str, node.choices)), number)).otherwise(_none()) \
            if node.choices else _none()
    elif isinstance(node, Listed):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, i: findings(x, node.item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        inside = F.when(F.size(items) < node.least, _one(path, "length", f"at least {node.least}", F.size(items))).otherwise(F.flatten(each))
    elif isinstance(node, Record):
        inside = _record(value, node, path)
    else:
        raise TypeError("a tagged node stands in a record")

    def judged(kind: Column) -> Column:
        wrong = F.when(kind == want, inside)
        if node.nullable:
            wrong = wrong.when(kind == "null", _none())
        return wrong.otherwise(_one(path, "type", _name(node), kind))
    return let(kind_of(value), judged)


def _record(value: Column, node: Record, path: Column) -> Column:
    known = F.array(*[F.lit(k) for k in node.fields]).cast("array<string>")
    extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(value)), known))
    parts = [F.transform(extra, lambda k: F.struct(
        F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown key").alias("problem"), F.lit("nothing").alias("expected"),
        F.lit("a value").alias("found"))).cast(FINDING)]
    for name, child in node.fields.items():
        parts.append(let(F.try_variant_get(value, f"$.{name}", "variant"), functools.partial(_member, value, name, child, path)))
    return F.concat(*parts)


def _member(value: Column, name: str, child: Node, path: Column, here: Column) -> Column:
    at = F.concat(path, F.lit(f".{name}"))
    if isinstance(child, ByTag):
        tag = F.try_variant_get(value, f"$.{child.tag}", "string")
        inside = F.when(tag.isNull(), _none())
        for label, case in child.cases.items():
            inside = inside.when(tag == label, findings(here, case, at))
        inside = inside.otherwise(_none())
    else:
        inside = findings(here, child, at)
    return F.when(here.isNull(), _one(at, "missing", _name(child), F.lit(None))).otherwise(inside)


def schema_findings(documents: DataFrame, node: Record, *, json: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with path, problem, expected and found, a row for each finding in each JSON text.

    What is no JSON, null included, is one finding at ``$``. Documents without findings have no row.
    """
    parsed = documents.select(*keep, F.try_parse_json(json).alias("_v"))
    found = F.when(F.col("_v").isNull(), _one(F.lit("$"), "syntax", "JSON", F.lit(None))).otherwise(findings(F.col("_v"), node, F.lit("$")))
    return parsed.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*")
