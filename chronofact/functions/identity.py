"""Deterministic identifiers, canonical JSON and content hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

from .text import col

# The name space of stable identifiers and the root seed.
NAMESPACE = "a1c3b357-506c-5760-a0ce-f06ba8b1cd03"
ROOT_SEED = 42


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5 identifier of ``name``, without a Python worker."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def stable_id(object_type: str, key: Column | str, namespace: str = NAMESPACE) -> Column:
    return uuid5(F.concat(F.lit(f"{object_type}:"), col(key).cast("string")), namespace)


def component_seed(stream: str, component: Column | str, root_seed: int = ROOT_SEED) -> Column:
    """Unsigned 64-bit seed, the leading eight bytes of a SHA-256 digest."""
    digest = F.sha2(F.concat(F.lit(f"{root_seed}|{stream}|"), col(component).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast(T.DecimalType(20, 0))


def _ordered(value: Column, dtype: T.DataType) -> Column:
    """The same value with struct fields and map keys in sorted order."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _ordered(F.element_at(value, k), dtype.valueType)))
    return value


def canonical_json(value: Column, dtype: T.DataType) -> Column:
    """Compact JSON with sorted keys and explicit nulls, non-ASCII kept.

    ``dtype`` is the type of ``value`` (``df.schema[name].dataType``). Use it
    on strings, integers, booleans and nestings of them: floating point
    numbers print differently in different engines.
    """
    return F.to_json(_ordered(value, dtype), {"ignoreNullFields": "false"})


def canonical_row(columns: dict[str, Column]) -> Column:
    """Canonical JSON object of flat columns."""
    fields = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def canonical_text(json_text: Column | str) -> Column:
    """Canonical form of JSON text: sorted keys at every level, no spaces.

    Integral floats such as ``1.0`` print as integers.
    """
    return F.to_json(F.parse_json(col(json_text)))


def canonical_object_without(json_text: Column | str, dropped: Iterable[str]) -> Column:
    """Canonical JSON of an object after removing top-level keys."""
    entries = F.parse_json(col(json_text)).cast("map<string,variant>")
    keys = F.array_sort(F.filter(F.map_keys(entries), lambda k: ~k.isin(*dropped)))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(entries, k))))


def json_string(text: Column | str) -> Column:
    """A string as a quoted JSON value."""
    whole = F.to_json(F.struct(F.coalesce(col(text), F.lit("")).alias("v")))
    return F.when(col(text).isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def content_hash(canonical: Column) -> Column:
    """SHA-256 of canonical bytes, which end with a line feed."""
    return F.sha2(F.concat(canonical, F.lit("\n")), 256)


def identity_hash(canonical: Column) -> Column:
    """SHA-256 of canonical JSON without the line feed, used in identities."""
    return F.sha2(canonical, 256)


def payload_hash(record_json: Column | str) -> Column:
    """Hash of a ledger record, leaving out what may change without changing its content."""
    return content_hash(canonical_object_without(record_json, ("payload_hash", "commit_seq", "text")))
