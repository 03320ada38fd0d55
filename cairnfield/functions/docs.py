"""Algebra of open JSON documents.

At rest a document is a JSON string; in flight it is MAP<STRING, VARIANT>: one level of keys whose values keep their
JSON types. Merging needs spark.sql.mapKeyDedupPolicy=LAST_WIN, which session() sets; merge() itself does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOC = "map<string,variant>"


def doc(json: Column | str) -> Column:
    """A JSON object as a document; null, and anything but an object, as an empty one."""
    parsed = F.try_parse_json(F.col(json) if isinstance(json, str) else json)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast(DOC)).otherwise(empty())


def empty() -> Column:
    return F.parse_json(F.lit("{}")).cast(DOC)


def text(document: Column) -> Column:
    return F.to_json(document)


def value(x: Column) -> Column:
    """A SQL value as a document's value; null becomes JSON null."""
    return F.coalesce(F.to_variant_object(F.struct(x.alias("v"))).cast(DOC).getItem("v"), F.parse_json(F.lit("null")))


def build(**fields: Column) -> Column:
    """A document of named values."""
    return F.to_variant_object(F.struct(*[v.alias(k) for k, v in fields.items()])).cast(DOC)


def field(document: Column, key: str, kind: str = "string") -> Column:
    """The value of a key, null if missing, JSON null or not of that kind."""
    return F.try_variant_get(document.getItem(key), "$", kind)


def has(document: Column, *keys: str) -> Column:
    """Whether any of the keys is there."""
    return F.arrays_overlap(F.map_keys(document), F.array(*map(F.lit, keys)))


def without(document: Column, *keys: str) -> Column:
    return F.map_filter(document, lambda k, _: ~k.isin(*keys))


def merge(left: Column, right: Column) -> Column:
    """Shallow merge; the right side wins."""
    keys = F.map_keys(right)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(keys, k)), right)


def put(document: Column, key: str, x: Column) -> Column:
    """The document with one key set, or added."""
    return merge(document, build(**{key: x}))


def rename(document: Column, old: str, new: str) -> Column:
    """The value of `old` under `new`; documents without `old` stay as they are."""
    moved = F.map_concat(without(document, old, new), F.create_map(F.lit(new), document.getItem(old)))
    return F.when(has(document, old), moved).otherwise(document)


def strip_nulls(document: Column) -> Column:
    return F.map_filter(document, lambda _, v: v.isNotNull() & ~F.is_variant_null(v))


def compact(document: Column, drop_false: bool = False) -> Column:
    """Without nulls, empty texts, empty arrays and empty objects, and without false if asked."""
    blank = ["null", '""', "[]", "{}", *(["false"] if drop_false else [])]
    return F.map_filter(document, lambda _, v: v.isNotNull() & ~F.is_variant_null(v) & ~F.to_json(v).isin(*blank))


def patch(document: Column, other: Column, allowed: list[str]) -> Column:
    """Allowed keys of the other document overwrite, unless their value is null."""
    return merge(document, strip_nulls(F.map_filter(other, lambda k, _: k.isin(*allowed))))


def promote(top: Column, custom: Column, keys: list[str]) -> tuple[Column, Column]:
    """Fields moved from a custom document to the top level; what the top level has already wins."""
    moved = F.map_filter(custom, lambda k, v: k.isin(*keys) & v.isNotNull() & ~F.is_variant_null(v))
    return merge(moved, strip_nulls(top)), without(custom, *keys)


def contains_object(array: Column, **fields: Column) -> Column:
    """Whether an array of structs has an element with these field values."""
    found = F.lit(True)

    def same(e: Column) -> Column:
        out = found
        for k, v in fields.items():
            out = out & (e[k] == v)
        return out

    return F.exists(array, same)


def registered(array: Column, key: str, element: Column) -> Column:
    """The array with the element at its end, in place of those with the same key value."""
    return F.concat(F.filter(array, lambda e: ~e[key].eqNullSafe(element[key])), F.array(element))


def without_at(array: Column, index: int) -> Column:
    """The array without its element at an index from 0, or from the end if below."""
    return F.filter(array, lambda _, i: i != (F.size(array) + index if index < 0 else F.lit(index)))


def pretty(document: Column) -> Column:
    """A document's text over several lines, for people."""
    return F.to_json(document, {"pretty": "true"})


def patched(array: Column, where: Callable[[Column], Column], **fields: Column) -> Column:
    """The array with fields of its structs set where the test of the element is true."""

    def one(e: Column) -> Column:
        changed = e
        for k, x in fields.items():
            changed = changed.withField(k, x)
        return F.when(F.coalesce(where(e), F.lit(False)), changed).otherwise(e)

    return F.transform(array, one)
