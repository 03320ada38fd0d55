"""Text functions: keys, tokens, labels, ids, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not tell campgrounds apart.
GENERIC_WORDS = ["campground", "campsite", "camp", "camping", "resort", "rv", "park", "the", "and", "of", "a", "dca", "llc", "inc", "co", "state", "county"]


def site_key(label: Column) -> Column:
    """struct<prefix, number> of a site's label, both texts: `Site 60E` is ('', '60'), `A2` is ('A', '2'); others are all prefix."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(label, F.lit(""))), "[^A-Z0-9]+", ""), "^SITE", "")
    form = r"^([A-Z]*)(\d+)[A-Z]*$"
    fits = bare.rlike(form)
    return F.struct(F.when(fits, F.regexp_extract(bare, form, 1)).otherwise(bare).alias("prefix"), F.when(fits, F.regexp_extract(bare, form, 2)).otherwise("").alias("number"))


def is_site_label(label: Column) -> Column:
    return label.rlike(r"^\d{1,3}[eE]?$")


def tokens(name: Column, generic: list[str] = GENERIC_WORDS) -> Column:
    """Distinctive lower-case words of three letters or more."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), "'", "")
    found = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*generic)))


def same_place(want: Column, got: Column, generic: list[str] = GENERIC_WORDS) -> Column:
    """Whether the names share a distinctive word; a wanted name without any accepts all."""
    wanted = tokens(F.coalesce(want, F.lit("")), generic)
    return (F.size(wanted) == 0) | F.arrays_overlap(wanted, tokens(F.coalesce(got, F.lit("")), generic))


def uuid_of(text: Column) -> Column:
    """A deterministic id: the digest of a text in the 8-4-4-4-12 form."""
    return F.regexp_replace(F.md5(text), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def route_label(names: Column) -> Column:
    """The first three trail names as one label."""
    label = F.array_join(F.transform(F.slice(names, 1, 3), lambda n: F.regexp_replace(n, " Trail", "")), " + ")
    return F.when(F.size(names) == 0, F.lit("Unnamed loop")).when(F.lower(label).contains("loop"), label).otherwise(F.concat(label, F.lit(" Loop")))


def climb_kind(bouldering: Column, **kinds: Column) -> Column:
    """Bouldering wins; else the kinds, in the order given, joined by /; else unknown."""
    joined = F.concat_ws("/", *[F.when(v, F.lit(k)) for k, v in kinds.items()])
    return F.when(bouldering, F.lit("boulder")).when(joined != "", joined).otherwise(F.lit("unknown"))


_TAG = re.compile(r"\{\{\s*(#if\s+([\w.]+)|/if|([\w.]+))\s*\}\}")


def template(source: str, field) -> Column:
    """A popup template compiled to one Column. {{ key }} is the key's text, {{#if key}} ... {{/if}} shows when it is truthy
    (there, and neither empty, 0 nor false) and may nest. `field` gives a Column of text for a key."""
    stack: list[tuple[Column | None, list[Column]]] = [(None, [])]
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(F.lit(source[at : m.start()]))
        at = m.end()
        if m[2]:
            shown = F.coalesce(field(m[2]), F.lit(""))
            stack.append((~shown.isin("", "0", "false", "null"), []))
        elif m[1] == "/if":
            if len(stack) == 1:
                raise ValueError(f"{{{{/if}}}} without {{{{#if}}}} at {m.start()}")
            test, parts = stack.pop()
            stack[-1][1].append(F.when(test, F.concat(*parts, F.lit(""))).otherwise(F.lit("")))
        else:
            stack[-1][1].append(F.coalesce(field(m[3]), F.lit("")))
    if len(stack) > 1:
        raise ValueError("{{#if}} without {{/if}}")
    return F.concat(*stack[0][1], F.lit(source[at:]))


def iso_date(text: Column) -> Column:
    """A date of the form YYYY-MM-DD; null for other forms and for days that there are not."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def url(base: str, **parameters: Column) -> Column:
    """An address with parameters in the given order; those without a value are left out."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in parameters.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))
