"""Entities, prefixes and style texts as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in the order in which they are decoded; prefixes of newer functions.
ENTITIES = (("quot", '"'), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("apos", "'"))
PREFIXES = ("xlfn", "xll", "xlws", "xlpm", "xleta", "xlnm")


def decode_entities(text: Column) -> Column:
    """Five named entities, one after another, in either case; so &amp;lt; becomes <."""
    return reduce(lambda t, e: F.regexp_replace(t, f"(?i)&{e[0]};", e[1]), ENTITIES, text)


def clean_formula(text: Column) -> Column:
    """Formula without the prefixes of newer functions."""
    return F.regexp_replace(text, rf"(?i)_({'|'.join(PREFIXES)})\.", "")


def with_equals(formula: Column) -> Column:
    """Formula behind one equals sign; null stays null, empty gives null."""
    return F.when(formula.startswith("="), formula).when(F.length(formula) > 0, F.concat(F.lit("="), formula))


def css_map(css: Column) -> Column:
    """Map of the properties of a style text; a repeated property keeps its last value."""
    parts = F.filter(F.transform(F.split(css, ";"), lambda p: F.trim(p)), lambda p: F.instr(p, ":") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.regexp_replace(p, "^[^:]*:", ""))))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["col1"] == p["col1"]))
    return F.map_from_entries(last)


def without_property(css: Column, name: str) -> Column:
    """Style text without a property; separators stay clean."""
    parts = F.filter(F.transform(F.split(css, ";"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith(f"{name}:"))
    return F.array_join(parts, "; ")


def sheet_name_of(ref: Column) -> Column:
    """The sheet of a reference without quotes; null if there is none."""
    return F.when(F.instr(ref, "!") > 0, F.regexp_replace(F.regexp_extract(ref, r"^(.*)!", 1), r"^'|'$", ""))


def stable_guid(*parts: Column) -> Column:
    """An identifier in the form of a GUID that only depends on the parts, so that a row keeps it however often it is computed."""
    h = F.upper(F.md5(F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary")))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
