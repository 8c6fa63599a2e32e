"""Arrays, maps and JSON: the shapes that comments and targets come in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_items(text: Column) -> Column:
    """The elements of a JSON list as texts (objects stay JSON); a bare value is a list of one; invalid JSON is null."""
    clean = F.trim(text)
    listed = F.when(clean.startswith("["), clean).otherwise(F.concat(F.lit("["), clean, F.lit("]")))
    return F.from_json(listed, "array<string>")


def first_pair(item: Column) -> Column:
    """The first pair of a JSON object as struct(key, value), in stored order: shorter keys first, then by byte. Null for
    anything but an object, and for an empty one."""
    pairs = F.map_entries(F.when(item.startswith("{"), F.from_json(item, "map<string,string>")))
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(F.octet_length(p["key"]).alias("n"), p["key"].alias("key"), p["value"].alias("value"))))
    return F.get(ordered, F.lit(0))


def ordered_entries(mapping: Column) -> Column:
    """Entries of a map in stored order: shorter keys first, then by byte."""
    rows = F.transform(F.map_entries(mapping), lambda p: F.struct(F.octet_length(p["key"]).alias("n"), p["key"].alias("key"), p["value"].alias("value")))
    return F.array_sort(rows)


def merged(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins. Doesn't depend on the session's policy for duplicate keys."""
    own = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(F.map_concat(own, right))


def alternating_map(items: Column) -> Column:
    """[name, code, name, code...] as {code: name}; a leftover item is dropped, of equal codes the last one stays."""
    even = F.filter(items, lambda _, i: i % 2 == 0)
    odd = F.filter(items, lambda _, i: i % 2 == 1)
    pairs = F.filter(F.arrays_zip(odd.alias("c"), F.slice(even, 1, F.greatest(F.size(odd), F.lit(0))).alias("n")), lambda p: p["c"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["c"] == p["c"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["c"], p["n"])))


def without_empty(items: Column) -> Column:
    """[""] becomes []."""
    return F.filter(items, lambda x: (x.isNotNull()) & (x != ""))


def index_map(items: Column) -> Column:
    """{'0': first, '1': second...}, the form in which a batch goes to a scorer."""
    return F.map_from_entries(F.transform(items, lambda x, i: F.struct(i.cast("string"), x)))


def chunk(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size``; an empty or null one gives none."""
    count = F.ceil(F.size(items) / size).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(items, i * size + 1, F.lit(size)))
    return F.when(F.size(items) > 0, made).otherwise(F.array().cast("array<array<string>>"))


def fingerprint(*columns: Column) -> Column:
    """Hash of fields for change detection; null and empty fields differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))
