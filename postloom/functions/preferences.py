"""Region preferences of many profiles at once: the region registry as constant maps, so every row is worked out where it lies.

The registry and its aliases are fixed and small; looking them up needs neither a join nor a shuffle.  ``regions`` has the same rules for a
single profile on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regions import ALIASES, FILLER, REGIONS

_TEXTS = "array<string>"


def _map(values: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast(_TEXTS)


def _none(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_TEXTS))


def normalized(regions: Column, custom: Column, remote_ok: Column, legacy: Column) -> Column:
    """(regions, custom, remote_ok): structured preferences win; otherwise legacy places are sorted into regions and custom ones.

    Unknown regions, blank places and fillers go, regions stand once, and remote work is fine where nothing says otherwise.  Null
    arrays are empty, null places are left out.
    """
    known = _texts(tuple(REGIONS))
    structured = (F.size(_none(regions)) > 0) | (F.size(_none(custom)) > 0) | remote_ok.isNotNull()
    own = F.array_distinct(F.filter(_none(regions), lambda r: F.array_contains(known, r)))
    trimmed = F.filter(F.transform(_none(custom), lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    places = F.filter(_none(legacy), lambda p: p.isNotNull())
    name = lambda p: F.lower(F.trim(p))
    far = lambda p: name(p).contains("remote")
    aliases = _map({k: F.lit(v) for k, v in ALIASES.items()})
    region = lambda p: F.try_element_at(aliases, name(p))
    found = F.array_distinct(F.filter(F.transform(F.filter(places, lambda p: ~far(p)), region), lambda r: r.isNotNull()))
    rest = F.transform(F.filter(places, lambda p: ~far(p) & region(p).isNull() & ~name(p).isin("", *FILLER)), lambda p: F.trim(p))
    some_remote = F.exists(places, far) | ((F.size(found) == 0) & (F.size(rest) == 0))
    return F.when(structured, F.struct(own.alias("regions"), trimmed.alias("custom"), F.coalesce(remote_ok, F.lit(True)).alias("remote_ok"))).otherwise(F.struct(found.alias("regions"), rest.alias("custom"), some_remote.alias("remote_ok")))


def _each(p: Column, values: dict[str, Column]) -> Column:
    """The registry's value for each of the regions, in order."""
    held = _map(values)
    return F.transform(p["regions"], lambda r: F.try_element_at(held, r))


def search_places(p: Column, most: int = 8) -> Column:
    """Primary places, custom ones, Remote, then secondary places, each once; two defaults where no place is wanted."""
    first = _each(p, {k: F.lit(r.search[0]) for k, r in REGIONS.items()})
    second = F.flatten(_each(p, {k: _texts(r.search[1:]) for k, r in REGIONS.items()}))
    remote = F.when(p["remote_ok"], _texts(("Remote",))).otherwise(_texts(()))
    nowhere = (F.size(p["regions"]) == 0) & (F.size(p["custom"]) == 0)
    return F.slice(F.array_distinct(F.when(nowhere, _texts(("Remote", "United States"))).otherwise(F.concat(first, p["custom"], remote, second))), 1, most)


def countries(p: Column) -> Column:
    found = F.array_distinct(F.flatten(_each(p, {k: _texts(r.countries) for k, r in REGIONS.items()})))
    return F.when(F.size(found) > 0, found).otherwise(_texts(("us",)))


def geos(p: Column) -> Column:
    found = F.array_distinct(_each(p, {k: F.lit(r.geo).cast("string") for k, r in REGIONS.items()}))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string")))


def describe(p: Column) -> Column:
    labels = _each(p, {k: F.lit(r.label) for k, r in REGIONS.items()})
    some = (F.size(p["regions"]) > 0) | (F.size(p["custom"]) > 0)
    said = F.concat_ws(", ", labels, p["custom"], F.when(p["remote_ok"] & some, "Remote"))
    return F.when(said != "", said).otherwise("No restriction")
