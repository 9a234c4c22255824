"""Location column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.text import _any_of, _col, let, strip, title_case


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _cue_value(description: Column, cue: str) -> Column:
    """Text after the first occurrence of a cue, up to a comma or line end."""
    # a Unicode case-insensitive match; [^\n] because Java's dot also stops at \r
    pattern = rf"(?iU){re.escape(cue)}\s*([^\n]+)"
    found = F.regexp_extract(description, pattern, 1)
    return strip(F.substring_index(strip(found), ",", 1))


def extract_location_patterns(description, profile: str = "v1") -> Column:
    """First cue (in list order) followed by a usable value; null when none."""

    def usable(value: Column) -> Column:
        ok = F.length(value) > 1
        if profile == "v3":
            low = F.lower(value)
            ok = ok & ~_any_of([F.contains(low, F.lit(f)) for f in rules.LOCATION_FALSE_POSITIVES])
        return ok

    text = F.coalesce(_col(description), F.lit(""))
    # filter() keeps each value to one evaluation; coalesce stops at the first hit
    cues = rules.LOCATION_CUES[profile]
    hits = [F.get(F.filter(F.array(_cue_value(text, cue)), usable), F.lit(0)) for cue in cues]
    value = F.substring(F.coalesce(*hits), 1, rules.LOCATION_MAX_CHARS)
    # most texts hold no cue at all: one search tells
    any_cue = "|".join(re.escape(cue) for cue in cues)
    return F.when(text.rlike(f"(?iU){any_cue}"), value)


def location_from_handle(handle, profile: str = "v1") -> Column:
    """Country of the handle's last label; null without a dot or a known label."""
    handle = F.lower(_col(handle))
    last = F.substring_index(handle, ".", -1)
    return F.when(F.contains(handle, F.lit(".")), _lookup(rules.TLD_COUNTRY[profile], last))


def location_from_mentions(description, word_boundary: bool = False) -> Column:
    """First listed country, then first listed city, named in a profile text.

    Substring matches by default ("UK" hits "ukraine"); ``word_boundary=True``
    asks for whole words.
    """
    names = rules.MENTIONED_COUNTRIES + rules.MENTIONED_CITIES

    def first_hit(low: Column) -> Column:
        hit = F
        for name in names:
            if word_boundary:
                test = low.rlike(rf"(?U)\b{re.escape(name.lower())}\b")
            else:
                test = F.contains(low, F.lit(name.lower()))
            hit = hit.when(test, name)
        return hit

    return let(F.lower(_col(description)), first_hit)


def resolve_location(description, handle, profile: str = "v1", word_boundary: bool = False) -> Column:
    """Profile text, then handle, then (v1 only) mentions; ``''`` when unknown."""
    parts = [extract_location_patterns(description, profile), location_from_handle(handle, profile)]
    if profile == "v1":
        parts.append(location_from_mentions(description, word_boundary))
    return F.coalesce(*parts, F.lit(""))


def country_from_location(location) -> Column:
    """Country of a free-text location: text after the last comma, aliases applied."""
    location = _col(location)
    last = F.upper(strip(F.substring_index(location, ",", -1)))
    return let(
        last,
        lambda key: F.when(location.isNull(), "Unknown").otherwise(
            F.coalesce(_lookup(rules.COUNTRY_ALIASES, key), title_case(key))),
    )


def location_key(location) -> Column:
    """Join key of a location: stripped and lower-cased."""
    return F.lower(strip(location))


def first_part(location) -> Column:
    return strip(F.substring_index(_col(location), ",", 1))


def geo_point(coordinates, bbox, place_name, country_code) -> Column:
    """Struct (latitude, longitude, location_type, place_name, country) or null.

    A point [lon, lat] wins over the centre of a bounding box
    [min_lon, min_lat, max_lon, max_lat].
    """
    point, box = _col(coordinates), _col(bbox)

    def located(lat, lon, kind, name, country):
        return F.struct(
            lat.alias("latitude"), lon.alias("longitude"),
            F.lit(kind).alias("location_type"),
            name.alias("place_name"), country.alias("country"))

    def at(array, i):
        return F.get(array, F.lit(i))

    return (
        F.when(F.size(point) >= 2,
               located(at(point, 1), at(point, 0), "coordinates", F.lit(""), F.lit("")))
        .when(F.size(box) >= 4,
              located((at(box, 1) + at(box, 3)) / 2, (at(box, 0) + at(box, 2)) / 2,
                      "place_center",
                      F.coalesce(_col(place_name), F.lit("")),
                      F.coalesce(_col(country_code), F.lit("")))))


def in_region(location, region: str, profile: str = "v3") -> Column:
    """Membership in the European or US location set of a profile."""
    table = {"europe": rules.EUROPEAN_LOCATIONS, "us": rules.US_LOCATIONS}[region]
    return _col(location).isin(*table[profile])
