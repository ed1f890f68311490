"""Arrays with places from 1, and JSON paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(array: Column, place) -> Column:
    """The element at a place counted from 1; NULL beyond either end and for a NULL place."""
    place = place if isinstance(place, Column) else F.lit(place)
    return F.try_element_at(array, F.nullif(F.greatest(place.cast("int"), F.lit(0)), F.lit(0)))


def at_sql(array: str, place: str) -> str:
    return f"try_element_at({array}, nullif(greatest(CAST({place} AS INT), 0), 0))"


def json_path(steps: list) -> str:
    """The path of keys (text) and array places (numbers counted from 1)."""
    out = "$"
    for s in steps:
        out += f"[{s - 1}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']"
    return out


def json_extract_path(json: Column, *keys: str) -> Column:
    """What the keys lead to as text; NULL if a step isn't there."""
    return F.get_json_object(json, json_path(list(keys)))
