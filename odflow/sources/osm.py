"""Selection of map features: for points, polygons and lines the columns and the named predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags of each kind of feature.
POINT_COLUMNS = [
    "access", "aeroway", "amenity", "beds", "building", "capacity", "denomination", "emergency", "fuel", "health_facility:bed",
    "health_facility:level", "health_facility:type", "healthcare", "historic", "isced:level", "landuse", "leisure", "medical_system:western",
    "name", "opening_hours", "operator", "operator:type", "public_transport", "religion", "rooms", "shop", "staff_count:doctors",
    "staff_count:nurses", "status", "toilets:disposal", "toilets:handwashing", "tourism",
]
POLYGON_COLUMNS = sorted([*POINT_COLUMNS, "layer", "railway"])
LINE_COLUMNS = ["aeroway", "bridge", "building", "highway", "layer", "name", "oneway", "railway", "smoothness", "surface", "tunnel", "width"]
# The amenities, offices and shops of each theme.
FOOD_RETAIL = ["marketplace", "restaurant", "fast_food", "cafe", "bar", "pub"]
EDUCATION = ["kindergarten", "school", "college", "university", "language_school"]
EDUCATION_OFFICE = "educational_institution"
EMERGENCY = ["police", "fire_station"]
HEALTH = ["doctors", "dentist", "clinic", "toilets", "hospital", "pharmacy"]
HEALTH_SHOPS = ["herbalist", "nutrition_supplements"]
SPORT_LEISURE = ["stadium", "swimming pool", "pitch", "sport_centre"]
SINGLE_AMENITIES = ["fuel", "place_of_worship", "community_centre", "library", "bus_station"]


def _tag(name: str) -> Column:
    return F.col(f"`{name}`")


def _has(name: str) -> Column:
    return _tag(name).isNotNull()


def _is(name: str, *values: str) -> Column:
    found = _tag(name).isin(*values) if len(values) > 1 else _tag(name) == values[0]
    return F.coalesce(found, F.lit(False))


def predicates(kind: str, strict: bool = False) -> dict[str, Column]:
    """The labelled predicates of point, polygon or line; strict takes the sport leisures as the one literal that they were written as."""
    aeroway = _has("aeroway") | _is("building", "aerodrome")
    if kind == "line":
        return {"aeroway": aeroway, "road": _has("highway"), "railway": _has("railway")}
    leisure = _is("leisure", ", ".join(SPORT_LEISURE)) if strict else _is("leisure", *SPORT_LEISURE)
    found = {
        "building": _has("building"),
        "food_retail": _has("shop") | _has("tourism") | _is("amenity", *FOOD_RETAIL) | _has("office"),
        "education": _is("amenity", *EDUCATION) | _is("office", EDUCATION_OFFICE),
        "emergency": _has("emergency") | _is("amenity", *EMERGENCY),
        "health": _has("healthcare") | _is("amenity", *HEALTH) | _is("shop", *HEALTH_SHOPS),
        "landuse": _has("landuse") | _is("leisure", "park") | _is("amenity", "grave_yard"),
        **{a: _is("amenity", a) for a in SINGLE_AMENITIES},
        "historic": _has("historic"),
        "sport": _has("sport") | leisure,
        "aeroway": aeroway,
    }
    if kind == "polygon":
        found["train_station"] = _is("building", "train_station")
    elif kind != "point":
        raise ValueError(f"unknown kind {kind!r}")
    return found


COLUMNS = {"point": POINT_COLUMNS, "polygon": POLYGON_COLUMNS, "line": LINE_COLUMNS}


def select_features(df: DataFrame, kind: str, themes: list[str] | None = None, keep: list[str] = (), strict: bool = False) -> DataFrame:
    """Rows that any of the themes (default: all) holds for, then the kind's columns; predicates see columns that go."""
    found = predicates(kind, strict)
    return df.where(reduce(Column.__or__, [found[t] for t in themes or found])).select(*keep, *[_tag(c) for c in COLUMNS[kind]])
