"""Features of locations from map geometry: areas by land use, lengths of roads, counts of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import join_within


def _placed(items: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """items (x, y, ...) with the loc_id of the area (loc_id, shape) that holds the point."""
    return join_within(items, areas.select(F.col("loc_id"), "shape"), cell, "x", "y").drop("shape")


def _pivot(items: DataFrame, classes: list[str], value) -> DataFrame:
    return items.groupBy("loc_id").pivot("class", classes).agg(value).fillna(0)


def land_use_km2(uses: DataFrame, areas: DataFrame, classes: list[str], cell: float, mode: str = "sphere") -> DataFrame:
    """(loc_id, a column a class): square kilometres of the land uses (class, shape) whose centre lies in the area."""
    centre = uses.withColumn("c", geo.polygon_centroid(F.col("shape")))
    items = centre.select("class", F.col("c.x").alias("x"), F.col("c.y").alias("y"), geo.polygon_area(F.col("shape"), mode).alias("km2"))
    return _pivot(_placed(items, areas, cell), classes, F.sum("km2"))


def road_km(roads: DataFrame, areas: DataFrame, classes: list[str], cell: float) -> DataFrame:
    """(loc_id, a column a class): kilometres of the roads (class, line), each piece between two points in the area of its middle."""
    n = F.size("line")
    pieces = roads.where(n > 1).select("class", F.explode(F.zip_with(F.slice("line", 1, n - 1), F.slice("line", 2, n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e"))
    middle = [((F.col(f"e.p.{c}") + F.col(f"e.q.{c}")) / 2).alias(c) for c in ("x", "y")]
    items = pieces.select("class", *middle, geo.line_km(F.array("e.p", "e.q")).alias("km"))
    return _pivot(_placed(items, areas, cell), classes, F.sum("km"))


def place_counts(places: DataFrame, areas: DataFrame, classes: list[str], cell: float) -> DataFrame:
    """(loc_id, a column a class): places (class, x, y) within the area."""
    return _pivot(_placed(places, areas, cell), classes, F.count(F.lit(1)))


def per_km2(features: DataFrame, areas: DataFrame, mode: str = "sphere") -> DataFrame:
    """Features over the area of their location."""
    size = areas.select("loc_id", geo.polygon_area(F.col("shape"), mode).alias("_km2"))
    return features.join(size, "loc_id").select("loc_id", *[(F.col(c) / F.col("_km2")).alias(c) for c in features.columns if c != "loc_id"])
