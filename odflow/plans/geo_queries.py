"""Geometry, tessellation, map features and described features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import described, spatial
from ..sources import osm
from ..sources.tables import table
from . import bindings as b
from .registry import query, rounded


@query(f"WITH {b.SQL_LOC} SELECT loc_id, round(1.0::DOUBLE / 1e6, 12) AS planar, round(6371.01 * 6371.01 * abs(radians(1.0)) * (sin(radians(lat + 0.5)) - sin(radians(lat - 0.5))), 3) AS sphere FROM loc")
def polygon_area(spark, d):
    """Squares of one degree: planar in the coordinates' unit, and on the sphere, where the rule is exact for them."""
    s = b.squares(b.locations(spark, d))
    return s.select("loc_id", F.round(geo.polygon_area(F.col("shape")), 12).alias("planar"), F.round(geo.polygon_area(F.col("shape"), "sphere"), 3).alias("sphere"))


@query(f"WITH {b.SQL_LOC} SELECT loc_id, round(lng, 6) AS x, round(lat, 6) AS y FROM loc")
def polygon_centroid(spark, d):
    octagon = b.locations(spark, d).select("loc_id", F.array(geo.regular_ring(F.col("lng"), F.col("lat"), 0.4, 8)).alias("shape"))
    c = octagon.select("loc_id", geo.polygon_centroid(F.col("shape")).alias("c"))
    return c.select("loc_id", (F.round("c.x", 6) + 0.0).alias("x"), (F.round("c.y", 6) + 0.0).alias("y"))


@query(f"WITH {b.SQL_LOC} SELECT loc_id, round(lat, 6) AS lat, round(lng, 6) AS lng, 1e-6::DOUBLE AS area_km2 FROM loc")
def loc_summary(spark, d):
    s = b.squares(b.locations(spark, d)).withColumn("c", geo.polygon_centroid(F.col("shape")))
    return s.select("loc_id", (F.round("c.y", 6) + 0.0).alias("lat"), (F.round("c.x", 6) + 0.0).alias("lng"), F.round(geo.polygon_area(F.col("shape")), 12).alias("area_km2"))


@query()
def centroid_text(spark, d):
    return b.locations(spark, d).select("loc_id", F.format_string("[%s,%s]", "lng", "lat").alias("centroid")).withColumn("parsed", F.from_json("centroid", "array<double>"))


_GRID = spatial.tessellate(-180, -60, 180, 60, 45)


@query("SELECT CAST(j * 8 + i AS VARCHAR) AS tile_id, -180.0 + i * 45 AS min_x, -60.0 + j * 45 AS min_y, -180.0 + (i + 1) * 45 AS max_x, -60.0 + (j + 1) * 45 AS max_y FROM (SELECT CAST(unnest(range(8)) AS DOUBLE)::INT AS i), (SELECT CAST(unnest(range(3)) AS DOUBLE)::INT AS j)")
def tessellate_square(spark, d):
    tiles = spatial.square_tiles(spark, _GRID)
    return tiles.select("tile_id", *[F.col(c).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(f"WITH {b.SQL_LOC} SELECT loc_id, CAST(CAST(floor((lat + 60) / 45) * 8 + floor((lng + 180) / 45) AS BIGINT) AS VARCHAR) AS tile_id FROM loc")
def assign_tile(spark, d):
    return spatial.assign_square(b.locations(spark, d).drop("tile_id"), _GRID).select("loc_id", "tile_id")


def _rings(spark):
    return spatial.square_shapes(spatial.square_tiles(spark, _GRID))


@query(f"""WITH {b.SQL_LOC}, g AS (SELECT CAST(j * 8 + i AS VARCHAR) AS tile_id, -180 + i * 45 AS x, -60 + j * 45 AS y FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(3)) AS j))
SELECT loc_id, g.tile_id FROM loc JOIN g ON lng > x AND lng < x + 45 AND lat > y AND lat < y + 45""")
def spatial_join_within(spark, d):
    return spatial.join_within(b.locations(spark, d).select("loc_id", "lat", "lng"), _rings(spark), 45.0).select("loc_id", "tile_id")


@query(f"""WITH {b.SQL_LOC}, g AS (SELECT CAST(j * 8 + i AS VARCHAR) AS tile_id, -180 + i * 45 AS x, -60 + j * 45 AS y FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(3)) AS j))
SELECT loc_id, g.tile_id FROM loc JOIN g ON lng > x AND lng < x + 45 AND lat > y AND lat < y + 45""")
def spatial_join_bucketed(spark, d):
    """With cells smaller than the tiles, so that a tile goes to several."""
    return spatial.join_within(b.locations(spark, d).select("loc_id", "lat", "lng"), _rings(spark), 10.0).select("loc_id", "tile_id")


#: Of every location a shape of two squares, the first with a hole: parts 2 degrees wide at it and 4 degrees east, a hole of 1 degree.
def _ringed(loc):
    x, y = F.col("lng"), F.col("lat")
    return loc.select("loc_id", F.array(geo.square_ring(x, y, 1.0), F.reverse(geo.square_ring(x, y, 0.5)), geo.square_ring(x + 4, y, 1.0)).alias("shape"))


@query(f"WITH {b.SQL_LOC} SELECT loc_id, round(7.0 / 1e6, 12) AS area, round(lng + 16 / 7.0, 6) AS x, round(lat, 6) AS y FROM loc")
def shape_parts_and_holes(spark, d):
    """One area and one centre for all parts of a shape, without its hole."""
    s = _ringed(b.locations(spark, d)).withColumn("c", geo.polygon_centroid(F.col("shape")))
    return s.select("loc_id", F.round(geo.polygon_area(F.col("shape")), 12).alias("area"), (F.round("c.x", 6) + 0.0).alias("x"), (F.round("c.y", 6) + 0.0).alias("y"))


@query(f"""WITH {b.SQL_LOC}, p AS (SELECT loc_id AS point, lng + dx AS x, lat + dy AS y FROM loc, (SELECT unnest([0.25, 0.5, 0.75, 1.0, 3.5, 5.5]) AS dx), (SELECT unnest([0.0, 0.75]) AS dy))
SELECT point, x, y, loc_id FROM p JOIN loc ON (abs(x - lng) < 1 AND abs(y - lat) < 1 AND (abs(x - lng) > 0.5 OR abs(y - lat) > 0.5)) OR (abs(x - lng - 4) < 1 AND abs(y - lat) < 1)""")
def spatial_join_parts_and_holes(spark, d):
    """Points in a hole, on its edge, between the parts and in them."""
    loc = b.locations(spark, d).select("loc_id", "lat", "lng")
    steps = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    points = loc.withColumn("dx", steps([0.25, 0.5, 0.75, 1.0, 3.5, 5.5])).withColumn("dy", steps([0.0, 0.75]))
    points = points.select(F.col("loc_id").alias("point"), (F.col("lng") + F.col("dx")).alias("x"), (F.col("lat") + F.col("dy")).alias("y"))
    return spatial.join_within(points, _ringed(loc), 5.0, "x", "y").select("point", "x", "y", "loc_id")


_TAGS = f"tags AS (SELECT p_partkey AS id, {b.SQL_TAGS}, p_name AS name FROM part)"
_FOOD = "(shop IS NOT NULL OR tourism IS NOT NULL OR office IS NOT NULL OR amenity IN ('marketplace', 'restaurant', 'fast_food', 'cafe', 'bar', 'pub'))"
_EDU = "(amenity IN ('kindergarten', 'school', 'college', 'university', 'language_school') OR office = 'educational_institution')"
_EMERGENCY = "(emergency IS NOT NULL OR amenity IN ('police', 'fire_station'))"
_HEALTH = "(healthcare IS NOT NULL OR amenity IN ('doctors', 'dentist', 'clinic', 'toilets', 'hospital', 'pharmacy') OR shop IN ('herbalist', 'nutrition_supplements'))"
_LANDUSE = "(landuse IS NOT NULL OR leisure = 'park' OR amenity = 'grave_yard')"
_SPORT = "(sport IS NOT NULL OR leisure IN ('stadium', 'swimming pool', 'pitch', 'sport_centre'))"
_AEROWAY = "(aeroway IS NOT NULL OR building = 'aerodrome')"
_SINGLE = "amenity IN ('fuel', 'place_of_worship', 'community_centre', 'library', 'bus_station')"
_POINT = f"(building IS NOT NULL OR historic IS NOT NULL OR {_FOOD} OR {_EDU} OR {_EMERGENCY} OR {_HEALTH} OR {_LANDUSE} OR {_SPORT} OR {_AEROWAY} OR {_SINGLE})"


def _themes(kind, *themes):
    def run(spark, d):
        return osm.select_features(b.tags(spark, d), kind, list(themes) or None, keep=["id"]).select("id", "name")

    return run


@query(f"WITH {_TAGS} SELECT id, amenity, shop, building FROM tags WHERE {_EDU}")
def osm_project(spark, d):
    return osm.select_features(b.tags(spark, d), "point", ["education"], keep=["id"]).select("id", "amenity", "shop", "building")


@query(f"WITH {_TAGS} SELECT id, name FROM tags WHERE {_POINT}")
def osm_point_filter(spark, d):
    return _themes("point")(spark, d)


@query(f"WITH {_TAGS} SELECT id, name FROM tags WHERE {_POINT} OR building = 'train_station'")
def osm_polygon_filter(spark, d):
    return _themes("polygon")(spark, d)


@query(f"WITH {_TAGS} SELECT id, name FROM tags WHERE {_AEROWAY} OR highway IS NOT NULL OR railway IS NOT NULL")
def osm_line_filter(spark, d):
    return _themes("line")(spark, d)


@query(f"WITH {_TAGS} SELECT id, name FROM tags WHERE {_FOOD}")
def osm_food_retail(spark, d):
    return _themes("point", "food_retail")(spark, d)


@query(f"WITH {_TAGS} SELECT id, name FROM tags WHERE {_EDU}")
def osm_education(spark, d):
    return _themes("point", "education")(spark, d)


@query(f"WITH {_TAGS} SELECT id, name FROM tags WHERE {_HEALTH}")
def osm_health(spark, d):
    return _themes("point", "health")(spark, d)


@query(f"WITH {_TAGS} SELECT id, name FROM tags WHERE {_LANDUSE}")
def osm_landuse(spark, d):
    return _themes("point", "landuse")(spark, d)


_COUNTED = {
    "building": "building IS NOT NULL", "food_retail": _FOOD, "education": _EDU, "emergency": _EMERGENCY, "health": _HEALTH, "landuse": _LANDUSE, "fuel": "amenity = 'fuel'", "place_of_worship": "amenity = 'place_of_worship'",
    "community_centre": "amenity = 'community_centre'", "library": "amenity = 'library'", "bus_station": "amenity = 'bus_station'", "historic": "historic IS NOT NULL", "sport": _SPORT, "aeroway": _AEROWAY,
}
_BY_KIND = {"point": _COUNTED, "polygon": _COUNTED | {"train_station": "building = 'train_station'"}, "line": {"aeroway": _AEROWAY, "road": "highway IS NOT NULL", "railway": "railway IS NOT NULL"}}


@query(f"WITH {_TAGS} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{theme}' AS theme, CAST(count(*) AS BIGINT) AS n FROM tags WHERE {where}" for kind, themes in _BY_KIND.items() for theme, where in themes.items()))
def osm_theme_counts(spark, d):
    """How many features each predicate of each kind holds for: none is left untried."""
    tags = b.tags(spark, d)
    every = [(kind, theme, holds) for kind in ("point", "polygon", "line") for theme, holds in osm.predicates(kind).items()]
    counts = tags.agg(*[F.count(F.when(holds, 1)).alias(f"{kind}|{theme}") for kind, theme, holds in every])
    rows = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(theme).alias("theme"), F.col(f"`{kind}|{theme}`").alias("n")) for kind, theme, _ in every])).alias("r")
    return counts.select(rows).select("r.*")


_AT = "CAST((p_partkey * 53) % 360 - 180 AS DOUBLE) + 0.25 AS x, CAST((p_partkey * 29) % 118 - 59 AS DOUBLE) + 0.25 AS y"
_IN = "CAST(CAST(floor(({y} + 60) / 45) * 8 + floor(({x} + 180) / 45) AS BIGINT) AS VARCHAR)"


def _spots(spark, d):
    """Parts at places (x, y), with a key."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), ((k * 53) % 360 - 180 + F.lit(0.25)).alias("x"), ((k * 29) % 118 - 59 + F.lit(0.25)).alias("y"))


def _areas(spark):
    return _rings(spark).withColumnRenamed("tile_id", "loc_id")


def _class(k, classes):
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (k % len(classes) + 1).cast("int")).alias("class")


LANDUSES, ROADS, PLACES = ["residential", "commercial", "industrial", "retail", "natural"], ["residential", "main", "other"], ["transport", "food", "health", "education", "retail"]
_STRIP = "6371.01 * 6371.01 * radians(0.5) * (sin(radians(y + 0.25)) - sin(radians(y - 0.25)))"
_KM = "2 * 6371.01 * asin(sqrt(pow(sin(radians({a} - {b}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({w}) / 2), 2)))"


@query(f"WITH p AS (SELECT p_partkey AS k, {_AT} FROM part) SELECT {_IN.format(x='x', y='y')} AS loc_id, " + ", ".join(f"round(coalesce(sum({_STRIP}) FILTER (k % 5 = {i}), 0), 4) AS {c}" for i, c in enumerate(LANDUSES)) + " FROM p GROUP BY 1")
def feat_land_use_km2(spark, d):
    """Square kilometres of land use by class and location, from shapes of half a degree."""
    uses = _spots(spark, d).select(_class(F.col("k"), LANDUSES), F.array(geo.square_ring(F.col("x"), F.col("y"), 0.25)).alias("shape"))
    return described.land_use_km2(uses, _areas(spark), LANDUSES, 45.0).select("loc_id", *[F.round(c, 4).alias(c) for c in LANDUSES])


_PIECES = f"""p AS (SELECT p_partkey AS k, {_AT} FROM part), e AS (SELECT k, x + 0.25 AS mx, y AS my, {_KM.format(a='y', b='y', w='0.5')} AS km FROM p UNION ALL SELECT k, x + 0.5, y + 0.25, {_KM.format(a='y', b='(y + 0.5)', w='0.0')} FROM p)"""


@query(f"WITH {_PIECES} SELECT {_IN.format(x='mx', y='my')} AS loc_id, " + ", ".join(f"round(coalesce(sum(km) FILTER (k % 3 = {i}), 0), 5) AS {c}" for i, c in enumerate(ROADS)) + " FROM e GROUP BY 1")
def feat_road_km(spark, d):
    """Kilometres of road by class and location, from lines of two pieces."""
    x, y = F.col("x"), F.col("y")
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    roads = _spots(spark, d).select(_class(F.col("k"), ROADS), F.array(point(0.0, 0.0), point(0.5, 0.0), point(0.5, 0.5)).alias("line"))
    return described.road_km(roads, _areas(spark), ROADS, 45.0).select("loc_id", *[F.round(c, 5).alias(c) for c in ROADS])


@query(f"WITH p AS (SELECT p_partkey AS k, {_AT} FROM part) SELECT {_IN.format(x='x', y='y')} AS loc_id, " + ", ".join(f"CAST(count(*) FILTER (k % 5 = {i}) AS BIGINT) AS {c}" for i, c in enumerate(PLACES)) + " FROM p GROUP BY 1")
def feat_place_counts(spark, d):
    places = _spots(spark, d).select(_class(F.col("k"), PLACES), "x", "y")
    return described.place_counts(places, _areas(spark), PLACES, 45.0)


@query(f"WITH p AS (SELECT p_partkey AS k, {_AT} FROM part), c AS (SELECT floor((x + 180) / 45) AS i, floor((y + 60) / 45) AS j, " + ", ".join(f"count(*) FILTER (k % 5 = {i}) AS {c}" for i, c in enumerate(PLACES)) + " FROM p GROUP BY 1, 2), a AS (SELECT *, 6371.01 * 6371.01 * radians(45.0) * (sin(radians(j * 45 - 15)) - sin(radians(j * 45 - 60))) / 1e6 AS mkm2 FROM c) SELECT CAST(CAST(j * 8 + i AS BIGINT) AS VARCHAR) AS loc_id, " + ", ".join(f"round({c} / mkm2, 6) AS {c}" for c in PLACES) + " FROM a")
def feat_places_per_million_km2(spark, d):
    made = described.per_km2(feat_place_counts(spark, d), _areas(spark))
    return made.select("loc_id", *[F.round(F.col(c) * 1e6, 6).alias(c) for c in PLACES])


def _items(spark, d, classes):
    """Line items as parts of a supplier's area: a class by part, an amount by quantity."""
    names = F.array(*[F.lit(c) for c in classes])
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("loc_id"), F.element_at(names, (F.col("l_partkey") % len(classes) + 1).cast("int")).alias("class"), F.col("l_quantity").alias("amount"), (F.col("l_linenumber") % 2 == 0).alias("is_building"))


def pivot_sum(items, classes):
    """A column a class, 0 where there is nothing."""
    return items.groupBy("loc_id").pivot("class", classes).agg(F.sum("amount")).fillna(0.0)


def _pivot_sql(classes, value="sum(CASE WHEN l_partkey % {n} = {k} THEN l_quantity ELSE 0 END)"):
    return "SELECT CAST(l_suppkey AS VARCHAR) AS loc_id, " + ", ".join(f"{value.format(n=len(classes), k=k)} AS {c}" for k, c in enumerate(classes)) + " FROM lineitem GROUP BY 1"


@query(_pivot_sql(LANDUSES))
def feat_landuse_pivot(spark, d):
    return pivot_sum(_items(spark, d, LANDUSES), LANDUSES)


@query(_pivot_sql(ROADS))
def feat_road_pivot(spark, d):
    return pivot_sum(_items(spark, d, ROADS), ROADS)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS loc_id, " + ", ".join(f"CAST(count(*) FILTER (l_partkey % 5 = {k} AND l_linenumber % 2 = {1 - s}) AS BIGINT) AS {c}_{n}" for k, c in enumerate(PLACES) for s, n in ((0, "poi"), (1, "building"))) + " FROM lineitem GROUP BY 1")
def feat_poi_pivot(spark, d):
    items = _items(spark, d, PLACES).withColumn("class", F.concat("class", F.when(F.col("is_building"), "_building").otherwise("_poi")))
    return items.groupBy("loc_id").pivot("class", [f"{c}_{n}" for c in PLACES for n in ("poi", "building")]).agg(F.count(F.lit(1))).fillna(0)


@query(f"WITH {b.SQL_LOC}, f AS ({_pivot_sql(LANDUSES)}) SELECT f.loc_id, " + ", ".join(f'round(f."{c}" / (100 + CAST(f.loc_id AS BIGINT)), 6) AS "{c}"' for c in LANDUSES) + " FROM f JOIN loc USING (loc_id)")
def feat_density(spark, d):
    """Per unit of the location's area."""
    made = pivot_sum(_items(spark, d, LANDUSES), LANDUSES).join(b.locations(spark, d).select("loc_id", (100 + F.col("loc_id").cast("long")).alias("area")), "loc_id")
    return rounded(made.select("loc_id", *[(F.col(c) / F.col("area")).alias(c) for c in LANDUSES]), *LANDUSES)
