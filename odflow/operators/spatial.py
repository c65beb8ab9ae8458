"""Points in polygons, and square tessellations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import point_within


def tessellate(x0: float, y0: float, x1: float, y1: float, size: float) -> tuple[str, float, float, float, int, int]:
    """Grid parameters of the squares that cover a box."""
    import math

    return ("grid", x0, y0, size, max(1, math.ceil((x1 - x0) / size)), max(1, math.ceil((y1 - y0) / size)))


def square_tiles(spark, grid) -> DataFrame:
    """(tile_id, min_x, min_y, max_x, max_y) of a grid."""
    _, x0, y0, size, nx, ny = grid
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    return cells.select(
        (F.col("j") * nx + F.col("i")).cast("string").alias("tile_id"),
        (x0 + F.col("i") * size).alias("min_x"), (y0 + F.col("j") * size).alias("min_y"),
        (x0 + (F.col("i") + 1) * size).alias("max_x"), (y0 + (F.col("j") + 1) * size).alias("max_y"),
    )


def assign_square(points: DataFrame, grid, x: str = "lng", y: str = "lat") -> DataFrame:
    """points with tile_id by arithmetic: squares are half open, so a point has one tile; outside the grid it is null."""
    _, x0, y0, size, nx, ny = grid
    i, j = F.floor((F.col(x) - x0) / size), F.floor((F.col(y) - y0) / size)
    inside = i.between(0, nx - 1) & j.between(0, ny - 1)
    return points.withColumn("tile_id", F.when(inside, (j * nx + i).cast("string")))


def join_within(points: DataFrame, polygons: DataFrame, cell: float, x: str = "lng", y: str = "lat", shape: str = "shape") -> DataFrame:
    """points joined with the polygons (tile_id, shape) that they lie in.

    Both sides meet on grid cells: a polygon goes to the cells of its bounding box,
    a point to its own, so the join has an equality; the exact test follows. A
    polygon without points is met by none.
    """
    floor = lambda c: F.floor(c / cell)
    points_of = F.flatten(F.col(shape))
    xs, ys = F.transform(points_of, lambda p: p["x"]), F.transform(points_of, lambda p: p["y"])
    cells = polygons.where(F.size(points_of) > 0).withColumn("_i", F.explode(F.sequence(floor(F.array_min(xs)), floor(F.array_max(xs)))))
    cells = cells.withColumn("_j", F.explode(F.sequence(floor(F.array_min(ys)), floor(F.array_max(ys)))))
    placed = points.withColumn("_i", floor(F.col(x))).withColumn("_j", floor(F.col(y)))
    return placed.join(cells, ["_i", "_j"]).where(point_within(F.col(x), F.col(y), F.col(shape))).drop("_i", "_j")


def square_shapes(tiles: DataFrame) -> DataFrame:
    """(tile_id, shape) of square_tiles()' rows."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"), corner("min_x", "min_y"))
    return tiles.select("tile_id", F.array(ring).alias("shape"))
