"""Shapefiles: polygons from .shp, attributes from .dbf (the public ESRI and dBASE formats), read and written through Hadoop's file systems."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import put

POLYGON_TYPES = (5, 15, 25)
SHAPE = "array<array<struct<x: double, y: double>>>"


def attributes(dbf: bytes, encoding: str) -> tuple[list[str], Iterator[dict[str, str]]]:
    """Field names, and the records as text."""
    count, header, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii"), dbf[at + 16]))
        at += 32

    def rows() -> Iterator[dict[str, str]]:
        for k in range(count):
            at = header + k * width + 1
            row = {}
            for name, size in fields:
                row[name] = dbf[at : at + size].decode(encoding).strip()
                at += size
            yield row

    return [n for n, _ in fields], rows()


def polygons(shp: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """The rings of each shape; a null shape has none."""
    at = 100
    while at < len(shp):
        (size,) = struct.unpack_from(">I", shp, at + 4)
        body = at + 8
        (kind,) = struct.unpack_from("<i", shp, body)
        if kind in POLYGON_TYPES:
            parts, points = struct.unpack_from("<ii", shp, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", shp, body + 44), points]
            flat = struct.unpack_from(f"<{2 * points}d", shp, body + 44 + 4 * parts)
            xy = list(zip(flat[::2], flat[1::2], strict=True))
            yield [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield []
        at = body + 2 * size


def read_shapefile(spark: SparkSession, path: str, id_column: str, encoding: str = "utf-8") -> DataFrame:
    """(id_column as string, shape) of a .shp and the .dbf beside it: a row a record, with all rings of its parts, a pair of files a task.

    The format has outer rings run clockwise and holes counter-clockwise; shapes have
    them the other way round. A null shape has no ring.
    """
    base = path.removesuffix(".shp")
    files = spark.read.format("binaryFile").load([f"{base}.shp", f"{base}.dbf"])
    pair = files.groupBy(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("base")).agg(*[F.first(F.when(F.col("path").endswith(f".{kind}"), F.col("content")), ignorenulls=True).alias(kind) for kind in ("shp", "dbf")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shp, dbf in zip(pdf["shp"], pdf["dbf"], strict=True):
                names, rows = attributes(dbf, encoding)
                if id_column not in names:
                    raise ValueError(f"the shapefile needs the column {id_column}, it has {names}")
                held = []
                for row, rings in zip(rows, polygons(shp), strict=True):
                    held.append((row[id_column], [[{"x": x, "y": y} for x, y in ring[::-1]] for ring in rings]))
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=["id", "shape"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["id", "shape"])

    return pair.select("shp", "dbf").mapInPandas(run, f"id string, shape {SHAPE}").withColumnRenamed("id", id_column)


def write_shapefile(shapes: DataFrame, base: str, id_column: str) -> None:
    """base.shp and base.dbf from (id_column, shape), as for a generated tessellation; the files are made on the driver."""
    rows = [(str(r[0]), [[(p.x, p.y) for p in ring] for ring in r[1]]) for r in shapes.select(id_column, "shape").toLocalIterator()]
    body = b""
    for k, (_, rings) in enumerate(rows, 1):
        points = [p for ring in rings for p in ring[::-1]]
        starts = [sum(map(len, rings[:j])) for j in range(len(rings))]
        xs, ys = zip(*points, strict=True)
        shape = struct.pack(f"<i4dii{len(rings)}i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points), *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">II", k, len(shape) // 2) + shape
    every = [p for _, rings in rows for ring in rings for p in ring] or [(0.0, 0.0)]
    box = [f(p[i] for p in every) for f in (min, max) for i in (0, 1)]
    head = struct.pack(">I20xI", 9994, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *box, 0, 0, 0, 0)
    width = max([len(i.encode()) for i, _ in rows] or [1])
    dbf = struct.pack("<B3BIHH20x", 3, 126, 1, 1, len(rows), 65, width + 1) + struct.pack("<11sc4xBB14x", id_column.encode(), b"C", width, 0) + b"\r"
    dbf += b"".join(b" " + i.encode().ljust(width) for i, _ in rows) + b"\x1a"
    for suffix, data in ((".shp", head + body), (".dbf", dbf)):
        put(shapes.sparkSession, base + suffix, iter([data]))
