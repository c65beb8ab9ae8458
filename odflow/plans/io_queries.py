"""Round trips through the file formats, in a work folder."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from ..functions import geo
from ..sources import files, shapefile
from ..sources.tables import table
from . import bindings as b
from .model_queries import _work
from .registry import query
from .report_queries import _RES

_SPLIT = "SELECT CAST(r_regionkey AS VARCHAR) AS tile_id FROM region WHERE r_regionkey % 2 = 0"
_FLOWS = f"WITH {b.SQL_FLOW} SELECT origin, destination, flow FROM flow"


@query(_FLOWS)
def src_flows_csv(spark, d):
    path = _work(spark, "csv")
    files.write_csv(b.observed(spark, d), path)
    return files.read_csv(spark, path, files.FLOW_SCHEMA)


@query(_FLOWS)
def src_csv_gz(spark, d):
    path = _work(spark, "gz")
    files.write_csv(b.observed(spark, d), path, gzip=True)
    return files.read_csv(spark, path, files.FLOW_SCHEMA)


def _put(spark, path: str, data: bytes) -> str:
    return files.put(spark, path, iter([data]))


def _zipped(name: str, text: str) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, text)
    return raw.getvalue()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS origin, CAST(n_regionkey AS VARCHAR) AS destination, CAST(n_nationkey * 3 AS BIGINT) AS flow FROM nation")
def src_csv_zip(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows
    text = "idx,origin,destination,flow\n" + "".join(f"{k},{r[0]},{r[1]},{r[0] * 3}\n" for k, r in enumerate(rows))
    return files.read_zip_csv(spark, _put(spark, _work(spark, "zip") + "/flows.csv.zip", _zipped("flows.csv", text)), files.FLOW_SCHEMA)


def _tree(spark, d) -> str:
    tree: dict = {}
    for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():  # 25 rows
        tree.setdefault(str(r[1]), {})[str(r[0])] = {"f": [float(r[0])]}
    return json.dumps(tree)


_TREE = "SELECT CAST(n_regionkey AS VARCHAR) AS tile_id, CAST(n_nationkey AS VARCHAR) AS loc_id, CAST(n_nationkey AS DOUBLE) AS f FROM nation"


@query(_TREE)
def src_tile_tree(spark, d):
    path = _put(spark, _work(spark, "tree") + "/tree.json", _tree(spark, d).encode())
    return files.read_tile_tree(spark, path).select("tile_id", "loc_id", F.col("features")["f"][0].alias("f"))


@query(_TREE)
def src_json_zip(spark, d):
    path = _put(spark, _work(spark, "jsonzip") + "/tree.zip", _zipped("tree.json", _tree(spark, d)))
    tiles = files.read_zip_json(spark, path, files.TILE_TREE).select(F.explode("value").alias("tile_id", "areas"))
    return tiles.select("tile_id", F.explode("areas").alias("loc_id", "features")).select("tile_id", "loc_id", F.col("features")["f"][0].alias("f"))


#: Region k has a square of 4 degrees with a hole of 2 at (10 k, 0), and if k is odd a second one of 2 degrees north of it.
_SHAPES = """s AS (SELECT r_regionkey AS k, 10.0 * r_regionkey AS x FROM region),
m AS (SELECT CAST(k AS VARCHAR) AS tile_id, CAST(2 + k % 2 AS INT) AS rings, round((12.0 + 4 * (k % 2)) / 1e6, 9) AS area, round(CASE WHEN k % 2 = 1 THEN (12.0 * (x + 2) + 4 * (x + 1)) / 16 ELSE x + 2 END, 6) AS x,
  round(CASE WHEN k % 2 = 1 THEN (12.0 * 2 + 4 * 7) / 16 ELSE 2.0 END, 6) AS y FROM s) SELECT * FROM m"""


def _square(x, y, s):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def _parts(k: int) -> list:
    """The parts of region k's shape, each an outer ring and its holes."""
    return [[_square(10 * k, 0, 4), _square(10 * k + 1, 1, 2)], [_square(10 * k, 6, 2)]][: 1 + k % 2]


def _described(shapes):
    c = geo.polygon_centroid(F.col("shape"))
    made = shapes.select("tile_id", F.size("shape").alias("rings"), F.round(geo.polygon_area(F.col("shape")), 9).alias("area"), c.alias("c"))
    return made.select("tile_id", "rings", "area", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(f"WITH {_SHAPES}")
def src_geojson(spark, d):
    """A row an area, whether it has one part or two, with its hole."""
    feature = lambda k: {"type": "Feature", "properties": {"tile_ID": str(k)}, "geometry": {"type": "MultiPolygon", "coordinates": _parts(k)} if k % 2 else {"type": "Polygon", "coordinates": _parts(k)[0]}}
    rows = table(spark, d, "region").select("r_regionkey").collect()  # 5 rows
    text = json.dumps({"type": "FeatureCollection", "features": [feature(r[0]) for r in rows]})
    return _described(files.read_geojson(spark, _put(spark, _work(spark, "geojson") + "/t.geojson", text.encode()), "tile_ID").withColumnRenamed("tile_ID", "tile_id"))


@query(f"WITH {_SHAPES}")
def src_shapefile(spark, d):
    """The same areas through a shapefile."""
    point = "struct<x: double, y: double>"
    rows = [(str(r[0]), [[tuple(map(float, p)) for p in (ring if j == 0 else ring[::-1])] for part in _parts(r[0]) for j, ring in enumerate(part)]) for r in table(spark, d, "region").select("r_regionkey").collect()]  # 5 rows
    base = _work(spark, "shapefile") + "/t"
    shapefile.write_shapefile(spark.createDataFrame(rows, f"tile_ID string, shape array<array<{point}>>"), base, "tile_ID")
    return _described(shapefile.read_shapefile(spark, f"{base}.shp", "tile_ID").withColumnRenamed("tile_ID", "tile_id"))


@query(_FLOWS)
def sink_csv_zip(spark, d):
    path = files.write_zip_csv(b.observed(spark, d), _work(spark, "zipped") + "/flows.csv.zip")
    return files.read_zip_csv(spark, path, files.FLOW_SCHEMA)


@query(f"WITH {_RES} SELECT model, 'demo' AS dataset, CAST(round AS INT) AS round, tile_id, round(cpc, 6) AS cpc FROM res")
def src_results(spark, d):
    """All models' and rounds' results, read back from the folder that runs write them to."""
    folder = _work(spark, "results")
    for model in ("DG", "G", "MFG", "NG"):
        for k in (0, 1):
            mine = b.reports(spark, d).where((F.col("model") == model) & (F.col("round") == k))
            files.write_csv(mine.select(F.col("tile_id").alias("tile"), F.round("cpc", 6).alias("cpc")), files.result_path(folder, model, "demo", k))
    return files.read_results(spark, folder)


@query(_SPLIT)
def src_tile_list(spark, d):
    path = _work(spark, "tiles")
    b.split_tiles(spark, d).where("split = 'train'").select("tile_id").write.csv(path, header=False)
    return files.read_tile_list(spark, path)


@query(f"WITH {_RES} SELECT tile_id, round(cpc, 6) AS cpc FROM mean WHERE model = 'G'")
def sink_csv_roundtrip(spark, d):
    from ..operators import report

    path = files.result_path(_work(spark, "results"), "G", "demo", 0)
    files.write_csv(report.round_mean(b.reports(spark, d)).where("model = 'G'").select("tile_id", F.round("cpc", 6).alias("cpc")), path)
    return files.read_csv(spark, path, "tile_id string, cpc double")


@query(f"WITH {b.SQL_LOC} SELECT tile_id, loc_id, f_balance FROM loc")
def sink_json_roundtrip(spark, d):
    """The tile tree with features, written and read back."""
    path = _work(spark, "json")
    files.write_tile_tree(b.locations(spark, d).select("tile_id", "loc_id", F.create_map(F.lit("balance"), F.array("f_balance")).alias("features")), path)
    return files.read_tile_tree(spark, path).select("tile_id", "loc_id", F.col("features")["balance"][0].alias("f_balance"))
