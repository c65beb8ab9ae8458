"""Files of a mobility dataset: checks, CSV (plain, gzip, zip), GeoJSON, the tile tree, and results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import oriented

FLOW_SCHEMA = "origin string, destination string, flow long"
TILE_TREE = "map<string, map<string, map<string, array<double>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's file system has the path, local or not."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def check_dataset(spark: SparkSession, folder: str) -> None:
    if not exists(spark, folder):
        raise ValueError(f"there is no dataset in {folder}")


def check_base_files(spark: SparkSession, folder: str, needed: tuple[str, ...] = ("tessellation", "output_areas")) -> None:
    """A tessellation, output areas (each as .shp or .geojson) and flows.csv."""
    for name in needed:
        if not any(exists(spark, f"{folder}/{name}.{kind}") for kind in ("shp", "geojson")):
            raise ValueError(f"{folder} needs {name}.shp or {name}.geojson")
    if not exists(spark, f"{folder}/flows.csv"):
        raise ValueError(f"{folder} needs flows.csv")


def is_cached(spark: SparkSession, folder: str, tables: tuple[str, ...] = ("loc", "flow", "loc_tile", "features")) -> bool:
    """Whether all processed tables were written to the end."""
    return all(exists(spark, f"{folder}/processed/{t}/_SUCCESS") for t in tables)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header, types forced; a bad row stops the job. Spark decodes .gz by itself."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(path, header=True)


def read_optional_features(spark: SparkSession, path: str, id_column: str) -> DataFrame | None:
    """Features with a string id and double columns, or None without the file."""
    if not exists(spark, path):
        return None
    names = spark.read.option("header", True).csv(path).columns
    if id_column not in names:
        raise ValueError(f"features need the column {id_column}")
    return read_csv(spark, path, ", ".join(f"`{n}` {'string' if n == id_column else 'double'}" for n in names))


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """tile_id from a file without header; never a number, so leading zeros stay."""
    return spark.read.schema("tile_id string").csv(path, header=False)


def _members(path: str, content: bytes, suffix: str) -> Iterator[bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.endswith(suffix):
                yield z.read(name)


def read_zip_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files inside zip archives, an archive a task."""
    names = [c.split()[0] for c in schema.split(",")]
    text = {c: "string" for c in names}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                for raw in _members(path_, content, ".csv"):
                    for part in pd.read_csv(io.BytesIO(raw), dtype=text, usecols=names, chunksize=100_000, keep_default_na=False, na_values=[""]):
                        yield part[names]

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(f"{c} string" for c in names))
    types = dict(c.split() for c in schema.split(","))
    return raw.select(*[F.col(c).cast(types[c]).alias(c) for c in names])


def read_zip_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files inside zip archives, parsed by schema into column value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                for raw in _members(path_, content, ".json"):
                    yield pd.DataFrame({"text": [raw.decode()]})

    text = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "text string")
    return text.select(F.from_json("text", schema).alias("value"))


def read_tile_tree(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, loc_id, features) from nested JSON: one file, or a folder of write_tile_tree with an object a line."""
    text = spark.read.text(path, wholetext=not exists(spark, f"{path}/_SUCCESS"))
    tiles = text.select(F.explode(F.from_json("value", TILE_TREE)).alias("tile_id", "areas"))
    return tiles.select("tile_id", F.explode("areas").alias("loc_id", "features"))


def read_geojson(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """(id_column as string, shape): a row a feature, with the rings of all its parts, holes among them."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    many = "array<array<array<array<double>>>>"
    parts = F.when(kind == "MultiPolygon", F.from_json(text, many)).otherwise(F.array(F.from_json(text, "array<array<array<double>>>")))
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = F.transform(parts, lambda part: F.transform(part, lambda ring, k: oriented(points(ring), k == 0)))
    return rows.select(F.col("f.properties")[id_column].alias(id_column), F.coalesce(F.flatten(rings), F.array().cast("array<array<struct<x: double, y: double>>>")).alias("shape"))


def put(spark: SparkSession, path: str, parts: Iterator[bytes]) -> str:
    """A file through Hadoop's file system, from the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    for data in parts:
        out.write(bytearray(data))
    out.close()
    return path


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path, header=True)


def write_zip_csv(df: DataFrame, path: str, rows_each: int = 50_000) -> str:
    """One zip archive with one CSV, as others expect it; rows pass the driver a partition at a time."""

    class Stream(io.RawIOBase):
        def __init__(self):
            self.made: list[bytes] = []

        def writable(self) -> bool:
            return True

        def write(self, data) -> int:
            self.made.append(bytes(data))
            return len(data)

        def taken(self) -> bytes:
            out, self.made = b"".join(self.made), []
            return out

    def parts() -> Iterator[bytes]:
        stream, held = Stream(), []
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{path.rsplit('/', 1)[-1].removesuffix('.zip')}", "w", force_zip64=True) as member:
            text = lambda rows, head: pd.DataFrame(rows, columns=df.columns).to_csv(index=False, header=head).encode()
            member.write(text([], True))
            for row in df.toLocalIterator():
                held.append(tuple(row))
                if len(held) == rows_each:
                    member.write(text(held, False))
                    held = []
                    yield stream.taken()
            if held:
                member.write(text(held, False))
        yield stream.taken()

    return put(df.sparkSession, path, parts())


def write_tile_tree(members: DataFrame, path: str) -> None:
    """Nested JSON, an object a line with one tile: {tile: {location: features}}; without features they are empty."""
    features = F.col("features") if "features" in members.columns else F.create_map().cast("map<string, array<double>>")
    areas = F.map_from_entries(F.array_sort(F.collect_list(F.struct("loc_id", F.struct(features.alias("f")).alias("e"))), lambda a, b: F.when(a["loc_id"] < b["loc_id"], -1).otherwise(1)))
    tree = F.transform_values(areas, lambda _, e: e["f"])
    members.groupBy("tile_id").agg(F.to_json(F.create_map("tile_id", tree)).alias("value")).select("value").write.mode("overwrite").text(path)


def write_geojson(tiles: DataFrame, path: str) -> None:
    """A feature a line from (tile_id, shape) of one part each."""
    points = F.transform("shape", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("tile_id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates")).alias("geometry"))
    tiles.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def result_path(folder: str, model: str, dataset: str, round_: int) -> str:
    return f"{folder}/results/model={model}/dataset={dataset}/round={round_}"


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(model, dataset, round, tile_id, cpc) of all results under the folder, by result_path's layout."""
    base = f"{folder}/results"
    rows = spark.read.schema("tile string, cpc double").option("basePath", base).csv(f"{base}/model=*/dataset=*/round=*", header=True)
    return rows.select(F.col("model").cast("string"), F.col("dataset").cast("string"), F.col("round").cast("int"), F.col("tile").alias("tile_id"), "cpc")
