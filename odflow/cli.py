"""Command line: train or evaluate a model on a dataset folder of files.

    python -m odflow.cli --dataset demo --data-dir data --mode train --model DG

A dataset has tessellation and output_areas (.geojson or .shp), flows.csv and, if
wanted, features.csv. Without a tessellation, --tessellation-area may be a box,
"west,south,east,north" in degrees, which squares of --tessellation-size metres
(of a meridian) cover. Processed tables are written once, as Parquet.

Models: DG (deep, all features), NG (deep, populations), MFG (linear, all features)
and G (linear, population); each with the distance.
"""

from __future__ import annotations

import argparse
import logging
import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ColumnBinding, EngineConfig
from .functions import geo
from .models import linear, mlp, store, training
from .operators import evaluation, flows, pairs, spatial
from .sources import files

log = logging.getLogger("odflow")

#: Kind of net and feature set by model.
MODELS = {"DG": ("deep", "dg"), "NG": ("deep", "ng"), "MFG": ("linear", "mfg"), "G": ("linear", "g")}


def parse(args: list[str] | None = None) -> tuple[EngineConfig, str]:
    p, c, b = argparse.ArgumentParser("odflow"), EngineConfig(), ColumnBinding()
    for name in ("batch_size", "test-batch-size", "epochs", "lr", "momentum", "seed", "log-interval", "device", "mode", "model", "workers", "dropout", "tessellation-area", "tessellation-size", "dataset"):
        default = getattr(c, name.replace("-", "_"))
        p.add_argument(f"--{name}", type=type(default), default=default, choices=MODELS if name == "model" else None)
    roles = {"tile-id-column": "tile_id", "tile-geometry": "tile_geometry", "oa-id-column": "oa_id", "oa-geometry": "oa_geometry", "flow-origin-column": "flow_origin", "flow-destination-column": "flow_destination", "flow-flows-column": "flow_flows"}
    for name, role in roles.items():
        p.add_argument(f"--{name}", dest=role, default=getattr(b, role))
    p.add_argument("--data-dir", default="data")
    got = vars(p.parse_args(args))
    folder = got.pop("data_dir")
    return EngineConfig(columns=ColumnBinding(**{r: got.pop(r) for r in roles.values()}), **got), f"{folder}/{got['dataset']}"


def _polygons(spark: SparkSession, base: str, id_column: str) -> DataFrame:
    if files.exists(spark, f"{base}.geojson"):
        return files.read_geojson(spark, f"{base}.geojson", id_column)
    from .sources.shapefile import read_shapefile

    return read_shapefile(spark, f"{base}.shp", id_column)


def _box(area: str, size: float):
    """The grid of squares over "west,south,east,north", or None if the area is not four numbers."""
    try:
        west, south, east, north = (float(v) for v in area.split(","))
    except ValueError:
        return None
    return spatial.tessellate(west, south, east, north, math.degrees(size / 1000 / geo.EARTH_KM))


def process(spark: SparkSession, config: EngineConfig, folder: str) -> None:
    """Write loc, flow, loc_tile and features under processed/, unless they are there."""
    files.check_dataset(spark, folder)
    if files.is_cached(spark, folder):
        return
    given = any(files.exists(spark, f"{folder}/tessellation.{kind}") for kind in ("shp", "geojson"))
    grid = None if given else _box(config.tessellation_area, config.tessellation_size)
    files.check_base_files(spark, folder, ("output_areas",) if grid else ("tessellation", "output_areas"))
    b = config.columns
    areas = _polygons(spark, f"{folder}/output_areas", b.oa_id).withColumnRenamed(b.oa_id, "loc_id")
    made = areas.where(F.size("shape") > 0).withColumn("c", geo.polygon_centroid(F.col("shape")))
    loc = made.select("loc_id", F.col("c.y").alias("lat"), F.col("c.x").alias("lng"), geo.polygon_area(F.col("shape")).alias("area_km2"))
    raw = files.read_csv(spark, f"{folder}/flows.csv", f"`{b.flow_origin}` string, `{b.flow_destination}` string, `{b.flow_flows}` long")
    features = files.read_optional_features(spark, f"{folder}/features.csv", b.oa_id)
    if features is None:
        log.info("no features.csv: running without features")
        features = loc.select("loc_id")
    else:
        features = features.withColumnRenamed(b.oa_id, "loc_id")
    if grid:
        from .sources.shapefile import write_shapefile

        write_shapefile(spatial.square_shapes(spatial.square_tiles(spark, grid)).withColumnRenamed("tile_id", b.tile_id), f"{folder}/tessellation_made", b.tile_id)
        placed = spatial.assign_square(loc, grid).where("tile_id is not null")
    else:
        placed = spatial.join_within(loc, _polygons(spark, f"{folder}/tessellation", b.tile_id).withColumnRenamed(b.tile_id, "tile_id"), cell=1.0)
    members = pairs.last_tile(placed.select("loc_id", "tile_id"))
    for name, df in (("loc", loc), ("flow", flows.dedupe(b.bind_flows(raw))), ("loc_tile", members), ("features", features)):
        df.write.mode("overwrite").parquet(f"{folder}/processed/{name}")
    done = spark.read.parquet(f"{folder}/processed/loc")
    files.write_csv(done.select(F.col("loc_id").alias("geo_code"), F.format_string("[%s,%s]", "lng", "lat").alias("centroid"), "area_km2"), f"{folder}/processed/areas_csv", gzip=True)
    files.write_zip_csv(spark.read.parquet(f"{folder}/processed/flow").select("origin", "destination", "flow"), f"{folder}/processed/flows.csv.zip")
    files.write_tile_tree(spark.read.parquet(f"{folder}/processed/loc_tile"), f"{folder}/processed/tile_tree")


def _locations(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Locations of the split's tiles with population and feature vector; a feature that is missing is 0."""
    read = lambda t: spark.read.parquet(f"{folder}/processed/{t}")
    members, features = read("loc_tile"), read("features")
    path = f"{folder}/processed/{split}_tiles.csv"
    if files.exists(spark, path):
        members = pairs.split_members(members, files.read_tile_list(spark, path).withColumn("split", F.lit(split))).select("loc_id", "tile_id")
    names = [c for c in features.columns if c != "loc_id"]
    loc = read("loc").select("loc_id", "lat", "lng").join(members, "loc_id").join(flows.population(read("flow"), read("loc")), "loc_id")
    short = {f"_f{k}": c for k, c in enumerate(names)}  # a feature may be called like a column of loc
    loc = loc.join(features.select("loc_id", *[F.col(f"`{c}`").alias(n) for n, c in short.items()]), "loc_id", "left").fillna(0.0, list(short))
    return pairs.feature_vector(loc, list(short)).select("tile_id", "loc_id", "lat", "lng", "pop", "x")


COLUMNS = ("lat", "lng", "pop", "x")


def _inputs(made: DataFrame, observed: DataFrame, kind: str) -> DataFrame:
    """(origin, destination, t, x) of described pairs."""
    return pairs.with_flow(pairs.with_distance(made), observed).select("origin", "destination", "t", pairs.feature_set(kind).alias("x"))


def train_model(spark: SparkSession, config: EngineConfig, folder: str) -> training.State:
    """Train on the train tiles; every epoch draws at most dim_dests destinations for an origin, and all where no tile has more."""
    net, kind = MODELS[config.model]
    loc, observed = _locations(spark, folder, "train"), spark.read.parquet(f"{folder}/processed/flow")
    loc.write.mode("overwrite").parquet(f"{folder}/processed/train_locations")
    loc = spark.read.parquet(f"{folder}/processed/train_locations")
    largest = loc.groupBy("tile_id").count().agg(F.max("count")).first()[0] or 0
    whole = largest <= config.dim_dests and not config.frac_true_dest

    def written(made: DataFrame) -> DataFrame:
        path = f"{folder}/processed/train_pairs_{config.model}"
        _inputs(made, observed, kind).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    @cache
    def all_pairs() -> DataFrame:
        return written(pairs.od_pairs(loc, COLUMNS))

    def pairs_of(epoch: int) -> DataFrame:
        if whole:
            return all_pairs()
        drawn = pairs.sample_destinations(loc, observed, config.dim_dests, config.frac_true_dest, config.seed, epoch)
        return written(pairs.described(drawn.select("origin", "destination"), loc, COLUMNS))

    first = pairs_of(1).select(F.size("x")).first()
    if first is None:
        raise ValueError("the train tiles have no locations")

    def report(epoch: int, loss: float, state: training.State) -> None:
        if epoch % config.log_interval == 0:
            log.info("epoch %d: mean loss %.6f, test %s", epoch, loss, first_batch(spark, config, folder, state.layers))

    start = training.State.fresh(mlp.create(net, first[0], dropout=config.dropout, seed=config.seed))
    log.info("before training: test %s", first_batch(spark, config, folder, start.layers))
    return training.train(pairs_of, start, config.epochs, report, batch_size=config.batch_size, lr=config.lr, momentum=config.momentum, dropout=config.dropout, seed=config.seed, workers=config.workers)[0]


def scored(made: DataFrame, layers: list[mlp.Layer]) -> DataFrame:
    """Pairs with score: linear models as a column expression, deep ones in Arrow batches."""
    if len(layers) > 1:
        return mlp.score(made, layers)
    (w, bias), *_ = layers
    return made.withColumn("score", linear.score(F.col("x"), np.ravel(w).tolist(), float(bias[0])))


def test_pairs(spark: SparkSession, config: EngineConfig, folder: str, origins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs of the test tiles, or those of some origins; and the locations."""
    loc, observed = _locations(spark, folder, "test"), spark.read.parquet(f"{folder}/processed/flow")
    made = pairs.od_pairs(loc, COLUMNS)
    if origins is not None:
        made = made.join(F.broadcast(origins), "origin", "left_semi")
    return _inputs(made, observed, MODELS[config.model][1]), loc


def first_batch(spark: SparkSession, config: EngineConfig, folder: str, layers: list[mlp.Layer]) -> str:
    """Mean loss and CPC of the first test_batch_size origins: what is reported while training."""
    some = _locations(spark, folder, "test").select(F.col("loc_id").alias("origin")).orderBy("origin").limit(config.test_batch_size)
    made = scored(test_pairs(spark, config, folder, some)[0], layers)
    both = evaluation.negative_log_likelihood(made).join(evaluation.cpc_origin(evaluation.generate(made)), "origin")
    got = both.agg(F.avg("nll").alias("loss"), F.avg("cpc").alias("cpc")).first()
    return f"loss {got.loss}, CPC {got.cpc}"


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    config, folder = parse(args)
    spark = SparkSession.builder.appName("odflow").getOrCreate()
    process(spark, config, folder)
    model_path = f"{folder}/results/model_{config.model}_{config.dataset}"
    if config.mode == "train":
        state = train_model(spark, config, folder)
        store.save(spark, state.layers, model_path, state.square, state.speed)
    made, loc = test_pairs(spark, config, folder)
    outflow = flows.outflow(spark.read.parquet(f"{folder}/processed/flow"))
    numerators = evaluation.cpc_numerator(evaluation.generate(scored(made, store.load(spark, model_path)[0])))
    result = files.result_path(folder, config.model, config.dataset, 0)
    files.write_csv(evaluation.tile_cpc(numerators, loc, outflow).withColumnRenamed("tile_id", "tile"), result)
    log.info("mean and deviation of CPC: %s", evaluation.cpc_summary(files.read_csv(spark, result, "tile string, cpc double")).first())


if __name__ == "__main__":
    main()
