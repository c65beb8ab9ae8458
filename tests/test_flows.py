"""The flow engine: a hand-made tile, properties, pandas and NumPy oracles, files, and DuckDB for every query with SQL."""

import dataclasses
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odflow import cli
from odflow.catalog import QUERIES, SQL
from odflow.functions import choice as choice_functions
from odflow.functions import geo
from odflow.models import linear, mlp, store, tiles, training
from odflow.operators import evaluation, flows, pairs, report, spatial
from odflow.sources import files, osm
from odflow.streaming import transitions, windowed_flows

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def tile(spark):
    loc = spark.createDataFrame([("A", "007", 0.0, 0.0), ("B", "007", 0.0, 1.0), ("C", "007", 1.0, 0.0)], "loc_id string, tile_id string, lat double, lng double")
    observed = spark.createDataFrame([("A", "B", 3), ("A", "C", 1), ("B", "A", 2), ("B", "Z", 5)], "origin string, destination string, flow long")
    loc = loc.join(flows.population(observed, loc), "loc_id")
    made = pairs.with_flow(pairs.with_distance(pairs.od_pairs(loc, ("lat", "lng", "pop"))), observed)
    return loc, observed, made.withColumn("score", F.ln("d_pop") - 0.01 * F.col("dist"))


def test_hand_fixture(tile):
    loc, observed, made = tile
    got = {(r.origin, r.destination): r for r in evaluation.generate(made).collect()}
    assert got["A", "B"].dist == pytest.approx(111.195101, abs=1e-6) and got["B", "C"].dist == pytest.approx(157.249628, abs=1e-6)
    assert [got["A", d].p for d in "ABC"] == pytest.approx([0.634677, 0.365323, 0], abs=1e-6)
    assert [got["B", d].gen for d in "ABC"] == pytest.approx([0.316431, 1.683569, 0], abs=1e-6)
    num = evaluation.cpc_numerator(evaluation.generate(made))
    assert {r.origin: round(r.cpc_num, 6) for r in num.collect()} == {"A": 2.922583, "B": 0.632862, "C": 0}
    assert {r.origin: r.nll for r in evaluation.negative_log_likelihood(made).collect()} == pytest.approx({"A": 19.789317, "B": 3.687596, "C": 0}, abs=1e-6)
    row = evaluation.tile_cpc(num, loc, flows.outflow(observed)).first()
    assert row.tile_id == "007" and row.cpc == pytest.approx(0.161611, abs=1e-6)


def test_probabilities_sum_to_one_and_ignore_shifts(tile):
    made = tile[2]
    a = {(r.origin, r.destination): r.p for r in evaluation.generate(made).collect()}
    b = {(r.origin, r.destination): r.p for r in evaluation.generate(made.withColumn("score", F.col("score") + 700)).collect()}
    assert a == pytest.approx(b) and [sum(p for (o, _), p in a.items() if o == x) for x in "ABC"] == pytest.approx([1, 1, 1])


def test_gradient(tile):
    made = tile[2].select("origin", "t", F.array(F.ln("d_pop"), F.col("dist") / 100).alias("x"))
    loss, g = linear.loss_and_gradient(made, [0.3, -0.2], 0.1)
    for k, h in enumerate(np.eye(2) * 1e-5):
        up, down = (linear.loss_and_gradient(made, (np.array([0.3, -0.2]) + s * h).tolist(), 0.1)[0] for s in (1, -1))
        assert (up - down) / 2e-5 == pytest.approx(g[k], rel=1e-4, abs=1e-6)
    _, losses, _ = linear.train(made, 2, 5, lr=0.01)
    assert losses[-1] < losses[0]


def test_net(spark, tile, tmp_path):
    assert mlp.parameter_count(mlp.widths(39)) == 455_041
    layers = mlp.initial_layers([2, 5, 1])
    made = tile[2].select("origin", "t", F.array(F.ln("d_pop"), F.col("dist") / 100).alias("x"))
    native = mlp.expression([F.col("x")[0], F.col("x")[1]], layers)
    for r in mlp.score(made, layers).withColumn("n", native).collect():
        assert r.score == pytest.approx(r.n, abs=1e-9) and r.score == pytest.approx(mlp.forward(np.array([r.x]), layers)[-1][0, 0], abs=1e-9)
    loss, grads = mlp.batch_gradient(made, layers)
    bumped = [(w.copy(), b.copy()) for w, b in layers]
    bumped[0][0][1, 0] += 1e-6
    assert (mlp.batch_gradient(made, bumped)[0] - loss) / 1e-6 == pytest.approx(grads[0][0][1, 0], rel=1e-3, abs=1e-4)
    x = np.ones((4, 2))
    assert np.array_equal(mlp.forward(x, layers, 0.0)[-1], mlp.forward(x, layers, 0.0, np.random.default_rng(1))[-1])
    store.save(spark, layers, str(tmp_path / "m"), np.ones(2), np.zeros(2))
    back, square, _ = store.load(spark, str(tmp_path / "m"))
    assert all(np.array_equal(a, c) and np.array_equal(b, d) for (a, b), (c, d) in zip(layers, back)) and square.tolist() == [1, 1]
    with pytest.raises(ValueError):
        mlp.create("linear", 2, dropout=1.0)


def test_training_over_origins(spark):
    """One worker gives the sequential run, several average; a lone origin, an origin over several Arrow batches, an empty table."""
    rng = np.random.default_rng(3)
    rows = [(f"o{o}", f"d{k:05d}", int(rng.poisson(3)), rng.normal(size=2).tolist()) for o in range(7) for k in range(1 if o == 2 else 5 + o)]
    made = spark.createDataFrame(rows, "origin string, destination string, t long, x array<double>")
    layers = mlp.initial_layers([2, 6, 3, 1])
    state, want, optimizer, losses = training.State.fresh(layers), mlp.flat(layers), linear.RmsProp(len(mlp.flat(layers)), 0.01, 0.9), []
    for _ in range(2):
        for at in range(0, 7, 3):
            got = [mlp.loss_of_origin(np.array([r[3] for r in rows if r[0] == f"o{o}"]), np.array([r[2] for r in rows if r[0] == f"o{o}"], float), mlp.shaped(want, layers)) for o in range(at, min(7, at + 3))]
            losses += [g[0] for g in got]
            want = optimizer.step(want, sum(g[1] for g in got))
    for epoch in (1, 2):
        loss, state = training.train_epoch(made, state, batch_size=3, lr=0.01, epoch=epoch, workers=1)
        assert loss == pytest.approx(np.mean(losses[7 * (epoch - 1) : 7 * epoch]))
    # the last bias shifts all scores alike: its gradient is rounding, which the optimizer scales up
    assert mlp.flat(state.layers) == pytest.approx(want) and state.square == pytest.approx(optimizer.square) and state.speed[:-1] == pytest.approx(optimizer.speed[:-1])
    _, losses = training.train(lambda epoch: made, training.State.fresh(layers), 6, batch_size=2, lr=0.01, workers=3)
    assert losses[-1] < losses[0]
    assert training.train_epoch(made.limit(0), state)[0] == 0 and training.train_epoch(made.limit(0), state)[1] is state
    with pytest.raises(ValueError):
        training.train_epoch(made, state, batch_size=0)


def test_origins_and_dropout(spark):
    pdf = pd.DataFrame({"origin": list("aabbbc"), "x": [np.array([k, 1.0]) for k in range(6)], "t": range(6)})
    for step in (1, 2, 4, 6):
        got = list(mlp.by_origin(iter([pdf[k : k + step] for k in range(0, 6, step)] + [pdf[:0]])))
        assert [t.tolist() for _, t in got] == [[0, 1], [2, 3, 4], [5]] and got[1][0][:, 0].tolist() == [2, 3, 4]
    layers, x, t = mlp.initial_layers([2, 20, 10, 1]), np.random.default_rng(1).normal(size=(6, 2)), np.arange(6.0)
    value = lambda v: mlp.loss_of_origin(x, t, mlp.shaped(v, layers), 0.35, np.random.default_rng(9))
    flat = mlp.flat(layers)
    _, g = value(flat)
    for k in (0, 30, 70, len(flat) - 2):
        h = np.eye(1, len(flat), k)[0] * 1e-6
        assert (value(flat + h)[0] - value(flat - h)[0]) / 2e-6 == pytest.approx(g[k], rel=1e-4, abs=1e-6)
    blocks = mlp.as_blocks(3, 1.5, np.arange(mlp.BLOCK + 5.0))
    n, loss, total = mlp.added_up(spark.createDataFrame(pd.concat([blocks, blocks]), mlp.PARTS))
    assert (n, loss) == (6, 3.0) and np.array_equal(total, 2 * np.arange(mlp.BLOCK + 5.0))


def test_deciles_are_those_of_pandas(spark):
    rng = np.random.default_rng(0)
    for n in (10, 11, 37, 193):
        tied, free = rng.integers(0, 20, n).tolist(), rng.permutation(1000)[:n].tolist()
        ids = [f"{k:04d}" for k in range(n)]
        t, f = (spark.createDataFrame(list(zip(ids, v)), "tile_id string, n long") for v in (tied, free))
        want = pd.qcut(pd.Series(tied, index=ids).rank(method="first"), 10, labels=False)
        assert {r.tile_id: r.decile for r in report.decile_by_rank(t).collect()} == want.to_dict()
        want = pd.qcut(pd.Series(free, index=ids), 10, labels=False)
        assert {r.tile_id: r.decile for r in report.decile_by_value(f).collect()} == want.to_dict()
    with pytest.raises(Exception, match="unique"):
        report.decile_by_value(spark.createDataFrame([(str(k), 1) for k in range(30)], "tile_id string, n long")).collect()


SHAPES = "tile_id string, shape array<array<struct<x: double, y: double>>>"


def box(x, y, s):
    return [(float(a), float(b)) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]


def test_points_in_polygons(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, rng.uniform(-3, 3, 2))) for k in range(300)] + [(900, 0.5, 0.0), (901, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "id long, lng double, lat double")
    ring = [(0, 0), (2, 0), (2, 2), (1, 1), (0, 2), (0, 0)]
    poly = spark.createDataFrame([("P", [[(float(x), float(y)) for x, y in ring]]), ("none", [])], SHAPES)

    def inside(x, y):
        return 0 < x < 2 and 0 < y < (2 - x if x <= 1 else x)

    for cell in (0.3, 5.0):
        got = {r.id for r in spatial.join_within(pts, poly, cell).collect()}
        assert got == {k for k, x, y in rows if inside(x, y)}
    c = poly.where("tile_id = 'P'").select(geo.signed_area(F.col("shape")).alias("a"), geo.polygon_centroid(F.col("shape")).alias("c")).first()
    assert c.a == pytest.approx(3.0) and c.c.x == pytest.approx(1.0)
    grid = spatial.tessellate(-3, -3, 3, 3, 1)
    assert spatial.assign_square(pts, grid).where("tile_id is null").count() == 0 and spatial.square_tiles(spark, grid).count() == 36


def test_samples(spark, tile):
    loc, observed, _ = tile
    got = pairs.sample_destinations(loc, observed, 2, 0.5).collect()
    for o in "ABC":
        mine = [r for r in got if r.origin == o]
        assert len({r.destination for r in mine}) == len(mine) == 2
        assert sum(r.is_true for r in mine) == (1 if o in "AB" else 0)
    assert pairs.sample_destinations(loc, observed, 10**9, 0.0).count() == 9


def test_flows(spark):
    df = spark.createDataFrame([("a", "b", 1, 1), ("a", "b", 5, 0), ("a", "c", 2, 2)], "origin string, destination string, flow long, seq long")
    assert {(r.destination, r.flow) for r in flows.dedupe(df).collect()} == {("b", 6), ("c", 2)}
    assert {(r.destination, r.flow) for r in flows.dedupe(df, "last", "seq").collect()} == {("b", 1), ("c", 2)}
    assert flows.nested(flows.dedupe(df)).first().flows == {"b": 6, "c": 2}
    with pytest.raises(ValueError):
        flows.dedupe(df, "last")


def test_osm_strict_literal(spark):
    columns = sorted({*osm.POLYGON_COLUMNS, *osm.LINE_COLUMNS, "office", "sport"})
    rows = [tuple("pitch" if c == "leisure" else None for c in columns)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    assert osm.select_features(df, "point", ["sport"]).count() == 1 and osm.select_features(df, "point", ["sport"], strict=True).count() == 0
    assert len(osm.POINT_COLUMNS) == 32 and len(osm.POLYGON_COLUMNS) == 34 and len(osm.select_features(df, "line").columns) == 12


def test_shapefile(spark, tmp_path):
    from odflow.sources.shapefile import read_shapefile, write_shapefile

    shapes = [("007", [box(0, 0, 4), box(1, 1, 2)[::-1], box(6, 0, 1)]), ("8", [box(0, 9, 1)])]
    write_shapefile(spark.createDataFrame(shapes, SHAPES).withColumnRenamed("tile_id", "tile_ID"), str(tmp_path / "t"), "tile_ID")
    got = {r.tile_ID: [[(p.x, p.y) for p in ring] for ring in r.shape] for r in read_shapefile(spark, str(tmp_path / "t.shp"), "tile_ID").collect()}
    assert got == dict(shapes)
    with pytest.raises(Exception, match="other"):
        read_shapefile(spark, str(tmp_path / "t.shp"), "other").collect()


def test_holes_and_parts(spark, tmp_path):
    """Whichever way the rings run in the file, and in GeoJSON as in a shapefile."""
    from odflow.sources.shapefile import read_shapefile, write_shapefile

    parts = [[box(0, 0, 4)[::-1], box(1, 1, 2)], [box(6, 0, 1)]]
    feature = {"type": "Feature", "properties": {"tile_id": "T"}, "geometry": {"type": "MultiPolygon", "coordinates": parts}}
    (tmp_path / "t.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {"type": "Feature", "properties": {"tile_id": "empty"}, "geometry": None}]}))
    shapes = files.read_geojson(spark, str(tmp_path / "t.geojson"), "tile_id")
    assert {r.tile_id: len(r.shape) for r in shapes.collect()} == {"T": 3, "empty": 0}
    write_shapefile(shapes.where("tile_id = 'T'"), str(tmp_path / "t"), "tile_id")
    points = spark.createDataFrame([("hole", 2.0, 2.0), ("in", 0.5, 2.0), ("second", 6.5, 0.5), ("between", 5.0, 0.5), ("edge", 1.0, 2.0), ("rim", 0.0, 1.0)], "id string, lng double, lat double")
    for made in (shapes, read_shapefile(spark, str(tmp_path / "t.shp"), "tile_id")):
        assert sorted(r.id for r in spatial.join_within(points, made, 3.0).collect()) == ["in", "second"]
        c = made.where("tile_id = 'T'").select((geo.polygon_area(F.col("shape")) * 1e6).alias("a"), geo.polygon_centroid(F.col("shape")).alias("c")).first()
        assert c.a == pytest.approx(13) and (c.c.x, c.c.y) == pytest.approx(((12 * 2 + 6.5) / 13, (12 * 2 + 0.5) / 13))


def test_area_of_slanting_edges_is_as_near_as_said(spark):
    n = 400
    line = [(20 * k / n, 40 + 10 * k / n) for k in range(n + 1)]
    fine = spark.createDataFrame([("T", [[*line, (0.0, 50.0), (0.0, 40.0)]]), ("C", [[line[0], line[-1], (0.0, 50.0), (0.0, 40.0)]])], SHAPES)
    got = {r.tile_id: r.a for r in fine.select("tile_id", geo.polygon_area(F.col("shape"), "sphere").alias("a")).collect()}
    bound = geo.EARTH_KM**2 * math.radians(20) * math.radians(10) ** 2 / 12
    assert 0.1 * bound < abs(got["C"] - got["T"]) < bound


def test_a_split_may_not_list_unknown_tiles(spark):
    members = spark.createDataFrame([("a", "1")], "loc_id string, tile_id string")
    listed = spark.createDataFrame([("1", "train"), ("2", "train")], "tile_id string, split string")
    assert pairs.split_members(members, listed.where("tile_id = '1'")).count() == 1
    with pytest.raises(Exception, match="without locations: 2"):
        pairs.split_members(members, listed).collect()


def test_device():
    with pytest.raises(ValueError, match="cuda"):
        cli.parse(["--device", "cuda"])


def test_areas_of_two_parts_on_the_command_line(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    shape = lambda name, i, parts: {"type": "Feature", "properties": {name: i}, "geometry": {"type": "MultiPolygon", "coordinates": parts}}
    dump = lambda features: json.dumps({"type": "FeatureCollection", "features": features})
    (d / "tessellation.geojson").write_text(dump([shape("tile_ID", "T", [[box(0, 0, 20)]])]))
    (d / "output_areas.geojson").write_text(dump([shape("oa_ID", "two", [[box(1, 1, 2)], [box(5, 1, 2)]]), shape("oa_ID", "one", [[box(10, 10, 3)]])]))
    (d / "flows.csv").write_text("origin,destination,flow\ntwo,one,3\none,two,2\n")
    config, folder = cli.parse(["--dataset", "parts", "--data-dir", str(tmp_path), "--model", "G"])
    cli.process(spark, config, folder)
    made, loc = cli.test_pairs(spark, config, folder)
    assert loc.count() == 2 and sorted((r.origin, r.destination, r.t) for r in made.collect()) == [("one", "one", 0), ("one", "two", 2), ("two", "one", 3), ("two", "two", 0)]
    at = {r.loc_id: (r.lng, r.lat) for r in spark.read.parquet(f"{folder}/processed/loc").collect()}
    assert at["two"] == pytest.approx((4, 2))
    assert {(r.origin, r.flow) for r in files.read_zip_csv(spark, f"{folder}/processed/flows.csv.zip", files.FLOW_SCHEMA).collect()} == {("two", 3), ("one", 2)}
    assert {r.loc_id for r in files.read_tile_tree(spark, f"{folder}/processed/tile_tree").collect()} == {"one", "two"}
    assert files.read_csv(spark, f"{folder}/processed/areas_csv", "geo_code string, centroid string, area_km2 double").count() == 2


def test_command_line(spark, tmp_path):
    d = tmp_path / "demo"
    d.mkdir()
    square = lambda x, y, s: [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]
    collection = lambda name, shapes: json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {name: i}, "geometry": {"type": "Polygon", "coordinates": s}} for i, s in shapes]})
    with pytest.raises(ValueError):
        files.check_base_files(spark, str(d))
    (d / "tessellation.geojson").write_text(collection("tile_ID", [("007", square(0, 0, 10)), ("1", square(10, 0, 10))]))
    (d / "output_areas.geojson").write_text(collection("oa_ID", [(f"a{k}", square(1 + 2 * k, 3, 1)) for k in range(9)]))
    (d / "flows.csv").write_text("origin,destination,flow\n" + "".join(f"a{k},a{(k * 3 + 1) % 9},{k + 1}\n" for k in range(9)))
    for model in ("G", "DG"):  # the deep model is the default
        cli.main(["--dataset", "demo", "--data-dir", str(tmp_path), "--epochs", "2", "--lr", "0.001", *(["--model", model] if model != "DG" else [])])
        got = files.read_csv(spark, files.result_path(str(d), model, "demo", 0), "tile string, cpc double").collect()
        assert {r.tile for r in got} == {"007", "1"} and all(0 <= r.cpc <= 1 for r in got)
    assert [len(store.load(spark, str(d / "results" / f"model_{m}_demo"))[0]) for m in ("G", "DG")] == [1, 16]
    compared = files.read_results(spark, str(d))
    assert {(r.model, r.round, r.tile_id) for r in compared.collect()} == {(m, 0, t) for m in ("G", "DG") for t in ("007", "1")}
    assert {r.tile_id for r in report.pivot(compared).where("G is not null").collect()} == {"007", "1"}
    assert files.is_cached(spark, str(d))
    with pytest.raises(ValueError):
        files.check_dataset(spark, str(tmp_path / "absent"))


def test_command_line_over_a_box_with_features_and_samples(spark, tmp_path):
    """Squares instead of a tessellation file, features of clashing names with gaps, tiles of more locations than are drawn."""
    d = tmp_path / "box"
    d.mkdir()
    square = lambda x, y: [[[x, y], [x + 0.1, y], [x + 0.1, y + 0.1], [x, y + 0.1], [x, y]]]
    shapes = [{"type": "Feature", "properties": {"oa_ID": f"a{k}"}, "geometry": {"type": "Polygon", "coordinates": square(0.2 + 0.3 * k, 0.4)}} for k in range(8)]
    (d / "output_areas.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    (d / "flows.csv").write_text("origin,destination,flow\n" + "".join(f"a{k},a{(k + 1) % 8},{k + 1}\n" for k in range(8)))
    (d / "features.csv").write_text("oa_ID,lat,pop\n" + "".join(f"a{k},{k}.5,{'' if k == 3 else k}\n" for k in range(7)))
    run = ["--dataset", "box", "--data-dir", str(tmp_path), "--epochs", "1", "--model", "MFG", "--batch_size", "4", "--workers", "2"]
    with pytest.raises(ValueError):
        cli.main(run)
    run += ["--tessellation-area", "0,0,4,2", "--tessellation-size", "150000"]
    cli.main(run)
    got = files.read_csv(spark, files.result_path(str(d), "MFG", "box", 0), "tile string, cpc double").collect()
    assert {r.tile for r in got} == {"0", "1"}
    from odflow.sources.shapefile import read_shapefile

    assert read_shapefile(spark, str(d / "tessellation_made.shp"), "tile_ID").count() == 6
    config, folder = cli.parse(run)
    state = cli.train_model(spark, dataclasses.replace(config, dim_dests=2, epochs=2), folder)
    assert state.layers[0][0].shape == (1, 7)
    assert spark.read.parquet(f"{folder}/processed/train_pairs_MFG").groupBy("origin").count().where("count <> 2").count() == 0


@needs_tables
def test_stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{SF}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    q = transitions(stream).writeStream.format("memory").queryName("trips").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    trips = spark.table("trips")
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    events["origin"] = events.groupby("user_id").event_type.shift()
    want = events.dropna(subset=["origin"]).groupby(["origin", "event_type"]).size().to_dict()
    assert {(r.origin, r.destination): r["count"] for r in trips.groupBy("origin", "destination").count().collect()} == want
    assert windowed_flows(trips).agg(F.sum("flow")).first()[0] == sum(want.values())


def normal(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    shown = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(shown(r[i]) for i in order) for r in rows), key=repr)


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), names)


def numpy_inputs(spark):
    """Flows t and inputs of all origins' pairs, and those of the net."""
    from odflow.plans import bindings

    rows = bindings.pairs(spark, SF, vectors=True).orderBy("origin", "destination").collect()
    t = np.array([r.t for r in rows], float)
    origin = np.array([r.origin for r in rows])
    d_pop, o_pop, dist = (np.array([r[c] for r in rows]) for c in ("d_pop", "o_pop", "dist"))
    return rows, origin, t, np.log(o_pop), np.log(d_pop), dist


def choice(origin, t, score):
    """(loss, error by pair) of a multinomial choice."""
    loss, error = 0.0, np.zeros(len(t))
    for o in sorted(set(origin)):
        m = origin == o
        e = np.exp(score[m] - score[m].max())
        p = e / e.sum()
        loss -= (t[m] * np.log(p)).sum()
        error[m] = t[m].sum() * p - t[m]
    return loss, error


def test_outputs_of_a_net():
    layers, x = mlp.create("deep", 13), np.random.default_rng(2).normal(size=(2500, 13))
    assert mlp.outputs(x, layers) == pytest.approx(mlp.forward(x, layers)[-1][:, 0], abs=1e-12)
    assert not len(mlp.outputs(x[:0], layers))


def test_log_sums(spark):
    """Scores far apart and far from 0, in several levels, do not overflow; means are by the first score's probabilities."""
    rows = [("a", 1500.0, 1.0), ("a", 1499.0, 2.0), ("a", -700.0, 9.0), ("b", -3000.0, 1.0), ("b", -2990.5, 3.0), ("c", 0.0, 5.0)]
    df = spark.createDataFrame(rows, "origin string, s double, v double").repartition(3)
    got = {r.origin: r for r in choice_functions.log_sums(df, ("s",), {"m": F.col("v")}).collect()}
    for o in "abc":
        s, v = np.array([(x, y) for n, x, y in rows if n == o]).T
        e = np.exp(s - s.max())
        assert got[o].ls_s == pytest.approx(s.max() + np.log(e.sum()), rel=1e-12) and got[o].m == pytest.approx((e * v).sum() / e.sum())


@needs_tables
@pytest.mark.parametrize("few", [1, 10**9])
@pytest.mark.parametrize("name", ["generated_flow", "cpc_numerator", "features_dg", "leaky_relu", "train_linear_step", "compare_models"])
def test_pairs_are_not_sorted(spark, name, few, monkeypatch):
    """Spread over parts or not: the rows of the SQL, without a window over pairs, and without the steps of all orders in the plan."""
    monkeypatch.setattr(pairs, "FEW_PAIRS", few)
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Window [sum(", "Window [max(", "lineitem") if x in plan]
    test_query_against_duckdb(spark, name)


@needs_tables
def test_training_queries_against_numpy(spark):
    _, origin, t, _, ln_d, dist = numpy_inputs(spark)
    x = np.c_[ln_d, dist / 1000]
    values, losses, optimizer = np.zeros(3), [], linear.RmsProp(3, 0.01, 0.9)
    for _ in range(4):
        loss, error = choice(origin, t, x @ values[:2] + values[2])
        losses.append(loss)
        values = optimizer.step(values, np.r_[x.T @ error, error.sum()])
    got = {r.parameter: r.value for r in QUERIES["train_linear"](spark, SF).collect()}
    assert [got[k] for k in (0, 1)] == pytest.approx(values[:2].tolist(), abs=1e-5)
    assert [r.loss for r in QUERIES["train_log"](spark, SF).orderBy("epoch").collect()] == pytest.approx(losses, rel=1e-6)


@needs_tables
def test_nets_against_numpy(spark):
    from odflow.plans.model_queries import _small_layers

    rows, origin, t, ln_o, ln_d, dist = numpy_inputs(spark)
    small, x = _small_layers(), np.c_[ln_o, ln_d, dist / 1000]
    loss, error = choice(origin, t, mlp.forward(x, small)[-1][:, 0])
    hidden = x @ small[0][0].T + small[0][1]
    act = np.where(hidden > 0, hidden, 0.01 * hidden)
    g1 = (error[:, None] * small[1][0] * np.where(hidden > 0, 1, 0.01)).T @ x
    got = {r.layer: r for r in QUERIES["train_mlp_step"](spark, SF).collect()}
    assert got[0].loss == pytest.approx(loss, abs=1e-2)
    assert got[0].size == pytest.approx(np.abs(g1).sum(), rel=1e-5) and got[1].size == pytest.approx(np.abs(error @ act).sum(), rel=1e-5)
    wide = np.array([[*r.o_x, *r.d_x, r.dist] for r in rows])
    want = wide * 0
    want = np.sign(wide) * np.log1p(np.abs(wide))
    for w, v in mlp.create("deep", 13):
        want = want @ w.T + v
        want = np.where(want > 0, want, 0.01 * want) if len(v) > 1 else want
    full = {(r.origin, r.destination): r.score for r in QUERIES["mlp_full"](spark, SF).collect()}
    assert [full[r.origin, r.destination] for r in rows] == pytest.approx(want[:, 0].tolist(), abs=2e-6)
    layers = mlp.create("deep", 13, 16)
    assert sorted((r.layer, r.outputs, r.inputs, r.total) for r in QUERIES["model_roundtrip"](spark, SF).collect()) == [(k, *w.shape, pytest.approx(float(w.sum() + v.sum()), abs=1e-6)) for k, (w, v) in enumerate(layers)]
    losses = [r.loss for r in QUERIES["train_mlp"](spark, SF).orderBy("epoch").collect()]
    assert len(losses) == 4 and losses[-1] < losses[0]
    text = QUERIES["centroid_text"](spark, SF).collect()
    assert all(r.centroid == f"[{r.parsed[0]},{r.parsed[1]}]" for r in text)


def test_steps_are_ordered_by_what_decides(spark):
    """What comes after the place in the order is not shuffled; ties before it give the same flows."""
    rows = [(1, 1, 7, 3.0), (1, 1, 5, 1.0), (1, 2, 5, 2.0), (2, 1, 5, 9.0), (2, 1, 5, 8.0), (2, None, 7, 1.0)]
    df = spark.createDataFrame(rows, "k long, n int, s long, x double")
    made = flows.transitions(df, "k", ["n", "s", "x"], "s")
    assert {tuple(r) for r in made.collect()} == {("5", "7", 1), ("7", "5", 2), ("5", "5", 1)}
    assert "x#" not in made._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_rounding_at_six_decimals(spark):
    duckdb = pytest.importorskip("duckdb")
    from odflow.plans.registry import round6

    values = [0.0, 0.1234565, -0.1234565, 2.5e-7, -2.5e-7, 1234567.1234567, 1e12 + 0.3, -3e15, 5e-7, -5e-7, 999999999.9999999, None, float("nan"), float("inf")]
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(round6(F.col("x")).alias("y")).collect()]
    want = [None if v is None else duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [repr(g) for g in got] == [repr(w + 0.0 if w is not None else w) for w in want]


@needs_tables
@pytest.mark.parametrize("name", ["cpc_numerator", "cpc_summary", "train_linear", "train_linear_step", "train_mlp", "train_mlp_step"])
def test_no_row_is_made_of_a_pair(spark, name, monkeypatch):
    def refuse(*args, **kw):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(pairs, "od_pairs", refuse)
    assert QUERIES[name](spark, SF).collect()


def test_packed_pairs(spark):
    """Tiles of several sizes, a location without a place and one without flows, dealt by the origins' hash: a part a number, and sums as by loops."""
    loc = spark.createDataFrame([(f"L{k}", "ab"[k % 3 > 0], float(k * 7 % 50), float(k * 31 % 170), float(k + 1)) for k in range(20)] + [("none", "b", None, None, 2.0), ("lost", None, 0.0, 0.0, 1.0)], "loc_id string, tile_id string, lat double, lng double, pop double")
    loc = pairs.with_angles(loc).withColumn("ln_pop", F.ln("pop"))
    seen = spark.createDataFrame([("L1", "L2", 4), ("L1", "L0", 9), ("L2", "L1", 1)], "origin string, destination string, flow long")
    rows = tiles.dealt(loc, 4, flows=seen)
    parts = rows.where("origin is not null").select("origin", F.spark_partition_id().alias("p"), F.pmod(F.hash("origin"), F.lit(4)).alias("h")).collect()
    assert len(parts) == 21 and all(r.p == r.h for r in parts)
    assert {r.origin: r["at"] and r.t for r in rows.where("origin in ('L1', 'L2', 'L0')").collect()} == {"L1": [4.0], "L2": [1.0], "L0": None}
    all_pairs = pairs.with_distance(pairs.od_pairs(loc, ("lat", "lng", "ln_pop")))
    want = {r.origin: r.s for r in all_pairs.groupBy("origin").agg(F.ln(F.sum(F.exp(0.8 * F.col("d_ln_pop") - 0.0005 * F.col("dist") + 2))).alias("s")).collect()}
    got = {r.origin: r.ls_score for r in tiles.log_sums(rows, [0.8, -0.0005, 2.0]).collect()}
    assert set(got) == set(want) and all(want[o] is None or got[o] == pytest.approx(want[o], rel=1e-12) for o in want)


@needs_tables
@pytest.mark.parametrize("few", [1, 10**9])
def test_nearest_are_found_without_pairs(spark, few, monkeypatch):
    """The pairs of features_knn are made once, at its end, and neither sorted nor joined by location."""
    monkeypatch.setattr(pairs, "FEW_PAIRS", few)
    plan = QUERIES["features_knn"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and "SortMergeJoin" not in plan.replace("SortMergeJoin [tile_id", "")
    test_query_against_duckdb(spark, "features_knn")


def test_nearest_of_packed_pairs(spark):
    """A tile of one, of two, of equal places, and an id with two rows in a tile and one in another: as by windows over pairs."""
    rows = [("one", "a", 1.0, 1.0), ("x", "b", 0.0, 0.0), ("y", "b", 0.0, 3.0), *[(f"L{k}", "c", float(k % 4), float(k * 7 % 5)) for k in range(12)], ("twice", "c", 2.0, 2.0), ("twice", "c", 2.0, 2.0), ("twice", "b", 2.0, 2.0), ("lost", None, 0.0, 0.0)]
    loc = pairs.with_angles(spark.createDataFrame(rows, "loc_id string, tile_id string, lat double, lng double")).withColumn("ln_pop", F.lit(0.0))
    want = pairs.nearest_distances(pairs.with_distance(pairs.od_pairs(loc, ("lat", "lng"))), 3)
    got = {r.loc_id: r.near for r in tiles.nearest(tiles.dealt(loc, 4), 3).collect()}
    assert len(got) == 15 and got == {r.loc_id: pytest.approx(r.near, rel=1e-12) for r in want.collect()}


@needs_tables
def test_the_full_net_needs_no_rows_of_pairs(spark, monkeypatch):
    def refuse(*args, **kw):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(pairs, "od_pairs", refuse)
    assert QUERIES["mlp_full"](spark, SF).count() == 26


@needs_tables
@pytest.mark.parametrize("name", ["features_knn", "mlp_full"])
def test_flows_are_not_written_for_populations_only(spark, name, monkeypatch):
    from odflow.plans import bindings

    names, plain = [], bindings.written
    monkeypatch.setattr(bindings, "written", lambda df, name: names.append(name) or plain(df, name))
    assert QUERIES[name](spark, SF).count() and names and "flows" not in names


def test_a_net_runs_once_for_locations_alike(spark, tmp_path, monkeypatch):
    """Three tiles; L0 to L11 have four places, three of each, one of them with two features, and an id comes twice."""
    rows = [(f"L{k}", "a", float(k % 4), 2.0, 5.0 if k == 3 else -1.5, float(k % 4)) for k in range(12)] + [("one", "b", 0.0, 2.0, -1.5, 0.0), ("twice", "c", 1.0, 1.0, 0.0, 7.0), ("twice", "c", 1.0, 1.0, 0.0, 7.0), ("none", "c", 1.0, 1.0, None, 7.0), ("lost", None, 1.0, 1.0, 0.0, 0.0)]
    loc = pairs.with_angles(spark.createDataFrame(rows, "loc_id string, tile_id string, lat double, lng double, u double, v double")).withColumn("ln_pop", F.lit(0.0))
    made = pairs.with_distance(pairs.od_pairs(loc, ("lat", "lng", "u", "v"))).select("origin", "destination", "o_u", "o_v", "d_u", "d_v", "dist").collect()
    layers = mlp.initial_layers([5, 6, 4, 1], 3)
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in made])
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0.0)
    want = sorted(((r.origin, r.destination, None if np.isnan(s) else s) for r, s in zip(made, mlp.forward(np.sign(x) * np.log(1 + np.abs(x)), layers)[-1][:, 0], strict=True)), key=key)
    runs, plain = str(tmp_path / "runs"), mlp.outputs

    def noted(x, layers):
        with open(runs, "a") as f:
            f.write(f"{len(x)}\n")
        return plain(x, layers)

    monkeypatch.setattr(tiles, "outputs", noted)
    got = sorted((tuple(r) for r in tiles.net_scores(tiles.dealt(loc, 4, more=("u", "v"), alike=True), layers, ("u", "v")).collect()), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 12 * 12 + 1 + 3 * 3
    assert all(g[2] == w[2] or g[2] == pytest.approx(w[2], abs=1e-12) for g, w in zip(got, want, strict=True))
    assert sorted(open(runs).read().split()) == ["1", "2", "2", *["5"] * 5]


def test_totals_of_features_are_alike_in_any_order(spark):
    from odflow.plans.bindings import _total

    values = [0.1, 1e8 + 0.7, -3.3, 1e-9, 0.2, 12345.67, 1e12, -0.3, 99.99] * 9
    orders = [values, values[::-1], sorted(values), sorted(values, key=abs, reverse=True)]
    df = spark.createDataFrame([(k, v) for k, o in enumerate(orders) for v in [*o, None]] + [(9, None), (8, float("nan"))], "k int, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(_total("v").alias("s")).collect()}
    assert {got[k] for k in range(4)} == {math.fsum(values)} and got[9] is None and math.isnan(got[8])


@needs_tables
@pytest.mark.parametrize("name", ["features_ng", "generated_flow"])
def test_destinations_are_not_dealt_to_every_part(spark, name, monkeypatch):
    monkeypatch.setattr(pairs, "FEW_PAIRS", 1)
    assert "Generate explode(sequence" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
