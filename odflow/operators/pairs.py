"""Origin-destination pairs within tiles, their features, and samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, haversine_of


def last_tile(members: DataFrame) -> DataFrame:
    """One tile for a location: the greatest tile id wins."""
    return members.groupBy("loc_id").agg(F.max("tile_id").alias("tile_id"))


#: Pairs that one task makes, about, from how many on they are spread at all, and how many locations are broadcast.
TASK_PAIRS, FEW_PAIRS, FEW_LOCATIONS = 6_000_000, 500_000, 500_000


def parts_for(locations: DataFrame) -> int:
    """Into how many parts od_pairs should spread the origins, by the tiles' sizes: one row goes to the driver."""
    return parts_of(counted(locations)[1])


def parts_of(pairs: float) -> int:
    return 1 if pairs < FEW_PAIRS else max(16, int(-(-pairs // TASK_PAIRS)))


def counted(locations: DataFrame) -> tuple[float, float]:
    """Locations, and pairs of them."""
    n = F.col("n")
    row = locations.groupBy("tile_id").agg(F.count("*").cast("double").alias("n")).agg(F.sum(n), F.sum(n * n)).first()
    return row[0] or 0.0, row[1] or 0.0


def od_pairs(locations: DataFrame, columns: tuple[str, ...] = (), split: int = 1, origins: DataFrame | None = None, own: tuple[str, ...] = (), flows: DataFrame | None = None, few: bool = False) -> DataFrame:
    """All (origin, destination) of a tile, self pairs included, with o_ and d_ copies of the columns.

    The equality on the tile is the one join key. Tiles of very many locations are
    spread by split: origins fall into that many parts, destinations go to each, so a
    tile's part is a task's, and pairs are neither shuffled nor sorted. origins, locations
    by default, may have further columns (own) of theirs. With flows pairs have t, the
    observed flow: an origin's row has its flows with it, and each pair looks its own up.
    Then a location has one row. With few each executor can hold all destinations: they are
    broadcast, and only origins are dealt.
    """
    if split == 1:
        o, d = _ends(locations, origins, columns, own)
        made = o.join(d, "tile_id")
        return made if flows is None else with_flow(made, flows)
    if flows is not None:
        locations = locations.withColumn("place", F.row_number().over(Window.partitionBy("tile_id").orderBy("loc_id")))
        carried = flows_by_origin(locations, flows).withColumnRenamed("origin", "loc_id")
        origins, own = (locations if origins is None else origins).join(carried, "loc_id", "left"), (*own, "_flows")
    o, d = _ends(locations, origins, columns, own, () if flows is None else ("place",))
    if few:
        made = o.repartition(split, "origin").join(F.broadcast(d), "tile_id")
    else:
        made = _dealt(o, d, split)
    if flows is None:
        return made
    own_flow = F.get("_flows", F.pmod("place", F.lit(FLOW_MAPS)))[F.col("place")]
    return made.withColumn("t", F.coalesce(own_flow, F.lit(0)).cast("long")).drop("_flows", "place")


def _dealt(o: DataFrame, d: DataFrame, split: int) -> DataFrame:
    """Origins joined with destinations, which go to each of split parts."""
    cell = lambda part: F.concat_ws("|", part.cast("string"), "tile_id")  # noqa: E731 - one column, by which Spark keeps the rows dealt
    o = o.withColumn("cell", cell(F.pmod(F.xxhash64("origin"), F.lit(split)))).repartition(split, "cell")
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)))).withColumn("cell", cell(F.col("part"))).drop("part", "tile_id").repartition(split, "cell")
    return o.join(d.hint("shuffle_hash"), "cell").drop("cell")


FLOW_MAPS = 64  # Spark looks a map's key up from its start, so an origin's flows are in so many maps


def _ends(locations: DataFrame, origins: DataFrame | None, columns: tuple[str, ...], own: tuple[str, ...], more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    o = (locations if origins is None else origins).select("tile_id", F.col("loc_id").alias("origin"), *[F.col(c).alias(f"o_{c}") for c in columns], *own)
    return o, locations.select("tile_id", F.col("loc_id").alias("destination"), *[F.col(c).alias(f"d_{c}") for c in columns], *more)


def flows_by_origin(locations: DataFrame, flows: DataFrame) -> DataFrame:
    """(origin, _flows): flows within the tile, by the destination's place (an int) in an array of maps."""
    inside = flow_pairs(locations, ("place",), flows).groupBy("origin", F.col("d_place").alias("place")).agg(F.sum("t").alias("t"))
    few = inside.groupBy("origin", F.pmod("place", F.lit(FLOW_MAPS)).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("place", "t"))).alias("m"))
    by_key = few.groupBy("origin").agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("f"))
    return by_key.select("origin", F.transform(F.sequence(F.lit(0), F.lit(FLOW_MAPS - 1)), lambda k: F.col("f")[k]).alias("_flows"))


def flow_pairs(locations: DataFrame, columns: tuple[str, ...], flows: DataFrame) -> DataFrame:
    """Those pairs of od_pairs that have an observed flow, t."""
    ends = []
    for end, mark in (("origin", "o"), ("destination", "d")):
        ends.append(locations.select(F.col("loc_id").alias(end), F.col("tile_id").alias(f"{mark}_tile"), *[F.col(c).alias(f"{mark}_{c}") for c in columns]))
    made = flows.join(ends[0], "origin").join(ends[1], "destination").where("o_tile = d_tile")
    return made.withColumnRenamed("o_tile", "tile_id").drop("d_tile").withColumn("t", F.col("flow").cast("long")).drop("flow")


def described(pairs: DataFrame, locations: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """pairs (origin, destination, ...) with o_ and d_ copies of the locations' columns."""
    for end, mark in (("origin", "o"), ("destination", "d")):
        pairs = pairs.join(locations.select(F.col("loc_id").alias(end), *[F.col(c).alias(f"{mark}_{c}") for c in columns]), end)
    return pairs


def with_flow(pairs: DataFrame, flows: DataFrame) -> DataFrame:
    """pairs with t, the observed flow, 0 where there is none."""
    return pairs.join(flows, ["origin", "destination"], "left").withColumn("t", F.coalesce("flow", F.lit(0)).cast("long")).drop("flow")


def with_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("dist", haversine_km(F.col("o_lat"), F.col("o_lng"), F.col("d_lat"), F.col("d_lng")))


#: What with_angles adds, for angular_distance.
ANGLES = ("a_lat", "c_lat", "a_lng")


def with_angles(locations: DataFrame) -> DataFrame:
    """locations with radians and the latitude's cosine, which are a location's and need not be computed by pair."""
    return locations.withColumns({"a_lat": F.radians("lat"), "c_lat": F.cos(F.radians("lat")), "a_lng": F.radians("lng")})


def angular_distance(pairs: DataFrame) -> DataFrame:
    """with_distance of pairs that have the ANGLES of both ends instead, which go."""
    made = haversine_of(*[F.col(f"{m}_{c}") for m in "od" for c in ANGLES])
    return pairs.withColumn("dist", made).drop(*[f"{m}_{c}" for m in "od" for c in ANGLES])


def feature_vector(locations: DataFrame, columns: list[str]) -> DataFrame:
    """locations with x: the logarithm of pop, then the features."""
    return locations.withColumn("x", F.array(F.ln("pop"), *[F.col(c).cast("double") for c in columns]))


def feature_set(kind: str) -> Column:
    """Model inputs of a pair with o_/d_ pop and x, and dist.

    g: destination and distance; ng: both populations and distance; mfg and dg: both
    feature vectors and distance; knn: both vectors and both nearest-distance lists.
    """
    ln = lambda c: F.ln(F.col(c))
    if kind == "g":
        return F.array(ln("d_pop"), F.col("dist"))
    if kind == "ng":
        return F.array(ln("o_pop"), ln("d_pop"), F.col("dist"))
    if kind in ("mfg", "dg"):
        return F.concat(F.col("o_x"), F.col("d_x"), F.array("dist"))
    if kind == "knn":
        return F.concat(F.col("o_x"), F.col("d_x"), F.col("o_near"), F.col("d_near"))
    raise ValueError(f"unknown feature set {kind!r}")


def nearest_distances(pairs: DataFrame, k: int) -> DataFrame:
    """(loc_id, near): distances to the k nearest other locations of the tile, ascending."""
    rank = F.row_number().over(Window.partitionBy("origin").orderBy("dist", "destination"))
    near = pairs.where("origin <> destination").withColumn("r", rank).where(F.col("r") <= k)
    return near.groupBy("origin").agg(F.sort_array(F.collect_list("dist")).alias("near")).withColumnRenamed("origin", "loc_id")


def hash_order(*parts) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def sample_destinations(locations: DataFrame, flows: DataFrame, dim: int, frac_true: float = 0.5, seed: int = 1234, epoch: int = 0) -> DataFrame:
    """(origin, destination, is_true): for each origin min(dim, tile size) destinations.

    int(k * frac_true) of them, if there are so many, come from those that its flows
    go to, in the tile or not; the rest from the tile without those chosen.
    """
    sizes = locations.groupBy("tile_id").agg(F.count("*").alias("n"))
    origins = locations.select(F.col("loc_id").alias("origin"), "tile_id").join(sizes, "tile_id").withColumn("k", F.least(F.lit(dim), F.col("n")))
    order = lambda kind: Window.partitionBy("origin").orderBy(hash_order(seed, epoch, kind, F.col("origin"), F.col("destination")), "destination")
    wanted = F.floor(F.col("k") * F.lit(frac_true))
    if frac_true > 0:
        true = flows.where("flow > 0").select("origin", "destination").join(origins.select("origin", "k"), "origin")
        true = true.withColumn("r", F.row_number().over(order("true"))).where(F.col("r") <= wanted).select("origin", "destination")
    else:
        true = origins.select("origin", F.col("origin").alias("destination")).limit(0)
    chosen = true.groupBy("origin").agg(F.count("*").alias("n_true"))
    fake = od_pairs(locations).select("origin", "destination").join(true, ["origin", "destination"], "left_anti")
    fake = fake.join(origins.select("origin", "k"), "origin").join(chosen, "origin", "left")
    fake = fake.withColumn("r", F.row_number().over(order("fake"))).where(F.col("r") <= F.col("k") - F.coalesce("n_true", F.lit(0)))
    return true.withColumn("is_true", F.lit(True)).unionByName(fake.select("origin", "destination", F.lit(False).alias("is_true")))


def split_members(members: DataFrame, tiles: DataFrame) -> DataFrame:
    """(loc_id, tile_id, split) of the locations in the listed tiles; a listed tile without a location is an error when the rows are read."""
    listed = tiles.select(F.col("tile_id").cast("string").alias("tile_id"), "split")
    unknown = F.raise_error(F.concat(F.lit("the split lists a tile without locations: "), F.col("tile_id")))
    return listed.join(members, "tile_id", "left").select(F.when(F.col("loc_id").isNull(), unknown.cast("string")).otherwise(F.col("loc_id")).alias("loc_id"), "tile_id", "split")


def split_train_test(ids: DataFrame, fraction: float, seed: int = 1234) -> DataFrame:
    """(loc_id, split): the first int(n * fraction) by hash order are train."""
    total = ids.agg(F.count("*").alias("n"))
    ranked = ids.select("loc_id", hash_order(seed, F.col("loc_id")).alias("h"))
    # a global rank without one global sort: 256 ranges of the hash, each ranked on its own
    bucket = ranked.withColumn("b", F.substring("h", 1, 2))
    below = bucket.groupBy("b").agg(F.count("*").alias("m"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = below.select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("h", "loc_id")) + F.col("start")
    return bucket.join(F.broadcast(starts), "b").crossJoin(F.broadcast(total)).select("loc_id", F.when(place <= F.floor(F.col("n") * F.lit(fraction)), "train").otherwise("test").alias("split"))


def batches(origins: DataFrame, size: int) -> DataFrame:
    """(origin, batch): consecutive origins by id, the last batch may be short; numbered within a tile."""
    order = Window.partitionBy("tile_id").orderBy("origin")
    return origins.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
