"""Comparison of models by decile of tile size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODELS = ("DG", "G", "MFG", "NG")


def round_mean(results: DataFrame) -> DataFrame:
    """(model, tile_id, cpc): the mean over rounds of long results (model, round, tile_id, cpc), null as 0."""
    return results.groupBy("model", "tile_id").agg(F.avg(F.coalesce("cpc", F.lit(0.0))).alias("cpc"))


def pivot(results: DataFrame, anchor: str = MODELS[0], drop_tile: str = "0") -> DataFrame:
    """(tile_id, one column a model) for the anchor's tiles but drop_tile."""
    mean = round_mean(results).where(F.col("tile_id") != drop_tile)
    wide = mean.groupBy("tile_id").pivot("model", list(MODELS)).agg(F.first("cpc"))
    return wide.where(F.col(anchor).isNotNull())


def rank_first(sizes: DataFrame) -> DataFrame:
    """sizes with rank: 1 is the smallest, ties by tile id. Each size is ranked on its own; one task sums up the sizes' counts only."""
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("n").agg(F.count("*").alias("_m")).select("n", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("tile_id")) + F.col("_start")
    return sizes.join(starts, "n").select(*sizes.columns, place.cast("int").alias("rank"))


def decile_by_rank(sizes: DataFrame) -> DataFrame:
    """sizes with decile 0 to 9: equal-frequency bins whose edges interpolate ranks linearly."""
    n = F.col("_rows")
    edge = F.when(n > 1, F.greatest(F.lit(0), F.ceil((F.col("rank") - 1) * 10 / (n - 1)) - 1)).otherwise(F.lit(0))
    total = sizes.agg(F.count("*").alias("_rows"))  # one row
    return rank_first(sizes).crossJoin(F.broadcast(total)).withColumn("decile", edge.cast("int")).drop("rank", "_rows")


def decile_by_value(sizes: DataFrame) -> DataFrame:
    """As decile_by_rank with edges of values; edges that repeat raise an error."""
    edges = sizes.agg(F.percentile("n", F.array(*[F.lit(k / 10) for k in range(11)])).alias("edges"))
    distinct = F.size(F.array_distinct("edges")) == 11
    checked = edges.select(F.when(distinct, F.col("edges")).otherwise(F.raise_error(F.lit("bin edges must be unique"))).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col("n")))
    return sizes.crossJoin(F.broadcast(checked)).withColumn("decile", F.greatest(F.lit(0), below - 1).cast("int")).drop("edges")


def by_decile(wide: DataFrame, deciles: DataFrame) -> DataFrame:
    """(decile, mean_ and std_ of each model), in order."""
    rows = wide.join(deciles.select("tile_id", "decile"), "tile_id")
    aggs = [f(m).alias(f"{name}_{m}") for m in MODELS for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy("decile").agg(*aggs).orderBy("decile")


def improvement(deciles: DataFrame, base: str = "G") -> DataFrame:
    """(decile, rel_ of each other model): per cent over the base's mean; null where that is 0."""
    rel = [(F.try_divide(F.col(f"mean_{m}") - F.col(f"mean_{base}"), F.col(f"mean_{base}")) * 100).alias(f"rel_{m}") for m in MODELS if m != base]
    return deciles.select("decile", *rel)
