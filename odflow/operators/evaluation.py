"""Generated flows and how well they match the observed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.choice import NO_FLOW, by_origin, cpc, log_softmax, softmax


def generate(pairs: DataFrame, score: str = "score", total: str = "in_tile", outflow: DataFrame | None = None) -> DataFrame:
    """pairs with p and gen: the probability times the origin's total, over its candidates or (total='all') over all its flows."""
    out = pairs.withColumn("p", softmax(F.col(score)))
    if total == "in_tile":
        return out.withColumn("gen", F.col("p") * F.sum("t").over(by_origin()))
    out = out.join(outflow, "origin", "left")
    return out.withColumn("gen", F.col("p") * F.coalesce("outflow", F.lit(0))).drop("outflow")


def of_sums(pairs: DataFrame, score: str = "score") -> DataFrame:
    """pairs with ls_<score> and tot of their origin, with lp, p and gen: as generate gives them, without a window."""
    out = pairs.withColumn("lp", F.col(score) - F.col(f"ls_{score}")).withColumn("p", F.exp("lp"))
    return out.withColumn("gen", F.col("p") * F.col("tot"))


def by_all_origins(origins: DataFrame, trips: DataFrame, name: str, value) -> DataFrame:
    """(origin, tot, name) of all origins (origin, tot): value aggregated over trips, the pairs with a flow, 0 without any. Pairs without a flow add nothing to what is summed of flows."""
    return origins.join(trips.groupBy("origin").agg(value.alias(name)), "origin", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def negative_log_likelihood(pairs: DataFrame, score: str = "score", normalize: bool = False) -> DataFrame:
    """(origin, nll): minus the flows times the log probabilities; normalize divides flows by the origin's."""
    terms = pairs.withColumn("lp", log_softmax(F.col(score)))
    if not normalize:
        return terms.groupBy("origin").agg((-F.sum(F.col("t") * F.col("lp"))).alias("nll"))
    total = F.sum("t")
    return terms.groupBy("origin").agg(F.when(total > 0, -F.sum(F.col("t") * F.col("lp")) / total).otherwise(F.lit(0.0)).alias("nll"))


def cpc_numerator(pairs: DataFrame) -> DataFrame:
    """(origin, cpc_num) of pairs with t and gen."""
    return pairs.groupBy("origin").agg(cpc(F.col("t"), F.col("gen"), numerator_only=True).alias("cpc_num"))


def cpc_origin(pairs: DataFrame, denominator: str = "generated") -> DataFrame:
    return pairs.groupBy("origin").agg(cpc(F.col("t"), F.col("gen"), denominator=denominator).alias("cpc"))


def tile_cpc(numerators: DataFrame, members: DataFrame, outflow: DataFrame) -> DataFrame:
    """(tile_id, cpc): half the numerators' sum over the origins' outflow, which counts flows that leave the tile too."""
    rows = numerators.join(members.select(F.col("loc_id").alias("origin"), "tile_id"), "origin").join(outflow, "origin", "left")
    total = F.sum(F.coalesce(F.col("outflow").cast("double"), F.lit(NO_FLOW)))
    return rows.groupBy("tile_id").agg((F.sum("cpc_num") / 2 / total).alias("cpc"))


def cpc_summary(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.avg("cpc").alias("mean_cpc"), F.stddev_samp("cpc").alias("std_cpc"), F.count("*").alias("n_tiles"))


def top1(pairs: DataFrame, score: str = "score") -> DataFrame:
    """(origin, destination): the best-scored one, ties to the least id."""
    best = F.min_by("destination", F.struct((-F.col(score)).alias("s"), F.col("destination")))
    return pairs.groupBy("origin").agg(best.alias("destination"))
