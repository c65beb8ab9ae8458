"""Flows between locations: building, deduplicating, nesting, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.choice import NO_FLOW


def transitions(steps: DataFrame, entity: str, order: list[str], place: str, ends: tuple[str, ...] = ("origin", "destination")) -> DataFrame:
    """(origin, destination, flow): how often an entity's next step goes from place to place; or by one of the ends only.

    Steps that tie in the order up to the place are at the same place, so what the order
    has after it decides nothing and is not shuffled. Whole numbers become text when
    they are counted.
    """
    if place in order:
        order = order[: order.index(place) + 1]
    kind = "long" if dict(steps.dtypes)[place] in ("tinyint", "smallint", "int", "bigint") else "string"
    following = F.lead(place).over(Window.partitionBy(entity).orderBy(*order))
    trips = steps.select(F.col(place).cast(kind).alias("origin"), following.cast(kind).alias("destination"))
    counted = trips.where(F.col("destination").isNotNull()).groupBy(*ends).agg(F.count("*").alias("flow"))
    return counted.select(*[F.col(e).cast("string").alias(e) for e in ends], "flow")


def dedupe(flows: DataFrame, keep: str = "sum", sequence: str | None = None) -> DataFrame:
    """One row for an (origin, destination): the flows' sum, or the last by the sequence column."""
    if keep == "sum":
        value = F.sum("flow")
    elif keep == "last" and sequence:
        value = F.max_by("flow", sequence)
    else:
        raise ValueError("keep is 'sum', or 'last' with a sequence column")
    return flows.groupBy("origin", "destination").agg(value.alias("flow"))


def outflow(flows: DataFrame) -> DataFrame:
    """(origin, outflow) over all destinations, in the tile or not."""
    return flows.groupBy("origin").agg(F.sum("flow").alias("outflow"))


def population(flows: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """(loc_id, pop): outflow with 0 raised to NO_FLOW; with locations, also those without flows, and flows of unknown places stay."""
    total = outflow(flows).select(F.col("origin").alias("loc_id"), F.col("outflow").cast("double").alias("pop"))
    if locations is not None:
        total = locations.select("loc_id").distinct().join(total, "loc_id", "full")
    return total.select("loc_id", F.when(F.coalesce("pop", F.lit(0.0)) == 0, F.lit(NO_FLOW)).otherwise(F.col("pop")).alias("pop"))


def nested(flows: DataFrame) -> DataFrame:
    """(origin, flows): a map from destination to flow."""
    pairs = F.array_sort(F.collect_list(F.struct("destination", "flow")))
    return flows.groupBy("origin").agg(F.map_from_entries(pairs).alias("flows"))


def to_map(df: DataFrame, key: str, values: list[str], group: str) -> DataFrame:
    """(group, entries): by group a map from key to an array of the values."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.array(*[F.col(v).cast("double") for v in values]).alias("value"))))
    return df.groupBy(group).agg(F.map_from_entries(entries).alias("entries"))


def top_flows(flows: DataFrame, n: int = 10) -> DataFrame:
    """The n largest flows, ties by origin and destination."""
    return flows.orderBy(F.desc("flow"), "origin", "destination").limit(n)
