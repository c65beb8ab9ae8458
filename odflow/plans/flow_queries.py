"""Flows, populations, pairs, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import bind
from ..operators import flows as ops
from ..operators import pairs as pair_ops
from ..sources.tables import table
from . import bindings as b
from .registry import query, round6, rounded


@query(f"WITH {b.SQL_LOC}, {b.SQL_FLOW} SELECT origin AS loc_id, CAST(outflow AS DOUBLE) AS pop FROM outf")
def population(spark, d):
    return ops.outflow(b.observed(spark, d)).select(F.col("origin").alias("loc_id"), F.col("outflow").cast("double").alias("pop"))


@query(f"""WITH {b.SQL_FLOW}, z AS (SELECT origin, CASE WHEN CAST(origin AS BIGINT) % 7 = 0 THEN 0 ELSE flow END AS flow FROM flow)
SELECT origin AS loc_id, CASE WHEN sum(flow) = 0 THEN 1e-6 ELSE CAST(sum(flow) AS DOUBLE) END AS pop FROM z GROUP BY origin""")
def population_floor(spark, d):
    zero = b.observed(spark, d).withColumn("flow", F.when(F.col("origin").cast("long") % 7 == 0, 0).otherwise(F.col("flow")))
    return ops.population(zero)


@query("""WITH l AS (SELECT CAST(s_suppkey AS VARCHAR) AS loc_id FROM supplier), o AS (SELECT CAST(o_custkey AS VARCHAR) AS origin, CAST(count(*) AS DOUBLE) AS outflow FROM orders GROUP BY 1)
SELECT coalesce(l.loc_id, o.origin) AS loc_id, coalesce(outflow, 1e-6) AS pop FROM l FULL JOIN o ON l.loc_id = o.origin""")
def population_full(spark, d):
    """Orders as flows of customers, suppliers as locations: both have ids that the other lacks."""
    trips = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("origin"), F.col("o_orderstatus").alias("destination")).agg(F.count("*").alias("flow"))
    return ops.population(trips, b.locations(spark, d))


@query(f"WITH {b.SQL_FLOW} SELECT origin, outflow FROM outf")
def outflow(spark, d):
    return ops.outflow(b.observed(spark, d))


@query(f"""WITH {b.SQL_FLOW} SELECT origin, CAST(count(*) AS INT) AS n_destinations, string_agg(destination || ':' || flow, ',' ORDER BY destination) AS flows FROM flow GROUP BY origin""")
def od_nested(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("flows")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return ops.nested(b.observed(spark, d)).select("origin", F.size("flows").alias("n_destinations"), text.alias("flows"))


@query("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS origin, CAST(o_custkey % 50 AS VARCHAR) AS destination, o_orderkey AS flow FROM orders)
SELECT origin, destination, max(flow) AS flow FROM r GROUP BY origin, destination""")
def od_dedupe_last(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("origin"), (F.col("o_custkey") % 50).cast("string").alias("destination"), F.col("o_orderkey").alias("flow"), F.col("o_orderkey").alias("seq"))
    return ops.dedupe(rows, "last", "seq")


@query(f"WITH {b.SQL_FLOW} SELECT origin, destination, flow FROM flow ORDER BY flow DESC, origin, destination LIMIT 10")
def topk_flows(spark, d):
    return ops.top_flows(b.observed(spark, d), 10)


@query(f"""WITH {b.SQL_LOC} SELECT tile_id, CAST(count(*) AS INT) AS n, string_agg(loc_id || '=' || CAST(lat AS BIGINT) || '/' || CAST(lng AS BIGINT), ',' ORDER BY loc_id) AS entries FROM loc GROUP BY tile_id""")
def df_to_map(spark, d):
    made = ops.to_map(b.locations(spark, d), "loc_id", ["lat", "lng"], "tile_id")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("entries")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda v: v.cast("long").cast("string")), "/"))), ",")
    return made.select("tile_id", F.size("entries").alias("n"), text.alias("entries"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS origin, CAST(l_partkey AS VARCHAR) AS destination, CAST(l_quantity AS BIGINT) AS flow FROM lineitem")
def proj_role_columns(spark, d):
    return bind(table(spark, d, "lineitem").drop("l_tax", "absent"), {"l_suppkey": ("origin", "string"), "l_partkey": ("destination", "string"), "l_quantity": ("flow", "long")})


@query(f"WITH {b.SQL_LOC} SELECT o.tile_id, o.loc_id AS origin, d.loc_id AS destination FROM loc o JOIN loc d ON o.tile_id = d.tile_id")
def od_pairs(spark, d):
    return pair_ops.od_pairs(b.locations(spark, d))


@query(f"WITH {b.SQL_LOC} SELECT o.tile_id, o.loc_id AS origin, d.loc_id AS destination FROM loc o JOIN loc d ON o.tile_id = d.tile_id")
def od_pairs_split(spark, d):
    return pair_ops.od_pairs(b.locations(spark, d), split=4)


@query(f"{b.PAIRS} SELECT origin, destination, t FROM pairs")
def od_pairs_flow(spark, d):
    return pair_ops.with_flow(pair_ops.od_pairs(b.locations(spark, d)), b.observed(spark, d)).select("origin", "destination", "t")


@query(f"{b.PAIRS} SELECT origin, destination, round(dist, 6) AS dist FROM pairs")
def od_distance(spark, d):
    return rounded(pair_ops.with_distance(pair_ops.od_pairs(b.locations(spark, d), ("lat", "lng"))).select("origin", "destination", "dist"), "dist")


_F = "ln({0}.pop), {0}.f_balance, {0}.f_lines, {0}.f_parts, {0}.f_price, {0}.f_quantity"


def _flat(df, prefix, n, *keep):
    return df.select(*keep, *[round6(F.col(prefix)[k]).alias(f"x{k:02d}") for k in range(n)])


def _vectors(spark, d):
    """The elements of feature set dg, rounded: those of locations before the join, the distance after it."""
    w = b.world(spark, d)
    loc = pair_ops.with_angles(pair_ops.feature_vector(b.featured(spark, d, w.flows), b.FEATURES))
    names = [f"x{k}" for k in range(6)]
    w.loc = b.written(loc.select("tile_id", "loc_id", *pair_ops.ANGLES, *[round6(F.col("x")[k]).alias(n) for k, n in enumerate(names)]), "rounded")
    w.columns = pair_ops.ANGLES
    made = w.pairs(more=tuple(names))
    return made.select("origin", "destination", *[F.col(f"{m}_{n}").alias(f"x{6 * i + k:02d}") for i, m in enumerate("od") for k, n in enumerate(names)], round6(F.col("dist")).alias("x12"))


@query(f"""{b.BASE}, {b.SQL_FEATURED} SELECT o.loc_id AS origin, d.loc_id AS destination, {', '.join(f'round({c}, 6) AS x{k:02d}' for k, c in enumerate((_F.format('o') + ', ' + _F.format('d')).split(', ')))},
round({b.SQL_DIST}, 6) AS x12 FROM feat o JOIN feat d ON o.tile_id = d.tile_id""")
def od_features(spark, d):
    return _vectors(spark, d)


@query(f"""{b.BASE}, {b.SQL_FEATURED} SELECT loc_id, {', '.join(f'round({c}, 6) AS x{k:02d}' for k, c in enumerate(_F.format('feat').split(', ')))} FROM feat""")
def feature_vector(spark, d):
    return _flat(pair_ops.feature_vector(b.featured(spark, d), b.FEATURES), "x", 6, "loc_id")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS loc_id, max(c_mktsegment) AS tile_id FROM customer GROUP BY c_nationkey")
def loc_tile_dedupe(spark, d):
    """Customers' nations as locations that lie in many tiles."""
    return pair_ops.last_tile(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("loc_id"), F.col("c_mktsegment").alias("tile_id")))


@query(f"WITH {b.SQL_LOC} SELECT tile_id, string_agg(loc_id, ',' ORDER BY loc_id) AS members FROM loc GROUP BY tile_id")
def tile_members(spark, d):
    return b.locations(spark, d).groupBy("tile_id").agg(F.array_join(F.array_sort(F.collect_list("loc_id")), ",").alias("members"))


@query(f"WITH {b.SQL_LOC} SELECT tile_id, CAST(count(*) AS BIGINT) AS n FROM loc GROUP BY tile_id")
def tile_sizes(spark, d):
    return b.locations(spark, d).groupBy("tile_id").agg(F.count("*").alias("n"))


@query(f"""{b.BASE}, {b.SQL_FEATURED} SELECT tile_id, loc_id, round(f_balance, 6) AS f_balance, round(f_price, 6) AS f_price FROM feat""")
def tile_features(spark, d):
    loc = b.locations(spark, d).select("loc_id", "tile_id")
    return rounded(b.featured(spark, d).drop("tile_id").join(loc, "loc_id").select("tile_id", "loc_id", "f_balance", "f_price"), "f_balance", "f_price")


@query(f"WITH {b.SQL_LOC} SELECT DISTINCT tile_id FROM loc")
def distinct_tiles(spark, d):
    return b.locations(spark, d).select("tile_id").distinct()


@query(f"WITH {b.SQL_LOC} SELECT loc_id, tile_id, CASE WHEN r_regionkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM loc JOIN region ON tile_id = CAST(r_regionkey AS VARCHAR)")
def split_membership(spark, d):
    return pair_ops.split_members(b.locations(spark, d).select("loc_id", "tile_id"), b.split_tiles(spark, d))


@query(f"""WITH {b.SQL_LOC}, r AS (SELECT loc_id, row_number() OVER (ORDER BY md5('1234|' || loc_id), loc_id) AS r, count(*) OVER () AS n FROM loc)
SELECT loc_id, CASE WHEN r <= floor(n * 0.5) THEN 'train' ELSE 'test' END AS split FROM r""")
def split_train_test(spark, d):
    return pair_ops.split_train_test(b.locations(spark, d), 0.5)


@query(f"""WITH {b.SQL_LOC} SELECT loc_id AS origin, tile_id, CAST(floor((row_number() OVER (PARTITION BY tile_id ORDER BY loc_id) - 1) / 4) AS BIGINT) AS batch FROM loc""")
def batches(spark, d):
    return pair_ops.batches(b.locations(spark, d).select(F.col("loc_id").alias("origin"), "tile_id"), 4)


def _sample_sql(dim: int, frac: float) -> str:
    return f"""WITH {b.SQL_LOC}, {b.SQL_FLOW}, o AS (SELECT loc_id AS origin, tile_id, least({dim}, count(*) OVER (PARTITION BY tile_id)) AS k FROM loc),
tr AS (SELECT f.origin, f.destination, row_number() OVER (PARTITION BY f.origin ORDER BY md5('1234|0|true|' || f.origin || '|' || f.destination), f.destination) AS r, k FROM flow f JOIN o ON o.origin = f.origin),
t AS (SELECT origin, destination FROM tr WHERE r <= floor(k * {frac})),
fk AS (SELECT o.origin, l.loc_id AS destination, k FROM o JOIN loc l ON o.tile_id = l.tile_id ANTI JOIN t ON t.origin = o.origin AND t.destination = l.loc_id),
fr AS (SELECT fk.origin, fk.destination, k - coalesce(n, 0) AS m, row_number() OVER (PARTITION BY fk.origin ORDER BY md5('1234|0|fake|' || fk.origin || '|' || fk.destination), fk.destination) AS r
  FROM fk LEFT JOIN (SELECT origin, count(*) AS n FROM t GROUP BY origin) c ON c.origin = fk.origin)
SELECT origin, destination, TRUE AS is_true FROM t UNION ALL SELECT origin, destination, FALSE FROM fr WHERE r <= m"""


@query(_sample_sql(8, 0.25))
def sample_destinations(spark, d):
    return pair_ops.sample_destinations(b.locations(spark, d), b.observed(spark, d), 8, 0.25)


@query(_sample_sql(12, 0.5))
def sample_destinations_half(spark, d):
    return pair_ops.sample_destinations(b.locations(spark, d), b.observed(spark, d), 12)


@query(_sample_sql(512, 0.0))
def sample_train(spark, d):
    return pair_ops.sample_destinations(b.locations(spark, d), b.observed(spark, d), 512, 0.0)
