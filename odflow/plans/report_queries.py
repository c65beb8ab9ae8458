"""Model comparison by decile."""

from __future__ import annotations

from ..operators import report
from . import bindings as b
from .registry import query, rounded

_RES = """m AS (SELECT unnest(['DG', 'G', 'MFG', 'NG']) AS model, unnest([1, 2, 3, 4]) AS m), c AS (SELECT DISTINCT c_custkey % 200 AS t FROM customer), r AS (SELECT unnest([0, 1]) AS round),
res AS (SELECT model, round, CAST(t AS VARCHAR) AS tile_id, t, CASE WHEN (t + m) % 23 = 0 THEN NULL ELSE ((t * 7 + m * 13 + round * 3) % 97) / 97.0::DOUBLE END AS cpc FROM c, m, r),
mean AS (SELECT model, tile_id, t, avg(coalesce(cpc, 0)) AS cpc FROM res GROUP BY model, tile_id, t),
wide AS (SELECT tile_id, t, max(CASE WHEN model = 'DG' THEN cpc END) AS DG, max(CASE WHEN model = 'G' THEN cpc END) AS G, max(CASE WHEN model = 'MFG' THEN cpc END) AS MFG, max(CASE WHEN model = 'NG' THEN cpc END) AS NG FROM mean WHERE t <> 0 GROUP BY tile_id, t)"""
_SIZES = "sizes AS (SELECT tile_id, CAST(t % 17 + 3 AS BIGINT) AS n FROM wide), free AS (SELECT tile_id, CAST(t * 3 + t % 3 AS BIGINT) AS n FROM wide)"
_RANK = """rk AS (SELECT tile_id, n, row_number() OVER (ORDER BY n, tile_id) AS r, count(*) OVER () AS c FROM sizes),
dr AS (SELECT tile_id, n, CAST(CASE WHEN c > 1 THEN greatest(0, ceil(CAST((r - 1) * 10 AS DOUBLE) / (c - 1)) - 1) ELSE 0 END AS INT) AS decile FROM rk)"""
_VALUE = """ed AS (SELECT quantile_cont(CAST(n AS DOUBLE), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM free),
dv AS (SELECT tile_id, n, CAST(greatest(0, len(list_filter(e, lambda x: x < n)) - 1) AS INT) AS decile FROM free, ed)"""
_AGG = ", ".join(f"round({f}({m}), 6) AS {p}_{m}" for m in report.MODELS for p, f in (("mean", "avg"), ("std", "stddev_samp")))
_STATS = [f"{p}_{m}" for m in report.MODELS for p in ("mean", "std")]


@query(f"WITH {_RES} SELECT tile_id, round(DG, 6) AS DG, round(G, 6) AS G, round(MFG, 6) AS MFG, round(NG, 6) AS NG FROM wide")
def report_pivot(spark, d):
    return rounded(report.pivot(b.reports(spark, d)), *report.MODELS)


@query(f"WITH {_RES} SELECT model, tile_id, round(cpc, 6) AS cpc FROM mean")
def round_mean(spark, d):
    return rounded(report.round_mean(b.reports(spark, d)), "cpc")


@query(f"WITH {_RES}, {_SIZES} SELECT tile_id, n, CAST(row_number() OVER (ORDER BY n, tile_id) AS INT) AS rank FROM sizes")
def rank_first(spark, d):
    return report.rank_first(b.sizes(spark, d))


@query(f"WITH {_RES}, {_SIZES}, {_RANK} SELECT tile_id, n, decile FROM dr")
def report_decile_rank(spark, d):
    return report.decile_by_rank(b.sizes(spark, d))


@query(f"WITH {_RES}, {_SIZES}, {_VALUE} SELECT tile_id, n, decile FROM dv")
def report_decile_value(spark, d):
    return report.decile_by_value(b.sizes(spark, d, ties=False))


@query(f"WITH {_RES}, {_SIZES}, {_RANK} SELECT decile, {_AGG} FROM wide JOIN dr USING (tile_id) GROUP BY decile")
def report_decile(spark, d):
    return rounded(report.by_decile(report.pivot(b.reports(spark, d)), report.decile_by_rank(b.sizes(spark, d))), *_STATS)


@query(f"""WITH {_RES}, {_SIZES}, {_RANK}, a AS (SELECT decile, avg(DG) AS DG, avg(G) AS G, avg(MFG) AS MFG, avg(NG) AS NG FROM wide JOIN dr USING (tile_id) GROUP BY decile)
SELECT decile, {', '.join(f'round(CASE WHEN G <> 0 THEN ({m} - G) / G * 100 END, 6) AS rel_{m}' for m in ('DG', 'MFG', 'NG'))} FROM a""")
def report_improvement(spark, d):
    made = report.improvement(report.by_decile(report.pivot(b.reports(spark, d)), report.decile_by_rank(b.sizes(spark, d))))
    return rounded(made, "rel_DG", "rel_MFG", "rel_NG")
