"""Multinomial choice: scores to probabilities to flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_FLOW = 1e-6  # fixed value: population of a place without outflow, and outflow of an origin without flows


def by_origin(origin: str = "origin"):
    return Window.partitionBy(origin)


def softmax(score: Column, origin: str = "origin") -> Column:
    """Probability among the origin's candidates; shifted by the largest score."""
    shifted = F.exp(score - F.max(score).over(by_origin(origin)))
    return shifted / F.sum(shifted).over(by_origin(origin))


def log_softmax(score: Column, origin: str = "origin") -> Column:
    shift = score - F.max(score).over(by_origin(origin))
    return shift - F.ln(F.sum(F.exp(shift)).over(by_origin(origin)))


LEVEL = 512.0  # the exponential of a score's place in its level is within a double's range


def log_sums(pairs: DataFrame, scores: tuple[str, ...], weighted: dict[str, Column] | None = None, origin: str = "origin") -> DataFrame:
    """(origin, ls_<score>): the logarithm of the sum of the scores' exponentials over the origin's candidates; and means of weighted.

    What softmax divides by, as one aggregation: nothing is sorted, and only sums by
    origin and level of the scores are shuffled, not pairs. A level is 512 wide, so no
    sum overflows; levels are added up under the largest. The weighted columns are
    averaged with the first score's probabilities.
    """
    weighted = weighted or {}
    levels = {s: F.floor(F.col(s) / LEVEL).cast("double") for s in scores}
    leveled = pairs.withColumns({f"_l_{s}": x for s, x in levels.items()})
    power = {s: F.exp(F.col(s) - LEVEL * F.col(f"_l_{s}")) for s in scores}
    sums = [F.sum(x).alias(f"_s_{s}") for s, x in power.items()] + [F.sum(power[scores[0]] * x).alias(f"_w_{k}") for k, x in weighted.items()]
    few = leveled.groupBy(origin, *[f"_l_{s}" for s in scores]).agg(*sums)
    names = [*[f"_l_{s}" for s in scores], *[f"_s_{s}" for s in scores], *[f"_w_{k}" for k in weighted]]
    each = few.groupBy(origin).agg(*[F.max(f"_l_{s}").alias(f"_m_{s}") for s in scores], F.collect_list(F.struct(*names)).alias("_rows"))
    under = lambda s, c: F.aggregate("_rows", F.lit(0.0), lambda a, r: a + F.coalesce(r[c] * F.exp(LEVEL * (r[f"_l_{s}"] - F.col(f"_m_{s}"))), F.lit(0.0)))
    logs = [(F.ln(under(s, f"_s_{s}")) + LEVEL * F.col(f"_m_{s}")).alias(f"ls_{s}") for s in scores]
    return each.select(origin, *logs, *[(under(scores[0], f"_w_{k}") / under(scores[0], f"_s_{scores[0]}")).alias(k) for k in weighted])


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def cpc(observed: Column, generated: Column, numerator_only: bool = False, denominator: str = "generated") -> Column:
    """Aggregate: twice the common part over twice the generated total (or over both totals); 0 without a total."""
    common = 2 * F.sum(F.least(observed, generated))
    if numerator_only:
        return common
    total = 2 * F.sum(generated) if denominator == "generated" else F.sum(observed) + F.sum(generated)
    return F.when(total > 0, common / total).otherwise(F.lit(0.0))
