"""Declarative measures compiled to aggregate expressions (UX-1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """value = sum(numerator) / sum(denominator) over the rows of ``population``."""

    name: str
    numerator: str
    denominator: str
    population: str = "true"
    offense_high_is_good: bool = True

    def high_is_good(self, role: str) -> bool:
        return self.offense_high_is_good == (role == "offense")


def mean_metric(name: str, value: str, population: str = "true", high: bool = True) -> Metric:
    """A mean over the rows where the value is known."""
    return Metric(name, value, f"CASE WHEN {value} IS NOT NULL THEN 1 END", population, high)


# The registry of long team measures; add with ``register_metric``.
REGISTRY: dict[str, Metric] = {}


def register_metric(metric: Metric) -> Metric:
    if metric.name in REGISTRY:
        raise ValueError(f"metric {metric.name} registered twice")
    REGISTRY[metric.name] = metric
    return metric


for _m in (
    mean_metric("ppa_per_play", "ppa"),
    mean_metric("epa_pass", "ppa", "dropback = 1"),
    mean_metric("epa_rush", "ppa", "rush_attempt = 1 AND dropback = 0"),
    mean_metric("early_down_epa", "ppa", "down IN (1, 2)"),
    mean_metric("conv_rate_3rd_4th", "CASE WHEN yards >= CASE WHEN yards_to_first > 0 THEN yards_to_first ELSE yards_to_goal END "
                                     "THEN 1 ELSE 0 END", "down IN (3, 4)"),
    mean_metric("success_rate", "success"),
    mean_metric("explosive_rate", "CASE WHEN yards >= 20 THEN 1 ELSE 0 END"),
    mean_metric("turnover_rate", "turnover", high=False),
):
    register_metric(_m)


def sums(metrics: list[Metric]) -> list[Column]:
    """Numerator and denominator of every metric: one wide aggregation, one pass."""
    out = []
    for m in metrics:
        where = F.expr(m.population)
        out.append(F.sum(F.when(where, F.expr(m.numerator))).cast("double").alias(f"{m.name}__num"))
        out.append(F.sum(F.when(where, F.expr(m.denominator))).cast("double").alias(f"{m.name}__den"))
    return out


def to_long(wide: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    """One row per (keys, metric) with numerator, denominator and value; empty denominators give NULL."""
    rows = [F.struct(F.lit(m.name).alias("metric"), F.col(f"{m.name}__num").alias("numerator"),
                     F.coalesce(f"{m.name}__den", F.lit(0.0)).alias("denominator")) for m in metrics]
    long = wide.select(*keys, F.inline(F.array(*rows)))
    return long.withColumn("value", F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator")))


def role_measures(plays: DataFrame, keys: list[str], metrics: list[Metric] | None = None) -> DataFrame:
    """Long measures for both roles. Rows are summed per (offense, defense) pair once and the roles
    are taken from the pair table, so the play table is read and shuffled once, not twice."""
    metrics = metrics or list(REGISTRY.values())
    pairs = plays.groupBy(*keys, "offense", "defense").agg(*sums(metrics))
    names = [f"{m.name}__{part}" for m in metrics for part in ("num", "den")]
    both = pairs.select(*keys, *names, F.inline(F.array(
        F.struct(F.col("offense").alias("team"), F.lit("offense").alias("role")),
        F.struct(F.col("defense").alias("team"), F.lit("defense").alias("role")))))
    wide = both.groupBy(*keys, "team", "role").agg(*[F.sum(n).alias(n) for n in names])
    return to_long(wide, [*keys, "team", "role"], metrics)


def signed_value(value: Column, metric: Column, role: Column) -> Column:
    """Value with the sign that makes higher better, by the registry's directions."""
    low = F.lit(False)
    for m in REGISTRY.values():
        for r in ("offense", "defense"):
            if not m.high_is_good(r):
                low = low | ((metric == m.name) & (role == r))
    return F.when(low, -value).otherwise(value)
