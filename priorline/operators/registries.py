"""Extension points: measurement recipes (UX-2) and rating designs (UX-3).

Both are registries of functions from DataFrame to DataFrame, so an extension is planned and
optimised like a built-in one.  Metrics (UX-1) register in ``metrics``, checks (UX-4) in ``quality``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ratings

RECIPES: dict[str, Callable[[DataFrame], DataFrame]] = {}
DESIGNS: dict[str, "Design"] = {}


@dataclass(frozen=True)
class Design:
    """``estimate(evidence) -> ratings``: evidence has team, season, z, exposure and kickoff; the result one row per team and season."""

    name: str
    estimate: Callable[[DataFrame], DataFrame]


def register_recipe(name: str):
    def wrap(fn):
        if name in RECIPES:
            raise ValueError(f"recipe {name} registered twice")
        RECIPES[name] = fn
        return fn
    return wrap


def register_design(name: str):
    def wrap(fn):
        if name in DESIGNS:
            raise ValueError(f"design {name} registered twice")
        DESIGNS[name] = Design(name, fn)
        return fn
    return wrap


@register_recipe("value_per_unit")
def _value_per_unit(rows: DataFrame) -> DataFrame:
    return rows.groupBy("season", "team").agg((F.sum("num") / F.sum("den")).alias("value"), F.sum("den").alias("exposure"))


@register_recipe("mean_value")
def _mean_value(rows: DataFrame) -> DataFrame:
    return rows.groupBy("season", "team").agg(F.avg("num").alias("value"), F.count("*").cast("double").alias("exposure"))


@register_design("analytic_k4")
def _analytic(evidence: DataFrame) -> DataFrame:
    s = evidence.where("exposure > 0 AND z IS NOT NULL").groupBy("season", "team").agg(F.sum("exposure").alias("_e"), F.sum(F.col("exposure") * F.col("z")).alias("_ez"))
    up = ratings.analytic_update(F.lit(0.0), F.lit(1.0), F.col("_ez") / F.col("_e"), F.col("_e"), 4.0)
    return s.select("season", "team", up["mean"].alias("mean"), up["variance"].alias("variance"))


@register_design("latest_game")
def _latest(evidence: DataFrame) -> DataFrame:
    e = evidence.where("exposure > 0 AND z IS NOT NULL")
    return e.groupBy("season", "team").agg(F.max_by("z", F.struct("kickoff", "game_id")).alias("mean"), F.lit(1.0).alias("variance"))


def run_designs(evidence: DataFrame, names: list[str]) -> DataFrame:
    parts = [DESIGNS[n].estimate(evidence).withColumn("design", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
