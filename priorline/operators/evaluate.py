"""Forecast evaluation: records, scorecards, slices, bias and market comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def weekly_records(rows: DataFrame, signed: Column, keys: list[str], week: str) -> DataFrame:
    """AG-34: wins, losses, pushes by week and cumulative; rates over decided rows."""
    s = rows.withColumn("_s", signed)
    one = lambda cond: F.count(F.when(cond, 1))
    per = s.groupBy(*keys, week).agg(one(F.col("_s") > 0).alias("w"), one(F.col("_s") < 0).alias("l"), one(F.col("_s") == 0).alias("p"))
    upto = Window.partitionBy(*keys).orderBy(week).rowsBetween(Window.unboundedPreceding, 0)
    out = per.withColumns({"cum_w": F.sum("w").over(upto), "cum_l": F.sum("l").over(upto)})
    share = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return out.withColumns({
        "win_rate": share("w", "l"), "cum_rate": share("cum_w", "cum_l"),
        "roi": F.try_divide(F.col("w") * 100.0 / 110 - F.col("l"), F.col("w") + F.col("l") + F.col("p"))})


def model_vs_line(rows: DataFrame, keys: list[str], big: float) -> DataFrame:
    """AG-36: whose miss is smaller, the lean, and the big misses."""
    m, l = F.abs(F.col("actual") - F.col("prediction")), F.abs(F.col("actual") - F.col("line"))
    one = lambda cond: F.count(F.when(cond, 1))
    return rows.groupBy(*keys).agg(
        F.avg(m).alias("model_miss"), F.avg(l).alias("line_miss"), F.avg(F.col("prediction") - F.col("line")).alias("lean"),
        one(m < l).alias("model_closer"), one(m > l).alias("line_closer"), one(m == l).alias("ties"), one(m >= big).alias("big_misses"))


def score_aggregates() -> list[Column]:
    """ML-8: n, MAE, RMSE, bias, CRPS, and coverage and width at 50, 80 and 95 percent."""
    err = F.col("prediction") - F.col("actual")
    out = [F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"),
           F.avg(stats.gaussian_crps(F.col("actual"), F.col("prediction"), F.col("sigma"))).alias("crps")]
    for level in (50, 80, 95):
        half = stats.Z_QUANTILES[level] * F.col("sigma")
        out += [F.avg((F.abs(err) <= half).cast("int")).alias(f"coverage_{level}"), F.avg(2 * half).alias(f"width_{level}")]
    return out


def scorecard(rows: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """ML-8: the scores for several groupings in one pass."""
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*score_aggregates())


def slice_table(rows: DataFrame, slices: dict[str, Column], small: int = 100) -> DataFrame:
    """ML-9: each row once per dimension, then one aggregation over (dimension, label)."""
    named = rows.select("target", "prediction", "actual", "sigma", F.inline(F.array(*[
        F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("label")) for n, c in slices.items()])))
    err = F.col("prediction") - F.col("actual")
    out = named.where("label IS NOT NULL").groupBy("target", "dimension", "label").agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"),
        F.avg((F.abs(err) <= stats.Z_QUANTILES[90] * F.col("sigma")).cast("int")).alias("coverage_90"))
    return out.withColumn("small_cell", F.col("n") < small)


def early_season_cost(rows: DataFrame, early: Column) -> DataFrame:
    """ML-9: how much more the early rows miss by than the others."""
    err = F.abs(F.col("prediction") - F.col("actual"))
    return rows.groupBy("target").agg(F.avg(F.when(early, err)).alias("early_mae"), F.avg(F.when(~early, err)).alias("later_mae")).withColumn(
        "cost", F.col("early_mae") - F.col("later_mae"))


def total_bias(wide: DataFrame, keys: list[str]) -> DataFrame:
    """ML-10: team-point errors from margin and total, and the share of the error that is bias."""
    h = (F.col("pred_total") + F.col("pred_margin")) / 2 - F.col("home_points")
    a = (F.col("pred_total") - F.col("pred_margin")) / 2 - F.col("away_points")
    t = F.col("pred_total") - F.col("home_points") - F.col("away_points")
    return wide.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(h).alias("home_bias"), F.avg(a).alias("away_bias"), F.avg(t).alias("total_bias"),
        F.try_divide(F.pow(F.avg(t), 2), F.avg(t * t)).alias("bias_share"), F.corr(h, a).alias("error_corr"))


def recentered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """WN-17: the shift each season gets from the mean error of strictly earlier seasons."""
    per = rows.groupBy(*keys, "season").agg(F.sum(F.col("prediction") - F.col("actual")).alias("s"), F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    return per.withColumn("shift", F.coalesce(F.sum("s").over(before) / F.sum("n").over(before), F.lit(0.0))).drop("s")


def match_claims(measured: DataFrame, claims: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """ML-11: reported against recomputed metrics."""
    out = claims.join(measured, keys, "left")
    gap = F.abs(F.col("reported") - F.col("value"))
    return out.withColumn("status", F.when(F.col("value").isNull(), "not_found").when(gap <= tolerance, "match").otherwise("mismatch"))


def paired_models(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """ML-12: two models on the games both predicted."""
    both = a.select(*keys, "actual", F.col("prediction").alias("_a")).join(b.select(*keys, F.col("prediction").alias("_b")), keys)
    ea, eb = F.abs(F.col("_a") - F.col("actual")), F.abs(F.col("_b") - F.col("actual"))
    return both.groupBy("target").agg(F.count("*").alias("n"), F.avg(ea).alias("mae_a"), F.avg(eb).alias("mae_b"),
                                      F.avg(eb - ea).alias("improvement"), F.count(F.when(ea < eb, 1)).alias("a_closer"))
