"""Ridge forecasts with rolling origin, inner alpha choice, calibration and bootstrap.

The data is read once: moments (counts, sums, cross products) are summed per (target, season).  Every
fold is a running sum of season moments, so all folds, alphas and targets come from that small table.
Only p x p systems reach Python, one per (target, fold, alpha), solved in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["target", "season"]


def _pairs(features: list[str]) -> list[tuple[str, str]]:
    cols = [*features, "y"]
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def clean(frame: DataFrame, features: list[str]) -> DataFrame:
    """Rows with any missing or infinite feature or target are dropped."""
    ok = F.lit(True)
    for c in [*features, "y"]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return frame.where(ok)


def season_moments(frame: DataFrame, features: list[str], shift: dict[str, float] | None = None) -> DataFrame:
    """One row per (target, season) with the count, sums and cross products of features and target.

    ``shift`` is subtracted first where a column's mean is large against its spread.
    """
    shift = shift or {}
    x = lambda c: F.col(c) - F.lit(float(shift.get(c, 0.0)))
    cols = [*features, "y"]
    return frame.groupBy(*KEYS).agg(
        F.count("*").cast("double").alias("n"), F.array(*[F.sum(x(c)) for c in cols]).alias("s"),
        F.array(*[F.sum(x(a) * x(b)) for a, b in _pairs(features)]).alias("q"))


def earlier_moments(moments: DataFrame, horizon: int | None = None) -> DataFrame:
    """ML-3: training moments of each validation season: all strictly earlier seasons, or the latest ``horizon``."""
    w = Window.partitionBy("target").orderBy("season")
    frame = w.rowsBetween(Window.unboundedPreceding if horizon is None else -horizon, -1)
    total = lambda c, size: F.array(*[F.sum(F.col(c)[i]).over(frame) for i in range(size)])
    first = moments.select(F.size("s").alias("a"), F.size("q").alias("b")).first()
    return moments.select("target", "season", F.sum("n").over(frame).alias("n"), F.count("n").over(frame).alias("seasons"),
                          total("s", first["a"]).alias("s"), total("q", first["b"]).alias("q"))


def solve(moments: DataFrame, features: list[str], alphas: list[float], floor: float = 1e-6, shift: dict[str, float] | None = None) -> DataFrame:
    """ML-1: ridge on standardised features (training mean, population sd with a floor); constant columns
    get no weight; the intercept is not penalised.  Coefficients are returned in raw units."""
    p = len(features)
    shift = np.array([float((shift or {}).get(c, 0.0)) for c in [*features, "y"]])
    alphas = [float(a) for a in alphas]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, s, q = r.n, np.asarray(r.s, float), np.asarray(r.q, float)
                full = np.zeros((p + 1, p + 1))
                full[np.triu_indices(p + 1)] = q
                mean = s / n
                cov = np.triu(full) + np.triu(full, 1).T - n * np.outer(mean, mean)
                var = np.diag(cov)[:p] / n
                vary = var > 1e-18 * np.maximum(1.0, mean[:p] ** 2)
                sd = np.maximum(np.sqrt(np.maximum(var, 0.0)), floor)
                a, b = cov[:p, :p] / np.outer(sd, sd), cov[:p, p] / sd
                for alpha in alphas:
                    beta = np.zeros(p)
                    if vary.any():
                        k = np.flatnonzero(vary)
                        beta[k] = np.linalg.solve(a[np.ix_(k, k)] + alpha * np.eye(len(k)), b[k])
                    raw = beta / sd
                    level = mean[p] + shift[p] - float(raw @ (mean[:p] + shift[:p]))
                    rows.append((r.target, r.season, alpha, n, level, raw.tolist()))
            yield pd.DataFrame(rows, columns=["target", "season", "alpha", "n_train", "intercept", "beta"])

    return moments.where("n > 0").select("target", "season", "n", "s", "q").mapInPandas(
        run, "target string, season int, alpha double, n_train double, intercept double, beta array<double>")


def score(frame: DataFrame, coefficients: DataFrame, features: list[str]) -> DataFrame:
    """ML-5: intercept plus dot product; the coefficient table has a row per (target, season, alpha)."""
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.col("beta")[i] * F.col(c)
    return frame.join(coefficients, KEYS).withColumn("fitted", value)


def rolling_origin(frame: DataFrame, features: list[str], alphas: list[float], horizon: int | None = None) -> DataFrame:
    """ML-3: out-of-fold predictions of every season, for every alpha."""
    data = clean(frame, features)
    return score(data, solve(earlier_moments(season_moments(data, features), horizon), features, alphas), features)


def inner_alpha(predictions: DataFrame, slack: float = 1.005) -> DataFrame:
    """ML-2: per (target, season) the largest alpha whose mean absolute error over earlier folds is
    within half a percent of the best; 10 where there is no earlier fold."""
    per = predictions.groupBy("target", "season", "alpha").agg(F.sum(F.abs(F.col("fitted") - F.col("y"))).alias("_e"), F.count("*").alias("_n"))
    w = Window.partitionBy("target", "alpha").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    past = per.select("target", "season", "alpha", (F.sum("_e").over(w) / F.sum("_n").over(w)).alias("mae"))
    best = past.groupBy("target", "season").agg(F.min("mae").alias("best"))
    pick = past.join(best, KEYS).groupBy(*KEYS).agg(F.max(F.when(F.col("mae") <= F.col("best") * slack, F.col("alpha"))).alias("alpha"))
    return pick.select(*KEYS, F.coalesce("alpha", F.lit(10.0)).alias("alpha"), F.col("alpha").isNull().alias("fallback"))


def calibrated_variance(residuals: DataFrame, floor: float = 1e-6) -> DataFrame:
    """ML-4: mean squared earlier out-of-fold residual per (target, season)."""
    per = residuals.groupBy(*KEYS).agg(F.sum(F.pow(F.col("fitted") - F.col("y"), 2)).alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy("target").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_n").over(w)
    return per.select(*KEYS, F.coalesce(n, F.lit(0)).alias("residuals"), F.coalesce(F.greatest(F.sum("_s").over(w) / n, F.lit(floor)), F.lit(floor)).alias("variance"),
                      F.when(n.isNull(), "no_prior_residuals").alias("fallback_reason"))


def draw(text: Column, size: Column) -> Column:
    """A reproducible index in [0, size) from a hash of the text."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)


def cluster_bootstrap(differences: DataFrame, cluster: list[str], value: str, replicates: int, seed: str = "s") -> DataFrame:
    """ML-6: mean difference of each replicate: whole clusters are drawn with replacement, and inside each drawn cluster its rows again.

    Clusters are numbered by the dense position of their key, rows of a cluster by their value, where equal values may trade places.
    The second draw joins a drawn cluster with its rows, so replicates x rows are made and none is held in an array. Null values are left out.
    """
    rows = differences.where(F.col(value).isNotNull()).select(*cluster, F.col(value).alias("_x"))
    c = rows.groupBy(*cluster).agg(F.count("*").alias("_n"))
    head = c.groupBy(cluster[0]).agg(F.count("*").alias("_k"))  # one row per season
    start = head.select(cluster[0], (F.sum("_k").over(Window.orderBy(cluster[0])) - F.col("_k")).alias("_base"), F.sum("_k").over(Window.partitionBy()).alias("_total"))
    place = F.row_number().over(Window.partitionBy(cluster[0]).orderBy(*(cluster[1:] or cluster))) - 1
    numbered = c.join(start, cluster[0]).withColumn("_i", F.col("_base") + place)
    inside = rows.withColumn("_j", F.row_number().over(Window.partitionBy(*cluster).orderBy("_x")) - 1)
    games = inside.join(numbered.select(*cluster, "_i", "_n"), cluster).select("_i", "_j", "_n", "_x")
    slots = numbered.select(F.col("_i").alias("_slot"), "_total").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    slots = slots.select("replicate", "_slot", draw(F.concat_ws(":", F.lit(seed), "replicate", "_slot"), F.col("_total")).alias("_i"))
    again = slots.join(games.select("_i", "_j", "_n"), "_i").select(
        "replicate", "_i", draw(F.concat_ws(":", F.lit(seed), "replicate", "_slot", "_j"), F.col("_n")).alias("_j"))
    return again.join(games.select("_i", "_j", "_x"), ["_i", "_j"]).groupBy("replicate").agg(F.avg("_x").alias("mean"))


def interval_of(replicates: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return replicates.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(low)).alias("lower"), F.percentile("mean", F.lit(high)).alias("upper"))


def select_candidate(scores: DataFrame, reference: str, minimum_gain: float, slack: float) -> DataFrame:
    """ML-7: candidates that gain enough overall and lose on no target; the simplest among near-equals.

    ``scores``: candidate, complexity, target, mae.
    """
    ref = scores.where(F.col("candidate") == reference).select("target", F.col("mae").alias("_ref"))
    per = scores.join(ref, "target").groupBy("candidate", "complexity").agg(
        F.avg("mae").alias("mae"), F.avg(F.col("_ref") - F.col("mae")).alias("gain"), F.min(F.col("_ref") - F.col("mae")).alias("worst"))
    passes = (F.col("gain") >= minimum_gain) & (F.col("worst") >= -slack)
    best = per.where(passes).agg(F.min("mae").alias("_best"))
    out = per.join(best).withColumn("passes", passes)
    near = F.when(passes & (F.col("mae") <= F.col("_best") + slack), F.struct("complexity", "mae", "candidate"))
    pick = out.agg(F.min(near)["candidate"].alias("_pick"))
    return out.join(pick).select("candidate", "mae", "gain", "worst", "passes", F.coalesce(F.col("candidate") == F.col("_pick"), F.lit(False)).alias("selected"))


def standardize_by_fold(frame: DataFrame, folds: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """PO-11: z by the moments of strictly earlier seasons, missing values at the mean; constant columns are null."""
    per = frame.groupBy("season").agg(*[x for c in columns for x in (F.sum(c).alias(f"_s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}"), F.count(c).alias(f"_n_{c}"))])
    w = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # one row per season
    past = per.select("season", *[F.sum(f"_{k}_{c}").over(w).alias(f"_{k}_{c}") for c in columns for k in "sqn"])
    out = frame.join(folds.select("season").distinct(), "season", "left_semi").join(past, "season")
    z = {}
    for c in columns:
        n, m = F.col(f"_n_{c}"), F.col(f"_s_{c}") / F.col(f"_n_{c}")
        sd = F.sqrt(F.greatest(F.col(f"_q_{c}") / n - m * m, F.lit(0.0)))
        z[f"z_{c}"] = F.when((n > 0) & (sd > floor), (F.coalesce(F.col(c).cast("double"), m) - m) / sd)
    return out.withColumns(z).drop(*[f"_{k}_{c}" for c in columns for k in "sqn"])


def candidate_grid(rows: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """PO-8: each row once per candidate of a fixed grid; the candidate id is a group key from then on."""
    out = rows
    for name, labels in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))
    return out.withColumn("candidate", F.concat_ws("|", *axes))
