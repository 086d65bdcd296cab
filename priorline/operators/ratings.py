"""Ratings from ordered evidence: priors, Bayesian updates and Kalman filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from . import folds
from .guards import ContractError
from .scan import apart, running


def carryover_prior(terminal: DataFrame, keys: list[str], gap: int = 1, rho: float = 0.6) -> DataFrame:
    """IT-8: next season's prior from the terminal state; reverts to (0, 1)."""
    d = rho**gap
    return terminal.select(*keys, (F.col("season") + gap).alias("season"), (d * F.col("mean")).alias("prior_mean"),
                           (d * d * F.col("variance") + 1 - d * d).alias("prior_variance"), F.col("season").alias("source_season"))


def attach_priors(rows: DataFrame, priors: DataFrame, keys: list[str]) -> DataFrame:
    """IT-8: the prior, neutral (0, 1) with a reason where there is no predecessor."""
    out = rows.join(priors, [*keys, "season"], "left")
    return out.withColumns({
        "fallback_reason": F.when(F.col("prior_mean").isNull(), "no_predecessor"),
        "prior_mean": F.coalesce("prior_mean", F.lit(0.0)), "prior_variance": F.coalesce("prior_variance", F.lit(1.0))})


def analytic_update(prior_mean: Column, prior_var: Column, observation: Column, exposure: Column, k: float) -> dict[str, Column]:
    """IT-9: precision-weighted posterior; without usable evidence the prior stays."""
    usable = observation.isNotNull() & ~F.isnan(observation) & (exposure > 0)
    info = F.when(usable, exposure / k).otherwise(0.0)
    var = 1 / (1 / prior_var + info)
    return {"variance": var, "mean": F.when(usable, var * (prior_mean / prior_var + info * observation)).otherwise(prior_mean),
            "weight": info / (1 / prior_var + info)}


def _places(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, chunk: int, columns: dict[str, Column]) -> DataFrame:
    """The rows with their place ``_p``, chunk ``_c``, the time of the row before, and named inputs."""
    base = reduce(DataFrame.unionByName, [running(rows, keys, order, slice_by, {"_was": ("last", columns["_at"])} | {"_p": ("count", F.lit(1))}, inclusive=False, sliced=sliced)
                                          for rows, sliced in apart(df.withColumns(columns), keys)])
    return base.withColumns({"_c": F.expr(f"_p div {chunk}"), "_weeks": F.coalesce((F.col("_at") - F.col("_was")) / 86400.0, F.lit(0.0)) / 7.0})


def _chunked(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, chunk: int, columns: dict[str, Column]) -> DataFrame:
    """The rows of :func:`_places`, written once."""
    return stage_table(_places(df, keys, order, slice_by, chunk, columns))


def kalman_filter(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, z: Column, exposure: Column, time: Column,
                  q: Column, r: Column, prior_mean: Column, prior_var: Column, chunk: int = 512) -> DataFrame:
    """IT-10: filter state after each row; variance grows by q per week, a missing value only widens.

    Rows are folded in chunks (:mod:`folds`): no task holds more than a chunk of rows, and inside a chunk the states of all
    rows come from array operations.
    """
    base = _chunked(df, keys, order, slice_by, chunk, {
        "_z": z.cast("double"), "_n": exposure.cast("double"), "_at": time.cast("double"), "_q": q.cast("double"), "_r": r.cast("double"),
        "_first": F.array(prior_mean.cast("double"), prior_var.cast("double"))})

    def parts(pdf: pd.DataFrame) -> tuple:
        # q and r may differ by row
        columns = {c: pdf[c].to_numpy(float) for c in ("_q", "_r", "_weeks", "_n", "_z")}
        return folds.kalman_elements(columns["_q"][:, None], columns["_r"][:, None], columns["_weeks"], columns["_n"], columns["_z"])

    def summarise(pdf: pd.DataFrame, seg: np.ndarray) -> list[np.ndarray]:
        last = np.append(folds.heads(seg)[1:], len(seg)) - 1
        return list(folds.segment_prefix(parts(pdf)[0], seg, folds.kalman_compose)[:, last, 0].T)

    def replay(pdf: pd.DataFrame, seg: np.ndarray, starts: list[np.ndarray]) -> tuple[np.ndarray, dict]:
        e, drift, noise = parts(pdf)
        after, before = folds.kalman_states(e, seg, np.array(starts).T[:, :, None])
        return np.arange(len(pdf)), {
            "_p": pdf["_p"].to_numpy(), "pred_mean": before[0, :, 0], "pred_variance": before[1, :, 0] + drift[:, 0],
            "noise": [x if x < np.inf else None for x in noise[:, 0]], "mean": after[0, :, 0], "variance": after[1, :, 0]}

    rows = base.select(*keys, "_c", "_p", "_z", "_n", "_weeks", "_q", "_r", "_first")
    out = folds.chunked_fold(rows, keys, summarise, folds.kalman_apply, folds.kalman_compose, replay,
                             "_p BIGINT, pred_mean DOUBLE, pred_variance DOUBLE, noise DOUBLE, mean DOUBLE, variance DOUBLE")
    return base.join(out, [*keys, "_p"]).select(*df.columns, "pred_mean", "pred_variance", "noise", "mean", "variance")


def _capped_chunks(df: DataFrame, keys: list[str], order: list[str], id_columns: list[str], slice_by: Column | str, q: float, sigma2: float, weak_weight: float,
                   cap: float, floor: float, chunk: int) -> DataFrame:
    """:func:`capped_kalman` over series of several chunks."""
    base = _chunked(df, keys, order, slice_by, chunk, {"_z": F.col("value").cast("double"), "_n": F.col("exposure").cast("double"), "_weak": F.coalesce(F.col("weak"), F.lit(False)),
                                                       "_at": F.lit(0.0)})
    used = F.col("_z").isNotNull() & ~F.isnan("_z") & (F.col("_n") > 0)
    # the mean never leaves the interval of its start and the values
    reach = base.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(F.when(used, F.col("_z")))).alias("_lo"), F.greatest(F.lit(0.0), F.max(F.when(used, F.col("_z")))).alias("_hi"))

    def floors(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, n = pdf["_z"].to_numpy(float), pdf["_n"].to_numpy(float)
        ok = np.isfinite(z) & (n > 0)
        noise = sigma2 / (np.where(pdf["_weak"].to_numpy(bool), weak_weight, 1.0) * np.maximum(np.where(ok, n, 1.0), 1.0))
        one, zero = np.ones(len(z)), np.zeros(len(z))
        return np.stack([np.where(ok, noise, one), np.where(ok, noise * q, q), np.where(ok, one, zero), np.where(ok, q + noise, one), np.where(ok, floor, -np.inf)]), noise, ok

    def summarise_variance(pdf: pd.DataFrame, seg: np.ndarray) -> list[np.ndarray]:
        last = np.append(folds.heads(seg)[1:], len(seg)) - 1
        return list(folds.segment_prefix(floors(pdf)[0], seg, folds.floor_compose)[:, last].T)

    def replay_variance(pdf: pd.DataFrame, seg: np.ndarray, starts: list[np.ndarray]) -> tuple[np.ndarray, dict]:
        e, noise, ok = floors(pdf)
        starts = np.array(starts)[:, 0]
        variance = folds.floor_apply(starts[seg], folds.segment_prefix(e, seg, folds.floor_compose))
        before = np.concatenate([variance[:1], variance[:-1]])
        before[folds.heads(seg)] = starts
        gain = np.where(ok, (before + q) / (before + q + noise), 0.0)
        return np.arange(len(pdf)), {"_p": pdf["_p"].to_numpy(), "variance": variance, "gain": gain, "_ok": ok}

    rows = base.select(*keys, "_c", "_p", "_z", "_n", "_weak", F.array(F.lit(1.0)).alias("_first"))
    spread = folds.chunked_fold(rows, keys, summarise_variance, lambda s, e: np.atleast_1d(folds.floor_apply(s, e)), folds.floor_compose, replay_variance,
                                "_p BIGINT, variance DOUBLE, gain DOUBLE, _ok BOOLEAN")
    rows = base.select(*keys, "_c", "_p", "_z", "_weak", F.array(F.lit(0.0)).alias("_first")).join(spread, [*keys, "_p"]).join(reach, keys)

    def summarise_mean(pdf: pd.DataFrame, seg: np.ndarray) -> list[np.ndarray]:
        out, was = [], -1
        for here, lo, hi, z, gain, ok, weak in zip(seg, *(pdf[c].to_numpy() for c in ("_lo", "_hi", "_z", "gain", "_ok", "_weak"))):
            if here != was:
                out.append(None if was < 0 else np.concatenate(folds.thin(xs, ys)))
                xs = ys = np.array([lo, hi])
                was = here
            if ok:
                xs, ys = folds.thin(*folds.capped_steps(xs, ys, z, gain, cap)) if weak else (xs, ys + gain * (z - ys))
        return [*out[1:], np.concatenate(folds.thin(xs, ys))]

    def after(state: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.interp(state, *np.split(e, 2))

    def then(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (xs, mid), (ins, outs) = np.split(x, 2), np.split(y, 2)
        corners = ins[(ins > mid[0]) & (ins < mid[-1])]
        at = np.interp(corners, mid, xs)
        order = np.searchsorted(xs, at)
        xs, mid = np.insert(xs, order, at), np.insert(mid, order, corners)
        return np.concatenate(folds.thin(xs, np.interp(mid, ins, outs)))

    def replay_mean(pdf: pd.DataFrame, seg: np.ndarray, starts: list[np.ndarray]) -> tuple[np.ndarray, dict]:
        means, capped, was, m = [], [], -1, 0.0
        for here, z, gain, ok, weak in zip(seg, *(pdf[c].to_numpy() for c in ("_z", "gain", "_ok", "_weak"))):
            m = float(starts[here][0]) if here != was else m
            was, gap = here, z - m if ok else 0.0
            step = max(-cap, min(cap, gap)) if weak else gap
            m += gain * step
            means.append(m)
            capped.append(step != gap)
        return np.arange(len(pdf)), {"_p": pdf["_p"].to_numpy(), "mean": means, "variance": pdf["variance"].to_numpy(), "gain": pdf["gain"].to_numpy(), "capped": capped}

    out = folds.chunked_fold(rows, keys, summarise_mean, after, then, replay_mean, "_p BIGINT, mean DOUBLE, variance DOUBLE, gain DOUBLE, capped BOOLEAN")
    return base.select(*dict.fromkeys([*keys, *id_columns]), "_p").join(out, [*keys, "_p"]).select(*id_columns, "mean", "variance", "gain", "capped")


def capped_kalman(df: DataFrame, keys: list[str], order: list[str], id_columns: list[str], slice_by: Column | str, q: float, sigma2: float, weak_weight: float = 0.25,
                  cap: float = 1.5, floor: float = 1e-4, chunk: int = 512) -> DataFrame:
    """IT-11: exposure-weighted filter with down-weighted, capped innovations and a variance floor.

    Columns: value, exposure, weak.  A series of at most ``chunk`` rows is one row of arrays, and many are walked at once, step by
    step.  Longer ones run in chunks: the variance does not depend on the mean, and its step composes; given the gains, a
    capped step of the mean is a rising piecewise linear function, and these compose as well.
    """
    first, ids = [c for c in order if c not in keys], [c for c in dict.fromkeys(id_columns) if c not in keys]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = folds.capped_walk(batch, q, sigma2, weak_weight, cap, floor)
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in [*keys, "_ids"]} | out)

    out = []
    for rows, is_long in apart(df, keys, chunk):
        if is_long:
            out.append(_capped_chunks(rows, keys, order, id_columns, slice_by, q, sigma2, weak_weight, cap, floor, chunk))
            continue
        inputs = [F.col("value").cast("double").alias("_z"), F.col("exposure").cast("double").alias("_n"), F.coalesce(F.col("weak"), F.lit(False)).alias("_weak")]
        series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first, *inputs, F.struct(F.lit(0).alias("_"), *ids).alias("_ids")))).alias("_rows"))
        series = series.select(*keys, *[F.col(f"_rows.{c}").alias(c) for c in ("_ids", "_z", "_n", "_weak")])
        done = series.mapInArrow(walk, f"{folds.named(series, [*keys, '_ids'])}, mean ARRAY<DOUBLE>, variance ARRAY<DOUBLE>, gain ARRAY<DOUBLE>, capped ARRAY<BOOLEAN>")
        done = done.select(*keys, F.inline(F.arrays_zip("_ids", "mean", "variance", "gain", "capped")))
        out.append(done.select(*[F.col(c) if c in keys else F.col(f"_ids.{c}").alias(c) for c in id_columns], "mean", "variance", "gain", "capped"))
    return reduce(DataFrame.unionByName, out)


Q_BOUNDS, R_BOUNDS = (0.0, 1.0), (1e-6, 100.0)
MIN_OBSERVATIONS = 8


class NoiseSeries:
    """Series whose innovation likelihood is wanted for several (q, r) of their group.

    A row is a chunk of a series as arrays, written once; a round reads the rows where they lie, and only a series of several
    chunks meets anything but its candidates: the states its chunks start from.
    """

    def __init__(self, df: DataFrame, group: list[str], keys: list[str], order: list[str], slice_by: Column | str, z: Column, exposure: Column, time: Column, chunk: int = 512):
        self.group, self.keys = group, list(dict.fromkeys([*group, *keys]))
        inputs = {"_z": z.cast("double"), "_n": exposure.cast("double"), "_at": time.cast("double")}
        usable = df.withColumns(inputs).where("_z IS NOT NULL AND NOT isnan(_z) AND abs(_z) < double('infinity') AND _n > 0")
        self.all = df.select(*group).distinct()
        rows = _places(usable.select(*dict.fromkeys([*self.keys, *order]), *inputs, (F.expr(slice_by) if isinstance(slice_by, str) else slice_by).alias("_on")),
                       self.keys, order, "_on", chunk, {c: F.col(c) for c in inputs})
        rows = rows.groupBy(*self.keys, "_c").agg(F.array_sort(F.collect_list(F.struct("_p", "_weeks", "_n", "_z"))).alias("_rows"))
        self.chunks = stage_table(rows.select(*self.keys, "_c", *[F.col(f"_rows.{c}").alias(c) for c in ("_weeks", "_n", "_z")]))
        self.long = None
        if self.chunks.where("_c > 0").limit(1).count():
            long = self.chunks.where("_c > 0").select(*self.keys).distinct()
            self.long = stage_table(self.chunks.join(long, self.keys, "left_semi"))
            self.chunks = stage_table(self.chunks.join(long, self.keys, "left_anti"))

    def counts(self) -> DataFrame:
        """(group, n): usable rows."""
        rows = self.chunks if self.long is None else self.chunks.union(self.long)
        return rows.groupBy(*self.group).agg(F.sum(F.size("_z")).alias("n"))

    def _starts(self, candidates: DataFrame) -> DataFrame:
        """(keys, _c, _s): the state each chunk of the long series starts from, means and variances per candidate."""
        keys = self.keys

        def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, left, series, q, r in folds.kalman_blocks(batch):
                    out = {c: batch[c].take(pa.array(rows)) for c in [*keys, "_c"]}
                    e = folds.kalman_sums(left, series, q, r)
                    out |= {"e": pa.array(list(np.moveaxis(e, 1, 0).reshape(len(rows), -1))), "s": pa.array([[0.0, 1.0]] * len(rows))}
                    yield pa.RecordBatch.from_pydict(out)

        def spread(f):
            def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                y = y.reshape(5, -1)
                x = x.reshape(2 if f is folds.kalman_apply else 5, -1)
                x = np.repeat(x, y.shape[1], axis=1) if x.shape[1] == 1 else x
                return f(x, y).ravel()

            return run

        chunks = self.long.join(candidates, self.group).mapInArrow(sum_up, f"{folds.named(self.long, keys)}, _c BIGINT, e ARRAY<DOUBLE>, s ARRAY<DOUBLE>")
        return folds.chunk_starts(stage_table(chunks), keys, spread(folds.kalman_apply), spread(folds.kalman_compose)).withColumnRenamed("s", "_s")

    def objective(self, candidates: DataFrame) -> DataFrame:
        """``candidates`` (group, _q, _r arrays) to (group, i, objective): half the sum of log variance and squared standardised innovation."""
        group = self.group

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                of = batch.select(group).to_pandas().groupby(group, dropna=False, sort=False).ngroup().to_numpy()
                first = np.unique(of, return_index=True)[1]
                total = 0.0
                for rows, left, series, q, r in folds.kalman_blocks(batch):
                    m, v = np.zeros_like(q), np.ones_like(q)
                    for at, row in enumerate(rows if "_s" in batch.schema.names else []):
                        m[at], v[at] = batch["_s"][int(row)].values.to_numpy().reshape(2, -1)
                    loss, sums = folds.kalman_losses(left, series, q, r, m, v), np.zeros((len(first), q.shape[1]))
                    np.add.at(sums, of[rows], loss)
                    total = total + sums
                many = total.shape[1]
                yield pa.RecordBatch.from_pydict({c: batch[c].take(pa.array(np.repeat(first, many))) for c in group} | {
                    "i": pa.array(np.tile(np.arange(many), len(first))), "loss": pa.array(total.ravel())})

        schema = f"{folds.named(self.chunks, group)}, i BIGINT, loss DOUBLE"
        out = self.chunks.join(candidates, group).mapInArrow(score, schema)
        if self.long is not None:
            out = out.union(self.long.join(self._starts(candidates), [*self.keys, "_c"]).join(candidates, group).mapInArrow(score, schema))
        return out.groupBy(*group, "i").agg(F.sum("loss").alias("objective"))


def fit_noise(df: DataFrame, group: list[str], keys: list[str], order: list[str], slice_by: Column | str, z: Column, exposure: Column, time: Column,
              tolerance: float = 1e-4, rounds: int = 60, chunk: int = 512) -> DataFrame:
    """IT-12: (q, r, objective, converged, n) of largest innovation likelihood per group, q in [0, 1], r in [1e-6, 100].

    All groups are searched at once: a grid over the whole range (root of q, logarithm of r), then grids around each group's
    best point, a third as wide whenever the best lies inside, until they are narrower than ``tolerance``.  Ties go to the
    smaller pair.  A group of fewer than 8 usable rows gets (0, 1, null, false).
    """
    series = NoiseSeries(df, group, keys, order, slice_by, z, exposure, time, chunk)
    many = series.counts()
    lo, hi = math.log(R_BOUNDS[0]), math.log(R_BOUNDS[1])
    box = stage_table(many.where(f"n >= {MIN_OBSERVATIONS}").select(*group, F.lit(0.5).alias("t"), F.lit((lo + hi) / 2).alias("u"), F.lit(0.5).alias("dt"), F.lit((hi - lo) / 2).alias("du")))
    offsets, first = [k / 3 for k in range(-3, 4)], [k / 6 for k in range(-6, 7)]
    for turn in range(rounds):
        grid = [(a, b) for a in (first if turn == 0 else offsets) for b in (first if turn == 0 else offsets)]
        points = F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in grid]), lambda p: F.struct(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("t") + p["a"] * F.col("dt"))).alias("t"),
            F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("u") + p["b"] * F.col("du"))).alias("u"), p["a"].alias("a"), p["b"].alias("b")))
        tried = box.withColumn("_points", points)
        found = series.objective(tried.select(*group, F.transform("_points", lambda p: p["t"] * p["t"]).alias("_q"), F.transform("_points", lambda p: F.exp(p["u"])).alias("_r")))
        scored = found.join(tried.drop("objective"), group).select(*group, "objective", F.get("_points", F.col("i").cast("int")).alias("p"), "dt", "du")
        best = scored.groupBy(*group).agg(F.min_by(F.struct("p", "objective", "dt", "du"), F.struct("objective", "p.t", "p.u")).alias("x"))
        # a step is kept where the best lies on the edge of its grid and the range goes on there
        wide = lambda v, edge, low, high: (F.abs(F.col(f"x.p.{edge}")) > 0.99) & (F.col(f"x.p.{v}") > low) & (F.col(f"x.p.{v}") < high)
        shrink = lambda v, edge, low, high: F.when(wide(v, edge, low, high), F.col(f"x.d{v}")).otherwise(F.col(f"x.d{v}") / (6 if turn == 0 else 3))
        box = stage_table(best.select(*group, F.col("x.p.t").alias("t"), F.col("x.p.u").alias("u"), shrink("t", "a", 0.0, 1.0).alias("dt"), shrink("u", "b", lo, hi).alias("du"), F.col("x.objective").alias("objective")))
        if not box.where(f"greatest(dt, du) > {tolerance}").limit(1).count():
            break
    else:
        raise ContractError(f"the noise fit has not settled after {rounds} rounds")
    out = series.all.join(many, group, "left").join(box, group, "left")
    fitted = F.col("t").isNotNull()
    return out.select(*group, F.when(fitted, F.col("t") * F.col("t")).otherwise(0.0).alias("q"), F.when(fitted, F.exp("u")).otherwise(1.0).alias("r"), "objective",
                      fitted.alias("converged"), F.coalesce("n", F.lit(0)).alias("n"))


def season_prior(terminal: DataFrame, features: DataFrame, keys: list[str], rho: float, betas: dict[str, float], center: Column, scale: Column) -> DataFrame:
    """IT-14: decayed terminal z plus standardised continuity features, mapped to observation units."""
    t = terminal.select(*keys, (F.col("season") + 1).alias("season"), (rho * F.col("z")).alias("_z"))
    out = features.join(t, [*keys, "season"], "left")
    z = F.coalesce("_z", F.lit(0.0))
    for name, beta in betas.items():
        z = z + beta * F.coalesce(name, F.lit(0.0))
    sign = F.when(F.col("role") == "defense", -1.0).otherwise(1.0)
    return out.withColumn("prior_z", z).withColumn("prior", center + sign * F.col("prior_z") * scale).drop("_z")


def partial_pool(states: DataFrame, targets: DataFrame, keys: list[str], time: str, mean: str, sd: str, exposure_per_state: float = 100.0) -> DataFrame:
    """IT-15: the mean of strictly earlier cohort states shrunk to (0, 1); the largest sd stays."""
    probes = targets.select(*keys, time).distinct()
    s = states.groupBy(*keys, time).agg(F.sum(mean).alias("_s"), F.count(mean).alias("_n"), F.max(sd).alias("_sd"))
    both = s.join(probes.withColumn("_probe", F.lit(1)), [*keys, time], "full_outer")
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    w = both.withColumns({c: f(c).over(before) for c, f in (("_s", F.sum), ("_n", F.sum), ("_sd", F.max))}).where("_probe = 1")
    up = analytic_update(F.lit(0.0), F.lit(1.0), F.try_divide("_s", "_n"), F.col("_n") * exposure_per_state, 1.0)
    w = w.withColumns({"pool_mean": up["mean"], "_pv": up["variance"]})
    return w.select(*keys, time, F.coalesce("pool_mean", F.lit(0.0)).alias("pool_mean"),
                    F.when(F.col("_n") > 0, F.greatest(F.sqrt("_pv"), F.col("_sd"))).otherwise(1.0).alias("pool_sd"),
                    F.when(F.col("_n") > 0, "preceding_pool").otherwise("neutral").alias("source"))


def replay_pregame(targets: DataFrame, evidence: DataFrame, keys: list[str], k: float, prior_mean: float = 0.0, prior_var: float = 1.0) -> DataFrame:
    """IT-16: the state before each target from evidence usable by then.

    ``evidence.usable_from`` is the first kickoff that may use the row; sums run over those times
    and each target takes the latest sum at or before its kickoff.
    """
    from .joins import latest_state
    e = evidence.where("exposure > 0 AND z IS NOT NULL").groupBy(*keys, "usable_from").agg(
        F.sum("exposure").alias("_e"), F.sum(F.col("exposure") * F.col("z")).alias("_ez"), F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("usable_from").rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, "usable_from", *[F.sum(c).over(upto).alias(c) for c in ("_e", "_ez", "_c")])
    out = latest_state(targets, e, keys, "kickoff", "usable_from", ["_e", "_ez", "_c"])
    up = analytic_update(F.lit(prior_mean), F.lit(prior_var), F.try_divide("_ez", "_e"), F.coalesce("_e", F.lit(0.0)), k)
    return out.withColumns({"mean": up["mean"], "variance": up["variance"], "exposure": F.coalesce("_e", F.lit(0.0)),
                            "evidence_games": F.coalesce("_c", F.lit(0))}).drop("_e", "_ez", "_c", "matched_usable_from")


def team_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """IT-17: one row per team from its two role states; the overall rating carries the summed variance."""
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    out = states.groupBy(*keys).agg(*[pick(r, c).alias(f"{r}_{c}") for r in ("offense", "defense") for c in ("mean", "variance")])
    return out.withColumns({"overall": (F.col("offense_mean") + F.col("defense_mean")) / 2,
                            "overall_sd": F.sqrt((F.col("offense_variance") + F.col("defense_variance")) / 4)})
