"""Ordered folds whose steps compose: a key's rows are cut into chunks, and chunks into chunks of chunks.

Each chunk is summed up as one element, an array of numbers that stands for "what these rows do to a state".  States at the
chunk starts are found level by level, never more than ``fan`` elements in a task, and every chunk is then replayed from
its start.  A key with a third of all rows is thus as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

FAN = 512
Array = np.ndarray


def named(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def by_segments(df: DataFrame, keys: list[str], order: str, fn: Callable[[pd.DataFrame, Array], tuple[Array, dict]], schema: str) -> DataFrame:
    """``fn(rows, segment numbers) -> (row places, columns)`` over whole groups of ``keys`` in ``order``, many groups in one call.

    Rows are hash-partitioned and sorted; a group that an Arrow batch ends in waits for the next batch.  The key columns of
    the returned row places are put in front.  One call for many groups, because a call for each costs far more than its work.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame, starts: Array) -> pd.DataFrame:
            at, found = fn(pdf, np.cumsum(starts) - 1)
            return pd.concat([pdf[keys].iloc[at].reset_index(drop=True), pd.DataFrame(found)], axis=1)

        rest = None
        for batch in batches:
            pdf = (batch[columns] if rest is None else pd.concat([rest, batch[columns]], ignore_index=True)).reset_index(drop=True)
            starts = np.zeros(len(pdf), bool)
            starts[:1] = True
            for key in keys:
                codes = pd.factorize(pdf[key], use_na_sentinel=False)[0]
                starts[1:] |= codes[1:] != codes[:-1]
            last = int(np.flatnonzero(starts)[-1]) if len(pdf) else 0
            rest = pdf.iloc[last:]
            if last:
                yield done(pdf.iloc[:last], starts[:last])
        if rest is not None and len(rest):
            yield done(rest.reset_index(drop=True), np.arange(len(rest)) == 0)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, f"{named(df, keys)}, {schema}")


def heads(seg: Array) -> Array:
    return np.flatnonzero(np.diff(seg, prepend=-1))


def segment_prefix(e: Array, seg: Array, compose: Callable[[Array, Array], Array]) -> Array:
    """Elements (parts, rows, ...) of the first 1, 2, ... rows of each segment, in a logarithmic number of array steps."""
    longest, shift = int(np.bincount(seg).max()) if len(seg) else 0, 1
    while shift < longest:
        same = (seg[shift:] == seg[:-shift]).reshape((1, -1) + (1,) * (e.ndim - 2))
        e = np.concatenate([e[:, :shift], np.where(same, compose(e[:, :-shift], e[:, shift:]), e[:, shift:])], axis=1)
        shift *= 2
    return e


def chunk_starts(chunks: DataFrame, keys: list[str], apply: Callable[[Array, Array], Array], compose: Callable[[Array, Array], Array], fan: int | None = None) -> DataFrame:
    """(keys, _c, s): the state each chunk starts from.  ``chunks`` has (keys, _c, e, s), where s holds the key's first state."""

    def walk(pdf: pd.DataFrame, seg: Array) -> tuple[Array, dict]:
        out, state, was = [], None, -1
        for here, first, element in zip(seg, pdf["s"], pdf["e"]):
            state = np.asarray(first, float) if here != was else state
            out.append(state)
            state, was = apply(state, np.asarray(element, float)), here
        return np.arange(len(pdf)), {"_c": pdf["_c"].to_numpy(), "s": out}

    schema, fan = "_c BIGINT, s ARRAY<DOUBLE>", fan or FAN
    if (chunks.agg(F.max("_c")).first()[0] or 0) < fan:
        return by_segments(chunks, keys, "_c", walk, schema)

    def merge(pdf: pd.DataFrame, seg: Array) -> tuple[Array, dict]:
        first, whole = heads(seg), []
        for here, element in zip(seg, pdf["e"]):
            element = np.asarray(element, float)
            if here == len(whole):
                whole.append(element)
            else:
                whole[-1] = compose(whole[-1], element)
        return first, {"e": whole, "s": pdf["s"].iloc[first].to_list()}

    cut = chunks.withColumn("_u", F.expr(f"_c div {fan}"))
    upper = stage_table(by_segments(cut, [*keys, "_u"], "_c", merge, "e ARRAY<DOUBLE>, s ARRAY<DOUBLE>").withColumnRenamed("_u", "_c"))
    above = chunk_starts(upper, keys, apply, compose, fan).withColumnRenamed("_c", "_u")
    return by_segments(cut.drop("s").join(above, [*keys, "_u"]), [*keys, "_u"], "_c", walk, schema).drop("_u")


def chunked_fold(rows: DataFrame, keys: list[str], summarise: Callable[[pd.DataFrame, Array], list[Array]], apply: Callable[[Array, Array], Array],
                 compose: Callable[[Array, Array], Array], replay: Callable[[pd.DataFrame, Array, list[Array]], tuple[Array, dict]], schema: str, fan: int | None = None) -> DataFrame:
    """``replay(rows, segments, start states) -> (row places, columns)`` over all chunks, many in one call.

    ``rows`` has the keys, ``_c`` (chunk from 0), ``_p`` (order in the key), ``_first`` (the key's first state) and what the functions read;
    ``summarise`` gives one element per segment.
    """
    rows = stage_table(rows)

    def sum_up(pdf: pd.DataFrame, seg: Array) -> tuple[Array, dict]:
        first = heads(seg)
        return first, {"e": list(summarise(pdf, seg)), "s": pdf["_first"].iloc[first].to_list()}

    def play(pdf: pd.DataFrame, seg: Array) -> tuple[Array, dict]:
        first = heads(seg)
        states = [np.asarray(f if s is None else s, float) for f, s in zip(pdf["_first"].iloc[first], pdf["_s"].iloc[first])]
        return replay(pdf, seg, states)

    if (rows.agg(F.max("_c")).first()[0] or 0) == 0:
        started = rows.withColumn("_s", F.lit(None).cast("array<double>"))
    else:
        long = rows.where("_c > 0").select(*keys).distinct()  # only keys of several chunks need starts
        chunks = stage_table(by_segments(rows.join(long, keys, "left_semi"), [*keys, "_c"], "_p", sum_up, "e ARRAY<DOUBLE>, s ARRAY<DOUBLE>"))
        starts = chunk_starts(chunks, keys, apply, compose, fan).withColumnRenamed("s", "_s")
        started = rows.join(starts, [*keys, "_c"], "left")
    return by_segments(started, [*keys, "_c"], "_p", play, schema).drop("_c")


# Kalman steps (A, b, C, eta, J) compose associatively (Sarkka and Garcia-Fernandez, 2020); arrays are (5, rows, candidates)
def kalman_elements(q: Array, r: Array, weeks: Array, n: Array, z: Array) -> tuple[Array, Array, Array]:
    """Elements, drift and noise of rows (first axis) under candidates (second axis of q and r); unusable rows only drift."""
    used = (np.isfinite(z) & (n > 0))[:, None]
    drift = q * weeks[:, None]
    noise = np.where(used, r / np.where(used, n[:, None], 1.0), np.inf)
    s = drift + np.where(used, noise, 1.0)
    k, zz = np.where(used, drift / s, 0.0), np.where(used, z[:, None], 0.0)
    return np.stack([1 - k, k * zz, (1 - k) * drift, np.where(used, zz / s, 0.0), np.where(used, 1 / s, 0.0)]), drift, noise


def kalman_compose(x: Array, y: Array) -> Array:
    d = 1 + x[2] * y[4]
    return np.stack([y[0] * x[0] / d, y[0] * (x[1] + x[2] * y[3]) / d + y[1], y[0] * y[0] * x[2] / d + y[2],
                     x[0] * (y[3] - y[4] * x[1]) / d + x[3], x[0] * x[0] * y[4] / d + x[4]])


def kalman_apply(state: Array, e: Array) -> Array:
    m, v = state
    return np.stack([e[0] * (m + v * e[3]) / (1 + v * e[4]) + e[1], e[0] * e[0] * v / (1 + v * e[4]) + e[2]])


def kalman_states(e: Array, seg: Array, starts: Array) -> tuple[Array, Array]:
    """Means and variances (2, rows, candidates) after each row, and before it; ``starts`` is (2, segments, candidates)."""
    after = kalman_apply(starts[:, seg], segment_prefix(e, seg, kalman_compose))
    before = np.concatenate([after[:, :1], after[:, :-1]], axis=1)
    before[:, heads(seg)] = starts
    return after, before


def kalman_blocks(batch: pa.RecordBatch, cells: int = 32_768) -> Iterator[tuple[Array, Array, tuple[Array, Array, Array], Array, Array]]:
    """Series of a batch (lists _weeks, _n, _z and candidates _q, _r), longest first: (rows, rows left at each step, (weeks, n, z) by step and row, q, r).

    A block has about ``cells`` rows times candidates, so that a step's arrays stay in a core's cache.
    """
    lengths = batch["_z"].value_lengths().to_numpy()
    first, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    values = [batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("_weeks", "_n", "_z")]
    q, r = (batch[c].flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1) for c in ("_q", "_r"))
    size = max(1, cells // max(1, q.shape[1]))
    for a in range(0, len(order), size):
        rows = order[a:a + size]
        step = np.arange(lengths[rows[0]])[:, None]
        left = (lengths[rows] > step).sum(axis=1)
        at = np.where(lengths[rows] > step, first[rows] + step, 0)
        yield rows, left, tuple(x[at] for x in values), q[rows], r[rows]


def kalman_losses(left: Array, series: tuple[Array, Array, Array], q: Array, r: Array, m: Array, v: Array) -> Array:
    """Half the sum of log variance and squared standardised innovation, all series of a block and all candidates at once, from means ``m`` and variances ``v``."""
    loss, m, v = np.zeros_like(q), m.copy(), v.copy()
    for k, a in enumerate(left):
        weeks, n, z = (x[k, :a, None] for x in series)
        ahead, noise, gap = v[:a] + q[:a] * weeks, r[:a] * (1.0 / n), z - m[:a]
        s = ahead + noise
        pull = gap / s
        loss[:a] += np.log(s)
        loss[:a] += gap * pull
        m[:a] += ahead * pull
        v[:a] = ahead * noise / s
    return 0.5 * loss


def kalman_sums(left: Array, series: tuple[Array, Array, Array], q: Array, r: Array) -> Array:
    """The elements (5, rows, candidates) of whole series of a block."""
    out = None
    for k, a in enumerate(left):
        weeks, n, z = (x[k, :a] for x in series)
        e = kalman_elements(q[:a], r[:a], weeks, n, z)[0]
        if out is None:
            out = e
        else:
            out[:, :a] = kalman_compose(out[:, :a], e)
    return out


# The variance with its floor: v -> max((a v + b) / (c v + d), f), closed under composition because the fraction rises in v
def floor_compose(x: Array, y: Array) -> Array:
    a, b, c, d = (y[0] * x[0] + y[1] * x[2], y[0] * x[1] + y[1] * x[3], y[2] * x[0] + y[3] * x[2], y[2] * x[1] + y[3] * x[3])
    with np.errstate(invalid="ignore", divide="ignore"):
        f = np.where(np.isfinite(x[4]), (y[0] * x[4] + y[1]) / (y[2] * x[4] + y[3]), -np.inf)
    top = np.maximum.reduce(np.abs([a, b, c, d]))
    return np.stack([a / top, b / top, c / top, d / top, np.maximum(f, y[4])])


def floor_apply(v: Array | float, e: Array) -> Array:
    return np.maximum((e[0] * v + e[1]) / (e[2] * v + e[3]), e[4])


def capped_walk(batch: pa.RecordBatch, q: float, sigma2: float, weak_weight: float, cap: float, floor: float, block: int = 4096) -> dict[str, pa.Array]:
    """Whole series (lists _z, _n, _weak) from mean 0 and variance 1, step by step, many at once: lists of mean, variance, gain, capped."""
    lengths = batch["_z"].value_lengths().to_numpy()
    first, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    z, n, weak = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("_z", "_n", "_weak"))
    ok = np.isfinite(z) & (n > 0)
    noise = sigma2 / (np.where(weak, weak_weight, 1.0) * np.maximum(np.where(ok, n, 1.0), 1.0))
    z = np.where(ok, z, 0.0)
    out = {c: np.empty(len(z)) for c in ("mean", "variance", "gain")} | {"capped": np.empty(len(z), bool)}
    for a in range(0, len(order), block):
        rows = order[a:a + block]
        m, v = np.zeros(len(rows)), np.ones(len(rows))
        for k in range(lengths[rows[0]]):
            left = int(np.searchsorted(-lengths[rows], -k))
            at = first[rows[:left]] + k
            ahead, here, used = v[:left] + q, m[:left], ok[at]
            gain = np.where(used, ahead / (ahead + noise[at]), 0.0)
            gap = np.where(used, z[at] - here, 0.0)
            step = np.where(weak[at], np.clip(gap, -cap, cap), gap)
            m[:left] = here + gain * step
            v[:left] = np.where(used, np.maximum((1 - gain) * ahead, floor), ahead)
            out["mean"][at], out["variance"][at], out["gain"][at], out["capped"][at] = m[:left], v[:left], gain, step != gap
    offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    return {c: pa.ListArray.from_arrays(offsets, pa.array(x)) for c, x in out.items()}


# The mean under capped steps is a rising, piecewise linear function of the mean before; (xs, ys) on the reachable interval
def capped_steps(xs: Array, ys: Array, z: float, gain: float, cap: float) -> tuple[Array, Array]:
    """(xs, ys) followed by y + gain * clip(z - y, -cap, cap)."""
    corners = [c for c in (z - cap, z + cap) if ys[0] < c < ys[-1]]
    if corners:
        at = np.interp(corners, ys, xs)
        order = np.searchsorted(xs, at)
        xs, ys = np.insert(xs, order, at), np.insert(ys, order, corners)
    return xs, ys + gain * np.clip(z - ys, -cap, cap)


def thin(xs: Array, ys: Array) -> tuple[Array, Array]:
    """Without points on the line between their neighbours (to rounding)."""
    if ys[-1] - ys[0] <= 1e-15 * max(1.0, abs(ys[0])):
        return xs[[0, -1]], ys[[0, -1]]
    while len(xs) > 2:
        line = ys[:-2] + (ys[2:] - ys[:-2]) * np.divide(xs[1:-1] - xs[:-2], xs[2:] - xs[:-2], out=np.zeros(len(xs) - 2), where=xs[2:] > xs[:-2])
        flat = np.abs(line - ys[1:-1]) <= 1e-15 * np.maximum(1.0, np.abs(ys[1:-1]))
        flat[1::2] = False  # never two neighbours at once
        if not flat.any():
            break
        keep = np.concatenate([[True], ~flat, [True]])
        xs, ys = xs[keep], ys[keep]
    return xs, ys
