"""Ordered running values and ranks that do not put a whole key into one task.

A key may hold a large part of all rows, so running values are computed in two levels: rows are
cut into slices (a time slice, or a value slice for ranks), each slice is scanned on its own, and
the slice totals -- a few per key -- give the carry each slice starts from.  Only the slice table
is ever windowed by the bare key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

START = Window.unboundedPreceding
LONG = 1 << 18


def apart(df: DataFrame, keys: list[str], long: int | None = None) -> list[tuple[DataFrame, bool]]:
    """The rows of keys that one task can scan, with False, and, where there are any, those of longer keys, with True.

    Slices cost a second shuffle and rows of their own, which only a key of more than ``long`` rows is worth.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (long or LONG)).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    if not hot.limit(1).count():
        return [(df, False)]
    hot = stage_table(hot)  # at most one row per ``long`` rows; its size is known to the planner
    on = [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys]
    return [(df.join(hot, on, "left_anti"), False), (df.join(hot, on, "left_semi"), True)]


def running(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str,
            specs: dict[str, tuple[str, Column]], inclusive: bool = True, materialize: bool = False, sliced: bool = True) -> DataFrame:
    """Running sum/count/max/min/last of each column over ``order`` inside ``keys``.

    ``slice_by`` (a column or SQL text) must not decrease along ``order``.  ``last`` is the last non-null value.
    ``inclusive=False`` leaves the current row out.  The input is read twice (totals and rows), so
    chains of several scans set ``materialize`` to write an expensive input once.  What a slice starts from
    is a row in front of its rows, so rows are shuffled and sorted once and not joined.  With ``sliced=False`` (short keys, see
    :func:`apart`) a key is one window, and scans by the same keys follow each other without a shuffle.
    """
    if not sliced:
        here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(START, 0 if inclusive else -1)
        whole = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, True)}
        return df.withColumns({n: whole[op](c).over(here) for n, (op, c) in specs.items()})
    slice_by = F.expr(slice_by) if isinstance(slice_by, str) else slice_by
    base = df.withColumns({"_slice": slice_by, **{f"_x_{n}": c for n, (_, c) in specs.items()}})
    base = stage_table(base) if materialize else base
    base = base.withColumns({f"_x_{n}": F.col(f"_x_{n}").isNotNull().cast("long") for n, (op, _) in specs.items() if op == "count"})
    window = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    position, total = F.struct(*order), []
    for name, (op, _) in specs.items():
        x = F.col(f"_x_{name}")
        total.append((F.max_by(x, F.when(x.isNotNull(), position)) if op == "last" else window[op](x)).alias(f"_x_{name}"))
    slices = base.groupBy(*keys, "_slice").agg(*total)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(START, -1)
    carry = slices.select(*keys, "_slice", *[(F.last(f"_x_{n}", True) if op == "last" else window[op](f"_x_{n}")).over(before).alias(f"_x_{n}") for n, (op, _) in specs.items()])
    known = set(carry.columns)
    carry = carry.select(*[F.col(f"`{c}`") if c in known else F.lit(None).cast(t).alias(c) for c, t in base.dtypes], F.lit(False).alias("_is_row"))
    here = Window.partitionBy(*keys, "_slice").orderBy("_is_row", *order).rowsBetween(START, 0 if inclusive else -1)
    out = {}
    for name, (op, _) in specs.items():
        x = F.col(f"_x_{name}")
        value = F.last(x, True).over(here) if op == "last" else window[op](x).over(here)
        out[name] = F.coalesce(value, F.lit(0)) if op == "count" else value
    return base.withColumn("_is_row", F.lit(True)).union(carry).withColumns(out).where("_is_row").drop("_slice", "_is_row", *[f"_x_{n}" for n in specs])


def previous(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, columns: dict[str, str],
             materialize: bool = False, sliced: bool = True) -> DataFrame:
    """The value of the row before, as a struct-carried running ``last`` (null values included)."""
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    out = running(df, keys, order, slice_by, {"_previous_row": ("last", row)}, inclusive=False, materialize=materialize, sliced=sliced)
    return out.withColumns({n: F.col(f"_previous_row.{n}") for n in columns}).drop("_previous_row")


def prior_totals(df: DataFrame, keys: list[str], time: str, sums: dict[str, Column]) -> DataFrame:
    """Totals over rows strictly before each distinct time of a key; rows at the same time never count.

    Rows are first summed per (key, time), so the window sees one row per distinct time.
    """
    points = df.groupBy(*keys, time).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(START, -1)
    return points.select(*keys, time, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def competition_rank(df: DataFrame, keys: list[str], value: Column, name: str = "rank", slices: int = 64,
                     cohort: str | None = None) -> DataFrame:
    """WN-7: rank 1 for the highest value, ties share the lowest rank, null values get none.

    Value slices come from approximate percentiles of each key; rank = rows in higher slices plus
    the rank inside the slice.  Equal values always fall into the same slice, so ties stay exact.
    Approximate percentiles and sums of doubles depend on the order rows arrive in, so the rows and the
    slice bounds are written once: counts and rows must be cut at the same places.
    """
    cuts = [i / slices for i in range(1, slices)]
    base = stage_table(df.withColumn("_v", value.cast("double")))
    bounds = stage_table(base.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*map(F.lit, cuts)), 1000).alias("_cuts")))
    cut = base.join(bounds, keys, "left").withColumn(
        "_slice", F.when(F.col("_v").isNotNull(), F.size(F.filter("_cuts", lambda b: b >= F.col("_v")))))
    totals = cut.where("_v IS NOT NULL").groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    per_key = Window.partitionBy(*keys)
    carry = totals.select(*keys, "_slice",
                          F.coalesce(F.sum("_n").over(per_key.orderBy("_slice").rowsBetween(START, -1)), F.lit(0)).alias("_above"),
                          F.sum("_n").over(per_key).alias("_size"))
    out = cut.join(carry, [*keys, "_slice"], "left")
    local = F.rank().over(Window.partitionBy(*keys, "_slice").orderBy(F.col("_v").desc()))
    out = out.withColumn(name, F.when(F.col("_v").isNotNull(), F.col("_above") + local))
    if cohort:
        out = out.withColumn(cohort, F.when(F.col("_v").isNotNull(), F.col("_size")))
    return out.drop("_v", "_cuts", "_slice", "_above", "_size")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], name: str = "edges", slices: int = 64) -> DataFrame:
    """Exact linear-interpolated quantiles per key, as an array in the order of ``probabilities``.

    The built-in exact percentile keeps every distinct value of a key in one task.  Here values are cut
    into slices at approximate percentiles and counted; only the slices that hold a wanted rank are
    looked into, and they are windowed by (key, slice).  Rows and bounds are written once, as for the ranks.
    """
    cuts = [i / slices for i in range(1, slices)]
    base = stage_table(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    bounds = stage_table(base.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*map(F.lit, cuts)), 1000).alias("_cuts")))
    cut = base.join(bounds, keys).withColumn("_slice", F.size(F.filter("_cuts", lambda b: b < F.col("_v")))).drop("_cuts")
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    counts = counts.select(*keys, "_slice", "_n", F.coalesce(F.sum("_n").over(w.orderBy("_slice").rowsBetween(START, -1)), F.lit(0)).alias("_below"),
                           F.sum("_n").over(w).alias("_total"))
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("_h")) for i, p in enumerate(probabilities)])
    wanted = counts.select("*", F.inline(ranks)).select("*", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_rank")).where(
        (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
    inside = cut.join(wanted.select(*keys, "_slice").distinct(), [*keys, "_slice"], "left_semi").withColumn(
        "_p", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_v")) - 1)
    hit = wanted.withColumn("_p", F.col("_rank") - F.col("_below")).join(inside, [*keys, "_slice", "_p"])
    per = hit.groupBy(*keys, "_i", "_h").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda x: x["q"]).alias(name))
