"""Ordered operators: running envelopes, decay means, shrinkage, segments, references and movement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plays import flag
from .scan import START, competition_rank, previous, prior_totals, running


def score_envelope(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, score: str, final: str) -> DataFrame:
    """WN-3: the running maximum of a score, never above the final."""
    out = running(df, keys, order, slice_by, {"_top": ("max", F.col(score))})
    return out.withColumn("envelope", F.least(F.col(final), F.col("_top"))).drop("_top")


def regressions(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, score: str) -> DataFrame:
    """WN-4: how often a running score falls, by how much at most, and jumps of more than eight points."""
    out = previous(df, keys, order, slice_by, {"_was": score})
    step = F.col(score) - F.col("_was")
    return out.groupBy(*keys).agg(
        F.count(F.when(step < 0, 1)).alias("drops"), F.coalesce(F.max(-step), F.lit(0)).alias("largest_drop"),
        F.count(F.when(step > 8, 1)).alias("jumps"), F.count("*").alias("rows"))


def position(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, name: str = "position") -> DataFrame:
    """WN-5: place inside the group, from zero."""
    return running(df, keys, order, slice_by, {name: ("count", F.lit(1))}, inclusive=False)


def ewma_prior(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, value: str, alpha: float, name: str) -> DataFrame:
    """WN-6: exponentially weighted mean of strictly earlier rows; null values decay the others too.

    Weights relative to the row are (1-a)^(n-i).  Sums are kept relative to the start of a block
    short enough for the powers to stay in range; the last two blocks that hold values give the carry, older
    ones weigh less than 1e-190 of it.  Before the first value of a block the carry alone is the mean, however long the gap.
    """
    beta = 1 - alpha
    block = max(1, int(-200 / math.log10(beta) / 2))
    p = running(df, keys, order, slice_by, {"_p": ("count", F.lit(1))}, inclusive=False)
    p = p.withColumns({"_b": F.floor(F.col("_p") / block), "_i": F.col("_p") % block})
    lift = F.pow(F.lit(beta), -F.col("_i"))
    x = F.col(value)
    p = p.withColumns({"_s": F.when(x.isNotNull(), x * lift), "_w": F.when(x.isNotNull(), lift)})
    totals = p.groupBy(*keys, "_b").agg(F.sum("_s").alias("_ts"), F.sum("_w").alias("_tw"))
    step = beta**block
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(START, -1)
    held = F.last(F.when(F.col("_tw").isNotNull(), F.struct("_b", "_ts", "_tw")), True).over(before)
    add = lambda c: F.col(c) + F.coalesce(F.col(f"_held.{c}") * F.pow(F.lit(step), F.col("_b") - F.col("_held._b")), F.lit(0.0))
    both = F.when(F.col("_tw").isNotNull(), F.struct(F.col("_b"), add("_ts").alias("_ts"), add("_tw").alias("_tw")))
    totals = totals.withColumn("_held", held).withColumn("_both", both).select(*keys, "_b", F.last("_both", True).over(before).alias("_c"))
    here = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(START, -1)
    out = p.join(totals, [*keys, "_b"])
    fade = F.pow(F.lit(step), F.col("_b") - F.col("_c._b"))
    num, den = F.sum("_s").over(here), F.sum("_w").over(here)
    mixed = (num + F.coalesce(F.col("_c._ts") * fade, F.lit(0.0))) / (den + F.coalesce(F.col("_c._tw") * fade, F.lit(0.0)))
    return out.withColumn(name, F.when(den > 0, mixed).otherwise(F.col("_c._ts") / F.col("_c._tw"))).drop("_p", "_b", "_i", "_s", "_w", "_c")


def ordinal_rank(df: DataFrame, keys: list[str], value: Column, tie: str, name: str = "rank") -> DataFrame:
    """WN-8: one number per row, ties broken by a name: rank of the value, then place among equals."""
    ranked = competition_rank(df, keys, value, "_r")
    inside = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(tie))
    numbered = ranked.where("_r IS NOT NULL").withColumn(name, F.col("_r") + inside - 1)
    return numbered.unionByName(ranked.where("_r IS NULL").withColumn(name, F.col("_r"))).drop("_r")


def tied_flag(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """WN-9: whether another row has the same rank."""
    sizes = df.where(F.col(rank).isNotNull()).groupBy(*keys, rank).agg((F.count("*") > 1).alias("tied"))
    return df.join(sizes, [*keys, rank], "left").withColumn("tied", F.coalesce("tied", F.lit(False)))


def elite_reference(df: DataFrame, keys: list[str], value: str, tie: str, top: int = 25) -> DataFrame:
    """WN-10: mean of the top N; a member is measured against the other N-1 and number N+1."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))
    head = df.where(F.col(value).isNotNull()).select(*keys, tie, value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top + 1)
    sums = head.groupBy(*keys).agg(F.sum(F.when(F.col("_rn") <= top, F.col(value))).alias("_top"), F.sum(value).alias("_more"),
                                   F.count("*").alias("_n"))
    member = head.where(F.col("_rn") <= top).select(*keys, tie, F.lit(True).alias("_in"))
    out = df.join(sums, keys, "left").join(member, [*keys, tie], "left")
    ref = F.when(F.col("_in"), F.try_divide(F.col("_more") - F.col(value), F.col("_n") - 1)).otherwise(
        F.col("_top") / F.least(F.col("_n"), F.lit(top)))
    return out.withColumn("reference", ref).drop("_top", "_more", "_n", "_in")


def cumulative_snapshot(df: DataFrame, keys: list[str], week: str, num: str, den: str) -> DataFrame:
    """WN-12: running sum of the numerator over the running sum of the denominator, by week."""
    per = df.groupBy(*keys, week).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"), F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(week).rowsBetween(START, 0)
    return per.select(*keys, week, F.try_divide(F.sum("_n").over(upto), F.sum("_d").over(upto)).alias("value"),
                      F.sum("_d").over(upto).alias("exposure"), F.sum("_c").over(upto).alias("contributors"))


def half_life_mean(df: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, num: str, den: str, half_life: float) -> DataFrame:
    """WN-13: weights 0.5^(age/h) on numerator and denominator, age in usable games from the latest.

    A row without a numerator or without a positive denominator is not usable and ages no other; a key without usable rows has
    exposure 0 and no value.  Ages come from a two-level count, so a hot key is scanned by many tasks.
    """
    usable = df.withColumn("_u", F.col(num).isNotNull() & (F.coalesce(F.col(den), F.lit(0)) > 0))
    counts = usable.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count_if("_u").alias("games"))
    placed = position(usable.where("_u"), keys, order, slice_by, "_at").alias("p")
    rows = counts.join(placed, [F.col(f"_k_{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], "left")
    w = F.pow(F.lit(0.5), (F.col("games") - 1 - F.col("_at")) / half_life)
    return rows.groupBy(*[F.col(f"_k_{k}").alias(k) for k in keys]).agg(
        F.try_divide(F.sum(F.col(num) * w), F.sum(F.col(den) * w)).alias("value"), F.coalesce(F.sum(F.col(den) * w), F.lit(0.0)).alias("exposure"), F.max("games").alias("games"))


def shrunk_prior(df: DataFrame, keys: list[str], time: str, value: str, equivalent: float, season: str = "season") -> DataFrame:
    """WN-14: (sum + k * prior) / (n + k) over strictly earlier times; prior = the previous season's mean."""
    x = F.col(value)
    so_far = prior_totals(df, [season, *keys], time, {"_s": x, "_n": F.when(x.isNotNull(), 1).otherwise(0)})
    league = df.groupBy(season).agg(F.avg(value).alias("_prior")).withColumn(season, F.col(season) + 1)
    out = so_far.join(league, season, "left")
    prior = F.coalesce("_prior", F.lit(0.0))
    return out.select(season, *keys, time, F.col("_n").alias("games_before"),
                      ((F.col("_s") + equivalent * prior) / (F.col("_n") + equivalent)).alias("shrunk"))


def assign_segments(df: DataFrame, group: list[str], order: list[str], slice_by: Column | str, holder: str, ends: Column,
                    starts: Column, name: str = "drive_number") -> DataFrame:
    """WN-15: a new segment when the holder changes, after an ending row, or at a starting row."""
    marked = df.withColumn("_ends", flag(ends))
    seen = previous(marked, group, order, slice_by, {"_was": holder, "_ended": "_ends"})
    new = F.col("_was").isNull() | (F.col("_was") != F.col(holder)) | (F.col("_ended") == 1) | starts
    seen = seen.withColumn("_new", flag(new))
    return running(seen, group, order, slice_by, {name: ("sum", F.col("_new"))}).drop("_ends", "_was", "_ended", "_new")


def unresolved_order(df: DataFrame, sequence: list[str], period: str) -> DataFrame:
    """WN-16: rows whose place is not known: several rows share the sequence, or there is no period."""
    ties = df.groupBy(*sequence).agg(F.count("*").alias("_n"))
    out = df.join(ties, sequence, "left")
    reason = F.when(F.col(period).isNull(), "missing_period").when(F.col("_n") > 1, "tied_sequence")
    return out.withColumns({"order_reason": reason, "order_unresolved": reason.isNotNull()}).drop("_n")


def movement(df: DataFrame, keys: list[str], period: str, columns: list[str]) -> DataFrame:
    """WN-18: change of each column against the period before."""
    w = Window.partitionBy(*keys).orderBy(period)
    return df.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(w) for c in columns})


def order_violations(df: DataFrame, group: list[str], slice_by: Column | str, orders: dict[str, list[str]], period: str, clock: str) -> DataFrame:
    """WN-19: per ordering rule, pairs where the period goes back or the clock goes up inside a period."""
    parts = []
    for label, order in orders.items():
        seen = previous(df, group, order, slice_by, {"_p": period, "_c": clock})
        back = F.col(period) < F.col("_p")
        up = (F.col(period) == F.col("_p")) & (F.col(clock) > F.col("_c"))
        parts.append(seen.groupBy(*group).agg(F.count(F.when(back, 1)).alias("period_back"), F.count(F.when(up, 1)).alias("clock_up"))
                     .withColumn("rule", F.lit(label)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_inclusion(games: DataFrame, hours: int = 6) -> DataFrame:
    """WN-21: the first later-week game at which a source game is evidence.

    Only distinct (week, kickoff) slots are compared, never games.  A later week that starts after the
    source is available gives its first kickoff, so most of the work is on the week table; slots are
    looked into only for weeks that straddle the availability time.
    """
    slots = games.groupBy("season", "week", "kickoff").agg(F.min("game_id").alias("game_id"))
    weeks = slots.groupBy("season", "week").agg(F.min("kickoff").alias("_first"), F.max("kickoff").alias("_last"))
    src = slots.select("season", F.col("week").alias("_w"), F.col("kickoff").alias("_k"))
    src = src.withColumn("_at", F.col("_k") + F.expr(f"INTERVAL {hours} HOURS"))
    later = src.join(weeks, "season").where((F.col("week") > F.col("_w")) & (F.col("_last") >= F.col("_at")))
    whole = F.col("_first") >= F.col("_at")
    best = later.groupBy("season", "_w", "_k", "_at").agg(
        F.min(F.when(whole, F.col("_first"))).alias("_b"), F.collect_set(F.when(~whole, F.col("week"))).alias("_open"))
    # weeks that overlap the availability time are at most a few, bounded by the calendar
    inside = best.select("season", "_w", "_k", "_at", F.explode("_open").alias("week")).join(slots, ["season", "week"]).where(
        F.col("kickoff") >= F.col("_at")).groupBy("season", "_w", "_k").agg(F.min("kickoff").alias("_i"))
    best = best.join(inside, ["season", "_w", "_k"], "left").select(
        "season", "_w", "_k", F.least("_b", "_i").alias("boundary_kickoff")).where("boundary_kickoff IS NOT NULL")
    owner = best.join(slots.withColumnRenamed("kickoff", "boundary_kickoff"), ["season", "boundary_kickoff"]).where(
        F.col("week") > F.col("_w")).groupBy("season", "_w", "_k", "boundary_kickoff").agg(F.min("game_id").alias("boundary_game_id"))
    out = games.select("season", "game_id", F.col("week").alias("_w"), F.col("kickoff").alias("_k")).join(owner, ["season", "_w", "_k"], "left")
    return out.select("season", "game_id", "boundary_game_id", "boundary_kickoff")
