"""Win probabilities, strength of schedule and strength of record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf
from .joins import sides
from .windows import ordinal_rank


def at_least_wins(probabilities: Column, wins: Column) -> Column:
    """IT-27: exact P(at least ``wins``) for independent games: one convolution step per game.

    The array holds one team's schedule, which the calendar bounds.
    """
    start = F.array(F.lit(1.0))
    step = lambda acc, p: F.zip_with(F.concat(F.transform(acc, lambda v: v * (1 - p)), F.array(F.lit(0.0))),
                                     F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda v: v * p)), lambda a, b: a + b)
    mass = F.aggregate(probabilities, start, step)
    tail = F.aggregate(F.slice(mass, wins + 1, F.greatest(F.size(mass) - wins, F.lit(0))), F.lit(0.0), lambda a, v: a + v)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))


def win_probability(bridge: dict[str, float], is_home: Column, off: Column, dfn: Column, opp_off: Column, opp_def: Column) -> Column:
    """Chance that the reference beats the opponent in its home or away slot."""
    pick = lambda a, b: F.when(is_home, a).otherwise(b)
    margin = (bridge["intercept"] + bridge["home_offense"] * pick(off, opp_off) + bridge["home_defense"] * pick(dfn, opp_def)
              + bridge["away_offense"] * pick(opp_off, off) + bridge["away_defense"] * pick(opp_def, dfn))
    return normal_cdf(F.when(is_home, margin).otherwise(-margin) / bridge["sigma"])


def elite_vectors(ratings: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Per team the mean rating vector of the elite reference (never itself) and of all teams."""
    w = Window.partitionBy(*keys).orderBy(F.col("overall").desc(), "team")
    head = ratings.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top + 1)
    s = lambda c, n: F.sum(F.when(F.col("_rn") <= n, F.col(c)))
    sums = head.groupBy(*keys).agg(F.count("*").alias("_n"), *[x.alias(f"_{c}_{n}") for c in ("off", "dfn") for n, x in (
        ("top", s(c, top)), ("more", s(c, top + 1)))])
    member = head.where(F.col("_rn") <= top).select(*keys, "team", F.lit(True).alias("_in"))
    whole = ratings.groupBy(*keys).agg(F.avg("off").alias("avg_off"), F.avg("dfn").alias("avg_dfn"), F.count("*").alias("teams"))
    out = ratings.join(sums, keys).join(member, [*keys, "team"], "left").join(whole, keys)
    for c in ("off", "dfn"):
        out = out.withColumn(f"elite_{c}", F.when(F.col("_in"), F.try_divide(F.col(f"_{c}_more") - F.col(c), F.col("_n") - 1)).otherwise(
            F.col(f"_{c}_top") / F.least(F.col("_n"), F.lit(top))))
    return out.select(*keys, "team", "overall", "off", "dfn", "elite_off", "elite_dfn", "avg_off", "avg_dfn", "teams")


def team_resume(ratings: DataFrame, games: DataFrame, bridge: dict[str, float], top: int = 25, min_games: int = 3) -> DataFrame:
    """IT-28: schedule strength against the elite and the average reference, strength of record, wins
    above average.  ``ratings``: season, period_id, cutoff, team, off, dfn, overall.  All periods at once.
    """
    keys = ["season", "period_id", "cutoff"]
    ref = elite_vectors(ratings, keys, top)
    s = sides(games, ["season", "game_id", "kickoff", "completed"], {
        "team": ("home", "away"), "opponent": ("away", "home"), "pf": ("home_points", "away_points"), "pa": ("away_points", "home_points")})
    opp = ratings.select(*keys, F.col("team").alias("opponent"), F.col("off").alias("opp_off"), F.col("dfn").alias("opp_dfn"))
    g = ref.join(s, ["season", "team"]).join(opp, [*keys, "opponent"])
    home = F.col("side") == "home"
    for kind in ("elite", "avg"):
        g = g.withColumn(f"p_{kind}", win_probability(bridge, home, F.col(f"{kind}_off"), F.col(f"{kind}_dfn"), F.col("opp_off"), F.col("opp_dfn")))
    g = g.withColumns({"_done": F.col("completed") & (F.col("kickoff") <= F.col("cutoff")), "_left": F.col("kickoff") > F.col("cutoff")})
    sos = lambda p, cond: 100 * F.avg(F.when(cond, 1 - F.col(p)))
    yes = F.lit(True)
    out = g.groupBy(*keys, "team", "overall").agg(
        F.count("*").alias("scheduled"), F.count(F.when(F.col("_done"), 1)).alias("played"),
        F.count(F.when(F.col("_done") & (F.col("pf") > F.col("pa")), 1)).alias("wins"),
        *[sos(f"p_{k}", c).alias(f"sos_{n}_{k}") for k in ("elite", "avg") for n, c in (("played", F.col("_done")), ("remaining", F.col("_left")), ("full", yes))],
        F.collect_list(F.when(F.col("_done"), F.col("p_elite"))).alias("_ps"), F.sum(F.when(F.col("_done"), F.col("p_avg"))).alias("_exp"))
    ok = F.col("played") >= min_games
    out = out.withColumns({"sor_p": F.when(ok, at_least_wins(F.array_sort("_ps"), F.col("wins").cast("int"))),
                           "waa": F.when(ok, F.col("wins") - F.col("_exp"))}).drop("_ps", "_exp")
    return out.withColumn("sor", F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("sor_p")) * 100)))


def with_ranks(resume: DataFrame, keys: list[str]) -> DataFrame:
    """WN-8 on the résumé: strength of record, ties by overall rating and then by name."""
    r = ordinal_rank(resume.withColumn("_tie", F.struct(-F.col("overall"), "team")), keys, F.round("sor", 9), "_tie", "sor_rank")
    return r.drop("_tie")
