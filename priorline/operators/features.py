"""Feature blocks: situational, weather, site, preseason and matchup frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .joins import sides


def matchup_frame(games: DataFrame, team_side: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """FE-2/3/8: the home and away columns of a (game, team) table on one row per game."""
    out = games
    for side in ("home", "away"):
        right = team_side.select("game_id", F.col("team").alias(side), *[F.col(c).alias(f"{side}_{prefix}{c}") for c in columns])
        out = out.join(right, ["game_id", side], "left")
    return out


def attach_baseline(matchups: DataFrame, baseline: DataFrame, seasons: list[int]) -> DataFrame:
    """FE-4: baseline predictions; required seasons must be covered, or the job fails."""
    from .guards import unique_lookup, unless
    b = unique_lookup(baseline.select("game_id", F.col("prediction").alias("baseline")), ["game_id"])
    out = matchups.join(b, "game_id", "left")
    needed = F.col("season").isin(seasons) & F.col("baseline").isNull()
    return out.withColumn("baseline", unless(needed, F.col("baseline"), "baseline does not cover a required season"))


def situational(sides_df: DataFrame, venues: DataFrame) -> DataFrame:
    """FE-5: rest days, travel, zone and altitude differences, fatigue; missing venues are flagged, not dropped.

    ``sides_df``: season, team, game_id, kickoff, venue_id, home_venue_id, neutral.
    """
    slots = sides_df.select("season", "team", "kickoff").distinct()
    rest = slots.withColumn("_last", F.lag("kickoff").over(Window.partitionBy("season", "team").orderBy("kickoff")))
    v = lambda p: venues.select(F.col("venue_id").alias(f"{p}venue_id"), *[F.col(c).alias(f"_{p}{c}") for c in ("lat", "lon", "zone", "elevation", "dome")])
    out = sides_df.join(rest, ["season", "team", "kickoff"], "left").join(v(""), "venue_id", "left").join(v("home_"), "home_venue_id", "left")
    km = F.when(F.col("venue_id") == F.col("home_venue_id"), F.lit(0.0)).otherwise(
        geo.distance_km(F.col("_home_lat"), F.col("_home_lon"), F.col("_lat"), F.col("_lon")))
    zone = geo.offset_hours(F.col("kickoff"), F.col("_zone")) - geo.offset_hours(F.col("kickoff"), F.col("_home_zone"))
    out = out.withColumns({"rest_days": F.datediff("kickoff", "_last"), "_km": km, "tz_diff": F.coalesce(zone, F.lit(0.0)),
                           "altitude_diff": F.coalesce(F.col("_elevation") - F.col("_home_elevation"), F.lit(0.0)), "dome": F.coalesce("_dome", F.lit(False))})
    return out.select("season", "team", "game_id", "neutral", "rest_days", F.col("_km").isNull().alias("travel_missing"),
                      F.coalesce("_km", F.lit(0.0)).alias("travel_km"), "tz_diff", "altitude_diff", "dome").withColumn(
        "fatigue", F.col("travel_km") / (F.coalesce("rest_days", F.lit(7)) + 1))


def weather(team_games: DataFrame, observations: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """FE-6: one weather row per game on both teams; defaults with a missing flag."""
    from .guards import unique_lookup
    w = unique_lookup(observations.select("game_id", *defaults), ["game_id"])
    out = team_games.join(w.withColumn("_seen", F.lit(True)), "game_id", "left")
    flags = {f"{c}_missing": F.col(c).isNull() for c in defaults}
    return out.withColumns(flags).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}).drop("_seen")


def assemble(universe: DataFrame, blocks: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """FE-7: left joins of feature blocks on the universe; each block says where it has no row."""
    out = universe
    for name, block in blocks.items():
        out = out.join(block.withColumn(f"{name}_present", F.lit(True)), keys, "left").withColumn(
            f"{name}_present", F.coalesce(f"{name}_present", F.lit(False)))
    return out


def non_offense_totals(sides_df: DataFrame, events: DataFrame, usable: Column) -> DataFrame:
    """FE-9: points per (game, team) not scored by the offense; usable games without any count zero,
    games with an unresolved event are unusable."""
    e = events.groupBy("game_id", "team").agg(
        F.sum(F.when(F.col("category") == "non_offense", F.col("points")).otherwise(0)).alias("_p"), F.bool_or(F.col("category") == "unresolved").alias("_u"))
    bad = e.groupBy("game_id").agg(F.bool_or("_u").alias("_bad"))
    out = sides_df.join(e, ["game_id", "team"], "left").join(bad, "game_id", "left")
    ok = usable & ~F.coalesce("_bad", F.lit(False))
    return out.withColumns({"usable": ok, "non_offense_points": F.when(ok, F.coalesce("_p", F.lit(0)))}).drop("_p", "_u", "_bad")


def add_families(frame: DataFrame, families: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """FE-10: nested variants: base, base+first family, ...; with the share of rows the family covers."""
    out, parts, names = frame, [], []
    parts.append((["base"], frame, []))
    for name, (block, cols) in families.items():
        out = out.join(block.select(key, *cols), key, "left")
        names = [*names, *cols]
        parts.append(([name], out, cols))
    rows = [p.agg(F.lit("+".join(label)).alias("family"), F.count("*").alias("rows"), *([F.avg(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]).cast("int")).alias("coverage")]
            if cols else [F.lit(1.0).alias("coverage")])) for label, p, cols in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)


def home_venues(hosting: DataFrame, minimum: int = 3) -> DataFrame:
    """FE-11: venues a team hosted at least ``minimum`` times in a season, else its most used one."""
    n = hosting.groupBy("season", "team", "venue_id").agg(F.count("*").alias("games"))
    top = n.groupBy("season", "team").agg(F.max_by("venue_id", F.struct("games", -F.col("venue_id"))).alias("_modal"))
    return n.join(top, ["season", "team"]).where((F.col("games") >= minimum) | (F.col("venue_id") == F.col("_modal"))).drop("_modal")


def venue_class(games: DataFrame, homes: DataFrame) -> DataFrame:
    h = homes.select("season", F.col("team").alias("home"), "venue_id", F.lit(True).alias("_own"))
    out = games.join(h, ["season", "home", "venue_id"], "left")
    return out.withColumn("venue_class", F.when(F.col("neutral"), "neutral").when(F.col("_own"), "home_venue").otherwise("other_not_neutral")).drop("_own")
