"""Roll-ups: play to drive, team-game, team-season; and the other grouped tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plays as P
from ..functions import playtypes as T
from .joins import next_start
from .scan import exact_quantiles

ratio1 = lambda num, den: num / F.when(den > 0, den).otherwise(F.lit(1))  # zero denominators count as one


def _drive_outcomes(df: DataFrame) -> DataFrame:
    per_play = ratio1(F.col("drive_yards"), F.col("drive_plays"))
    return df.withColumns({
        "is_successful_drive": P.flag(F.col("points") > 0), "is_busted_drive": P.flag(F.col("turnovers") > 0),
        "is_explosive_drive": P.flag(per_play > 10),
        "points_on_opps": F.when(F.col("had_scoring_opportunity") == 1, F.col("points")).otherwise(0)})


def drives(plays: DataFrame, order: list[str]) -> DataFrame:
    """AG-1: play to drive by the displayed drive number."""
    at = F.struct(*order)
    ytg = F.col("yards_to_goal")
    known = F.when(ytg.isNotNull(), at)
    out = plays.groupBy("game_id", "drive_number", "offense", "defense").agg(
        F.sum("is_drive_play").alias("drive_plays"), F.sum("yards").alias("drive_yards"),
        F.min("quarter").alias("drive_start_period"), F.max("quarter").alias("drive_end_period"),
        F.min_by(ytg, known).alias("start_yards_to_goal"), F.max_by(ytg, known).alias("end_yards_to_goal"),
        F.max("eckel").alias("had_scoring_opportunity"), F.sum("scoring").alias("points"), F.sum("turnover").alias("turnovers"))
    return _drive_outcomes(out)


def provider_drives(plays: DataFrame, sequence: list[str]) -> DataFrame:
    """AG-2: play to drive by drive id; an edge is unknown where tied edge plays disagree.

    Plays tied on the sequence are folded first (low and high field position), so the edge test is
    part of the same aggregation.
    """
    keys = ["game_id", "drive_id", "offense", "defense"]
    points = plays.groupBy(*keys, *sequence).agg(
        F.min("yards_to_goal").alias("lo"), F.max("yards_to_goal").alias("hi"), F.sum("is_drive_play").alias("n"),
        F.sum("yards").alias("y"), F.max("eckel").alias("eckel"), F.sum("scoring").alias("p"), F.sum("turnover").alias("t"))
    edge = F.struct(*sequence)
    out = points.groupBy(*keys).agg(
        F.sum("n").alias("drive_plays"), F.sum("y").alias("drive_yards"),
        F.min_by(F.struct("lo", "hi"), edge).alias("_first"), F.max_by(F.struct("lo", "hi"), edge).alias("_last"),
        F.max("eckel").alias("had_scoring_opportunity"), F.sum("p").alias("points"), F.sum("t").alias("turnovers"))
    same = lambda e: F.when(F.col(f"{e}.lo") == F.col(f"{e}.hi"), F.col(f"{e}.lo"))
    return _drive_outcomes(out.withColumns({"start_yards_to_goal": same("_first"), "end_yards_to_goal": same("_last")})
                           .drop("_first", "_last"))


def present(df: DataFrame, wanted: dict[str, tuple[list[str], Column]]) -> list[Column]:
    """AG-5: the aggregates whose input columns exist."""
    return [c.alias(n) for n, (needs, c) in wanted.items() if set(needs) <= set(df.columns)]


def _when_mean(value: str, condition: str) -> Column:
    return F.avg(F.when(F.expr(condition), F.col(value)))


def _rate(condition: str) -> Column:
    return F.avg(F.coalesce(F.expr(f"CAST({condition} AS INT)"), F.lit(0)))


def _role_columns(df: DataFrame, p: str) -> list[Column]:
    s = lambda c: F.sum(c)
    base = [
        F.count("play_number").alias(f"n_{p}_plays"), s("rush_attempt").alias(f"{p}_n_rush"), s("pass_attempt").alias(f"{p}_n_pass"),
        F.avg("success").alias(f"{p}_sr"), F.avg("yards").alias(f"{p}_ypp"), F.avg("ppa").alias(f"{p}_epa_pp"),
        ratio1(F.sum(F.when(F.col("rush_attempt") == 1, F.col("yards")).otherwise(0.0)), s("rush_attempt")).alias(f"{p}_rush_ypp"),
        ratio1(F.sum(F.when(F.col("pass_attempt") == 1, F.col("yards")).otherwise(0.0)), s("pass_attempt")).alias(f"{p}_pass_ypp"),
        *[_rate(f"yards >= {k}").alias(f"{p}_expl_rate_overall_{k}") for k in (10, 20, 30)],
        _rate("rush_attempt = 1 AND yards >= 15").alias(f"{p}_expl_rate_rush"),
        _rate("pass_attempt = 1 AND yards >= 20").alias(f"{p}_expl_rate_pass"),
        _rate("rush_attempt = 1 AND yards <= 0").alias(f"{p}_stuff_rate"), F.avg("havoc").alias(f"{p}_havoc_rate"),
        F.avg("line_yards").alias(f"{p}_avg_line_yards"), F.avg("second_level_yards").alias(f"{p}_avg_second_level_yards"),
        F.avg("open_field_yards").alias(f"{p}_avg_open_field_yards"),
        ratio1(F.sum(F.col("power_success_converted").cast("int")), F.sum(F.col("is_power_situation").cast("int"))).alias(f"{p}_power_success_rate"),
        F.avg("thirddown_conversion").alias(f"{p}_third_down_conversion_rate"),
    ]
    optional = present(df, {
        f"{p}_turnover_rate": (["turnover"], F.avg("turnover")),
        f"{p}_fumble_rate": (["fumble_turnover"], F.avg("fumble_turnover")),
        f"{p}_interception_rate": (["interception_turnover"], F.avg("interception_turnover")),
        f"{p}_penalty_rate": (["penalty"], F.avg("penalty")),
        f"{p}_sack_rate": (["sack", "dropback"], ratio1(s("sack"), s("dropback"))),
        f"{p}_fourth_down_conversion_rate": (["fourthdown_conversion"], F.avg("fourthdown_conversion")),
        f"{p}_fourth_down_attempt_rate": (["down"], ratio1(F.sum(F.expr("CAST(down = 4 AS INT)")), F.count("play_number"))),
        f"{p}_red_zone_sr": (["red_zone"], _when_mean("success", "red_zone = 1")),
        f"{p}_non_garbage_sr": (["garbage"], _when_mean("success", "garbage = 0")),
        f"{p}_non_garbage_epa": (["garbage"], _when_mean("ppa", "garbage = 0")),
        f"{p}_fourth_quarter_sr": (["fourth_quarter"], _when_mean("success", "fourth_quarter = 1")),
        f"{p}_close_game_sr": (["close_game"], _when_mean("success", "close_game = 1")),
        f"{p}_td_rate": (["td_play"], F.avg("td_play")),
        f"{p}_40_plus_yard_rate": (["big_play_40"], F.avg("big_play_40")),
    })
    return base + optional


def _drive_columns(p: str) -> list[Column]:
    return [F.count("*").alias(f"{p}_drives"), F.avg("is_successful_drive").alias(f"{p}_successful_drive_rate"),
            F.avg("is_busted_drive").alias(f"{p}_busted_drive_rate"), F.avg("is_explosive_drive").alias(f"{p}_explosive_drive_rate"),
            ratio1(F.sum("points_on_opps"), F.sum("had_scoring_opportunity")).alias(f"{p}_points_per_opportunity")]


def team_game(plays: DataFrame, drive_rows: DataFrame) -> DataFrame:
    """AG-3: offense and defense rates per (game, team), with drive rates joined."""
    out = None
    for p, column in (("off", "offense"), ("def", "defense")):
        keys = ["season", "week", "game_id"]
        part = plays.groupBy(*keys, F.col(column).alias("team")).agg(*_role_columns(plays, p))
        rate = drive_rows.groupBy("game_id", F.col(column).alias("team")).agg(*_drive_columns(p))
        part = part.join(rate, ["game_id", "team"], "left")
        out = part if out is None else out.join(part, [*keys, "team"], "full_outer")
    return out


def special_teams(plays: DataFrame, drive_rows: DataFrame) -> DataFrame:
    """AG-4: net punt yards and field goals by distance, pivoted."""
    after = next_start(drive_rows, "game_id", "drive_number", "start_yards_to_goal")
    st = plays.join(after, ["game_id", "drive_number"], "left").withColumns({
        "net_punt": F.when(F.col("st_punt") == 1, F.col("yards_to_goal") - (100 - F.col("next_start"))),
        "bucket": F.when(F.col("st_fg") == 1, P.right_closed_bin("kick_distance", *P.FG_DISTANCE))})
    st = st.where("st_punt = 1 OR st_fg = 1")
    labels = P.FG_DISTANCE[1]
    tried = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    made = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("is_fg_made")).otherwise(0))
    return st.groupBy("game_id", F.col("offense").alias("team")).agg(
        F.avg("net_punt").alias("avg_net_punt_yards"),
        *[x for b in labels for x in (tried(b).alias(f"fg_attempts_{b}"), made(b).alias(f"fg_made_{b}"),
                                      ratio1(made(b), tried(b)).alias(f"fg_rate_{b}"))])


def recency_season(games: DataFrame, keys: list[str], order: list[str], metrics: list[str]) -> DataFrame:
    """AG-6 / WN-11: weights 4, 3, 2, 1 on the last four games, 1 before; a null value counts zero but
    keeps its weight.  The extra weight only concerns the last three games, so a top-3 window (cut
    before the shuffle) and a plain aggregation replace a window over every game."""
    whole = games.groupBy(*keys).agg(F.count("*").alias("games_played"), *[F.sum(m).alias(f"_s_{m}") for m in metrics])
    recent = games.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))).where("_rn <= 3")
    rn, extra = F.col("_rn"), 4 - F.col("_rn")
    tail = recent.groupBy(*keys).agg(
        F.sum(extra).alias("_w"), *[F.sum(F.col(m) * extra).alias(f"_x_{m}") for m in metrics],
        *[F.avg(F.when(rn <= k, F.col(m))).alias(f"{m}_last_{k}") for m in metrics for k in (1, 2, 3)])
    both = whole.join(tail, keys)
    value = lambda m: (F.coalesce(f"_s_{m}", F.lit(0.0)) + F.coalesce(f"_x_{m}", F.lit(0.0))) / (F.col("games_played") + F.col("_w"))
    return both.select(*keys, "games_played", *[value(m).alias(m) for m in metrics],
                       *[f"{m}_last_{k}" for m in metrics for k in (1, 2, 3)])


def luck(plays: DataFrame) -> DataFrame:
    """AG-7: turnovers gained minus lost per team-game."""
    lost = plays.groupBy("season", "week", "game_id", "offense", "defense").agg(F.sum("turnover").alias("n"))
    both = lost.select("season", "week", "game_id", F.inline(F.array(
        F.struct(F.col("offense").alias("team"), (-F.col("n")).alias("luck")),
        F.struct(F.col("defense").alias("team"), F.col("n").alias("luck")))))
    return both.groupBy("season", "week", "game_id", "team").agg(F.sum("luck").alias("luck"))


def ratio_with_exclusions(rows: DataFrame, keys: list[str], num: str, den: str, excluded_reason: Column, event: str) -> DataFrame:
    """AG-9: ratio of sums over admitted rows; how many events were left out, and why."""
    r = rows.withColumn("_why", excluded_reason)
    ok = F.col("_why").isNull()
    return r.groupBy(*keys).agg(
        F.sum(F.when(ok, F.col(num))).alias("numerator"), F.sum(F.when(ok, F.col(den))).alias("denominator"),
        F.count(F.when(ok, 1)).alias("games_counted"), F.count("_why").alias("games_excluded")).withColumn(
        "value", F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator")))


def exclusion_list(rows: DataFrame, keys: list[str], excluded_reason: Column, event: str) -> DataFrame:
    """AG-9: one row for every excluded event, with its reason."""
    return rows.select(*keys, event, excluded_reason.alias("reason")).where("reason IS NOT NULL")


def mirrored_sums(plays: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """AG-10/11: sums per (event, team) with the opponent's beside them."""
    pair = plays.groupBy(*keys, "offense", "defense").agg(*[c.alias(n) for n, c in sums.items()])
    own = [F.when(F.col("side") == "o", F.col(n)).alias(f"off_{n}") for n in sums]
    opp = [F.when(F.col("side") == "d", F.col(n)).alias(f"def_{n}") for n in sums]
    two = pair.select(*keys, *sums, F.inline(F.array(
        F.struct(F.col("offense").alias("team"), F.col("defense").alias("opponent"), F.lit("o").alias("side")),
        F.struct(F.col("defense").alias("team"), F.col("offense").alias("opponent"), F.lit("d").alias("side")))))
    named = two.select(*keys, "team", "opponent", *own, *opp)
    return named.groupBy(*keys, "team", "opponent").agg(*[F.sum(f"{s}_{n}").alias(f"{s}_{n}") for n in sums for s in ("off", "def")])


def stream_points(plays: DataFrame) -> DataFrame:
    """AG-12: each team's largest running score over both roles."""
    roles = plays.select("game_id", F.inline(F.array(
        F.struct(F.col("offense").alias("team"), F.col("offense_score").alias("score")),
        F.struct(F.col("defense").alias("team"), F.col("defense_score").alias("score")))))
    return roles.groupBy("game_id", "team").agg(F.max("score").alias("points"))


def weighted_center(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """AG-18: exposure-weighted mean."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("center"))


def earlier_scale(values: DataFrame, targets: DataFrame, keys: list[str], value: str, floor: float = 1e-6) -> DataFrame:
    """AG-17: mean and population sd of the latest earlier season, (0, 1) where there is none."""
    per = values.groupBy(*keys, F.col("season").alias("source_season")).agg(
        F.avg(value).alias("center"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("scale"))
    t = targets.select("season").distinct()
    near = t.join(per, F.col("source_season") < F.col("season")).groupBy("season", *keys).agg(
        F.max_by(F.struct("source_season", "center", "scale"), "source_season").alias("s"))
    grid = t.join(per.select(*keys).distinct())
    out = grid.join(near, ["season", *keys], "left")
    return out.select("season", *keys, F.col("s.source_season").alias("source_season"),
                      F.coalesce("s.center", F.lit(0.0)).alias("center"), F.coalesce("s.scale", F.lit(1.0)).alias("scale"))


def stage_coverage(rows: DataFrame, keys: list[str], event: str, stages: dict[str, Column]) -> DataFrame:
    """AG-19: admitted, excluded, unresolved and the rate for each stage; a stage is true, false or null."""
    named = rows.select(*keys, event, F.inline(F.array(*[
        F.struct(F.lit(n).alias("stage"), c.alias("state")) for n, c in stages.items()])))
    out = named.groupBy(*keys, "stage").agg(
        F.count(event).alias("denominator"), F.count(F.when(F.col("state"), 1)).alias("admitted"),
        F.count(F.when(~F.col("state"), 1)).alias("excluded"), F.count(F.when(F.col("state").isNull(), 1)).alias("unresolved"))
    return out.withColumn("rate", F.col("admitted") / F.col("denominator"))


def by_group_and_pooled(rows: DataFrame, group: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """AG-20: each group and all groups together in one pass."""
    return rows.groupingSets([[F.col(group), *map(F.col, keys)], [F.col(k) for k in keys]], group, *keys).agg(*aggs)


def quantile_edges(rows: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    """AG-21: exact linear-interpolated edges at 1/parts, 2/parts, ..."""
    return exact_quantiles(rows, keys, value, [i / parts for i in range(1, parts)])


def iqr_outliers(rows: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """AG-25: rows outside the quartiles by k interquartile ranges."""
    q = exact_quantiles(rows, keys, value, [0.25, 0.75], "_q")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    v = F.col(value)
    return rows.join(q, keys).where((v < lo - k * (hi - lo)) | (v > hi + k * (hi - lo))).drop("_q")


def rolling_years(rows: DataFrame, keys: list[str], year: str, value: str, span: int = 4) -> DataFrame:
    """AG-27: mean over the last ``span`` years, current value, trend, years present, why it is missing.

    A year range frame, so missing years stay missing; null values are not counted.
    """
    w = Window.partitionBy(*keys).orderBy(year).rangeBetween(-(span - 1), 0)
    out = rows.withColumns({
        "years": F.count(value).over(w), "mean": F.avg(value).over(w), "oldest": F.min_by(value, year).over(w)})
    return out.withColumns({
        "strict_mean": F.when(F.col("years") == span, F.col("mean")), "trend": F.col(value) - F.col("oldest"),
        "missing_reason": F.when(F.col("years") == 0, "no_history").when(F.col("years") < span, "short_history")})


def transfer_balance(moves: DataFrame) -> DataFrame:
    """AG-26: moves in and out per (season, team); one pass over both ends of each move."""
    ends = moves.select("season", "rating", "is_qb", F.inline(F.array(
        F.struct(F.col("destination").alias("team"), F.lit(1).alias("inn")), F.struct(F.col("origin").alias("team"), F.lit(0).alias("inn")))))
    ends = ends.where("team IS NOT NULL")
    one = lambda flag, c: F.coalesce(F.sum(F.when(F.col("inn") == flag, c)), F.lit(0))
    return ends.groupBy("season", "team").agg(
        one(1, F.lit(1)).alias("in_count"), one(0, F.lit(1)).alias("out_count"),
        one(1, F.col("rating")).alias("in_rating"), one(0, F.col("rating")).alias("out_rating"),
        one(1, F.col("is_qb")).alias("in_qb"), one(0, F.col("is_qb")).alias("out_qb")).withColumn(
        "net_count", F.col("in_count") - F.col("out_count"))


def roster_continuity(roster: DataFrame) -> DataFrame:
    """AG-29: share returning against the previous season; ids on two teams in a season are left out."""
    one = roster.groupBy("season", "id").agg(F.min("team").alias("team"), F.max("team").alias("_hi"), F.max(F.expr(
        "CAST(position = 'QB' AS INT)")).alias("is_qb")).where("team = _hi").drop("_hi")
    before = one.select((F.col("season") + 1).alias("season"), "id", F.col("team").alias("was"))
    both = one.join(before, ["season", "id"], "left")
    back = F.col("was") == F.col("team")
    return both.groupBy("season", "team").agg(
        F.count("*").alias("players"), F.count(F.when(back, 1)).alias("returning"),
        F.count(F.when(F.col("was") != F.col("team"), 1)).alias("incoming"),
        F.count(F.when(back & (F.col("is_qb") == 1), 1)).alias("returning_qbs")).withColumn(
        "share_returning", F.col("returning") / F.col("players"))


def coach_tenure(seasons: DataFrame, year: int) -> DataFrame:
    """AG-30: consecutive years at one school that end at the target year; the longest tenure leads."""
    s = seasons.where(F.col("year") <= year).select("coach", "school", "year").distinct()
    w = Window.partitionBy("coach", "school").orderBy("year")
    runs = s.withColumn("_island", F.col("year") - F.row_number().over(w)).groupBy("coach", "school", "_island").agg(
        F.count("*").alias("tenure"), F.max("year").alias("last"))
    now = runs.where(F.col("last") == year)
    return now.groupBy("school").agg(F.max("tenure").alias("tenure"), F.max_by("coach", F.struct("tenure", "coach")).alias("coach"),
                                     F.count("*").alias("coaches")).withColumn("new_coach", F.col("tenure") == 1)


def lagged_poll_rank(sides_df: DataFrame, polls: DataFrame, unranked: int = 26) -> DataFrame:
    """AG-31: rank in the latest poll of the season before the game week; absent = 26, no poll = null."""
    weeks = polls.select("season", F.col("week").alias("poll_week")).distinct()
    pick = sides_df.select("season", "week").distinct().join(weeks, "season").where("poll_week < week").groupBy("season", "week").agg(
        F.max("poll_week").alias("poll_week"))
    ranks = polls.groupBy("season", F.col("week").alias("poll_week"), "team").agg(F.min("rank").alias("_lo"), F.max("rank").alias("_hi"))
    out = sides_df.join(pick, ["season", "week"], "left").join(ranks, ["season", "poll_week", "team"], "left")
    conflict = F.col("_lo") != F.col("_hi")
    return out.withColumns({
        "rank": F.when(F.col("poll_week").isNotNull() & ~F.coalesce(conflict, F.lit(False)), F.coalesce("_lo", F.lit(unranked))),
        "reason": F.when(F.col("poll_week").isNull(), "no_earlier_poll").when(conflict, "conflicting_rows")}).drop("_lo", "_hi")
