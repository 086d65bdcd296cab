"""Play-level column expressions. All stay inside code generation; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import playtypes as P

PERIOD_MARKERS = "(?i)(end of|end period|end quarter|end game|timeout)"


def flag(condition: Column) -> Column:
    """0/1 flag; an unknown condition counts as not met."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def member(column: str, labels: list[str]) -> Column:
    return F.coalesce(F.col(column).isin(labels), F.lit(False))


def with_missing_flags(df: DataFrame, value: str, reason: str, keep_null: bool = True) -> DataFrame:
    """FN-1: record what was missing before any fill."""
    number = F.col(value).try_cast("double")
    missing = number.isNull() | F.isnan(number)
    clean = F.when(~missing, number)
    return df.withColumns({
        f"{value}_missing": missing,
        f"{value}_missing_reason": F.when(missing, F.lit(reason)).otherwise(F.lit("")),
        value: clean if keep_null else F.coalesce(clean, F.lit(0.0)),
    })


def type_flags(column: str = "play_type") -> dict[str, Column]:
    """FN-2: membership flags from the play-type families."""
    return {name: member(column, labels).cast("int") for name, labels in P.FLAGS.items()}


def penalty_flags() -> dict[str, Column]:
    """FN-3: the sign of the yards tells whose penalty it was."""
    is_penalty = F.col("play_type") == "Penalty"
    yards = F.col("yards_gained")
    return {
        "penalty": flag(is_penalty),
        "offensive_penalty": flag(is_penalty & (yards < 0)),
        "defensive_penalty": flag(is_penalty & (yards > 0)),
    }


def context_columns() -> dict[str, Column]:
    """FN-4: half, which side has the ball, score difference."""
    q = F.col("quarter")
    return {
        "half": F.when(q.isin(1, 2), 1).when(q.isin(3, 4), 2).otherwise(3),
        "home_away": F.when(F.col("offense") == F.col("home"), "home").otherwise("away"),
        "relative_score": F.col("offense_score") - F.col("defense_score"),
    }


def standard_yards() -> Column:
    """FN-5: no yards for the offense on a lost or touchdown fumble recovery."""
    label = F.lower("play_type")
    lost = label.contains("fumble recovery (opponent)") | label.contains("fumble recovery (touchdown)")
    return F.when(lost, F.lit(0.0)).otherwise(F.col("yards_gained"))


def _gain_reaches(target: Column, yards: Column, down: Column) -> Column:
    share = F.when(down == 1, 0.5).when(down == 2, 0.7).when(down.isin(3, 4), 1.0)
    return F.coalesce(yards >= share * target, F.lit(False))


def success(yards: str = "yards", turnover: Column | None = None) -> Column:
    """FN-6: share of the needed distance by down; reaching the goal share also counts."""
    y, d = F.col(yards), F.col("down")
    to_first, to_goal = F.col("yards_to_first"), F.col("yards_to_goal")
    by_goal = _gain_reaches(to_goal, y, d)
    made = F.when(to_first == 0, by_goal).when(to_first > 0, by_goal | _gain_reaches(to_first, y, d))
    lost = member("play_type", P.TURNOVER) if turnover is None else turnover
    return (
        F.when(member("play_type", P.SCRIMMAGE_RESULT), F.coalesce(made, F.lit(False)).cast("double"))
        .when(lost, F.lit(0.0))
    )


def explosive(yards: str = "yards") -> Column:
    """FN-7: rushes of 15 and passes of 20 yards or more; NULL where the idea does not apply."""
    y = F.col(yards)
    big = (member("play_type", P.RUSH_RESULT) & (y >= 15)) | (member("play_type", P.PASS_ATTEMPT) & (y >= 20))
    return F.when(member("play_type", P.NEVER_EXPLOSIVE), F.lit(0.0)).when(
        member("play_type", P.SCRIMMAGE_RESULT), flag(big).cast("double"))


def line_yards(yards: str = "yards") -> Column:
    """FN-8: losses weigh 1.2, gains count full to 4, half to 10, and 7 beyond; rushes only."""
    y = F.col(yards)
    credit = F.when(y < 0, y * 1.2).when(y <= 4, y).when(y <= 10, 4 + (y - 4) * 0.5).otherwise(F.lit(7.0))
    return F.when(member("play_type", P.RUSH_ATTEMPT), credit)


def second_level_yards(yards: str = "yards") -> Column:
    """FN-9: the part of a rush between 5 and 10 yards."""
    y = F.col(yards)
    return F.when(member("play_type", P.RUSH_ATTEMPT), F.greatest(F.lit(5.0), F.least(F.lit(10.0), y)) - 5)


def open_field_yards(yards: str = "yards") -> Column:
    """FN-9: the part of a rush beyond 10 yards."""
    return F.when(member("play_type", P.RUSH_ATTEMPT), F.greatest(F.lit(10.0), F.col(yards)) - 10)


def power_situation() -> Column:
    """FN-10: a rush on third or fourth down with at most 2 yards to go."""
    return F.coalesce(
        F.col("down").isin(3, 4) & (F.col("yards_to_first") <= 2) & member("play_type", P.RUSH_ATTEMPT),
        F.lit(False))


def kick_distance() -> Column:
    """FN-11: field-goal attempts only; 17 yards behind the line."""
    return F.when(member("play_type", P.FIELD_GOAL), F.col("yard_line") + 17)


def defense_flags(yards: str = "yards") -> dict[str, Column]:
    """FN-12: stuff, havoc, loss, sack, completion, touchdown, 40-yard gain."""
    y = F.col(yards)
    is_penalty = F.col("play_type") == "Penalty"
    return {
        "stuff": flag(member("play_type", P.RUSH_ATTEMPT) & (y <= 0)),
        "havoc": flag(~is_penalty & (member("play_type", P.HAVOC) | (y < 0))),
        "tfl": flag(~is_penalty & (y < 0)),
        "sack": flag(F.col("play_type") == "Sack"),
        "completion": flag(member("play_type", P.COMPLETION)),
        "td_play": flag(F.lower("play_type").contains("touchdown")),
        "big_play_40": flag(y >= 40),
    }


def conversion(down: int, success_column: str = "success") -> Column:
    """FN-13: conversion on one down, NULL off that down."""
    return F.when(F.col("down") == down, flag(F.col(success_column) == 1))


def garbage_time() -> Column:
    """FN-14: third quarter led by 35 or more, fourth by 27 or more."""
    lead = F.abs(F.col("offense_score") - F.col("defense_score"))
    q = F.col("quarter")
    return flag(((q == 3) & (lead >= 35)) | ((q == 4) & (lead >= 27)))


def situation_flags() -> dict[str, Column]:
    """FN-15: close game, fourth quarter, passing down, red zone, scoring opportunity."""
    d, to_first = F.col("down"), F.col("yards_to_first")
    lead = F.abs(F.col("offense_score") - F.col("defense_score"))
    return {
        "close_game": flag((F.col("quarter") == 4) & (lead <= 7)),
        "fourth_quarter": flag(F.col("quarter") == 4),
        "passing_down": flag(((d == 2) & (to_first >= 8)) | (d.isin(3, 4) & (to_first >= 5))),
        "red_zone": flag(F.col("yards_to_goal") <= 20),
        "eckel": flag((F.col("yards_to_goal") < 40) & (d == 1)),
    }


def right_closed_bin(column: str, edges: list[float], labels: list[str]) -> Column:
    """FN-16: label of the interval (lo, hi] that holds the value; NULL outside every interval."""
    x = F.col(column)
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), F.lit(label)).otherwise(out)
    return out


FIELD_POSITION = ([0, 20, 50, 80, 100], ["Own Red Zone", "Own", "Opponent", "Red Zone"])
FG_DISTANCE = ([0, 39, 49, 100], ["short", "mid", "long"])


def counts_for_drive() -> Column:
    return flag(~member("play_type", P.SPECIAL_TEAMS + P.TWO_POINT + P.DEAD + ["Penalty"]))


def drop_dead_and_retag(df: DataFrame) -> DataFrame:
    """FN-17: remove dead rows; recovered fumbles count as rushes."""
    fumble = member("play_type", P.OWN_OR_LOST_FUMBLE)
    return df.where(~member("play_type", P.DEAD)).withColumns({
        "rush_attempt": F.when(fumble, 1).otherwise(F.col("rush_attempt")),
        "rush_result": F.when(fumble, 1).otherwise(F.col("rush_result")),
        "yards": F.when(F.col("play_type") == "Fumble Recovery (Opponent)", 0.0).otherwise(F.col("yards")),
    })


def period_class() -> Column:
    """NRM-22: regulation for periods 1 to 4, overtime beyond, else unknown."""
    q = F.col("quarter")
    return F.when(q.between(1, 4), "regulation").when(q > 4, "overtime").otherwise("unknown")


def needed_distance(distance: str, goal: str) -> Column:
    """FN-27: the distance, or the goal distance where there is no positive one."""
    return F.when(F.col(distance) > 0, F.col(distance)).otherwise(F.col(goal))


def is_pass_text(column: str) -> Column:
    """FN-28: passes by label text."""
    return F.coalesce(F.col(column).rlike("(?i)pass|sack|interception"), F.lit(False))


def is_rush_text(column: str) -> Column:
    """FN-28: rushes by label text."""
    return F.coalesce(F.col(column).rlike("(?i)rush|run"), F.lit(False))


def eligible_play(overtime: bool = False) -> Column:
    """NRM-21: a live play from scrimmage that is neither special teams, penalty, try nor garbage time."""
    period = period_class()
    in_period = (period == "regulation") | ((period == "overtime") if overtime else F.lit(False))
    return in_period & (garbage_time() == 0) & ~member(
        "play_type", P.SPECIAL_TEAMS + P.TWO_POINT + P.DEAD + ["Penalty"])


def enrich_plays(plays: DataFrame) -> DataFrame:
    """All play columns in three projections, so every expression is computed once."""
    base = with_missing_flags(plays, "ppa", "provider_missing_ppa").withColumns({
        **type_flags(), **penalty_flags(), **context_columns(), **situation_flags(),
        "yards": standard_yards(), "garbage": garbage_time(), "is_drive_play": counts_for_drive(),
        "kick_distance": kick_distance(), "is_fg_made": flag(F.col("play_type") == "Field Goal Good"),
        "field_position_bin": right_closed_bin("yard_line", *FIELD_POSITION),
        "period_class": period_class(), "is_power_situation": power_situation(),
    })
    rated = base.withColumns({
        "success": success(), "explosive": explosive(), "line_yards": line_yards(),
        "second_level_yards": second_level_yards(), "open_field_yards": open_field_yards(),
        **defense_flags(),
    }).withColumns({
        "success_yards": F.when(F.col("success") == 1, F.col("yards")).otherwise(0.0),
        "explosive_yards": F.when(F.col("explosive") == 1, F.col("yards")).otherwise(0.0),
        "power_success_converted": F.col("is_power_situation") & (F.coalesce("success", F.lit(0.0)) == 1),
        "thirddown_conversion": conversion(3), "fourthdown_conversion": conversion(4),
    })
    return drop_dead_and_retag(rated)
