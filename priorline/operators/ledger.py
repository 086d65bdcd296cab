"""Possessions and scoring events from a play log with running scores.

The rules are stated on an ordered stream (carry the score, undo points the provider took back,
stop at an impossible jump), but none of them needs a row-by-row walk: the score carried forward is
the previous capped score, undone points are those above the lowest later score, and the stop is a
running flag.  All three are two-level running values, so one very long game is split over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plays as P
from ..functions import playtypes as T
from ..functions.identity import content_id
from ..session import stage_table
from .components import connected_components
from .scan import apart, previous, running

STREAM = ["game_id", "team"]


def possession_ledger(plays: DataFrame, eligible: Column) -> DataFrame:
    """IT-18: one row per (game, drive, offense) with counts, flags and the ordered play ids."""
    period = P.period_class()
    out = plays.withColumns({"_ok": eligible, "_pc": period}).groupBy("game_id", "drive_number", "offense").agg(
        F.count(F.when(F.col("_ok"), 1)).alias("eligible_plays"), F.count(F.when(~F.col("_ok"), 1)).alias("ineligible_plays"),
        F.min("defense").alias("_d0"), F.max("defense").alias("_d1"), F.min("_pc").alias("_p0"), F.max("_pc").alias("_p1"),
        F.array_sort(F.collect_list(F.struct("quarter", "play_number", "play_id"))).alias("_ids"))
    single = (F.col("_d0") == F.col("_d1")) & (F.col("_p0") == F.col("_p1"))
    return out.select(
        "game_id", "drive_number", "offense", "eligible_plays", "ineligible_plays", (F.col("eligible_plays") > 0).alias("possession_eligible"),
        ((F.col("eligible_plays") > 0) & (F.col("ineligible_plays") > 0)).alias("mixed"),
        F.when(~single, "ambiguous_drive_identity_or_period").alias("quality_reason"), F.transform("_ids", lambda x: x["play_id"]).alias("play_ids"))


def score_stream(plays: DataFrame) -> DataFrame:
    """One row per (play, team) with the team's running score."""
    return plays.select("*", F.inline(F.array(
        F.struct(F.col("offense").alias("team"), F.col("offense_score").cast("double").alias("score")),
        F.struct(F.col("defense").alias("team"), F.col("defense_score").cast("double").alias("score")))))


def _fault(x: Column, p: Column) -> Column:
    whole = (x >= 0) & (x == F.floor(x))
    return (F.when(x.isNull() | F.isnan(x), "missing_or_nonfinite_score").when(whole & (x < p), None)
            .when(~whole, "score_regression_or_nonintegral").when(x - p > 8, "impossible_score_increment"))


def accepted_stream(stream: DataFrame, finals: DataFrame, order: list[str], slice_by: Column | str, sliced: bool = True) -> DataFrame:
    """Previous capped score, what is wrong with the row, and whether the stream is already stopped."""
    s = stream.join(finals.select(*STREAM, "final"), STREAM, "left")
    s = s.withColumn("capped", F.least("score", F.col("final")))
    s = previous(s, STREAM, order, slice_by, {"_prev": "capped"}, materialize=sliced, sliced=sliced)
    s = s.withColumn("prev", F.coalesce("_prev", F.lit(0.0))).drop("_prev")
    s = s.withColumn("malformed", _fault(F.col("score"), F.col("prev")))
    s = running(s, STREAM, order, slice_by, {"_stops": ("count", F.when(F.col("malformed").isNotNull(), 1)), "_pos": ("count", F.lit(1))},
                inclusive=False, materialize=sliced, sliced=sliced)
    return s.where("_stops = 0").drop("_stops")


def opened_streams(stream: DataFrame, order: list[str]) -> DataFrame:
    """The streams of which :func:`accepted_stream` accepts a row: those whose first row, before which the score is 0, is no stop."""
    first = stream.groupBy(*STREAM).agg(F.min_by(F.struct("score"), F.struct(*order))["score"].alias("score"))
    return first.where(_fault(F.col("score"), F.lit(0.0)).isNull()).select(*STREAM)


def scoring_events(plays: DataFrame, possessions: DataFrame, finals: DataFrame, order: list[str], slice_by: str) -> DataFrame:
    """IT-19: score increments with category, origin of conversions, cap, quarantine and rollback."""
    scored = ["offense_score", "defense_score", "defense", "_late_side"]
    narrow = plays.where(~P.member("play_type", T.DEAD)).select(
        *dict.fromkeys(["game_id", "play_id", "drive_number", "quarter", "offense", *scored[:3], *order]), F.expr(slice_by).alias("_on"),
        P.member("play_type", T.TWO_POINT + T.EXTRA_POINT).alias("_conversion"), P.member("play_type", T.TURNOVER + T.KICKOFF + T.PUNT).alias("_late_side"))
    slice_by = "_on"
    stream = score_stream(narrow).withColumn("_other_side", (F.col("team") != F.col("offense")) | F.col("_late_side")).drop(*[c for c in scored if c not in order])
    parts = [_increments(rows, finals, order, slice_by, sliced) for rows, sliced in apart(stream, STREAM)]
    return reduce(DataFrame.unionByName, [_categories(s, ev, possessions, order, slice_by, sliced) for s, ev, sliced in parts])


def _increments(stream: DataFrame, finals: DataFrame, order: list[str], slice_by: str, sliced: bool) -> tuple[DataFrame, DataFrame, bool]:
    """The accepted rows, and those that raise the score with what is left of it."""
    s = stage_table(accepted_stream(stream, finals, order, slice_by, sliced))
    # points undone later are those above the lowest later score: a running minimum from the end
    live = s.where("malformed IS NULL").withColumns({"_back": -F.col("_pos"), "_day": -F.datediff(F.expr(slice_by), F.lit("1970-01-01"))})
    low = running(live, STREAM, ["_back"], "_day", {"_low": ("min", F.col("capped"))}, inclusive=False, sliced=sliced).drop("_pos", "_back", "_day")
    ev = low.where("score > prev")
    return s, ev.withColumns({
        "gained": F.col("capped") - F.col("prev"),
        "score_increment": F.greatest(F.lit(0.0), F.least(F.col("capped"), F.coalesce("_low", F.col("capped"))) - F.col("prev")).cast("int")}), sliced


def _categories(s: DataFrame, ev: DataFrame, possessions: DataFrame, order: list[str], slice_by: str, sliced: bool) -> DataFrame:
    p = possessions.select("game_id", "drive_number", "offense", "possession_eligible", F.col("quality_reason").alias("_pq"), F.lit(True).alias("_has"))
    ev = ev.join(p, ["game_id", "drive_number", "offense"], "left")
    period = P.period_class()
    conversion, other_side = F.col("_conversion"), F.col("_other_side")
    category = (F.when(F.col("gained") == 0, None).when(period == "unknown", "unresolved").when(period == "overtime", "overtime")
                .when(conversion, None).when(other_side, "regulation_non_offense")
                .when(F.col("_has").isNull() | F.col("_pq").isNotNull(), "unresolved")
                .when(F.col("possession_eligible"), "eligible_regulation_offense").otherwise("excluded_regulation_offense"))
    ev = ev.withColumns({"_conv": conversion & (period == "regulation") & (F.col("gained") > 0), "_cat": category})
    settled = ~F.col("_cat").isin("unresolved", "overtime")
    # a conversion belongs to the last event before it that is settled or itself a conversion
    ev = running(ev, STREAM, order, slice_by, {"_origin": ("last", F.when(settled, F.col("_cat"))),
                                               "_active": ("last", F.when(settled | F.col("_conv"), F.col("play_id")))},
                 inclusive=False, materialize=sliced, sliced=sliced)
    cat = F.when(F.col("gained") == 0, "unresolved").when(F.col("_conv"), F.coalesce("_origin", F.lit("unresolved"))).otherwise(F.col("_cat"))
    reason = (F.when(F.col("gained") == 0, "exceeds_repaired_final").when(F.col("score_increment") < F.col("gained"), "score_regression_rollback")
              .when(F.col("_conv") & F.col("_origin").isNull(), "conversion_without_origin").when(period == "unknown", "unknown_period")
              .when(cat == "unresolved", "ambiguous_possession"))
    good = ev.select("game_id", "team", "play_id", "drive_number", period.alias("period_class"), "score_increment", cat.alias("scoring_category"),
                     F.when(F.col("_conv") & F.col("_origin").isNotNull(), F.col("_active")).alias("conversion_for_event_id"), reason.alias("quality_reason"))
    stop = s.where("malformed IS NOT NULL").select(
        "game_id", "team", "play_id", "drive_number", period.alias("period_class"), F.lit(0).alias("score_increment"),
        F.lit("unresolved").alias("scoring_category"), F.lit(None).cast("long").alias("conversion_for_event_id"), F.col("malformed").alias("quality_reason"))
    return good.unionByName(stop)


def drive_points(plays: DataFrame, order: list[str], slice_by: Column | str) -> DataFrame:
    """IT-20: last score minus the score before the first play of each drive; a stream that ever falls is left out."""
    s = previous(score_stream(plays).where("team = offense"), STREAM, order, slice_by, {"_was": "score"})
    at = F.struct(*order)
    fell = s.groupBy(*STREAM).agg(F.coalesce(F.bool_or(F.col("score") < F.col("_was")), F.lit(False)).alias("_fell")).where("_fell")
    out = s.groupBy(*STREAM, "drive_number").agg(F.min_by(F.struct("_was"), at).alias("_f"), F.max_by("score", at).alias("_l"))
    return out.join(fell.select(*STREAM), STREAM, "left_anti").select(
        *STREAM, "drive_number", (F.col("_l") - F.coalesce("_f._was", F.lit(0.0))).alias("points"))


def changed_groups(baseline: DataFrame, candidate: DataFrame, order: str) -> DataFrame:
    """IT-22: maximal runs of changed events per (game, team), merged over conversion references."""
    keys = [*STREAM, "play_id"]
    b = baseline.select(*keys, F.col(order).alias("_bo"), F.col("points").alias("b_points"), F.col("category").alias("b_cat"), "conversion_for", F.lit(1).alias("_b"))
    c = candidate.select(*keys, F.col(order).alias("_co"), F.col("points").alias("c_points"), F.col("category").alias("c_cat"), F.col("conversion_for").alias("_cf"), F.lit(1).alias("_c"))
    both = b.join(c, keys, "full_outer").withColumn("_o", F.coalesce("_bo", "_co"))
    both = both.withColumn("changed", F.col("_b").isNull() | F.col("_c").isNull() | ~F.col("b_points").eqNullSafe(F.col("c_points")) | ~F.col("b_cat").eqNullSafe(F.col("c_cat")))
    w = Window.partitionBy(*STREAM).orderBy("_o", "play_id")
    run = both.withColumn("_run", F.sum((~F.col("changed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ch = run.where("changed").withColumn("conversion_for", F.coalesce("conversion_for", "_cf"))
    first = ch.groupBy(*STREAM, "_run").agg(F.min("play_id").alias("run_id"))
    ch = ch.join(first, [*STREAM, "_run"])
    link = ch.where("conversion_for IS NOT NULL").select(*STREAM, F.col("run_id").alias("src"), F.col("conversion_for").alias("_ev")).join(
        ch.select(*STREAM, F.col("play_id").alias("_ev"), F.col("run_id").alias("dst")), [*STREAM, "_ev"])
    # ids are unique across games only together with the stream, so components run on one combined key
    node = lambda c: F.concat_ws(":", "game_id", "team", F.col(c))
    comp = connected_components(ch.select(node("run_id").alias("node")).distinct(), link.select(node("src").alias("src"), node("dst").alias("dst")).where("src <> dst"))
    out = ch.withColumn("node", node("run_id")).join(comp, "node")
    delta = F.coalesce("c_points", F.lit(0)) - F.coalesce("b_points", F.lit(0))
    return out.groupBy(*STREAM, F.col("component").alias("group_id")).agg(
        F.count("*").alias("events"), F.sum(delta).alias("net_points"), F.max(F.col("_b").isNull()).alias("added"),
        F.max(F.col("_c").isNull()).alias("removed"), F.count_distinct("run_id").alias("runs"))


def admit_groups(baseline: DataFrame, candidate: DataFrame, membership: DataFrame, decisions: DataFrame) -> DataFrame:
    """IT-23: baseline rows outside admitted groups plus the candidate rows of admitted groups."""
    keys = [*STREAM, "play_id"]
    m = membership.join(decisions.where("admitted"), "group_id").select(*keys, "group_id", "decision")
    stay = baseline.join(m.select(*keys), keys, "left_anti").withColumns({"group_id": F.lit(None).cast("string"), "decision": F.lit("baseline")})
    come = candidate.join(m, keys)
    return stay.unionByName(come.select(*stay.columns))


def ledger_rows(possessions: DataFrame, drives: DataFrame) -> DataFrame:
    """IT-24: versioned possession rows: stable id, start position, opportunity flag."""
    out = possessions.join(drives.select("game_id", "drive_number", "offense", "start_yards_to_goal", "had_scoring_opportunity"),
                           ["game_id", "drive_number", "offense"], "left")
    return out.withColumns({"possession_id": content_id(["game_id", "drive_number", "offense"], 32),
                            "start_field_position": 100 - F.col("start_yards_to_goal"),
                            "scoring_opportunity": F.coalesce(F.col("had_scoring_opportunity") == 1, F.lit(False))}).select(
        "possession_id", "game_id", "drive_number", "offense", "start_field_position", "scoring_opportunity", "possession_eligible")
