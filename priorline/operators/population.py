"""Population, gating and serving tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guards import ContractError


def reconcile(schedule: DataFrame, outcomes: DataFrame, observed: dict[str, DataFrame], omissions: DataFrame) -> DataFrame:
    """PO-1: one row per scheduled game: what is known, what is missing, and its disposition."""
    out = schedule.join(outcomes.select("game_id", F.lit(True).alias("_outcome"), "valid"), "game_id", "left")
    for name, df in observed.items():
        out = out.join(df.select("game_id").distinct().withColumn(f"_{name}", F.lit(True)), "game_id", "left")
    out = out.join(omissions.select("game_id", "omission").distinct(), "game_id", "left")
    missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in observed])))
    out = out.withColumns({"outcome_valid": F.coalesce("valid", F.lit(False)), "missing_sources": F.array_join(missing, ",")})
    out = out.withColumn("measurement_usable", F.col("outcome_valid") & (F.col("missing_sources") == ""))
    disposition = (F.when(~F.col("completed"), "not_played").when(~F.col("outcome_valid"), "invalid_outcome").when(F.col("measurement_usable"), "usable")
                   .when(F.col("omission").isNotNull(), "declared_omission").otherwise("undeclared_gap"))
    return out.withColumn("disposition", disposition).drop("_outcome", "valid", *[f"_{n}" for n in observed])


def require_counts(df: DataFrame, expected: dict[str, int], conditions: dict[str, Column]) -> DataFrame:
    """PO-2: exact counts in one pass, or the job stops."""
    got = df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()]).first().asDict()
    wrong = {n: (got[n], expected[n]) for n in expected if got[n] != expected[n]}
    if wrong:
        raise ContractError(f"population counts differ (found, expected): {wrong}")
    return df


def coverage_gate(coverage: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """PO-3: every expected cell with its rate, threshold and verdict; absent cells fail."""
    out = thresholds.join(coverage.select(*keys, "rate"), keys, "left")
    return out.withColumn("verdict", F.when(F.col("rate").isNull(), "absent").when(F.col("rate") < F.col("minimum"), "below").otherwise("ok"))


def omission_reasons(expected: DataFrame, present: DataFrame, declared: DataFrame) -> DataFrame:
    """PO-4: each missing game with its declared reason; declarations that match no gap are listed too."""
    gap = expected.select("game_id").distinct().join(present.select("game_id"), "game_id", "left_anti").withColumn("_gap", F.lit(True))
    out = gap.join(declared.select("game_id", "reason").distinct(), "game_id", "full_outer")
    return out.select("game_id", F.when(F.col("_gap").isNull(), "unused_declaration").when(F.col("reason").isNull(), "undeclared").otherwise(F.col("reason")).alias("status"))


def classify_sequence(rows: DataFrame, sequence: list[str], payload: list[str]) -> DataFrame:
    """PO-38: groups with several rows: identical copies, or different rows on one sequence."""
    row = F.struct(*payload)
    g = rows.groupBy(*sequence).agg(F.count("*").alias("n"), F.min(row).alias("_a"), F.max(row).alias("_b")).where("n > 1")
    return g.select(F.when(F.col("_a").eqNullSafe(F.col("_b")), "identical").otherwise("divergent").alias("kind"), "n").groupBy("kind").agg(
        F.count("*").alias("groups"), F.sum("n").alias("rows"))


def availability_matrix(targets: DataFrame, sources: dict[str, DataFrame], minimum: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """PO-15: of the target games (per ``by``), how many each source has, and whether all sources are ready.

    Each source marks the targets it has, and one aggregate counts the marks, so totals are never joined back.
    """
    marked = targets.select(*by, "game_id")
    for k, df in enumerate(sources.values()):
        marked = marked.join(df.select("game_id").distinct().withColumn(f"_has{k}", F.lit(1)), "game_id", "left")
    counts = marked.groupBy(*by).agg(F.count("*").alias("targets"), *[F.count(f"_has{k}").alias(f"_has{k}") for k in range(len(sources))])
    ready = [F.col(f"_has{k}") >= minimum * F.col("targets") for k in range(len(sources))]
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"_has{k}").alias("found"), ready[k].alias("ready")) for k, s in enumerate(sources)])
    return counts.select(*by, "targets", reduce(lambda a, b: a & b, ready).alias("all_ready"), F.inline(rows))


def freeze_plan(schedule: DataFrame, predictions: DataFrame, freeze_at: Column) -> DataFrame:
    """PO-16: what each scheduled game gets at the freeze time."""
    p = predictions.select("game_id", F.lit(True).alias("_p")).distinct()
    out = schedule.join(p, "game_id", "left")
    return out.withColumn("plan", F.when(F.col("kickoff") <= freeze_at, "late").when(F.col("_p").isNull(), "no_prediction").otherwise("frozen")).drop("_p")


def key_digest(rows: DataFrame, group: list[str], key: str, examples: int) -> DataFrame:
    """PO-19: count, a bounded example list and an order-free digest of all affected keys."""
    w = Window.partitionBy(*group).orderBy(key)
    head = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= examples).groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(key))).cast("array<string>"), ",").alias("examples"))
    hashed = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    whole = rows.groupBy(*group).agg(F.count("*").alias("keys"), F.sum(hashed).cast("string").alias("digest"))
    return whole.join(head, group)


def explain_extra(left: DataFrame, right: DataFrame, keys: list[str], reasons: dict[str, Column]) -> DataFrame:
    """PO-21: rows only the left side has, with the first reason that fits."""
    extra = left.join(right.select(*keys), keys, "left_anti")
    why = F.lit("unexplained")
    for name, cond in reversed(reasons.items()):
        why = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(why)
    return extra.withColumn("reason", why)


def corroborate(ledger: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """PO-22: points per drive from two sources; a game is usable if every drive agrees."""
    l = ledger.groupBy("game_id", *keys).agg(F.sum("points").alias("_l"))
    e = external.groupBy("game_id", *keys).agg(F.sum("points").alias("_e"))
    both = l.join(e, ["game_id", *keys], "full_outer").withColumn("_ok", F.col("_l").eqNullSafe(F.col("_e")))
    return both.groupBy("game_id").agg(F.count("*").alias("drives"), F.count(F.when(~F.col("_ok"), 1)).alias("differing"), F.bool_and("_ok").alias("usable"))


def serving_core(games: DataFrame, forecasts: DataFrame, grades: DataFrame) -> DataFrame:
    """PO-23: one row per game with both forecasts and both grades beside the result."""
    f = forecasts.groupBy("game_id").agg(*[F.max(F.when(F.col("target") == t, F.col("prediction"))).alias(f"{t}_mean") for t in ("spread", "total")])
    g = grades.groupBy("game_id").agg(*[F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{t}_{c}") for t in ("spread", "total") for c in ("side", "result")])
    return games.join(f, "game_id", "left").join(g, "game_id", "left")


def cumulative_efficiency(rows: DataFrame, keys: list[str], week: str) -> DataFrame:
    """PO-27: cumulative success and value per play through each week; pooled rows are play-weighted."""
    both = rows.select("*", F.explode(F.array(F.col("team").cast("string"), F.lit("pooled"))).alias("_who"))
    per = both.groupBy(*keys, F.col("_who").alias("who"), week).agg(F.sum("plays").alias("_p"), F.sum("success").alias("_s"), F.sum("value").alias("_v"))
    w = Window.partitionBy(*keys, "who").orderBy(week).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*keys, "who", week, F.sum("_p").over(w).alias("plays"), F.try_divide(F.sum("_s").over(w), F.sum("_p").over(w)).alias("success_rate"),
                      F.try_divide(F.sum("_v").over(w), F.sum("_p").over(w)).alias("value_per_play"))


def net_success(rows: DataFrame, finals: DataFrame) -> DataFrame:
    """PO-28: winner minus loser success rate, and winners that were outplayed."""
    a = rows.select("game_id", F.col("team").alias("_t"), F.col("rate").alias("_r"))
    f = finals.withColumns({"winner": F.when(F.col("home_points") > F.col("away_points"), F.col("home")).when(F.col("home_points") < F.col("away_points"), F.col("away")),
                            "loser": F.when(F.col("home_points") > F.col("away_points"), F.col("away")).when(F.col("home_points") < F.col("away_points"), F.col("home"))})
    out = (f.join(a.withColumnsRenamed({"_t": "winner", "_r": "w_rate"}), ["game_id", "winner"], "left")
           .join(a.withColumnsRenamed({"_t": "loser", "_r": "l_rate"}), ["game_id", "loser"], "left"))
    net = F.col("w_rate") - F.col("l_rate")
    return out.select("game_id", net.alias("net"), F.when(F.col("winner").isNull(), "no_winner").when(net.isNull(), "no_rate").alias("not_charted"), F.coalesce(net < 0, F.lit(False)).alias("outplayed"))


def team_records(sides_df: DataFrame, line: str, total: str) -> DataFrame:
    """PO-33: winners, against the spread and over/under tallies per team."""
    one = lambda c: F.count(F.when(c, 1))
    m = F.col("points_for") - F.col("points_against")
    ats, ou = m + F.col(line), F.col("points_for") + F.col("points_against") - F.col(total)
    return sides_df.groupBy("season", "team").agg(one(m > 0).alias("wins"), one(m < 0).alias("losses"), one(ats > 0).alias("ats_wins"), one(ats < 0).alias("ats_losses"),
                                                  one(ats == 0).alias("ats_pushes"), one(ou > 0).alias("overs"), one(ou < 0).alias("unders"))


def bye_weeks(sides_df: DataFrame) -> DataFrame:
    """PO-35: every week between a team's first and last game, with a bye where there is no game."""
    span = sides_df.groupBy("season", "team").agg(F.min("week").alias("_a"), F.max("week").alias("_b"))
    grid = span.select("season", "team", F.explode(F.sequence("_a", "_b")).alias("week"))
    played = sides_df.groupBy("season", "team", "week").agg(F.count("*").alias("games"))
    return grid.join(played, ["season", "team", "week"], "left").withColumns({"games": F.coalesce("games", F.lit(0)), "bye": F.col("games").isNull()})


def completed_week_guard(weeks: DataFrame, inputs: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """PO-43: completed weeks an input does not have."""
    parts = [weeks.select(*keys).join(df.select(*keys).distinct(), keys, "left_anti").withColumn("input", F.lit(n)) for n, df in inputs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
