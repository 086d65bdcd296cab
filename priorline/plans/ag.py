"""Aggregations: roll-ups of the play log, coverage, quantiles, records and season tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import plays as P, playtypes as T
from ..functions.regimes import label_by_edges
from ..operators import joins as J, metrics as M, rollup as R
from .fn import ELIGIBLE_SQL, GARBAGE_SQL, RATED_CTE, RUSH, inlist
from .registry import q6, query, r6

ENRICHED = f"""{RATED_CTE}, en AS (
    SELECT *, quarter*10 + k//25 AS drive_number, game_id || '-' || (quarter*10 + k//25) AS drive_id,
      CAST(play_type IN {inlist(T.RUSH_ATTEMPT + T.OWN_OR_LOST_FUMBLE)} AS INT) AS rush_attempt,
      CAST(play_type IN {inlist(T.PASS_ATTEMPT)} AS INT) AS pass_attempt, CAST(play_type IN {inlist(T.DROPBACK)} AS INT) AS dropback,
      CAST(play_type IN {inlist(T.TURNOVER)} AS INT) AS turnover, CAST(play_type='Sack' AS INT) AS sack,
      CASE WHEN play_type ILIKE '%touchdown%' THEN 7 WHEN play_type='Field Goal Good' THEN 3 ELSE 0 END AS scoring,
      CAST(yards_to_goal<40 AND down=1 AS INT) AS eckel, {GARBAGE_SQL} AS garbage, {ELIGIBLE_SQL} AS eligible,
      CAST(play_type NOT IN {inlist(T.SPECIAL_TEAMS + T.TWO_POINT + T.DEAD + ['Penalty'])} AS INT) AS is_drive_play,
      CAST(play_type<>'Penalty' AND (play_type IN {inlist(T.HAVOC)} OR yards<0) AS INT) AS havoc,
      CASE WHEN {RUSH} THEN CASE WHEN yards<0 THEN yards*1.2 WHEN yards<=4 THEN yards WHEN yards<=10 THEN 2+yards/2 ELSE 7 END END AS line_yards,
      down>=3 AND yards_to_first<=2 AND {RUSH} AS is_power
    FROM rated WHERE play_type NOT IN {inlist(T.DEAD)})"""


def enriched(d):
    e = P.enrich_plays(d.plays)
    return e.withColumns({
        "drive_number": (F.col("quarter") * 10 + F.floor(F.col("k") / 25)).cast("int"),
        "scoring": F.when(F.col("td_play") == 1, 7).when(F.col("play_type") == "Field Goal Good", 3).otherwise(0),
    }).withColumn("drive_id", F.concat_ws("-", "game_id", "drive_number"))


DRIVES_SQL = """dr AS (SELECT game_id, drive_number, offense, defense, CAST(sum(is_drive_play) AS BIGINT) AS drive_plays, sum(yards) AS drive_yards,
      min(quarter) AS drive_start_period, max(quarter) AS drive_end_period, arg_min(yards_to_goal, play_number) AS start_yards_to_goal,
      arg_max(yards_to_goal, play_number) AS end_yards_to_goal, max(eckel) AS had_scoring_opportunity,
      CAST(sum(scoring) AS BIGINT) AS points, CAST(sum(turnover) AS BIGINT) AS turnovers FROM en GROUP BY 1, 2, 3, 4),
    dro AS (SELECT *, CAST(points>0 AS INT) AS is_successful_drive, CAST(turnovers>0 AS INT) AS is_busted_drive,
      CAST(drive_yards/greatest(drive_plays,1)>10 AS INT) AS is_explosive_drive,
      CASE WHEN had_scoring_opportunity=1 THEN points ELSE 0 END AS points_on_opps FROM dr)"""


@query("ag1_drive_rollup", uses="plays", sql=f"{ENRICHED}, {DRIVES_SQL} SELECT * FROM dro")
def _(d):
    return R.drives(enriched(d), ["quarter", "play_number"])


@query("ag2_provider_drives", uses="plays", sql=f"""{ENRICHED},
    e AS (SELECT game_id, drive_id, offense, defense, min(quarter) AS q0, max(quarter) AS q1 FROM en GROUP BY 1, 2, 3, 4),
    pts AS (SELECT game_id, drive_id, offense, defense, down, min(yards_to_goal) AS lo, max(yards_to_goal) AS hi FROM en GROUP BY 1,2,3,4,5)
    SELECT n.game_id, n.drive_id, n.offense, n.defense, CAST(sum(is_drive_play) AS BIGINT) AS drive_plays, CAST(sum(scoring) AS BIGINT) AS points,
      any_value(f.v) AS start_yards_to_goal, any_value(l.v) AS end_yards_to_goal
    FROM en n
    JOIN (SELECT game_id, drive_id, offense, defense, arg_min(CASE WHEN lo=hi THEN lo ELSE -1 END, down) AS v0, nullif(arg_min(CASE WHEN lo=hi THEN lo ELSE -1 END, down), -1) AS v FROM pts GROUP BY 1,2,3,4) f USING (game_id, drive_id, offense, defense)
    JOIN (SELECT game_id, drive_id, offense, defense, nullif(arg_max(CASE WHEN lo=hi THEN lo ELSE -1 END, down), -1) AS v FROM pts GROUP BY 1,2,3,4) l USING (game_id, drive_id, offense, defense)
    GROUP BY 1, 2, 3, 4""")
def _(d):
    return R.provider_drives(enriched(d), ["down"]).select(
        "game_id", "drive_id", "offense", "defense", "drive_plays", "points", "start_yards_to_goal", "end_yards_to_goal")


def _tg_sql(p, col):
    return f"""SELECT game_id, {col} AS team, count(*) AS n_{p}_plays, CAST(sum(rush_attempt) AS BIGINT) AS {p}_n_rush, {q6('avg(success)')} AS {p}_sr,
      {q6('avg(yards)')} AS {p}_ypp, {q6('avg(ppa)')} AS {p}_epa_pp, {q6('sum(CASE WHEN rush_attempt=1 THEN yards ELSE 0 END)/greatest(sum(rush_attempt),1)')} AS {p}_rush_ypp,
      {q6('avg(CAST(yards>=20 AS INT))')} AS {p}_expl_rate_overall_20, {q6('avg(CAST(rush_attempt=1 AND yards<=0 AS INT))')} AS {p}_stuff_rate,
      {q6('avg(havoc)')} AS {p}_havoc_rate, {q6('avg(line_yards)')} AS {p}_avg_line_yards,
      {q6('sum(CAST(is_power AND success=1 AS INT))/greatest(sum(CAST(is_power AS INT)),1)')} AS {p}_power_success_rate,
      {q6('avg(CASE WHEN down=3 THEN CASE WHEN success=1 THEN 1 ELSE 0 END END)')} AS {p}_third_down_conversion_rate,
      {q6('avg(turnover)')} AS {p}_turnover_rate, {q6('sum(sack)/greatest(sum(dropback),1)')} AS {p}_sack_rate,
      {q6('avg(CASE WHEN garbage=0 THEN ppa END)')} AS {p}_non_garbage_epa FROM en GROUP BY 1, 2"""


def _tgd_sql(p, col):
    return f"""SELECT game_id, {col} AS team, count(*) AS {p}_drives, {q6('avg(is_successful_drive)')} AS {p}_successful_drive_rate,
      {q6('sum(points_on_opps)/greatest(sum(had_scoring_opportunity),1)')} AS {p}_points_per_opportunity FROM dro GROUP BY 1, 2"""


_TG = ["sr", "ypp", "epa_pp", "rush_ypp", "expl_rate_overall_20", "stuff_rate", "havoc_rate", "avg_line_yards", "power_success_rate",
       "third_down_conversion_rate", "turnover_rate", "sack_rate", "non_garbage_epa", "successful_drive_rate", "points_per_opportunity"]


@query("ag3_team_game", uses="plays", sql=f"""{ENRICHED}, {DRIVES_SQL}
    SELECT * FROM ({_tg_sql('off', 'offense')}) FULL JOIN ({_tg_sql('def', 'defense')}) USING (game_id, team)
    LEFT JOIN ({_tgd_sql('off', 'offense')}) USING (game_id, team) LEFT JOIN ({_tgd_sql('def', 'defense')}) USING (game_id, team)""")
def _(d):
    e = enriched(d)
    out = R.team_game(e, R.drives(e, ["quarter", "play_number"]))
    return out.select("game_id", "team", *[f"{p}_{c}" for p in ("off", "def") for c in ("n_rush", "drives")],
                      *[f"n_{p}_plays" for p in ("off", "def")], *[r6(f"{p}_{c}").alias(f"{p}_{c}") for p in ("off", "def") for c in _TG])


@query("ag4_special_teams", uses="plays", sql=f"""{ENRICHED}, {DRIVES_SQL},
    one AS (SELECT game_id, drive_number, CASE WHEN count(*)=1 THEN min(start_yards_to_goal) END AS v FROM dro GROUP BY 1, 2),
    nx AS (SELECT game_id, drive_number, lead(v) OVER (PARTITION BY game_id ORDER BY drive_number) AS nxt FROM one),
    st AS (SELECT e.game_id, offense AS team, CASE WHEN play_type IN {inlist(T.PUNT)} THEN yards_to_goal-(100-nxt) END AS net,
      CASE WHEN play_type IN {inlist(T.FIELD_GOAL)} THEN CASE WHEN yard_line+17<=39 THEN 'short' WHEN yard_line+17<=49 THEN 'mid' WHEN yard_line+17<=100 THEN 'long' END END AS b,
      play_type='Field Goal Good' AS good FROM en e LEFT JOIN nx USING (game_id, drive_number) WHERE play_type IN {inlist(T.PUNT + T.FIELD_GOAL)})
    SELECT game_id, team, {q6('avg(net)')} AS avg_net_punt_yards, """ + ", ".join(
        f"count(*) FILTER (b='{b}') AS fg_attempts_{b}, count(*) FILTER (b='{b}' AND good) AS fg_made_{b}, "
        + q6(f"count(*) FILTER (b='{b}' AND good)/greatest(count(*) FILTER (b='{b}'),1)") + f" AS fg_rate_{b}" for b in ("short", "mid", "long"))
    + " FROM st GROUP BY 1, 2")
def _(d):
    e = enriched(d)
    out = R.special_teams(e, R.drives(e, ["quarter", "play_number"]))
    return out.withColumns({c: r6(c) for c in ("avg_net_punt_yards", "fg_rate_short", "fg_rate_mid", "fg_rate_long")})


@query("ag5_optional_columns", sql=f"""
    SELECT l_suppkey, {q6('avg(l_tax)')} AS tax, {q6('sum(l_quantity)')} AS qty FROM lineitem GROUP BY 1""")
def _(d):
    wanted = {"tax": (["l_tax"], r6(F.avg("l_tax"))), "qty": (["l_quantity"], r6(F.sum("l_quantity"))),
              "absent": (["no_such_column"], F.count("*"))}
    return d.lineitem.groupBy("l_suppkey").agg(*R.present(d.lineitem, wanted))


@query("ag6_recency_season", uses="sides", sql="""
    WITH s AS (SELECT season, team, CAST(points_for AS DOUBLE) AS x, row_number() OVER (PARTITION BY season, team ORDER BY week DESC, game_id DESC, side DESC) AS rn FROM sides),
    w AS (SELECT *, greatest(5 - rn, 1) AS w FROM s)
    SELECT season, team, count(*) AS games_played, """ + q6("coalesce(sum(x*w),0)/sum(w)") + " AS x, " + ", ".join(
        q6(f"avg(x) FILTER (rn<={k})") + f" AS x_last_{k}" for k in (1, 2, 3)) + " FROM w GROUP BY 1, 2")
def _(d):
    s = d.sides.withColumn("x", F.col("points_for").cast("double"))
    out = R.recency_season(s, ["season", "team"], ["week", "game_id", "side"], ["x"])
    return out.withColumns({c: r6(c) for c in ("x", "x_last_1", "x_last_2", "x_last_3")})


@query("ag7_luck", uses="plays", sql=f"""{ENRICHED},
    t AS (SELECT week, game_id, offense AS team, -turnover AS v FROM en UNION ALL SELECT week, game_id, defense, turnover FROM en),
    g AS (SELECT week, game_id, team, CAST(sum(v) AS BIGINT) AS luck FROM t GROUP BY 1, 2, 3)
    SELECT *, CAST(sum(luck) OVER (PARTITION BY team ORDER BY week, game_id) AS BIGINT) AS season_luck FROM g""")
def _(d):
    w = Window.partitionBy("season", "team").orderBy("week", "game_id").rowsBetween(Window.unboundedPreceding, 0)
    return R.luck(enriched(d)).withColumn("season_luck", F.sum("luck").over(w)).drop("season")


_LONG = [("ppa_per_play", "ppa", "true"), ("epa_pass", "ppa", "dropback=1"), ("epa_rush", "ppa", "rush_attempt=1 AND dropback=0"),
         ("early_down_epa", "ppa", "down<=2"), ("conv_rate_3rd_4th", "CAST(yards>=CASE WHEN yards_to_first>0 THEN yards_to_first ELSE yards_to_goal END AS INT)", "down>=3"),
         ("success_rate", "success", "true"), ("explosive_rate", "CAST(yards>=20 AS INT)", "true"), ("turnover_rate", "turnover", "true")]
LONG_SQL = f"""{ENRICHED}, ro AS (SELECT *, offense AS team, 'offense' AS role FROM en WHERE eligible UNION ALL SELECT *, defense, 'defense' FROM en WHERE eligible),
    long AS (""" + " UNION ALL ".join(
    f"SELECT season, team, role, '{n}' AS metric, CAST(avg({x}) FILTER ({w}) AS DOUBLE) AS value, count({x}) FILTER ({w}) AS n FROM ro GROUP BY 1, 2, 3" for n, x, w in _LONG) + ")"


def long_measures(d):
    return M.role_measures(enriched(d).where(P.eligible_play()), ["season"])


@query("ag8_long_team_measures", uses="plays", sql=f"{LONG_SQL} SELECT season, team, role, metric, {q6('value')} AS value, CAST(n AS DOUBLE) AS n FROM long")
def _(d):
    return long_measures(d).select("season", "team", "role", "metric", r6("value").alias("value"), F.col("denominator").alias("n"))


@query("ag9_ratio_exclusions", uses="exposures", sql=f"""
    SELECT season, offense, {q6('sum(num) FILTER (ok)', 2)} AS numerator, {q6('sum(den) FILTER (ok)')} AS denominator, count(*) FILTER (ok) AS games_counted,
      count(*) FILTER (NOT ok) AS games_excluded, {q6('sum(num) FILTER (ok)/sum(den) FILTER (ok)', 4)} AS value
    FROM (SELECT *, flag<>'R' AND den>=3 AS ok FROM exposures) GROUP BY 1, 2""")
def _(d):
    why = F.when(F.col("flag") == "R", "returned").when(F.col("den") < 3, "small")
    out = R.ratio_with_exclusions(d.exposures, ["season", "offense"], "num", "den", why, "game_id")
    return out.withColumns({"numerator": r6("numerator", 2), "denominator": r6("denominator"), "value": r6("value", 4)})


@query("ag9_exclusion_examples", uses="exposures", sql="""
    SELECT season, offense, game_id, CASE WHEN flag='R' THEN 'returned' ELSE 'small' END AS reason FROM exposures WHERE flag='R' OR den<3""")
def _(d):
    why = F.when(F.col("flag") == "R", "returned").when(F.col("den") < 3, "small")
    return R.exclusion_list(d.exposures, ["season", "offense"], why, "game_id")


@query("ag10_team_game_charts", uses="plays", sql=f"""{ENRICHED},
    o AS (SELECT game_id, offense AS team, defense AS opponent, count(*) FILTER (eligible) AS plays, count(success) FILTER (eligible) AS sn, sum(success) FILTER (eligible) AS ss,
          sum(ppa) FILTER (eligible) AS es, count(ppa) FILTER (eligible) AS en FROM en GROUP BY 1, 2, 3),
    k AS (SELECT game_id, team, opponent FROM o UNION SELECT game_id, opponent, team FROM o)
    SELECT k.game_id, k.team, k.opponent, """ + ", ".join(
        f"CAST({s}.plays AS DOUBLE) AS {p}_plays, {q6(s + '.ss')} AS {p}_success_sum, {q6(s + '.es')} AS {p}_epa_sum" for s, p in (("a", "off"), ("b", "def")))
    + " FROM k LEFT JOIN o a ON a.game_id=k.game_id AND a.team=k.team AND a.opponent=k.opponent LEFT JOIN o b ON b.game_id=k.game_id AND b.team=k.opponent AND b.opponent=k.team")
def _(d):
    ok = P.eligible_play()
    sums = {"plays": F.sum(P.flag(ok)).cast("double"), "success_sum": F.sum(F.when(ok, F.col("success"))), "epa_sum": F.sum(F.when(ok, F.col("ppa")))}
    out = R.mirrored_sums(enriched(d), ["game_id"], sums)
    return out.withColumns({c: r6(c) for c in ("off_success_sum", "off_epa_sum", "def_success_sum", "def_epa_sum")})


@query("ag11_team_game_yardage", uses="plays", sql=f"""{ENRICHED}
    SELECT game_id, offense AS team, count(*) FILTER (eligible) AS plays, CAST(sum(yards) FILTER (eligible AND rush_attempt=1) AS DOUBLE) AS rush_yards,
      CAST(sum(yards) FILTER (eligible AND dropback=1) AS DOUBLE) AS pass_yards, count(*) FILTER (eligible AND yards>=20) AS big FROM en GROUP BY 1, 2""")
def _(d):
    ok = P.eligible_play()
    return enriched(d).groupBy("game_id", F.col("offense").alias("team")).agg(
        F.count(F.when(ok, 1)).alias("plays"), F.sum(F.when(ok & (F.col("rush_attempt") == 1), F.col("yards"))).alias("rush_yards"),
        F.sum(F.when(ok & (F.col("dropback") == 1), F.col("yards"))).alias("pass_yards"), F.count(F.when(ok & (F.col("yards") >= 20), 1)).alias("big"))


@query("ag12_stream_maximum", uses="plays", sql="""
    SELECT game_id, team, max(s) AS points FROM (SELECT game_id, offense AS team, offense_score AS s FROM plays UNION ALL SELECT game_id, defense, defense_score FROM plays) GROUP BY 1, 2""")
def _(d):
    return R.stream_points(d.plays)


@query("ag13_possession_totals", uses="plays", sql=f"""{ENRICHED},
    p AS (SELECT game_id, offense, drive_number, bool_or(eligible) AS ok, bool_or(eligible) AND bool_or(NOT eligible) AS mixed, sum(ppa) FILTER (eligible) AS ppa,
      count(*) FILTER (eligible AND ppa IS NULL)=0 AS ppa_valid, sum(scoring) FILTER (eligible) AS pts, sum(scoring) FILTER (NOT eligible) AS other FROM en GROUP BY 1, 2, 3)
    SELECT game_id, offense AS team, count(*) FILTER (ok) AS possessions, bool_or(mixed) AS any_mixed, {q6('sum(ppa)')} AS ppa, bool_and(ppa_valid) AS ppa_valid,
      CAST(coalesce(sum(pts),0) AS BIGINT) AS offense_points, CAST(coalesce(sum(other),0) AS BIGINT) AS excluded_points FROM p GROUP BY 1, 2""")
def _(d):
    ok = P.eligible_play()
    p = enriched(d).groupBy("game_id", "offense", "drive_number").agg(
        F.bool_or(ok).alias("ok"), (F.bool_or(ok) & F.bool_or(~ok)).alias("mixed"), F.sum(F.when(ok, F.col("ppa"))).alias("ppa"),
        (F.count(F.when(ok & F.col("ppa").isNull(), 1)) == 0).alias("ppa_valid"),
        F.sum(F.when(ok, F.col("scoring"))).alias("pts"), F.sum(F.when(~ok, F.col("scoring"))).alias("other"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return p.groupBy("game_id", F.col("offense").alias("team")).agg(
        F.count(F.when(F.col("ok"), 1)).alias("possessions"), F.bool_or("mixed").alias("any_mixed"), r6(F.sum("ppa")).alias("ppa"),
        F.bool_and("ppa_valid").alias("ppa_valid"), zero("pts").alias("offense_points"), zero("other").alias("excluded_points"))


@query("ag14_measurement_grid", uses="plays", sql=f"""{LONG_SQL}, ms AS (SELECT * FROM (VALUES {", ".join(f"('{n}')" for n, _, _ in _LONG)}) m(metric)),
    tr AS (SELECT DISTINCT team, role FROM long)
    SELECT team, role, metric, coalesce(n, 0)>0 AS usable, CASE WHEN coalesce(n, 0)=0 THEN 'no_exposure' END AS reason FROM tr CROSS JOIN ms LEFT JOIN long USING (team, role, metric)""")
def _(d):
    long = long_measures(d)
    grid = J.complete_grid(long.select("team", "role").distinct(), long.select("team", "role", "metric", "denominator"), ["team", "role"],
                           {"metric": list(M.REGISTRY)}, "denominator")
    usable = F.coalesce("denominator", F.lit(0.0)) > 0
    return grid.select("team", "role", "metric", usable.alias("usable"), F.when(~usable, "no_exposure").alias("reason"))


@query("ag15_raw_observations", uses="plays", sql=f"""{ENRICHED}
    SELECT game_id, offense AS team, defense AS opponent, 'rush_yards' AS measurement, CAST(sum(yards) FILTER (rush_attempt=1) AS DOUBLE) AS numerator, count(*) FILTER (rush_attempt=1)::DOUBLE AS denominator FROM en WHERE eligible GROUP BY 1, 2, 3
    UNION ALL SELECT game_id, offense, defense, 'pass_yards', CAST(sum(yards) FILTER (dropback=1) AS DOUBLE), count(*) FILTER (dropback=1)::DOUBLE FROM en WHERE eligible GROUP BY 1, 2, 3""")
def _(d):
    specs = [M.mean_metric("rush_yards", "yards", "rush_attempt = 1"), M.mean_metric("pass_yards", "yards", "dropback = 1")]
    wide = enriched(d).where(P.eligible_play()).groupBy("game_id", F.col("offense").alias("team"), F.col("defense").alias("opponent")).agg(*M.sums(specs))
    return M.to_long(wide, ["game_id", "team", "opponent"], specs).drop("value").withColumnRenamed("metric", "measurement")


@query("ag16_factor_measures", uses="plays", sql=f"""{ENRICHED},
    n AS (SELECT *, CASE WHEN yards_to_first<=0 OR yards_to_first>=yards_to_goal THEN yards_to_goal ELSE yards_to_first END AS need FROM en WHERE eligible),
    s AS (SELECT *, yards >= need*CASE down WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 1.0 END AS ok FROM n),
    dv AS (SELECT game_id, offense, drive_number, bool_or(yards_to_goal<=40) AS opp, max(scoring) AS pts FROM s GROUP BY 1, 2, 3)
    SELECT game_id, team, plays, successes, explosiveness, opportunities, CASE WHEN opportunities>0 THEN finishing END AS finishing, CASE WHEN opportunities=0 THEN 'no_opportunity' END AS missing_reason FROM
      (SELECT game_id, offense AS team, count(*) AS plays, count(*) FILTER (ok) AS successes, {q6('avg(ppa) FILTER (ok)')} AS explosiveness FROM s GROUP BY 1, 2)
      JOIN (SELECT game_id, offense AS team, count(*) FILTER (opp) AS opportunities, {q6('avg(CASE WHEN pts>=7 THEN 7 WHEN pts=3 THEN 3 ELSE 0 END) FILTER (opp)')} AS finishing FROM dv GROUP BY 1, 2) USING (game_id, team)""")
def _(d):
    p = enriched(d).where(P.eligible_play())
    need = F.when((F.col("yards_to_first") <= 0) | (F.col("yards_to_first") >= F.col("yards_to_goal")), F.col("yards_to_goal")).otherwise(F.col("yards_to_first"))
    share = F.when(F.col("down") == 1, 0.5).when(F.col("down") == 2, 0.7).otherwise(1.0)
    p = p.withColumn("ok", F.col("yards") >= need * share)
    # one pass to drives, then drives to games: the play table is shuffled once
    dv = p.groupBy("game_id", "offense", "drive_number").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("s"), F.sum(F.when(F.col("ok"), F.col("ppa"))).alias("e"),
        F.count(F.when(F.col("ok"), F.col("ppa"))).alias("en"), F.bool_or(F.col("yards_to_goal") <= 40).alias("opp"), F.max("scoring").alias("pts"))
    finish = F.when(F.col("pts") >= 7, 7).when(F.col("pts") == 3, 3).otherwise(0)
    out = dv.groupBy("game_id", F.col("offense").alias("team")).agg(
        F.sum("n").alias("plays"), F.sum("s").alias("successes"), r6(F.sum("e") / F.expr("nullif(sum(en), 0)")).alias("explosiveness"),
        F.count(F.when(F.col("opp"), 1)).alias("opportunities"), r6(F.avg(F.when(F.col("opp"), finish))).alias("finishing"))
    return out.withColumn("missing_reason", F.when(F.col("opportunities") == 0, "no_opportunity"))


@query("ag17_earlier_scale", uses="exposures", sql=f"""
    WITH v AS (SELECT season, offense, sum(num)/sum(den) AS v FROM exposures GROUP BY 1, 2), p AS (SELECT season AS s, avg(v) AS c, greatest(stddev_pop(v), 1e-6) AS k FROM v GROUP BY 1),
    t AS (SELECT DISTINCT season FROM v)
    SELECT t.season, CAST(max(p.s) AS DOUBLE) AS source_season, {q6('coalesce(arg_max(p.c, p.s), 0)', 4)} AS center, {q6('coalesce(arg_max(p.k, p.s), 1)', 4)} AS scale FROM t LEFT JOIN p ON p.s < t.season GROUP BY 1""")
def _(d):
    v = d.exposures.groupBy("season", "offense").agg((F.sum("num") / F.sum("den")).alias("v")).withColumn("metric", F.lit("v"))
    out = R.earlier_scale(v, v, ["metric"], "v")
    return out.select("season", F.col("source_season").cast("double"), r6("center", 4).alias("center"), r6("scale", 4).alias("scale"))


@query("ag18_weighted_center", uses="exposures", sql=f"""
    SELECT season, flag, {q6('sum(num/den*den)/sum(den)', 4)} AS center FROM exposures GROUP BY 1, 2""")
def _(d):
    e = d.exposures.withColumn("v", F.col("num") / F.col("den"))
    return R.weighted_center(e, ["season", "flag"], "v", "den").withColumn("center", r6("center", 4))


@query("ag19_stage_coverage", uses="games", sql=f"""
    WITH s AS (SELECT season, 'outcome' AS stage, completed AS st FROM games UNION ALL SELECT season, 'scored', home_points>10 FROM games)
    SELECT season, stage, count(*) AS denominator, count(*) FILTER (st) AS admitted, count(*) FILTER (NOT st) AS excluded, count(*) FILTER (st IS NULL) AS unresolved,
      {q6('count(*) FILTER (st)/count(*)')} AS rate FROM s GROUP BY 1, 2""")
def _(d):
    out = R.stage_coverage(d.games, ["season"], "game_id", {"outcome": F.col("completed"), "scored": F.col("home_points") > 10})
    return out.withColumn("rate", r6("rate"))


@query("ag20_group_and_pooled", uses="graded", sql=f"""
    SELECT coalesce(CAST(season AS VARCHAR), 'pooled') AS season, target, count(*) AS n, {q6('avg(abs(actual-prediction))')} AS mae FROM graded
    GROUP BY GROUPING SETS ((season, target), (target))""")
def _(d):
    err = F.abs(F.col("actual") - F.col("prediction"))
    out = R.by_group_and_pooled(d.graded, "season", ["target"], [F.count("*").alias("n"), r6(F.avg(err)).alias("mae")])
    return out.select(F.coalesce(F.col("season").cast("string"), F.lit("pooled")).alias("season"), "target", "n", "mae")


@query("ag21_terciles", uses="graded", sql=f"""
    WITH e AS (SELECT target, quantile_cont(line, [1/3, 2/3]) AS q FROM graded GROUP BY 1)
    SELECT target, CASE WHEN line<=q[1] THEN 'low' WHEN line<=q[2] THEN 'mid' ELSE 'high' END AS band, count(*) AS n, {q6('avg(actual-prediction)')} AS bias FROM graded JOIN e USING (target) GROUP BY 1, 2""")
def _(d):
    edges = R.quantile_edges(d.graded, ["target"], "line", 3)
    g = d.graded.join(edges, "target")
    band = label_by_edges(F.col("line"), [F.col("edges")[0], F.col("edges")[1]], ["low", "mid", "high"])
    return g.groupBy("target", band.alias("band")).agg(F.count("*").alias("n"), r6(F.avg(F.col("actual") - F.col("prediction"))).alias("bias"))


@query("ag22_median", uses="quotes", sql=f"SELECT game_id, {q6('median(total)')} AS med, count(DISTINCT provider) AS providers FROM quotes GROUP BY 1")
def _(d):
    return d.quotes.groupBy("game_id").agg(r6(F.median(F.col("total").cast("double"))).alias("med"), F.count_distinct("provider").alias("providers"))


@query("ag23_correlation", uses="graded", sql=f"""
    SELECT coalesce(CAST(season AS VARCHAR), 'pooled') AS season, target, {q6('corr(actual, prediction)')} AS r FROM graded GROUP BY GROUPING SETS ((season, target), (target))""")
def _(d):
    out = R.by_group_and_pooled(d.graded, "season", ["target"], [r6(F.corr("actual", "prediction")).alias("r")])
    return out.withColumn("season", F.coalesce(F.col("season").cast("string"), F.lit("pooled")))


@query("ag24_simple_regression", uses="graded", sql=f"""
    SELECT target, {q6('regr_slope(actual, line)')} AS slope, {q6('regr_intercept(actual, line)')} AS level, {q6('regr_r2(actual, line)')} AS r2 FROM graded GROUP BY 1""")
def _(d):
    return d.graded.groupBy("target").agg(r6(F.regr_slope("actual", "line")).alias("slope"), r6(F.regr_intercept("actual", "line")).alias("level"),
                                          r6(F.regr_r2("actual", "line")).alias("r2"))


@query("ag25_iqr_outliers", sql="""
    WITH q AS (SELECT event_type, quantile_cont(value, [0.25, 0.75]) AS q FROM events GROUP BY 1)
    SELECT event_id FROM events JOIN q USING (event_type) WHERE value < q[1]-1.5*(q[2]-q[1]) OR value > q[2]+1.5*(q[2]-q[1])""")
def _(d):
    return R.iqr_outliers(d.events, ["event_type"], "value").select("event_id")


def _moves(d):
    return d.orders.select(F.year("o_orderdate").alias("season"), (F.col("o_totalprice") / 1000).alias("rating"),
                           (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_qb"),
                           F.floor(F.col("o_custkey") / 5).alias("origin"),
                           F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_orderkey") / 50)).alias("destination"))


@query("ag26_transfers", sql=f"""
    WITH m AS (SELECT year(o_orderdate) AS season, o_totalprice/1000 AS r, CAST(o_orderpriority='1-URGENT' AS INT) AS qb, o_custkey//5 AS o,
      CASE WHEN o_orderstatus<>'P' THEN o_orderkey//50 END AS dst FROM orders),
    i AS (SELECT season, dst AS team, count(*) AS n, sum(r) AS r, sum(qb) AS qb FROM m WHERE dst IS NOT NULL GROUP BY 1, 2), u AS (SELECT season, o AS team, count(*) AS n, sum(r) AS r, sum(qb) AS qb FROM m GROUP BY 1, 2)
    SELECT CAST(season AS INT) AS season, team, coalesce(i.n,0) AS in_count, coalesce(u.n,0) AS out_count, {q6('coalesce(i.r,0)')} AS in_rating, {q6('coalesce(u.r,0)')} AS out_rating,
      CAST(coalesce(i.qb,0) AS BIGINT) AS in_qb, CAST(coalesce(u.qb,0) AS BIGINT) AS out_qb, coalesce(i.n,0)-coalesce(u.n,0) AS net_count FROM i FULL JOIN u USING (season, team)""")
def _(d):
    return R.transfer_balance(_moves(d)).withColumns({"in_rating": r6("in_rating"), "out_rating": r6("out_rating")})


@query("ag27_rolling_recruiting", uses="exposures", sql=f"""
    WITH y AS (SELECT offense AS team, season, CASE WHEN (offense+season)%5<>0 THEN sum(den) END AS v FROM exposures WHERE (offense+season)%7<>0 GROUP BY 1, 2),
    w AS (SELECT *, count(v) OVER f AS years, avg(v) OVER f AS mean, arg_min(CASE WHEN v IS NOT NULL THEN v END, season) OVER f AS o1, first_value(v) OVER f AS oldest FROM y
          WINDOW f AS (PARTITION BY team ORDER BY season RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT team, season, years, {q6('mean')} AS mean, {q6('CASE WHEN years=4 THEN mean END')} AS strict_mean, {q6('v-oldest')} AS trend,
      CASE WHEN years=0 THEN 'no_history' WHEN years<4 THEN 'short_history' END AS missing_reason FROM w""")
def _(d):
    y = d.exposures.withColumnRenamed("offense", "team").where("(team + season) % 7 <> 0").groupBy("team", "season").agg(F.sum("den").alias("v"))
    y = y.withColumn("v", F.when((F.col("team") + F.col("season")) % 5 != 0, F.col("v")))
    out = R.rolling_years(y, ["team"], "season", "v")
    return out.select("team", "season", "years", r6("mean").alias("mean"), r6("strict_mean").alias("strict_mean"), r6("trend").alias("trend"), "missing_reason")


@query("ag28_returning_production", sql=f"""
    SELECT CAST(c_custkey//5 AS BIGINT) AS team, {q6('max(CASE WHEN c_mktsegment<>\'BUILDING\' THEN c_acctbal END)')} AS returning_share,
      CASE WHEN max(CASE WHEN c_mktsegment<>'BUILDING' THEN c_acctbal END) IS NULL THEN 'no_source_row' END AS missing_reason FROM customer GROUP BY 1""")
def _(d):
    raw = d.customer.select(F.floor(F.col("c_custkey") / 5).alias("team"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("a"),
                            F.lit(None).cast("double").alias("b"))
    out = raw.groupBy("team").agg(r6(F.max(F.coalesce("b", "a"))).alias("returning_share"))
    return out.withColumn("missing_reason", F.when(F.col("returning_share").isNull(), "no_source_row"))


@query("ag29_roster_continuity", sql=f"""
    WITH r AS (SELECT year(o_orderdate) AS season, o_custkey AS id, o_custkey//5 + CASE WHEN o_totalprice>400000 THEN 1 ELSE 0 END AS team, o_orderpriority='1-URGENT' AS qb FROM orders),
    one AS (SELECT season, id, min(team) AS team, bool_or(qb) AS qb FROM r GROUP BY 1, 2 HAVING min(team)=max(team))
    SELECT CAST(c.season AS INT) AS season, c.team, count(*) AS players, count(*) FILTER (p.team=c.team) AS returning, count(*) FILTER (p.team<>c.team) AS incoming,
      count(*) FILTER (p.team=c.team AND c.qb) AS returning_qbs, {q6('count(*) FILTER (p.team=c.team)/count(*)')} AS share_returning
    FROM one c LEFT JOIN one p ON p.id=c.id AND p.season=c.season-1 GROUP BY 1, 2""")
def _(d):
    roster = d.orders.select(F.year("o_orderdate").alias("season"), F.col("o_custkey").alias("id"),
                             (F.floor(F.col("o_custkey") / 5) + (F.col("o_totalprice") > 400000).cast("int")).alias("team"),
                             F.when(F.col("o_orderpriority") == "1-URGENT", "QB").otherwise("OL").alias("position"))
    return R.roster_continuity(roster).withColumn("share_returning", r6("share_returning"))


@query("ag30_coach_tenure", sql="""
    WITH s AS (SELECT DISTINCT o_custkey AS coach, o_orderkey%3 AS school3, o_custkey//5 AS school, CAST(year(o_orderdate) AS INT) AS y FROM orders WHERE year(o_orderdate)<=2000),
    d AS (SELECT DISTINCT coach, school, y FROM s), i AS (SELECT *, y - row_number() OVER (PARTITION BY coach, school ORDER BY y) AS isl FROM d),
    r AS (SELECT coach, school, isl, count(*) AS tenure, max(y) AS last FROM i GROUP BY 1, 2, 3)
    SELECT school, max(tenure) AS tenure, arg_max(coach, struct_pack(a := tenure, b := coach)) AS coach, count(*) AS coaches, max(tenure)=1 AS new_coach FROM r WHERE last=2000 GROUP BY 1""")
def _(d):
    nested = d.orders.groupBy(F.col("o_custkey").alias("coach")).agg(F.collect_set(F.struct(
        F.year("o_orderdate").alias("year"), F.floor(F.col("o_custkey") / 5).alias("school"))).alias("seasons"))
    return R.coach_tenure(nested.select("coach", F.inline("seasons")), 2000)


@query("ag31_lagged_polls", uses="sides exposures", sql="""
    WITH p AS (SELECT season, week, offense AS team, CAST(den AS INT) AS rank FROM exposures),
    wk AS (SELECT DISTINCT season, week AS pw FROM p), sw AS (SELECT s.season, s.week, max(pw) AS poll_week FROM (SELECT DISTINCT season, week FROM sides) s JOIN wk ON wk.season=s.season AND pw<s.week GROUP BY 1, 2),
    r AS (SELECT season, week AS poll_week, team, min(rank) AS lo, max(rank) AS hi FROM p GROUP BY 1, 2, 3)
    SELECT game_id, side, CAST(poll_week AS DOUBLE) AS poll_week, CAST(CASE WHEN poll_week IS NOT NULL AND coalesce(lo=hi, true) THEN coalesce(lo, 26) END AS DOUBLE) AS rank,
      CASE WHEN poll_week IS NULL THEN 'no_earlier_poll' WHEN lo<>hi THEN 'conflicting_rows' END AS reason
    FROM sides LEFT JOIN sw USING (season, week) LEFT JOIN r USING (season, poll_week, team)""")
def _(d):
    polls = d.exposures.select("season", "week", F.col("offense").alias("team"), F.col("den").cast("int").alias("rank"))
    out = R.lagged_poll_rank(d.sides.select("game_id", "side", "season", "week", "team"), polls)
    return out.select("game_id", "side", F.col("poll_week").cast("double"), F.col("rank").cast("double"), "reason")


@query("ag33_null_exposure", uses="plays", sql=f"""
    SELECT game_id, offense, count(*) FILTER ({ELIGIBLE_SQL}) AS eligible, count(*) FILTER ({ELIGIBLE_SQL} AND ppa IS NULL) AS null_ppa FROM plays GROUP BY 1, 2""")
def _(d):
    ok = P.eligible_play()
    return d.plays.groupBy("game_id", "offense").agg(F.count(F.when(ok, 1)).alias("eligible"), F.count(F.when(ok & F.col("ppa").isNull(), 1)).alias("null_ppa"))


@query("ag34_weekly_records", uses="graded", sql=f"""
    WITH r AS (SELECT season, week, count(*) FILTER ((prediction-line)*(actual-line)>0) AS w, count(*) FILTER ((prediction-line)*(actual-line)<0) AS l,
      count(*) FILTER ((prediction-line)*(actual-line)=0) AS p FROM graded GROUP BY 1, 2),
    c AS (SELECT *, CAST(sum(w) OVER x AS BIGINT) AS cum_w, CAST(sum(l) OVER x AS BIGINT) AS cum_l FROM r WINDOW x AS (PARTITION BY season ORDER BY week))
    SELECT *, {q6('w/(w+l)')} AS win_rate, {q6('(w*100.0/110-l)/(w+l+p)')} AS roi, {q6('cum_w/(cum_w+cum_l)')} AS cum_rate FROM c""")
def _(d):
    from ..operators.evaluate import weekly_records
    out = weekly_records(d.graded, (F.col("prediction") - F.col("line")) * (F.col("actual") - F.col("line")), ["season"], "week")
    return out.withColumns({c: r6(c) for c in ("win_rate", "roi", "cum_rate")})


@query("ag35_performance_split", uses="graded", sql=f"""
    SELECT coalesce(kind, 'all') AS kind, target, count(*) AS n, {q6('avg(abs(actual-prediction))')} AS mae, {q6('avg(CAST(abs(actual-prediction)<=1.959963984540054*sigma AS INT))')} AS coverage_95,
      count(*) FILTER (week<20) AS before_week, count(*) FILTER (week=20) AS at_week
    FROM (SELECT *, CASE WHEN season<2000 THEN 'replay' ELSE 'live' END AS kind FROM graded) GROUP BY GROUPING SETS ((kind, target), (target))""")
def _(d):
    g = d.graded.withColumn("kind", F.when(F.col("season") < 2000, "replay").otherwise("live"))
    err = F.abs(F.col("actual") - F.col("prediction"))
    out = R.by_group_and_pooled(g, "kind", ["target"], [
        F.count("*").alias("n"), r6(F.avg(err)).alias("mae"), r6(F.avg((err <= 1.959963984540054 * F.col("sigma")).cast("int"))).alias("coverage_95"),
        F.count(F.when(F.col("week") < 20, 1)).alias("before_week"), F.count(F.when(F.col("week") == 20, 1)).alias("at_week")])
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("ag36_model_vs_line", uses="graded", sql=f"""
    WITH e AS (SELECT target, abs(actual-prediction) AS m, abs(actual-line) AS l, prediction-line AS lean FROM graded)
    SELECT target, {q6('avg(m)')} AS model_miss, {q6('avg(l)')} AS line_miss, {q6('avg(lean)')} AS lean, count(*) FILTER (m<l) AS model_closer, count(*) FILTER (m>l) AS line_closer,
      count(*) FILTER (m=l) AS ties, count(*) FILTER (m>=21) AS big_misses FROM e GROUP BY 1""")
def _(d):
    from ..operators.evaluate import model_vs_line
    out = model_vs_line(d.graded, ["target"], 21)
    return out.withColumns({c: r6(c) for c in ("model_miss", "line_miss", "lean")})


@query("ag37_season_zscores", uses="exposures", sql=f"""
    WITH v AS (SELECT season, offense, sum(den) AS v FROM exposures GROUP BY 1, 2)
    SELECT season, offense, {q6('(v-avg(v) OVER (PARTITION BY season))/stddev_pop(v) OVER (PARTITION BY season)')} AS z FROM v""")
def _(d):
    v = d.exposures.groupBy("season", "offense").agg(F.sum("den").alias("v"))
    scale = v.groupBy("season").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return v.join(scale, "season").select("season", "offense", r6((F.col("v") - F.col("m")) / F.col("s")).alias("z"))


@query("ag38_explosiveness_alternatives", uses="plays", sql=f"""{ENRICHED},
    t AS (SELECT week, offense, avg(CASE WHEN yards>=20 THEN 1.0 ELSE 0.0 END) AS rate, median(yards) FILTER (success=1) AS med FROM en WHERE eligible GROUP BY 1, 2)
    SELECT week, count(*) AS teams, {q6('corr(rate, med)')} AS r FROM t GROUP BY 1""")
def _(d):
    t = enriched(d).where(P.eligible_play()).groupBy("week", "offense").agg(
        F.avg((F.col("yards") >= 20).cast("int")).alias("rate"), F.median(F.when(F.col("success") == 1, F.col("yards"))).alias("med"))
    return t.groupBy("week").agg(F.count("*").alias("teams"), r6(F.corr("rate", "med")).alias("r"))


@query("ag39_distinct_counts", uses="quotes exposures", sql="""
    SELECT offense AS team, count(DISTINCT game_id) AS games, count(DISTINCT defense) AS opponents FROM exposures GROUP BY 1""")
def _(d):
    return d.exposures.groupBy(F.col("offense").alias("team")).agg(F.count_distinct("game_id").alias("games"), F.count_distinct("defense").alias("opponents"))
