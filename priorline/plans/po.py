"""Population, gating, serving and web-table queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import plays as P
from ..operators import adjust as A, forecast as M, joins as J, market as K, population as O, quality as Q, ratings as R, rollup as RU, scan, windows as W
from ..sources import lake
from .ag import DRIVES_SQL, ENRICHED, enriched
from .mk import MARKET, chain
from .registry import q6, query, r6
from .wn import TEAM_RATING, _ratings


@query("po1_population", uses="games", sql="""
    WITH p AS (SELECT DISTINCT l_orderkey AS game_id FROM lineitem WHERE l_quantity>5), s AS (SELECT DISTINCT l_orderkey AS game_id FROM lineitem WHERE l_quantity>20),
    x AS (SELECT g.*, p.game_id IS NOT NULL AS hp, s.game_id IS NOT NULL AS hs FROM games g LEFT JOIN p USING (game_id) LEFT JOIN s USING (game_id))
    SELECT game_id, coalesce(completed AND home_points<>away_points, false) AS outcome_valid, concat_ws(',', CASE WHEN NOT hp THEN 'plays' END, CASE WHEN NOT hs THEN 'stats' END) AS missing_sources,
      coalesce(completed AND home_points<>away_points, false) AND hp AND hs AS measurement_usable,
      CASE WHEN NOT completed THEN 'not_played' WHEN home_points=away_points THEN 'invalid_outcome' WHEN hp AND hs THEN 'usable' WHEN neutral THEN 'declared_omission' ELSE 'undeclared_gap' END AS disposition FROM x""")
def _(d):
    li = d.lineitem.withColumnRenamed("l_orderkey", "game_id")
    out = O.reconcile(d.games.select("game_id", "completed"), d.games.where("completed").select("game_id", (F.col("home_points") != F.col("away_points")).alias("valid")),
                      {"plays": li.where("l_quantity > 5"), "stats": li.where("l_quantity > 20")}, d.games.where("neutral").select("game_id", F.lit("x").alias("omission")))
    return out.select("game_id", "outcome_valid", "missing_sources", "measurement_usable", "disposition")


@query("po2_exact_population", uses="games", sql="SELECT season, count(*) AS games FROM games WHERE completed GROUP BY 1")
def _(d):
    g = d.games.where("completed")
    n = g.count()
    checked = O.require_counts(g, {"rows": n, "self_play": 0}, {"rows": F.lit(True), "self_play": F.col("home") == F.col("away")})
    return checked.groupBy("season").agg(F.count("*").alias("games"))


@query("po3_coverage_gate", uses="games", sql=f"""
    SELECT t.season, {q6('r.rate')} AS rate, CASE WHEN r.rate IS NULL THEN 'absent' WHEN r.rate<0.665 THEN 'below' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT season+1 AS season FROM games) t
    LEFT JOIN (SELECT season, avg(CAST(completed AS INT)) AS rate FROM games GROUP BY 1) r USING (season)""")
def _(d):
    cov = d.games.groupBy("season").agg(F.avg(F.col("completed").cast("int")).alias("rate"))
    th = d.games.select((F.col("season") + 1).alias("season")).distinct().withColumn("minimum", F.lit(0.665))
    return O.coverage_gate(cov, th, ["season"]).select("season", r6("rate").alias("rate"), "verdict")


@query("po4_omission_reasons", uses="games", sql="""
    WITH p AS (SELECT DISTINCT l_orderkey AS game_id FROM lineitem), g AS (SELECT game_id FROM games WHERE game_id NOT IN (SELECT game_id FROM p)), dcl AS (SELECT game_id FROM games WHERE neutral)
    SELECT coalesce(g.game_id, dcl.game_id) AS game_id, CASE WHEN g.game_id IS NULL THEN 'unused_declaration' WHEN dcl.game_id IS NULL THEN 'undeclared' ELSE 'no_feed' END AS status FROM g FULL JOIN dcl USING (game_id)""")
def _(d):
    return O.omission_reasons(d.games, d.lineitem.select(F.col("l_orderkey").alias("game_id")), d.games.where("neutral").select("game_id", F.lit("no_feed").alias("reason")))


@query("po5_game_log", uses="exposures games", sql=f"""
    SELECT g.game_id, e.offense AS team, g.week, count(*) AS rows, {q6('sum(den)')} AS exposure, max(e.kickoff) + INTERVAL 6 HOUR AS available FROM exposures e JOIN games g USING (game_id) GROUP BY 1, 2, 3""")
def _(d):
    rows = J.by_size(d.exposures.select("game_id", "offense", "den", F.col("kickoff").alias("at")), ["game_id"])
    j = rows.join(d.games.select("game_id", "week"), "game_id")
    return j.groupBy("game_id", F.col("offense").alias("team"), "week").agg(F.count("*").alias("rows"), r6(F.sum("den")).alias("exposure"),
                                                                       (F.max("at") + F.expr("INTERVAL 6 HOURS")).alias("available"))


@query("po6_terminal_z", uses="exposures", sql=f"""
    WITH v AS (SELECT season, offense AS team, 'offense' AS role, sum(num)/sum(den) AS v FROM exposures GROUP BY 1, 2 UNION ALL SELECT season, defense, 'defense', sum(num)/sum(den) FROM exposures GROUP BY 1, 2),
    s AS (SELECT season, role, avg(v) AS m, stddev_pop(v) AS k FROM v GROUP BY 1, 2)
    SELECT v.season, v.team, v.role, {q6("CASE v.role WHEN 'defense' THEN -1 ELSE 1 END*(v-coalesce(m, 0))/coalesce(k, 1)")} AS z FROM v LEFT JOIN s ON s.season=v.season-1 AND s.role=v.role""")
def _(d):
    v = A.raw_values(A.pair_edges(d.exposures, ["season"]), ["season"])
    sc = RU.earlier_scale(v, v, ["role"], "raw")
    out = v.join(sc, ["season", "role"])
    sign = F.when(F.col("role") == "defense", -1.0).otherwise(1.0)
    return out.select("season", "team", "role", r6(sign * (F.col("raw") - F.col("center")) / F.col("scale")).alias("z"))


@query("po7_evidence_streams", uses="games sides", sql="""
    WITH slots AS (SELECT DISTINCT season, week, kickoff FROM games), src AS (SELECT DISTINCT season, week AS w, kickoff AS k FROM games),
    b AS (SELECT src.season, w, k, min(s.kickoff) AS bk FROM src JOIN slots s ON s.season=src.season AND s.week>w AND s.kickoff>=k+INTERVAL 6 HOUR GROUP BY 1, 2, 3)
    SELECT s.season, s.team, bk AS usable_from, count(*) AS games, CAST(sum(points_for) AS DOUBLE) AS value FROM sides s JOIN b ON b.season=s.season AND b.w=s.week AND b.k=s.kickoff WHERE completed GROUP BY 1, 2, 3""")
def _(d):
    b = W.first_inclusion(d.games).where("boundary_kickoff IS NOT NULL").select("game_id", F.col("boundary_kickoff").alias("usable_from"))
    return d.sides.where("completed").join(b, "game_id").groupBy("season", "team", "usable_from").agg(
        F.count("*").alias("games"), F.sum("points_for").cast("double").alias("value"))


@query("po8_candidate_grid", uses="graded", sql=f"""
    WITH c AS (SELECT a || '|' || b AS candidate, a, b FROM (SELECT unnest(['raw','half']) AS a) CROSS JOIN (SELECT unnest(['none','line']) AS b))
    SELECT candidate, target, count(*) AS n, {q6("avg(abs(prediction*CASE a WHEN 'half' THEN 0.5 ELSE 1 END + CASE b WHEN 'line' THEN 0.5*line ELSE 0 END - actual))")} AS mae FROM graded CROSS JOIN c GROUP BY 1, 2""")
def _(d):
    g = M.candidate_grid(d.graded.select("target", "prediction", "line", "actual"), {"a": ["raw", "half"], "b": ["none", "line"]})
    p = F.col("prediction") * F.when(F.col("a") == "half", 0.5).otherwise(1.0) + F.when(F.col("b") == "line", 0.5 * F.col("line")).otherwise(0.0)
    return g.groupBy("candidate", "target").agg(F.count("*").alias("n"), r6(F.avg(F.abs(p - F.col("actual")))).alias("mae"))


@query("po9_scoreable_games", uses="games exposures", sql="""
    WITH r AS (SELECT DISTINCT season, offense AS team FROM exposures WHERE den>20)
    SELECT game_id FROM games g WHERE completed AND home_points<>away_points AND (season, home) IN (SELECT season, team FROM r) AND (season, away) IN (SELECT season, team FROM r)""")
def _(d):
    r = d.exposures.where("den > 20").select("season", F.col("offense").alias("team")).distinct()
    g = d.games.where("completed AND home_points <> away_points")
    return g.join(r.withColumnRenamed("team", "home"), ["season", "home"], "left_semi").join(r.withColumnRenamed("team", "away"), ["season", "away"], "left_semi").select("game_id")


@query("po10_compact_features", uses="exposures", sql=f"""
    WITH v AS (SELECT season, offense AS team, 'offense' AS role, flag, sum(num)/sum(den) AS v FROM exposures GROUP BY 1, 2, 4 UNION ALL SELECT season, defense, 'defense', flag, sum(num)/sum(den) FROM exposures GROUP BY 1, 2, 4)
    SELECT season, team, {", ".join(q6(f"max(v) FILTER (role='{r}' AND flag='{f}')", 4) + f" AS {r}_{f}" for r in ("offense", "defense") for f in "ANR")} FROM v GROUP BY 1, 2""")
def _(d):
    v = A.raw_values(A.pair_edges(d.exposures, ["season"], metric="flag"), ["season"])
    v = v.withColumn("column", F.concat_ws("_", "role", "metric"))
    names = [f"{r}_{f}" for r in ("offense", "defense") for f in "ANR"]
    return v.groupBy("season", "team").pivot("column", names).agg(r6(F.max("raw"), 4))


@query("po11_fold_standardize", uses="graded", sql=f"""
    WITH m AS (SELECT s.season, avg(g.prediction) AS m, stddev_pop(g.prediction) AS k, count(g.prediction) AS n FROM (SELECT DISTINCT season FROM graded) s LEFT JOIN graded g ON g.season<s.season AND g.target='margin' AND g.stage<>2 GROUP BY 1)
    SELECT game_id, {q6('CASE WHEN n>0 AND k>1e-6 THEN (CASE WHEN stage<>2 THEN prediction ELSE m END - m)/k END')} AS z FROM graded JOIN m USING (season) WHERE target='margin'""")
def _(d):
    g = d.graded.where("target = 'margin'").withColumn("x", F.when(F.col("stage") != 2, F.col("prediction")))
    return M.standardize_by_fold(g, g, ["x"]).select("game_id", r6("z_x").alias("z"))


@query("po12_tournament_table", uses="graded", sql=f"""
    WITH c AS (SELECT season, target, abs(prediction-actual) AS m, abs(line-actual) AS l FROM graded), s AS (SELECT season, target, avg(m) AS m, avg(l) AS l FROM c GROUP BY 1, 2)
    SELECT target, {q6('avg(m)')} AS challenger, {q6('avg(l)')} AS reference, count(*) FILTER (m<l) AS seasons_better, count(*) AS seasons FROM s GROUP BY 1""")
def _(d):
    s = d.graded.groupBy("season", "target").agg(F.avg(F.abs(F.col("prediction") - F.col("actual"))).alias("m"), F.avg(F.abs(F.col("line") - F.col("actual"))).alias("l"))
    return s.groupBy("target").agg(r6(F.avg("m")).alias("challenger"), r6(F.avg("l")).alias("reference"), F.count(F.when(F.col("m") < F.col("l"), 1)).alias("seasons_better"), F.count("*").alias("seasons"))


@query("po13_prediction_population", uses="graded games", sql="""
    SELECT g.season, t.target, count(*) AS expected, count(p.game_id) AS present, count(*)-count(p.game_id) AS missing FROM games g CROSS JOIN (VALUES ('margin'), ('total')) t(target)
    LEFT JOIN (SELECT * FROM graded WHERE line>-13) p ON p.game_id=g.game_id AND p.target=t.target WHERE g.completed GROUP BY 1, 2""")
def _(d):
    p = d.graded.where("line > -13").select("game_id", "target", F.lit(1.0).alias("v"))
    grid = J.complete_grid(d.games.where("completed"), p, ["game_id"], {"target": ["margin", "total"]}, "v").join(d.games.select("game_id", "season"), "game_id")
    return grid.groupBy("season", "target").agg(F.count("*").alias("expected"), F.count("v").alias("present"), F.count("missing_reason").alias("missing"))


@query("po14_measurement_validation", uses="exposures", sql="""
    SELECT 'bad_role' AS rule, count(*) FILTER (flag='R') AS n FROM exposures UNION ALL SELECT 'empty_denominator', count(*) FILTER (den<=0) FROM exposures UNION ALL SELECT 'negative_numerator', count(*) FILTER (num<1000) FROM exposures""")
def _(d):
    out = d.exposures.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("bad_role", F.col("flag") == "R"), ("empty_denominator", F.col("den") <= 0), ("negative_numerator", F.col("num") < 1000))])
    return out.unpivot([], ["bad_role", "empty_denominator", "negative_numerator"], "rule", "n")


@query("po15_source_availability", uses="games", sql="""
    WITH s AS (SELECT season, 'plays' AS source, count(*) AS targets, count(*) FILTER (game_id IN (SELECT l_orderkey FROM lineitem)) AS found FROM games GROUP BY 1
      UNION ALL SELECT season, 'finals', count(*), count(*) FILTER (game_id IN (SELECT game_id FROM games WHERE completed)) FROM games GROUP BY 1)
    SELECT season, source, found, targets, found>=0.9*targets AS ready, bool_and(found>=0.9*targets) OVER (PARTITION BY season) AS all_ready FROM s""")
def _(d):
    t = d.games.select("season", "game_id")
    return O.availability_matrix(t, {"plays": d.lineitem.select(F.col("l_orderkey").alias("game_id")), "finals": d.games.where("completed")}, 0.9, ["season"])


@query("po16_freeze_plan", uses="slate quotes", sql="""
    SELECT game_id, CASE WHEN kickoff<=TIMESTAMP '2024-01-18 12:00:00' THEN 'late' WHEN game_id NOT IN (SELECT game_id FROM quotes WHERE spread IS NOT NULL) THEN 'no_prediction' ELSE 'frozen' END AS plan FROM slate""")
def _(d):
    at = F.lit("2024-01-18 12:00:00").cast("timestamp_ntz")
    return O.freeze_plan(d.slate, d.quotes.where("spread IS NOT NULL"), at).select("game_id", "plan")


@query("po17_frozen_replay", uses="graded", sql="SELECT true AS identical, CAST(count(DISTINCT season) AS BIGINT) AS seasons FROM graded WHERE season > 1995")
def _(d):
    from .ml import FEATS, _frame
    f = _frame(d)
    digest = lambda df: lake.table_digest(df.select("season", "game_id", "target", F.round("fitted", 6).alias("fitted")), by=["season"]).withColumnRenamed("digest", "x")
    a = digest(M.rolling_origin(f, FEATS, [10.0]))
    b = digest(M.rolling_origin(f.repartition(5, "game_id"), FEATS, [10.0])).withColumnRenamed("x", "y").drop("rows")
    return a.join(b, "season").agg(F.bool_and(F.col("x") == F.col("y")).alias("identical"), F.count("*").alias("seasons"))


@query("po18_correction_report", uses="games", sql="""
    SELECT game_id, 'away_points' AS field, CAST(away_points AS VARCHAR) AS left_value, CAST(away_points+7 AS VARCHAR) AS right_value, 'changed' AS kind FROM games WHERE completed AND game_id%12=1""")
def _(d):
    new = d.games.withColumn("away_points", F.col("away_points") + F.when(F.col("game_id") % 12 == 1, 7).otherwise(0))
    return J.frame_diff(d.games, new, ["game_id"], ["home_points", "away_points", "week"])


@query("po19_key_digest", sql="""
    WITH k AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
    SELECT o_orderstatus, count(*) AS keys, CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (rn<=5) AS examples FROM k GROUP BY 1""")
def _(d):
    return O.key_digest(d.orders, ["o_orderstatus"], "o_orderkey", 5)


@query("po20_quarantine_classes", uses="plays", sql="""
    WITH s AS (SELECT game_id, offense, offense_score - lag(offense_score) OVER (PARTITION BY game_id, offense ORDER BY ts, play_id) AS x FROM plays), g AS (SELECT game_id, offense, count(*) FILTER (x<0) AS dr, count(*) FILTER (x>8) AS j FROM s GROUP BY 1, 2)
    SELECT CASE WHEN dr=0 AND j=0 THEN 'clean' WHEN dr>0 AND j>0 THEN 'regression_and_jump' WHEN dr>0 THEN 'regression' ELSE 'jump' END AS class, count(*) AS streams FROM g GROUP BY 1""")
def _(d):
    r = W.regressions(d.plays.select("game_id", "offense", "ts", "play_id", "offense_score"), ["game_id", "offense"], ["ts", "play_id"], "to_date(ts)", "offense_score")
    c = F.when((F.col("drops") == 0) & (F.col("jumps") == 0), "clean").when((F.col("drops") > 0) & (F.col("jumps") > 0), "regression_and_jump").when(F.col("drops") > 0, "regression").otherwise("jump")
    return r.groupBy(c.alias("class")).agg(F.count("*").alias("streams"))


@query("po21_extra_rows", uses="games", sql="""
    SELECT game_id, CASE WHEN NOT completed THEN 'not_completed' WHEN neutral THEN 'neutral_site' ELSE 'unexplained' END AS reason FROM games WHERE game_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>25)""")
def _(d):
    out = O.explain_extra(d.games, d.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("game_id")), ["game_id"], {"not_completed": ~F.col("completed"), "neutral_site": F.col("neutral")})
    return out.select("game_id", "reason")


@query("po22_drive_corroboration", uses="plays", sql=f"""{ENRICHED}, l AS (SELECT game_id, drive_number, sum(scoring) AS p FROM en GROUP BY 1, 2), e AS (SELECT game_id, drive_number, sum(scoring + CASE WHEN game_id%8=1 AND down=4 THEN 1 ELSE 0 END) AS p FROM en WHERE NOT (game_id%9=2 AND quarter=5) GROUP BY 1, 2)
    SELECT game_id, count(*) AS drives, count(*) FILTER (l.p IS DISTINCT FROM e.p) AS differing, bool_and(l.p IS NOT DISTINCT FROM e.p) AS usable FROM l FULL JOIN e USING (game_id, drive_number) GROUP BY 1""")
def _(d):
    e = enriched(d).select("game_id", "drive_number", "quarter", "down", F.col("scoring").alias("points"))
    bump = ((F.col("game_id") % 8 == 1) & (F.col("down") == 4)).cast("int")
    ext = e.where("NOT (game_id % 9 = 2 AND quarter = 5)").withColumn("points", F.col("points") + bump)
    return O.corroborate(e, ext, ["drive_number"])


@query("po23_serving_core", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', 'q.captured_at < p.kickoff', '')}
    SELECT s.game_id, pred_margin AS spread_mean, pred_total AS total_mean, a.side AS spread_side, b.side AS total_side FROM slate s LEFT JOIN bq a ON a.game_id=s.game_id AND a.target='spread' LEFT JOIN bq b ON b.game_id=s.game_id AND b.target='total'""")
def _(d):
    p = K.long_predictions(d.slate)
    q = K.long_quotes(d.quotes)
    g = K.grade(p, q, q.where("false"))
    out = O.serving_core(d.slate.select("game_id"), p, g)
    return out.select("game_id", "spread_mean", "total_mean", "spread_side", "total_side")


@query("po24_rating_snapshots", uses="sides", sql=f"""
    WITH k AS (SELECT season, team, week, sum(points_for) AS s, count(points_for) AS n FROM sides GROUP BY 1, 2, 3), c AS (SELECT season, team, week, sum(s) OVER w AS s, sum(n) OVER w AS n FROM k WINDOW w AS (PARTITION BY season, team ORDER BY week))
    SELECT season, week AS as_of_week, team, {q6('s/n')} AS value, rank() OVER (PARTITION BY season, week ORDER BY round(s/n, 9) DESC)::BIGINT AS rank FROM c WHERE n>0""")
def _(d):
    v = W.cumulative_snapshot(d.sides.where("points_for IS NOT NULL").withColumn("one", F.lit(1)), ["season", "team"], "week", "points_for", "one")
    k = d.sides.select("season", "team", "week").distinct()
    out = k.join(v, ["season", "team", "week"], "left")
    w = Window.partitionBy("season", "team").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("value", F.last("value", True).over(w)).where("value IS NOT NULL")
    out = scan.competition_rank(out, ["season", "week"], F.round("value", 9))
    return out.select("season", F.col("week").alias("as_of_week"), "team", r6("value").alias("value"), F.col("rank").cast("long"))


@query("po25_serving_views", uses="games graded", sql=f"""
    SELECT g.season, count(*) AS games, count(g.home_points) AS with_result, count(p.game_id) AS predictions, {q6('avg(abs(p.prediction-p.actual))')} AS mae FROM games g LEFT JOIN graded p ON p.game_id=g.game_id AND p.target='margin' GROUP BY 1""")
def _(d):
    sql = """WITH active AS (SELECT game_id, prediction, actual FROM {graded} WHERE target = 'margin')
        SELECT g.season, count(*) AS games, count(g.home_points) AS with_result, count(p.game_id) AS predictions, avg(abs(p.prediction - p.actual)) AS mae
        FROM {games} g LEFT JOIN active p ON p.game_id = g.game_id GROUP BY g.season"""
    return d.spark.sql(sql, games=d.games, graded=d.graded).withColumn("mae", r6("mae"))


@query("po26_tie_exists", uses="sides", sql=f"""WITH v AS ({TEAM_RATING}), r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY v DESC) AS rank FROM v)
    SELECT season, team FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.season=a.season AND b.rank=a.rank AND b.team<>a.team)""")
def _(d):
    ranked = scan.competition_rank(_ratings(d), ["season"], F.col("v"))
    return W.tied_flag(ranked, ["season"]).where("tied").select("season", "team")


@query("po27_window_efficiency", uses="plays", sql=f"""{ENRICHED}, t AS (SELECT season, week, CAST(offense AS VARCHAR) AS who, count(*) AS p, sum(success) AS s, sum(ppa) AS v FROM en WHERE eligible GROUP BY 1, 2, 3 UNION ALL SELECT season, week, 'pooled', count(*), sum(success), sum(ppa) FROM en WHERE eligible GROUP BY 1, 2)
    SELECT season, who, week, CAST(sum(p) OVER w AS BIGINT) AS plays, {q6('sum(s) OVER w/sum(p) OVER w')} AS success_rate, {q6('sum(v) OVER w/sum(p) OVER w')} AS value_per_play FROM t WINDOW w AS (PARTITION BY season, who ORDER BY week)""")
def _(d):
    t = enriched(d).where(P.eligible_play()).groupBy("season", "week", F.col("offense").alias("team")).agg(F.count("*").alias("plays"), F.sum("success").alias("success"), F.sum("ppa").alias("value"))
    out = O.cumulative_efficiency(t, ["season"], "week")
    return out.withColumns({c: r6(c) for c in ("success_rate", "value_per_play")})


@query("po28_net_success", uses="games exposures", sql=f"""
    WITH r AS (SELECT game_id, CASE WHEN l_orderkey%2=0 THEN home ELSE away END AS team, avg(l_discount) AS rate FROM games JOIN lineitem ON l_orderkey=game_id GROUP BY 1, 2 UNION ALL SELECT game_id, CASE WHEN game_id%2=0 THEN away ELSE home END, 0.05 FROM games WHERE game_id%3=0),
    f AS (SELECT game_id, CASE WHEN home_points>away_points THEN home WHEN home_points<away_points THEN away END AS w, CASE WHEN home_points>away_points THEN away WHEN home_points<away_points THEN home END AS l FROM games WHERE completed)
    SELECT f.game_id, {q6('a.rate-b.rate')} AS net, CASE WHEN w IS NULL THEN 'no_winner' WHEN a.rate IS NULL OR b.rate IS NULL THEN 'no_rate' END AS not_charted, coalesce(round(a.rate-b.rate, 9)<0, false) AS outplayed
    FROM f LEFT JOIN r a ON a.game_id=f.game_id AND a.team=f.w LEFT JOIN r b ON b.game_id=f.game_id AND b.team=f.l""")
def _(d):
    even = F.col("game_id") % 2 == 0
    one = d.games.join(d.lineitem, F.col("l_orderkey") == F.col("game_id")).groupBy("game_id", F.when(even, F.col("home")).otherwise(F.col("away")).alias("team")).agg(F.round(F.avg("l_discount"), 9).alias("rate"))
    two = d.games.where("game_id % 3 = 0").select("game_id", F.when(even, F.col("away")).otherwise(F.col("home")).alias("team"), F.lit(0.05).alias("rate"))
    return O.net_success(one.unionByName(two), d.games.where("completed")).withColumn("net", r6("net"))


@query("po29_rating_trajectory", uses="sides", sql=f"""
    WITH v AS (SELECT season, week, team, avg(points_for) AS v FROM sides WHERE points_for IS NOT NULL GROUP BY 1, 2, 3)
    SELECT season, week, team, {q6('v')} AS rating, {q6('avg(v) OVER (PARTITION BY season, week)')} AS league_mean, rank() OVER (PARTITION BY season, week ORDER BY round(v, 9) DESC)::BIGINT AS rank FROM v""")
def _(d):
    v = d.sides.where("points_for IS NOT NULL").groupBy("season", "week", "team").agg(F.avg("points_for").alias("v"))
    mean = v.groupBy("season", "week").agg(r6(F.avg("v")).alias("league_mean"))
    out = scan.competition_rank(v, ["season", "week"], F.round("v", 9)).join(mean, ["season", "week"])
    return out.select("season", "week", "team", r6("v").alias("rating"), "league_mean", F.col("rank").cast("long"))


@query("po30_scatter_ranks", uses="exposures", sql="""
    WITH v AS (SELECT offense AS team, round(sum(num)/sum(den), 3) AS x, round(avg(den), 6) AS y FROM exposures GROUP BY 1) SELECT team, rank() OVER (ORDER BY x DESC)::BIGINT AS x_rank, rank() OVER (ORDER BY y)::BIGINT AS y_rank FROM v""")
def _(d):
    v = d.exposures.groupBy(F.col("offense").alias("team")).agg(F.round(F.sum("num") / F.sum("den"), 3).alias("x"), F.round(F.avg("den"), 6).alias("y")).withColumn("board", F.lit(1))
    out = scan.competition_rank(scan.competition_rank(v, ["board"], F.col("x"), "x_rank"), ["board"], -F.col("y"), "y_rank")
    return out.select("team", F.col("x_rank").cast("long"), F.col("y_rank").cast("long"))


@query("po31_team_game_log", uses="sides", sql=f"""
    SELECT game_id, team, CAST(points_for AS DOUBLE) AS points, {q6('avg(points_for) OVER (PARTITION BY season, team)')} AS season_average, points_for IS NULL AS unavailable FROM sides""")
def _(d):
    mean = d.sides.groupBy("season", "team").agg(r6(F.avg("points_for")).alias("season_average"))
    return d.sides.join(mean, ["season", "team"]).select("game_id", "team", F.col("points_for").cast("double").alias("points"), "season_average", F.col("points_for").isNull().alias("unavailable"))


@query("po32_market_board", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', 'q.captured_at < p.kickoff', '')}
    SELECT game_id, target, {q6("CASE WHEN target='spread' THEN prediction+line ELSE prediction-line END")} AS edge, CASE WHEN line IS NULL THEN 'no_line' END AS unavailable FROM pr LEFT JOIN rl USING (game_id, target)""")
def _(d):
    p = K.long_predictions(d.slate)
    ref = K.reference_line(K.latest_per_provider(K.admissible(K.long_quotes(d.quotes), p)))
    e = F.when(F.col("target") == "spread", F.col("prediction") + F.col("line")).otherwise(F.col("prediction") - F.col("line"))
    return p.join(ref, K.LINK, "left").select("game_id", "target", r6(e).alias("edge"), F.when(F.col("line").isNull(), "no_line").alias("unavailable"))


@query("po33_team_records", uses="sides", sql="""
    SELECT season, team, count(*) FILTER (points_for>points_against) AS wins, count(*) FILTER (points_for<points_against) AS losses, count(*) FILTER (points_for-points_against+2.5-game_id%6>0) AS ats_wins,
      count(*) FILTER (points_for-points_against+2.5-game_id%6<0) AS ats_losses, count(*) FILTER (points_for-points_against+2.5-game_id%6=0) AS ats_pushes, count(*) FILTER (points_for+points_against>48) AS overs, count(*) FILTER (points_for+points_against<48) AS unders FROM sides GROUP BY 1, 2""")
def _(d):
    return O.team_records(d.sides.withColumns({"line": 2.5 - F.col("game_id") % 6, "total": F.lit(48)}), "line", "total")


@query("po34_top_edges_record", uses="graded", sql="""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY season, week, target ORDER BY abs(prediction-line) DESC, game_id) AS rn, (prediction-line)*(actual-line) AS s FROM graded)
    SELECT target, count(*) FILTER (s>0) AS w, count(*) FILTER (s<0) AS l, count(*) FILTER (s=0) AS p FROM e WHERE rn<=5 GROUP BY 1""")
def _(d):
    w = Window.partitionBy("season", "week", "target").orderBy(F.abs(F.col("prediction") - F.col("line")).desc(), "game_id")
    s = (F.col("prediction") - F.col("line")) * (F.col("actual") - F.col("line"))
    e = d.graded.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return e.groupBy("target").agg(F.count(F.when(s > 0, 1)).alias("w"), F.count(F.when(s < 0, 1)).alias("l"), F.count(F.when(s == 0, 1)).alias("p"))


@query("po35_bye_weeks", uses="sides", sql="""
    WITH sp AS (SELECT season, team, min(week) AS a, max(week) AS b FROM sides GROUP BY 1, 2), g AS (SELECT season, team, CAST(unnest(range(a, b+1)) AS INT) AS week FROM sp), n AS (SELECT season, team, week, count(*) AS c FROM sides GROUP BY 1, 2, 3)
    SELECT season, team, week, coalesce(c, 0) AS games, c IS NULL AS bye FROM g LEFT JOIN n USING (season, team, week)""")
def _(d):
    return O.bye_weeks(d.sides)


@query("po36_next_event", uses="sides", sql="SELECT team, arg_min(game_id, struct_pack(a := kickoff, b := game_id)) AS game_id, min(kickoff) AS kickoff FROM sides WHERE NOT completed GROUP BY 1")
def _(d):
    return d.sides.where("NOT completed").groupBy("team").agg(F.min_by("game_id", F.struct("kickoff", "game_id")).alias("game_id"), F.min("kickoff").alias("kickoff"))


@query("po37_request_coverage", uses="games exposures", sql="""
    WITH w AS (SELECT DISTINCT season, week FROM games), e AS (SELECT unnest(['A','R']) AS entity) SELECT season, week, entity FROM w CROSS JOIN e WHERE (season, week, entity) NOT IN (SELECT season, week, flag FROM exposures WHERE den>49 AND offense%3=0)""")
def _(d):
    want = d.games.select("season", "week").distinct().withColumn("entity", F.explode(F.array(F.lit("A"), F.lit("R"))))
    have = d.exposures.where("den > 49 AND offense % 3 = 0").select("season", "week", F.col("flag").alias("entity")).distinct()
    return want.join(have, ["season", "week", "entity"], "left_anti")


@query("po38_collision_census", sql="""
    WITH g AS (SELECT count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus)) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1) SELECT CASE WHEN k=1 THEN 'identical' ELSE 'divergent' END AS kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY 1""")
def _(d):
    return O.classify_sequence(d.lineitem, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])


@query("po39_ledger_comparison", uses="plays", sql="""
    SELECT play_id, CASE WHEN k%20=3 THEN 'right_only' WHEN k%20=5 THEN 'left_only' ELSE 'changed' END AS kind FROM plays WHERE k%20 IN (3, 5) OR k%3=0""")
def _(d):
    from .it import _two_ledgers
    b, c = _two_ledgers(d)
    return J.frame_diff(b, c, ["play_id"], ["points"]).select("play_id", "kind")


@query("po40_hand_check", uses="plays", sql="SELECT CAST(0 AS BIGINT) AS differing, count(*) AS drives FROM (SELECT DISTINCT game_id, quarter, k//25, offense, defense FROM plays WHERE play_type NOT IN ('Timeout', 'End Period'))")
def _(d):
    e = enriched(d)
    a = RU.drives(e, ["quarter", "play_number"]).select("game_id", "drive_number", "offense", "defense", F.col("drive_yards").alias("y1"), F.col("points").alias("p1"))
    b = RU.provider_drives(e, ["quarter", "play_number"]).select("game_id", F.split_part("drive_id", F.lit("-"), F.lit(2)).cast("int").alias("drive_number"), "offense", "defense",
                                                               F.col("drive_yards").alias("y2"), F.col("points").alias("p2"))
    j = a.join(b, ["game_id", "drive_number", "offense", "defense"], "full_outer")
    bad = ~F.col("y1").eqNullSafe(F.col("y2")) | ~F.col("p1").eqNullSafe(F.col("p2"))
    return j.agg(F.count(F.when(bad, 1)).alias("differing"), F.count("*").alias("drives"))


@query("po41_materiality", uses="sides", sql=f"""WITH v AS ({TEAM_RATING}), x AS (SELECT season, team, round(avg(points_for), 6) AS v2 FROM sides WHERE completed AND points_for<45 GROUP BY 1, 2),
    a AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY v DESC) AS r1 FROM v), b AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY v2 DESC) AS r2 FROM x)
    SELECT season, team, {q6('v2-v')} AS change, r2-r1 AS rank_change FROM a JOIN b USING (season, team)""")
def _(d):
    a = scan.competition_rank(_ratings(d), ["season"], F.col("v"), "r1")
    b = d.sides.where("completed AND points_for < 45").groupBy("season", "team").agg(F.round(F.avg("points_for"), 6).alias("v2"))
    b = scan.competition_rank(b, ["season"], F.col("v2"), "r2")
    return a.join(b, ["season", "team"]).select("season", "team", r6(F.col("v2") - F.col("v")).alias("change"), (F.col("r2") - F.col("r1")).cast("long").alias("rank_change"))


@query("po42_history_certification", uses="games", sql=f"""
    SELECT season, count(*) AS games, {q6('avg(CAST(completed AS INT))')} AS finals_share, count(*) FILTER (game_id IN (SELECT l_orderkey FROM lineitem)) AS play_covered, count(DISTINCT home) AS teams FROM games GROUP BY 1""")
def _(d):
    li = d.lineitem.select(F.col("l_orderkey").alias("game_id")).distinct().withColumn("_p", F.lit(1))
    return d.games.join(li, "game_id", "left").groupBy("season").agg(F.count("*").alias("games"), r6(F.avg(F.col("completed").cast("int"))).alias("finals_share"),
                                                               F.count("_p").alias("play_covered"), F.count_distinct("home").alias("teams"))


@query("po43_completed_week_guard", uses="games exposures", sql="""
    WITH w AS (SELECT season, week FROM games GROUP BY 1, 2) SELECT season, week, 'plays' AS input FROM w WHERE (season, week) NOT IN (SELECT season, week FROM exposures WHERE den>48)
    UNION ALL SELECT season, week, 'finals' FROM w WHERE (season, week) NOT IN (SELECT season, week FROM games WHERE home_points>40)""")
def _(d):
    w = d.games.select("season", "week").distinct()
    return O.completed_week_guard(w, {"plays": d.exposures.where("den > 48"), "finals": d.games.where("home_points > 40")}, ["season", "week"])
