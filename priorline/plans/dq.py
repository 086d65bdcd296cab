"""Data-quality checks on the given tables and their stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import playtypes as T
from ..operators import joins as J, ledger as L, metrics as M, quality as Q, rollup as R
from ..sources import lake
from .ag import DRIVES_SQL, ENRICHED, LONG_SQL, enriched, long_measures
from .fn import inlist
from .registry import q6, query, r6

LINES = Q.Contract("lineitem", ["l_orderkey", "l_linenumber"], non_null=["l_quantity"], integral=["l_quantity", "l_extendedprice"], timestamps=["l_shipdate"],
                   identifiers=["l_partkey"], enums={"l_returnflag": ["A", "N"]}, ranges={"l_discount": (0.0, 0.08)})


@query("dq1_frame_contract", sql="""
    SELECT 'null_key:l_orderkey' AS rule, count(*) FILTER (l_orderkey IS NULL) AS violations FROM lineitem UNION ALL SELECT 'null_key:l_linenumber', count(*) FILTER (l_linenumber IS NULL) FROM lineitem
    UNION ALL SELECT 'null:l_quantity', count(*) FILTER (l_quantity IS NULL) FROM lineitem UNION ALL SELECT 'not_integral:l_quantity', count(*) FILTER (l_quantity<>floor(l_quantity)) FROM lineitem
    UNION ALL SELECT 'not_integral:l_extendedprice', count(*) FILTER (l_extendedprice<>floor(l_extendedprice)) FROM lineitem UNION ALL SELECT 'not_timestamp:l_shipdate', 0 FROM lineitem GROUP BY 1
    UNION ALL SELECT 'not_identifier:l_partkey', 0 FROM lineitem GROUP BY 1 UNION ALL SELECT 'not_allowed:l_returnflag', count(*) FILTER (l_returnflag='R') FROM lineitem
    UNION ALL SELECT 'out_of_range:l_discount', count(*) FILTER (l_discount>0.08) FROM lineitem
    UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1)""")
def _(d):
    return LINES.check(d.lineitem)


@query("dq2_silver_contract", uses="games", sql="""
    SELECT 'null_key:season' AS rule, 0 AS violations FROM games GROUP BY 1 UNION ALL SELECT 'null_key:game_id', 0 FROM games GROUP BY 1
    UNION ALL SELECT 'null:home_points', count(*) FILTER (home_points IS NULL) FROM games UNION ALL SELECT 'duplicate_key', 0 FROM games GROUP BY 1""")
def _(d):
    return Q.Contract("games", ["season", "game_id"], required=["kickoff"], non_null=["home_points"]).check(d.games)


@Q.register_check("completed_scores", "silver", "required", ["games"])
def _completed_scores(t):
    return t["games"].where("completed AND (home_points IS NULL OR away_points IS NULL)")


@Q.register_check("no_self_play", "silver", "required", ["games"])
def _no_self_play(t):
    return t["games"].where("home = away")


@Q.register_check("score_range", "silver", "warn", ["games"])
def _score_range(t):
    return t["games"].where("home_points > 45")


@Q.register_check("venue_known", "silver", "required", ["venues"])
def _venue_known(t):
    return t["venues"]


@Q.register_check("weather_known", "silver", "warn", ["weather"])
def _weather_known(t):
    return t["weather"]


@Q.register_check("broken", "silver", "warn", ["games"])
def _broken(t):
    return t["games"].where("no_such_column > 1")


@query("dq3_stage_run", uses="games", sql="""
    SELECT 'completed_scores' AS "check", 'required' AS severity, 'pass' AS status, 0 AS findings FROM games GROUP BY 1 UNION ALL SELECT 'no_self_play', 'required', 'pass', 0 FROM games GROUP BY 1
    UNION ALL SELECT 'score_range', 'warn', 'fail', count(*) FROM games WHERE home_points>45 UNION ALL SELECT 'venue_known', 'required', 'block', 0 FROM games GROUP BY 1
    UNION ALL SELECT 'weather_known', 'warn', 'skip', 0 FROM games GROUP BY 1 UNION ALL SELECT 'broken', 'warn', 'fail', -1 FROM games GROUP BY 1""")
def _(d):
    return Q.run_stage("silver", {"games": d.games})


@query("dq4_numbering", sql="""
    WITH p AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, max(l_linenumber) AS highest, count(*) AS numbers, count(*) FILTER (a<>b) AS shared_numbers, min(l_linenumber)=1 AND max(l_linenumber)=count(*) AS contiguous FROM p GROUP BY 1""")
def _(d):
    return Q.numbering_problems(d.lineitem, "l_orderkey", "l_linenumber", "l_suppkey")


@query("dq5_coverage_both_ways", uses="games", sql="""
    WITH l AS (SELECT l_orderkey AS game_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT game_id, CASE WHEN g.season IS NULL THEN 'no_game' WHEN l.n IS NULL THEN 'no_play' ELSE 'few_play' END AS problem
    FROM l FULL JOIN games g USING (game_id) WHERE g.season IS NULL OR l.n IS NULL OR l.n<2""")
def _(d):
    return Q.coverage_both_ways(d.lineitem.select(F.col("l_orderkey").alias("game_id")), d.games, ["game_id"], ("play", "game"), minimum=2)


@query("dq6_points_identity", uses="plays", sql=f"""{ENRICHED}, p AS (SELECT game_id, offense, CAST(sum(scoring) AS BIGINT) AS parts FROM en GROUP BY 1, 2), f AS (SELECT game_id, offense, max(offense_score) AS final FROM plays GROUP BY 1, 2)
    SELECT * FROM p JOIN f USING (game_id, offense) WHERE parts>final""")
def _(d):
    e = enriched(d)
    return Q.points_exceed_final(e.withColumn("points", F.col("scoring")), d.plays.groupBy("game_id", "offense").agg(F.max("offense_score").alias("final")), ["game_id", "offense"])


@query("dq7_flag_consistency", uses="plays", sql="""
    SELECT week, count(*) FILTER (ppa IS NULL AND NOT (event_type='error' AND k%2=0)) AS null_not_flagged, count(*) FILTER (ppa IS NOT NULL AND k%17=0 AND event_type<>'error') AS flagged_not_null FROM plays GROUP BY 1""")
def _(d):
    flag = ((F.col("event_type") == "error") & (F.col("k") % 2 == 0)) | ((F.col("event_type") != "error") & (F.col("k") % 17 == 0))
    return Q.flag_problems(d.plays.withColumn("flag", flag), "ppa", "flag", ["week"])


@query("dq8_changed_rows", uses="games", sql="""
    SELECT game_id, CASE WHEN game_id%13=0 THEN '*missing*' WHEN game_id%5=0 AND game_id%7=0 THEN 'home_points,week' WHEN game_id%5=0 THEN 'home_points' ELSE 'week' END AS changed
    FROM games WHERE completed AND (game_id%13=0 OR game_id%5=0 OR game_id%7=0)""")
def _(d):
    k = F.col("game_id")
    new = d.games.where(k % 13 != 0).withColumns({"home_points": F.when(k % 5 == 0, F.coalesce("home_points", F.lit(0)) + 1).otherwise(F.col("home_points")),
                                                  "week": F.col("week") + (k % 7 == 0).cast("int")})
    return Q.changed_rows(d.games, new, ["game_id"], ["home_points", "week"], F.col("completed"))


@query("dq9_ambiguous_versions", sql="""
    SELECT o_custkey AS dataset, count(DISTINCT o_orderstatus) AS versions FROM orders WHERE o_custkey%4<>0 GROUP BY 1 HAVING count(DISTINCT o_orderstatus)>1""")
def _(d):
    cat = d.orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderstatus").alias("version"))
    return Q.ambiguous_versions(cat, d.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("dataset")))


@query("dq9_ingest_checks", uses="quotes slate", sql="""
    SELECT 'unmatched_quotes' AS check_name, count(*) AS n FROM quotes WHERE game_id NOT IN (SELECT game_id FROM slate WHERE completed)
    UNION ALL SELECT 'request_gaps', count(*) FROM slate WHERE game_id NOT IN (SELECT game_id FROM quotes)""")
def _(d):
    q, s = d.quotes.select("game_id"), d.slate
    one = lambda df, n: df.agg(F.lit(n).alias("check_name"), F.count("*").alias("n"))
    return one(q.join(s.where("completed"), "game_id", "left_anti"), "unmatched_quotes").unionByName(one(s.join(q, "game_id", "left_anti"), "request_gaps"))


@query("dq10_publish_rules", uses="graded", sql="""
    SELECT game_id, target, 'range' AS rule FROM graded WHERE abs(prediction)>60 UNION ALL SELECT game_id, target, 'wide_sigma' FROM graded WHERE sigma>=19 UNION ALL SELECT game_id, target, 'far_line' FROM graded WHERE abs(prediction-line)>35""")
def _(d):
    return Q.rule_violations(d.graded, ["game_id", "target"], {"range": F.abs("prediction") > 60, "wide_sigma": F.col("sigma") >= 19, "far_line": F.abs(F.col("prediction") - F.col("line")) > 35})


@query("dq11_metric_semantics", uses="plays", sql=f"""{LONG_SQL}, x AS (SELECT *, CASE WHEN team%9=0 THEN value+0.01 ELSE value END AS shown FROM long)
    SELECT team, role, metric, 'value_differs' AS rule FROM x WHERE value IS NOT NULL AND team%9=0 UNION ALL SELECT team, role, metric, 'empty' FROM x WHERE n=0""")
def _(d):
    x = long_measures(d).withColumn("shown", F.when(F.col("team") % 9 == 0, F.col("value") + 0.01).otherwise(F.col("value")))
    return Q.rule_violations(x, ["team", "role", "metric"], {"value_differs": F.abs(F.col("shown") - F.col("numerator") / F.expr("nullif(denominator, 0)")) > 1e-9,
                                                            "empty": F.col("denominator") == 0})


@query("dq11_ledger_rules", uses="plays", sql=f"""{ENRICHED}
    SELECT game_id, drive_number, offense, 'overtime_mixed' AS rule FROM en GROUP BY 1, 2, 3 HAVING count(DISTINCT quarter<=4)>1 OR count(DISTINCT defense)>1
    UNION ALL SELECT game_id, drive_number, offense, 'no_eligible_play' FROM en GROUP BY 1, 2, 3 HAVING NOT bool_or(eligible)""")
def _(d):
    from ..functions.plays import eligible_play
    p = L.possession_ledger(enriched(d), eligible_play())
    return Q.rule_violations(p, ["game_id", "drive_number", "offense"], {"overtime_mixed": F.col("quality_reason").isNotNull(), "no_eligible_play": ~F.col("possession_eligible")})


@query("dq12_chart_reconciliation", uses="plays", sql="""
    SELECT game_id, offense AS team, 'plays' AS field, CAST(count(*) AS VARCHAR) AS left_value, CAST(count(*)+1 AS VARCHAR) AS right_value, 'changed' AS kind FROM plays WHERE game_id%11=3 GROUP BY 1, 2""")
def _(d):
    a = d.plays.groupBy("game_id", F.col("offense").alias("team")).agg(F.count("*").alias("plays"))
    b = a.withColumn("plays", F.col("plays") + (F.col("game_id") % 11 == 3).cast("int"))
    return J.frame_diff(a, b, ["game_id", "team"], ["plays"])


TOL = {"yards": 2.0, "plays": 1.0, "turnovers": 0.0}


@query("dq13_cross_source", uses="plays", sql=f"""{ENRICHED}, a AS (SELECT game_id, sum(yards) AS yards, count(*) AS plays, CAST(sum(turnover) AS BIGINT) AS turnovers FROM en GROUP BY 1)
    SELECT game_id, CASE WHEN game_id%10=9 THEN 'incomplete_source' WHEN game_id%3=1 OR game_id%4=2 THEN 'blocking_conflict' WHEN game_id%10=5 THEN 'incomplete_source' ELSE 'matched' END AS status,
      CASE WHEN game_id%10=9 THEN '' ELSE concat_ws(',', CASE WHEN game_id%3=1 THEN 'yards' END, CASE WHEN game_id%4=2 AND game_id%10<>5 THEN 'turnovers' END) END AS fields FROM a""")
def _(d):
    a = enriched(d).groupBy("game_id").agg(F.sum("yards").alias("yards"), F.count("*").alias("plays"), F.sum("turnover").alias("turnovers"))
    k = F.col("game_id")
    b = a.where(k % 10 != 9).withColumns({"yards": F.col("yards") + F.when(k % 3 == 1, 3).otherwise(2), "plays": F.col("plays") + 1,
                                          "turnovers": F.when(k % 10 == 5, None).otherwise(F.col("turnovers") + (k % 4 == 2).cast("int"))})
    return Q.reconcile_games(a, b, ["game_id"], TOL)


@query("dq14_score_reconciliation", uses="games", sql="""
    SELECT game_id, CASE WHEN game_id%6<>0 THEN 'unexplained' WHEN home_points%5=0 AND home_points>0 THEN 'exception_differs' ELSE 'unused_exception' END AS problem FROM games
    WHERE completed AND ((home_points%5=0 AND game_id%6<>0 AND home_points>0) OR (home_points%5=0 AND game_id%6=0 AND home_points>1) OR (game_id%6=0 AND (home_points%5<>0 OR home_points=0)))""")
def _(d):
    g = d.games.where("completed")
    finals = g.select("game_id", F.col("home_points").alias("final"))
    events = g.select("game_id", F.when(F.col("home_points") % 5 == 0, 0).otherwise(F.col("home_points")).alias("points"))
    exceptions = g.where("game_id % 6 = 0").select("game_id", F.lit(1).alias("gap"))
    return Q.score_reconciliation(events, finals, ["game_id"], exceptions)


@query("dq15_point_in_time", uses="quotes slate", sql="""
    SELECT quote_id, 'quote_after_kickoff' AS rule FROM quotes JOIN slate USING (game_id) WHERE captured_at>kickoff
    UNION ALL SELECT quote_id, 'quote_after_cutoff' FROM quotes JOIN slate USING (game_id) WHERE captured_at>kickoff + INTERVAL 6 HOUR""")
def _(d):
    j = d.quotes.join(d.slate.select("game_id", "kickoff"), "game_id").withColumn("cutoff", F.col("kickoff") + F.expr("INTERVAL 6 HOURS"))
    return Q.time_violations(j, ["quote_id"], {"quote_after_kickoff": ("captured_at", "kickoff"), "quote_after_cutoff": ("captured_at", "cutoff")})


@query("dq16_corpus_checks", uses="plays", sql=f"""{ENRICHED}, {DRIVES_SQL}
    SELECT game_id, drive_number, offense, 'points_above_eight' AS rule FROM dro WHERE points>8 UNION ALL SELECT game_id, drive_number, offense, 'no_drive_play' FROM dro WHERE drive_plays=0
    UNION ALL SELECT game_id, drive_number, offense, 'turnover_and_points' FROM dro WHERE turnovers>0 AND points>0""")
def _(d):
    dr = R.drives(enriched(d), ["quarter", "play_number"])
    return Q.rule_violations(dr, ["game_id", "drive_number", "offense"], {"points_above_eight": F.col("points") > 8, "no_drive_play": F.col("drive_plays") == 0,
                                                                         "turnover_and_points": (F.col("turnovers") > 0) & (F.col("points") > 0)})


@query("dq17_grid_completeness", uses="sides", sql="""
    WITH w AS (SELECT unnest(range(1, 53)) AS week), s AS (SELECT DISTINCT season, team FROM sides), p AS (SELECT DISTINCT season, team, week FROM sides)
    SELECT season, team, CAST(week AS INT) AS week FROM (SELECT season, team, week FROM s CROSS JOIN w EXCEPT SELECT * FROM p)""")
def _(d):
    return Q.grid_completeness(d.sides, ["season", "team"], "week", 1, 52)


@query("dq18_row_set_digest", sql="""
    SELECT o_orderstatus, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}'), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM orders GROUP BY 1""")
def _(d):
    return lake.table_digest(d.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), by=["o_orderstatus"], columns=["o_orderkey", "o_custkey"])


@query("dq19_frame_profile", sql=" UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c}=0) AS zeros, {q6(f'min({c})')} AS low, {q6(f'max({c})')} AS high, {q6(f'avg({c})')} AS mean FROM lineitem"""
    for c in ("l_quantity", "l_discount", "l_tax")))
def _(d):
    return Q.profile(d.lineitem, ["l_quantity", "l_discount", "l_tax"]).withColumns({c: r6(c) for c in ("low", "high", "mean")})


@query("dq19_condition_number", uses="graded", sql=f"SELECT {q6('(1+abs(corr(prediction, line)))/(1-abs(corr(prediction, line)))')} AS condition FROM graded")
def _(d):
    return Q.condition_number(d.graded, "prediction", "line").withColumn("condition", r6("condition"))


@query("dq20_release_parity", uses="games", sql="""
    SELECT game_id, 'home_points' AS field, CAST(home_points AS VARCHAR) AS left_value, CAST(home_points+2 AS VARCHAR) AS right_value, 'changed' AS kind FROM games WHERE completed AND game_id%10=4""")
def _(d):
    k = F.col("game_id")
    new = d.games.withColumns({"home_points": F.col("home_points") + F.when(k % 10 == 4, 2).otherwise(0), "week": F.col("week") + (k % 9 == 0).cast("int")})
    return Q.masked_parity(d.games, new, ["game_id"], ["home_points", "week"], {"week": k % 9 == 0})


@query("dq21_payload_recompute", uses="quotes slate", sql="SELECT 0 AS grade_mismatches, count(*)*2 AS graded FROM slate")
def _(d):
    from ..functions import odds
    from ..operators import market as K
    q = K.long_quotes(d.quotes)
    g = K.grade(K.long_predictions(d.slate), q, q.where("provider = 'view'"))
    again = odds.settle(K.signed_margin(), odds.profit_per_unit(F.col("price")))
    bad = F.col("side").isNotNull() & ~again.eqNullSafe(F.col("units"))
    return g.agg(F.count(F.when(bad, 1)).cast("int").alias("grade_mismatches"), F.count("*").alias("graded"))


@query("dq22_root_causes", uses="games", sql="""
    SELECT CASE WHEN NOT completed THEN 'not_played' WHEN neutral THEN 'neutral_site' WHEN week>50 THEN 'postseason' WHEN home_points=away_points THEN 'tie' ELSE 'unexplained' END AS cause, count(*) AS games FROM games GROUP BY 1""")
def _(d):
    out = Q.root_cause(d.games, {"not_played": ~F.col("completed"), "neutral_site": F.col("neutral"), "postseason": F.col("week") > 50, "tie": F.col("home_points") == F.col("away_points")})
    return out.groupBy("cause").agg(F.count("*").alias("games"))


@query("dq23_readiness", uses="games", sql=f"""
    SELECT season, count(*) AS rows, {q6('avg(CAST(home_points IS NULL AS INT))')} AS worst_null, CASE WHEN season=1998 THEN 'forbidden' WHEN avg(CAST(home_points IS NULL AS INT))>0.335 THEN 'incomplete' ELSE 'ready' END AS status FROM games GROUP BY 1""")
def _(d):
    return Q.readiness(d.games, "season", ["home_points", "week"], [1998], 0.335).withColumn("worst_null", r6("worst_null"))


@query("dq24_rating_audits", uses="exposures", sql="""
    WITH o AS (SELECT season, offense AS team, count(*) AS rows, count(DISTINCT game_id) AS games FROM exposures GROUP BY 1, 2)
    SELECT season, count(*) AS teams, count(*) FILTER (rows>games) AS double_counted, min(rows) AS least_rows FROM o GROUP BY 1""")
def _(d):
    o = d.exposures.groupBy("season", "offense").agg(F.count("*").alias("rows"), F.count_distinct("game_id").alias("games"))
    return o.groupBy("season").agg(F.count("*").alias("teams"), F.count(F.when(F.col("rows") > F.col("games"), 1)).alias("double_counted"), F.min("rows").alias("least_rows"))
