"""Joins over games, sides, quotes and exposure rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import guards, joins as J
from .registry import q6, query, r6


@query("jn1_inner_equi", uses="exposures", sql=f"""
    WITH c AS (SELECT offense, count(*) AS n FROM exposures GROUP BY 1), s AS (SELECT defense, {q6('sum(den)')} AS den FROM exposures GROUP BY 1)
    SELECT c.offense AS team, n, den FROM c JOIN s ON c.offense = s.defense""")
def _(d):
    e = d.exposures
    counts = e.groupBy(F.col("offense").alias("team")).agg(F.count("*").alias("n"))
    return counts.join(e.groupBy(F.col("defense").alias("team")).agg(r6(F.sum("den")).alias("den")), "team")


@query("jn2_one_to_one_left", uses="games", sql="""
    SELECT game_id, season, CAST(home_points AS DOUBLE) AS home_points FROM games""")
def _(d):
    schedule = d.games.select("game_id", "season")
    outcomes = d.games.where("completed").select("game_id", F.col("home_points").cast("double"))
    return guards.one_to_one(schedule, outcomes, ["game_id"])


@query("jn3_many_to_one_lookup", sql="SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(d):
    lookup = d.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return guards.left_lookup(d.customer.select("c_custkey", "c_nationkey"), lookup, ["c_nationkey"]).drop("c_nationkey")


@query("jn4_full_outer", uses="games", sql="""
    WITH h AS (SELECT home AS team, count(*) AS n FROM games WHERE neutral GROUP BY 1), a AS (SELECT away AS team, count(*) AS n FROM games WHERE status='2-HIGH' GROUP BY 1)
    SELECT team, coalesce(h.n, 0) AS hosted, coalesce(a.n, 0) AS visited, coalesce(h.n,0)-coalesce(a.n,0) AS net FROM h FULL JOIN a USING (team)""")
def _(d):
    h = d.games.where("neutral").groupBy(F.col("home").alias("team")).agg(F.count("*").alias("hosted"))
    a = d.games.where("status = '2-HIGH'").groupBy(F.col("away").alias("team")).agg(F.count("*").alias("visited"))
    return h.join(a, "team", "full_outer").na.fill(0, ["hosted", "visited"]).withColumn("net", F.col("hosted") - F.col("visited"))


@query("jn5_anti_keys", sql="SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(d):
    return d.orders.select("o_orderkey").join(d.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("jn6_semi_keys", uses="games", sql=f"""
    SELECT l_suppkey, count(*) AS n, {q6('sum(l_quantity)')} AS qty FROM lineitem
    WHERE l_orderkey IN (SELECT game_id FROM games WHERE completed AND neutral) GROUP BY 1""")
def _(d):
    ok = d.games.where("completed AND neutral").select(F.col("game_id").alias("l_orderkey"))
    return d.lineitem.join(ok, "l_orderkey", "left_semi").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("qty"))


@query("jn7_opponent_rows", uses="sides", sql="""
    SELECT game_id, team, opponent AS opponent_team, points_for, points_against AS opp_points_for FROM sides WHERE completed""")
def _(d):
    s = d.sides.where("completed").select("game_id", "team", "points_for")
    return J.opponent_rows(s, ["game_id"], "team", ["points_for"])


@query("jn8_sides_long", uses="sides", sql="SELECT game_id, season, side, team, opponent FROM sides")
def _(d):
    return J.sides(d.games, ["game_id", "season"], {"team": ("home", "away"), "opponent": ("away", "home")})


@query("jn8_sides_wide", uses="games", sql="SELECT game_id, home AS home_team, away AS away_team FROM games")
def _(d):
    long = J.sides(d.games, ["game_id"], {"team": ("home", "away")})
    return J.sides_to_wide(long, ["game_id"], ["team"])


@query("jn9_completed_before", uses="sides", sql="""
    SELECT game_id, side, CAST(coalesce(sum(CAST(completed AS INT)) OVER (PARTITION BY season, team ORDER BY kickoff
           RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS games_before FROM sides""")
def _(d):
    return J.completed_before(d.sides, ["season", "team"], "kickoff", F.col("completed")).select("game_id", "side", "games_before")


@query("jn10_latest_state", uses="quotes slate", sql="""
    SELECT s.game_id, max(q.captured_at) AS matched_captured_at, arg_max(q.quote_id, struct_pack(a := q.captured_at, b := q.quote_id)) AS quote_id
    FROM slate s JOIN quotes q ON q.game_id = s.game_id AND q.captured_at <= s.kickoff GROUP BY 1""")
def _(d):
    out = J.latest_state(d.slate.select("game_id", "kickoff"), d.quotes, ["game_id"], "kickoff", "captured_at", ["quote_id"])
    return out.where("quote_id IS NOT NULL").select("game_id", "matched_captured_at", "quote_id")


def _evidence(d):
    return d.exposures.select("season", "week", "offense", "num", "den",
                              (F.col("kickoff") + F.expr("INTERVAL 6 HOURS")).alias("available"))


def _cutoffs(d):
    return d.games.groupBy("season", F.col("week").alias("as_of_week")).agg(F.min("kickoff").alias("cutoff"))


CUTOFF_SQL = """cutoffs AS (SELECT season, week AS as_of_week, min(kickoff) AS cutoff FROM games GROUP BY 1, 2),
    pairs AS (SELECT e.*, c.as_of_week, c.cutoff FROM exposures e JOIN cutoffs c ON c.season = e.season AND e.week < c.as_of_week
              AND e.kickoff + INTERVAL 6 HOUR <= c.cutoff)"""


@query("jn11_availability_window", uses="exposures games", sql=f"""WITH {CUTOFF_SQL}
    SELECT season, as_of_week, count(*) AS rows, {q6('sum(den)')} AS den FROM pairs GROUP BY 1, 2""")
def _(d):
    return J.available_evidence(_evidence(d), _cutoffs(d)).groupBy("season", "as_of_week").agg(
        F.count("*").alias("rows"), r6(F.sum("den")).alias("den"))


@query("jn12_cutoff_totals", uses="exposures games", sql=f"""WITH {CUTOFF_SQL}
    SELECT season, offense, as_of_week, {q6('sum(num)', 3)} AS num, {q6('sum(den)')} AS den FROM pairs GROUP BY 1, 2, 3""")
def _(d):
    out = J.cutoff_totals(_evidence(d), _cutoffs(d), ["offense"], {"num": F.col("num"), "den": F.col("den")})
    return out.withColumns({"num": r6("num", 3), "den": r6("den")})


@query("jn13_prior_season", uses="exposures", sql=f"""
    WITH t AS (SELECT season, offense, sum(den) AS den FROM exposures GROUP BY 1, 2),
    m AS (SELECT *, CASE season WHEN 1999 THEN 1997 WHEN 1998 THEN NULL ELSE season - 1 END AS ps FROM t)
    SELECT m.season, m.offense, {q6('m.den')} AS den, CAST(m.ps AS DOUBLE) AS prior_season, {q6('p.den')} AS prior_den
    FROM m LEFT JOIN t p ON p.offense = m.offense AND p.season = m.ps""")
def _(d):
    t = d.exposures.groupBy("season", "offense").agg(F.sum("den").alias("den"))
    mapping = d.spark.createDataFrame([(1999, 1997), (1998, None)], "season INT, prior_season INT")
    out = J.prior_season(t, mapping, ["offense"], ["den"])
    return out.select("season", "offense", r6("den").alias("den"), F.col("prior_season").cast("double"), r6("prior_den").alias("prior_den"))


@query("jn14_next_start", uses="plays", sql="""
    WITH s AS (SELECT game_id, quarter, min(yards_to_goal) AS lo, count(*) AS n FROM plays GROUP BY 1, 2),
    seg AS (SELECT game_id, quarter, offense, arg_min(yards_to_goal, play_number) AS start_ytg FROM plays GROUP BY 1, 2, 3),
    one AS (SELECT game_id, quarter, CASE WHEN count(*)=1 THEN min(start_ytg) END AS v FROM seg GROUP BY 1, 2)
    SELECT game_id, quarter, lead(v) OVER (PARTITION BY game_id ORDER BY quarter) AS next_start FROM one""")
def _(d):
    seg = d.plays.groupBy("game_id", "quarter", "offense").agg(F.min_by("yards_to_goal", "play_number").alias("start_ytg"))
    return J.next_start(seg, "game_id", "quarter", "start_ytg")


@query("jn15_target_split", uses="quotes", sql="""
    SELECT quote_id, 'spread' AS target, CAST(spread AS DOUBLE) AS line FROM quotes WHERE spread IS NOT NULL
    UNION ALL SELECT quote_id, 'total', CAST(total AS DOUBLE) FROM quotes WHERE total IS NOT NULL""")
def _(d):
    q = d.quotes.select("quote_id", F.col("spread").cast("double"), F.col("total").cast("double"))
    return J.unpivot_targets(q, ["quote_id"], ["spread", "total"])


@query("jn16_frame_diff", sql="""
    SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS left_value, 'F' AS right_value, 'changed' AS kind FROM orders
      WHERE o_orderkey%5=1 AND o_orderstatus<>'F' AND o_orderkey%7<>0 AND o_orderkey%11<>0
    UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey+3 AS VARCHAR), 'changed' FROM orders
      WHERE o_orderkey%4=1 AND o_orderkey%7<>0 AND o_orderkey%11<>0
    UNION ALL SELECT o_orderkey, '*', NULL, NULL, 'left_only' FROM orders WHERE o_orderkey%7=0 AND o_orderkey%11<>0
    UNION ALL SELECT o_orderkey, '*', NULL, NULL, 'right_only' FROM orders WHERE o_orderkey%11=0 AND o_orderkey%7<>0""")
def _(d):
    o = d.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    k = F.col("o_orderkey")
    changed = o.where(k % 7 != 0).withColumns({
        "o_orderstatus": F.when(k % 5 == 1, "F").otherwise(F.col("o_orderstatus")),
        "o_custkey": F.col("o_custkey") + F.when(k % 4 == 1, 3).when(k % 4 == 2, 1).otherwise(0)})
    return J.frame_diff(o.where(k % 11 != 0), changed, ["o_orderkey"], ["o_orderstatus", "o_custkey"], tolerance=1)


@query("jn17_cardinality_audit", sql="""
    WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    b AS (SELECT coalesce(l.n,0) AS l, coalesce(r.n,0) AS r FROM l FULL JOIN r USING (k))
    SELECT count(*) FILTER (l>1) AS left_duplicates, count(*) FILTER (r>1) AS right_duplicates, count(*) FILTER (r=0) AS left_only,
           count(*) FILTER (l=0) AS right_only, CAST(sum(l*r) AS BIGINT) AS joined_rows, bool_or(l>1 AND r>1) AS many_to_many FROM b""")
def _(d):
    return J.cardinality_audit(d.lineitem.select(F.col("l_orderkey").alias("k")), d.lineitem.select(F.col("l_partkey").alias("k")), ["k"])


@query("jn18_mirror_check", uses="games", sql="""
    SELECT game_id, home AS a, away AS b, CASE WHEN home_points%10=9 THEN 'missing_defense' ELSE 'different' END AS problem
    FROM games WHERE completed AND (home_points%10=9 OR home_points%10=3)""")
def _(d):
    g = d.games.where("completed")
    off = g.select("game_id", F.col("home").alias("team"), F.col("away").alias("opponent"), F.lit("offense").alias("role"),
                   F.col("home_points").alias("v"))
    dfn = g.where("home_points % 10 <> 9").select("game_id", F.col("away").alias("team"), F.col("home").alias("opponent"),
                                                 F.lit("defense").alias("role"),
                                                 (F.col("home_points") + (F.col("home_points") % 10 == 3).cast("int")).alias("v"))
    return J.mirror_problems(off.unionByName(dfn), ["game_id"], "v")


@query("jn19_complete_grid", uses="exposures games", sql=f"""
    WITH o AS (SELECT DISTINCT season, offense AS team FROM exposures), axes AS (SELECT unnest(['off','def']) AS role),
    obs AS (SELECT season, offense AS team, 'off' AS role, sum(CASE WHEN week<=1 THEN den END) AS v FROM exposures GROUP BY 1, 2)
    SELECT o.season, o.team, axes.role, {q6('v')} AS v, CASE WHEN axes.role='def' THEN 'no_observation' WHEN v IS NULL THEN 'null_value' END AS missing_reason
    FROM o CROSS JOIN axes LEFT JOIN obs ON obs.season=o.season AND obs.team=o.team AND obs.role=axes.role""")
def _(d):
    e = d.exposures.withColumnRenamed("offense", "team")
    obs = e.groupBy("season", "team").agg(F.sum(F.when(F.col("week") <= 1, F.col("den"))).alias("v")).withColumn("role", F.lit("off"))
    out = J.complete_grid(e.select("season", "team").distinct(), obs, ["season", "team"], {"role": ["off", "def"]}, "v")
    return out.withColumn("v", r6("v"))


@query("jn20_exposed_games", uses="games sides", sql="""
    WITH f AS (SELECT season, team, min(week) AS w FROM sides WHERE points_for = 48 GROUP BY 1, 2)
    SELECT g.game_id, coalesce(h.w < g.week, false) OR coalesce(a.w < g.week, false) AS exposed FROM games g
    LEFT JOIN f h ON h.season=g.season AND h.team=g.home LEFT JOIN f a ON a.season=g.season AND a.team=g.away""")
def _(d):
    return J.exposed_games(d.games, d.sides.where("points_for = 48")).select("game_id", "exposed")
