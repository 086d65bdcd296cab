"""Window operators, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import playtypes as T
from ..operators import evaluate, metrics as M, scan, windows as W
from .ag import LONG_SQL, long_measures
from .fn import inlist
from .registry import q6, query, r6

DAY = "to_date(ts)"


def _plays(d):
    return d.plays.select("game_id", "play_id", "ts", "quarter", "offense", "defense", "play_type", "offense_score", "k")


@query("wn1_lag", uses="plays", sql="""
    SELECT play_id, CAST(lag(offense_score) OVER w AS DOUBLE) AS previous_score, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS DOUBLE) AS gap_us
    FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY ts, play_id)""")
def _(d):
    p = _plays(d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = scan.previous(p, ["game_id"], ["ts", "play_id"], DAY, {"was": "offense_score", "at": "us"})
    return out.select("play_id", F.col("was").cast("double").alias("previous_score"), (F.col("us") - F.col("at")).cast("double").alias("gap_us"))


@query("wn2_lead", uses="sides", sql="""
    WITH k AS (SELECT team, season, kickoff, max(game_id) AS g FROM sides GROUP BY 1, 2, 3)
    SELECT team, season, kickoff, lead(kickoff) OVER (PARTITION BY team, season ORDER BY kickoff) AS next_kickoff FROM k""")
def _(d):
    slots = d.sides.select("team", "season", "kickoff").distinct()
    return slots.withColumn("next_kickoff", F.lead("kickoff").over(Window.partitionBy("team", "season").orderBy("kickoff")))


@query("wn3_score_envelope", uses="plays", sql="""
    WITH f AS (SELECT game_id, offense, max(offense_score)-3 AS final FROM plays GROUP BY 1, 2)
    SELECT play_id, least(final, max(offense_score) OVER (PARTITION BY game_id, offense ORDER BY ts, play_id)) AS envelope FROM plays JOIN f USING (game_id, offense)""")
def _(d):
    p = _plays(d)
    finals = p.groupBy("game_id", "offense").agg((F.max("offense_score") - 3).alias("final"))
    out = W.score_envelope(p.join(finals, ["game_id", "offense"]), ["game_id", "offense"], ["ts", "play_id"], DAY, "offense_score", "final")
    return out.select("play_id", "envelope")


@query("wn4_regressions", uses="plays", sql="""
    WITH s AS (SELECT game_id, offense, offense_score - lag(offense_score) OVER (PARTITION BY game_id, offense ORDER BY ts, play_id) AS d FROM plays)
    SELECT game_id, offense, count(*) FILTER (d<0) AS drops, coalesce(max(-d), 0) AS largest_drop, count(*) FILTER (d>8) AS jumps, count(*) AS rows FROM s GROUP BY 1, 2""")
def _(d):
    return W.regressions(_plays(d), ["game_id", "offense"], ["ts", "play_id"], DAY, "offense_score")


@query("wn5_position", uses="plays", sql="SELECT play_id, row_number() OVER (PARTITION BY game_id ORDER BY ts, play_id) - 1 AS position FROM plays")
def _(d):
    return W.position(_plays(d), ["game_id"], ["ts", "play_id"], DAY).select("play_id", "position")


@query("wn6_ewma_prior", uses="sides", sql=f"""
    WITH s AS (SELECT season, team, game_id, side, CAST(points_for AS DOUBLE) AS x, row_number() OVER (PARTITION BY season, team ORDER BY kickoff, game_id, side) AS n FROM sides)
    SELECT a.game_id, a.side, {q6('sum(b.x*pow(0.7, a.n-b.n))/sum(CASE WHEN b.x IS NOT NULL THEN pow(0.7, a.n-b.n) END)')} AS ewma
    FROM s a LEFT JOIN s b ON a.season=b.season AND a.team=b.team AND b.n<a.n GROUP BY 1, 2""")
def _(d):
    s = d.sides.withColumn("x", F.col("points_for").cast("double"))
    out = W.ewma_prior(s, ["season", "team"], ["kickoff", "game_id", "side"], "to_date(kickoff)", "x", 0.3, "ewma")
    return out.select("game_id", "side", r6("ewma").alias("ewma"))


@query("wn7_competition_rank", uses="exposures", sql="""
    WITH v AS (SELECT season, offense, CASE WHEN count(DISTINCT game_id)>=40 THEN sum(den) END AS v FROM exposures GROUP BY 1, 2)
    SELECT season, offense, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY season ORDER BY v DESC NULLS LAST) END::DOUBLE AS rank,
      CASE WHEN v IS NOT NULL THEN count(v) OVER (PARTITION BY season) END::DOUBLE AS cohort FROM v""")
def _(d):
    v = d.exposures.groupBy("season", "offense").agg(F.sum("den").alias("v"), F.count_distinct("game_id").alias("games"))
    v = v.withColumn("v", F.when(F.col("games") >= 40, F.col("v")))
    out = scan.competition_rank(v, ["season"], F.col("v"), cohort="cohort")
    return out.select("season", "offense", F.col("rank").cast("double"), F.col("cohort").cast("double"))


@query("wn7_directional_rank", uses="plays", sql=f"""{LONG_SQL},
    sg AS (SELECT *, round(CASE WHEN (metric='turnover_rate') <> (role='defense') THEN -value ELSE value END, 9) AS s FROM long WHERE value IS NOT NULL)
    SELECT team, role, metric, rank() OVER (PARTITION BY role, metric ORDER BY s DESC)::BIGINT AS rank, count(*) OVER (PARTITION BY role, metric) AS cohort FROM sg""")
def _(d):
    # means over 32, 64, ... plays lie halfway between two roundings, where the order of additions would part equal values
    long = long_measures(d).where("value IS NOT NULL").withColumn("s", r6(M.signed_value(F.col("value"), F.col("metric"), F.col("role")), 9))
    out = scan.competition_rank(long, ["role", "metric"], F.col("s"), cohort="cohort")
    return out.select("team", "role", "metric", F.col("rank").cast("long"), "cohort")


TEAM_RATING = "SELECT season, team, round(avg(points_for), 6) AS v FROM sides WHERE completed GROUP BY 1, 2"


def _ratings(d):
    return d.sides.where("completed").groupBy("season", "team").agg(F.round(F.avg("points_for"), 6).alias("v"))


@query("wn8_ordinal_rank", uses="sides", sql=f"WITH v AS ({TEAM_RATING}) SELECT season, team, row_number() OVER (PARTITION BY season ORDER BY v DESC, team) AS rank FROM v")
def _(d):
    return W.ordinal_rank(_ratings(d), ["season"], F.col("v"), "team").select("season", "team", "rank")


@query("wn9_tied_flag", uses="sides", sql=f"""WITH v AS ({TEAM_RATING}), r AS (SELECT season, team, rank() OVER (PARTITION BY season ORDER BY v DESC) AS rank FROM v)
    SELECT season, team, rank, count(*) OVER (PARTITION BY season, rank) > 1 AS tied FROM r""")
def _(d):
    ranked = scan.competition_rank(_ratings(d), ["season"], F.col("v")).withColumn("rank", F.col("rank").cast("long"))
    return W.tied_flag(ranked, ["season"]).select("season", "team", "rank", "tied")


@query("wn10_elite_reference", uses="sides", sql=f"""WITH v AS ({TEAM_RATING}), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY v DESC, team) AS rn FROM v)
    SELECT a.season, a.team, {q6('avg(b.v)')} AS reference FROM r a JOIN r b ON a.season=b.season AND b.team<>a.team AND b.rn <= CASE WHEN a.rn<=25 THEN 26 ELSE 25 END GROUP BY 1, 2""")
def _(d):
    return W.elite_reference(_ratings(d), ["season"], "v", "team").select("season", "team", r6("reference").alias("reference"))


@query("wn12_cumulative_snapshot", uses="exposures", sql=f"""
    WITH p AS (SELECT season, offense, week, sum(num) AS n, sum(den) AS dn, count(*) AS c FROM exposures GROUP BY 1, 2, 3)
    SELECT season, offense, week, {q6('sum(n) OVER w/sum(dn) OVER w', 4)} AS value, {q6('sum(dn) OVER w')} AS exposure, CAST(sum(c) OVER w AS BIGINT) AS contributors
    FROM p WINDOW w AS (PARTITION BY season, offense ORDER BY week)""")
def _(d):
    out = W.cumulative_snapshot(d.exposures, ["season", "offense"], "week", "num", "den")
    return out.withColumns({"value": r6("value", 4), "exposure": r6("exposure")})


@query("wn13_half_life_mean", uses="exposures", sql=f"""
    WITH k AS (SELECT DISTINCT season, offense FROM exposures),
    a AS (SELECT *, row_number() OVER (PARTITION BY season, offense ORDER BY kickoff DESC, game_id DESC, play_number DESC, num DESC)-1 AS age FROM exposures WHERE num IS NOT NULL AND den > 0)
    SELECT season, offense, {q6('sum(num*pow(0.5, age/8.0))/sum(den*pow(0.5, age/8.0))', 4)} AS value, coalesce({q6('sum(den*pow(0.5, age/8.0))')}, 0) AS exposure, count(num) AS games
    FROM k LEFT JOIN a USING (season, offense) GROUP BY 1, 2""")
def _(d):
    out = W.half_life_mean(d.exposures, ["season", "offense"], ["kickoff", "game_id", "play_number", "num"], "week", "num", "den", 8.0)
    return out.withColumns({"value": r6("value", 4), "exposure": r6("exposure")})


@query("wn14_shrinkage_offset", uses="sides", sql=f"""
    WITH l AS (SELECT season+1 AS season, avg(points_for) AS prior FROM sides GROUP BY 1), k AS (SELECT season, team, kickoff, sum(points_for) AS s, count(points_for) AS n FROM sides GROUP BY 1, 2, 3),
    c AS (SELECT season, team, kickoff, coalesce(sum(s) OVER w, 0) AS s, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS n FROM k WINDOW w AS (PARTITION BY season, team ORDER BY kickoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT season, team, kickoff, n AS games_before, {q6('(s + 4*coalesce(prior, 0))/(n+4)')} AS shrunk FROM c LEFT JOIN l USING (season)""")
def _(d):
    s = d.sides.withColumn("x", F.col("points_for").cast("double"))
    out = W.shrunk_prior(s, ["team"], "kickoff", "x", 4.0)
    return out.withColumns({"shrunk": r6("shrunk"), "games_before": F.col("games_before").cast("long")})


@query("wn15_drive_segments", uses="plays", sql=f"""
    WITH s AS (SELECT play_id, game_id, ts, offense, play_type, lag(offense) OVER w AS lo, lag(play_type) OVER w AS lt FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY ts, play_id))
    SELECT play_id, CAST(sum(CASE WHEN lo IS NULL OR lo<>offense OR lt IN {inlist(T.END_OF_DRIVE + T.TURNOVER)} OR lt ILIKE '%touchdown%' OR play_type IN {inlist(T.KICKOFF)} THEN 1 ELSE 0 END)
      OVER (PARTITION BY game_id ORDER BY ts, play_id) AS BIGINT) AS drive_number FROM s""")
def _(d):
    ends = F.col("play_type").isin(T.END_OF_DRIVE + T.TURNOVER) | F.lower("play_type").contains("touchdown")
    out = W.assign_segments(_plays(d), ["game_id"], ["ts", "play_id"], DAY, "offense", ends, F.col("play_type").isin(T.KICKOFF))
    return out.select("play_id", "drive_number")


@query("wn16_unresolved_order", uses="plays", sql="""
    SELECT play_id, CASE WHEN quarter=5 THEN 'missing_period' WHEN count(*) OVER (PARTITION BY game_id, quarter, k) > 1 THEN 'tied_sequence' END AS order_reason,
      quarter=5 OR count(*) OVER (PARTITION BY game_id, quarter, k) > 1 AS order_unresolved FROM plays""")
def _(d):
    p = _plays(d).withColumn("period", F.when(F.col("quarter") < 5, F.col("quarter")))
    return W.unresolved_order(p, ["game_id", "quarter", "k"], "period").select("play_id", "order_reason", "order_unresolved")


@query("wn17_recentering", uses="graded", sql=f"""
    SELECT a.target, a.season, a.n, {q6('coalesce(avg(b.prediction-b.actual), 0)')} AS shift FROM (SELECT target, season, count(*) AS n FROM graded GROUP BY 1, 2) a
    LEFT JOIN graded b ON b.target=a.target AND b.season<a.season GROUP BY 1, 2, 3""")
def _(d):
    return evaluate.recentered(d.graded, ["target"]).withColumn("shift", r6("shift"))


@query("wn18_weekly_movement", uses="sides", sql=f"""WITH v AS ({TEAM_RATING}), r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY v DESC) AS rank FROM v)
    SELECT season, team, {q6('v-lag(v) OVER w')} AS v_change, CAST(rank-lag(rank) OVER w AS DOUBLE) AS rank_change FROM r WINDOW w AS (PARTITION BY team ORDER BY season)""")
def _(d):
    ranked = scan.competition_rank(_ratings(d), ["season"], F.col("v"))
    out = W.movement(ranked, ["team"], "season", ["v", "rank"])
    return out.select("season", "team", r6("v_change").alias("v_change"), F.col("rank_change").cast("double"))


@query("wn19_order_violations", uses="plays", sql=" UNION ALL ".join(f"""
    SELECT game_id, count(*) FILTER (quarter<p) AS period_back, count(*) FILTER (quarter=p AND k>c) AS clock_up, '{r}' AS rule FROM
      (SELECT game_id, quarter, k, lag(quarter) OVER w AS p, lag(k) OVER w AS c FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY {o})) GROUP BY 1"""
    for r, o in (("time", "ts, play_id"), ("day_then_clock", "CAST(ts AS DATE), k DESC, play_id"))))
def _(d):
    p = _plays(d).withColumns({"day": F.to_date("ts"), "neg_k": -F.col("k")})
    return W.order_violations(p, ["game_id"], DAY, {"time": ["ts", "play_id"], "day_then_clock": ["day", "neg_k", "play_id"]}, "quarter", "k")


@query("wn20_weekly_cutoffs", uses="games", sql="SELECT season, week, min(kickoff) AS cutoff FROM games WHERE NOT neutral GROUP BY 1, 2")
def _(d):
    return d.games.where("NOT neutral").groupBy("season", "week").agg(F.min("kickoff").alias("cutoff"))


@query("wn21_first_inclusion", uses="games", sql="""
    WITH slots AS (SELECT DISTINCT season, week, kickoff FROM games), src AS (SELECT DISTINCT season, week AS w, kickoff AS k FROM games),
    b AS (SELECT src.season, w, k, min(s.kickoff) AS bk FROM src JOIN slots s ON s.season=src.season AND s.week>w AND s.kickoff>=k+INTERVAL 6 HOUR GROUP BY 1, 2, 3),
    bg AS (SELECT b.season, w, k, bk, min(g.game_id) AS bg FROM b JOIN games g ON g.season=b.season AND g.kickoff=bk AND g.week>w GROUP BY 1, 2, 3, 4)
    SELECT g.season, g.game_id, CAST(bg AS DOUBLE) AS boundary_game_id, bk AS boundary_kickoff FROM games g LEFT JOIN bg ON bg.season=g.season AND bg.w=g.week AND bg.k=g.kickoff""")
def _(d):
    out = W.first_inclusion(d.games)
    return out.withColumn("boundary_game_id", F.col("boundary_game_id").cast("double"))


@query("so1_total_order", uses="plays", sql="SELECT play_id, quarter FROM plays")
def _(d):
    return d.plays.orderBy("season", "week", "game_id", "quarter", "play_number", "play_id").select("play_id", "quarter")


@query("so2_keep_last", uses="quotes", sql="""
    SELECT game_id, provider, arg_max(quote_id, struct_pack(a := captured_at, b := quote_id)) AS quote_id, max(captured_at) AS captured_at FROM quotes GROUP BY 1, 2""")
def _(d):
    return d.quotes.groupBy("game_id", "provider").agg(
        F.max_by("quote_id", F.struct("captured_at", "quote_id")).alias("quote_id"), F.max("captured_at").alias("captured_at"))


@query("so3_keep_first", sql="""
    SELECT l_orderkey, l_linenumber, arg_min(l_partkey, struct_pack(a := l_shipdate, b := l_partkey)) AS l_partkey FROM lineitem GROUP BY 1, 2""")
def _(d):
    return d.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("l_partkey"))


@query("so4_top1_multi_key", uses="quotes", sql="""
    SELECT game_id, quote_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY spread DESC, coalesce(side_price, -110) DESC, quote_id) AS rn FROM quotes WHERE spread IS NOT NULL) WHERE rn=1""")
def _(d):
    best = F.struct((-F.col("spread")).alias("p"), (-F.coalesce("side_price", F.lit(-110))).alias("price"), F.col("quote_id"))
    return d.quotes.where("spread IS NOT NULL").groupBy("game_id").agg(F.min_by("quote_id", best).alias("quote_id"))


@query("so5_top_edges", uses="graded", sql="""
    SELECT season, game_id, target, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY abs(prediction-line) DESC, game_id, target) AS INT) AS rn FROM graded) WHERE rn<=10""")
def _(d):
    w = Window.partitionBy("season").orderBy(F.abs(F.col("prediction") - F.col("line")).desc(), "game_id", "target")
    return d.graded.withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("season", "game_id", "target", "rn")


@query("so6_latest_row", uses="sides", sql="SELECT team, arg_max(game_id, struct_pack(a := kickoff, b := game_id)) AS game_id, max(kickoff) AS kickoff FROM sides GROUP BY 1")
def _(d):
    return d.sides.groupBy("team").agg(F.max_by("game_id", F.struct("kickoff", "game_id")).alias("game_id"), F.max("kickoff").alias("kickoff"))


@query("so7_last_week", uses="exposures", sql=f"""
    WITH m AS (SELECT season, offense, max(week) AS week FROM exposures GROUP BY 1, 2) SELECT season, offense, week, {q6('sum(den)')} AS den FROM exposures JOIN m USING (season, offense, week) GROUP BY 1, 2, 3""")
def _(d):
    per = d.exposures.groupBy("season", "offense", "week").agg(F.sum("den").alias("den"))
    return per.groupBy("season", "offense").agg(F.max("week").alias("week"), r6(F.max_by("den", "week")).alias("den"))


@query("st1_union_missing_columns", uses="sides exposures", sql="""
    SELECT season, team, count(*) AS n, count(week) AS weeks, count(den) AS dens FROM (SELECT season, team, week, NULL AS den FROM sides UNION ALL SELECT season, offense, NULL, den FROM exposures) GROUP BY 1, 2""")
def _(d):
    a = d.sides.select("season", "team", "week")
    b = d.exposures.select("season", F.col("offense").alias("team"), "den")
    return a.unionByName(b, allowMissingColumns=True).groupBy("season", "team").agg(F.count("*").alias("n"), F.count("week").alias("weeks"), F.count("den").alias("dens"))


@query("st2_union_roles", uses="exposures", sql=f"""
    SELECT team, role, {q6('sum(den)')} AS den FROM (SELECT offense AS team, 'offense' AS role, den FROM exposures UNION ALL SELECT defense, 'defense', den FROM exposures) GROUP BY 1, 2""")
def _(d):
    e = d.exposures
    both = e.select(F.col("offense").alias("team"), F.lit("offense").alias("role"), "den").union(e.select("defense", F.lit("defense"), "den"))
    return both.groupBy("team", "role").agg(r6(F.sum("den")).alias("den"))


@query("st3_team_universe", uses="games", sql="SELECT season, home AS team FROM games UNION SELECT season, away FROM games")
def _(d):
    return d.games.select("season", F.col("home").alias("team")).union(d.games.select("season", "away")).distinct()


@query("st4_key_set_agreement", uses="games", sql="""
    WITH a AS (SELECT DISTINCT season, home AS team FROM games), b AS (SELECT DISTINCT season, away AS team FROM games)
    SELECT season, team, 'both' AS place FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT season, team, 'home_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT season, team, 'away_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(d):
    a = d.games.select("season", F.col("home").alias("team"))
    b = d.games.select("season", F.col("away").alias("team"))
    tag = lambda df, name: df.withColumn("place", F.lit(name))
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "home_only")).union(tag(b.subtract(a), "away_only"))


@query("wn11_last_k_means", uses="sides", sql="""
    WITH r AS (SELECT season, team, points_for AS x, row_number() OVER (PARTITION BY season, team ORDER BY kickoff DESC, game_id DESC, side DESC) AS rn FROM sides)
    SELECT season, team, """ + ", ".join(q6(f"avg(x) FILTER (rn<={k})") + f" AS last_{k}" for k in (1, 2, 3)) + " FROM r GROUP BY 1, 2")
def _(d):
    w = Window.partitionBy("season", "team").orderBy(F.desc("kickoff"), F.desc("game_id"), F.desc("side"))
    recent = d.sides.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return recent.groupBy("season", "team").agg(*[r6(F.avg(F.when(F.col("rn") <= k, F.col("points_for")))).alias(f"last_{k}") for k in (1, 2, 3)])
