"""Feature blocks, forecasting and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import plays as P, regimes
from ..operators import evaluate as E, features as X, forecast as M, joins as J, rollup as R, windows as W
from ..operators.scan import exact_quantiles
from .ag import DRIVES_SQL, ENRICHED, enriched
from .fn import ZONES, geodesic_sql, sql_cdf
from .registry import q6, query, r6

FEATS = ["prediction", "line"]
ALPHAS = [1.0, 10.0, 100.0]


def _frame(d):
    return d.graded.select("target", "season", "week", "game_id", "prediction", "line", F.col("actual").alias("y"), "sigma")


def ridge_sql(alphas=ALPHAS, horizon=None):
    """Two-feature ridge in closed form per (target, validation season, alpha)."""
    late = f" AND t.season>=v.season-{horizon}" if horizon else ""
    return f"""WITH v AS (SELECT DISTINCT target, season FROM graded),
    mo AS (SELECT v.target, v.season, count(*) AS n, avg(t.prediction) AS m1, avg(t.line) AS m2, avg(t.actual) AS my, stddev_pop(t.prediction) AS s1, stddev_pop(t.line) AS s2,
        covar_pop(t.prediction, t.line) AS c12, covar_pop(t.prediction, t.actual) AS c1, covar_pop(t.line, t.actual) AS c2 FROM v JOIN graded t ON t.target=v.target AND t.season<v.season{late} GROUP BY 1, 2),
    al AS (SELECT unnest({alphas}) AS alpha),
    nm AS (SELECT *, n+alpha AS a11, n*c12/(s1*s2) AS a12, n*c1/s1 AS b1, n*c2/s2 AS b2 FROM mo CROSS JOIN al),
    co AS (SELECT target, season, alpha, n, (b1*a11-b2*a12)/(a11*a11-a12*a12)/s1 AS w1, (b2*a11-b1*a12)/(a11*a11-a12*a12)/s2 AS w2, my, m1, m2 FROM nm),
    fit AS (SELECT g.target, g.season, g.week, g.game_id, g.actual, g.line, alpha, my+w1*(g.prediction-m1)+w2*(g.line-m2) AS f FROM graded g JOIN co USING (target, season))"""


@query("ml1_ridge_fit", uses="graded", sql=f"{ridge_sql()} SELECT target, season, alpha, CAST(n AS DOUBLE) AS n_train, {q6('my-w1*m1-w2*m2')} AS intercept, {q6('w1')} AS b1, {q6('w2')} AS b2 FROM co")
def _(d):
    out = M.solve(M.earlier_moments(M.season_moments(M.clean(_frame(d), FEATS), FEATS)), FEATS, ALPHAS)
    return out.select("target", "season", "alpha", "n_train", r6("intercept").alias("intercept"), r6(F.col("beta")[0]).alias("b1"), r6(F.col("beta")[1]).alias("b2"))


ALPHA_SQL = """, pe AS (SELECT target, season, alpha, sum(abs(f-actual)) AS e, count(*) AS n FROM fit GROUP BY 1, 2, 3),
    pa AS (SELECT target, season, alpha, sum(e) OVER w/sum(n) OVER w AS mae FROM pe WINDOW w AS (PARTITION BY target, alpha ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pk AS (SELECT target, season, max(alpha) FILTER (mae<=best*1.005) AS al FROM (SELECT *, min(mae) OVER (PARTITION BY target, season) AS best FROM pa) GROUP BY 1, 2)"""


@query("ml2_inner_alpha", uses="graded", sql=f"{ridge_sql()}{ALPHA_SQL} SELECT target, season, coalesce(al, 10.0)::DOUBLE AS alpha, al IS NULL AS fallback FROM pk")
def _(d):
    return M.inner_alpha(M.rolling_origin(_frame(d), FEATS, ALPHAS))


@query("ml3_rolling_origin", uses="graded", sql=f"{ridge_sql([10.0])} SELECT target, season, count(*) AS n, {q6('avg(abs(f-actual))')} AS mae, {q6('avg(f-actual)')} AS bias FROM fit GROUP BY 1, 2")
def _(d):
    p = M.rolling_origin(_frame(d), FEATS, [10.0])
    return p.groupBy("target", "season").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("fitted") - F.col("y")))).alias("mae"), r6(F.avg(F.col("fitted") - F.col("y"))).alias("bias"))


@query("ml3_latest_two_seasons", uses="graded", sql=f"{ridge_sql([10.0], 2)} SELECT target, season, game_id, {q6('f')} AS fitted FROM fit")
def _(d):
    return M.rolling_origin(_frame(d), FEATS, [10.0], horizon=2).select("target", "season", "game_id", r6("fitted").alias("fitted"))


@query("ml4_calibration", uses="graded", sql=f"""{ridge_sql()}{ALPHA_SQL}, ch AS (SELECT fit.* FROM fit JOIN pk ON pk.target=fit.target AND pk.season=fit.season AND coalesce(pk.al, 10.0)=fit.alpha),
    rs AS (SELECT target, season, sum(pow(f-actual, 2)) AS s, count(*) AS n FROM ch GROUP BY 1, 2)
    SELECT target, season, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS residuals, {q6('coalesce(sum(s) OVER w/sum(n) OVER w, 1e-6)')} AS variance, CASE WHEN sum(n) OVER w IS NULL THEN 'no_prior_residuals' END AS fallback_reason
    FROM rs WINDOW w AS (PARTITION BY target ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(d):
    p = M.rolling_origin(_frame(d), FEATS, ALPHAS)
    chosen = p.join(M.inner_alpha(p).select("target", "season", "alpha"), ["target", "season", "alpha"])
    return M.calibrated_variance(chosen).withColumn("variance", r6("variance"))


@query("ml5_batch_scoring", uses="graded", sql=f"""{ridge_sql([10.0])} SELECT game_id, target, {q6('f')} AS mean, {q6('f-1.6448536269514722*13')} AS lo90, {q6('f+1.6448536269514722*13')} AS hi90 FROM fit""")
def _(d):
    from ..functions.stats import interval
    f = M.clean(_frame(d), FEATS)
    coef = M.solve(M.earlier_moments(M.season_moments(f, FEATS)), FEATS, [10.0])
    lo, hi = interval(F.col("fitted"), F.lit(13.0), 90)
    return M.score(f, coef, FEATS).select("game_id", "target", r6("fitted").alias("mean"), r6(lo).alias("lo90"), r6(hi).alias("hi90"))


BOOT_SQL = """WITH df AS (SELECT season, week, abs(line-actual)-abs(prediction-actual) AS x FROM graded WHERE target='margin'),
    cl AS (SELECT season, week, count(*) AS n, row_number() OVER (ORDER BY season, week)-1 AS i FROM df WHERE x IS NOT NULL GROUP BY 1, 2), t AS (SELECT count(*) AS k FROM cl),
    g AS (SELECT i, n, x, row_number() OVER (PARTITION BY season, week ORDER BY x)-1 AS j FROM df JOIN cl USING (season, week) WHERE x IS NOT NULL),
    dr AS (SELECT r.r AS replicate, cl.i AS slot, ('0x'||substr(sha256('s:'||r.r||':'||cl.i), 1, 15))::BIGINT % k AS i FROM cl CROSS JOIN t CROSS JOIN (SELECT unnest(range(0, 40)) AS r) r),
    ag AS (SELECT replicate, i, ('0x'||substr(sha256('s:'||replicate||':'||slot||':'||g.j), 1, 15))::BIGINT % g.n AS j FROM dr JOIN g USING (i)),
    rp AS (SELECT replicate, avg(x) AS mean FROM ag JOIN g USING (i, j) GROUP BY 1)"""


def _bootstrap(d):
    x = d.graded.where("target = 'margin'").withColumn("x", F.abs(F.col("line") - F.col("actual")) - F.abs(F.col("prediction") - F.col("actual")))
    return M.cluster_bootstrap(x, ["season", "week"], "x", 40)


@query("ml6_bootstrap_replicates", uses="graded", sql=f"{BOOT_SQL} SELECT CAST(replicate AS INT) AS replicate, {q6('mean')} AS mean FROM rp")
def _(d):
    return _bootstrap(d).withColumn("mean", r6("mean"))


@query("ml6_bootstrap_interval", uses="graded", sql=f"{BOOT_SQL} SELECT {q6('avg(mean)')} AS mean, {q6('quantile_cont(mean, 0.05)')} AS lower, {q6('quantile_cont(mean, 0.95)')} AS upper FROM rp")
def _(d):
    return M.interval_of(_bootstrap(d)).select(*[r6(c).alias(c) for c in ("mean", "lower", "upper")])


@query("ml7_candidate_selection", uses="graded", sql=f"""
    WITH s AS (SELECT target, c, CASE c WHEN 'line' THEN 1 WHEN 'model' THEN 2 ELSE 3 END AS cx, avg(abs(CASE c WHEN 'line' THEN line WHEN 'model' THEN prediction ELSE (line+prediction)/2 END - actual)) AS mae
      FROM graded CROSS JOIN (SELECT unnest(['line','model','blend']) AS c) GROUP BY 1, 2),
    r AS (SELECT s.c AS candidate, s.cx, avg(s.mae) AS mae, avg(b.mae-s.mae) AS gain, min(b.mae-s.mae) AS worst FROM s JOIN s b ON b.target=s.target AND b.c='line' GROUP BY 1, 2),
    p AS (SELECT *, gain>=0 AND worst>=-5 AS passes FROM r)
    SELECT candidate, {q6('mae')} AS mae, {q6('gain')} AS gain, {q6('worst')} AS worst, passes, candidate=(SELECT candidate FROM p WHERE passes AND mae<=(SELECT min(mae) FROM p WHERE passes)+5 ORDER BY cx, mae, candidate LIMIT 1) AS selected FROM p""")
def _(d):
    options = F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(c).alias("complexity"), v.alias("p")) for n, c, v in (
        ("line", 1, F.col("line")), ("model", 2, F.col("prediction")), ("blend", 3, (F.col("line") + F.col("prediction")) / 2))])
    s = d.graded.select("target", "actual", F.inline(options)).groupBy("target", "candidate", "complexity").agg(F.avg(F.abs(F.col("p") - F.col("actual"))).alias("mae"))
    return M.select_candidate(s, "line", 0.0, 5.0).withColumns({c: r6(c) for c in ("mae", "gain", "worst")})


SCORES = f"""count(*) AS n, {q6('avg(abs(prediction-actual))')} AS mae, {q6('sqrt(avg(pow(prediction-actual, 2)))')} AS rmse, {q6('avg(prediction-actual)')} AS bias, {q6('avg(crps)')} AS crps,
    """ + ", ".join(f"{q6(f'avg(CAST(abs(prediction-actual)<={z}*sigma AS INT))')} AS coverage_{l}, {q6(f'avg(2*{z}*sigma)')} AS width_{l}"
                   for l, z in ((50, 0.6744897501960817), (80, 1.2815515655446004), (95, 1.959963984540054)))


@query("ml8_scorecard", uses="graded", sql=f"""
    WITH z AS (SELECT *, (actual-prediction)/sigma AS z FROM graded), c AS (SELECT *, sigma*(z*(2*{sql_cdf('z')}-1)+2*exp(-0.5*z*z)/sqrt(2*pi())-1/sqrt(pi())) AS crps FROM z)
    SELECT target, coalesce(CAST(season AS VARCHAR), 'all') AS season, {SCORES} FROM c GROUP BY GROUPING SETS ((target, season), (target))""")
def _(d):
    out = E.scorecard(d.graded, [["target", "season"], ["target"]], ["target", "season"])
    return out.select("target", F.coalesce(F.col("season").cast("string"), F.lit("all")).alias("season"), "n", *[r6(c).alias(c) for c in out.columns[3:]])


@query("ml9_error_slices", uses="graded", sql=f"""
    WITH s AS (SELECT *, 'stage' AS dimension, CASE WHEN stage>=4 THEN '4_plus' ELSE CAST(stage AS VARCHAR) END AS label FROM graded UNION ALL
      SELECT *, 'weeks', CASE WHEN week<=4 THEN CAST(week AS VARCHAR) WHEN week<=8 THEN '5-8' WHEN week<=12 THEN '9-12' ELSE '13-16' END FROM graded UNION ALL
      SELECT *, 'favourite', CASE WHEN line<0 THEN 'home' ELSE 'away' END FROM graded)
    SELECT target, dimension, label, count(*) AS n, {q6('avg(abs(prediction-actual))')} AS mae, {q6('sqrt(avg(pow(prediction-actual, 2)))')} AS rmse, {q6('avg(prediction-actual)')} AS bias,
      {q6('avg(CAST(abs(prediction-actual)<=1.6448536269514722*sigma AS INT))')} AS coverage_90, count(*)<200 AS small_cell FROM s GROUP BY 1, 2, 3""")
def _(d):
    out = E.slice_table(d.graded.select("target", "prediction", "actual", "sigma", "stage", "week", "line"), {
        "stage": regimes.stage_key(F.col("stage")), "weeks": regimes.week_bucket(F.col("week")), "favourite": F.when(F.col("line") < 0, "home").otherwise("away")}, small=200)
    return out.withColumns({c: r6(c) for c in ("mae", "rmse", "bias", "coverage_90")})


@query("ml9_early_season_cost", uses="graded", sql=f"""
    SELECT target, {q6('avg(abs(prediction-actual)) FILTER (week<=4)')} AS early_mae, {q6('avg(abs(prediction-actual)) FILTER (week>4)')} AS later_mae,
      {q6('avg(abs(prediction-actual)) FILTER (week<=4)-avg(abs(prediction-actual)) FILTER (week>4)')} AS cost FROM graded GROUP BY 1""")
def _(d):
    return E.early_season_cost(d.graded, F.col("week") <= 4).withColumns({c: r6(c) for c in ("early_mae", "later_mae", "cost")})


@query("ml10_total_bias", uses="slate", sql=f"""
    WITH e AS (SELECT week, (pred_total+pred_margin)/2-home_points AS h, (pred_total-pred_margin)/2-away_points AS a, pred_total-home_points-away_points AS t FROM slate WHERE completed)
    SELECT coalesce(CAST(week AS VARCHAR), 'all') AS week, count(*) AS n, {q6('avg(h)')} AS home_bias, {q6('avg(a)')} AS away_bias, {q6('avg(t)')} AS total_bias, {q6('pow(avg(t), 2)/avg(t*t)')} AS bias_share, {q6('corr(h, a)')} AS error_corr
    FROM e GROUP BY GROUPING SETS ((week), ())""")
def _(d):
    s = d.slate.where("completed")
    both = s.select("*", F.explode(F.array(F.col("week").cast("string"), F.lit("all"))).alias("bucket"))
    out = E.total_bias(both.drop("week").withColumnRenamed("bucket", "week"), ["week"])
    return out.withColumns({c: r6(c) for c in ("home_bias", "away_bias", "total_bias", "bias_share", "error_corr")})


@query("ml11_claim_matching", uses="graded", sql=f"""
    WITH m AS (SELECT season, target, avg(abs(prediction-actual)) AS v FROM graded GROUP BY 1, 2), c AS (SELECT season, target, v + CASE season%3 WHEN 0 THEN 0 WHEN 1 THEN 0.0005 ELSE 0.5 END AS rep FROM m UNION ALL SELECT 2030, 'margin', 1.0)
    SELECT c.season, c.target, CASE WHEN m.v IS NULL THEN 'not_found' WHEN abs(rep-m.v)<=0.001 THEN 'match' ELSE 'mismatch' END AS status FROM c LEFT JOIN m USING (season, target)""")
def _(d):
    m = d.graded.groupBy("season", "target").agg(F.avg(F.abs(F.col("prediction") - F.col("actual"))).alias("value"))
    gap = F.when(F.col("season") % 3 == 0, 0.0).when(F.col("season") % 3 == 1, 0.0005).otherwise(0.5)
    claims = m.select("season", "target", (F.col("value") + gap).alias("reported"))
    extra = d.region.where("r_regionkey = 0").select(F.lit(2030).alias("season"), F.lit("margin").alias("target"), F.lit(1.0).alias("reported"))
    return E.match_claims(m, claims.unionByName(extra), ["season", "target"], 0.001).select("season", "target", "status")


@query("ml12_paired_models", uses="graded", sql=f"""
    SELECT target, count(*) AS n, {q6('avg(abs(prediction-actual))')} AS mae_a, {q6('avg(abs(line-actual))')} AS mae_b, {q6('avg(abs(line-actual)-abs(prediction-actual))')} AS improvement,
      count(*) FILTER (abs(prediction-actual)<abs(line-actual)) AS a_closer FROM graded WHERE game_id%5<>0 GROUP BY 1""")
def _(d):
    a = d.graded.select("game_id", "target", "actual", "prediction")
    b = d.graded.where("game_id % 5 <> 0").select("game_id", "target", F.col("line").alias("prediction"))
    return E.paired_models(a, b, ["game_id", "target"]).withColumns({c: r6(c) for c in ("mae_a", "mae_b", "improvement")})


@query("ml13_market_diagnostic", uses="graded", sql=f"""
    SELECT target, stage, count(*) AS n, {q6('corr(line, actual)')} AS line_corr, {q6('quantile_cont(prediction-line, 0.25)')} AS edge_q1, {q6('median(prediction-line)')} AS edge_median, {q6('quantile_cont(prediction-line, 0.75)')} AS edge_q3,
      CASE WHEN corr(line, actual)<0 THEN 'home_signed_line' ELSE 'margin_signed_line' END AS sign_rule FROM graded GROUP BY 1, 2""")
def _(d):
    edge = F.col("prediction") - F.col("line")
    out = d.graded.groupBy("target", "stage").agg(F.count("*").alias("n"), F.corr("line", "actual").alias("c"))
    out = out.join(exact_quantiles(d.graded.withColumn("edge", edge), ["target", "stage"], "edge", [0.25, 0.5, 0.75], "q"), ["target", "stage"])
    return out.select("target", "stage", "n", r6("c").alias("line_corr"), *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("edge_q1", "edge_median", "edge_q3"))],
                      F.when(F.col("c") < 0, "home_signed_line").otherwise("margin_signed_line").alias("sign_rule"))


@query("ml14_training_filter", uses="graded", sql="SELECT season, target, count(*) AS n FROM graded WHERE season<2000 AND season<>1998 AND line IS NOT NULL GROUP BY 1, 2")
def _(d):
    allowed = (F.col("season") < 2000) & (F.col("season") != 1998)
    return d.graded.where(allowed & F.col("actual").isNotNull() & F.col("line").isNotNull()).groupBy("season", "target").agg(F.count("*").alias("n"))


@query("ml15_weekly_season", uses="sides games", sql=f"""
    WITH st AS (SELECT t.game_id, t.side, t.season, coalesce(sum((e.points_for-24)/14.0*2)/4/(1+count(e.points_for)*2/4.0), 0) AS m FROM sides t LEFT JOIN sides e ON e.season=t.season AND e.team=t.team AND e.week<t.week
        AND e.kickoff + INTERVAL 6 HOUR <= t.kickoff AND e.points_for IS NOT NULL GROUP BY 1, 2, 3),
    f AS (SELECT g.season, g.week, g.game_id, 2.5+10*(h.m-a.m) AS mean, g.home_points-g.away_points AS actual FROM games g JOIN st h ON h.game_id=g.game_id AND h.side='home' JOIN st a ON a.game_id=g.game_id AND a.side='away')
    SELECT season, week, count(*) AS games, {q6('avg(abs(mean-actual))')} AS mae, count(*) FILTER (round(mean, 6)*actual>0) AS winners FROM f GROUP BY 1, 2""")
def _(d):
    from ..operators.ratings import replay_pregame
    from ..operators.windows import first_inclusion
    b = first_inclusion(d.games).select("game_id", F.col("boundary_kickoff").alias("usable_from"))
    ev = d.sides.join(b, "game_id").where("usable_from IS NOT NULL").select(
        "season", "team", "usable_from", F.when(F.col("points_for").isNotNull(), 2.0).alias("exposure"), ((F.col("points_for") - 24) / 14.0).alias("z"))
    st = replay_pregame(d.sides.select("season", "team", "game_id", "kickoff"), ev, ["season", "team"], 4.0)
    f = X.matchup_frame(d.games, st.select("game_id", "team", "mean"), ["mean"])
    mean, actual = 2.5 + 10 * (F.col("home_mean") - F.col("away_mean")), F.col("home_points") - F.col("away_points")
    return f.groupBy("season", "week").agg(F.count("*").alias("games"), r6(F.avg(F.abs(mean - actual))).alias("mae"), F.count(F.when(F.round(mean, 6) * actual > 0, 1)).alias("winners"))


@query("fe1_preaggregation", uses="plays", sql=f"""{ENRICHED}, {DRIVES_SQL},
    o AS (SELECT season, week, game_id, offense AS team, avg(success) AS sr, avg(ppa) AS epa FROM en GROUP BY 1, 2, 3, 4), q AS (SELECT game_id, offense AS team, avg(is_successful_drive) AS sdr FROM dro GROUP BY 1, 2),
    tg AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY week DESC, game_id DESC) AS rn FROM o JOIN q USING (game_id, team)), w AS (SELECT *, greatest(5-rn, 1) AS w FROM tg)
    SELECT season, team, count(*) AS games_played, {q6('coalesce(sum(sr*w),0)/sum(w)')} AS off_sr, {q6('coalesce(sum(epa*w),0)/sum(w)')} AS off_epa_pp, {q6('coalesce(sum(sdr*w),0)/sum(w)')} AS off_successful_drive_rate, {q6('avg(epa) FILTER (rn<=2)')} AS off_epa_pp_last_2 FROM w GROUP BY 1, 2""")
def _(d):
    e = enriched(d)
    tg = R.team_game(e, R.drives(e, ["quarter", "play_number"])).where("n_off_plays IS NOT NULL")
    m = ["off_sr", "off_epa_pp", "off_successful_drive_rate"]
    out = R.recency_season(tg, ["season", "team"], ["week", "game_id"], m)
    return out.select("season", "team", "games_played", *[r6(c).alias(c) for c in [*m, "off_epa_pp_last_2"]])


@query("fe2_temporal_matchups", uses="sides games", sql=f"""
    WITH s AS (SELECT season, team, game_id, side, CAST(points_for AS DOUBLE) AS x, row_number() OVER (PARTITION BY season, team ORDER BY kickoff, game_id, side) AS n FROM sides),
    e AS (SELECT a.game_id, a.side, a.season, a.team, sum(b.x*pow(0.7, a.n-b.n))/sum(CASE WHEN b.x IS NOT NULL THEN pow(0.7, a.n-b.n) END) AS ew FROM s a LEFT JOIN s b ON a.season=b.season AND a.team=b.team AND b.n<a.n GROUP BY 1, 2, 3, 4),
    p AS (SELECT season+1 AS season, team, avg(x) AS pr FROM s GROUP BY 1, 2)
    SELECT g.game_id, {q6('h.ew')} AS home_ewma, {q6('a.ew')} AS away_ewma, {q6('hp.pr')} AS home_prior, {q6('ap.pr')} AS away_prior, {q6('h.ew-a.ew')} AS simple_diff FROM games g JOIN e h ON h.game_id=g.game_id AND h.side='home' JOIN e a ON a.game_id=g.game_id AND a.side='away'
      LEFT JOIN p hp ON hp.season=g.season AND hp.team=g.home LEFT JOIN p ap ON ap.season=g.season AND ap.team=g.away""")
def _(d):
    s = d.sides.withColumn("x", F.col("points_for").cast("double"))
    ew = W.ewma_prior(s, ["season", "team"], ["kickoff", "game_id", "side"], "to_date(kickoff)", "x", 0.3, "ewma")
    prior = s.groupBy((F.col("season") + 1).alias("season"), "team").agg(F.avg("x").alias("prior"))
    f = X.matchup_frame(d.games, ew.join(prior, ["season", "team"], "left"), ["ewma", "prior"])
    return f.select("game_id", *[r6(c).alias(c) for c in ("home_ewma", "away_ewma", "home_prior", "away_prior")], r6(F.col("home_ewma") - F.col("away_ewma")).alias("simple_diff"))


@query("fe3_team_side_round_trip", uses="games", sql="SELECT game_id, season, home AS home_team, away AS away_team, CAST(home_points AS DOUBLE) AS home_points, CAST(away_points AS DOUBLE) AS away_points FROM games")
def _(d):
    long = J.sides(d.games, ["game_id", "season"], {"team": ("home", "away"), "points": ("home_points", "away_points")})
    out = J.sides_to_wide(long, ["game_id", "season"], ["team", "points"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("home_points", "away_points")})


@query("fe4_baseline_attach", uses="games graded", sql=f"SELECT g.game_id, {q6('b.prediction')} AS baseline FROM games g LEFT JOIN graded b ON b.game_id=g.game_id AND b.target='margin' AND b.season>=1997 WHERE completed")
def _(d):
    base = d.graded.where("target = 'margin' AND season >= 1997").select("game_id", "prediction")
    return X.attach_baseline(d.games.where("completed"), base, [1997, 1998, 1999, 2000, 2001]).select("game_id", r6("baseline").alias("baseline"))


def _venues(d):
    k = F.col("n_nationkey")
    zones = F.array(*[F.lit(z) for z in ZONES])
    return d.nation.select(k.cast("long").alias("venue_id"), F.when(k % 6 != 5, (k * 7 % 60).cast("double")).alias("lat"), (k * 13 % 150).cast("double").alias("lon"),
                           F.element_at(zones, (k % 5 + 1).cast("int")).alias("zone"), (k * 100).cast("double").alias("elevation"), (k % 4 == 0).alias("dome"))


@query("fe5_situational", uses="sides games", sql=f"""
    WITH RECURSIVE v AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey%6<>5 THEN radians(n_nationkey*7%60) END AS la, radians(n_nationkey*13%150) AS lo, n_nationkey*100.0 AS el, n_nationkey%4=0 AS dome, {ZONES!r}[1+n_nationkey%5] AS z FROM nation),
    k AS (SELECT DISTINCT season, team, kickoff FROM sides), r AS (SELECT *, lag(kickoff) OVER (PARTITION BY season, team ORDER BY kickoff) AS lk FROM k),
    s AS (SELECT s.*, g.home%25 AS vid, s.team%25 AS hid FROM sides s JOIN games g USING (game_id)),
    vp AS (SELECT h.la AS a1, h.lo AS o1, v.la AS a2, v.lo AS o2 FROM v CROSS JOIN v h), {geodesic_sql('vp')},
    c AS (SELECT s.game_id, s.team, date_diff('day', CAST(lk AS DATE), CAST(s.kickoff AS DATE)) AS rest, CASE WHEN vid=hid THEN 0.0 ELSE gd.km END AS km,
        (epoch(timezone(v.z, timezone('UTC', s.kickoff)))-epoch(timezone(h.z, timezone('UTC', s.kickoff))))/3600.0 AS tz, v.el-h.el AS alt, v.dome FROM s JOIN r USING (season, team, kickoff) JOIN v ON v.id=vid JOIN v h ON h.id=hid
      LEFT JOIN gd ON gd.a1=h.la AND gd.o1=h.lo AND gd.a2=v.la AND gd.o2=v.lo)
    SELECT game_id, team, CAST(rest AS DOUBLE) AS rest_days, km IS NULL AS travel_missing, {q6('coalesce(km, 0)', 2)} AS travel_km, CAST(tz AS DOUBLE) AS tz_diff, CAST(alt AS DOUBLE) AS altitude_diff, dome, {q6('coalesce(km, 0)/(coalesce(rest, 7)+1)', 2)} AS fatigue FROM c""")
def _(d):
    g = d.games.select("game_id", (F.col("home") % 25).alias("venue_id"), "neutral")
    s = d.sides.join(g, "game_id").withColumn("home_venue_id", F.col("team") % 25)
    out = X.situational(s, _venues(d))
    return out.select("game_id", "team", F.col("rest_days").cast("double"), "travel_missing", r6("travel_km", 2).alias("travel_km"), "tz_diff", "altitude_diff", "dome", r6("fatigue", 2).alias("fatigue"))


@query("fe6_weather", uses="sides games", sql=f"""
    SELECT s.game_id, s.team, {q6('coalesce(w.t, 70)')} AS temperature, w.t IS NULL AS temperature_missing, {q6('coalesce(w.wd, 0)')} AS wind, w.wd IS NULL AS wind_missing
    FROM sides s LEFT JOIN (SELECT game_id, price%100 AS t, CASE WHEN price%3<>0 THEN price%30 END AS wd FROM games WHERE NOT neutral) w USING (game_id)""")
def _(d):
    w = d.games.where("NOT neutral").select("game_id", (F.col("price") % 100).cast("double").alias("temperature"),
                                            F.when(F.col("price") % 3 != 0, F.col("price") % 30).cast("double").alias("wind"))
    out = X.weather(d.sides.select("game_id", "team"), w, {"temperature": 70.0, "wind": 0.0})
    return out.select("game_id", "team", r6("temperature").alias("temperature"), "temperature_missing", r6("wind").alias("wind"), "wind_missing")


@query("fe7_preseason_table", uses="exposures sides", sql=f"""
    WITH u AS (SELECT DISTINCT season, team FROM sides), q AS (SELECT season+1 AS season, team, avg(points_for) AS quality FROM sides GROUP BY 1, 2), r AS (SELECT season, offense AS team, sum(den) AS recruiting FROM exposures GROUP BY 1, 2)
    SELECT u.season, u.team, {q6('quality')} AS quality, q.season IS NOT NULL AS quality_present, {q6('recruiting')} AS recruiting, r.season IS NOT NULL AS recruiting_present FROM u LEFT JOIN q USING (season, team) LEFT JOIN r USING (season, team)""")
def _(d):
    u = d.sides.select("season", "team").distinct()
    quality = d.sides.groupBy((F.col("season") + 1).alias("season"), "team").agg(r6(F.avg("points_for")).alias("quality"))
    rec = d.exposures.groupBy("season", F.col("offense").alias("team")).agg(r6(F.sum("den")).alias("recruiting"))
    return X.assemble(u, {"quality": quality, "recruiting": rec}, ["season", "team"])


@query("fe8_state_features", uses="sides games", sql=f"""
    WITH m AS (SELECT season+1 AS season, team, avg(points_for) AS o, avg(points_against) AS f FROM sides GROUP BY 1, 2)
    SELECT game_id, {q6('h.o')} AS home_offense, {q6('a.o')} AS away_offense, {q6('h.f')} AS home_defense, {q6('a.f')} AS away_defense, CASE WHEN neutral THEN 0 ELSE 1 END AS host, CAST(home_points-away_points AS DOUBLE) AS margin
    FROM games g LEFT JOIN m h ON h.season=g.season AND h.team=g.home LEFT JOIN m a ON a.season=g.season AND a.team=g.away""")
def _(d):
    st = d.sides.groupBy((F.col("season") + 1).alias("season"), "team").agg(F.avg("points_for").alias("offense"), F.avg("points_against").alias("defense"))
    rows = d.sides.select("game_id", "season", "team").join(st, ["season", "team"], "left")
    f = X.matchup_frame(d.games, rows, ["offense", "defense"])
    return f.select("game_id", *[r6(c).alias(c) for c in ("home_offense", "away_offense", "home_defense", "away_defense")],
                    F.when(F.col("neutral"), 0).otherwise(1).alias("host"), (F.col("home_points") - F.col("away_points")).cast("double").alias("margin"))


@query("fe9_non_offense_totals", uses="sides", sql="""
    WITH e AS (SELECT game_id, team, points_for%7 AS p, CASE WHEN points_for%5=0 THEN 'unresolved' WHEN points_for%2=0 THEN 'non_offense' ELSE 'offense' END AS c FROM sides WHERE points_for%3<>0),
    b AS (SELECT game_id, bool_or(c='unresolved') AS bad FROM e GROUP BY 1)
    SELECT s.game_id, s.team, s.completed AND NOT coalesce(bad, false) AS usable, CAST(CASE WHEN s.completed AND NOT coalesce(bad, false) THEN coalesce(CASE WHEN c='non_offense' THEN p ELSE 0 END, 0) END AS DOUBLE) AS non_offense_points
    FROM sides s LEFT JOIN e USING (game_id, team) LEFT JOIN b USING (game_id)""")
def _(d):
    x = F.col("points_for")
    ev = d.sides.where("points_for % 3 <> 0").select("game_id", "team", (x % 7).alias("points"), F.when(x % 5 == 0, "unresolved").when(x % 2 == 0, "non_offense").otherwise("offense").alias("category"))
    out = X.non_offense_totals(d.sides.select("game_id", "team", "completed"), ev, F.col("completed"))
    return out.select("game_id", "team", "usable", F.col("non_offense_points").cast("double"))


@query("fe10_context_families", uses="games", sql=f"""
    SELECT 'base' AS family, count(*) AS rows, 1.0 AS coverage FROM games UNION ALL SELECT 'weather', count(*), {q6('avg(CAST(NOT neutral AS INT))')} FROM games UNION ALL SELECT 'finals', count(*), {q6('avg(CAST(completed AS INT))')} FROM games""")
def _(d):
    w = d.games.where("NOT neutral").select("game_id", F.col("price").alias("wind"))
    f = d.games.where("completed").select("game_id", F.col("home_points").alias("hp"))
    return X.add_families(d.games.select("game_id"), {"weather": (w, ["wind"]), "finals": (f, ["hp"])}, "game_id").withColumn("coverage", r6("coverage"))


def _hosted(d):
    return d.games.withColumn("venue_id", F.when(F.col("game_id") % 4 == 0, F.col("game_id") % 7).otherwise(F.col("home") % 25))


@query("fe11_site_context", uses="games", sql="""
    WITH g AS (SELECT *, CASE WHEN game_id%4=0 THEN game_id%7 ELSE home%25 END AS venue_id FROM games), n AS (SELECT season, home, venue_id, count(*) AS c FROM g GROUP BY 1, 2, 3),
    h AS (SELECT season, home, venue_id FROM (SELECT *, row_number() OVER (PARTITION BY season, home ORDER BY c DESC, venue_id) AS rn FROM n) WHERE c>=3 OR rn=1)
    SELECT season, CASE WHEN neutral THEN 'neutral' WHEN h.home IS NOT NULL THEN 'home_venue' ELSE 'other_not_neutral' END AS venue_class, count(*) AS games FROM g LEFT JOIN h USING (season, home, venue_id) GROUP BY 1, 2""")
def _(d):
    g = _hosted(d)
    homes = X.home_venues(g.select("season", F.col("home").alias("team"), "venue_id"))
    return X.venue_class(g, homes).groupBy("season", "venue_class").agg(F.count("*").alias("games"))


@query("it13_learned_prior", uses="exposures", sql=f"""
    WITH t AS (SELECT season, offense AS team, avg(num/den)/1000 AS z, sum(den)/1000 AS e FROM exposures GROUP BY 1, 2), f AS (SELECT c.season, c.team, c.z AS y, p.z AS x1, p.e AS x2 FROM t c JOIN t p ON p.team=c.team AND p.season=c.season-1),
    mo AS (SELECT v.season, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM (SELECT DISTINCT season FROM f) v JOIN f t ON t.season<v.season GROUP BY 1),
    nm AS (SELECT *, n+10 AS a11, n*c12/(s1*s2) AS a12, n*c1/s1 AS b1, n*c2/s2 AS b2 FROM mo)
    SELECT f.season, f.team, {q6('my+(b1*a11-b2*a12)/(a11*a11-a12*a12)/s1*(x1-m1)+(b2*a11-b1*a12)/(a11*a11-a12*a12)/s2*(x2-m2)')} AS prior FROM f JOIN nm USING (season)""")
def _(d):
    t = d.exposures.groupBy("season", F.col("offense").alias("team")).agg((F.avg(F.col("num") / F.col("den")) / 1000).alias("z"), (F.sum("den") / 1000).alias("e"))
    prev = t.select((F.col("season") + 1).alias("season"), "team", F.col("z").alias("x1"), F.col("e").alias("x2"))
    f = t.join(prev, ["season", "team"]).select(F.lit("z").alias("target"), "season", "team", "x1", "x2", F.col("z").alias("y"))
    return M.rolling_origin(f, ["x1", "x2"], [10.0]).select("season", "team", r6("fitted").alias("prior"))
