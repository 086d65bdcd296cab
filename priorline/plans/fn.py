"""Scalar column functions over the derived play log, games and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, identity, odds, plays as P, playtypes as T, regimes, stats
from .registry import q6, query, r6


def inlist(labels: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


# Normal CDF in plain SQL: the power series of (2n+1)!! through log-gamma, good for |z| < 7.
def sql_cdf(z: str) -> str:
    # ratio form of the series: each term is the last one times z^2/(2n+1)
    return (f"(CASE WHEN abs({z}) > 7 THEN CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END ELSE "
            f"0.5 + exp(-0.5*({z})*({z}))/sqrt(2*pi())*sign({z})*"
            f"list_sum(list_transform(range(0, 90), lambda n: CASE WHEN abs({z}) = 0 THEN 0.0 ELSE "
            f"exp((2*n+1)*ln(abs({z})) - (n+1)*ln(2) - lgamma(n+1.5) + 0.5*ln(pi())) END)) END)")


FUMBLE_YARDS = ("CASE WHEN contains(lower(play_type), 'fumble recovery (opponent)') OR "
                "contains(lower(play_type), 'fumble recovery (touchdown)') THEN 0.0 ELSE yards_gained END")

SUCCESS_SQL = f"""CASE WHEN play_type IN {inlist(T.SCRIMMAGE_RESULT)} THEN
    CASE WHEN yards_to_first = 0 AND ((down=1 AND yards>=0.5*yards_to_goal) OR (down=2 AND yards>=0.7*yards_to_goal)
              OR (down IN (3,4) AND yards>=yards_to_goal)) THEN 1.0
         WHEN yards_to_first > 0 AND ((down=1 AND yards>=0.5*least(yards_to_first,yards_to_goal))
              OR (down=2 AND yards>=0.7*least(yards_to_first,yards_to_goal))
              OR (down IN (3,4) AND yards>=least(yards_to_first,yards_to_goal))) THEN 1.0 ELSE 0.0 END
    WHEN play_type IN {inlist(T.TURNOVER)} THEN 0.0 END"""

EXPLOSIVE_SQL = f"""CASE WHEN play_type IN {inlist(T.NEVER_EXPLOSIVE)} THEN 0.0
    WHEN play_type IN {inlist(T.SCRIMMAGE_RESULT)} THEN
      CASE WHEN (play_type IN {inlist(T.RUSH_RESULT)} AND yards >= 15)
             OR (play_type IN {inlist(T.PASS_ATTEMPT)} AND yards >= 20) THEN 1.0 ELSE 0.0 END END"""

RUSH = f"play_type IN {inlist(T.RUSH_ATTEMPT)}"
GARBAGE_SQL = ("CAST((quarter=3 AND abs(offense_score-defense_score)>=35) OR "
               "(quarter=4 AND abs(offense_score-defense_score)>=27) AS INT)")
ELIGIBLE_SQL = (f"(quarter BETWEEN 1 AND 4 AND {GARBAGE_SQL} = 0 AND play_type NOT IN "
                f"{inlist(T.SPECIAL_TEAMS + T.TWO_POINT + T.DEAD + ['Penalty'])})")
YARDS_CTE = f"WITH y AS (SELECT *, {FUMBLE_YARDS} AS yards FROM plays)"
RATED_CTE = f"{YARDS_CTE}, rated AS (SELECT *, {SUCCESS_SQL} AS success, {EXPLOSIVE_SQL} AS explosive FROM y)"


def _yards(d):
    return d.plays.withColumn("yards", P.standard_yards())


@query("fn1_missing_flags", uses="plays", sql=f"""
    SELECT play_id, ppa IS NULL AS ppa_missing,
           CASE WHEN ppa IS NULL THEN 'provider_missing_ppa' ELSE '' END AS ppa_missing_reason,
           {q6('ppa')} AS kept, {q6('coalesce(ppa, 0)')} AS filled FROM plays""")
def _(d):
    kept = P.with_missing_flags(d.plays, "ppa", "provider_missing_ppa")
    return kept.select("play_id", "ppa_missing", "ppa_missing_reason", r6("ppa").alias("kept"),
                       r6(F.coalesce("ppa", F.lit(0.0))).alias("filled"))


@query("fn2_type_flags", uses="plays", sql="SELECT play_id, " + ", ".join(
    f"CAST(play_type IN {inlist(v)} AS INT) AS {k}" for k, v in T.FLAGS.items()) + " FROM plays")
def _(d):
    return d.plays.select("play_id", *[c.alias(n) for n, c in P.type_flags().items()])


@query("fn3_penalty_split", uses="plays", sql="""
    SELECT play_id, CAST(play_type='Penalty' AS INT) AS penalty,
           CAST(play_type='Penalty' AND yards_gained<0 AS INT) AS offensive_penalty,
           CAST(play_type='Penalty' AND yards_gained>0 AS INT) AS defensive_penalty FROM plays""")
def _(d):
    return d.plays.select("play_id", *[c.alias(n) for n, c in P.penalty_flags().items()])


@query("fn4_context", uses="plays", sql="""
    SELECT play_id, CASE WHEN quarter<=2 THEN 1 WHEN quarter<=4 THEN 2 ELSE 3 END AS half,
           CASE WHEN offense=home THEN 'home' ELSE 'away' END AS home_away,
           offense_score-defense_score AS relative_score FROM plays""")
def _(d):
    return d.plays.select("play_id", *[c.alias(n) for n, c in P.context_columns().items()])


@query("fn5_standard_yards", uses="plays", sql=f"SELECT play_id, {FUMBLE_YARDS} AS yards FROM plays")
def _(d):
    return _yards(d).select("play_id", "yards")


@query("fn6_success", uses="plays", sql=f"{RATED_CTE} SELECT play_id, success FROM rated")
def _(d):
    return _yards(d).select("play_id", P.success().alias("success"))


@query("fn7_explosive", uses="plays", sql=f"{RATED_CTE} SELECT play_id, explosive FROM rated")
def _(d):
    return _yards(d).select("play_id", P.explosive().alias("explosive"))


@query("fn8_line_yards", uses="plays", sql=f"""{YARDS_CTE}
    SELECT play_id, {q6('''CASE WHEN yards<0 THEN yards*1.2 WHEN yards<=4 THEN yards
        WHEN yards<=10 THEN 2+yards/2 ELSE 7 END''')} AS line_yards FROM y WHERE {RUSH}""")
def _(d):
    return _yards(d).select("play_id", r6(P.line_yards()).alias("line_yards")).where("line_yards IS NOT NULL")


@query("fn9_second_open_yards", uses="plays", sql=f"""{YARDS_CTE}
    SELECT play_id, CASE WHEN {RUSH} THEN CASE WHEN yards<=5 THEN 0.0 WHEN yards>=10 THEN 5.0 ELSE yards-5 END END AS second_level,
           CASE WHEN {RUSH} THEN CASE WHEN yards<=10 THEN 0.0 ELSE yards-10 END END AS open_field FROM y""")
def _(d):
    return _yards(d).select("play_id", P.second_level_yards().alias("second_level"),
                            P.open_field_yards().alias("open_field"))


@query("fn10_power", uses="plays", sql=f"""{RATED_CTE}
    SELECT play_id, (down>=3 AND yards_to_first<=2 AND {RUSH}) AS is_power,
           (down>=3 AND yards_to_first<=2 AND {RUSH} AND success=1) AS converted FROM rated""")
def _(d):
    power = P.power_situation()
    return _yards(d).select("play_id", power.alias("is_power"),
                            (power & (F.coalesce(P.success(), F.lit(0.0)) == 1)).alias("converted"))


@query("fn11_kick_distance", uses="plays", sql=f"""
    SELECT play_id, yard_line+17 AS kick_distance, CAST(play_type='Field Goal Good' AS INT) AS is_fg_made
    FROM plays WHERE play_type IN {inlist(T.FIELD_GOAL)}""")
def _(d):
    return d.plays.select("play_id", P.kick_distance().alias("kick_distance"),
                          P.flag(F.col("play_type") == "Field Goal Good").alias("is_fg_made")).where(
        "kick_distance IS NOT NULL")


@query("fn12_defense_flags", uses="plays", sql=f"""{YARDS_CTE}
    SELECT play_id, CAST({RUSH} AND yards<=0 AS INT) AS stuff,
           CAST(play_type<>'Penalty' AND (play_type IN {inlist(T.HAVOC)} OR yards<0) AS INT) AS havoc,
           CAST(play_type<>'Penalty' AND yards<0 AS INT) AS tfl, CAST(play_type='Sack' AS INT) AS sack,
           CAST(play_type IN {inlist(T.COMPLETION)} AS INT) AS completion,
           CAST(play_type ILIKE '%touchdown%' AS INT) AS td_play, CAST(yards>=40 AS INT) AS big_play_40 FROM y""")
def _(d):
    return _yards(d).select("play_id", *[c.alias(n) for n, c in P.defense_flags().items()])


@query("fn13_conversions", uses="plays", sql=f"""{RATED_CTE}
    SELECT play_id, CASE WHEN down=3 THEN CASE WHEN success=1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS third,
           CASE WHEN down=4 THEN CASE WHEN success=1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS fourth FROM rated WHERE down >= 3""")
def _(d):
    return (_yards(d).where("down >= 3").withColumn("success", P.success())
            .select("play_id", P.conversion(3).cast("double").alias("third"),
                    P.conversion(4).cast("double").alias("fourth")))


@query("fn14_garbage_time", uses="plays", sql=f"SELECT play_id, {GARBAGE_SQL} AS garbage FROM plays")
def _(d):
    return d.plays.select("play_id", P.garbage_time().alias("garbage"))


@query("fn15_situations", uses="plays", sql="""
    SELECT play_id, CAST(quarter=4 AND abs(offense_score-defense_score)<=7 AS INT) AS close_game,
           CAST(quarter=4 AS INT) AS fourth_quarter,
           CAST((down=2 AND yards_to_first>=8) OR (down>=3 AND yards_to_first>=5) AS INT) AS passing_down,
           CAST(yards_to_goal<=20 AS INT) AS red_zone, CAST(yards_to_goal<40 AND down=1 AS INT) AS eckel FROM plays""")
def _(d):
    return d.plays.select("play_id", *[c.alias(n) for n, c in P.situation_flags().items()])


@query("fn16_field_bin", uses="plays", sql="""
    SELECT play_id, CASE WHEN yard_line<=0 THEN NULL WHEN yard_line<=20 THEN 'Own Red Zone' WHEN yard_line<=50 THEN 'Own'
           WHEN yard_line<=80 THEN 'Opponent' WHEN yard_line<=100 THEN 'Red Zone' END AS field_bin FROM plays""")
def _(d):
    return d.plays.select("play_id", P.right_closed_bin("yard_line", *P.FIELD_POSITION).alias("field_bin"))


@query("fn17_drop_dead_retag", uses="plays", sql=f"""{YARDS_CTE}
    SELECT play_id, CAST(play_type IN {inlist(T.RUSH_ATTEMPT + T.OWN_OR_LOST_FUMBLE)} AS INT) AS rush_attempt,
           CAST(play_type IN {inlist(T.RUSH_RESULT + T.OWN_OR_LOST_FUMBLE)} AS INT) AS rush_result, yards
    FROM y WHERE play_type NOT IN {inlist(T.DEAD)}""")
def _(d):
    flagged = _yards(d).withColumns(P.type_flags())
    return P.drop_dead_and_retag(flagged).select("play_id", "rush_attempt", "rush_result", "yards")


@query("fn18_american_profit", uses="quotes", sql=f"""
    SELECT quote_id, {q6('CASE WHEN side_price IS NULL THEN 1/1.1 WHEN side_price>0 THEN side_price/100.0 ELSE 100.0/abs(side_price) END')} AS profit
    FROM quotes""")
def _(d):
    return d.quotes.select("quote_id", r6(odds.profit_per_unit(F.col("side_price"))).alias("profit"))


@query("fn19_normal_cdf", uses="graded", sql=f"""
    WITH z AS (SELECT game_id, target, (actual-prediction)/sigma AS z FROM graded)
    SELECT game_id, target, {q6(sql_cdf('z'))} AS p FROM z""")
def _(d):
    z = (F.col("actual") - F.col("prediction")) / F.col("sigma")
    return d.graded.select("game_id", "target", r6(stats.normal_cdf(z)).alias("p"))


@query("fn20_gaussian_crps", uses="graded", sql=f"""
    WITH z AS (SELECT game_id, target, sigma, (actual-prediction)/sigma AS z FROM graded)
    SELECT game_id, target, {q6(f"sigma*(z*(2*{sql_cdf('z')}-1)+2*exp(-0.5*z*z)/sqrt(2*pi())-1/sqrt(pi()))")} AS crps FROM z""")
def _(d):
    return d.graded.select("game_id", "target", r6(stats.gaussian_crps(
        F.col("actual"), F.col("prediction"), F.col("sigma"))).alias("crps"))


@query("fn21_intervals", uses="graded", sql="SELECT game_id, target, " + ", ".join(
    f"{q6(f'prediction-{z}*sigma')} AS lo{p}, {q6(f'prediction+{z}*sigma')} AS hi{p}"
    for p, z in stats.Z_QUANTILES.items()) + " FROM graded")
def _(d):
    cols = []
    for level in stats.Z_QUANTILES:
        lo, hi = stats.interval(F.col("prediction"), F.col("sigma"), level)
        cols += [r6(lo).alias(f"lo{level}"), r6(hi).alias(f"hi{level}")]
    return d.graded.select("game_id", "target", *cols)


def _points(df, key):
    return df.withColumns({"lat": F.pmod(F.col(key) * 7, F.lit(120)) - 60.0, "lon": F.pmod(F.col(key) * 13, F.lit(300)) - 150.0})


def geodesic_sql(pairs: str) -> str:
    """Table ``gd`` (a1, o1, a2, o2, km) for the pairs of points, in radians, of a table; needs WITH RECURSIVE."""
    a, f = geo.EQUATOR_KM, geo.FLATTENING
    arc = """sqrt(pow(cos(u2)*sin(l), 2) + pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(l), 2)) AS ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(l) AS cs, atan2(ss, cs) AS sg,
        CASE WHEN ss=0 THEN 0.0 ELSE cos(u1)*cos(u2)*sin(l)/ss END AS sa, 1-sa*sa AS ca, CASE WHEN ca<1e-15 THEN 0.0 ELSE cs-2*sin(u1)*sin(u2)/ca END AS cm"""
    return f"""gi AS (SELECT DISTINCT a1, o1, a2, o2, atan((1-{f!r})*tan(a1)) AS u1, atan((1-{f!r})*tan(a2)) AS u2, o2-o1-2*pi()*floor((o2-o1+pi())/(2*pi())) AS d, d AS l, 0 AS it, 1.0::DOUBLE AS gap
        FROM {pairs} WHERE a1+o1+a2+o2 IS NOT NULL
      UNION ALL SELECT a1, o1, a2, o2, u1, u2, d, nl, it+1, abs(nl-l) FROM (SELECT *, {arc}, {f!r}/16*ca*(4+{f!r}*(4-3*ca)) AS cc, d+(1-cc)*{f!r}*sa*(sg+cc*ss*(cm+cc*cs*(2*cm*cm-1))) AS nl FROM gi WHERE it<{geo.ROUNDS} AND gap>{geo.SETTLED}) t),
    gl AS (SELECT * FROM gi QUALIFY row_number() OVER (PARTITION BY a1, o1, a2, o2 ORDER BY it DESC)=1),
    gd AS (SELECT a1, o1, a2, o2, CASE WHEN gap<={geo.SETTLED} THEN {a*(1-f)!r}*(1+uu/16384*(4096+uu*(uu*(320-175*uu)-768)))*(sg - bb*ss*(cm+bb/4*(cs*(2*cm*cm-1)-bb/6*cm*(4*ss*ss-3)*(4*cm*cm-3))))
        ELSE {geo.EARTH_RADIUS_KM}*acos(greatest(-1,least(1,sin(a1)*sin(a2)+cos(a1)*cos(a2)*cos(o2-o1)))) END AS km
      FROM (SELECT *, {arc}, ca*{1/(1-f)**2-1!r} AS uu, uu/1024*(256+uu*(uu*(74-47*uu)-128)) AS bb FROM gl) t)"""


@query("fn22_travel_km", uses="games", sql=f"""
    WITH RECURSIVE p AS (SELECT game_id, radians(home*7%120-60) AS a1, radians(home*13%300-150) AS o1,
                      radians(away*7%120-60) AS a2, radians(away*13%300-150) AS o2 FROM games), {geodesic_sql('p')}
    SELECT game_id, {q6('km', 2)} AS km FROM p JOIN gd USING (a1, o1, a2, o2)""")
def _(d):
    g = _points(d.games, "home").withColumnsRenamed({"lat": "lat1", "lon": "lon1"})
    g = _points(g, "away")
    return g.select("game_id", r6(geo.distance_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")), 2).alias("km"))


# Zones used for the derived venues.
ZONES = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix"]


@query("fn23_zone_offsets", uses="games", sql=f"""
    WITH z AS (SELECT game_id, kickoff, {ZONES!r}[1+home%5] AS hz, {ZONES!r}[1+away%5] AS az FROM games),
    o AS (SELECT game_id, (epoch(timezone(hz, timezone('UTC', kickoff)))-epoch(kickoff))/3600.0 AS home_offset,
                 (epoch(timezone(az, timezone('UTC', kickoff)))-epoch(kickoff))/3600.0 AS away_offset FROM z)
    SELECT game_id, CAST(home_offset AS DOUBLE) AS home_offset, CAST(away_offset AS DOUBLE) AS away_offset,
           CAST(home_offset-away_offset AS DOUBLE) AS tz_diff, home_offset > away_offset AS eastward FROM o""")
def _(d):
    zones = F.array(*[F.lit(z) for z in ZONES])
    at = lambda side: geo.offset_hours(F.col("kickoff"), F.element_at(zones, (F.col(side) % 5 + 1).cast("int")))
    return d.games.select("game_id", at("home").alias("home_offset"), at("away").alias("away_offset")).withColumns({
        "tz_diff": F.col("home_offset") - F.col("away_offset"),
        "eastward": F.col("home_offset") > F.col("away_offset")})


@query("fn24_routes", uses="graded", sql="""
    SELECT DISTINCT target, stage, CASE WHEN stage>=4 THEN 'established' ELSE 'game_'||(stage+1) END AS upcoming,
           (['preseason','one_game','two_games','three_games','established'])[stage+1] AS legacy,
           CASE WHEN stage>=4 THEN 'established' ELSE 'game_'||(stage+1) END AS canonical FROM graded""")
def _(d):
    stage = F.col("stage")
    return d.graded.select("target", "stage", regimes.upcoming_route(stage).alias("upcoming"),
                           regimes.completed_route(stage).alias("legacy"),
                           regimes.canonical_route(regimes.completed_route(stage)).alias("canonical")).distinct()


@query("fn25_week_stage_labels", uses="graded", sql="""
    SELECT game_id, target, CASE WHEN week<=4 THEN CAST(week AS VARCHAR) WHEN week<=8 THEN '5-8' WHEN week<=12 THEN '9-12' ELSE '13-16' END AS bucket,
           CASE WHEN stage>=4 THEN '4_plus' ELSE CAST(stage AS VARCHAR) END AS stage_key,
           CASE WHEN line<=-3 THEN 'low' WHEN line<=20 THEN 'mid' ELSE 'high' END AS band FROM graded""")
def _(d):
    return d.graded.select("game_id", "target", regimes.week_bucket(F.col("week")).alias("bucket"),
                           regimes.stage_key(F.col("stage")).alias("stage_key"),
                           regimes.label_by_edges(F.col("line"), [F.lit(-3), F.lit(20)], ["low", "mid", "high"]).alias("band"))


@query("fn26_content_identity", uses="games", sql="""
    SELECT game_id, sha256('{"away":'||away||',"game_id":'||game_id||',"home":'||home||',"home_points":'||
           coalesce(CAST(home_points AS VARCHAR),'null')||'}') AS content_id FROM games""")
def _(d):
    return d.games.select("game_id", identity.content_id(["game_id", "home", "away", "home_points"]).alias("content_id"))


@query("fn27_needed_distance", uses="plays", sql="""
    SELECT play_id, CASE WHEN yards_to_first>0 THEN yards_to_first ELSE yards_to_goal END AS needed FROM plays""")
def _(d):
    return d.plays.select("play_id", P.needed_distance("yards_to_first", "yards_to_goal").alias("needed"))


@query("fn28_regex_typing", uses="plays", sql="""
    SELECT play_type, (play_type ILIKE '%pass%' OR play_type ILIKE '%sack%' OR play_type ILIKE '%interception%') AS is_pass,
           (play_type ILIKE '%rush%' OR play_type ILIKE '%run%') AS is_rush, count(*) AS n FROM plays GROUP BY 1,2,3""")
def _(d):
    return d.plays.groupBy("play_type", P.is_pass_text("play_type").alias("is_pass"),
                           P.is_rush_text("play_type").alias("is_rush")).agg(F.count("*").alias("n"))


@query("fn_enriched_rollup", uses="plays", sql=f"""{RATED_CTE}
    SELECT offense, quarter, count(*) AS plays, CAST(sum(CAST({ELIGIBLE_SQL} AS INT)) AS BIGINT) AS eligible,
           {q6(f"avg(CASE WHEN {ELIGIBLE_SQL} THEN success END)")} AS success_rate,
           {q6(f"avg(CASE WHEN {ELIGIBLE_SQL} THEN ppa END)")} AS ppa
    FROM rated WHERE play_type NOT IN {inlist(T.DEAD)} GROUP BY 1, 2""")
def _(d):
    ok = P.eligible_play()
    return P.enrich_plays(d.plays).groupBy("offense", "quarter").agg(
        F.count("*").alias("plays"), F.sum(P.flag(ok)).alias("eligible"),
        r6(F.avg(F.when(ok, F.col("success")))).alias("success_rate"),
        r6(F.avg(F.when(ok, F.col("ppa")))).alias("ppa"))
