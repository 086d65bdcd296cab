"""Extension points exercised on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M, quality as Q, registries as X
from .registry import q6, query, r6


@query("ux1_metric_registry", uses="exposures", sql=f"""
    SELECT offense AS team, 'price_per_unit' AS metric, {q6('sum(num)/sum(den)', 4)} AS value FROM exposures GROUP BY 1 UNION ALL
    SELECT offense, 'returned_share', {q6("avg(CAST(flag='R' AS INT))")} FROM exposures GROUP BY 1 UNION ALL SELECT offense, 'large_open_price', {q6("sum(num) FILTER (line_status='O')/sum(den) FILTER (line_status='O')", 4)} FROM exposures GROUP BY 1""")
def _(d):
    specs = [M.Metric("price_per_unit", "num", "den"), M.mean_metric("returned_share", "CAST(flag = 'R' AS INT)"), M.Metric("large_open_price", "num", "den", "line_status = 'O'")]
    wide = d.exposures.groupBy(F.col("offense").alias("team")).agg(*M.sums(specs))
    long = M.to_long(wide, ["team"], specs)
    return long.select("team", "metric", F.when(F.col("metric") == "returned_share", r6("value")).otherwise(r6("value", 4)).alias("value"))


@query("ux2_measurement_recipes", uses="exposures", sql=f"""
    SELECT 'value_per_unit' AS recipe, season, offense AS team, {q6('sum(num)/sum(den)', 4)} AS value FROM exposures GROUP BY 2, 3 UNION ALL SELECT 'mean_value', season, offense, {q6('avg(num)', 4)} FROM exposures GROUP BY 2, 3""")
def _(d):
    rows = d.exposures.withColumnRenamed("offense", "team")
    part = lambda n: X.RECIPES[n](rows).select(F.lit(n).alias("recipe"), "season", "team", r6("value", 4).alias("value"))
    return part("value_per_unit").unionByName(part("mean_value"))


@query("ux3_rating_designs", uses="sides", sql=f"""
    WITH e AS (SELECT season, team, (points_for-24)/14.0 AS z, kickoff, game_id FROM sides WHERE points_for IS NOT NULL)
    SELECT 'analytic_k4' AS design, season, team, {q6('sum(2*z)/4/(1+count(*)*2/4.0)')} AS mean FROM e GROUP BY 2, 3 UNION ALL SELECT 'latest_game', season, team, {q6('arg_max(z, struct_pack(a := kickoff, b := game_id))')} FROM e GROUP BY 2, 3""")
def _(d):
    ev = d.sides.select("season", "team", "game_id", "kickoff", ((F.col("points_for") - 24) / 14.0).alias("z"), F.when(F.col("points_for").isNotNull(), 2.0).alias("exposure"))
    return X.run_designs(ev, ["analytic_k4", "latest_game"]).select("design", "season", "team", r6("mean").alias("mean"))


@query("ux5_custom_aggregates", uses="exposures", sql=f"""
    SELECT season, {q6("sum(CASE WHEN flag='A' THEN num ELSE 0 END)/greatest(count(*) FILTER (flag='A'), 1)", 3)} AS accepted_mean, {q6('avg(CAST(den>=40 AS INT))')} AS large_share, {q6('median(den)')} AS mid FROM exposures GROUP BY 1""")
def _(d):
    a = F.col("flag") == "A"
    return d.exposures.groupBy("season").agg(r6(F.sum(F.when(a, F.col("num")).otherwise(0.0)) / F.greatest(F.count(F.when(a, 1)), F.lit(1)), 3).alias("accepted_mean"),
                                             r6(F.avg((F.col("den") >= 40).cast("int"))).alias("large_share"), r6(F.median("den")).alias("mid"))


@query("ux6_row_fan_out", sql="""
    WITH w AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT lang, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM w GROUP BY 1""")
def _(d):
    lines = d.documents.select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query("ux4_check_registry", uses="graded", sql="""
    SELECT 'wide_sigma' AS "check", 'warn' AS severity, CASE WHEN count(*)=0 THEN 'pass' ELSE 'fail' END AS status, count(*) AS findings FROM graded WHERE sigma>=19
    UNION ALL SELECT 'known_target', 'required', CASE WHEN count(*)=0 THEN 'pass' ELSE 'fail' END, count(*) FROM graded WHERE target NOT IN ('margin', 'total')""")
def _(d):
    own = {"wide_sigma": ("forecast", "warn", lambda t: t["graded"].where("sigma >= 19"), ["graded"]),
           "known_target": ("forecast", "required", lambda t: t["graded"].where("target NOT IN ('margin', 'total')"), ["graded"])}
    return Q.run_stage("forecast", {"graded": d.graded}, own)
