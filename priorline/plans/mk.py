"""Market quotes against the slate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds
from ..operators import market as K
from .registry import q6, query, r6

PROFIT = "CASE WHEN {0}>0 THEN {0}/100.0 ELSE 100.0/abs({0}) END"
MARKET = """WITH ql AS (SELECT game_id, quote_id, provider, captured_at, side_price AS price, 'spread' AS target, CAST(spread AS DOUBLE) AS point FROM quotes WHERE spread IS NOT NULL
      UNION ALL SELECT game_id, quote_id, provider, captured_at, side_price, 'total', CAST(total AS DOUBLE) FROM quotes WHERE total IS NOT NULL),
    pr AS (SELECT game_id, week, kickoff, 'spread' AS target, pred_margin AS prediction, CAST(home_points-away_points AS DOUBLE) AS actual FROM slate
      UNION ALL SELECT game_id, week, kickoff, 'total', pred_total, CAST(home_points+away_points AS DOUBLE) FROM slate)"""


def chain(src: str, where: str, tag: str) -> str:
    """SQL twin of best_quote over quotes ``src`` (joined to predictions) filtered by ``where``."""
    return f"""lp{tag} AS (SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY q.game_id, q.target, q.provider ORDER BY q.captured_at DESC, q.quote_id DESC) AS rn
        FROM {src} q JOIN pr p ON p.game_id=q.game_id AND p.target=q.target WHERE {where}) WHERE rn=1),
    rl{tag} AS (SELECT game_id, target, coalesce(max(point) FILTER (provider='consensus'), median(point)) AS line, CASE WHEN bool_or(provider='consensus') THEN 'consensus' ELSE 'provider_median' END AS rule,
        CASE WHEN bool_or(provider='consensus') THEN 1 ELSE count(*) END AS provider_count FROM lp{tag} GROUP BY 1, 2),
    ps{tag} AS (SELECT pr.*, line, rule, provider_count, CASE WHEN target='spread' THEN CASE WHEN prediction+line>0 THEN 'home' ELSE 'away' END
        ELSE CASE WHEN prediction>line THEN 'over' ELSE 'under' END END AS side FROM pr JOIN rl{tag} USING (game_id, target)),
    bq{tag} AS (SELECT * FROM (SELECT s.*, l.quote_id, l.provider, l.point, coalesce(l.price, -110) AS price,
        row_number() OVER (PARTITION BY s.game_id, s.target ORDER BY CASE WHEN side IN ('home','under') THEN -l.point ELSE l.point END,
          {PROFIT.format('coalesce(l.price,-110)')} DESC, l.quote_id) AS rk FROM ps{tag} s JOIN lp{tag} l ON l.game_id=s.game_id AND l.target=s.target) WHERE rk=1)"""


SIGNED = """CASE WHEN target='spread' THEN CASE WHEN side='home' THEN actual+point ELSE -actual-point END ELSE CASE WHEN side='over' THEN actual-point ELSE point-actual END END"""


@query("mk1_reference_line", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', "q.captured_at < TIMESTAMP '2024-01-20'", '')}
    SELECT game_id, target, {q6('line')} AS line, rule, CAST(provider_count AS BIGINT) AS provider_count FROM rl""")
def _(d):
    q = K.long_quotes(d.quotes).where("captured_at < TIMESTAMP_NTZ '2024-01-20 00:00:00'").join(d.slate.select("game_id"), "game_id", "left_semi")
    return K.reference_line(K.latest_per_provider(q)).select("game_id", "target", r6("line").alias("line"), "rule", "provider_count")


@query("mk1_snapshot_quote_ids", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', 'true', '')}
    SELECT l.game_id, l.target, string_agg(CAST(quote_id AS VARCHAR), ',' ORDER BY CAST(quote_id AS VARCHAR)) AS ids
    FROM lp l JOIN rl r ON r.game_id=l.game_id AND r.target=l.target WHERE r.rule='provider_median' OR l.provider='consensus' GROUP BY 1, 2""")
def _(d):
    q = K.long_quotes(d.quotes).join(d.slate.select("game_id"), "game_id", "left_semi")
    return K.reference_line(K.latest_per_provider(q)).select("game_id", "target", F.array_join("quote_ids", ",").alias("ids"))


@query("mk2_direction", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', 'q.captured_at < p.kickoff', '')} SELECT game_id, target, side FROM ps""")
def _(d):
    p = K.long_predictions(d.slate)
    ref = K.reference_line(K.latest_per_provider(K.admissible(K.long_quotes(d.quotes), p)))
    return p.join(ref, K.LINK).select("game_id", "target", K.direction(F.col("prediction"), F.col("line")).alias("side"))


@query("mk3_best_quote", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', 'q.captured_at < p.kickoff', '')}
    SELECT game_id, target, side, quote_id, point, price, {q6("abs(CASE WHEN target='spread' THEN prediction+point ELSE prediction-point END)")} AS edge FROM bq""")
def _(d):
    p = K.long_predictions(d.slate)
    out = K.best_quote(p, K.admissible(K.long_quotes(d.quotes), p))
    return out.select("game_id", "target", "side", "quote_id", "point", "price", r6("edge").alias("edge"))


@query("mk4_settlement", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', 'q.captured_at < p.kickoff', '')}
    SELECT game_id, target, {q6(f"CASE WHEN {SIGNED}>0 THEN {PROFIT.format('price')} WHEN {SIGNED}<0 THEN -1 ELSE 0 END")} AS units FROM bq WHERE actual IS NOT NULL""")
def _(d):
    p = K.long_predictions(d.slate).where("actual IS NOT NULL")
    out = K.best_quote(p, K.admissible(K.long_quotes(d.quotes), p))
    return out.select("game_id", "target", r6(odds.settle(K.signed_margin(), odds.profit_per_unit(F.col("price")))).alias("units"))


@query("mk5_grade_predictions", uses="quotes slate", sql=f"""{MARKET}, fb AS (SELECT * FROM ql WHERE provider='view'), {chain('ql', 'q.captured_at < p.kickoff', '1')},
    {chain('fb', "NOT EXISTS (SELECT 1 FROM bq1 b WHERE b.game_id=q.game_id AND b.target=q.target)", '2')},
    ch AS (SELECT game_id, target, side, quote_id, point, price, 'retained_prekickoff' AS benchmark FROM bq1 UNION ALL SELECT game_id, target, side, quote_id, point, price, 'retrospective' FROM bq2),
    g AS (SELECT pr.game_id, pr.target, coalesce(benchmark, 'ungraded') AS benchmark, side, CAST(quote_id AS DOUBLE) AS quote_id,
      CASE WHEN actual IS NULL OR side IS NULL THEN NULL WHEN {SIGNED}>0 THEN {PROFIT.format('price')} WHEN {SIGNED}<0 THEN -1.0 ELSE 0.0 END AS u FROM pr LEFT JOIN ch USING (game_id, target))
    SELECT game_id, target, benchmark, side, quote_id, {q6('u')} AS units, CASE WHEN u>0 THEN 'win' WHEN u<0 THEN 'loss' WHEN u=0 THEN 'push' END AS result FROM g""")
def _(d):
    q = K.long_quotes(d.quotes)
    out = K.grade(K.long_predictions(d.slate), q, q.where("provider = 'view'"))
    return out.select("game_id", "target", "benchmark", "side", F.col("quote_id").cast("double"), r6("units").alias("units"), "result")


@query("mk6_quote_coverage", uses="quotes slate", sql=f"""{MARKET},
    c AS (SELECT p.game_id, p.target, count(q.quote_id) AS candidates, count(q.quote_id) FILTER (q.captured_at<p.kickoff) AS eligible FROM pr p LEFT JOIN ql q USING (game_id, target) GROUP BY 1, 2)
    SELECT *, CASE WHEN candidates=0 THEN 'no_quote' WHEN eligible=0 THEN 'post_kickoff' ELSE 'ok' END AS reason FROM c""")
def _(d):
    return K.coverage_audit(K.long_predictions(d.slate), K.long_quotes(d.quotes))


@query("mk7_late_exceptions", uses="quotes slate", sql=f"""{MARKET}
    SELECT q.game_id, q.target, count(*) AS admitted FROM ql q JOIN slate s USING (game_id) WHERE q.captured_at < s.kickoff OR (q.provider='click' AND q.price > 150 AND q.target='total') GROUP BY 1, 2""")
def _(d):
    q = K.long_quotes(d.quotes)
    declared = q.where("provider = 'click' AND price > 150 AND target = 'total'")
    out = K.admissible(q, K.long_predictions(d.slate), declared=declared)
    return out.groupBy("game_id", "target").agg(F.count("*").alias("admitted"))


@query("mk8_kickoff_moves", uses="quotes slate", sql="""
    WITH k AS (SELECT game_id, kickoff AS o, kickoff + INTERVAL 1 DAY * (game_id%3) AS n FROM slate)
    SELECT game_id, count(*) AS moved_quotes FROM quotes JOIN k USING (game_id) WHERE o<>n AND (captured_at<o) <> (captured_at<n) GROUP BY 1""")
def _(d):
    new = d.slate.withColumn("kickoff", F.expr("kickoff + INTERVAL '1' DAY * CAST(game_id % 3 AS INT)"))
    return K.kickoff_moves(d.slate, new, d.quotes)


@query("mk9_selection_problems", uses="quotes slate", sql=f"""{MARKET}, {chain('ql', 'q.captured_at < p.kickoff', '')},
    sel AS (SELECT game_id, target, side, CASE WHEN game_id%5=0 THEN -1 ELSE quote_id END AS quote_id, CASE WHEN game_id%3=0 THEN point+0.5 ELSE point END AS point FROM bq)
    SELECT game_id, target, side, quote_id, CASE WHEN quote_id=-1 THEN 'not_linked' ELSE 'not_best' END AS why FROM sel WHERE quote_id=-1 OR game_id%3=0""")
def _(d):
    p = K.long_predictions(d.slate)
    q = K.admissible(K.long_quotes(d.quotes), p)
    chosen = K.best_quote(p, q).select(
        "game_id", "target", "side", F.when(F.col("game_id") % 5 == 0, F.lit(-1)).otherwise(F.col("quote_id")).alias("quote_id"),
        F.when(F.col("game_id") % 3 == 0, F.col("point") + 0.5).otherwise(F.col("point")).alias("point"))
    return K.selection_problems(chosen, K.latest_per_provider(q))


@query("mk10_price_presence", uses="quotes", sql=f"SELECT provider, count(*) AS quotes, {q6('avg(CAST(side_price IS NOT NULL AS INT))')} AS priced FROM quotes GROUP BY 1")
def _(d):
    return K.price_presence(d.quotes.withColumnRenamed("side_price", "price"), ["provider"]).withColumn("priced", r6("priced"))


@query("ag32_reference_quotes", uses="quotes slate", sql=f"""{MARKET.replace('FROM slate', 'FROM (SELECT DISTINCT q.game_id, 0 AS week, NULL::TIMESTAMP AS kickoff, 0.0 AS pred_margin, 0.0 AS pred_total, 0 AS home_points, 0 AS away_points FROM quotes q)')}, {chain('ql', 'true', '')}
    SELECT game_id, target, {q6('line')} AS line, rule FROM rl""")
def _(d):
    lines, _excluded = K.reference_quotes(d.quotes)
    return lines.select("game_id", "target", r6("line").alias("line"), "rule")


@query("ag32_excluded_quotes", uses="quotes", sql="SELECT quote_id, 'no_value' AS reason FROM quotes WHERE spread IS NULL AND total IS NULL")
def _(d):
    return K.reference_quotes(d.quotes)[1]
