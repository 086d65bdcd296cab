"""Streaming queries: the event table as a file stream, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import ops as S
from .registry import q6, query, r6


def _events(d):
    s = S.stream_table(d.spark, d.root, "events.parquet", d.events.schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("ss1_stream_dedup", sql="SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(d):
    e = _events(d).select("event_id", "event_type", "ts")
    twice = e.select("event_id", "event_type", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    out = S.run_to_table(S.deduplicated(twice, ["event_id"], "ts", "1 day"), "dedup")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("ss2_available_windows", sql=f"""
    WITH m AS (SELECT max(ts) - INTERVAL 6 HOUR AS wm FROM events) SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, {q6('avg(value)')} AS mean
    FROM events, m GROUP BY 1, 2, wm HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= wm""")
def _(d):
    out = S.run_to_table(S.closed_windows(_events(d), "ts", "6 hours", "6 hours", None, ["event_type"], [F.count("*").alias("n"), F.avg("value").alias("mean")]), "windows")
    return _ntz(out, "window_start").select("window_start", "event_type", "n", r6("mean").alias("mean"))


@query("ss2_late_rows", uses="quotes slate", sql="SELECT quote_id FROM quotes JOIN slate USING (game_id) WHERE captured_at > kickoff + INTERVAL 6 HOUR")
def _(d):
    j = d.quotes.join(d.slate.select("game_id", "kickoff"), "game_id")
    return S.late_rows(j, "kickoff", "captured_at", 6).select("quote_id")


@query("ss3_sliding_windows", sql=f"""
    WITH s AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * o AS window_start, value, ts FROM events CROSS JOIN (SELECT unnest([0, 1]) AS o)), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)
    SELECT window_start, count(*) AS n, {q6('sum(value)')} AS total FROM s, m GROUP BY 1, wm HAVING window_start + INTERVAL 2 DAY <= wm""")
def _(d):
    out = S.run_to_table(S.closed_windows(_events(d), "ts", "1 hour", "2 days", "1 day", [], [F.count("*").alias("n"), F.sum("value").alias("total")]), "sliding")
    return _ntz(out, "window_start").select("window_start", "n", r6("total").alias("total"))


@query("ss4_session_windows", sql=f"""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 4 HOUR AS session_end, count(*) AS n FROM i, m GROUP BY user_id, k, wm HAVING max(ts) + INTERVAL 4 HOUR <= wm""")
def _(d):
    out = S.run_to_table(S.sessions(_events(d), "user_id", "ts", "4 hours", "1 hour", [F.count("*").alias("n")]), "sessions")
    return _ntz(out, "session_start", "session_end")


KALMAN_SQL = """WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts)/1e6 AS tm, value/100 AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    k AS (SELECT user_id, event_id, i, tm, z/(1+0.8) AS m, 1-1/(1+0.8) AS v FROM s WHERE i=1 UNION ALL
      SELECT s.user_id, s.event_id, s.i, s.tm, k.m+(k.v+0.05*(s.tm-k.tm)/604800)/(k.v+0.05*(s.tm-k.tm)/604800+0.8)*(s.z-k.m), (1-(k.v+0.05*(s.tm-k.tm)/604800)/(k.v+0.05*(s.tm-k.tm)/604800+0.8))*(k.v+0.05*(s.tm-k.tm)/604800)
      FROM k JOIN s ON s.user_id=k.user_id AND s.i=k.i+1)"""


@query("ss5_stateful_rating", sql=f"{KALMAN_SQL} SELECT event_id, {q6('m')} AS mean, {q6('v')} AS variance FROM k")
def _(d):
    e = _events(d).select("user_id", F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e6).alias("at"), (F.col("value") / 100).alias("z"), F.lit(1.0).alias("n"))
    out = S.run_to_table(S.kalman_stream(e, "user_id", ["id", "at", "z", "n"], 0.05, 0.8), "kalman")
    return out.select(F.col("id").alias("event_id"), r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("ss6_regression_alerts", uses="plays", sql="""
    WITH s AS (SELECT event_id, CAST(floor(floor(value*10+0.0001)/3) AS INT)%60 AS sc, user_id, ts FROM events), l AS (SELECT *, lag(sc) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s)
    SELECT event_id, was-sc AS fell_by FROM l WHERE sc<was AND ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def _(d):
    score = (F.floor(F.floor(F.col("value") * 10 + 0.0001) / 3) % 60).cast("int")
    e = _events(d).select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("id"), "ts", score.alias("score"))
    return S.run_to_table(S.score_alerts(e, "stream", "ts", "1 hour"), "alerts").select(F.col("id").alias("event_id"), "fell_by")


@query("ss7_latest_quote", uses="slate", sql="""
    SELECT e.user_id AS game_id, event_type AS provider, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS quote_id FROM events e JOIN slate s ON s.game_id=e.user_id WHERE ts < kickoff GROUP BY 1, 2""")
def _(d):
    e = _events(d).select(F.col("user_id").alias("game_id"), F.col("event_type").alias("provider"), F.col("event_id").alias("quote_id"), "ts")
    j = e.join(d.slate.select("game_id", F.col("kickoff").cast("timestamp").alias("kickoff")), "game_id").where("ts < kickoff").drop("kickoff")
    target = scratch_path(d.spark, "latest")
    S.upsert_batches(j, target, ["game_id", "provider"], "provider", ["ts", "quote_id"])
    return d.spark.read.schema("game_id BIGINT, quote_id BIGINT, ts TIMESTAMP, provider STRING").parquet(target).select("game_id", "provider", "quote_id")


@query("ss8_idempotent_upsert", sql=f"""
    SELECT user_id, CAST(day(ts) AS INT) AS day, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, {q6('arg_max(value, struct_pack(a := ts, b := event_id))')} AS value FROM events GROUP BY 1, 2""")
def _(d):
    e = _events(d).select("user_id", F.dayofmonth("ts").alias("day"), "event_type", "value", "ts", "event_id")
    target = scratch_path(d.spark, "upsert")
    S.upsert_batches(e, target, ["user_id", "day"], "day", ["ts", "event_id"])
    S.upsert_batches(e, target, ["user_id", "day"], "day", ["ts", "event_id"])  # the same input again changes nothing
    out = d.spark.read.schema("user_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP, event_id BIGINT, day INT").parquet(target)
    return out.select("user_id", "day", "event_type", r6("value").alias("value"))


@query("ss9_interval_join", sql="""
    SELECT a.event_id AS forecast_id, b.event_id AS quote_id FROM events a JOIN events b ON a.user_id=b.user_id AND b.ts>=a.ts AND b.ts<=a.ts + INTERVAL 12 HOUR WHERE a.event_type='purchase' AND b.event_type='click'""")
def _(d):
    f = _events(d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("forecast_id"), F.col("ts").alias("made_at"))
    q = _events(d).where("event_type = 'click'").select("user_id", F.col("event_id").alias("quote_id"), F.col("ts").alias("captured_at"))
    out = S.interval_join(f, q, "user_id", "made_at", "captured_at", "12 HOURS", "1 day").select("forecast_id", "quote_id")
    return S.run_to_table(out, "interval")
