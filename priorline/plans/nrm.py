"""Normalisers over raw-looking projections of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plays as P
from ..operators import normalize as N
from .fn import ELIGIBLE_SQL
from .registry import q6, query, r6


@query("nrm1_camel_coalesce", sql="""
    SELECT o_orderkey AS game_id, o_custkey AS home_team_id, o_orderstatus AS status FROM orders""")
def _(d):
    odd = F.col("o_orderkey") % 3 == 0
    raw = d.orders.select(
        F.when(odd, F.col("o_orderkey")).alias("gameId"), F.when(~odd, F.col("o_orderkey")).alias("game_id"),
        F.col("o_custkey").alias("homeTeamId"), F.when(odd, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderstatus").alias("Status_"))
    return N.coalesce_camel(raw.withColumn("status", F.coalesce("status", "Status_")).drop("Status_"))


def _rendered(d):
    ts, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    return d.orders.select("o_orderkey", (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.date_format(ts, "yyyy/MM/dd HH:mm")).when(k == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+00:00'"))
        .when(k == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'"))
        .when(k == 6, F.date_format(ts, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))).alias("text"))


@query("nrm2_mixed_utc_parse", sql="""
    SELECT o_orderkey, o_orderdate AS kickoff_utc, timezone('America/New_York', timezone('UTC', o_orderdate)) AS kickoff_eastern FROM orders""")
def _(d):
    at = N.parse_utc(F.col("text"))
    return _rendered(d).select("o_orderkey", at.alias("kickoff_utc")).withColumn(
        "kickoff_eastern", N.to_local(F.col("kickoff_utc")))


@query("nrm3_decode_structs", sql="""
    SELECT event_type, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def _(d):
    text = F.when(F.col("event_id") % 2 == 0, F.replace(F.col("props"), F.lit('"'), F.lit("'"))).otherwise(F.col("props"))
    return d.events.select("event_type", N.decode_struct(text, "k INT").alias("s")).groupBy("event_type").agg(
        F.count("s.k").alias("n"), F.sum("s.k").alias("total"))


CLASSED_SQL = """classed AS (SELECT *, CASE WHEN home%10=0 THEN 'fcs' WHEN home%2=0 THEN 'FBS' ELSE 'fbs' END AS home_class,
    CASE WHEN away%11=0 THEN 'fcs' WHEN away%97=1 THEN NULL ELSE 'Fbs' END AS away_class FROM games)"""


def _classed(d):
    return d.games.withColumns({
        "home_class": F.when(F.col("home") % 10 == 0, "fcs").when(F.col("home") % 2 == 0, "FBS").otherwise("fbs"),
        "away_class": F.when(F.col("away") % 11 == 0, "fcs").when(F.col("away") % 97 != 1, "Fbs")})


@query("nrm4_games_with_policy", uses="games", sql=f"""WITH {CLASSED_SQL}
    SELECT season, game_id, week AS provider_week, CASE WHEN neutral THEN week+1 ELSE week END AS week FROM classed
    WHERE lower(home_class)='fbs' AND lower(away_class)='fbs'""")
def _(d):
    policy = d.games.select("season", "game_id", F.col("week").alias("provider_week"),
                            (F.col("week") + F.col("neutral").cast("int")).alias("canonical_week"))
    return N.normalize_games(_classed(d), policy).select("season", "game_id", "provider_week", "week")


@query("nrm5_population_class", uses="games", sql=f"""WITH {CLASSED_SQL}
    SELECT season, CASE WHEN away_class IS NULL THEN 'unresolved' WHEN lower(home_class)=lower(away_class) THEN
           CASE WHEN home_class='fcs' THEN 'excluded' ELSE 'fbs_fbs' END ELSE 'fbs_fcs' END AS population, count(*) AS games FROM classed GROUP BY 1,2""")
def _(d):
    return _classed(d).groupBy("season", N.classify_population(F.col("home_class"), F.col("away_class")).alias("population")).agg(
        F.count("*").alias("games"))


@query("nrm6_plays_unwrap", uses="plays", sql="SELECT game_id, play_id, season, week, play_type FROM plays")
def _(d):
    p = d.plays
    raw = p.select(F.when(F.col("k") % 2 == 0, F.col("game_id")).alias("game_id"), F.lit(None).cast("long").alias("play_id"),
                   F.struct("game_id", "play_id", "play_type").alias("rec"))
    games = p.groupBy("game_id").agg(F.max("season").alias("season"), F.max("week").alias("week"))
    return N.normalize_plays(raw, games)


@query("nrm7_constrain_to_games", uses="games", sql="""
    SELECT l.l_orderkey AS game_id, count(*) AS n, min(g.season) AS season, min(g.week) AS week
    FROM lineitem l JOIN games g ON g.game_id = l.l_orderkey GROUP BY 1""")
def _(d):
    lines = d.lineitem.select(F.col("l_orderkey").alias("game_id"), F.lit(None).cast("int").alias("season"),
                              F.lit(None).cast("int").alias("week"))
    return N.constrain_to_context(lines, d.games).groupBy("game_id").agg(
        F.count("*").alias("n"), F.min("season").alias("season"), F.min("week").alias("week"))


@query("nrm8_quotes_flatten", uses="quotes", sql=f"""
    SELECT game_id, provider, count(*) AS quotes, count(spread) AS spreads, {q6('sum(total)')} AS totals, 32 AS id_length
    FROM quotes WHERE spread IS NOT NULL OR total IS NOT NULL GROUP BY 1, 2""")
def _(d):
    q = d.quotes.where("spread IS NOT NULL OR total IS NOT NULL")
    per = (F.col("quote_id") % 2 == 0)
    line = F.struct("provider", "spread", F.when(per, F.col("total")).alias("total"), F.col("total").alias("over_under"))
    records = q.groupBy("game_id", "captured_at").agg(F.collect_list(line).alias("lines"))
    flat = N.flatten_quotes(records)
    return flat.groupBy("game_id", "provider").agg(
        F.count_distinct("quote_id").alias("quotes"), F.count("spread").alias("spreads"), r6(F.sum("total")).alias("totals"),
        F.max(F.length("quote_id")).alias("id_length"))


@query("nrm9_snapshots_enrich", uses="quotes slate", sql="""
    SELECT q.quote_id AS snapshot_id, q.captured_at AS snapshot_at, s.season, s.week FROM quotes q JOIN slate s USING (game_id)""")
def _(d):
    games = d.slate.select("game_id", "season", "week")
    return d.quotes.withColumnsRenamed({"quote_id": "snapshot_id", "captured_at": "snapshot_at"}).join(games, "game_id").select(
        "snapshot_id", "snapshot_at", "season", "week")


@query("nrm10_quarantine_lines", uses="quotes", sql="""
    SELECT quote_id, false AS usable_for_selection, false AS usable_for_grading, 'no_authentic_capture_time' AS quarantine_reason
    FROM quotes WHERE side_price IS NULL""")
def _(d):
    lines = d.quotes.withColumn("captured_at", F.when(F.col("side_price").isNotNull(), F.col("captured_at")))
    return N.quarantine_uncaptured(lines).select("quote_id", "usable_for_selection", "usable_for_grading", "quarantine_reason")


@query("nrm11_week_policy", uses="games", sql="""
    WITH o AS (SELECT o_orderkey AS game_id, CAST(1 + o_orderkey % 4 AS INT) AS cw FROM orders WHERE o_orderpriority='1-URGENT')
    SELECT CAST(season AS DOUBLE) AS season, game_id, CAST(week AS DOUBLE) AS provider_week, coalesce(cw, week) AS canonical_week,
           CASE WHEN season IS NULL THEN 'unknown_game' WHEN cw IS NULL THEN 'provider' WHEN cw=week THEN 'override_same' ELSE 'override' END AS source
    FROM games FULL JOIN o USING (game_id)""")
def _(d):
    o = d.orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("game_id"), (1 + F.col("o_orderkey") % 4).cast("int").alias("canonical_week"))
    return N.week_policy(d.games, o).withColumns({"season": F.col("season").cast("double"),
                                                  "provider_week": F.col("provider_week").cast("double")})


@query("nrm11_select_week_games", uses="games", sql="""
    SELECT season, game_id FROM games WHERE season=1999 AND CASE WHEN neutral THEN week+1 ELSE week END = 10""")
def _(d):
    over = d.games.where("neutral").select("game_id", (F.col("week") + 1).alias("canonical_week"))
    return N.week_policy(d.games, over).where("season = 1999 AND canonical_week = 10").select("season", "game_id")


@query("nrm12_team_alias", sql="""
    SELECT c.c_custkey, coalesce(n.n_name, 'X' || c.c_nationkey) AS canonical FROM customer c
    LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 3 <> 0""")
def _(d):
    aliases = d.nation.where("n_nationkey % 3 <> 0").select(F.concat(F.lit("X"), "n_nationkey").alias("alias"), F.col("n_name").alias("team"))
    names = d.customer.select("c_custkey", F.concat(F.lit("X"), "c_nationkey").alias("name"))
    return N.canonical_name(names, "name", aliases).select("c_custkey", "canonical")


@query("nrm13_outcomes_table", uses="games", sql="""
    SELECT season, game_id, CAST(home_points AS DOUBLE) AS home_points, CAST(away_points AS DOUBLE) AS away_points, completed FROM games WHERE completed""")
def _(d):
    raw = d.games.select(F.col("season").cast("string"), F.col("game_id").cast("string").alias("gameId"),
                         F.col("home_points").alias("homePoints"), F.col("away_points").alias("awayPoints"), "completed")
    g = N.coalesce_camel(raw)
    return g.where("completed").select(F.col("season").cast("int"), F.col("game_id").cast("long"),
                                       F.col("home_points").cast("double"), F.col("away_points").cast("double"), "completed")


@query("nrm14_name_resolution", sql="""
    SELECT s_name AS name, CASE WHEN s_suppkey%2=0 THEN s_name WHEN s_suppkey%3=0 THEN 'Alias ' || s_suppkey END AS game_name,
           CASE WHEN s_suppkey%2=0 THEN 'exact' WHEN s_suppkey%3=0 THEN 'alias' ELSE 'unresolved' END AS how FROM supplier""")
def _(d):
    s = d.supplier
    names = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(
        F.concat(F.lit("Alias "), "s_suppkey")).alias("name"))
    aliases = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("alias"), F.concat(F.lit("Alias "), "s_suppkey").alias("team"))
    return N.resolve_names(s.select(F.col("s_name").alias("name")), names, aliases)


@query("nrm15_event_match", uses="slate", sql="""
    SELECT game_id + 1000000 AS event_id, game_id, CASE WHEN game_id%3=0 THEN 'prefix' ELSE 'exact' END AS how
    FROM slate WHERE game_id%7 <> 6""")
def _(d):
    g = d.slate
    schedule = g.select("game_id", F.concat(F.lit("Téam "), "game_id", F.lit("x")).alias("home_name"),
                        F.concat(F.lit("Club "), "away").alias("away_name"), "kickoff")
    tail = F.when(F.col("game_id") % 3 == 0, " Raiders").otherwise("")
    shift = F.when(F.col("game_id") % 7 == 6, 30 * 60).otherwise((F.col("game_id") % 6) * 50)
    events = g.select((F.col("game_id") + 1000000).alias("event_id"),
                      F.concat(F.lit("TEAM-"), "game_id", F.lit("X"), tail).alias("home_name"),
                      F.concat(F.lit("club "), "away").alias("away_name"),
                      F.timestamp_seconds(F.unix_timestamp("kickoff") + shift).alias("kickoff"))
    return N.match_events(events, schedule, 5)


@query("nrm16_name_fold", sql="""
    SELECT doc_id, regexp_replace(lower(strip_accents(translate(text, 'øØœŒæÆßł', ''))), '[^a-z0-9]', '', 'g') AS folded FROM documents""")
def _(d):
    from ..functions.identity import fold_name
    return d.documents.select("doc_id", fold_name(F.translate("text", "øØœŒæÆßł", "")).alias("folded"))


@query("nrm17_source_dedup", sql="""
    SELECT event_id, event_type, value, CASE WHEN event_id%2=0 THEN 2 ELSE 1 END::BIGINT AS copies FROM events""")
def _(d):
    e = d.events.select("event_id", "event_type", "value")
    return N.dedup_source_rows(e.unionByName(e.where("event_id % 2 = 0")), "event_id", ["event_type", "value"])


@query("nrm18_sequence_collisions", sql="""
    WITH clash AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1),
    listed AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45)
    SELECT *, 'unlisted_collision' AS problem FROM (SELECT * FROM clash EXCEPT SELECT * FROM listed)
    UNION ALL SELECT *, 'unused_exception' FROM (SELECT * FROM listed EXCEPT SELECT * FROM clash)""")
def _(d):
    li = d.lineitem
    return N.sequence_collisions(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], li.where("l_quantity >= 45"))


@query("nrm19_corrections", sql=f"""
    SELECT o_orderkey, CASE WHEN o_orderpriority='1-URGENT' THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
           {q6("CASE WHEN o_orderpriority='1-URGENT' AND o_custkey%2=0 THEN 1.5 ELSE o_totalprice END")} AS o_totalprice FROM orders""")
def _(d):
    o = d.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    urgent = d.orders.where("o_orderpriority = '1-URGENT'")
    fixes = urgent.select("o_orderkey", F.lit("o_orderstatus").alias("changed_field"), F.col("o_orderstatus").alias("old_value"),
                          F.lit("Z").alias("new_value")).unionByName(
        urgent.where("o_custkey % 2 = 0").select("o_orderkey", F.lit("o_totalprice").alias("changed_field"),
                                                 F.col("o_totalprice").cast("string").alias("old_value"), F.lit("1.5").alias("new_value")))
    out = N.apply_corrections(o, fixes, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return out.withColumn("o_totalprice", r6("o_totalprice"))


@query("nrm19_unmatched_corrections", sql="""
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 1""")
def _(d):
    li = d.lineitem.select("l_orderkey", "l_linenumber")
    return N.unmatched_corrections(li, li, ["l_orderkey", "l_linenumber"])


@query("nrm20_drive_identity", uses="plays", sql="""
    WITH p AS (SELECT *, CASE WHEN k%2=0 THEN CAST(game_id*100+quarter AS VARCHAR) ELSE game_id || '-' || k%5 END AS drive_id,
                      CASE WHEN k%2=0 THEN 'provider' ELSE 'derived' END AS src FROM plays)
    SELECT game_id, drive_id, count(DISTINCT (offense, defense)) AS orientations, max(quarter)-min(quarter) AS span, max(src) AS drive_id_source,
           count(*) AS plays, max(src)='derived' AND (count(DISTINCT (offense, defense))>2 OR max(quarter)-min(quarter)>1) AS drive_ambiguous
    FROM p GROUP BY 1, 2""")
def _(d):
    p = d.plays.withColumns({"provider_drive_id": F.when(F.col("k") % 2 == 0, (F.col("game_id") * 100 + F.col("quarter")).cast("string")),
                             "drive_number": F.col("k") % 5})
    return N.drive_identity(p)


@query("nrm21_eligible_plays", uses="plays", sql=f"""
    SELECT game_id, offense, count(*) FILTER ({ELIGIBLE_SQL}) AS eligible, count(*) AS plays FROM plays GROUP BY 1, 2""")
def _(d):
    return d.plays.groupBy("game_id", "offense").agg(
        F.sum(P.flag(P.eligible_play())).alias("eligible"), F.count("*").alias("plays"))


@query("nrm22_period_class", uses="plays", sql="""
    SELECT CASE WHEN quarter<=4 THEN 'regulation' ELSE 'overtime' END AS period, count(*) AS n FROM plays GROUP BY 1""")
def _(d):
    return d.plays.groupBy(P.period_class().alias("period")).agg(F.count("*").alias("n"))


@query("nrm23_conflict_quarantine", sql="""
    SELECT l_orderkey, l_linenumber, CASE WHEN min(l_returnflag)=max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag, count(*) AS copies,
           CASE WHEN min(l_returnflag)=max(l_returnflag) THEN 'kept' ELSE 'quarantined' END AS disposition FROM lineitem GROUP BY 1, 2""")
def _(d):
    return N.split_conflicts(d.lineitem, ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("nrm24_schedule_merge", uses="games", sql="""
    SELECT game_id, home, away, CASE WHEN neutral THEN 2 ELSE 1 END::BIGINT AS observations FROM games""")
def _(d):
    base = d.games.select("game_id", "home", "away", "week")
    return N.merge_observations(base, d.games.where("neutral").select("game_id", "home", "away"), ["game_id"], ["home", "away"])


@query("nrm25_cutoff_mask", uses="games", sql="""
    SELECT season, count(*) AS games, count(*) FILTER (completed AND kickoff + INTERVAL 6 HOUR <= TIMESTAMP '1998-09-15 18:00:00') AS completed FROM games GROUP BY 1""")
def _(d):
    return N.mask_after_cutoff(d.games, F.lit("1998-09-15 18:00:00").cast("timestamp_ntz")).groupBy("season").agg(
        F.count("*").alias("games"), F.sum(F.col("completed").cast("int")).alias("completed"))


@query("nrm26_game_venues", uses="games", sql="""
    SELECT game_id, CAST(home%30 AS BIGINT) AS venue_id, CASE WHEN home%30<25 THEN n_name WHEN home%30<28 THEN 'Annex' END AS city,
           CASE WHEN home%30<25 THEN r_name WHEN home%30<28 THEN 'Other' END AS state,
           CASE WHEN home%30<25 THEN 'venue' WHEN home%30<28 THEN 'supplement' ELSE 'missing' END AS coverage
    FROM games LEFT JOIN nation ON n_nationkey = home%30 LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(d):
    venues = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("venue_id"), F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    extra = d.region.select((F.col("r_regionkey") + 25).cast("long").alias("venue_id"), F.lit("Annex").alias("city"), F.lit("Other").alias("state"))
    return N.attach_venues(d.games.withColumn("venue_id", F.col("home") % 30), venues, extra.where("venue_id < 28"))
