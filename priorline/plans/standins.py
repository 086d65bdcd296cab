"""Sports-shaped tables derived from the star-schema tables.

Each stand-in is one SELECT in SQL that Spark and an ANSI engine read the same way, so the
Spark queries and their checking SQL start from identical rows.  All entity keys come from
keys that grow with the data, so the number of teams, games and quotes grows with it too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..sources.tables import NAMES, Tables

# Provider play-type labels used to label the derived plays.
PLAY_TYPES = [
    "Rush", "Pass Reception", "Pass Incompletion", "Rush", "Pass", "Sack", "Penalty",
    "Rushing Touchdown", "Passing Touchdown", "Interception", "Fumble Recovery (Own)",
    "Fumble Recovery (Opponent)", "Punt", "Kickoff", "Field Goal Good", "Field Goal Missed",
    "Kickoff Return (Offense)", "Punt Return", "Safety", "Timeout", "Two Point Rush",
    "Extra Point Good", "Interception Return Touchdown", "Pass Completion", "End Period",
    "Blocked Punt", "Blocked Field Goal", "Fumble Return Touchdown", "Rush", "Pass Reception",
]


def _labels(index: str, labels: list[str]) -> str:
    return f"split_part('{'|'.join(labels)}', '|', {index} + 1)"


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

STANDINS: dict[str, str] = {
    # one game per order: 100 games a team, about 14 a season
    "games": """
        SELECT game_id, season, week, kickoff, home, away, completed, neutral, status,
               CASE WHEN completed THEN CAST(price % 49 AS INT) END AS home_points,
               CASE WHEN completed THEN CAST(FLOOR(price / 49) % 49 AS INT) END AS away_points,
               price
        FROM (SELECT o_orderkey AS game_id,
                     CAST(year(o_orderdate) AS INT) AS season,
                     CAST(FLOOR((dayofyear(o_orderdate) - 1) / 7) + 1 AS INT) AS week,
                     o_orderdate + INTERVAL '1' HOUR * CAST(12 + o_orderkey % 10 AS INT) AS kickoff,
                     CAST(FLOOR(o_custkey / 5) AS BIGINT) AS home,
                     CAST(FLOOR(o_orderkey / 50) AS BIGINT) AS away,
                     o_orderstatus <> 'P' AS completed,
                     o_orderpriority = '5-LOW' AS neutral,
                     o_orderpriority AS status,
                     CAST(FLOOR(o_totalprice) AS BIGINT) AS price
              FROM {orders}) o
        WHERE home <> away""",
    # two rows per game, one per team
    "sides": """
        SELECT game_id, season, week, kickoff, completed, home AS team, away AS opponent, 'home' AS side,
               home_points AS points_for, away_points AS points_against FROM {games}
        UNION ALL
        SELECT game_id, season, week, kickoff, completed, away AS team, home AS opponent, 'away' AS side,
               away_points AS points_for, home_points AS points_against FROM {games}""",
    # exposure rows: a supplier (offense) meets a part family (defense)
    "exposures": """
        SELECT l_orderkey AS game_id, l_linenumber AS play_number,
               CAST(year(l_shipdate) AS INT) AS season,
               CAST(FLOOR((dayofyear(l_shipdate) - 1) / 7) + 1 AS INT) AS week,
               l_shipdate AS kickoff,
               l_suppkey AS offense, CAST(FLOOR(l_partkey / 20) AS BIGINT) AS defense,
               l_extendedprice * (1 - l_discount) AS num, l_quantity AS den,
               l_returnflag AS flag, l_linestatus AS line_status
        FROM {lineitem}""",
    # ordered play log: a user's events are one game, week days make the periods
    "plays": f"""
        SELECT game_id, play_id, ts, season, week, quarter, CAST(play_id AS BIGINT) AS play_number,
               home, away, CASE WHEN v % 2 = 0 THEN home ELSE away END AS offense,
               CASE WHEN v % 2 = 0 THEN away ELSE home END AS defense,
               {_labels("CAST((k * 7 + v) % 30 AS INT)", PLAY_TYPES)} AS play_type,
               CAST(v % 31 - 6 AS DOUBLE) AS yards_gained,
               CAST(1 + (v10 % 4) AS INT) AS down,
               CAST(v100 % 11 AS DOUBLE) AS yards_to_first,
               CAST((k * 37 + v100) % 100 + 1 AS DOUBLE) AS yards_to_goal,
               CAST(100 - ((k * 37 + v100) % 100 + 1) AS DOUBLE) AS yard_line,
               CAST(FLOOR(v10 / 3) % 60 AS INT) AS offense_score,
               CAST(FLOOR(v10 / 7) % 60 AS INT) AS defense_score,
               CASE WHEN event_type = 'error' THEN NULL ELSE v100 / 10000.0 - 0.15 END AS ppa,
               k, v100, event_type
        FROM (SELECT user_id AS game_id, event_id AS play_id, ts, event_type, 2024 AS season,
                     CAST(FLOOR(user_id / 10) % 15 + 1 AS INT) AS week,
                     CAST(FLOOR((day(ts) - 1) / 7) + 1 AS INT) AS quarter,
                     CAST(FLOOR(user_id / 3) AS BIGINT) AS home,
                     CAST(FLOOR(user_id / 3) + 1 + user_id % 3 AS BIGINT) AS away,
                     {_K} AS k,
                     CAST(FLOOR(value) AS BIGINT) AS v,
                     CAST(FLOOR(value * 10 + 0.0001) AS BIGINT) AS v10,
                     CAST(ROUND(value * 100) AS BIGINT) AS v100
              FROM {{events}}) e""",
    # timestamped market lines: event type is the provider
    "quotes": f"""
        SELECT event_id AS quote_id, user_id AS game_id,
               CASE event_type WHEN 'error' THEN 'consensus' ELSE event_type END AS provider,
               ts AS captured_at,
               CASE WHEN k % 10 = 0 THEN NULL ELSE (v100 % 81) / 2.0 - 20 END AS spread,
               CASE WHEN k % 11 = 0 THEN NULL ELSE 30 + (v100 % 61) / 2.0 END AS total,
               CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN CAST(-100 - k % 30 AS INT)
                    ELSE CAST(100 + k AS INT) END AS side_price
        FROM (SELECT event_id, user_id, event_type, ts, {_K} AS k,
                     CAST(ROUND(value * 100) AS BIGINT) AS v100 FROM {{events}}) e""",
    # the slate the quotes refer to, with forecasts and finals
    "slate": """
        SELECT c_custkey AS game_id, 2024 AS season, CAST(c_nationkey % 15 + 1 AS INT) AS week,
               CAST('2024-01-12 18:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 17 AS INT) AS kickoff,
               CAST(FLOOR(c_custkey / 3) AS BIGINT) AS home,
               CAST(FLOOR(c_custkey / 3) + 1 + c_custkey % 3 AS BIGINT) AS away,
               CAST(a % 81 AS DOUBLE) / 2 - 20.25 AS pred_margin,
               35.25 + CAST(FLOOR(a / 81) % 41 AS DOUBLE) AS pred_total,
               c_mktsegment <> 'BUILDING' AS completed,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(a % 45 AS INT) END AS home_points,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(FLOOR(a / 45) % 45 AS INT) END AS away_points
        FROM (SELECT *, CAST(FLOOR(ABS(c_acctbal)) AS BIGINT) AS a FROM {customer}) c""",
    # long forecasts with outcome, two targets per game
    "graded": """
        SELECT season, week, game_id, home, away, target, prediction, sigma, actual, stage, line FROM (
            SELECT season, week, game_id, home, away, 'margin' AS target,
                   CAST(price % 61 AS DOUBLE) / 2 - 15.25 AS prediction,
                   CAST(12 + game_id % 5 AS DOUBLE) AS sigma,
                   CAST(home_points - away_points AS DOUBLE) AS actual,
                   CAST(game_id % 5 AS INT) AS stage, CAST(price % 57 AS DOUBLE) / 2 - 14 AS line
            FROM {games} WHERE completed
            UNION ALL
            SELECT season, week, game_id, home, away, 'total' AS target,
                   30.25 + CAST(price % 83 AS DOUBLE) / 2 AS prediction,
                   CAST(13 + game_id % 7 AS DOUBLE) AS sigma,
                   CAST(home_points + away_points AS DOUBLE) AS actual,
                   CAST(game_id % 5 AS INT) AS stage, 31 + CAST(price % 79 AS DOUBLE) / 2 AS line
            FROM {games} WHERE completed) g""",
}

_REF = re.compile(r"\{(\w+)\}")


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for ref in _REF.findall(STANDINS[name]):
            if ref in STANDINS:
                visit(ref)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def with_ctes(sql: str, names: list[str]) -> str:
    """Prefix ``sql`` with the stand-ins it uses; a leading WITH of ``sql`` is merged in."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({_REF.sub(lambda m: m.group(1), STANDINS[n])})" for n in _order(names))
    body = sql.strip()
    recursive = body[:15].upper().startswith("WITH RECURSIVE ")
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Domain:
    """The driver tables plus the stand-ins, all lazy."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.spark = tables.spark
        self.root = tables.root

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.tables.read(name)
        if name in STANDINS:
            refs = {ref: getattr(self, ref) for ref in set(_REF.findall(STANDINS[name]))}
            return self.spark.sql(STANDINS[name], **refs)
        raise AttributeError(name)
