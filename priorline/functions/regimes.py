"""Routing labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legacy to current route names.
LEGACY_ROUTES = {
    "preseason": "game_1", "one_game": "game_2", "two_games": "game_3", "three_games": "game_4",
    "established": "established",
}


def upcoming_route(completed_games: Column) -> Column:
    """FN-24: route of the next game from the number of completed ones."""
    n = F.greatest(F.coalesce(completed_games, F.lit(0)).cast("int"), F.lit(0))
    return F.when(n >= 4, "established").otherwise(F.concat(F.lit("game_"), (n + 1).cast("string")))


def completed_route(completed_games: Column) -> Column:
    """FN-24: the legacy names for the same counts."""
    n = completed_games
    return (F.when(n == 0, "preseason").when(n == 1, "one_game").when(n == 2, "two_games")
            .when(n == 3, "three_games").otherwise("established"))


def canonical_route(name: Column) -> Column:
    """FN-24: legacy names become current ones, current ones stay, others are NULL."""
    table = F.create_map(*[F.lit(x) for pair in LEGACY_ROUTES.items() for x in pair])
    return F.when(name.rlike("^game_[1-4]$"), name).otherwise(F.try_element_at(table, name))


def week_bucket(week: Column) -> Column:
    """FN-25: weeks 1 to 4 alone, then 5-8, 9-12 and 13-16."""
    return (F.when(week.between(1, 4), week.cast("string")).when(week.between(5, 8), "5-8")
            .when(week.between(9, 12), "9-12").when(week >= 13, "13-16"))


def stage_key(completed_games: Column) -> Column:
    return F.when(completed_games >= 4, "4_plus").otherwise(completed_games.cast("string"))


def label_by_edges(value: Column, edges: list[Column], labels: list[str]) -> Column:
    """FN-25 / AG-21: label of the first edge the value does not exceed, the last label beyond."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(value <= edge, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)
