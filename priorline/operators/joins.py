"""Joins with cardinality and time contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import prior_totals

ROWS = 1 << 18


def by_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by hashes of its keys, in as many partitions as hold about ``ROWS`` rows each.

    For a join and a grouping in one task that hardly merge rows: with a fixed number of partitions a task's sorts and hash
    maps grow with the table.
    """
    return df.repartition(max(1, -(-df.count() // ROWS)), *keys)


def sides(games: DataFrame, keep: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """JN-8: one row per game to one row per side; ``pairs`` maps a name to its (home, away) columns."""
    rows = [F.struct(F.lit(label).alias("side"), *[F.col(p[i]).alias(n) for n, p in pairs.items()])
            for i, label in enumerate(("home", "away"))]
    return games.select(*keep, F.inline(F.array(*rows)))


def sides_to_wide(long: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """JN-8 back: one row per game; each side contributes once."""
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    return long.groupBy(*keys).agg(*[pick(side, c) for c in columns for side in ("home", "away")])


def opponent_rows(df: DataFrame, event: list[str], team: str, columns: list[str]) -> DataFrame:
    """JN-7: each row with the other side's columns of the same event."""
    other = df.select(*event, F.col(team).alias("_other"), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return df.join(other, event).where(F.col(team) != F.col("_other")).withColumnRenamed("_other", "opponent_team")


def completed_before(sides_df: DataFrame, keys: list[str], time: str, done: Column) -> DataFrame:
    """JN-9: completed games of the team strictly before this kickoff; same-time games do not count."""
    counts = prior_totals(sides_df, keys, time, {"games_before": F.when(done, 1).otherwise(0)})
    return sides_df.join(counts, [*keys, time], "left")


def latest_state(probes: DataFrame, states: DataFrame, keys: list[str], probe_time: str, state_time: str,
                 columns: list[str]) -> DataFrame:
    """JN-10: the newest state at or before each probe time.

    Both sides are reduced to one row per (key, time) before the ordered pass, so its length is
    the number of distinct times of a key, not its number of rows.
    """
    payload = F.struct(F.col(state_time).alias("_at"), *columns)
    s = states.groupBy(*keys, F.col(state_time).alias("_t")).agg(F.max(payload).alias("_state"))
    p = probes.select(*keys, F.col(probe_time).alias("_t")).distinct()
    both = p.withColumn("_probe", F.lit(1)).join(s, [*keys, "_t"], "full_outer")
    upto = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_state", F.last("_state", True).over(upto)).where("_probe = 1")
    filled = filled.select(*keys, F.col("_t").alias(probe_time), F.col("_state._at").alias(f"matched_{state_time}"),
                           *[F.col(f"_state.{c}").alias(c) for c in columns])
    return probes.join(filled, [*keys, probe_time], "left")


def available_evidence(evidence: DataFrame, cutoffs: DataFrame, season: str = "season") -> DataFrame:
    """JN-11/12: evidence of an earlier week that was available at the cutoff, per cutoff.

    The expansion is one row per admissible (cutoff, evidence) pair, as the table is defined.  To
    total over cutoffs use :func:`cutoff_totals`, which never expands.
    """
    c = cutoffs.withColumnRenamed(season, "_season")
    return evidence.join(c, (F.col(season) == F.col("_season")) & (F.col("week") < F.col("as_of_week"))
                         & (F.col("available") <= F.col("cutoff"))).drop("_season")


def _first_cutoff(evidence: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The cutoffs of the season in week order, and the first that admits the row.

    All later cutoffs of a season admit what an earlier one does, so the job fails where a cutoff lies before that of an earlier week.
    """
    spec = cutoffs.groupBy("season").agg(F.array_sort(F.collect_list(F.struct("as_of_week", "cutoff"))).alias("_weeks"))
    rising = F.col("_weeks.cutoff") == F.array_sort("_weeks.cutoff")
    spec = spec.withColumn("_weeks", F.when(rising, F.col("_weeks")).otherwise(F.raise_error(F.format_string("cutoffs of season %s do not rise with the week", F.col("season").cast("string")))))
    first = F.filter("_weeks", lambda w: (w["as_of_week"] > F.col("week")) & (w["cutoff"] >= F.col("available")))
    return evidence.join(spec, "season").withColumn("_first", F.get(first, F.lit(0))["as_of_week"]).where("_first IS NOT NULL")


def cutoff_entries(evidence: DataFrame, cutoffs: DataFrame, keys: list[str], sums: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """JN-12 for keys that seldom repeat (team pairs): evidence summed per (season, key, ``at``), the place of the first
    admitting cutoff, from which on it counts; and the places (season, at, as_of_week).  Nothing is listed per cutoff."""
    weeks = cutoffs.groupBy("season").agg(F.array_sort(F.collect_set("as_of_week")).alias("_all"))
    cell = _first_cutoff(evidence, cutoffs).groupBy("season", *keys, "_first").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    at = F.array_position("_all", F.col("_first")).cast("int") - 1
    return cell.join(weeks, "season").select("season", *keys, at.alias("at"), *sums), weeks.select("season", F.posexplode("_all").alias("at", "as_of_week"))


def cutoff_totals(evidence: DataFrame, cutoffs: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """JN-12: totals per (key, as_of_week) over earlier available evidence.

    Evidence is assigned to the first week whose cutoff admits it and summed there; the totals are
    running sums over weeks.  Cost is rows + keys x weeks instead of rows x weeks.
    """
    cell = _first_cutoff(evidence, cutoffs).groupBy("season", *keys, F.col("_first").alias("as_of_week")).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()])
    grid = cell.select("season", *keys).distinct().join(cutoffs.select("season", "as_of_week"), "season")
    upto = Window.partitionBy("season", *keys).orderBy("as_of_week").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(cell, ["season", *keys, "as_of_week"], "left")
    return out.select("season", *keys, "as_of_week", *[F.sum(n).over(upto).alias(n) for n in sums]).where(
        reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in sums]))


def prior_season(df: DataFrame, mapping: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """JN-13: columns of the prior season; ``mapping`` (season, prior_season) overrides season - 1.

    A mapping row with a null prior season forbids the join.
    """
    m = mapping.select("season", F.col("prior_season").alias("_prior"), F.lit(True).alias("_mapped"))
    prior = df.select(*keys, F.col("season").alias("_ps"), *[F.col(c).alias(f"prior_{c}") for c in columns])
    cur = df.join(m, "season", "left").withColumn(
        "_ps", F.when(F.col("_mapped"), F.col("_prior")).otherwise(F.col("season") - 1))
    return cur.join(prior, [*keys, "_ps"], "left").withColumnRenamed("_ps", "prior_season").drop("_prior", "_mapped")


def next_start(segments: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """JN-14: start value of the next segment of the group; null when two segments tie for next."""
    starts = segments.groupBy(group, order).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(order)
    one = F.when(F.col("_n") == 1, F.col("_lo"))
    return starts.select(group, order, F.lead(one).over(w).alias("next_start"))


def unpivot_targets(df: DataFrame, keys: list[str], columns: list[str], name: str = "target", value: str = "line") -> DataFrame:
    """JN-15: one row per target with a value."""
    return df.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def frame_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """JN-16: one row per missing key or differing cell; numbers within the tolerance are equal."""
    kinds = dict(left.dtypes)
    l = left.select(*keys, F.struct(*columns).alias("_l"))
    r = right.select(*keys, F.struct(*columns).alias("_r"))
    both = l.join(r, keys, "full_outer")
    cells = []
    for c in columns:
        a, b = F.col(f"_l.{c}"), F.col(f"_r.{c}")
        same = a.eqNullSafe(b)
        if tolerance and kinds[c] in ("double", "float", "int", "bigint"):
            same = same | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        cells.append(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~same, F.struct(
            F.lit(c).alias("field"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"),
            F.lit("changed").alias("kind"))))
    lone = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    empty = F.lit(None).cast("string")
    cells.append(F.when(lone.isNotNull(), F.struct(F.lit("*").alias("field"), empty.alias("left_value"),
                                                   empty.alias("right_value"), lone.alias("kind"))))
    return both.select(*keys, F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def cardinality_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN-17: one row about how two tables meet on their keys."""
    l = left.groupBy(*keys).agg(F.count("*").alias("l"))
    r = right.groupBy(*keys).agg(F.count("*").alias("r"))
    both = l.join(r, keys, "full_outer").select(F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    many = count((F.col("l") > 1) & (F.col("r") > 1))
    return both.agg(count(F.col("l") > 1).alias("left_duplicates"), count(F.col("r") > 1).alias("right_duplicates"),
                    count(F.col("r") == 0).alias("left_only"), count(F.col("l") == 0).alias("right_only"),
                    F.sum(F.col("l") * F.col("r")).alias("joined_rows"), (many > 0).alias("many_to_many"))


def mirror_problems(rows: DataFrame, event: list[str], value: str) -> DataFrame:
    """JN-18: offense rows whose opponent's defense row is missing or different."""
    off = rows.where("role = 'offense'").select(*event, F.col("team").alias("a"), F.col("opponent").alias("b"), F.col(value).alias("off"))
    dfn = rows.where("role = 'defense'").select(*event, F.col("opponent").alias("a"), F.col("team").alias("b"), F.col(value).alias("def"))
    both = off.withColumn("_o", F.lit(1)).join(dfn.withColumn("_d", F.lit(1)), [*event, "a", "b"], "full_outer")
    problem = (F.when(F.col("_d").isNull(), "missing_defense").when(F.col("_o").isNull(), "missing_offense")
               .when(~F.col("off").eqNullSafe(F.col("def")), "different"))
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(*event, "a", "b", "problem")


def complete_grid(population: DataFrame, observed: DataFrame, keys: list[str], axes: dict[str, list[str]], value: str) -> DataFrame:
    """JN-19: every expected key, with a reason where nothing was observed.

    The axes are fixed lists (roles, measurements) exploded in the row, so there is no cross join.
    """
    grid = population.select(*keys)
    for name, labels in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))
    out = grid.join(observed.select(*keys, *axes, F.col(value), F.lit(True).alias("_seen")), [*keys, *axes], "left")
    return out.withColumn("missing_reason", F.when(F.col("_seen").isNull(), "no_observation").when(
        F.col(value).isNull(), "null_value")).drop("_seen")


def exposed_games(games: DataFrame, flagged: DataFrame) -> DataFrame:
    """JN-20: games where either team had a flagged game in an earlier week of the season."""
    first = flagged.groupBy("season", "team").agg(F.min("week").alias("first_week"))
    side = lambda c: first.select("season", F.col("team").alias(c), F.col("first_week").alias(f"{c}_first"))
    out = games.join(side("home"), ["season", "home"], "left").join(side("away"), ["season", "away"], "left")
    hit = lambda c: F.coalesce(F.col(f"{c}_first") < F.col("week"), F.lit(False))
    return out.withColumn("exposed", hit("home") | hit("away")).drop("home_first", "away_first")
