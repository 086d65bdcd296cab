"""IT-21: rules that rebuild a running score, and what each rule would settle.

The fits minimise the total absolute error over non-decreasing paths of whole scores.  Such a fit falls apart into one
question per score level -- from which row on is the path at least this high? -- and that row is where a running sum of
votes is least.  A running sum's least place is found in slices (total, least prefix, its last place) and then over the
slices of a stream, so a very long game is split over tasks.  The latest of equally good rows gives the lowest path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .ledger import STREAM
from .scan import previous, running

# fixed values: parts of provider labels of scoring plays
SCORING_MARKERS = ("Touchdown", "Field Goal Good", "Safety", "Extra Point Good", "Two Point")
RULES = ("r0_baseline", "r1_envelope", "r2_isotonic", "r3_quarter_anchored", "r4_scoring_rows")
MAX_DRIVE_POINTS = 8
FORBIDDEN = 1 << 40  # weighs more than all rows of a stream


def scoring_row(flag: Column, play_type: Column) -> Column:
    """The provider's flag, or a scoring play's label."""
    out = F.coalesce(flag, F.lit(False))
    for marker in SCORING_MARKERS:
        out |= F.coalesce(F.contains(play_type, F.lit(marker)), F.lit(False))
    return out


def _votes(levels: np.ndarray, y: np.ndarray, says: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost of being below, and of reaching, each level of the row, as (rows, levels)."""
    high = y[:, None] >= levels
    below = (says[:, None] & high) + FORBIDDEN * (lower[:, None] >= levels)
    reached = (says[:, None] & ~high) + FORBIDDEN * (upper[:, None] < levels)
    return below.astype(np.int64), reached.astype(np.int64)


def _piece_minima(levels: list[np.ndarray], sizes: np.ndarray, columns: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Per piece (rows that follow each other) and level: the sum of votes, the least sum over the first 1.. rows, how many rows that is, and the cost of reaching it at once."""
    starts, piece = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    table = np.full((len(levels), max(map(len, levels))), np.inf)
    for i, x in enumerate(levels):
        table[i, :len(x)] = x
    below, reached = _votes(table[piece], *columns)
    sums = np.cumsum(below - reached, axis=0)
    sums -= np.vstack([np.zeros((1, table.shape[1]), np.int64), sums[starts[1:] - 1]])[piece]
    least = np.minimum.reduceat(sums, starts, axis=0)
    place = (np.arange(len(piece)) - starts[piece] + 1)[:, None]
    last = np.maximum.reduceat(np.where(sums == least[piece], place, 0), starts, axis=0)
    told = np.isfinite(table)
    return {"_piece": np.nonzero(told)[0], "level": table[told], "_total": sums[starts + sizes - 1][told], "_least": least[told], "_rows": last[told],
            "_reached": np.add.reduceat(reached, starts, axis=0)[told]}


def _slice_minima(pdf: pd.DataFrame, keys: list[str], cells: int = 2_000_000) -> pd.DataFrame:
    """``_piece_minima`` of all (key, slice) pieces in the frame, many in one array call; a piece of more than ``cells`` numbers goes by parts of its levels."""
    pdf = pdf.sort_values([*keys, "_slice", "_pos"], ignore_index=True)
    first = np.flatnonzero(pdf["_pos"].to_numpy() == 0)
    sizes = np.diff(np.append(first, len(pdf)))
    levels = [x[x > 0] for x in (np.asarray(v, dtype=float) for v in pdf["_levels"].iloc[first])]
    kinds = {"_y": float, "_says": bool, "_lower": float, "_upper": float}
    columns = [pdf[c].to_numpy().astype(kind) for c, kind in kinds.items()]
    out, at = [], 0
    names = ["_piece", "level", "_total", "_least", "_rows", "_reached"]
    while at < len(first):
        end, rows, wide = at, 0, 0
        while end < len(first) and (end == at or (rows + sizes[end]) * max(wide, len(levels[end])) <= cells):
            rows, wide, end = rows + sizes[end], max(wide, len(levels[end])), end + 1
        part = [c[first[at]:first[at] + rows] for c in columns]
        step = max(1, cells // rows) if end == at + 1 else max(wide, 1)
        for low in range(0, wide, step):
            found = _piece_minima([x[low:low + step] for x in levels[at:end]], sizes[at:end], part)
            found["_piece"] = found["_piece"] + at
            out.append(found)
        at = end
    found = pd.DataFrame({n: np.concatenate([o[n] for o in out]) if out else [] for n in names})
    place = first[found.pop("_piece").to_numpy().astype(int)]
    for key in [*keys, "_slice"]:
        found.insert(0, key, pdf[key].to_numpy()[place])
    return found


def monotone_fit(rows: DataFrame, group: list[str], order: list[str], slice_by: Column | str, final: str, score: str, says: Column | None = None,
                 lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    """``rows`` with ``fitted``: the lowest non-decreasing path of least absolute error to the scores, capped at ``final``.

    Levels are 0, the final, the bounds and the scores seen between them, whole numbers, so there are at most ``final`` + 1 of
    them.  ``says`` marks the rows whose score counts (others, and those without a score, take what is carried to them; 0 at the start).
    Rows may have bounds; a group whose bounds no path keeps gets null.  ``slice_by`` must not decrease along ``order``.
    """
    slice_by = F.expr(slice_by) if isinstance(slice_by, str) else slice_by
    y = F.least(F.col(score).cast("double"), F.col(final).cast("double"))
    known = F.col(score).isNotNull() & (says if says is not None else F.lit(True))
    bound = lambda c, other: F.coalesce((c if c is not None else F.lit(None)).cast("double"), F.lit(other))
    base = rows.withColumns({
        "_slice": slice_by, "_y": F.coalesce(y, F.lit(0.0)), "_says": F.coalesce(known, F.lit(False)),
        "_lower": bound(lower, float("-inf")), "_upper": bound(upper, float("inf"))})
    base = stage_table(base.withColumn("_pos", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)) - 1))
    seen = F.array(*[F.when((F.col(c) >= 0) & (F.col(c) <= F.col(final)), F.floor(c)) for c in ("_y", "_lower", "_upper")], F.col(final).cast("long"), F.lit(0).cast("long"))
    levels = base.select(*group, F.explode(seen).alias("_l")).where("_l IS NOT NULL").groupBy(*group).agg(F.array_sort(F.collect_set("_l")).alias("_levels"))
    kinds = dict(base.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in reversed([*group, "_slice"])) + ", level DOUBLE, _total BIGINT, _least BIGINT, _rows BIGINT, _reached BIGINT"
    narrow = base.select(*group, "_slice", "_pos", "_y", "_says", "_lower", "_upper").join(levels, group)
    narrow = narrow.withColumn("_levels", F.when(F.col("_pos") == 0, F.col("_levels")))  # one copy a slice is enough
    # many short slices share one call of Python: about 20,000 rows
    share = F.pmod(F.xxhash64(*group, "_slice"), F.lit(1 + base.count() // 20_000)).alias("_share")
    parts = narrow.groupBy(share).applyInPandas(lambda pdf: _slice_minima(pdf, group), schema)
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*group, "level").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_value", before + F.col("_least"))
    best = parts.groupBy(*group, "level").agg(F.min("_value").alias("_value"), F.max_by(F.struct("_slice", "_rows"), F.struct(-F.col("_value"), F.col("_slice"))).alias("_at"),
                                              F.sum("_reached").alias("_reached"))
    # a switch before the first row has the value 0; a later one that is as good is preferred
    best = best.select(*group, "level", F.when(F.col("_value") <= 0, F.col("_at")).alias("_at"), (F.col("_reached") + F.least(F.col("_value"), F.lit(0)) >= FORBIDDEN).alias("_broken"))
    switches = best.groupBy(*group).agg(F.collect_list(F.struct("level", "_at")).alias("_switches"), F.bool_or("_broken").alias("_broken"))
    on = lambda s: s["_at"].isNull() | (F.col("_slice") > s["_at"]["_slice"]) | ((F.col("_slice") == s["_at"]["_slice"]) & (F.col("_pos") >= s["_at"]["_rows"]))
    out = base.join(switches, group, "left")
    reached = F.array_max(F.transform(F.filter("_switches", on), lambda s: s["level"]))
    fitted = F.when(~F.coalesce("_broken", F.lit(False)), F.coalesce(reached, F.lit(0.0)))
    return out.withColumn("fitted", fitted).drop("_slice", "_pos", "_y", "_says", "_lower", "_upper", "_switches", "_broken")


def quarter_bounds(line: str, quarter: str) -> tuple[Column, Column]:
    """Points before and through the row's quarter by the line score; rows after regulation may reach its total."""
    through = lambda n: F.aggregate(F.slice(line, 1, n), F.lit(0.0), lambda a, x: a + x)
    regulation, q = F.least(F.lit(4), F.size(line)), F.col(quarter).cast("int")
    inside = q <= regulation
    return through(F.when(inside, q - 1).otherwise(regulation)), through(F.when(inside, q).otherwise(F.size(line)))


def rebuild(stream: DataFrame, finals: DataFrame, order: list[str], slice_by: Column | str, rule: str, lines: DataFrame | None = None) -> DataFrame:
    """Each stream by one of ``RULES`` as ``repaired``; streams of teams without a final are left out.

    ``stream`` has (game_id, team, score, is_scoring, quarter); ``lines`` (game_id, team, line), needed by the quarter rule, whose
    answer is null where there is no line score, where it does not add up to the final, or where no path keeps its bounds.
    """
    s = stream.join(finals.select(*STREAM, F.col("final").cast("double").alias("final")), STREAM)
    if rule == "r0_baseline":
        return s.withColumn("repaired", F.col("score").cast("double"))
    if rule == "r1_envelope":
        out = running(s, STREAM, order, slice_by, {"_top": ("max", F.col("score").cast("double"))})
        return out.withColumn("repaired", F.least(F.coalesce("_top", F.lit(0.0)), F.col("final"))).drop("_top")
    if rule == "r2_isotonic":
        return monotone_fit(s, STREAM, order, slice_by, "final", "score").withColumnRenamed("fitted", "repaired")
    if rule == "r4_scoring_rows":
        return monotone_fit(s, STREAM, order, slice_by, "final", "score", F.col("is_scoring")).withColumnRenamed("fitted", "repaired")
    if rule != "r3_quarter_anchored" or lines is None:
        raise ValueError(f"no rule {rule}, or no line scores for it")
    s = s.join(lines.select(*STREAM, F.col("line").alias("_line")), STREAM, "left")
    adds_up = F.aggregate("_line", F.lit(0.0), lambda a, x: a + x) == F.col("final")
    s = s.withColumn("_line", F.when(adds_up, F.col("_line")))
    low, high = quarter_bounds("_line", "quarter")
    out = monotone_fit(s, STREAM, order, slice_by, "final", "score", None, low, high)
    return out.withColumn("repaired", F.when(F.col("_line").isNotNull(), F.col("fitted"))).drop("fitted", "_line")


def reject_reasons(stream: DataFrame, keys: list[str], order: list[str], slice_by: Column | str, value: str) -> DataFrame:
    """Per stream: ``reached`` and the first reason to reject it, or null: it falls, ends above or below the final, or a drive scores outside 0 to 8."""
    s = previous(stream, keys, order, slice_by, {"_was": value})
    at, x = F.struct(*order), F.col(value)
    whole = s.groupBy(*keys).agg(F.bool_or(x < F.col("_was")).alias("_falls"), F.max_by(value, at).alias("_last"), F.max("final").alias("_final"))
    drives = s.where("team = offense").groupBy(*keys, "drive_number").agg(F.max_by(value, at).alias("_l"), F.coalesce(F.min_by(F.struct("_was"), at)["_was"], F.lit(0.0)).alias("_b"))
    gain = (F.col("_l") - F.col("_b")).cast("long")
    odd = drives.groupBy(*keys).agg(F.bool_or((gain < 0) | (gain > MAX_DRIVE_POINTS)).alias("_odd"))
    reached = F.col("_last").cast("long")
    reason = (F.when(F.col("_falls"), "score_regression").when(reached > F.col("_final"), "exceeds_final").when(reached < F.col("_final"), "short_of_final")
              .when(F.col("_odd"), "drive_points_outside_0_8"))
    return whole.join(odd, keys, "left").select(*keys, reached.alias("reached"), reason.alias("reason"))


def repaired_streams(stream: DataFrame, finals: DataFrame, order: list[str], slice_by: Column | str, rules: tuple[str, ...] = RULES, lines: DataFrame | None = None) -> DataFrame:
    """Rows times ``rules``: the rebuilt score; a stream that is accepted as it is stays as it is.  ``changed`` marks rejected streams."""
    stream, finals = stage_table(stream), stage_table(finals)
    base = stream.join(finals.select(*STREAM, F.col("final").cast("double").alias("final")), STREAM)
    rejected = stage_table(reject_reasons(base.withColumn("score", F.col("score").cast("double")), STREAM, order, slice_by, "score")
                           .select(*STREAM, F.col("reason").isNotNull().alias("changed")))
    wanted = [c for c in dict.fromkeys([*STREAM, "play_id", "drive_number", "offense", "quarter", "is_scoring", "score", "final", *order])]
    bad = stage_table(stream.join(rejected.where("changed").select(*STREAM), STREAM, "left_semi"))
    kept = base.join(rejected.where("NOT changed").select(*STREAM), STREAM, "left_semi").select(*wanted, F.col("score").cast("double").alias("repaired"), F.lit(False).alias("changed"))
    out = kept.select(F.explode(F.array(*map(F.lit, rules))).alias("rule"), "*")
    for rule in rules:
        out = out.unionByName(rebuild(bad, finals, order, slice_by, rule, lines).select(F.lit(rule).alias("rule"), *wanted, "repaired", F.lit(True).alias("changed")))
    return out


def evaluate_repairs(stream: DataFrame, finals: DataFrame, order: list[str], slice_by: str, lines: DataFrame, rules: tuple[str, ...] = RULES, near: int = 2) -> DataFrame:
    """Every rule on every stream: is it accepted after the repair, why not, what it reaches, do its quarters match, how many rises lie near a scoring row.

    A rule without an answer is unresolved for ``quarter_bounds_infeasible`` and leaves the observed stream.
    """
    keys, lines = ["rule", *STREAM], stage_table(lines)
    rows = stage_table(repaired_streams(stream, finals, order, slice_by, rules, lines))
    silent = rows.groupBy(*keys).agg(F.max("repaired").isNull().alias("_silent"), F.max_by("score", F.struct(*order)).cast("long").alias("_observed"), F.bool_or("changed").alias("changed"))
    told = rows.where("repaired IS NOT NULL")
    reasons = reject_reasons(told, keys, order, slice_by, "repaired")
    # rises above the highest value so far
    up = running(told, keys, order, slice_by, {"_peak": ("max", F.col("repaired")), "_place": ("count", F.lit(1))}, inclusive=False, materialize=True)
    up = stage_table(up.withColumn("_rise", F.col("repaired") - F.greatest(F.lit(0.0), F.coalesce("_peak", F.lit(0.0)))))
    rises = up.where("_rise > 0")
    close = up.where("is_scoring").select(*keys, F.explode(F.sequence(F.col("_place") - near, F.col("_place") + near)).alias("_place")).distinct().withColumn("_near", F.lit(True))
    placed = rises.join(close, [*keys, "_place"], "left").groupBy(*keys).agg(F.count("_near").alias("placed"), F.count("*").alias("increments"))
    scored = rises.where("quarter IS NOT NULL").groupBy(*keys, "quarter").agg(F.sum(F.col("_rise").cast("long")).alias("_points"))
    gains = scored.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("quarter").cast("int"), "_points"))).alias("_gains"))
    out = silent.join(reasons, keys, "left").join(placed, keys, "left").join(gains, keys, "left").join(lines.select(*STREAM, "line"), STREAM, "left")
    regulation = F.least(F.lit(4), F.size("line"))
    gain = lambda q: F.coalesce(F.try_element_at("_gains", q), F.lit(0))
    quarters = F.forall(F.transform(F.slice("line", 1, regulation), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("q"))), lambda s: gain(s["q"]) == s["x"])
    extra = F.aggregate(F.filter(F.map_entries("_gains"), lambda e: e["key"] > regulation), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    rest = F.aggregate(F.slice("line", regulation + 1, F.size("line")), F.lit(0).cast("long"), lambda a, x: a + x)
    told = ~F.col("_silent")
    match = F.when(told & F.col("line").isNotNull(), quarters & (F.coalesce(extra, F.lit(0)) == rest))
    return out.select(
        *keys, (told & F.col("reason").isNull()).alias("resolved"), F.when(told, F.col("reason")).otherwise("quarter_bounds_infeasible").alias("reason"),
        (told & F.col("changed")).alias("changed"), F.when(told, F.col("reached")).otherwise(F.col("_observed")).alias("reached"), match.alias("quarter_match"),
        F.when(told, F.coalesce("placed", F.lit(0))).otherwise(0).alias("placed"), F.when(told, F.coalesce("increments", F.lit(0))).otherwise(0).alias("increments"))
