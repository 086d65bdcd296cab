"""Set-based checks. Each check is a DataFrame of findings; nothing is sampled and nothing is looped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import previous

union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)


@dataclass(frozen=True)
class Contract:
    """DQ-1/2: what a table must hold. A missing required column is found before any row is read."""

    name: str
    keys: list[str]
    required: list[str] = field(default_factory=list)
    non_null: list[str] = field(default_factory=list)
    integral: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    timestamps: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    enums: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    def missing(self, df: DataFrame) -> list[str]:
        wanted = dict.fromkeys([*self.keys, *self.required, *self.non_null, *self.integral, *self.flags, *self.timestamps, *self.identifiers,
                                *self.enums, *self.ranges])
        return [c for c in wanted if c not in df.columns]

    def violations(self) -> dict[str, Column]:
        null = lambda c: F.col(c).isNull()
        text = lambda c: F.col(c).cast("string")
        out = {f"null_key:{c}": null(c) for c in self.keys}
        out |= {f"null:{c}": null(c) for c in self.non_null}
        out |= {f"not_integral:{c}": F.col(c).cast("double") != F.floor(F.col(c).cast("double")) for c in self.integral}
        out |= {f"not_flag:{c}": ~text(c).isin("0", "1", "true", "false", "0.0", "1.0") for c in self.flags}
        out |= {f"not_timestamp:{c}": F.col(c).isNotNull() & F.try_to_timestamp(text(c)).isNull() for c in self.timestamps}
        out |= {f"not_identifier:{c}": ~text(c).rlike("^-?[0-9]+$") for c in self.identifiers}
        out |= {f"not_allowed:{c}": ~F.col(c).isin(v) for c, v in self.enums.items()}
        out |= {f"out_of_range:{c}": ~F.col(c).between(lo, hi) for c, (lo, hi) in self.ranges.items()}
        return out

    def check(self, df: DataFrame) -> DataFrame:
        """(rule, violations): one pass for all row rules, one grouped pass for the key."""
        missing = self.missing(df)
        if missing:
            raise ValueError(f"{self.name} lacks columns {missing}")
        rules = self.violations()
        counts = df.agg(*[F.count(F.when(F.coalesce(c, F.lit(False)), 1)).alias(str(i)) for i, c in enumerate(rules.values())])
        rows = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{i}`").alias("violations")) for i, n in enumerate(rules)])))
        dup = df.groupBy(*self.keys).agg(F.count("*").alias("n")).agg(F.lit("duplicate_key").alias("rule"), F.count(F.when(F.col("n") > 1, 1)).alias("violations"))
        return rows.unionByName(dup)


CHECKS: dict[str, tuple[str, str, Callable[[dict[str, DataFrame]], DataFrame], list[str]]] = {}


def register_check(name: str, stage: str, severity: str, needs: list[str]):
    """DQ-3 / UX-4: a check returns the rows that break it."""
    def wrap(fn):
        if name in CHECKS:
            raise ValueError(f"check {name} registered twice")
        CHECKS[name] = (stage, severity, fn, needs)
        return fn
    return wrap


def run_stage(stage: str, tables: dict[str, DataFrame], checks: dict | None = None) -> DataFrame:
    """DQ-3: one row per check of the stage: pass, fail, skip or block, with the count of findings.

    A check that cannot be built counts as failed; a missing required input blocks.
    """
    parts = []
    any_table = next(iter(tables.values()))
    blank = any_table.sparkSession.range(1)
    for name, (where, severity, fn, needs) in (CHECKS if checks is None else checks).items():
        if where != stage:
            continue
        base = {"check": F.lit(name), "severity": F.lit(severity)}
        if any(n not in tables for n in needs):
            status = "block" if severity == "required" else "skip"
            parts.append(blank.select(*[c.alias(n) for n, c in base.items()], F.lit(status).alias("status"), F.lit(0).cast("long").alias("findings")))
            continue
        try:
            found = fn(tables).agg(F.count("*").alias("findings"))
            parts.append(found.select(*[c.alias(n) for n, c in base.items()], F.when(F.col("findings") == 0, "pass").otherwise("fail").alias("status"), "findings"))
        except Exception:  # a check that cannot even be planned is a failed check
            parts.append(blank.select(*[c.alias(n) for n, c in base.items()], F.lit("fail").alias("status"), F.lit(-1).cast("long").alias("findings")))
    return union(parts)


def numbering_problems(rows: DataFrame, group: str, number: str, owner: str) -> DataFrame:
    """DQ-4: numbers must run 1..n per group; one owner per number."""
    per = rows.groupBy(group, number).agg(F.min(owner).alias("_a"), F.max(owner).alias("_b"))
    g = per.groupBy(group).agg(F.max(number).alias("_max"), F.min(number).alias("_min"), F.count("*").alias("_n"),
                               F.count(F.when(~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("shared_numbers"))
    return g.withColumn("contiguous", (F.col("_min") == 1) & (F.col("_max") == F.col("_n"))).drop("_min").withColumnsRenamed({"_max": "highest", "_n": "numbers"})


def coverage_both_ways(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str], minimum: int = 0) -> DataFrame:
    """DQ-5: keys on one side only, and keys with fewer left rows than wanted."""
    l = left.groupBy(*keys).agg(F.count("*").alias("_l"))
    r = right.groupBy(*keys).agg(F.count("*").alias("_r"))
    both = l.join(r, keys, "full_outer")
    problem = (F.when(F.col("_r").isNull(), f"no_{names[1]}").when(F.col("_l").isNull(), f"no_{names[0]}").when(F.col("_l") < minimum, f"few_{names[0]}"))
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def points_exceed_final(parts: DataFrame, finals: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-6: parts may never add up to more than the final."""
    s = parts.groupBy(*keys).agg(F.sum("points").alias("parts"))
    return s.join(finals, keys).where("parts > final")


def flag_problems(rows: DataFrame, value: str, flag: str, keys: list[str]) -> DataFrame:
    """DQ-7: null if and only if flagged."""
    return rows.groupBy(*keys).agg(F.count(F.when(F.col(value).isNull() & ~F.col(flag), 1)).alias("null_not_flagged"),
                                   F.count(F.when(F.col(value).isNotNull() & F.col(flag), 1)).alias("flagged_not_null"))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], only: Column | None = None) -> DataFrame:
    """DQ-8: null-safe field changes on rows that should be settled, and settled rows that vanished."""
    o = (old.where(only) if only is not None else old).select(*keys, F.struct(*columns).alias("_o"))
    both = o.join(new.select(*keys, F.struct(*columns).alias("_n")), keys, "left")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), F.lit(c)) for c in columns]))
    out = both.withColumn("changed", F.when(F.col("_n").isNull(), F.array(F.lit("*missing*"))).otherwise(fields))
    return out.where(F.size("changed") > 0).select(*keys, F.array_join("changed", ",").alias("changed"))


def ambiguous_versions(catalog: DataFrame, pins: DataFrame) -> DataFrame:
    """DQ-9: datasets with several versions and no pin."""
    n = catalog.groupBy("dataset").agg(F.count_distinct("version").alias("versions")).where("versions > 1")
    return n.join(pins.select("dataset"), "dataset", "left_anti")


def rule_violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """DQ-10/11: one row per broken (row, rule); all rules in one pass."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(*keys, F.explode(hits).alias("rule"))


def reconcile_games(derived: DataFrame, source: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """DQ-13: matched, incomplete_source or blocking_conflict per key, with the fields out of tolerance."""
    d = derived.select(*keys, F.struct(*tolerances).alias("_d"))
    s = source.select(*keys, F.struct(*tolerances).alias("_s"))
    both = d.join(s, keys, "full_outer")
    off = F.array_compact(F.array(*[F.when(F.abs(F.col(f"_d.{c}") - F.col(f"_s.{c}")) > t, F.lit(c)) for c, t in tolerances.items()]))
    gap = reduce(lambda a, b: a | b, [F.col(f"_s.{c}").isNull() | F.col(f"_d.{c}").isNull() for c in tolerances])
    out = both.withColumn("_off", F.when(F.col("_d").isNotNull() & F.col("_s").isNotNull(), off))
    status = (F.when(F.size("_off") > 0, "blocking_conflict").when(F.col("_d").isNull() | F.col("_s").isNull() | gap, "incomplete_source").otherwise("matched"))
    return out.select(*keys, status.alias("status"), F.array_join(F.coalesce("_off", F.array().cast("array<string>")), ",").alias("fields"))


def score_reconciliation(events: DataFrame, finals: DataFrame, keys: list[str], exceptions: DataFrame) -> DataFrame:
    """DQ-14: increments must add up to the final; reviewed exceptions must exist and be needed."""
    s = events.groupBy(*keys).agg(F.sum("points").alias("_sum"))
    both = finals.join(s, keys, "full_outer").withColumn("_gap", F.coalesce("final", F.lit(0)) - F.coalesce("_sum", F.lit(0)))
    both = both.join(exceptions.select(*keys, F.col("gap").alias("_known")), keys, "full_outer")
    problem = (F.when(F.col("_known").isNull() & (F.col("_gap") != 0), "unexplained").when(F.col("_known").isNotNull() & (F.coalesce("_gap", F.lit(0)) == 0), "unused_exception")
               .when(F.col("_known") != F.col("_gap"), "exception_differs"))
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def time_violations(rows: DataFrame, keys: list[str], rules: dict[str, tuple[str, str]]) -> DataFrame:
    """DQ-15: each rule names (earlier, later); a row breaks it when earlier is after later."""
    return rule_violations(rows, keys, {n: F.col(a) > F.col(b) for n, (a, b) in rules.items()})


def grid_completeness(rows: DataFrame, outer: list[str], inner: str, low: int, high: int) -> DataFrame:
    """DQ-17: cells of the outer x inner grid that hold no row."""
    seen = rows.select(*outer, inner).distinct()
    grid = rows.select(*outer).distinct().withColumn(inner, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return grid.join(seen, [*outer, inner], "left_anti")


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """DQ-19: nulls, zeros, distinct, minimum and maximum per column, in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), F.count(F.when(x == 0, 1)).alias("zeros"),
                             F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean")).alias(f"_{i}"))
    return rows.agg(*aggs).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def condition_number(rows: DataFrame, a: str, b: str) -> DataFrame:
    """DQ-19: condition number of the two-column correlation matrix."""
    r = F.abs(F.corr(a, b))
    return rows.agg(F.try_divide(1 + r, 1 - r).alias("condition"))


def masked_parity(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], allowed: dict[str, Column], tolerance: float = 0.0) -> DataFrame:
    """DQ-20: cell differences between two releases, less the changes a mask allows."""
    from .joins import frame_diff
    diff = frame_diff(left, right, keys, columns, tolerance)
    ok = reduce(lambda a, b: a | b, [(F.col("field") == c) & cond for c, cond in allowed.items()], F.lit(False))
    return diff.where(~ok)


def root_cause(rows: DataFrame, causes: dict[str, Column], other: str = "unexplained") -> DataFrame:
    """DQ-22: the first matching cause in order, so causes exclude each other."""
    out = F.lit(other)
    for name, cond in reversed(causes.items()):
        out = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return rows.withColumn("cause", out)


def readiness(rows: DataFrame, season: str, columns: list[str], forbidden: list[int], max_null: float) -> DataFrame:
    """DQ-23: rows and null shares per season and whether the season may be used."""
    nulls = [F.avg(F.col(c).isNull().cast("int")) for c in columns]
    out = rows.groupBy(season).agg(F.count("*").alias("rows"), F.greatest(*nulls, F.lit(0.0)).alias("worst_null"))
    return out.withColumn("status", F.when(F.col(season).isin(forbidden), "forbidden").when(F.col("worst_null") > max_null, "incomplete").otherwise("ready"))
