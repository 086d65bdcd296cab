"""Fail-closed guards. They are part of the plan: a broken contract stops the job that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not meet its contract."""


def require_empty(violations: DataFrame, message: str) -> None:
    """Stop if ``violations`` has any row; looks for one row only."""
    first = violations.limit(1).collect()
    if first:
        raise ContractError(f"{message}: {first[0].asDict()}")


def unless(bad: Column, value: Column, message: str) -> Column:
    """``value``, or a failing job where ``bad`` holds."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message))).otherwise(value)


def unique_lookup(df: DataFrame, keys: list[str], message: str = "duplicate lookup key") -> DataFrame:
    """One row per key; a key with several rows fails the job. Combines map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*(rest or keys))).alias("_row"))
    checked = grouped.withColumn("_row", unless(F.col("_n") > 1, F.col("_row"), message))
    return checked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def left_lookup(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Many-to-one left join: the right side must be unique on the keys."""
    return df.join(unique_lookup(lookup, keys), keys, "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """One-to-one join: both sides must be unique on the keys."""
    return unique_lookup(left, keys).join(unique_lookup(right, keys), keys, how)
