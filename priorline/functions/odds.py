"""Prices, directions and settlement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD_PRICE = -110


def profit_per_unit(price: Column) -> Column:
    """FN-18: American price to profit per unit staked; a zero price is an error."""
    return (
        F.when(price.isNull(), F.lit(100.0 / 110.0))
        .when(price > 0, price / 100.0)
        .when(price < 0, 100.0 / F.abs(price))
        .otherwise(F.raise_error(F.lit("an American price cannot be zero")).cast("double"))
    )


def spread_direction(prediction: Column, line: Column) -> Column:
    """MK-2: the line is home-signed, so home is the side when prediction plus line is positive."""
    return F.when(prediction + line > 0, "home").when((prediction + line).isNotNull(), "away")


def total_direction(prediction: Column, line: Column) -> Column:
    """MK-2: over when the forecast is above the line."""
    return F.when(prediction > line, "over").when((prediction - line).isNotNull(), "under")


def settle(signed_margin: Column, profit: Column) -> Column:
    """MK-4: profit on a win, minus one on a loss, nothing on a push."""
    return F.when(signed_margin > 0, profit).when(signed_margin < 0, F.lit(-1.0)).when(
        signed_margin == 0, F.lit(0.0))


def outcome(signed_margin: Column) -> Column:
    return F.when(signed_margin > 0, "W").when(signed_margin < 0, "L").when(signed_margin == 0, "P")
