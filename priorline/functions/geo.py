"""Distance and clock offsets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_RADIUS_KM = 6371.0088
# The WGS 84 ellipsoid.
EQUATOR_KM = 6378.137
FLATTENING = 1 / 298.257223563
POLE_KM = EQUATOR_KM * (1 - FLATTENING)
ROUNDS, SETTLED = 40, 1e-12


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere of the mean radius; null where a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() skips nulls, so an unknown point has to be kept unknown
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def _arc(u1: np.ndarray, u2: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the auxiliary sphere: sine, cosine and angle between the points, sine and squared cosine of the azimuth at the equator, cosine of twice the middle."""
    flat, tilt = np.cos(u1) * np.cos(u2), np.sin(u1) * np.sin(u2)
    cos = tilt + flat * np.cos(lam)
    sin = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
    azimuth = np.where(sin == 0, 0.0, flat * np.sin(lam) / np.where(sin == 0, 1.0, sin))
    slant = 1 - azimuth * azimuth
    flat_arc = slant < 1e-15
    middle = np.where(flat_arc, 0.0, cos - 2 * tilt / np.where(flat_arc, 1.0, slant))
    return sin, cos, np.arctan2(sin, cos), azimuth, slant, middle


def _vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Distances of known points; NaN where the difference of longitudes does not settle."""
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    apart = np.radians(lon2 - lon1)
    apart = apart - 2 * math.pi * np.floor((apart + math.pi) / (2 * math.pi))
    lam, gap = apart.copy(), np.ones(len(apart))
    for _ in range(ROUNDS):
        todo = np.flatnonzero(gap > SETTLED)
        if not len(todo):
            break
        sin, cos, angle, azimuth, slant, middle = _arc(u1[todo], u2[todo], lam[todo])
        c = FLATTENING / 16 * slant * (4 + FLATTENING * (4 - 3 * slant))
        turned = apart[todo] + (1 - c) * FLATTENING * azimuth * (angle + c * sin * (middle + c * cos * (2 * middle * middle - 1)))
        gap[todo], lam[todo] = np.abs(turned - lam[todo]), turned
    sin, cos, angle, _, slant, middle = _arc(u1, u2, lam)
    u = slant * ((EQUATOR_KM / POLE_KM) ** 2 - 1)
    a = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
    b = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
    bend = b * sin * (middle + b / 4 * (cos * (2 * middle * middle - 1) - b / 6 * middle * (4 * sin * sin - 3) * (4 * middle * middle - 3)))
    return np.where(gap <= SETTLED, POLE_KM * a * (angle - bend), np.nan)


@F.pandas_udf(DoubleType())
def _ellipsoid_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    points = [c.to_numpy(dtype=float, na_value=np.nan) for c in (lat1, lon1, lat2, lon2)]
    known = np.flatnonzero(np.isfinite(np.stack(points)).all(axis=0))
    out = np.full(len(lat1), np.nan)
    if len(known):
        out[known] = _vincenty(*(p[known] for p in points))
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """FN-22: length of the shortest line on the WGS 84 ellipsoid, by Vincenty's inverse formula on the columns of an Arrow batch.

    The difference of longitudes on the auxiliary sphere is iterated until it settles.  Points nearly opposite to each other, for which it
    does not within ``ROUNDS`` rounds, get the great-circle distance, at most 0.6 percent off.  Null where a coordinate is.
    """
    km = _ellipsoid_km(*(c.cast("double") for c in (lat1, lon1, lat2, lon2)))
    return F.coalesce(km, great_circle_km(lat1, lon1, lat2, lon2))


def offset_hours(ts: Column, zone: Column | str) -> Column:
    """FN-23: hours a named zone is ahead of UTC at an instant."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return (F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - F.unix_timestamp(ts)) / 3600.0
