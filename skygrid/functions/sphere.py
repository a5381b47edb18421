"""Positions on the unit sphere as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_ra(ra: Column) -> Column:
    return F.pmod(ra, F.lit(360.0))


def xyz(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    r, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def chord_of_arcsec(arcsec: float) -> float:
    return 2 * math.sin(math.radians(arcsec / 3600.0) / 2)


def chord2arcsec(chord: Column) -> Column:
    return F.degrees(F.asin(F.least(chord / 2, F.lit(1.0))) * 2) * 3600.0


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance (haversine)."""
    a = F.pow(F.sin(F.radians(dec1 - dec2) / 2), 2)
    b = F.pow(F.sin(F.radians(ra1 - ra2) / 2), 2) * F.cos(F.radians(dec1)) * F.cos(F.radians(dec2))
    return F.degrees(F.asin(F.sqrt(F.least(a + b, F.lit(1.0)))) * 2) * 3600.0
