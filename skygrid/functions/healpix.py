"""Hierarchical equal-area pixels (NESTED numbering) as columns and as arrays.

The column forms are plain expressions: they run inside whole-stage code
generation, and ranges on the index column reach the parquet scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = 29
INDEX_COLUMN = "_healpix_29"
# Masks of the five-step bit interleave, with their shifts.
SPREAD = [
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
]
# Ring and longitude of the twelve base cells' lowest corners.
BASE_RING = [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]
BASE_PHI = [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]
# Fixed value: smallest distance across a margin cell of order 0, in arcseconds.
ORDER0_MINDIST_ARCSEC = 131922.67821378837


def _spread_col(v: Column) -> Column:
    """Bits of ``v`` moved to the even places: its binary digits read in base 4.
    (The masked shifts below would double the expression at every step.)"""
    return F.conv(F.bin(v), 4, 10).cast("long")


def ang2pix(order: int, ra: Column, dec: Column) -> Column:
    """Pixel of (ra, dec) in degrees at ``order``, as BIGINT."""
    ns = 1 << order
    last = F.lit(ns - 1).cast("long")
    z = F.sin(F.radians(dec))
    tt = F.pmod(ra, F.lit(360.0)) / 90.0
    up, side = F.lit(float(ns)) * (tt + 0.5), F.lit(0.75 * ns) * z
    jp, jm = F.floor(up - side).cast("long"), F.floor(up + side).cast("long")
    ifp, ifm = F.shiftright(jp, order), F.shiftright(jm, order)
    quarter = lambda c: c.bitwiseAND(F.lit(3).cast("long"))
    belt_face = F.when(ifp == ifm, quarter(ifp) + 4).when(ifp < ifm, quarter(ifp)).otherwise(quarter(ifm) + 8)
    belt_x, belt_y = jm.bitwiseAND(last), last - jp.bitwiseAND(last)
    n = F.least(F.lit(3).cast("long"), F.floor(tt).cast("long"))
    tp = tt - n
    t = F.lit(ns * 6.0**0.5) * F.sin(F.radians((F.lit(90.0) - F.abs(dec)) / 2))
    cp, cm = F.least(F.floor(tp * t).cast("long"), last), F.least(F.floor((F.lit(1.0) - tp) * t).cast("long"), last)
    north = dec > 0
    belt = F.abs(z) <= 2.0 / 3.0
    face = F.when(belt, belt_face).when(north, n).otherwise(n + 8)
    ix = F.when(belt, belt_x).when(north, last - cm).otherwise(cp)
    iy = F.when(belt, belt_y).when(north, last - cp).otherwise(cm)
    return F.shiftleft(face, 2 * order) + _spread_col(ix) + F.shiftleft(_spread_col(iy), 1)


def pix_at(index: Column, order: int, index_order: int = ORDER) -> Column:
    """Pixel at a coarser order."""
    return F.shiftright(index, 2 * (index_order - order))


def in_pixel(index: Column, order: int, pixel: int, index_order: int = ORDER) -> Column:
    lo, hi = pixel_range(order, pixel, index_order)
    return (index >= lo) & (index < hi)


def pixel_range(order: int, pixel: int, index_order: int = ORDER) -> tuple[int, int]:
    shift = 2 * (index_order - order)
    return pixel << shift, (pixel + 1) << shift


# ---- array twins -----------------------------------------------------------


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for shift, mask in SPREAD:
        v = (v | (v << shift)) & mask
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64) & SPREAD[-1][1]
    for (shift, _), mask in zip(reversed(SPREAD), [m for _, m in reversed(SPREAD[:-1])] + [0xFFFFFFFF]):
        v = (v | (v >> shift)) & mask
    return v


def ang2pix_np(order: int, ra, dec) -> np.ndarray:
    ra, dec = np.atleast_1d(np.asarray(ra, float)), np.atleast_1d(np.asarray(dec, float))
    ns = 1 << order
    z, tt = np.sin(np.radians(dec)), np.mod(ra, 360.0) / 90.0
    jp = np.floor(ns * (tt + 0.5) - 0.75 * ns * z).astype(np.int64)
    jm = np.floor(ns * (tt + 0.5) + 0.75 * ns * z).astype(np.int64)
    ifp, ifm = jp >> order, jm >> order
    face = np.where(ifp == ifm, (ifp & 3) + 4, np.where(ifp < ifm, ifp & 3, (ifm & 3) + 8))
    ix, iy = jm & (ns - 1), ns - 1 - (jp & (ns - 1))
    n = np.minimum(3, np.floor(tt).astype(np.int64))
    t = ns * np.sqrt(6.0) * np.sin(np.radians((90.0 - np.abs(dec)) / 2))
    cp = np.minimum(np.floor((tt - n) * t).astype(np.int64), ns - 1)
    cm = np.minimum(np.floor((1.0 - (tt - n)) * t).astype(np.int64), ns - 1)
    north, cap = dec > 0, np.abs(z) > 2.0 / 3.0
    face = np.where(cap, np.where(north, n, n + 8), face)
    ix = np.where(cap, np.where(north, ns - 1 - cm, cp), ix)
    iy = np.where(cap, np.where(north, ns - 1 - cp, cm), iy)
    return (face << (2 * order)) + _spread(ix) + (_spread(iy) << 1)


def face_xy(order: int, pixel):
    pixel = np.asarray(pixel, np.int64)
    inner = pixel & ((1 << (2 * order)) - 1)
    return pixel >> (2 * order), _gather(inner), _gather(inner >> 1)


def from_face(face, x, y):
    """(ra, dec) in degrees of the point (x, y) in [0, 1]^2 of base cells."""
    face = np.asarray(face)
    jr = np.asarray(BASE_RING)[face] - x - y
    nr = np.where(jr < 1, jr, np.where(jr > 3, 4 - jr, 1.0))
    z = np.where(jr < 1, 1 - nr * nr / 3, np.where(jr > 3, nr * nr / 3 - 1, (2 - jr) * 2 / 3))
    tmp = np.mod(np.asarray(BASE_PHI)[face] * nr + x - y, 8)
    phi = np.where(nr < 1e-15, 0.0, 45.0 * tmp / np.maximum(nr, 1e-15))
    return np.mod(phi, 360.0), np.degrees(np.arcsin(np.clip(z, -1, 1)))


def pix2ang_np(order: int, pixel):
    """(ra, dec) of pixel centres in degrees."""
    face, ix, iy = face_xy(order, pixel)
    ns = 1 << order
    return from_face(face, (ix + 0.5) / ns, (iy + 0.5) / ns)


def xyz_np(ra, dec) -> np.ndarray:
    r, d = np.radians(np.asarray(ra, float)), np.radians(np.asarray(dec, float))
    return np.stack([np.cos(d) * np.cos(r), np.cos(d) * np.sin(r), np.sin(d)], axis=-1)


def neighbour_cells(order: int, cells: np.ndarray) -> np.ndarray:
    """The cells that share an edge or a corner with each cell (with repeats,
    the cell itself included).

    Points in twelve directions close around each of the four corners are
    located; no table of base-cell neighbours is needed.
    """
    face, ix, iy = face_xy(order, cells)
    ns = 1 << order
    own = xyz_np(*from_face(face, (ix + 0.5) / ns, (iy + 0.5) / ns))
    out = []
    for dx, dy in ((0, 0), (0, 1), (1, 0), (1, 1)):
        corner = xyz_np(*from_face(face, (ix + dx) / ns, (iy + dy) / ns))
        along = corner - own
        across = np.cross(corner, along)
        for angle in (np.arange(12) + 0.37) * np.pi / 6:
            p = corner + 0.05 * (np.cos(angle) * along + np.sin(angle) * across)
            p /= np.linalg.norm(p, axis=1, keepdims=True)
            out.append(ang2pix_np(order, np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(p[:, 2]))))
    return np.stack(out, axis=1)


def margin_cells(order: int, pixel: int, margin_order: int) -> np.ndarray:
    """Cells of ``margin_order`` that touch the pixel's edge from outside."""
    if margin_order <= order:
        raise ValueError("margin order must be higher than the pixel's order")
    k = 1 << (margin_order - order)
    i = np.arange(k)
    x, y = np.r_[i, i, np.zeros(k, int), np.full(k, k - 1)], np.r_[np.zeros(k, int), np.full(k, k - 1), i, i]
    inner = (pixel << (2 * (margin_order - order))) + _spread(x) + (_spread(y) << 1)
    cells = np.unique(neighbour_cells(margin_order, inner))
    return cells[cells >> (2 * (margin_order - order)) != pixel]


def order2mindist(order: int) -> float:
    return ORDER0_MINDIST_ARCSEC / 2**order


def margin2order(threshold_arcsec: float) -> int:
    """The highest order whose cells are at least the threshold wide."""
    k = 0
    while k < ORDER and order2mindist(k + 1) >= threshold_arcsec:
        k += 1
    return k
