"""Spatial, pixel and id searches.

A search has a coverage (index ranges, which select partitions and reach the
scan as a predicate) and an exact row condition. Both are column expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.healpix import ang2pix_np, xyz_np
from ..plans.moc import Moc
from ..plans.pixels import HealpixPixel


class AbstractSearch:
    """Subclass with ``coverage`` (a Moc, or None for everything) and
    ``condition``; or override ``search_points`` to filter pandas frames."""

    def __init__(self, fine: bool = True):
        self.fine = fine

    def coverage(self) -> Moc | None:
        return None

    def condition(self, info) -> Column | None:
        return None

    def search_points(self, frame, info):
        raise NotImplementedError

    def select_pixels(self, pixels):
        m = self.coverage()
        return list(pixels) if m is None else [p for p in pixels if m.overlaps(*p)]

    def outline(self) -> tuple[np.ndarray, np.ndarray]:
        """(ra, dec) along the region's edge, closed."""
        raise NotImplementedError("this search has no outline")

    def plot(self, ax=None, **kwargs):
        """The outline on an all-sky axis; needs matplotlib."""
        ra, dec = self.outline()
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise ImportError("matplotlib is required for plotting") from e
        if ax is None:
            ax = plt.figure().add_subplot(projection="mollweide")
        ax.plot(np.radians((ra + 180) % 360 - 180), np.radians(dec), **{"marker": ".", "linestyle": "none", "markersize": 1, **kwargs})
        return ax.figure, ax


def _validate_dec(*values):
    for v in values:
        if not -90 <= v <= 90:
            raise ValueError("declination must be between -90 and 90")


def _radec(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.mod(np.degrees(np.arctan2(xyz[:, 1], xyz[:, 0])), 360), np.degrees(np.arctan2(xyz[:, 2], np.hypot(xyz[:, 0], xyz[:, 1])))


class ConeSearch(AbstractSearch):
    def __init__(self, ra: float, dec: float, radius_arcsec: float, fine: bool = True):
        super().__init__(fine)
        if radius_arcsec <= 0:
            raise ValueError("Cone radius must be positive")
        _validate_dec(dec)
        self.ra, self.dec, self.radius_arcsec = ra % 360, dec, radius_arcsec

    def coverage(self):
        centre, r = xyz_np(self.ra, self.dec), math.radians(min(180.0, self.radius_arcsec / 3600))
        return Moc.from_region(lambda c, rad: np.arccos(np.clip(c @ centre, -1, 1)) <= r + rad, 14)

    def outline(self):
        centre, r = xyz_np(self.ra, self.dec), math.radians(min(180.0, self.radius_arcsec / 3600))
        east = np.array([-math.sin(math.radians(self.ra)), math.cos(math.radians(self.ra)), 0.0])
        t = np.linspace(0, 2 * np.pi, 361)[:, None]
        return _radec(math.cos(r) * centre + math.sin(r) * (np.cos(t) * east + np.sin(t) * np.cross(centre, east)))

    def condition(self, info):
        d = sphere.separation_arcsec(F.col(f"`{info.ra_column}`"), F.col(f"`{info.dec_column}`"), F.lit(self.ra), F.lit(self.dec))
        return d <= self.radius_arcsec


class BoxSearch(AbstractSearch):
    def __init__(self, ra=None, dec=None, fine: bool = True):
        super().__init__(fine)
        for name, v in (("ra", ra), ("dec", dec)):
            if v is None or len(v) != 2:
                raise ValueError(f"{name} range must have exactly two values")
        _validate_dec(*dec)
        if dec[0] >= dec[1]:
            raise ValueError("dec range must be strictly ascending")
        a, b = ra[0] % 360, ra[1] % 360
        self.whole = a == b
        self.ra, self.dec = (a, b), tuple(dec)

    def coverage(self):
        (a, b), (lo, hi) = self.ra, self.dec
        width = 360.0 if self.whole else (b - a) % 360

        def touches(c, rad):
            ra, dec = np.degrees(np.arctan2(c[:, 1], c[:, 0])), np.degrees(np.arcsin(np.clip(c[:, 2], -1, 1)))
            pad = math.degrees(rad)
            near = (dec >= lo - pad) & (dec <= hi + pad)
            top = np.minimum(np.abs(dec) + pad, 90)
            grow = np.where(top >= 89.9, 360.0, pad / np.maximum(np.cos(np.radians(top)), 1e-9))
            return near & (np.mod(ra - a + grow, 360) <= width + 2 * grow) | near & (width + 2 * grow >= 360)

        return Moc.from_region(touches)

    def outline(self):
        (a, b), (lo, hi), t = self.ra, self.dec, np.linspace(0, 1, 91)
        width = 360.0 if self.whole else (b - a) % 360
        side, up = a + width * t, lo + (hi - lo) * t
        one = np.ones_like(t)
        ra = np.r_[side, one * (a + width), side[::-1], one * a]
        return np.mod(ra, 360), np.r_[one * lo, up, one * hi, up[::-1]]

    def condition(self, info):
        ra, dec = sphere.wrap_ra(F.col(f"`{info.ra_column}`")), F.col(f"`{info.dec_column}`")
        out = dec.between(*map(float, self.dec))
        if self.whole:
            return out
        a, b = map(float, self.ra)
        return out & (ra.between(a, b) if a < b else (ra >= a) | (ra <= b))


class PolygonSearch(AbstractSearch):
    """Convex spherical polygon with great-circle edges."""

    def __init__(self, vertices, fine: bool = True):
        super().__init__(fine)
        if len(vertices) < 3:
            raise ValueError("polygon must have a minimum of 3 vertices")
        for _, d in vertices:
            _validate_dec(d)
        self.vertices = [(r % 360, d) for r, d in vertices]
        if len(set(self.vertices)) != len(self.vertices):
            raise ValueError("polygon has duplicated vertices")
        v = xyz_np([r for r, _ in self.vertices], [d for _, d in self.vertices])
        n = np.cross(v, np.roll(v, -1, axis=0))
        size = np.linalg.norm(n, axis=1, keepdims=True)
        middle = v.sum(0)
        if (size < 1e-12).any() or np.linalg.norm(middle) < 1e-12:
            raise ValueError("polygon is degenerate")
        n = n / size
        if (n @ middle).sum() < 0:
            n = -n
        side = v @ n.T
        if abs(side).max() < 1e-9:
            raise ValueError("polygon is degenerate")
        if side.min() < -1e-9:
            raise ValueError("polygon must be convex")
        self.normals = n

    def coverage(self):
        return Moc.from_region(lambda c, rad: (c @ self.normals.T >= -math.sin(min(rad, math.pi / 2))).all(1))

    def outline(self):
        v = xyz_np([r for r, _ in self.vertices], [d for _, d in self.vertices])
        t = np.linspace(0, 1, 91)[:, None]
        return _radec(np.concatenate([(1 - t) * a + t * b for a, b in zip(v, np.roll(v, -1, axis=0))]))

    def condition(self, info):
        x, y, z = sphere.xyz(F.col(f"`{info.ra_column}`"), F.col(f"`{info.dec_column}`"))
        out = F.lit(True)
        for a, b, c in self.normals.tolist():
            out = out & (x * a + y * b + z * c >= 0)
        return out


class MOCSearch(AbstractSearch):
    def __init__(self, moc: Moc, fine: bool = True):
        super().__init__(fine)
        self.moc = moc

    def coverage(self):
        return self.moc

    def condition(self, info):
        if info.healpix_column is None:
            raise ValueError("a search by coverage needs the index column")
        return self.moc.contains(info.healpix_column, info.healpix_order)


class PixelSearch(AbstractSearch):
    def __init__(self, pixels, fine: bool = False):
        super().__init__(fine)
        if isinstance(pixels, tuple) and len(pixels) == 2 and all(isinstance(x, (int, np.integer)) for x in pixels):
            pixels = [pixels]
        if not isinstance(pixels, (list, tuple)) or not all(isinstance(p, tuple) and len(p) == 2 for p in pixels):
            raise ValueError("Unsupported input for PixelSearch")
        if not pixels:
            raise ValueError("Some pixels required for PixelSearch")
        self.pixels = [HealpixPixel(int(o), int(p)) for o, p in pixels]

    @classmethod
    def from_radec(cls, ra, dec, fine: bool = False) -> "PixelSearch":
        return cls([(29, int(p)) for p in ang2pix_np(29, ra, dec)], fine)

    def coverage(self):
        return Moc.from_pixels(self.pixels)

    def condition(self, info):
        return self.coverage().contains(info.healpix_column, info.healpix_order)


class OrderSearch(AbstractSearch):
    def __init__(self, min_order: int = 0, max_order: int | None = None):
        super().__init__(False)
        if max_order is not None and min_order > max_order:
            raise ValueError("The minimum order is higher than the maximum order")
        self.min_order, self.max_order = min_order, max_order

    def select_pixels(self, pixels):
        highest = max((p[0] for p in pixels), default=0)
        if self.min_order > highest:
            raise ValueError("The minimum order is higher than the catalog's maximum order")
        top = highest if self.max_order is None else self.max_order
        return [p for p in pixels if self.min_order <= p[0] <= top]


class IndexSearch(AbstractSearch):
    """Rows by the value of one or more fields (AND); at most one field may
    give a list of values."""

    def __init__(self, values: dict, index_catalogs: dict | None = None, fine: bool = True):
        super().__init__(fine)
        if not values:
            raise ValueError("No values specified for search.")
        lists = [k for k, v in values.items() if isinstance(v, (list, tuple, set, np.ndarray))]
        if len(lists) > 1:
            raise ValueError("Only one field may have a list of values")
        if any(not len(values[k]) for k in lists):
            raise ValueError("No values specified for search.")
        self.values = {k: list(v) if k in lists else [v] for k, v in values.items()}
        self.index_catalogs = index_catalogs or {}

    def condition(self, info):
        out = F.lit(True)
        for name, vals in self.values.items():
            base, _, sub = name.partition(".")
            c = _matches(base, sub, vals)
            out = out & F.coalesce(c, F.lit(False))
        return out


def _matches(base: str, sub: str, vals) -> Column:
    if not sub:
        return F.col(f"`{base}`").isin(vals)

    def hit(x):
        return x[sub].isin(vals)

    return F.exists(F.col(f"`{base}`"), hit)
