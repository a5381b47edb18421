"""Multi-order coverage as sorted disjoint index ranges at order 29."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.healpix import ORDER, pix2ang_np, pixel_range, xyz_np

MAX_RANGES = 200  # more are merged over the smallest gaps when used as a predicate


def in_set(expression: str, values) -> Column:
    """Whether a BIGINT expression has one of the values. Given as text: one
    parse, where a column object for each value takes a call each."""
    return F.expr(f"{expression} IN ({','.join(f'{v}L' for v in values)})")


class Moc:
    def __init__(self, ranges=()):
        r = sorted((int(a), int(b)) for a, b in ranges if a < b)
        merged: list[list[int]] = []
        for a, b in r:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.ranges = [tuple(x) for x in merged]

    @classmethod
    def from_cells(cls, order: int, cells: np.ndarray) -> "Moc":
        """Of sorted distinct cells of one order."""
        cells = np.asarray(cells, np.int64)
        new = np.flatnonzero(np.diff(cells) != 1) + 1
        shift, at = 2 * (ORDER - order), np.r_[0, new][: len(cells)]
        out = cls()
        out.ranges = list(zip((cells[at] << shift).tolist(), (cells[np.r_[new, len(cells)][: len(at)] - 1] + 1 << shift).tolist()))
        return out

    @classmethod
    def from_pixels(cls, pixels) -> "Moc":
        return cls(pixel_range(o, p) for o, p in pixels)

    @classmethod
    def from_region(cls, touches, max_order: int = 9, max_cells: int = 400) -> "Moc":
        """Cells for which ``touches(centres xyz, radius in radians)`` may hold,
        refined until ``max_cells`` or ``max_order``: a superset of the region."""
        order, cells = 0, np.arange(12)
        while True:
            centres = xyz_np(*pix2ang_np(order, cells))
            cells = cells[touches(centres, 1.1 / 2**order)]
            if order == max_order or len(cells) * 4 > max_cells:
                return cls.from_pixels((order, int(c)) for c in cells)
            order, cells = order + 1, (cells[:, None] * 4 + np.arange(4)).ravel()

    def union(self, other: "Moc") -> "Moc":
        return Moc([*self.ranges, *other.ranges])

    def intersection(self, other: "Moc") -> "Moc":
        out, i, j = [], 0, 0
        while i < len(self.ranges) and j < len(other.ranges):
            a, b = self.ranges[i], other.ranges[j]
            lo, hi = max(a[0], b[0]), min(a[1], b[1])
            if lo < hi:
                out.append((lo, hi))
            if a[1] < b[1]:
                i += 1
            else:
                j += 1
        return Moc(out)

    def overlaps(self, order: int, pixel: int) -> bool:
        lo, hi = pixel_range(order, pixel)
        at = np.searchsorted([r[1] for r in self.ranges], lo, side="right")
        return bool(at < len(self.ranges) and self.ranges[at][0] < hi)

    def degrade(self, order: int) -> "Moc":
        s = 2 * (ORDER - order)
        return Moc(((a >> s) << s, -(-b >> s) << s) for a, b in self.ranges)

    @property
    def sky_fraction(self) -> float:
        return sum(b - a for a, b in self.ranges) / (12 << (2 * ORDER))

    def cells(self, top: int = ORDER) -> dict[int, list[int]]:
        """The fewest pixels of orders up to ``top`` that make up the ranges
        (their ends rounded outwards there), by order."""
        s, out = 2 * (ORDER - top), {}
        for a, b in self.ranges:
            a, b = a >> s, -(-b >> s)
            while a < b:
                up = min(top, (a & -a).bit_length() - 1 >> 1 if a else top, (b - a).bit_length() - 1 >> 1)
                out.setdefault(top - up, []).append(a >> 2 * up)
                a += 1 << 2 * up
        return out

    def contains(self, index: str, index_order: int = ORDER) -> Column:
        """Exact membership of an index column. A few ranges are comparisons; many
        are sets of pixels, one lookup for each order in use, behind the few ranges
        that cover them (which reach the scan)."""
        s, column = 2 * (ORDER - index_order), F.col(f"`{index}`")
        if not self.ranges:
            return F.lit(False)
        if len(self.ranges) <= MAX_RANGES:
            out = None
            for a, b in self.ranges:
                lo, hi = a >> s, -(-b >> s)
                c = (column >= lo) & (column < hi)
                out = c if out is None else out | c
            return out
        coarse = self.simplified(MAX_RANGES // 4).contains(index, index_order)
        fine = None
        for order, pixels in sorted(self.cells(index_order).items()):
            c = in_set(f"shiftright(`{index}`, {2 * (index_order - order)})", pixels)
            fine = c if fine is None else fine | c
        return coarse & fine

    def simplified(self, most: int) -> "Moc":
        """At most ``most`` ranges covering these, closing the smallest gaps."""
        if len(self.ranges) <= most:
            return self
        gaps = np.array([b[0] - a[1] for a, b in zip(self.ranges, self.ranges[1:])])
        keep = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
        starts = [self.ranges[0][0], *(self.ranges[k + 1][0] for k in keep)]
        ends = [*(self.ranges[k][1] for k in keep), self.ranges[-1][1]]
        return Moc(zip(starts, ends))

    def __eq__(self, other):
        return isinstance(other, Moc) and self.ranges == other.ranges
