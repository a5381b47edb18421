"""Partition pixels: order, overlap, adaptive merge, and the row's partition."""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.healpix import ORDER, pix_at, pixel_range
from .moc import in_set


class HealpixPixel(NamedTuple):
    order: int
    pixel: int

    def __str__(self):
        return f"Order: {self.order}, Pixel: {self.pixel}"


def sort_pixels(pixels) -> list[HealpixPixel]:
    return sorted((HealpixPixel(int(o), int(p)) for o, p in pixels), key=lambda x: (pixel_range(*x)[0], x.order))


class PixelTree:
    """Disjoint pixels in index order, with range lookup."""

    def __init__(self, pixels):
        self.pixels = sort_pixels(pixels)
        self.lows = [pixel_range(*p)[0] for p in self.pixels]

    def __len__(self):
        return len(self.pixels)

    def overlapping(self, order: int, pixel: int) -> list[HealpixPixel]:
        lo, hi = pixel_range(order, pixel)
        i = max(0, bisect_right(self.lows, lo) - 1)
        out = []
        while i < len(self.pixels) and self.lows[i] < hi:
            if pixel_range(*self.pixels[i])[1] > lo:
                out.append(self.pixels[i])
            i += 1
        return out

    def divisions(self) -> tuple[int, ...]:
        if not self.pixels:
            return ()
        return (*self.lows, pixel_range(*self.pixels[-1])[1])

    def align(self, other: "PixelTree", how: str = "inner") -> list[tuple]:
        """(left pixel or None, right pixel or None, aligned pixel): the finer
        of each overlapping pair; how: inner, left or outer (whole unmatched
        pixels are added)."""
        out, seen_right = [], set()
        for p in self.pixels:
            met = other.overlapping(*p)
            for q in met:
                seen_right.add(q)
                out.append((p, q, p if p.order >= q.order else q))
            if not met and how in ("left", "outer"):
                out.append((p, None, p))
        if how == "outer":
            out += [(None, q, q) for q in other.pixels if q not in seen_right]
        return sorted(out, key=lambda t: pixel_range(*t[2])[0])


def partition_of(df: DataFrame, index: str, pixels, index_order: int = ORDER) -> tuple[Column, Column]:
    """(norder, npix) of the partition that a row's index falls in; null where
    it falls in none. One set lookup for each order in use."""
    by: dict[int, list[int]] = {}
    for o, p in pixels:
        by.setdefault(o, []).append(p)
    col = F.col(f"`{index}`")
    norder, npix = F.lit(None).cast("int"), F.lit(None).cast("long")
    for o, ps in sorted(by.items(), reverse=True):
        inside = in_set(f"shiftright(`{index}`, {2 * (index_order - o)})", ps)
        norder = F.when(inside, F.lit(o)).otherwise(norder)
        npix = F.when(inside, pix_at(col, o, index_order)).otherwise(npix)
    return norder, npix


def adaptive_pixels(histogram: dict[int, int], highest: int, lowest: int, threshold: int, drop_empty_siblings: bool = True) -> list[HealpixPixel]:
    """Partitions from a histogram at order ``highest``: neighbouring siblings
    merge upward while their sum stays within the threshold.

    With ``drop_empty_siblings`` a lone non-empty child stays at its own order
    as long as its parent holds nothing else.
    """
    level = {p: n for p, n in histogram.items() if n}
    done: list[HealpixPixel] = []
    order = highest
    closed: set[int] = set()  # parents that hold a finished pixel
    while order > lowest:
        groups: dict[int, list[int]] = {}
        for p in level:
            groups.setdefault(p >> 2, []).append(p)
        up: dict[int, int] = {}
        parents_closed = {c >> 2 for c in closed}
        for parent, kids in groups.items():
            total = sum(level[k] for k in kids)
            if total > threshold or parent in parents_closed:
                done += [HealpixPixel(order, k) for k in kids]
                parents_closed.add(parent)
            else:
                up[parent] = total
        level, closed, order = up, parents_closed, order - 1
    done += [HealpixPixel(order, p) for p in level]
    if drop_empty_siblings:
        done = [_shrunk(p, histogram, highest) for p in done]
    return sort_pixels(done)


def _shrunk(p: HealpixPixel, histogram: dict[int, int], highest: int) -> HealpixPixel:
    """The pixel itself; if all its rows lie in one child at the next orders,
    that child, so that empty siblings get no partition."""
    while p.order < highest and p.order > 0:
        s = 2 * (highest - p.order - 1)
        kids = {c >> s for c, n in histogram.items() if n and (c >> (s + 2)) == p.pixel}
        if len(kids) != 1:
            break
        p = HealpixPixel(p.order + 1, kids.pop())
        break
    return p
