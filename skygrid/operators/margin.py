"""Margins: rows of other pixels within a ring of cells around each pixel."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.healpix import ORDER, face_xy, margin2order, neighbour_cells, order2mindist, pixel_range
from ..plans.pixels import HealpixPixel, sort_pixels
from .shipping import ship


def margin_order_for(threshold: float | None, order: int, highest: int) -> tuple[int, float] | None:
    """(margin order, threshold), or None for no margin."""
    if threshold is None and order < 0:
        return None
    if order < 0:
        if threshold < 0:
            raise ValueError("margin_threshold must be non-negative")
        if threshold == 0:
            return None
        order = margin2order(threshold)
    else:
        if threshold is not None:
            warnings.warn("Ignoring margin_threshold because margin_order was specified", RuntimeWarning, stacklevel=3)
        threshold = order2mindist(order)
    if order <= highest:
        raise ValueError("margin_order must be larger than the highest order of the catalog")
    return order, threshold


def empty_pixels(pixels) -> list[HealpixPixel]:
    """The fewest pixels that cover the sky outside the given disjoint ones."""
    taken = {HealpixPixel(*p) for p in pixels}
    above = {HealpixPixel(o, p >> (2 * (q_o - o))) for q_o, p in taken for o in range(q_o)}
    out, stack = [], [HealpixPixel(0, p) for p in range(12)]
    while stack:
        p = stack.pop()
        if p in taken:
            continue
        if p in above:
            stack += [HealpixPixel(p.order + 1, 4 * p.pixel + k) for k in range(4)]
        else:
            out.append(p)
    return out


def margin_rows(df: DataFrame, index: str, pixels, margin_order: int, index_order: int = ORDER) -> DataFrame:
    """``df`` rows repeated for every pixel whose ring they lie in, with columns
    ``__norder`` and ``__npix`` of the receiving pixel. Pixels of the empty sky
    receive rows as well.

    A row is in the ring of the pixels that its cell's neighbours belong to. Only
    rows in the outermost cells of their own pixel can have such neighbours; no
    list of ring cells is formed and nothing is shuffled.
    """
    ship(df.sparkSession)
    tree = sort_pixels([*map(lambda p: HealpixPixel(*p), pixels), *empty_pixels(pixels)])
    lows = np.array([pixel_range(*p)[0] for p in tree])
    orders, numbers = np.array([p.order for p in tree]), np.array([p.pixel for p in tree])
    at = df.columns.index(index)
    schema = StructType([*df.schema.fields, StructField("__norder", IntegerType()), StructField("__npix", LongType())])

    def run(batches):
        for b in batches:
            cell = b.column(at).to_numpy() >> (2 * (index_order - margin_order))
            find = lambda c: np.searchsorted(lows, c << (2 * (ORDER - margin_order)), side="right") - 1
            own = find(cell)
            _, ix, iy = face_xy(margin_order, cell)
            last = (1 << (margin_order - orders[own])) - 1
            x, y = ix & last, iy & last
            edge = np.flatnonzero((x == 0) | (y == 0) | (x == last) | (y == last))
            if not len(edge):
                continue
            met = find(neighbour_cells(margin_order, cell[edge]))
            row = np.repeat(edge, met.shape[1])
            pairs = np.unique(np.stack([row, met.ravel()]), axis=1)
            pairs = pairs[:, pairs[1] != own[pairs[0]]]
            out = b.take(pa.array(pairs[0]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(orders[pairs[1]].astype(np.int32)), pa.array(numbers[pairs[1]].astype(np.int64))], names=schema.names)

    return df.mapInArrow(run, schema)
