"""Concatenation of catalogs (UNION ALL by pixel) with its margin policy."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..functions.healpix import margin2order
from ..plans.pixels import sort_pixels
from .margin import margin_rows


def _union(a, b):
    for f in a.schema.fields:
        if f.name in b.columns and b.schema[f.name].dataType != f.dataType:
            raise TypeError(f"column {f.name} has type {f.dataType.simpleString()} on one side and {b.schema[f.name].dataType.simpleString()} on the other")
    return a.unionByName(b, allowMissingColumns=True)


def concat(left, right, ignore_empty_margins: bool = False):
    for name in ("ra_column", "dec_column"):
        x, y = getattr(left.info, name), getattr(right.info, name)
        if not x or x != y:
            raise ValueError(f"both catalogs need the same {name}")
    df = _union(left.df, right.df)
    pixels = sort_pixels({t[2] for t in left.tree.align(right.tree, "outer")})
    moc = left.moc.union(right.moc) if left.moc is not None and right.moc is not None else None
    lm, rm = left.margin, right.margin
    threshold = None
    if lm is not None and rm is not None:
        threshold = min(lm.info.margin_threshold, rm.info.margin_threshold)
    elif lm is not None or rm is not None:
        if ignore_empty_margins:
            threshold = (lm or rm).info.margin_threshold
        else:
            warnings.warn("One catalog has no margin; the result has none", UserWarning, stacklevel=3)
    out = left._with(df, pixels=pixels, moc=moc, margin=None)
    if threshold:
        order = margin2order(threshold)
        highest = max(p.order for p in pixels)
        if order > highest:
            rows = margin_rows(df.where(F.col(f"`{left.index_column}`").isNotNull()), left.index_column, pixels, order, left.info.healpix_order)
            base = lm or rm
            out.margin = base._with(rows, pixels=pixels, info=base.info.copy(margin_threshold=threshold))
    return out
