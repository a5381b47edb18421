"""Catalogs from data frames: index, adaptive partitions, coverage, margin."""

from __future__ import annotations

import re
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, MapCatalog, MarginCatalog
from ..functions.healpix import INDEX_COLUMN, ang2pix, pix_at
from ..operators.margin import margin_order_for, margin_rows
from ..plans.info import CatalogInfo
from ..plans.moc import Moc
from ..plans.pixels import adaptive_pixels

DEFAULT_PARTITION_BYTES = 1 << 30


def find_column(columns, name: str) -> str:
    found = [c for c in columns if re.fullmatch(name, c, re.IGNORECASE)]
    if len(found) != 1:
        raise ValueError(f"found {len(found)} possible {name} columns; pass {name}_column")
    return found[0]


def _active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    return spark if spark is not None else SparkSession.builder.getOrCreate()


def from_dataframe(df, *, ra_column=None, dec_column=None, lowest_order=0, highest_order=7, drop_empty_siblings=True, partition_rows=None, partition_bytes=None, margin_order=-1, margin_threshold=5.0, should_generate_moc=True, moc_max_order=10, use_pyarrow_types=True, schema=None, catalog_name="from_dataframe", catalog_type="object", **kwargs):
    """A catalog of a Spark or pandas frame.

    ``partition_rows`` or ``partition_bytes`` bounds a partition; its pixels come
    from a histogram at ``highest_order`` (at most 12 * 4^order counters).
    """
    for old in ("threshold",):
        if old in kwargs:
            raise ValueError(f"{old} is no longer accepted; use partition_rows")
    if catalog_type not in ("object", "source", "map"):
        raise ValueError("Cannot create catalog of this type")
    if partition_rows is not None and partition_bytes is not None:
        raise ValueError("Specify either partition_rows or partition_bytes, not both")
    if lowest_order > highest_order:
        raise ValueError("lowest_order is above highest_order")
    if isinstance(df, pd.DataFrame):
        frame = df.reset_index() if df.index.name else df.reset_index(drop=True)
        if len(frame) > 1_000_000 or frame.memory_usage(deep=True).sum() > DEFAULT_PARTITION_BYTES:
            warnings.warn("The frame is large; read it with Spark instead", RuntimeWarning, stacklevel=2)
        df = _active().createDataFrame(frame, schema=schema) if schema is not None else _active().createDataFrame(frame)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != INDEX_COLUMN])
    ra = ra_column or find_column(df.columns, "ra")
    dec = dec_column or find_column(df.columns, "dec")
    r, d = F.col(f"`{ra}`").cast("double"), F.col(f"`{dec}`").cast("double")
    # explode of one: predicates on the index then compare a computed value once,
    # where the optimizer would copy the whole formula into every comparison
    indexed = df.select(F.explode(F.array(ang2pix(29, r, d))).alias(INDEX_COLUMN), *[F.col(f"`{c}`") for c in df.columns])
    bad = r.isNull() | d.isNull() | F.isnan(r) | F.isnan(d)
    weight = F.count(F.lit(1))
    if partition_rows is None:
        total = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        partition_bytes = partition_bytes or DEFAULT_PARTITION_BYTES
    below = min(moc_max_order, 10) - highest_order
    # coverage up to three orders below the histogram comes with it: 64 bits to a pixel
    masked = should_generate_moc and catalog_type != "map" and 0 < below <= 3
    mask = F.expr(f"bit_or(shiftleft(1L, cast(shiftright(`{INDEX_COLUMN}`, {2 * (29 - highest_order - below)}) & {4**below - 1} as int)))") if masked else F.lit(0)
    tally = indexed.groupBy(F.when(~bad, pix_at(F.col(INDEX_COLUMN), highest_order)).alias("pixel")).agg(weight.alias("n"), mask.alias("mask")).collect()
    if any(x["pixel"] is None for x in tally):
        raise ValueError(f"NaN values found in {ra}/{dec} columns")
    rows = sum(x["n"] for x in tally)
    if partition_rows is None:
        partition_rows = max(1, int(partition_bytes * rows / max(total, 1)))
    pixels = adaptive_pixels({x["pixel"]: x["n"] for x in tally}, highest_order, lowest_order, partition_rows, drop_empty_siblings)
    info = CatalogInfo(catalog_name, catalog_type, ra, dec, total_rows=rows, extra=dict(kwargs))
    if catalog_type == "map":
        return MapCatalog(indexed, info, pixels)
    out = Catalog(indexed, info, pixels)
    if should_generate_moc:
        out.moc = covered_cells(tally, highest_order, below) if masked else out.coverage_moc(highest_order + below)
    ring = margin_order_for(margin_threshold, margin_order, max((p.order for p in pixels), default=0))
    if margin_threshold == 0 and margin_order < 0:
        out.margin = make_margin(out, None, 0.0)
    elif ring:
        out.margin = make_margin(out, *ring)
    return out


def covered_cells(tally, order: int, below: int) -> Moc:
    """Coverage from rows (pixel, mask of its cells ``below`` orders down)."""
    rows = sorted((r["pixel"], r["mask"]) for r in tally)
    pixels, masks = np.array([p for p, _ in rows], np.int64), np.array([m for _, m in rows], np.int64)
    bits = np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, cell = np.nonzero(bits[:, : 4**below])
    return Moc.from_cells(order + below, pixels[at] * 4**below + cell)


def make_margin(catalog: Catalog, order: int | None, threshold: float) -> MarginCatalog:
    if order is None:
        rows = catalog.df.where(F.lit(False)).withColumns({"__norder": F.lit(0), "__npix": F.lit(0).cast("long")})
    else:
        rows = margin_rows(catalog.df, catalog.index_column, catalog.tree.pixels, order, catalog.info.healpix_order)
    name = f"{catalog.name}_{int(threshold)}arcs"
    return MarginCatalog(rows, catalog.info.copy(catalog_name=name, catalog_type="margin", margin_threshold=threshold, primary_catalog=catalog.name, total_rows=None), catalog.tree.pixels)


def from_astropy(table, *, flatten_tensors: bool = False, **kwargs):
    """A catalog of a table object: anything with ``colnames`` and columns as
    arrays, or a dict of arrays. n-D columns become arrays (flat on request)."""
    names = list(getattr(table, "colnames", None) or table.keys())
    data = {}
    for n in names:
        a = np.asarray(table[n])
        if a.dtype.byteorder not in ("=", "|"):
            a = a.astype(a.dtype.newbyteorder("="))
        if a.ndim > 1:
            rows = a.reshape(len(a), -1) if flatten_tensors or a.ndim == 2 else a
            data[n] = [r.tolist() for r in rows]
        else:
            data[n] = a.astype(str) if a.dtype.kind in "SU" else a
    return from_dataframe(pd.DataFrame(data), **kwargs)
