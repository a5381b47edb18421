"""Catalogs: a DataFrame with an index column plus driver-side metadata.

Every operator is lazy and returns a new catalog, except ``compute``, ``head``,
``tail``, ``sample``, ``random_sample``, ``prune_empty_partitions`` and writing.
"""

from __future__ import annotations

import inspect
import logging
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .functions.healpix import INDEX_COLUMN, ORDER, pix_at, pixel_range
from .operators import concat as concat_ops
from .operators import joins as join_ops
from .operators import statistics as stats_ops
from .operators import udf as udf_ops
from .operators.crossmatch import DISTANCE, LARGE, MANY, AbstractCrossmatchAlgorithm, KdTreeCrossmatch, neighbours, within_radius
from .operators.search import (
    AbstractSearch,
    BoxSearch,
    ConeSearch,
    IndexSearch,
    MOCSearch,
    OrderSearch,
    PixelSearch,
    PolygonSearch,
)
from .plans.expr import is_nested, translate
from .plans.info import CatalogInfo
from .plans.moc import Moc, in_set
from .plans.pixels import HealpixPixel, PixelTree, partition_of, sort_pixels

log = logging.getLogger(__name__)
MARGIN_KEYS = ("__norder", "__npix")


def q(name: str) -> Column:
    return F.col(f"`{name}`")


class PartitionIndexer:
    def __init__(self, catalog):
        self.catalog = catalog

    def __getitem__(self, item):
        pixels = self.catalog.get_ordered_healpix_pixels()
        if isinstance(item, tuple) and len(item) == 2 and not isinstance(item, slice):
            item = HealpixPixel(*item)
            if item not in pixels:
                raise ValueError(f"Pixel {item} is not in the catalog")
            chosen = [item]
        elif isinstance(item, int):
            chosen = [pixels[item]]
        elif isinstance(item, slice):
            chosen = pixels[item]
        else:
            chosen = [pixels[i] if isinstance(i, int) else HealpixPixel(*i) for i in item]
        return self.catalog._only_pixels(chosen)

    def __iter__(self):
        for p in self.catalog.get_ordered_healpix_pixels():
            yield self.catalog._only_pixels([p])

    def __len__(self):
        return self.catalog.npartitions


class Stored:
    """How a dataset came from its files: what opens those of given pixels, and
    the functions applied since. A search opens the files again, those it needs."""

    def __init__(self, opened, steps=(), statistics: str | None = None):
        """``statistics``: the table of the stored rows' statistics by pixel."""
        self.opened, self.steps, self.statistics = opened, tuple(steps), statistics

    def then(self, fn) -> Stored:
        return Stored(self.opened, (*self.steps, fn), self.statistics)

    def frame(self, pixels) -> DataFrame:
        df = self.opened(pixels)
        for fn in self.steps:
            df = fn(df)
        return df

    def only(self, pixels) -> Stored:
        kept = set(pixels)
        return Stored(lambda asked: self.opened([p for p in asked if p in kept]), self.steps, self.statistics)


class HealpixDataset:
    """Base of all datasets: ``df``, ``info``, pixels and coverage."""

    def __init__(self, df: DataFrame | None, info: CatalogInfo, pixels, moc: Moc | None = None, original_schema: StructType | None = None, stats_preserved: bool = True, stored: Stored | None = None):
        """``df`` may be left out for a stored dataset: its files are looked at
        when rows are first asked for."""
        self._df, self.info, self.stored = df, info, stored
        self.tree = PixelTree(pixels)
        self.moc = moc
        self.original_schema = original_schema or df.schema
        self.stats_preserved = stats_preserved

    # -- metadata ------------------------------------------------------------
    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.stored.frame(self.tree.pixels)
        return self._df

    @property
    def schema(self) -> StructType:
        return self._shape().schema

    def _shape(self) -> DataFrame:
        """A frame of the same columns, which opens no data file."""
        return self._df if self._df is not None else self.stored.frame([])

    @property
    def spark(self):
        return self._shape().sparkSession

    @property
    def name(self):
        return self.info.catalog_name

    @property
    def columns(self):
        return [c for c in self.schema.names if c != self.info.healpix_column]

    @property
    def dtypes(self):
        return dict(self._shape().dtypes)

    @property
    def all_columns(self):
        return [c for c in self.original_schema.names if c != self.info.healpix_column]

    @property
    def nested_columns(self):
        return [f.name for f in self.schema.fields if is_nested(f.dataType)]

    @property
    def exploded_columns(self):
        return self.columns + [f"{f.name}.{s.name}" for f in self.schema.fields if is_nested(f.dataType) for s in f.dataType.elementType.fields]

    @property
    def npartitions(self):
        return len(self.tree)

    @property
    def partitions(self):
        return PartitionIndexer(self)

    def get_healpix_pixels(self):
        return list(self.tree.pixels)

    def get_ordered_healpix_pixels(self):
        return list(self.tree.pixels)

    def divisions(self):
        return self.tree.divisions()

    def __len__(self):
        if self.info.total_rows is None:
            raise ValueError("The number of rows is not known; use count()")
        return self.info.total_rows

    def __bool__(self):
        return True

    def count(self) -> int:
        return self.df.count()

    @property
    def iloc(self):
        raise NotImplementedError("Access by position is not supported; use head, sample or id_search")

    loc = iloc

    @property
    def index_column(self):
        return self.info.healpix_column or INDEX_COLUMN

    def _partition(self):
        return partition_of(self.df, self.index_column, self.tree.pixels, self.info.healpix_order)

    def _with(self, df=None, *, pixels=None, info=None, moc="same", modified=True, stored=None, **extra):
        info = info or self.info
        if modified:
            info = info.copy(total_rows=None)
        same = df is None and stored is None
        out = type(self)(
            self._df if same else df,
            info,
            self.tree.pixels if pixels is None else pixels,
            self.moc if moc == "same" else moc,
            original_schema=self.original_schema,
            stats_preserved=self.stats_preserved and not modified,
            stored=self.stored if same else stored,
            **extra,
        )
        return out

    def _apply(self, fn, **kw):
        """This dataset with a DataFrame function applied. A stored one notes it,
        and tries it on no rows, so that mistakes show at once."""
        if self.stored is None:
            return self._with(fn(self.df), **kw)
        stored = self.stored.then(fn)
        stored.frame([])
        return self._with(stored=stored, **kw)

    def _each(self, fn, **kw):
        """Apply a DataFrame function to this dataset (and to a margin)."""
        return self._apply(fn, **kw)

    def _at_pixels(self, pixels):
        """This dataset with its rows in some of its pixels: their files where it
        was opened from files, else a condition on the index."""
        if len(pixels) == len(self.tree):
            return self
        if self.stored is not None:
            return self._with(pixels=pixels, stored=self.stored.only(pixels))
        return self._with(self._inside(self.df, pixels), pixels=pixels)

    def _inside(self, df, pixels):
        if self.index_column not in df.columns:
            return df
        return df.where(Moc.from_pixels(pixels).contains(self.index_column, self.info.healpix_order))

    def _check_columns(self, names):
        schema = self.schema
        for n in names:
            base, _, sub = n.partition(".")
            if n in schema.names:
                continue
            if sub and base in self.nested_columns and sub in schema[base].dataType.elementType.names:
                continue
            if n in self.original_schema.names:
                raise ValueError(f"Column {n} is in the catalog but was not loaded; pass it in columns= when opening")
            raise KeyError(n)

    # -- projection and filters ----------------------------------------------
    def __getitem__(self, item):
        if isinstance(item, str):
            self._check_columns([item])
            return q(item) if item in self.schema.names else F.col(f"`{item.split('.')[0]}`")[item.split(".", 1)[1]]
        if isinstance(item, Column):
            return self._each(lambda d: d.where(item))
        return self._project(list(item))

    def _project(self, names):
        self._check_columns(names)
        subs: dict[str, list[str]] = {}
        out: list = []
        present = set(self.schema.names)
        for n in names:
            base, _, sub = n.partition(".")
            if n in present:
                out.append(n)
            else:
                if base not in subs:
                    out.append(("nested", base))
                subs.setdefault(base, []).append(sub)

        def run(df):
            cols = [q(c) for c in (self.index_column, *MARGIN_KEYS) if c in df.columns and c not in names]
            for n in out:
                if isinstance(n, tuple):
                    cols.append(_sub_struct(n[1], subs[n[1]]))
                else:
                    cols.append(q(n))
            return df.select(*cols)

        return self._each(run, modified=False)

    def query(self, expr: str):
        condition, nested = translate(expr, self.schema)
        if nested is None:
            return self._each(lambda d: d.where(condition))

        def run(d):
            kept = F.filter(q(nested), condition)
            return d.withColumn(nested, F.when(F.size(kept) > 0, kept))

        return self._each(run)

    def drop(self, columns, errors: str = "raise"):
        names = [columns] if isinstance(columns, str) else list(columns)
        missing = [n for n in names if n not in self.columns]
        if missing and errors == "raise":
            raise KeyError(f"{missing} not found in columns")
        keep = [n for n in names if n not in missing]
        return self._each(lambda d: d.select(*[q(c) for c in d.columns if c not in keep]))

    def rename(self, columns):
        fn = columns if callable(columns) else lambda c: columns.get(c, c)
        names = {c: fn(c) for c in self.columns}
        info = self.info.copy(ra_column=names.get(self.info.ra_column, self.info.ra_column), dec_column=names.get(self.info.dec_column, self.info.dec_column))
        return self._each(lambda d: d.select(*[q(c).alias(names.get(c, c)) for c in d.columns]), info=info)

    def rename_catalog(self, name: str):
        return self._with(info=self.info.copy(catalog_name=name), modified=False)

    # -- searches ------------------------------------------------------------
    def search(self, search: AbstractSearch):
        pixels = search.select_pixels(self.tree.pixels)
        cover = search.coverage()
        info = self.info
        few = cover.simplified(100) if cover is not None else None

        def run(d):
            if few is not None and self.index_column in d.columns:
                d = d.where(few.contains(self.index_column, info.healpix_order))
            condition = search.condition(info)
            if condition is not None:
                d = d.where(condition)
            elif type(search).search_points is not AbstractSearch.search_points:
                d = udf_ops.filter_frames(d, lambda f: search.search_points(f, info))
            return d

        moc = self.moc
        if cover is not None:
            base = self.moc or Moc.from_pixels(self.tree.pixels)
            moc = base.intersection(cover if search.fine else Moc.from_pixels(pixels))
        cut = self._at_pixels(pixels)
        return cut._each(run, moc=moc) if search.fine else cut._with(moc=moc)

    def cone_search(self, ra, dec, radius_arcsec, fine=True):
        return self.search(ConeSearch(ra, dec, radius_arcsec, fine))

    def box_search(self, ra=None, dec=None, fine=True):
        return self.search(BoxSearch(ra, dec, fine))

    def polygon_search(self, vertices, fine=True):
        return self.search(PolygonSearch(vertices, fine))

    def moc_search(self, moc, fine=True):
        return self.search(MOCSearch(moc, fine))

    def pixel_search(self, pixels, fine=False):
        return self.search(PixelSearch(pixels, fine))

    def order_search(self, min_order=0, max_order=None):
        return self.search(OrderSearch(min_order, max_order))

    # -- partitions ----------------------------------------------------------
    def _only_pixels(self, pixels):
        return self._at_pixels(sort_pixels(pixels))

    def get_partition(self, order: int, pixel: int):
        p = HealpixPixel(order, pixel)
        if p not in self.tree.pixels:
            raise ValueError(f"Pixel at order {order} pixel {pixel} not in Catalog")
        return self._only_pixels([p])

    def prune_empty_partitions(self):
        warnings.warn("Pruning empty partitions counts all rows", RuntimeWarning, stacklevel=2)
        norder, npix = self._partition()
        rows = self.df.select(norder.alias("o"), npix.alias("p")).where("o is not null").distinct().collect()
        return self._with(pixels=[(r["o"], r["p"]) for r in rows])

    def to_delayed(self):
        return [self._only_pixels([p]).df for p in self.get_ordered_healpix_pixels()]

    def to_spark(self) -> DataFrame:
        return self.df

    to_dask_dataframe = to_spark

    # -- statistics ----------------------------------------------------------
    def _stat_columns(self, use_default_columns, exclude_hats_columns, exclude_columns, include_columns, only_numeric=False):
        exclude = set(exclude_columns or ())
        if exclude_hats_columns:
            exclude |= {self.index_column, "Norder", "Dir", "Npix"}
        include = include_columns
        if include is None and use_default_columns and self.info.default_columns:
            include = list(self.info.default_columns)
        return stats_ops.usable(self._shape(), only_numeric, include, exclude)

    def _warn_modified(self, warn):
        if warn and not self.stats_preserved:
            warnings.warn("The catalog has been modified; statistics are computed from its present rows", UserWarning, stacklevel=3)

    def _written_statistics(self, columns, pixels) -> DataFrame | None:
        """The statistics written with the catalog, of its pixels or some of them;
        None where rows have been dropped or changed since, or a column has none."""
        if not self.stats_preserved or self.stored is None or self.stored.statistics is None:
            return None
        table = self.spark.read.parquet(self.stored.statistics)
        names = [f"{c}: {s}" for c in columns for s in stats_ops.STATS]
        if not set(names) <= set(table.columns):
            return None
        keep = MarginCatalog._inside(self, table.withColumnsRenamed({"norder": "__norder", "npix": "__npix"}), pixels)
        return keep.select(F.col("__norder").alias("norder"), F.col("__npix").alias("npix"), *[q(n) for n in names])

    def aggregate_column_statistics(self, use_default_columns=True, exclude_hats_columns=True, exclude_columns=None, include_columns=None, include_pixels=None, warn_on_modified_catalog=True) -> DataFrame:
        self._warn_modified(warn_on_modified_catalog)
        cols = self._stat_columns(use_default_columns, exclude_hats_columns, exclude_columns, include_columns)
        written = self._written_statistics(cols, self.tree.pixels if include_pixels is None else include_pixels)
        if written is not None:
            return stats_ops.combined(written, cols)
        df = self.df if include_pixels is None else self._only_pixels(include_pixels).df
        return stats_ops.column_statistics(df, cols)

    def per_partition_statistics(self, use_default_columns=True, exclude_hats_columns=True, exclude_columns=None, include_columns=None, only_numeric_columns=False, include_stats=None, include_pixels=None, warn_on_modified_catalog=True) -> DataFrame:
        self._warn_modified(warn_on_modified_catalog)
        cols = self._stat_columns(use_default_columns, exclude_hats_columns, exclude_columns, include_columns, only_numeric_columns)
        out = self._written_statistics(cols, self.tree.pixels if include_pixels is None else include_pixels)
        if out is None:
            cat = self if include_pixels is None else self._only_pixels(include_pixels)
            out = stats_ops.partition_statistics(cat.df, *cat._partition(), cols)
        if include_stats is not None:
            out = out.select("norder", "npix", *[q(f"{c}: {s}") for c in cols for s in include_stats])
        return out

    def per_pixel_statistics(self, *args, **kwargs):
        warnings.warn("per_pixel_statistics is now per_partition_statistics", DeprecationWarning, stacklevel=2)
        return self.per_partition_statistics(*args, **kwargs)

    def pixel_histogram(self, order: int) -> DataFrame:
        return self.df.groupBy(pix_at(q(self.index_column), order, self.info.healpix_order).alias("pixel")).agg(F.count(F.lit(1)).alias("n_rows"))

    def coverage_moc(self, max_order: int = 10) -> Moc:
        """Coverage of the rows themselves; at most 12 * 4^order cells."""
        cell = pix_at(q(self.index_column), max_order, self.info.healpix_order)
        cells = self.df.select(cell.alias("c")).where("c is not null").distinct().toArrow()["c"].to_numpy()  # 8 bytes a cell
        return Moc.from_cells(max_order, np.sort(cells))

    def est_size(self) -> float:
        """Estimated size in KiB, from the plan's statistics."""
        return float(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1024

    def estimate_size(self) -> str:
        text = f"{len(self.columns)} columns, {self.npartitions} partitions, {self.info.total_rows if self.info.total_rows is not None else 'unknown'} rows, about {self.est_size():.1f} KiB"
        print(text)
        return text

    # -- eager ---------------------------------------------------------------
    def _order_keys(self, order: int | None = None):
        """Sort keys: the index, or its pixel at ``order``, then the columns."""
        rest = [q(f.name) for f in self.df.schema.fields if f.name != self.index_column and f.dataType.typeName() not in ("map", "array", "struct")]
        place = q(self.index_column) if order is None else pix_at(q(self.index_column), order, self.info.healpix_order)
        return ([place] if self.index_column in self.df.columns else []) + rest

    def compute(self, order: int | None = None) -> pd.DataFrame:
        return self.df.orderBy(*self._order_keys(order)).toPandas()

    def _from_end(self, n: int, last: bool) -> pd.DataFrame:
        """The first (or last) rows by index. Files are visited from that end, a
        pixel at first, then twice as many each time."""
        pixels = self.tree.pixels[::-1] if last else self.tree.pixels
        count = 1 if self.stored is not None and self.index_column in self.df.columns else len(pixels)
        while True:
            part = self if count >= len(pixels) else self._only_pixels(pixels[:count])
            got = part.df.orderBy(*[k.desc() if last else k for k in self._order_keys()]).limit(n).toPandas()
            if len(got) == n or count >= len(pixels):
                return got
            count *= 2

    def head(self, n: int = 5) -> pd.DataFrame:
        return self._from_end(n, False)

    def tail(self, n: int = 5) -> pd.DataFrame:
        return self._from_end(n, True).iloc[::-1].reset_index(drop=True)

    def sample(self, partition_id: int, n: int = 5, seed: int | None = None) -> pd.DataFrame:
        if not 0 <= partition_id < self.npartitions:
            raise IndexError(f"{partition_id} is out of range [0, {self.npartitions})")
        return self.partitions[partition_id].random_sample(n, seed)

    def random_sample(self, n: int = 5, seed: int | None = None) -> pd.DataFrame:
        key = F.rand(seed) if seed is None else F.xxhash64(F.lit(seed), *self._order_keys())
        return self.df.orderBy(key, *self._order_keys()).limit(n).toPandas()

    # -- nested and row functions ---------------------------------------------
    def nest_lists(self, base_columns=None, list_columns=None, name: str = "nested"):
        lists = [f.name for f in self.df.schema.fields if isinstance(f.dataType, ArrayType) and not is_nested(f.dataType)]
        if list_columns is None:
            list_columns = [c for c in lists if base_columns is None or c not in base_columns]
        bad = [c for c in list_columns if c not in lists]
        if bad:
            raise TypeError(f"columns {bad} are not lists")
        if not list_columns:
            raise ValueError("No list columns to nest")
        base = [c for c in self.columns if c not in list_columns] if base_columns is None else list(base_columns)
        zipped = F.arrays_zip(*[q(c).alias(c) for c in list_columns]).alias(name)
        return self._each(lambda d: d.select(*[q(c) for c in (self.index_column, *MARGIN_KEYS) if c in d.columns and c not in base], *[q(c) for c in base], zipped))

    def map_rows(self, func, columns=None, *, meta, row_container="dict", output_names=None, infer_nesting=True, append_columns=False, **kwargs):
        names = list(columns) if columns is not None else self.exploded_columns
        self._check_columns(names)
        schema, packer = udf_ops.row_schema(meta, output_names, infer_nesting)
        if append_columns:
            clash = [f.name for f in schema.fields if f.name in self.df.columns]
            if clash:
                raise ValueError(f"output columns {clash} already exist")
        keep = self.df.columns if append_columns else ([self.index_column] if self.index_column in self.df.columns else [])
        info = self.info
        if not append_columns and not {info.ra_column, info.dec_column} <= set(schema.names):
            info = info.copy(ra_column=None, dec_column=None)
        return self._each(lambda d: udf_ops.map_rows(d, func, names, [*keep, *(c for c in MARGIN_KEYS if c in d.columns)], schema, packer, row_container, kwargs), info=info)

    def map_partitions(self, func, *args, meta=None, include_pixel=False, compute_single_partition=False, partition_index=None, **kwargs):
        pixels = self.get_ordered_healpix_pixels()
        if compute_single_partition:
            i = 0 if partition_index is None else partition_index
            p = pixels[i] if isinstance(i, int) else HealpixPixel(*i)
            frame = self._only_pixels([p]).df.toPandas()
            return func(frame, *([p] if include_pixel else []), *args, **kwargs)
        schema = udf_ops.infer_schema(func, self.df.schema, meta, args, kwargs, include_pixel)
        out = self._each(lambda d: udf_ops.map_partitions(d, self._partition_on(d), func, args, kwargs, schema, include_pixel))
        return out

    def _partition_on(self, df):
        return partition_of(df, self.index_column, self.tree.pixels, self.info.healpix_order)

    def write_catalog(self, path: str, **kw):
        from .sources.writer import write_dataset

        return write_dataset(self, path, **kw)

    def to_hats(self, path: str, **kw):
        warnings.warn("use write_catalog", DeprecationWarning, stacklevel=2)
        return self.write_catalog(path, **kw)

    def to_lance(self, path, table_name="data", overwrite=False, **kw):
        try:
            import lancedb
        except ImportError as e:
            raise ImportError("lancedb is required to write a Lance dataset") from e
        db = lancedb.connect(str(path))
        table = None
        for p in self.get_ordered_healpix_pixels():
            rows = self._only_pixels([p]).df.toArrow()
            if rows.num_rows and table is None:
                table = db.create_table(table_name, rows, mode="overwrite" if overwrite else "create")
            elif rows.num_rows:
                table.add(rows)
        return table

    def plot_pixels(self, *a, **k):
        return _plot(self, "pixels")

    def plot_coverage(self, *a, **k):
        return _plot(self, "coverage")

    # -- text ----------------------------------------------------------------
    def __repr__(self):
        rows = [str(p) for p in self.tree.pixels]
        if len(rows) > 3:
            rows = [rows[0], "...", *rows[-2:]]
        types = ", ".join(f"{n}: {t}" for n, t in self._shape().dtypes if n != self.index_column)
        return f"{type(self).__name__} {self.name}: npartitions={self.npartitions}\n" + "\n".join(rows) + f"\n{types}\n{len(self.columns)} of {len(self.all_columns)} columns loaded"

    def _repr_html_(self):
        import html

        return f"<pre>{html.escape(repr(self))}</pre>"


def _plot(cat, what):
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("matplotlib is required for plotting") from e
    from .functions.healpix import pix2ang_np

    ax = plt.figure().add_subplot(projection="mollweide")
    for p in cat.get_healpix_pixels():
        ra, dec = pix2ang_np(*p)
        ax.plot(((ra + 180) % 360 - 180) * 3.141592653589793 / 180, dec * 3.141592653589793 / 180, "s")
    return ax.figure, ax


def _sub_struct(base: str, subs) -> Column:
    def pick(x):
        return F.struct(*[x[s].alias(s) for s in subs])

    return F.transform(q(base), pick).alias(base)


class MarginCatalog(HealpixDataset):
    """Rows keyed by the receiving pixel in ``__norder`` and ``__npix``."""

    def _cut(self, pixels):
        """The rows that lie in the margin of these pixels; pixels of the empty
        sky, which only a margin has, go as well."""
        if self.stored is not None:
            held = set(self.tree.pixels)
            mine = [p for p in pixels if p in held]
            return self._with(pixels=mine, stored=self.stored.only(mine))
        return self._with(self._inside(self.df, pixels), pixels=[p for p in self.tree.pixels if p in set(pixels)])

    def _inside(self, df, pixels):
        by: dict[int, list[int]] = {}
        for o, p in pixels:
            by.setdefault(o, []).append(p)
        keep = F.lit(False)
        for o, ps in by.items():
            keep = keep | ((F.col("__norder") == o) & in_set("__npix", ps))
        return df.where(keep)

    def write_catalog(self, path: str, error_if_empty: bool = False, **kw):
        return super().write_catalog(path, error_if_empty=error_if_empty, **kw)


class AssociationCatalog(HealpixDataset):
    @property
    def max_separation(self):
        v = self.info.extra.get("assn_max_separation")
        return None if v in (None, "") else float(v)


class MapCatalog(HealpixDataset):
    pass


class Catalog(HealpixDataset):
    """A point catalog with an optional margin and optional id indexes."""

    def __init__(self, df, info, pixels, moc=None, original_schema=None, stats_preserved=True, margin: MarginCatalog | None = None, indexes: dict | None = None, stored: Stored | None = None):
        super().__init__(df, info, pixels, moc, original_schema, stats_preserved, stored)
        self.margin, self.indexes = margin, indexes or {}

    def _with(self, df=None, *, margin="same", **kw):
        return super()._with(df, margin=self.margin if margin == "same" else margin, indexes=self.indexes, **kw)

    def _each(self, fn, **kw):
        margin = self.margin
        if margin is not None:
            info = kw.get("info")
            new = margin.info if info is None else margin.info.copy(ra_column=info.ra_column, dec_column=info.dec_column)
            margin = margin._apply(fn, info=new)
            if not set(MARGIN_KEYS) <= set(margin.schema.names):
                margin = None
        return self._apply(fn, margin=margin, **kw)

    def _at_pixels(self, pixels):
        """The margin keeps what these pixels receive from the others."""
        out = super()._at_pixels(pixels)
        if self.margin is not None and out is not self:
            out.margin = self.margin._cut(pixels)
        return out

    def build_index(self, column: str) -> DataFrame:
        """An index catalog of this catalog: (value, Norder, Npix) of its rows."""
        self._check_columns([column])
        norder, npix = self._partition()
        base, _, sub = column.partition(".")
        value = q(column) if column in self.df.columns else F.explode(q(base)[sub])
        placed = self.df.withColumns({"Norder": norder, "Npix": npix}).select(value.alias(sub or base), "Norder", "Npix")
        return placed.where(q(sub or base).isNotNull()).distinct()

    def rename_catalog(self, name):
        out = super().rename_catalog(name)
        if out.margin is not None:
            out.margin = out.margin.rename_catalog(f"{name}_{int(out.margin.info.margin_threshold or 0)}arcs")
        return out

    def id_search(self, values: dict, index_catalogs: dict | None = None, fine: bool = True):
        """Rows by value, in the partitions that an index catalog of each field
        names (of the collection, or given; ``build_index`` makes one)."""
        known = {**self.indexes, **(index_catalogs or {})}
        missing = [k for k in values if k not in known]
        if missing:
            raise TypeError(f"no index catalog for {missing}")
        search = IndexSearch(values, known, fine)
        pixels = set(self.tree.pixels)
        for name, vals in search.values.items():
            idx = known[name]
            col = name.split(".")[-1] if name not in idx.columns else name
            hit = idx.where(q(col).isin(vals)).select("Norder", "Npix").distinct().collect()  # at most all partitions
            pixels &= {HealpixPixel(r["Norder"], r["Npix"]) for r in hit}
        log.info("id search reads %d partitions", len(pixels))
        cut = self._only_pixels(pixels)
        return cut._each(lambda d: d.where(search.condition(self.info))) if fine else cut

    # -- joins ---------------------------------------------------------------
    def crossmatch(self, other, *, n_neighbors=None, radius_arcsec=None, min_radius_arcsec=None, algorithm=None, output_catalog_name=None, require_right_margin=False, how="inner", suffixes=None, suffix_method=None, log_changes=True, scope="global"):
        if how not in ("inner", "left"):
            raise ValueError("how must be inner or left")
        if require_right_margin and getattr(other, "margin", None) is None:
            raise ValueError("Right catalog must have a margin cache")
        names = join_ops.suffixed(self, other, suffixes, suffix_method, log_changes)
        name = output_catalog_name or f"{self.name}_x_{other.name}"
        if isinstance(algorithm, AbstractCrossmatchAlgorithm) or (inspect.isclass(algorithm) and issubclass(algorithm, AbstractCrossmatchAlgorithm)):
            if any(v is not None for v in (n_neighbors, radius_arcsec, min_radius_arcsec)):
                raise ValueError("Give either an algorithm or its parameters, not both")
            algo = algorithm() if inspect.isclass(algorithm) else algorithm
            df = join_ops.custom_crossmatch(self, other, algo, names, how)
        else:
            df = self._match(other, algorithm, n_neighbors, radius_arcsec, min_radius_arcsec, how, names, scope)
            df = df.drop("__left_id")
        return self._joined(other, df, names, name, how)

    def _match(self, other, algorithm, n, r, rmin, how, names, scope):
        if algorithm is None:
            algorithm = KdTreeCrossmatch(1 if n is None else n, 1.0 if r is None else r, 0.0 if rmin is None else rmin)
        elif n is not None or r is not None or rmin is not None:
            raise ValueError("Give either an algorithm or its parameters, not both")
        m = getattr(other, "margin", None)
        if m is not None and m.info.margin_threshold is not None and m.info.margin_threshold < algorithm.radius_arcsec:
            raise ValueError("Cross match radius is greater than margin threshold")
        self._no_overlap(other)
        left, right = join_ops.renamed(self, names.left), join_ops.renamed(other, names.right)
        equal = None
        if scope == "partition":
            left, right, equal = join_ops.same_partition(left, right, self, other)
        rows = other.info.total_rows
        out = neighbours(
            left, right, (names.left[self.info.ra_column], names.left[self.info.dec_column]),
            (names.right[other.info.ra_column], names.right[other.info.dec_column]),
            algorithm.radius_arcsec, algorithm.min_radius_arcsec, algorithm.n_neighbors, how, equal,
            dense=within_radius(rows, other.tree.pixels, algorithm.radius_arcsec) > MANY, large=rows is None or rows > LARGE,
        )
        drop = [names.right[other.index_column]] if other.index_column in other.df.columns else []
        return out.drop(*drop, "__lp", "__rp")

    def _no_overlap(self, other):
        a, b = self.moc, other.moc
        if a is not None and b is not None and not len(self.tree) == 0 and not [1 for p in self.tree.pixels if other.tree.overlapping(*p)] and not a.intersection(b).ranges:
            raise RuntimeError("Catalogs do not overlap")

    def _joined(self, other, df, names, name, how="inner"):
        info = self.info.copy(catalog_name=name, ra_column=names.left.get(self.info.ra_column), dec_column=names.left.get(self.info.dec_column), default_columns=None, total_rows=None, catalog_type=min(self.info.catalog_type, other.info.catalog_type))
        pixels = [t[2] for t in self.tree.align(other.tree, "left" if how == "left" else "inner")] or self.tree.pixels
        return Catalog(df, info, sorted(set(pixels)), self.moc, stats_preserved=False)

    def crossmatch_nested(self, other, *, n_neighbors=None, radius_arcsec=None, min_radius_arcsec=None, algorithm=None, output_catalog_name=None, require_right_margin=False, nested_column_name=None, how="inner", log_changes=True):
        if how not in ("inner", "left"):
            raise ValueError("how must be inner or left")
        nested = nested_column_name or other.name
        names = join_ops.Names({c: c for c in self.df.columns}, {c: f"__r_{c}" for c in other.df.columns})
        pairs = self._match(other, algorithm, n_neighbors, radius_arcsec, min_radius_arcsec, how, names, "global")
        fields = [F.col(f"`__r_{c}`").alias(c) for c in other.columns] + [F.col(DISTANCE)]
        element = F.struct(F.col(DISTANCE).alias("__d"), F.struct(*fields).alias("v"))
        cells = F.transform(F.array_sort(F.collect_list(F.when(F.col(DISTANCE).isNotNull(), element))), lambda x: x["v"])
        grouped = pairs.groupBy("__left_id").agg(*[F.first(q(c)).alias(c) for c in self.df.columns], cells.alias(nested))
        grouped = grouped.withColumn(nested, F.when(F.size(q(nested)) > 0, q(nested))).drop("__left_id")
        return self._joined(other, grouped, names, output_catalog_name or f"{self.name}_x_{other.name}", how)

    def join(self, other, left_on=None, right_on=None, through: AssociationCatalog | None = None, suffixes=None, output_catalog_name=None, suffix_method=None, log_changes=True, scope="global"):
        names = join_ops.suffixed(self, other, suffixes, suffix_method, log_changes)
        name = output_catalog_name or f"{self.name}_x_{other.name}"
        if through is not None:
            df = join_ops.join_through(self, other, through, names)
        else:
            self._check_columns([left_on])
            other._check_columns([right_on])
            df = join_ops.join_on(self, other, left_on, right_on, names, scope)
        return self._joined(other, df, names, name)

    def join_nested(self, other, left_on, right_on, nested_column_name=None, output_catalog_name=None, how="inner"):
        if how not in ("inner", "left"):
            raise ValueError("how must be inner or left")
        self._check_columns([left_on])
        other._check_columns([right_on])
        names = join_ops.Names({c: c for c in self.df.columns}, {})
        df = join_ops.join_nested(self, other, left_on, right_on, nested_column_name or other.name, how)
        return self._joined(other, df, names, output_catalog_name or f"{self.name}_x_{other.name}", how)

    def merge_asof(self, other, direction="backward", suffixes=None, output_catalog_name=None, suffix_method=None, log_changes=True, scope="partition", order=None):
        names = join_ops.suffixed(self, other, suffixes, suffix_method, log_changes)
        df = join_ops.merge_asof(self, other, direction, names, scope, order)
        return self._joined(other, df, names, output_catalog_name or f"{self.name}_x_{other.name}")

    def merge_map(self, map_catalog, func, *args, meta=None, **kwargs):
        df = join_ops.merge_map(self, map_catalog, func, args, meta, kwargs)
        info = self.info
        if not {info.ra_column, info.dec_column} <= set(df.columns):
            info = info.copy(ra_column=None, dec_column=None)
        return Catalog(df, info.copy(total_rows=None), self.tree.pixels, self.moc, stats_preserved=False)

    def concat(self, other, *, ignore_empty_margins=False):
        return concat_ops.concat(self, other, ignore_empty_margins)

    def write_catalog(self, path: str, as_collection: bool = True, **kw):
        from .sources.writer import write_collection, write_dataset

        return write_collection(self, path, **kw) if as_collection else write_dataset(self, path, **kw)

    def to_association(self, path: str, **kw):
        from .sources.writer import write_association

        return write_association(self, path, **kw)

    def plot_points(self, most: int = 200_000, ax=None, **kwargs):
        """The rows' positions on an all-sky axis, ``most`` of them if there are
        more (those of smallest hash); needs matplotlib."""
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise ImportError("matplotlib is required for plotting") from e
        place = self.df.select(q(self.info.ra_column).cast("double").alias("ra"), q(self.info.dec_column).cast("double").alias("dec"))
        frame = place.orderBy(F.xxhash64("ra", "dec")).limit(most).toPandas()
        if ax is None:
            ax = plt.figure().add_subplot(projection="mollweide")
        ax.scatter(np.radians((frame.ra + 180) % 360 - 180), np.radians(frame.dec), **{"s": 1, **kwargs})
        return ax.figure, ax


def info_schema(df: DataFrame) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields])


__all__ = ["AssociationCatalog", "Catalog", "HealpixDataset", "MapCatalog", "MarginCatalog", "ORDER", "pixel_range"]
