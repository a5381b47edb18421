"""Writing catalogs, margins, collections and associations.

One Spark job writes all pixel files (rows of a pixel meet in one task, sorted
by index, so row groups have tight index ranges); the driver then only moves
files to their final names and writes small metadata files.
"""

from __future__ import annotations

import math
import struct
import uuid

from pyspark.sql import functions as F

from ..functions.healpix import pix_at
from ..plans.pixels import HealpixPixel, sort_pixels
from . import layout
from .reader import unnest_structs

PROVENANCE = ("creator_did", "obs_copyright", "bib_reference", "publisher_id", "obs_regime")


def round_sig(x: float, digits: int = 5) -> float:
    return 0.0 if x == 0 else round(x, digits - 1 - math.floor(math.log10(abs(x))))


def fits_image(values: list[int]) -> bytes:
    """A one-dimensional 64-bit image in a minimal FITS file."""
    cards = ["SIMPLE  =                    T", "BITPIX  =                   64", "NAXIS   =                    1", f"NAXIS1  = {len(values):20d}", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
    body = struct.pack(f">{len(values)}q", *values)
    return head + body + b"\0" * (-len(body) % 2880)


def write_dataset(cat, path: str, *, catalog_name=None, default_columns=None, inherit_provenance=False, addl_hats_properties=None, overwrite=False, resume=False, create_parquet_metadata=True, create_thumbnail=False, create_per_partition_statistics=True, error_if_empty=True, create_summary=False, should_write_skymap=True, skymap_alt_orders=None, histogram_order=None, npix_suffix=".parquet", write_table_kwargs=None, **_):
    """Write one dataset. Pixels that ``resume`` finds written are skipped."""
    spark = cat.spark
    path = path.rstrip("/")
    if overwrite and resume:
        raise ValueError("overwrite and resume exclude each other")
    if layout.exists(spark, path) and layout.listing(spark, path):
        if overwrite:
            layout.delete(spark, path)
        elif not resume:
            raise ValueError(f"{path} is not empty; pass overwrite=True or resume=True")
    if default_columns is not None:
        cat._check_columns(default_columns)
        for c in default_columns:
            if "." in c and c.split(".")[0] in default_columns:
                raise ValueError(f"default_columns has both {c.split('.')[0]} and its sub-column {c}")
    margin = "__norder" in cat.df.columns
    norder, npix = (F.col("__norder"), F.col("__npix")) if margin else cat._partition()
    df = cat.df.withColumns({"Norder": norder, "Npix": npix}).where("Norder is not null")
    if margin:
        df = df.drop("__norder", "__npix")
    counts = {HealpixPixel(r["Norder"], r["Npix"]): r["n"] for r in df.groupBy("Norder", "Npix").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = {p for p in counts if layout.exists(spark, f"{path}/dataset/{layout.pixel_file(*p, npix_suffix)}")} if resume else set()
    if resume:
        known = _existing(spark, path, npix_suffix)
        if known - set(counts):
            raise ValueError("the partly written catalog has pixels that this one has not")
    if not counts and error_if_empty:
        raise RuntimeError("The output catalog is empty")
    todo = [p for p in counts if p not in done]
    if todo:
        tmp = f"{path}/_writing-{uuid.uuid4().hex}"
        options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "15", **(write_table_kwargs or {})}
        rows = df
        if done:
            keep = spark.createDataFrame([(p.order, p.pixel) for p in todo], "Norder int, Npix long")
            rows = df.join(F.broadcast(keep), ["Norder", "Npix"], "left_semi")
        rows = unnest_structs(rows).withColumn("Dir", F.floor(F.col("Npix") / 10000) * 10000)
        index = [F.col(f"`{cat.index_column}`")] if cat.index_column in df.columns else []
        rows = rows.repartition(max(1, min(len(todo), 20_000)), "Norder", "Npix").sortWithinPartitions("Norder", "Npix", *index)
        rows.write.options(**options).partitionBy("Norder", "Dir", "Npix").parquet(tmp)
        for p in todo:
            folder = f"{tmp}/Norder={p.order}/Dir={p.pixel // 10000 * 10000}/Npix={p.pixel}"
            target = f"{path}/dataset/{layout.pixel_file(*p, npix_suffix)}"
            if npix_suffix == "/":
                layout.rename(spark, folder, target.rstrip("/"))
            else:
                layout.rename(spark, next(f for f in layout.listing(spark, folder) if f.endswith(".parquet")), target)
        layout.delete(spark, tmp)
    pixels = sort_pixels(counts)
    _metadata(cat, df, path, pixels, counts, catalog_name, default_columns, inherit_provenance, addl_hats_properties, npix_suffix, create_parquet_metadata, create_thumbnail, create_per_partition_statistics, create_summary, should_write_skymap, skymap_alt_orders, histogram_order)
    return path


def _existing(spark, path, suffix):
    out = set()
    for o in layout.listing(spark, f"{path}/dataset"):
        if "/Norder=" in o:
            for d in layout.listing(spark, o):
                for f in layout.listing(spark, d):
                    name = f.rsplit("Npix=", 1)[-1].removesuffix(suffix.rstrip("/") or "")
                    if name.isdigit():
                        out.add(HealpixPixel(int(o.rsplit("=", 1)[1]), int(name)))
    return out


def _metadata(cat, df, path, pixels, counts, name, default_columns, inherit, extra, suffix, parquet_metadata, thumbnail, statistics, summary, skymap, alt_orders, histogram_order):
    spark, info = cat.spark, cat.info
    lines = ["Norder,Npix"] + [f"{p.order},{p.pixel}" for p in pixels]
    layout.write_bytes(spark, f"{path}/{layout.PARTITION_INFO}", ("\n".join(lines) + "\n").encode())
    flat = unnest_structs(df.drop("Norder", "Npix"))
    if parquet_metadata or not pixels:
        empty = f"{path}/_schema-{uuid.uuid4().hex}"
        flat.limit(0).coalesce(1).write.parquet(empty)
        layout.rename(spark, next(f for f in layout.listing(spark, empty) if f.endswith(".parquet")), f"{path}/dataset/_common_metadata")
        layout.delete(spark, empty)
    if thumbnail:
        first = f"{path}/_thumb-{uuid.uuid4().hex}"
        one = df.dropDuplicates(["Norder", "Npix"]).drop("Norder", "Npix")
        unnest_structs(one).coalesce(1).write.parquet(first)
        layout.rename(spark, next(f for f in layout.listing(spark, first) if f.endswith(".parquet")), f"{path}/dataset/data_thumbnail.parquet")
        layout.delete(spark, first)
    if statistics and pixels and "__norder" not in cat.df.columns:
        cat.per_partition_statistics(warn_on_modified_catalog=False).coalesce(1).write.mode("overwrite").parquet(f"{path}/dataset/_statistics")
    top = max((p.order for p in pixels), default=0)
    point = info.catalog_type in ("object", "source", "map") and cat.index_column in df.columns
    if skymap and point and pixels:
        base = histogram_order if histogram_order is not None else max(top, 8)
        for order in [base, *(alt_orders or ())]:
            h = {r["pixel"]: r["n"] for r in df.groupBy(pix_at(F.col(f"`{cat.index_column}`"), order, info.healpix_order).alias("pixel")).agg(F.count(F.lit(1)).alias("n")).collect()}
            image = fits_image([h.get(i, 0) for i in range(12 << (2 * order))])
            if order == base:
                layout.write_bytes(spark, f"{path}/point_map.fits", image)
                layout.write_bytes(spark, f"{path}/skymap.fits", image)
            else:
                layout.write_bytes(spark, f"{path}/skymap.{order}.fits", image)
    old = dict(info.extra) if inherit else {k: v for k, v in info.extra.items() if k not in PROVENANCE}
    props = {
        **{k: v for k, v in old.items() if isinstance(v, str)},
        "obs_collection": name or cat.name,
        "dataproduct_type": info.catalog_type,
        "hats_nrows": sum(counts.values()),
        "hats_max_rows": max(counts.values(), default=0),
        "hats_order": top,
        "hats_col_ra": info.ra_column,
        "hats_col_dec": info.dec_column,
        "hats_col_healpix": cat.index_column if cat.index_column in df.columns else None,
        "hats_col_healpix_order": info.healpix_order,
        "hats_npix_suffix": suffix,
        "moc_sky_fraction": round_sig(sum(4.0**-p.order for p in pixels) / 12),
        "hats_margin_threshold": info.margin_threshold,
        "hats_cols_default": " ".join(default_columns or info.default_columns or ()),
        **(extra or {}),
    }
    data = layout.format_properties(props)
    for f in layout.PROPERTIES:
        layout.write_bytes(spark, f"{path}/{f}", data)
    if summary:
        text = f"# {props['obs_collection']}\n\n{props['hats_nrows']} rows, {len(pixels)} partitions, columns: {', '.join(cat.columns)}\n"
        layout.write_bytes(spark, f"{path}/README.md", text.encode())


def write_collection(cat, path: str, *, catalog_name=None, **kw):
    """A catalog with its margin in one folder."""
    path, name = path.rstrip("/"), catalog_name or cat.name
    write_dataset(cat, f"{path}/{name}", catalog_name=name, **kw)
    props = {"obs_collection": name, "hats_primary_table_url": name}
    if cat.margin is not None:
        margin = f"{name}_{int(cat.margin.info.margin_threshold or 0)}arcs"
        own = {k: v for k, v in kw.items() if k in ("overwrite", "resume", "default_columns", "npix_suffix", "write_table_kwargs", "inherit_provenance")}
        write_dataset(cat.margin, f"{path}/{margin}", catalog_name=margin, error_if_empty=False, **own)
        props |= {"all_margins": margin, "default_margin": margin}
    layout.write_bytes(cat.spark, f"{path}/{layout.COLLECTION}", layout.format_properties(props))
    return path


def write_association(cat, path: str, *, catalog_name, primary_catalog_dir, primary_column_association, primary_id_column, join_catalog_dir, join_column_association, join_id_column, join_to_primary_id_column=None, separation_column=None, overwrite=False, **kw):
    """An association table of a crossmatch result."""
    needed = {"primary_column_association": primary_column_association, "join_column_association": join_column_association}
    for k, v in {**needed, "catalog_name": catalog_name, "primary_catalog_dir": primary_catalog_dir, "primary_id_column": primary_id_column, "join_catalog_dir": join_catalog_dir, "join_id_column": join_id_column}.items():
        if not v:
            raise ValueError(f"{k} is required")
    for v in [*needed.values(), *([separation_column] if separation_column else [])]:
        if v not in cat.columns:
            raise ValueError(f"{v} is not a column of the catalog")
    keep = [primary_column_association, join_column_association, *([separation_column] if separation_column else [])]
    index = [cat.index_column] if cat.index_column in cat.df.columns else []
    slim = cat._with(cat.df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*index, *keep])]), margin=None, info=cat.info.copy(catalog_type="association", ra_column=None, dec_column=None, extra={}))
    largest = cat.df.agg(F.max(F.col(f"`{separation_column}`"))).first()[0] if separation_column else None
    props = {
        "primary_catalog": str(primary_catalog_dir), "primary_column": primary_id_column, "primary_column_association": primary_column_association,
        "join_catalog": str(join_catalog_dir), "join_column": join_id_column, "join_column_association": join_column_association,
        "join_to_primary_id_column": join_to_primary_id_column, "contains_leaf_files": "True",
        "assn_max_separation": None if largest is None else f"{largest:0.5f}",
    }
    return write_dataset(slim, path, catalog_name=catalog_name, overwrite=overwrite, addl_hats_properties=props, should_write_skymap=False, create_per_partition_statistics=False, **kw)
