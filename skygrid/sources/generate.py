"""Synthetic catalogs, generated on the executors from row numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.healpix import pix2ang_np
from ..operators.search import BoxSearch, ConeSearch, PixelSearch
from .frame import from_dataframe


def _uniform(seed: int, *keys):
    """Uniform in [0, 1) from a hash of the row's keys: the same on any cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def generate_data(spark: SparkSession, n_base: int, n_layer, npartitions: int = 1, seed: int = 0, ra_range=(0.0, 360.0), dec_range=(-90.0, 90.0), search_region=None) -> DataFrame:
    """ra, dec, id, a, b and nested columns of ``n_layer`` elements each (an int
    for one column ``nested``, a dict for several), uniform on the sphere or in
    a cone, box or pixel region."""
    df = spark.range(0, n_base, 1, npartitions)
    k = F.col("id")
    u, v = _uniform(seed + 1, k), _uniform(seed + 2, k)
    if isinstance(search_region, BoxSearch):
        a, b = (0.0, 360.0) if search_region.whole else search_region.ra
        ra_range, dec_range = (a, a + ((b - a) % 360 or 360)), search_region.dec
        search_region = None
    if isinstance(search_region, ConeSearch):
        r = math.radians(search_region.radius_arcsec / 3600)
        dist = F.acos(F.lit(1.0) - u * (1 - math.cos(r)))
        angle = v * (2 * math.pi)
        d0, r0 = math.radians(search_region.dec), math.radians(search_region.ra)
        sin_d = F.sin(F.lit(d0)) * F.cos(dist) + F.cos(F.lit(d0)) * F.sin(dist) * F.cos(angle)
        dec = F.degrees(F.asin(sin_d))
        ra = F.pmod(F.degrees(F.lit(r0) + F.atan2(F.sin(angle) * F.sin(dist) * math.cos(d0), F.cos(dist) - sin_d * math.sin(d0))), F.lit(360.0))
    elif isinstance(search_region, PixelSearch):
        # centres of deep sub-cells of the pixels, one for each of 4^8 places
        places = []
        for p in search_region.pixels:
            sub = min(29, p.order + 4)
            base = p.pixel << (2 * (sub - p.order))
            for c in range(1 << (2 * (sub - p.order))):
                x, y = pix2ang_np(sub, base + c)
                places.append((float(x), float(y)))
        grid = F.array(*[F.struct(F.lit(x).alias("ra"), F.lit(y).alias("dec")) for x, y in places])
        spot = F.element_at(grid, (F.floor(u * len(places)) + 1).cast("int"))
        ra, dec = spot["ra"], spot["dec"]
    else:
        lo, hi = (math.sin(math.radians(x)) for x in dec_range)
        ra = F.pmod(F.lit(float(ra_range[0])) + u * (ra_range[1] - ra_range[0]), F.lit(360.0))
        dec = F.degrees(F.asin(F.lit(lo) + v * (hi - lo)))
    layers = n_layer if isinstance(n_layer, dict) else {"nested": n_layer}
    cols = [ra.alias("ra"), dec.alias("dec"), k, _uniform(seed + 3, k).alias("a"), (_uniform(seed + 4, k) * 2).alias("b")]
    for i, (name, n) in enumerate(layers.items()):
        cols.append(F.transform(F.sequence(F.lit(1), F.lit(n)), _element(seed + 10 * (i + 1), k)).alias(name))
    return df.select(*cols)


def _element(seed: int, key):
    def build(j):
        flux = _uniform(seed + 1, key, j) * 100
        return F.struct((_uniform(seed, key, j) * 20).alias("t"), flux.alias("flux"), (flux * 0.05).alias("flux_err"), F.element_at(F.array(F.lit("g"), F.lit("r")), (j % 2 + 1).cast("int")).alias("band"))

    return build


def generate_catalog(spark: SparkSession, n_base: int, n_layer, seed: int = 0, ra_range=(0.0, 360.0), dec_range=(-90.0, 90.0), search_region=None, **kwargs):
    df = generate_data(spark, n_base, n_layer, max(1, n_base // 100_000), seed, ra_range, dec_range, search_region)
    return from_dataframe(df, ra_column="ra", dec_column="dec", **{"catalog_name": "generated", **kwargs})
