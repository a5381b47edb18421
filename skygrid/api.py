"""Module-level helpers: crossmatching frames, versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from .catalog import Catalog
from .sources.frame import from_dataframe


def crossmatch(left, right, *, ra_column=None, dec_column=None, suffixes=None, algorithm=None, output_catalog_name=None, require_right_margin=False, suffix_method=None, log_changes=True, how="inner", left_args=None, right_args=None, radius_arcsec=None, **kwargs):
    """Crossmatch two catalogs or frames; frames become catalogs, the right one
    with a margin as wide as the radius."""
    ra = {k: v for k, v in (("ra_column", ra_column), ("dec_column", dec_column)) if v}
    left_args, right_args = dict(left_args or {}), dict(right_args or {})
    if require_right_margin and not isinstance(right, Catalog) and right_args.get("margin_threshold", 1) is None:
        raise ValueError("If require_right_margin is True, margin_threshold must not be None")
    right_args.setdefault("margin_threshold", max(radius_arcsec or 1.0, 0.0))

    def lift(x, args, name):
        if isinstance(x, Catalog):
            return x
        if isinstance(x, (DataFrame, pd.DataFrame)):
            return from_dataframe(x, **{"catalog_name": name, **ra, **args})
        raise TypeError("Argument must be a Catalog or a DataFrame")

    a, b = lift(left, {"margin_threshold": None, **left_args}, "left"), lift(right, right_args, "right")
    return a.crossmatch(b, suffixes=suffixes, algorithm=algorithm, output_catalog_name=output_catalog_name, require_right_margin=require_right_margin, suffix_method=suffix_method, log_changes=log_changes, how=how, radius_arcsec=radius_arcsec, **kwargs)


def show_versions() -> dict:
    import platform
    from importlib.metadata import PackageNotFoundError, version

    out = {"python": platform.python_version()}
    for p in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[p] = version(p)
        except PackageNotFoundError:
            out[p] = "not installed"
    for k, v in out.items():
        print(f"{k:10}: {v}")
    return out
