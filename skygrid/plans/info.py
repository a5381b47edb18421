"""Catalog metadata kept on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

TYPES = ("object", "source", "map", "association", "margin", "index")


@dataclass(frozen=True)
class CatalogInfo:
    catalog_name: str = "catalog"
    catalog_type: str = "object"
    ra_column: str | None = "ra"
    dec_column: str | None = "dec"
    healpix_column: str | None = "_healpix_29"
    healpix_order: int = 29
    total_rows: int | None = None
    default_columns: tuple | None = None
    margin_threshold: float | None = None
    primary_catalog: str | None = None
    extra: dict = field(default_factory=dict)

    def copy(self, **kw) -> "CatalogInfo":
        return replace(self, **kw)
