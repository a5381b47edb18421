"""A PySpark-native engine for very large astronomical catalogs."""

from .api import crossmatch, show_versions
from .catalog import AssociationCatalog, Catalog, MapCatalog, MarginCatalog
from .operators.crossmatch import AbstractCrossmatchAlgorithm, KdTreeCrossmatch
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
from .plans.moc import Moc
from .plans.pixels import HealpixPixel
from .sources.frame import from_astropy, from_dataframe
from .sources.generate import generate_catalog, generate_data
from .sources.reader import open_catalog, read_hats
from .streaming import CatalogStream, InfiniteStream

__all__ = [
    "AbstractCrossmatchAlgorithm", "AbstractSearch", "AssociationCatalog", "BoxSearch", "Catalog", "CatalogStream", "ConeSearch", "HealpixPixel",
    "IndexSearch", "InfiniteStream", "KdTreeCrossmatch", "MOCSearch", "MapCatalog", "MarginCatalog", "Moc", "OrderSearch", "PixelSearch",
    "PolygonSearch", "crossmatch", "from_astropy", "from_dataframe", "generate_catalog", "generate_data", "open_catalog", "read_hats", "show_versions",
]
