from .catalog_streams import CatalogStream, InfiniteStream

__all__ = ["CatalogStream", "InfiniteStream"]
