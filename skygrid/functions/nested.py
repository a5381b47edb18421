"""Nested cells (arrays of structs): lengths, flattening, lists, sub-filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_lengths(nested: Column) -> Column:
    return F.coalesce(F.size(nested), F.lit(0)) if isinstance(nested, Column) else F.coalesce(F.size(F.col(nested)), F.lit(0))


def keep_where(nested: Column, condition) -> Column:
    """Filter inside the cell; an emptied cell becomes null."""
    kept = F.filter(nested, condition)
    return F.when(F.size(kept) > 0, kept)


def to_flat(df: DataFrame, nested: str, keep=()) -> DataFrame:
    """One row for each element, sub-columns named ``nested.sub``."""
    fields = [f.name for f in df.schema[nested].dataType.elementType.fields]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.col(f"`{nested}`")).alias("__e"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col("__e")[f].alias(f"{nested}.{f}") for f in fields])


def to_lists(df: DataFrame, nested: str, keep=()) -> DataFrame:
    """Sub-columns as arrays of equal length, named ``nested.sub``."""
    fields = [f.name for f in df.schema[nested].dataType.elementType.fields]
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{nested}`")[f].alias(f"{nested}.{f}") for f in fields])
