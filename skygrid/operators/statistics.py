"""Column and partition statistics: one aggregation over the rows, or over the
statistics that were written with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

STATS = ["min_value", "max_value", "null_count", "row_count"]


def usable(df: DataFrame, only_numeric: bool = False, include=None, exclude=()):
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("array", "map", "struct", "binary"):
            continue
        if only_numeric and not isinstance(f.dataType, NumericType):
            continue
        if (include is None or f.name in include) and f.name not in exclude:
            out.append(f.name)
    return out


def aggregates(columns):
    out = []
    for c in columns:
        q = F.col(f"`{c}`")
        out += [F.min(q).alias(f"{c}: min_value"), F.max(q).alias(f"{c}: max_value"), F.count_if(q.isNull()).alias(f"{c}: null_count"), F.count(F.lit(1)).alias(f"{c}: row_count")]
    return out


def column_statistics(df: DataFrame, columns) -> DataFrame:
    """One row for each column: min and max as strings, null and row counts."""
    return _tall(df.agg(*aggregates(columns)), columns)


def combined(written: DataFrame, columns) -> DataFrame:
    """The same from statistics by partition."""
    how = {"min_value": F.min, "max_value": F.max, "null_count": F.sum, "row_count": F.sum}
    names = [(f"{c}: {s}", how[s]) for c in columns for s in STATS]
    return _tall(written.agg(*[fn(F.col(f"`{n}`")).alias(n) for n, fn in names]), columns)


def _tall(wide: DataFrame, columns) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("column_names"), *[(F.col(f"`{c}: {s}`").cast("string") if s.endswith("value") else F.col(f"`{c}: {s}`")).alias(s) for s in STATS])
        for c in columns
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def partition_statistics(df: DataFrame, norder, npix, columns) -> DataFrame:
    keyed = df.withColumns({"norder": norder, "npix": npix})
    return keyed.groupBy("norder", "npix").agg(*aggregates(columns))
