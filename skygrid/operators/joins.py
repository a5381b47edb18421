"""Joins of catalogs: by id, through an association, as-of, with a map, custom."""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.pixels import partition_of
from . import udf as udf_ops
from .crossmatch import LARGE


class Names(NamedTuple):
    left: dict
    right: dict


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def suffixed(left, right, suffixes=None, method=None, log_changes=True) -> Names:
    """Output names of all columns; the left index keeps its name."""
    if suffixes is None:
        suffixes = (f"_{left.name}", f"_{right.name}") if left.name != right.name else ("", "_right")
    if len(suffixes) != 2:
        raise ValueError("`suffixes` must be a tuple with two strings")
    if method is None:
        warnings.warn("the default suffix method will become overlapping_columns", FutureWarning, stacklevel=3)
        method = "all_columns"
    if method not in ("all_columns", "overlapping_columns"):
        raise ValueError("suffix_method must be all_columns or overlapping_columns")
    both = set(left.columns) & set(right.columns)
    keep = (lambda c: c not in both) if method == "overlapping_columns" else (lambda c: False)
    names = Names({c: c if keep(c) else c + suffixes[0] for c in left.columns}, {c: c if keep(c) else c + suffixes[1] for c in right.columns})
    if left.index_column in left.df.columns:
        names.left[left.index_column] = left.index_column
    if right.index_column in right.df.columns:
        names.right[right.index_column] = f"__right_{right.index_column}"
    return names


def renamed(cat, names: dict) -> DataFrame:
    return cat.df.select(*[q(c).alias(names[c]) for c in cat.df.columns if c in names])


def right_partition(df: DataFrame, index: str, right) -> Column:
    """The right catalog's partition at a row's position, as one value."""
    norder, npix = partition_of(df, index, right.tree.pixels, right.info.healpix_order)
    return F.when(norder.isNotNull(), F.concat_ws(":", norder.cast("string"), npix.cast("string")))


def same_partition(left: DataFrame, right: DataFrame, lcat, rcat):
    a = left.withColumn("__lp", right_partition(left, lcat.index_column, rcat))
    b = right.withColumn("__rp", right_partition(right, f"__right_{rcat.index_column}", rcat))
    return a, b, ("__lp", "__rp")


def join_on(lcat, rcat, left_on: str, right_on: str, names: Names, scope: str) -> DataFrame:
    a, b = renamed(lcat, names.left), renamed(rcat, names.right)
    on = q(names.left[left_on]) == q(names.right[right_on])
    if scope == "partition":
        a, b, (x, y) = same_partition(a, b, lcat, rcat)
        on = on & (q(x) == q(y))
    return a.join(b, on, "inner").drop("__lp", "__rp", f"__right_{rcat.index_column}")


def join_through(lcat, rcat, assn, names: Names) -> DataFrame:
    info = assn.info.extra
    primary, key = info["primary_column"], info["primary_column_association"]
    joined, join_key = info["join_column"], info["join_column_association"]
    limit = assn.max_separation
    margin = getattr(rcat, "margin", None)
    if margin is not None and limit is not None and margin.info.margin_threshold is not None and margin.info.margin_threshold < limit:
        warnings.warn("The association's separation exceeds the margin threshold", RuntimeWarning, stacklevel=3)
    if info.get("contains_leaf_files", True) is False:
        return join_on(lcat, rcat, primary, joined, names, "global")
    skip = {key, join_key, "Norder", "Dir", "Npix", "join_Norder", "join_Dir", "join_Npix", assn.index_column}
    extras = [c for c in assn.df.columns if c not in skip]
    a, b = renamed(lcat, names.left), renamed(rcat, names.right)
    links = assn.df.select(q(key).alias("__a"), q(join_key).alias("__b"), *[q(c).alias(f"__x_{c}") for c in extras])
    if any(c.info.total_rows is None or c.info.total_rows > LARGE for c in (lcat, rcat)):
        links, b = links.hint("merge"), b.hint("merge")  # never through the driver
    out = a.join(links, q(names.left[primary]) == F.col("__a")).join(b, F.col("__b") == q(names.right[joined]))
    cols = [q(c) for c in a.columns] + [q(c) for c in b.columns if c != f"__right_{rcat.index_column}"]
    return out.select(*cols, *[q(f"__x_{c}").alias(c) for c in extras])


def join_nested(lcat, rcat, left_on: str, right_on: str, nested: str, how: str) -> DataFrame:
    """Right rows grouped by key into a cell, sorted for a stable order."""
    fields = [c for c in rcat.columns if c != right_on]
    cell = F.array_sort(F.collect_list(F.struct(*[q(c) for c in fields])))
    grouped = rcat.df.where(q(right_on).isNotNull()).groupBy(q(right_on).alias("__key")).agg(cell.alias(nested))
    return lcat.df.join(grouped, q(left_on) == F.col("__key"), how).drop("__key")


SPLITS = 3  # orders below a partition's own: 64 cells to a partition


def merge_asof(lcat, rcat, direction: str, names: Names, scope: str, order: int | None = None) -> DataFrame:
    """Nearest earlier, later or nearest right row by index, or by pixel at ``order``.

    Of right rows at one place ``backward`` takes the last by their columns,
    ``forward`` and ``nearest`` the first.

    One window over the union of both sides, within cells of the right catalog's
    partitions: each left row takes the last right row before it (read downwards,
    the first after it), so no range of pairs is formed and both ways cost one
    running pass. A partition is no unit of work: what a cell's first rows need
    from the cells before it comes from a table of each cell's outermost right
    rows, 64 to a partition.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction must be backward, forward or nearest")
    if scope != "partition":
        raise ValueError("merge_asof is defined within the right catalog's partitions")
    h, rh = lcat.index_column, f"__right_{rcat.index_column}"
    a, b = renamed(lcat, names.left), renamed(rcat, names.right)
    top = rcat.info.healpix_order
    fine = top if order is None else order
    if not 0 <= fine <= top:
        raise ValueError(f"order must be between 0 and {top}")
    at = lambda index: F.shiftright(index, 2 * (top - fine))

    def side(df, index, keep):
        norder, npix = partition_of(df, index, rcat.tree.pixels, top)
        cell = F.expr(f"shiftright(`{index}`, 2 * ({top} - greatest(__o, least(__o + {SPLITS}, {fine}))))")
        df = df.withColumns({"__o": norder, "__n": npix}).where("__o is not null")
        return df.select("__o", "__n", cell.alias("__c"), at(q(index)).alias("__h"), F.struct(*[q(c) for c in keep]).alias("__l" if index == h else "__r"))

    rest = [F.col(f"__r.`{c}`") for c in [*[c for c in b.columns if c != rh], rh] if b.schema[c].dataType.typeName() not in ("map",)]
    key, rights = ["__o", "__n", "__c"], side(b, rh, b.columns)
    if direction == "nearest":  # one row for a place: both ways then meet the same
        rights = rights.groupBy(*key, "__h").agg(F.min_by("__r", F.struct(*rest)).alias("__r"))
    both = side(a, h, a.columns).unionByName(rights, allowMissingColumns=True)
    place = F.when(F.col("__r").isNotNull(), F.struct("__h", *rest))
    cells = both.groupBy(*key).agg(F.max_by("__r", place).alias("__last"), F.min_by("__r", place).alias("__first"))
    is_left = F.col("__l").isNotNull().cast("int")
    found, picks = both, {}
    # downwards all sort keys turn but the side: a right row at the same place counts both ways
    ways = {"__b": ("backward", "__last", lambda c: F.asc(c) if isinstance(c, str) else c.asc()), "__f": ("forward", "__first", lambda c: F.desc(c) if isinstance(c, str) else c.desc())}
    for name, (way, edge, turn) in ways.items():
        if direction in (way, "nearest"):
            before = Window.partitionBy("__o", "__n").orderBy(turn("__c")).rowsBetween(Window.unboundedPreceding, -1)
            cells = cells.withColumn(f"{name}0", F.last(edge, ignorenulls=True).over(before))
            order = Window.partitionBy(*key).orderBy(turn("__h"), is_left, *[turn(c) for c in rest])
            picks[name] = F.coalesce(F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col(f"{name}0"))
    found = both.join(cells.drop("__last", "__first"), key)
    for name, pick in picks.items():
        found = found.withColumn(name, pick)
    if direction == "nearest":
        nearer = F.col("__b").isNull() | (F.col("__f").isNotNull() & (at(F.col(f"__f.`{rh}`")) - F.col("__h") < F.col("__h") - at(F.col(f"__b.`{rh}`"))))
        found = found.withColumn("__m", F.when(nearer, F.col("__f")).otherwise(F.col("__b")))
    else:
        found = found.withColumn("__m", F.col(next(iter(picks))))
    found = found.where("__l is not null")
    return found.select(*[F.col(f"__l.`{c}`").alias(c) for c in a.columns], *[F.col(f"__m.`{c}`").alias(c) for c in b.columns if c != rh])


def merge_map(cat, map_cat, func, args, meta, kwargs) -> DataFrame:
    """``func(catalog frame, map frame, catalog pixel, map pixel, ...)`` for
    every pair of overlapping partitions, both sorted by index."""
    pairs = cat.tree.align(map_cat.tree, "inner")
    if not pairs:
        raise RuntimeError("Catalogs do not overlap")
    schema = udf_ops.as_schema(meta) if meta is not None else udf_ops.infer_pair(func, cat.df.schema, map_cat.df.schema, args, kwargs)
    rows = [(f"{p.order}:{p.pixel}", f"{m.order}:{m.pixel}", f"{p.order}:{p.pixel}|{m.order}:{m.pixel}") for p, m, _ in pairs]
    mine = cat.spark.createDataFrame([(a, c) for a, _, c in rows], "__cp string, __pair string")
    theirs = cat.spark.createDataFrame([(b, c) for _, b, c in rows], "__mp string, __pair string")
    left = cat.df.withColumn("__cp", right_partition(cat.df, cat.index_column, cat)).join(mine, "__cp").drop("__cp")
    right = map_cat.df.withColumn("__mp", right_partition(map_cat.df, map_cat.index_column, map_cat)).join(theirs, "__mp").drop("__mp")
    return udf_ops.pairwise(left, right, func, args, kwargs, schema, cat.index_column, map_cat.index_column)


def join_map_values(cat, map_cat, map_order: int) -> DataFrame:
    """Map values at each row's position by an equi-join on the map's cell."""
    from ..functions.healpix import pix_at

    values = map_cat.df.withColumn("__cell", pix_at(q(map_cat.index_column), map_order, map_cat.info.healpix_order)).drop(map_cat.index_column)
    return cat.df.withColumn("__cell", pix_at(q(cat.index_column), map_order, cat.info.healpix_order)).join(values, "__cell").drop("__cell")


def custom_crossmatch(lcat, rcat, algo, names: Names, how: str) -> DataFrame:
    """A user's algorithm on every aligned pixel, the right side with its margin."""
    a, b = renamed(lcat, names.left), renamed(rcat, names.right)
    algo.validate(lcat, rcat)
    left = a.withColumn("__pair", right_partition(a, lcat.index_column, rcat))
    rh = f"__right_{rcat.index_column}"
    right = b.withColumn("__pair", right_partition(b, rh, rcat))
    margin = getattr(rcat, "margin", None)
    if margin is not None:
        m = margin.df.select(*[q(c).alias(names.right[c]) for c in rcat.df.columns], F.concat_ws(":", F.col("__norder").cast("string"), F.col("__npix").cast("string")).alias("__pair"))
        right = right.unionByName(m)
    extra = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in algo.extra_columns.items()))
    lcols, rcols = a.columns, [c for c in b.columns if c != rh]
    fields = [*a.schema.fields, *[b.schema[c] for c in rcols], *extra.fields]
    for f in fields[len(lcols) :]:
        f.nullable = True
    left = left.withColumn("__pair", F.coalesce("__pair", F.lit("none"))) if how == "left" else left.where("__pair is not null")
    return udf_ops.match_pairs(left, right.where("__pair is not null"), algo, lcols, rcols, list(algo.extra_columns), StructType(fields), how)
