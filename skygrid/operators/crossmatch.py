"""Nearest-neighbour crossmatch as a grid equi-join.

Positions go to the unit sphere, cut into cubes of an edge of several match
radii. The right side is written to every cube that its ball of the radius
touches (mostly one, at most eight); a left row lies in one cube, so a pair
meets at most once and no pole or wrap needs care. Rows of both sides move once,
to the partition of their cube. Where few right rows lie within the radius, an
equi-join on the cube and a ranking within the left row do the rest. Where many do,
each left row's nearest ``n`` are searched for on arrays (``nearest.py``), which
forms a few candidates a row where the join forms all pairs of a dense cube.
Columns that Arrow lacks take the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import sphere
from .nearest import matcher
from .shipping import ship

DISTANCE = "_dist_arcsec"
_LEFT_ID, _KEY, _SIDE = "__left_id", "__cell", "__side"


def cell_edge(chord: float) -> float:
    return max(4 * chord, 1e-5)


MANY = 4  # right rows within the radius, from which on searching beats the join
LARGE = 100_000  # right rows that are never gathered on the driver for a broadcast


def within_radius(rows: int | None, pixels, radius_arcsec: float) -> float:
    """Right rows expected within the radius, spread evenly over their pixels; rows
    of unknown number count as many."""
    if rows is None:
        return float("inf")
    area = sum(4.0**-p[0] for p in pixels) / 12
    return rows / max(area, 1e-12) * sphere.chord_of_arcsec(radius_arcsec) ** 2 / 4


def _key(x: Column, y: Column, z: Column) -> Column:
    """One BIGINT of three cube numbers (each below 2^20 in size)."""
    off = F.lit(1 << 20).cast("long")
    return F.shiftleft(x + off, 42) + F.shiftleft(y + off, 21) + (z + off)


def _cube(v: Column, s: float) -> Column:
    return F.floor(v / s).cast("long")


def neighbours(
    left: DataFrame,
    right: DataFrame,
    left_pos: tuple[str, str],
    right_pos: tuple[str, str],
    radius_arcsec: float,
    min_radius_arcsec: float = 0.0,
    n: int | None = 1,
    how: str = "inner",
    equal: tuple[str, str] | None = None,
    dense: bool = True,
    large: bool = True,
) -> DataFrame:
    """Join rows (all columns of both, names must differ) with the distance.

    ``min < d < max``; ``min = 0`` keeps zero distance. Ties go to the right row
    first by position, then by all its columns. ``equal``: a pair of columns that
    must also be equal (same right partition). ``dense``: search instead of joining,
    ``large``: no broadcast of the right side; neither changes the result.
    """
    chord = sphere.chord_of_arcsec(radius_arcsec)
    s = cell_edge(chord)
    c = chord * (1 + 1e-9) + 1e-15
    quote = lambda name: F.col(f"`{name}`")
    lx, ly, lz = sphere.xyz(quote(left_pos[0]), quote(left_pos[1]))
    rx, ry, rz = sphere.xyz(quote(right_pos[0]), quote(right_pos[1]))
    a = left.withColumn(_LEFT_ID, F.monotonically_increasing_id()).withColumns({"__lx": lx, "__ly": ly, "__lz": lz})
    a = a.withColumn(_KEY, _key(_cube(F.col("__lx"), s), _cube(F.col("__ly"), s), _cube(F.col("__lz"), s)))
    b = right.withColumns({"__rx": rx, "__ry": ry, "__rz": rz})
    for axis in "xyz":
        v = F.col(f"__r{axis}")
        b = b.withColumn(f"__c{axis}", F.explode(F.sequence(_cube(v - c, s), _cube(v + c, s))))
    b = b.withColumn("__rcell", _key(F.col("__cx"), F.col("__cy"), F.col("__cz"))).drop("__cx", "__cy", "__cz")
    if n is not None and dense and _in_arrow(left.schema, right.schema):
        low = sphere.chord_of_arcsec(min_radius_arcsec) if min_radius_arcsec > 0 else 0.0
        return _searched(a, b, left, right, n, chord, low, how, equal)

    d2 = sum(((F.col(f"__l{k}") - F.col(f"__r{k}")) * (F.col(f"__l{k}") - F.col(f"__r{k}")) for k in "xyz"), F.lit(0.0))
    band = d2 < chord * chord
    if min_radius_arcsec > 0:
        band = band & (d2 > sphere.chord_of_arcsec(min_radius_arcsec) ** 2)
    on = (F.col(_KEY) == F.col("__rcell")) & band
    if equal:
        on = on & (quote(equal[0]) == quote(equal[1]))
    pairs = a.join(b.hint("merge") if large else b, on, "left" if how == "left" else "inner").withColumn("__d2", d2)
    if n is not None:
        order = [F.col("__d2"), F.col("__rx"), F.col("__ry"), F.col("__rz")]
        order += [quote(f.name) for f in right.schema.fields if f.dataType.typeName() not in ("map", "variant")]
        # a left row lies in one cube: by cube as well, the ranking keeps the join's partitioning
        within = [_KEY, *([quote(equal[0])] if equal else []), _LEFT_ID]
        rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        pairs = pairs.withColumn("__rank", rank).where(F.col("__rank") <= n)
    dist = F.when(F.col("__d2").isNotNull(), sphere.chord2arcsec(F.sqrt(F.col("__d2"))))
    return pairs.select(*[quote(x) for x in left.columns], *[quote(x) for x in right.columns], dist.alias(DISTANCE), _LEFT_ID)


def _in_arrow(*schemas) -> bool:
    try:
        for s in schemas:
            to_arrow_schema(s)
    except Exception:
        return False
    return True


def _searched(a: DataFrame, b: DataFrame, left: DataFrame, right: DataFrame, n: int, chord: float, low: float, how: str, equal) -> DataFrame:
    """The nearest ``n``: both sides in one sorted pass by cube, right rows first."""
    quote = lambda name: F.col(f"`{name}`")
    ship(left.sparkSession)
    if how != "left":
        a = a.where(F.col(_KEY).isNotNull())
    if equal:
        b = b.where(quote(equal[1]).isNotNull())
    same = [[quote(e).alias("__same")] for e in equal] if equal else [[], []]
    place = ["__x", "__y", "__z"]
    mine = a.select(_KEY, *same[0], F.lit(1).alias(_SIDE), *[F.col(f"__l{k}").alias(f"__{k}") for k in "xyz"], _LEFT_ID, F.struct(*[quote(c) for c in left.columns]).alias("__l"))
    theirs = b.select(F.col("__rcell").alias(_KEY), *same[1], F.lit(0).alias(_SIDE), *[F.col(f"__r{k}").alias(f"__{k}") for k in "xyz"], F.struct(*[quote(c) for c in right.columns]).alias("__r"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    keys = [_KEY, *(["__same"] if equal else [])]
    ties = [F.col(f"__r.`{f.name}`") for f in right.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    both = both.repartition(*keys).sortWithinPartitions(*keys, _SIDE, *place, *ties)
    fields = [StructField("__l", both.schema["__l"].dataType), StructField("__r", both.schema["__r"].dataType), StructField("__d2", DoubleType()), StructField(_LEFT_ID, LongType())]
    run = matcher(keys, _SIDE, place, "__l", "__r", _LEFT_ID, [f.name for f in fields], n, chord, low, how == "left")
    found = both.mapInArrow(run, StructType(fields))
    dist = F.when(F.col("__d2").isNotNull(), sphere.chord2arcsec(F.sqrt(F.col("__d2"))))
    return found.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__r.`{c}`").alias(c) for c in right.columns], dist.alias(DISTANCE), _LEFT_ID)


class AbstractCrossmatchAlgorithm:
    """A user's own matching: ``perform_crossmatch(left, right)`` gets two pandas
    frames of one partition pair and returns (left positions, right positions,
    frame of extra columns). One that treats every left row by itself may set
    ``left_rows``, and gets so many rows of the left frame at most at a time."""

    extra_columns: dict[str, str] = {DISTANCE: "double"}
    left_rows: int | None = None

    def validate(self, left, right):
        return None

    def perform_crossmatch(self, left, right):
        raise NotImplementedError


class KdTreeCrossmatch:
    """Parameters of the built-in match."""

    def __init__(self, n_neighbors: int = 1, radius_arcsec: float = 1.0, min_radius_arcsec: float = 0.0):
        if radius_arcsec <= 0:
            raise ValueError("Cross match radius must be greater than 0")
        if n_neighbors < 1:
            raise ValueError("n_neighbors must be at least 1")
        if min_radius_arcsec < 0:
            raise ValueError("The minimum radius must be non-negative")
        if min_radius_arcsec >= radius_arcsec:
            raise ValueError("Cross match maximum radius must be greater than the minimum radius")
        self.n_neighbors, self.radius_arcsec, self.min_radius_arcsec = n_neighbors, radius_arcsec, min_radius_arcsec
