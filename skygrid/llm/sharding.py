"""Balanced sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (documents of equal text) are sorted by size and each enters the open
bin whose remaining capacity is the tightest that still holds it; the open
bins live in a height-balanced search tree keyed by remaining capacity. For a
fixed number of shards the smallest capacity that needs no more bins is found
by bisection.

Scale. Best fit depends on sizes alone, so the driver packs the histogram of
group sizes, never the groups: n different sizes sum to n^2 / 2 bytes at least,
so there are at most the root of twice the corpus in bytes, and in practice as
many as there are lengths of text. A group finds its bin from its size and its
number among the groups of that size.
"""

from __future__ import annotations

import random
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, table


class CapacityTree:
    """Ordered multiset of (remaining capacity, bin) as a treap: balanced in
    expectation, O(log n) insert, remove-tightest-at-least."""

    __slots__ = ("root", "rng")

    def __init__(self):
        self.root, self.rng = None, random.Random(7)

    def insert(self, key):
        self.root = self._insert(self.root, key)

    def _insert(self, t, key):
        if t is None:
            return [key, self.rng.random(), None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._insert(t[side], key)
        child = t[side]
        if child[1] > t[1]:  # rotate the child up
            other = 5 - side
            t[side], child[other] = child[other], t
            return child
        return t

    def tightest(self, least):
        """Remove and return the smallest key whose capacity is >= least."""
        best, t = None, self.root
        while t is not None:
            if t[0][0] >= least:
                best, t = t[0], t[2]
            else:
                t = t[3]
        if best is not None:
            self.root = self._remove(self.root, best)
        return best

    def _merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _remove(self, t, key):
        if key == t[0]:
            return self._merge(t[2], t[3])
        side = 2 if key < t[0] else 3
        t[side] = self._remove(t[side], key)
        return t


def best_fit_decreasing(sizes, counts, capacity: int, most: int | None = None) -> tuple[list[list[int]], int] | None:
    """Pack ``counts[i]`` items of ``sizes[i]`` (sizes descending, all different).

    Returns runs [size, items, bin] in the order of placement, and the number of
    bins; None if an item exceeds the capacity or more than ``most`` bins would
    be opened. The tightest bin stays the tightest after it took an item, so it
    takes items of one size in bulk: the packing is that of one at a time.
    """
    if len(sizes) and sizes[0] > capacity:
        return None
    tree, runs, bins = CapacityTree(), [], 0
    for size, left in zip(sizes, counts):
        while left:
            room = tree.tightest(size)
            if room is None:
                if bins == most:
                    return None
                room, bins = (capacity, bins), bins + 1
            n = min(left, room[0] // size)
            runs.append([size, n, room[1]])
            tree.insert((room[0] - n * size, room[1]))
            left -= n
    return runs, bins


def equal_bins(sizes: list[int], counts: list[int], bins: int) -> list[list[int]]:
    """Runs [size, items, bin] over at most ``bins`` bins. While the largest item
    exceeds an equal share of what is left it gets a bin of its own; the rest is
    packed best-fit-decreasing at the least capacity that bisection finds."""
    sizes, counts, runs = list(sizes), list(counts), []
    total, used = sum(s * c for s, c in zip(sizes, counts)), 0
    while sizes and bins - used > 1 and sizes[0] * (bins - used) > total:
        runs.append([sizes[0], 1, used])
        used, total = used + 1, total - sizes[0]
        counts[0] -= 1
        if not counts[0]:
            sizes, counts = sizes[1:], counts[1:]
    if not sizes:
        return runs
    bins -= used
    low = max(sizes[0], -(-total // bins))
    got = best_fit_decreasing(sizes, counts, low, bins)
    high, step = low, max(1, low // 10_000)
    while got is None:
        high, step = high + step, step * 2
        got = best_fit_decreasing(sizes, counts, high, bins)
    while high - low > max(1, low // 100_000):
        mid = (low + high) // 2
        if (trial := best_fit_decreasing(sizes, counts, mid, bins)) is None:
            low = mid
        else:
            high, got = mid, trial
    return runs + [[s, n, b + used] for s, n, b in got[0]]


def ranges(runs: list[list[int]]) -> np.ndarray:
    """Rows (size, first ordinal, bin), sorted: a group of ``size`` bytes and a
    number among the groups of that size belongs to the last row not after it.
    Neighbours with one bin merge, so rows follow the changes of bin, not sizes."""
    taken: dict[int, int] = {}
    rows = []
    for size, n, b in runs:
        rows.append((size, taken.get(size, 0), b))
        taken[size] = rows[-1][1] + n
    rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return rows[np.r_[True, rows[1:, 2] != rows[:-1, 2]][: len(rows)]]


def numbered(rows: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """``rows`` (stored) with a number, gapless from 0 within each ``key``. No
    key's rows are sorted in one task: they are ranked within slices by hash of
    ``order``, then the slices' running totals are added."""
    slices = max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = rows.groupBy(key, "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key, "slice").orderBy(*order)) - 1
    ranked = rows.withColumn("rank", rank).join(starts, [key, "slice"])
    return ranked.withColumn(name, (F.col("first") + F.col("rank")).cast("long")).drop("slice", "rank", "first")


def shard_documents(docs: DataFrame, shards: int = 8, fine: int = 1000) -> DataFrame:
    """Shards of near equal bytes; documents of equal text are never parted.

    Returns doc_id, size (UTF-8 bytes + 1; null text counts as none),
    text_crc32, shard, slot (gapless from 0 in each shard). Null texts group
    with empty ones. A group larger than an equal share fills a shard alone and
    makes it the larger one, however long its text or however many its copies;
    the others stay equal. Groups of equal size are told apart by their texts'
    hash. An empty table gives no rows; repeated rows and null doc_ids are kept,
    each with its own slot; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.md5(raw).alias("grp"),
        )
    )
    groups = materialise(base.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")))
    # distinct sizes: their sum is at most all bytes, so their number at most the root of twice that
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).toArrow()
    plan = ranges(equal_bins(sizes["bytes"].to_pylist(), sizes["n"].to_pylist(), shards))
    shared = spark.sparkContext.broadcast(plan)  # a row where the shard changes, at most shards for each size

    def place(batches):
        key = [tuple(r) for r in shared.value[:, :2].tolist()]
        for b in batches:
            here = zip(b.column(1).to_pylist(), b.column(3).to_pylist())
            at = np.array([bisect_right(key, k) - 1 for k in here], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(shared.value[at, 2].astype(np.int32))], names=["grp", "copies", "shard"])

    where = materialise(numbered(groups, "bytes", ["grp"], "nth").select("grp", "bytes", "copies", "nth").mapInArrow(place, "grp string, copies long, shard int"))
    limit = (groups.agg(F.sum("copies")).first()[0] or 0) // fine
    # groups of more than 1/fine of all rows: at most ``fine`` of them, so they may be broadcast; no other is hot
    heavy = F.broadcast(where.where(F.col("copies") > limit).select("grp", "shard"))
    tagged = base.join(heavy, "grp", "left")
    light = tagged.where("shard is null").drop("shard").join(where.where(F.col("copies") <= limit).select("grp", "shard"), "grp")
    placed = materialise(tagged.where("shard is not null").unionByName(light))
    return numbered(placed, "shard", ["doc_id", "grp"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    d = shard_documents(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
