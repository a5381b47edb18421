"""SimHash near-duplicate groups with BK-trees.

Fingerprints within ``radius`` bits link. Equal fingerprints are first reduced
to one row, so a group of copies of any size is one vertex. A shard of them is
held in a BK-tree: every fingerprint is a node, children hang on edges labelled
with the Hamming distance to their parent, at most one to a label, and a search
follows only the edges within the radius of the query's own distance.

Scale. One tree over everything would be visited in a fixed share by every
query. So beyond ``shard_rows`` fingerprints the shards are dealt by pigeonhole:
of radius + 1 blocks of bits, two fingerprints that differ in at most ``radius``
bits agree on one, so they meet in a shard keyed by the first bits of that
block, as many as bring shards down to ``shard_rows``. A shard that is still
larger takes the rest of its block, then further bits, and what these do not part
(a great many fingerprints within a few bits) is cut into slices that are searched
pair by pair. Trees stay where their
shard is: to broadcast them, the driver would have to gather the fingerprints of
all documents. A shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import all_columns, components, docs_of, free_name, map_rows, materialise, ship, table

SHARD_ROWS = 16_384
ROUNDS = 3
_ALL = (1 << 64) - 1


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles; 0 without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part)) for part in _parts(grams))


def _parts(grams, size: int = 65_536):
    return (grams[at : at + size] for at in range(0, len(grams), size))


def majority(hashes) -> int:
    """The bits set in over half of all hashes, given in parts."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """BK-tree over distinct fingerprints. Nodes are numbered level by level, so
    the children of a node are neighbours, in the order of their edges; ``first``
    gives for (node, edge) the first child on that edge or a longer one."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values, self.visited = values, 0
        self.member = np.zeros(n, np.int64)  # value of each node
        children = np.zeros((n, 67), np.int32)
        base = np.zeros(n, np.int32)
        rest, under, made = np.arange(1, n), np.zeros(max(0, n - 1), np.int64), min(n, 1)
        while len(rest):
            edge = np.bitwise_count(values[rest] ^ values[self.member[under]]).astype(np.int64)
            order = np.lexsort((edge, under))
            rest, under, edge = rest[order], under[order], edge[order]
            new = np.r_[True, (under[1:] != under[:-1]) | (edge[1:] != edge[:-1])]
            node = made + np.cumsum(new) - 1
            self.member[node[new]] = rest[new]
            children[under[new], edge[new] + 1] += 1
            parent = under[new]
            top = np.r_[True, parent[1:] != parent[:-1]]
            base[parent[top]] = node[new][top]
            rest, under, made = rest[~new], node[~new], made + int(new.sum())
        self.first = np.cumsum(children, axis=1, dtype=np.int32) + base[:, None]

    def search(self, queries: np.ndarray, radius: int):
        """Yield (query positions, value positions) within the radius. Many
        queries walk down together: a front of (query, node) pairs."""
        who = np.arange(len(queries) if len(self.values) else 0)
        node = np.zeros(len(who), np.int64)
        while len(who):
            self.visited += len(who)
            at = self.member[node]
            d = np.bitwise_count(queries[who] ^ self.values[at]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield who[hit], at[hit]
            lo = self.first[node, np.maximum(d - radius, 0)].astype(np.int64)
            n = self.first[node, np.minimum(d + radius + 1, 66)] - lo
            who = np.repeat(who, n)
            node = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(who))


class Labels:
    """Vectorised union-find: hook on the smaller label, then compress."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a, b):
        while True:
            la, lb = self.of[a], self.of[b]
            odd = la != lb
            if not odd.any():
                return
            a, b, la, lb = a[odd], b[odd], la[odd], lb[odd]
            parent = np.arange(len(self.of))
            np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.of = parent[self.of]


def forest(values: np.ndarray, radius: int, queries: np.ndarray | None = None, batch: int = 1024) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (value, representative) that connect what the radius connects, and
    the number of tree nodes visited: a tree of ``values`` searched with ``queries``
    (others than the values; by default the values themselves)."""
    tree, every = BKTree(values), values if queries is None else np.r_[values, queries]
    labels, skip = Labels(len(every)), len(every) - (len(values) if queries is None else len(queries))
    for at in range(skip, len(every), batch):
        for q, m in tree.search(every[at : at + batch], radius):
            labels.link(q + at, m)
    odd = labels.of != np.arange(len(every))
    return every[odd], every[labels.of[odd]], tree.visited


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks_for(n: int, radius: int, shard_rows: int = SHARD_ROWS) -> list[int]:
    """Bit masks, one of which any two fingerprints within ``radius`` agree on:
    of each of radius + 1 blocks the first bits, so that about ``shard_rows`` of
    ``n`` fingerprints share a key. One empty mask if all fit a shard."""
    bits = max(0, -(-n // shard_rows) - 1).bit_length()
    if not bits:
        return [0]
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [((1 << min(bits, hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def refine(mask: int, radius: int) -> list[int]:
    """Finer masks for the fingerprints of one key: the whole of a block begun,
    else ``mask`` with each of radius + 1 parts of the bits it leaves out."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    for lo, hi in zip(edges, edges[1:]):
        block = ((1 << (hi - lo)) - 1) << lo
        if mask & block == mask and 0 < mask < block:
            return [block]
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [free[k :: radius + 1] for k in range(radius + 1)]
    return [mask | sum(1 << i for i in p) for p in parts]


def links(distinct: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS, visits=None) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints (column fp).
    ``visits``: an accumulator of the tree nodes that searches visit."""
    spark = distinct.sparkSession
    masks = masks_for(distinct.count(), radius, shard_rows)
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    for _ in range(ROUNDS):
        hot = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows).select("mask", "key")
        here = [r["mask"] for r in hot.select("mask").distinct().collect()]  # masks, not keys: a fixed number
        if not here:
            break
        hot = hot.withColumn("hot", F.lit(True))
        tagged = keyed.join(hot, ["mask", "key"], "left")
        calm = tagged.where("hot is null").select("fp", "mask", "key")
        done = calm if done is None else done.unionByName(calm)
        finer = F.create_map(*[x for m in here for x in (F.lit(m), F.array(*[F.lit(_signed(k)) for k in refine(m & _ALL, radius)]))])
        keyed = tagged.where("hot").select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        keyed = materialise(keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))
    # what no key parts is cut into slices; each pair of them is a shard, one the tree and one the queries
    large = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows)
    cut = keyed.join(large, ["mask", "key"], "left").withColumn("slices", F.coalesce(F.ceil(F.col("n") / shard_rows), F.lit(1)).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cut = cut.select("fp", "mask", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).alias("query"))
    if done is not None:
        cut = cut.unionByName(done.select("fp", "mask", "key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("query")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        for fp, query in keyed_groups(batches):
            if len(fp) > 1:
                fp = fp.view(np.uint64)
                u, v, seen = forest(np.sort(fp[~query]), radius, fp[query] if query.any() else None)
                if visits is not None:
                    visits.add(seen)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    key = ["mask", "key", "a", "b"]
    return cut.select("fp", *key, "query").repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


def keyed_groups(batches):
    """(values, query marks) of each key of batches (value, key columns, mark)
    sorted by key: one shard in memory at a time."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        fp, *key, query = (b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns))
        cuts = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in key])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(fp)]):
            name = [c[s] for c in key]
            if held and name != last:
                yield tuple(map(np.concatenate, zip(*held)))
                held = []
            last = name
            held.append((fp[s:e], query[s:e]))
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def component_of(prints: DataFrame, radius: int, visits=None) -> DataFrame:
    """(fp, low, root, component_id) for each distinct fingerprint of ``prints``
    (doc_id, fp); low is its smallest doc_id, root the smallest fingerprint of
    its component, which names it even where components share a doc_id."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"), radius, visits=visits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "low", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, visits=None) -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits. Null and empty texts have fingerprint zero and
    link as any other; a bit set in exactly half the shingles is 0; a text of any
    length is read whole; rows that repeat a doc_id share its number, and rows
    without doc_id take part with a null one, which is their component_id where
    no other doc_id is reachable; an empty table gives no rows; extra columns,
    whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    prints = materialise(fingerprints(docs_of(docs), shingle))
    named = component_of(prints, radius, visits).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``: the
    one of the smallest doc_id (of rows that repeat it with one fingerprint,
    any one). Null and empty texts are one group. Rows without doc_id are not
    compared and stay; an empty table gives no rows.

    With ``similarity``, links are texts whose sets of shingles are that similar
    (Jaccard), verified exactly: fingerprints within the radius are candidates, and
    so are texts too far apart for a radius that trees can search (``shingles``)."""
    if similarity is not None:
        from . import shingles

        return shingles.keep_one(docs, shingle, similarity, radius)
    ship(docs.sparkSession)
    at, mark = docs.columns.index("text"), free_name(docs, "simhash")
    schema = StructType([*docs.schema.fields, StructField(mark, LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=schema.names)

    marked = materialise(map_rows(docs, run, schema))
    prints = marked.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("fp"))
    first = component_of(prints, radius).where("low = component_id").groupBy("root", "component_id").agg(F.min("fp").alias(mark)).drop("root")
    first = first.withColumnRenamed("component_id", "doc_id")
    kept = marked.join(first, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(all_columns(docs)).unionByName(marked.where("doc_id is null").select(all_columns(docs)))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
