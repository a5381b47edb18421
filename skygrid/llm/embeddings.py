"""Embedding near-duplicates by a subspace pigeonhole range join.

Unit vectors with cosine >= c lie within squared distance t = 2 - 2c. After a
fixed random rotation the coordinates are split into ``blocks`` blocks; if two
vectors are within t, some block differs by at most its share of the budget,
t * (block width / dims). So each block is range-joined on its own under that
radius, and the union of the candidates is verified exactly in double precision.

A block's range join partitions the block's space by a median-split tree fitted
on a bounded sample; then one aggregation over all vectors gives the exact box of
every leaf. A vector is at home in one leaf and visits every leaf of a higher
number whose box is within the radius; a pair meets where the lower-leaf vector
visits the higher one's home, once. Each (block, leaf) is cut into tiles of at
most ``tile`` homes by ``tile`` visitors, so no task holds a hot leaf. Inside a
task both sides are split on, to leaves of ``SMALL`` rows with exact boxes of
their own, and only boxes within the radius are compared.

Equal vectors are first reduced to one row with a count. Tiles verify their own
candidates and report counts of links by vector and spanning links, never pairs:
a group of near copies of a third of all rows would be quadratic in pairs.

Scale. Leaves follow the root of the rows, so what every task knows of them stays
small. The work depends on the data: boxes of clustered vectors are far apart; for
vectors without structure no exact partition of 16 dimensions keeps a ball of this
radius in few leaves, and the join does a falling share of all pairs (README).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, ship, table
from .passages import mix
from .simhash import Labels

SAMPLE, SAMPLE_BYTES = 20_000, 16_000_000
LEAF_ROWS = 8_192
SMALL = 512


class BlockTree:
    """Median-split tree over one block: leaf boxes given by the splits, then
    shrunk to what they hold."""

    def __init__(self, sample: np.ndarray, leaves: int):
        d = sample.shape[1]
        boxes = [(np.full(d, -np.inf), np.full(d, np.inf), sample)]
        while len(boxes) < leaves:
            nxt = []
            for lo, hi, x in boxes:
                axis = int(x.var(0).argmax()) if len(x) else 0
                cut = float(np.median(x[:, axis])) if len(x) else 0.0
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[axis] = right_lo[axis] = cut
                nxt += [(lo, left_hi, x[x[:, axis] < cut]), (right_lo, hi, x[x[:, axis] >= cut])]
            boxes = nxt
        self.lo = np.array([b[0] for b in boxes])
        self.hi = np.array([b[1] for b in boxes])
        self.least, self.most = self.lo, self.hi  # exact bounds, once known

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each leaf's exact box."""
        out = np.zeros((len(x), len(self.lo)))
        for a in range(x.shape[1]):
            v = x[:, a, None]
            gap = np.maximum(np.maximum(self.least[:, a] - v, v - self.most[:, a]), 0)
            out += gap * gap
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        inside = np.ones((len(x), len(self.lo)), bool)
        for a in range(x.shape[1]):
            v = x[:, a, None]
            inside &= (v >= self.lo[:, a]) & (v < self.hi[:, a])
        return inside.argmax(1)


class Space:
    """Rotation, blocks, radii and trees; bounded by the sample and the leaves."""

    def __init__(self, sample: np.ndarray, dims: int, cosine: float, blocks: int, leaves: int, seed: int = 3):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
        self.rotation = q * np.sign(np.diag(r))
        self.cosine = cosine
        blocks = min(blocks, dims)
        edges = [dims * i // blocks for i in range(blocks + 1)]
        self.blocks = [slice(a, b) for a, b in zip(edges, edges[1:])]
        # a hair more than the share, so that rounding loses no pair
        self.budget = [(2 - 2 * cosine) * (b.stop - b.start) / dims * (1 + 1e-9) + 1e-12 for b in self.blocks]
        turned = sample @ self.rotation
        self.trees = [BlockTree(turned[:, b], leaves) for b in self.blocks]

    def turn(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.rotation

    def turn_alike(self, unit: np.ndarray) -> np.ndarray:
        """The same, summed one coordinate after another: equal to the last bit
        for a row, whatever other rows stand beside it."""
        out = np.zeros_like(unit)
        for j, axis in enumerate(self.rotation):
            out += unit[:, j, None] * axis
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(key: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.maximum(tiles, 1).astype(np.uint64)).astype(np.int64)


def _visits(space: Space, x: np.ndarray):
    """For each block: home leaf of every row, and (row, leaf) visits to leaves
    of a higher number within the radius."""
    turned = space.turn(_unit(x))
    for b, tree, budget in zip(space.blocks, space.trees, space.budget):
        part = turned[:, b]
        home = tree.home(part)
        near = tree.distances(part) <= budget + 1e-9
        near &= np.arange(near.shape[1])[None, :] > home[:, None]
        row, leaf = np.nonzero(near)
        yield home, row, leaf


def _rows(batch):
    ids = batch.column(0).to_numpy()
    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(len(ids), -1)
    return ids, batch.column(2).to_numpy(), x


def bound_leaves(distinct: DataFrame, space: Space) -> None:
    """Set the exact box of every leaf; leaves x dims rows reach the driver."""
    shared = distinct.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        s, low, high = shared.value, None, None
        for b in batches:
            _, _, x = _rows(b)
            if not len(x):
                continue
            turned = s.turn(_unit(x))
            if low is None:
                low = np.full((len(s.trees[0].lo), x.shape[1]), np.inf)
                high = -low
            for block, tree in zip(s.blocks, s.trees):
                home = tree.home(turned[:, block])
                np.minimum.at(low[:, block], home, turned[:, block])
                np.maximum.at(high[:, block], home, turned[:, block])
        if low is not None:
            leaf, axis = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(axis), pa.array(low[leaf, axis]), pa.array(high[leaf, axis])], names=["leaf", "axis", "low", "high"])

    found = distinct.mapInArrow(run, "leaf long, axis long, low double, high double").groupBy("leaf", "axis")
    found = found.agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    low = np.full((len(space.trees[0].lo), len(space.rotation)), np.inf)
    high = -low
    at = found["leaf"].to_numpy(), found["axis"].to_numpy()
    low[at], high[at] = found["low"].to_numpy(), found["high"].to_numpy()
    for block, tree in zip(space.blocks, space.trees):
        tree.least, tree.most = low[:, block], high[:, block]


def plan_tiles(distinct: DataFrame, space: Space, tile: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block the numbers of tiles of homes and of visitors by leaf."""
    shared = distinct.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        s, counts = shared.value, None
        for b in batches:
            _, _, x = _rows(b)
            if not len(x):
                continue
            if counts is None:
                counts = np.zeros((len(s.trees), 2, len(s.trees[0].lo)), np.int64)
            for k, (home, _, leaf) in enumerate(_visits(s, x)):
                counts[k, 0] += np.bincount(home, minlength=counts.shape[2])
                counts[k, 1] += np.bincount(leaf, minlength=counts.shape[2])
        if counts is not None:
            at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in at), pa.array(counts[at])], names=["block", "role", "leaf", "n"])

    sums = distinct.mapInArrow(run, "block long, role long, leaf long, n long").groupBy("block", "role", "leaf").agg(F.sum("n").alias("n")).toArrow()
    cuts = np.zeros((len(space.trees), 2, len(space.trees[0].lo)), np.int64)
    cuts[sums["block"].to_numpy(), sums["role"].to_numpy(), sums["leaf"].to_numpy()] = -(-sums["n"].to_numpy() // tile)
    return [(c[0], c[1]) for c in cuts]


def _grouped(*columns: np.ndarray):
    """(values of the columns, positions) of every combination present."""
    order = np.lexsort(columns[::-1])
    if not len(order):
        return
    cols = [c[order] for c in columns]
    cuts = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in cols])) + 1
    for s, members in zip([0, *cuts], np.split(order, cuts)):
        yield [int(c[s]) for c in cols], members


def tile_links(distinct: DataFrame, space: Space, tile: int, component: str = "float64") -> DataFrame:
    """(kind, u, v): kind 0 a spanning link, kind 1 that u has v links (counting
    the copies of the other side) found in one tile."""
    spark = distinct.sparkSession
    bound_leaves(distinct, space)
    plan = plan_tiles(distinct, space, tile)
    shared, tiles = spark.sparkContext.broadcast(space), spark.sparkContext.broadcast(plan)
    dims, kind = space.rotation.shape[0], np.dtype(component)

    def deal(batches):
        """(block, leaf, home tile, visitor tile, role, rows): homes go to every
        visitor tile of their leaf and, as partners of each other, to every pair
        of home tiles; visitors to every home tile."""
        for batch in batches:
            ids, copies, x = _rows(batch)
            out = []
            for k, (home, row, leaf) in enumerate(_visits(shared.value, x) if len(ids) else ()):
                homes, guests = tiles.value[k]
                for (h, g), members in _grouped(home, _spread(ids, homes[home])):
                    for other in range(guests[h]):
                        out.append((k, h, g, other, 0, members))
                    for other in range(homes[h]):  # homes among themselves: -1 - tile marks a home tile as partner
                        lo, hi = min(g, other), max(g, other)
                        out.append((k, h, lo, -1 - hi, 0 if g == lo else 1, members))
                for (h, g), members in _grouped(leaf, _spread(ids[row], guests[leaf])):
                    for other in range(homes[h]):
                        out.append((k, h, other, g, 1, row[members]))
            blobs = [ids[m].tobytes() + copies[m].astype(np.int64).tobytes() + x[m].astype(kind).tobytes() for *_, m in out]
            cols = [pa.array([o[c] for o in out], pa.int64()) for c in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(blobs, pa.binary())], names=["block", "leaf", "a", "b", "role", "rows"])

    def join(batches):
        s, held, last = shared.value, ([], []), None

        def close():
            (k, _, a, g), (left, right) = last, held
            same = g < 0 and a == -1 - g  # a home tile with itself
            if left and (right or same):
                L = _unpack(left, dims, kind)
                yield from _verify(s, k, L, L if same else _unpack(right, dims, kind), same)

        for b in batches:
            for *cell, role, blob in zip(*(c.to_pylist() for c in b.columns)):
                if last is not None and cell != last:
                    yield from close()
                    held = [], []
                last = cell
                held[role].append(blob)
        if last is not None:
            yield from close()

    dealt = distinct.mapInArrow(deal, "block long, leaf long, a long, b long, role long, rows binary")
    cells = int(sum((h * g + h * (h + 1) // 2).sum() for h, g in plan))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells, 10_000))
    cell = ["block", "leaf", "a", "b"]
    return dealt.repartition(n, *cell).sortWithinPartitions(*cell).mapInArrow(join, "kind int, u long, v long")


def _unpack(blobs, dims, kind):
    ids, copies, xs = [], [], []
    for b in blobs:
        n = len(b) // (16 + kind.itemsize * dims)
        ids.append(np.frombuffer(b, np.int64, n))
        copies.append(np.frombuffer(b, np.int64, n, 8 * n))
        xs.append(np.frombuffer(b, kind, n * dims, 16 * n).reshape(n, dims))
    return np.concatenate(ids), np.concatenate(copies), _unit(np.concatenate(xs).astype(np.float64))


def small_leaves(x: np.ndarray, rows: int = SMALL):
    """Positions of leaves of at most ``rows`` rows by median splits, and their
    exact boxes."""
    stack, out = [np.arange(len(x))], []
    while stack:
        at = stack.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        v = x[at, int(x[at].var(0).argmax())]
        order = np.argpartition(v, len(at) // 2)
        stack += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out, np.array([x[at].min(0) for at in out]), np.array([x[at].max(0) for at in out])


def range_pairs(x: np.ndarray, y: np.ndarray, budget: float, same: bool):
    """Yield (rows of x, rows of y) that hold all pairs within the squared
    distance, and few others; each pair once."""
    ours, lo, hi = small_leaves(x)
    theirs, low, high = (ours, lo, hi) if same else small_leaves(y)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    xsq, ysq = (x32**2).sum(1), (y32**2).sum(1)
    limit = np.float32(budget + 1e-5)  # of single precision; the exact test follows
    for i, at in enumerate(ours):
        gap = np.maximum(np.maximum(low - hi[i], lo[i] - high), 0)
        near = (gap**2).sum(1) <= budget + 1e-9
        for j in np.flatnonzero(near):
            if same and j < i:
                continue
            to = theirs[j]
            d = xsq[at, None] + ysq[to] - 2 * (x32[at] @ y32[to].T)
            p, q = np.nonzero(d <= limit)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield at[p], to[q]


def _verify(space: Space, k: int, L, R, same: bool):
    """Range join of block k, then exact cosines of its candidates. A pair that
    several blocks find counts in the first of them only: blocks are told by one
    formula on coordinates that are alike wherever a row is."""
    (lid, lcopies, lu), (rid, rcopies, ru) = L, R
    every = np.unique(np.r_[lid, rid])
    labels = Labels(len(every))
    lpos, rpos = np.searchsorted(every, lid), np.searchsorted(every, rid)
    links = np.zeros(len(every), np.int64)
    block = space.blocks[k]
    for i, j in range_pairs(space.turn(lu)[:, block], space.turn(ru)[:, block], space.budget[k], same):
        rows, p = np.unique(i, return_inverse=True)
        cols, q = np.unique(j, return_inverse=True)
        a, b = space.turn_alike(lu[rows]), space.turn_alike(ru[cols])
        for c in range(0, len(i), 100_000):
            pc, qc = p[c : c + 100_000], q[c : c + 100_000]
            gaps = [((a[pc][:, s] - b[qc][:, s]) ** 2).sum(1) <= space.budget[n] for n, s in enumerate(space.blocks[: k + 1])]
            first = gaps[k] & ~np.logical_or.reduce(gaps[:k]) if k else gaps[k]
            x, y = rows[pc[first]], cols[qc[first]]
            hit = np.einsum("ij,ij->i", lu[x], ru[y]) >= space.cosine
            x, y = x[hit], y[hit]
            np.add.at(links, lpos[x], rcopies[y])
            np.add.at(links, rpos[y], lcopies[x])
            labels.link(lpos[x], rpos[y])
    some = np.flatnonzero(links)
    odd = np.flatnonzero(labels.of != np.arange(len(every)))
    u = np.r_[every[odd], every[some]]
    v = np.r_[every[labels.of[odd]], links[some]]
    kind = np.r_[np.zeros(len(odd), np.int32), np.ones(len(some), np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(u), pa.array(v)], names=["kind", "u", "v"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, blocks: int = 4, tile: int = 32_768, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``
    (vec_id, embedding array).

    Links are pairs of cosine >= ``cosine`` in double precision, ties included.
    Null, empty and zero vectors and vectors with null or non-finite components
    link with nothing; their component is their own vec_id. Vectors of different
    length do not link; each length present is a join of its own. Rows that repeat
    a vec_id count as vectors of their own; rows without vec_id link as others do,
    and their component_id is null where no other vec_id is reachable. An empty
    table gives no rows; extra columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    component = "float32" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"  # no rounding on the way
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("e").isNotNull() & ~F.exists("e", bad) & F.exists("e", lambda x: x != 0)
    base = base.withColumn("ok", F.coalesce(usable, F.lit(False)))
    out = base.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sizes = base.where("ok").select(F.size("e").alias("n")).distinct().orderBy("n").collect()  # lengths, a short list
    for size in sizes:
        rows = base.where(F.col("ok") & (F.size("e") == size["n"]))
        out = out.unionByName(_of_length(rows, size["n"], cosine, blocks, tile, leaf_rows, component))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _of_length(usable: DataFrame, dims: int, cosine: float, blocks: int, tile: int, leaf_rows: int, component: str) -> DataFrame:
    """(vec_id, n_links, component_id) of usable vectors of one length."""
    stored = materialise(_packed(usable, dims))
    distinct = stored.groupBy("x").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # a name of its own for every vector, also where rows repeat a vec_id or have none
    distinct = materialise(distinct.select(F.monotonically_increasing_id().alias("node"), "x", "copies", "low"))
    rows = distinct.count()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    picked = distinct.orderBy(F.xxhash64("x")).limit(most).select("x").collect()  # bounded in rows and bytes, for the splits only
    sample = _unit(np.frombuffer(b"".join(bytes(r["x"]) for r in picked), np.float64).reshape(-1, dims))
    leaves = 1
    while leaves * max(leaf_rows, 64 * math.isqrt(rows)) < rows:
        leaves *= 2
    found = materialise(tile_links(distinct.select("node", "x", "copies"), Space(sample, dims, cosine, blocks, leaves), tile, component))
    roots = components(found.where("kind = 0").select("u", "v"))
    counts = found.where("kind = 1").groupBy("u").agg(F.sum("v").alias("others")).withColumnRenamed("u", "node")
    named = distinct.join(roots, "node", "left").join(counts, "node", "left")
    named = named.select("x", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return stored.join(named.join(least, "root"), "x").select("vec_id", "n_links", "component_id")


def _packed(usable: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x): the vector as double bytes, negative zeros made positive."""

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "x"])

    return usable.select("vec_id", "e").mapInArrow(run, "vec_id long, x binary")


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.n, p.b FROM reach JOIN p ON p.a = reach.m),
c AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT c.n AS vec_id, coalesce(k.links, 0)::BIGINT AS n_links, c.component_id, c.n = c.component_id AS kept FROM c LEFT JOIN k ON k.a = c.n
"""
