"""Exact shingle similarity behind the SimHash operator.

Texts are sets of word shingles; two link if their sets' Jaccard similarity
reaches a threshold, and links chain. Equal sets are first reduced to one.
SimHash fingerprints of the sets that differ in few bits are candidates (BK-trees,
see ``simhash``). Sets of similarity 0.8 differ in some ten of 64 bits, and within
such a radius a tree leaves nothing out; so min-hash bands add candidates: at the
threshold a pair shares no band key with probability ``MISS`` at most. Texts
joined by candidates, chained, form a group that holds every component of its
members whole, so each group's texts are sent to one task once. There the links
are decided exactly: shingles in order of their frequency in the group, rare
first, and an index over each set's prefix, which two sets at the threshold must
share; sets already reached leave the index, so a group of many copies costs no
pairs of them.

Scale. A key row is two numbers; a bucket reports a star, never pairs. A group's
texts must fit a task, which bounds the size of one chain of candidates.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import all_columns, components, free_name, map_rows, materialise, ship
from .passages import gram_hashes, mix
from .simhash import links, majority

ROWS = 6  # hashes of a band
MISS = 1e-5
TILE = 32_768
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the lower-cased (A-Z) words; a
    text of fewer words is one shingle, a text without words has none."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    return np.unique(gram_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)), size))


def name_of(held: np.ndarray) -> int:
    """64-bit name of a set; 0 of the empty one."""
    import xxhash

    return xxhash.xxh64_intdigest(held.tobytes(), 7) if len(held) else 0


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def band_keys(sets: list[np.ndarray], bands: int, seed: int = 11) -> np.ndarray:
    """(sets x bands) keys; the sets must not be empty."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, (bands, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= TILE):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for j in range(bands):
            key = np.full(end - at, j + 1, np.uint64)
            for f in factors[j]:
                key = mix(key * _GOLD + np.minimum.reduceat(x * f, starts))
            out[at:end, j] = key
        at = end
    return out


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A label for each set, equal where links of at least ``similarity`` chain."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    label = np.full(n, -1)
    known, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(known))
    shared = np.zeros(len(known), bool)
    shared[rank] = count > 1
    held = [np.sort(t) for t in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
    prefix = []
    for t in held:
        p = t[: len(t) - math.ceil(similarity * len(t) - 1e-9) + 1]
        prefix.append(p[shared[p]])
    token = np.concatenate(prefix)
    owner = np.repeat(np.arange(n), [len(p) for p in prefix])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    cuts = np.flatnonzero(np.diff(token)) + 1
    posts = dict(zip(token[np.r_[0, cuts]].tolist(), np.split(owner, cuts))) if len(token) else {}
    mark = np.zeros(len(known), bool)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        queue = [start]
        while queue:
            d = queue.pop()
            near = []
            for t in prefix[d].tolist():
                post = posts.get(t)
                if post is None:
                    continue
                post = post[label[post] < 0]
                if len(post):
                    posts[t] = post
                    near.append(post)
                else:
                    del posts[t]
            if not near:
                continue
            c = np.unique(np.concatenate(near))
            c = c[np.minimum(sizes[c], sizes[d]) >= similarity * np.maximum(sizes[c], sizes[d]) - 1e-9]
            mark[held[d]] = True
            for at in range(0, len(c), 1024):
                part = c[at : at + 1024]
                starts = np.cumsum(sizes[part]) - sizes[part]
                common = np.add.reduceat(mark[np.concatenate([held[i] for i in part])].astype(np.int64), starts)
                hit = part[common >= similarity * (sizes[part] + sizes[d] - common) - 1e-9]
                label[hit] = start
                queue += hit.tolist()
            mark[held[d]] = False
    return label


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``: the
    one of the smallest doc_id (of rows that repeat it with one set of shingles,
    any one). Texts without words, null ones too, are copies of each other. Rows
    without doc_id are not compared and stay; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    at, bands = docs.columns.index("text"), bands_for(similarity)
    name, keys, print_ = free_name(docs, "set"), free_name(docs, "keys"), free_name(docs, "fingerprint")
    schema = StructType([*docs.schema.fields, StructField(name, LongType()), StructField(print_, LongType()), StructField(keys, ArrayType(LongType()))])

    def prepare(batches):
        for b in (b[k : k + 1000] for b in batches for k in range(0, b.num_rows, 1000)):
            sets = [shingles(t.as_py() or "", shingle) for t in b.column(at)]
            names = np.array([name_of(s) for s in sets], np.uint64)
            full = [s for s in sets if len(s)]
            drawn = band_keys(full, bands) if full else np.zeros((0, bands), np.uint64)
            ends = np.cumsum([0] + [bands * bool(len(s)) for s in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(drawn.ravel().view(np.int64)))
            prints = np.array([majority([s]) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names.view(np.int64)), pa.array(prints.view(np.int64)), lists], names=schema.names)

    marked = materialise(map_rows(docs, prepare, schema))
    prints = marked.where("doc_id is not null").select(F.col(name).alias("node"), F.col("doc_id").cast("long").alias("low"), "text", F.col(print_).alias("fp"), F.col(keys).alias("keys"))
    distinct = materialise(prints.groupBy("node").agg(F.min("low").alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def stars(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key, node = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.r_[True, key[1:] != key[:-1]]
        low = node[first][np.cumsum(first) - 1]
        edges = np.unique(np.stack([node[~first], low[~first]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["u", "v"])

    keyed = distinct.select(F.explode("keys").alias("key"), "node").repartition(n, "key")
    # fingerprints within the radius: the sets of one hang on the first of them, and the firsts on each other
    named = distinct.where(F.size("keys") > 0).groupBy("fp").agg(F.min("node").alias("first"))
    near = links(named.select("fp"), radius)
    ends = near.join(named.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(named.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    same = distinct.where(F.size("keys") > 0).join(named, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    found = keyed.mapInArrow(stars, "u long, v long").unionByName(same).unionByName(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = components(found)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())  # a root is no node of its own there
    members = distinct.select("node", "low").join(groups, "node")
    texts = prints.select("node", "low", "text").join(members, ["node", "low"])

    def losers(batches):
        rows = {}
        for b in batches:
            for root, name, low, text in zip(*(c.to_pylist() for c in b.columns)):
                rows.setdefault(root, {})[name] = low, text
        out = []
        for group in rows.values():
            label = linked([shingles(t, shingle) for _, t in group.values()], similarity)
            best: dict = {}
            for k, (name, (low, _)) in zip(label.tolist(), group.items()):
                best[k] = min(best.get(k, (low, name)), (low, name))
            out += [name for k, name in zip(label.tolist(), group) if best[k][1] != name]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])

    gone = texts.select("root", "node", "low", "text").repartition(n, "root").mapInArrow(losers, "node long")
    first = distinct.select("node", "low").join(materialise(gone), "node", "left_anti")
    first = first.select(F.col("node").alias(name), F.col("low").alias("doc_id"))
    kept = marked.join(first, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return kept.select(all_columns(docs)).unionByName(marked.where("doc_id is null").select(all_columns(docs)))
