"""Exchange of content anchors between chunks of documents.

Both passage operators (bytes and words) look for strings of ``k`` symbols that
occur in more than one document. Every such string contains a minimiser: the
smallest hash among its q-grams. So only windows whose minimiser also occurs
in another document can repeat, and equal windows have equal minimisers. This
module finds these windows; it decides nothing: what is removed follows from
the index (or the sorted suffixes) that the operators build from them.

Texts travel as compressed chunks, written once to the shared folder. A chunk
reports each anchor once, so copies of a document or a line that everyone shares
cost one entry a chunk; a 32-bit rest of the hash in enough buckets keeps wrong
matches rare, and those only cost time.

Scale. There are as many buckets and shards as chunks (more shards once chunks are
large, ``shard_count``), and each has a task of its own that takes them one by one.
A chunk sends one packet to each, and a packet costs the same however small it is,
so chunks have a few megabytes up to some 4 GB of text, then grow with the root of
the corpus: chunk by chunk a packet stands for ``PACKET_BYTES`` of text up to chunks
of ``LARGE_CHUNK``, and for ``BLOB_BYTES`` at least (100 MB a chunk at 100 TB); half
of that where two shards share a chunk's worth of text.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, materialise, ship

CHUNK_BYTES = 4_000_000
LARGE_CHUNK = 16_000_000
SHARD_BYTES = 8_000_000
PACKET_BYTES, BLOB_BYTES = 4000, 100
TILE = 1 << 16  # its arrays stay in the cache
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def expand(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 10 * n, []
    for i in range(n):
        kind, length = struct.unpack_from("<2sQ", raw, 4 + 10 * i)
        a = np.frombuffer(raw, "<" + kind.decode(), length, at)
        out.append(a)
        at += a.nbytes
    return out


def chunk_size(docs: DataFrame) -> int:
    """Bytes of text to a chunk."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(CHUNK_BYTES, min(LARGE_CHUNK, math.isqrt(PACKET_BYTES * total)), math.isqrt(BLOB_BYTES * total))


def shard_count(chunks: int, chunk_bytes: int) -> int:
    """As many shards as chunks, or so many that a shard stands for
    ``SHARD_BYTES`` of text where chunks are larger."""
    return max(chunks, -(-chunks * min(chunk_bytes, LARGE_CHUNK) // SHARD_BYTES))


def pack_chunks(docs: DataFrame, chunk_bytes: int | None = None) -> DataFrame:
    """(chunk, payload) rows: doc_ids, lengths and bytes of whole texts; a
    chunk closes once it holds ``chunk_bytes``. Written to the shared folder."""
    ship(docs.sparkSession)
    if chunk_bytes is None:
        chunk_bytes = chunk_size(docs)

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def close():
            nonlocal n, ids, texts, size
            lens = np.array([len(t) for t in texts], np.int64)
            blob = squeeze(np.array(ids, np.int64), lens, np.frombuffer(b"".join(texts), np.uint8), level=3)
            row = pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "payload"])
            n, ids, texts, size = n + 1, [], [], 0
            return row

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                ids.append(d)
                texts.append(raw)
                size += len(raw) + 64
                if size >= chunk_bytes:
                    yield close()
        if ids:
            yield close()

    known = docs_of(docs).where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    return materialise(known.mapInArrow(run, "chunk long, payload binary"))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams of ``x`` (uint64 symbols), by doubling."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    out, done, cur, step = None, 0, x, 1
    while True:
        if q & step:
            seg = cur[done : done + len(x) - q + 1]
            out = seg.copy() if out is None else out * np.uint64(pow(_P, step, 1 << 64)) + seg
            done += step
        if done == q:
            return mix(out)
        cur = cur[: len(cur) - step] * np.uint64(pow(_P, step, 1 << 64)) + cur[step:]
        step *= 2


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest hash (leftmost of equals) in each ``span``
    neighbouring hashes; len(h) - span + 1 results."""
    low = np.uint64((1 << 23) - 1)
    cur = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= span:
        cur = np.minimum(cur[: len(cur) - have], cur[have:])
        have *= 2
    if have < span:
        cur = np.minimum(cur[: len(h) - span + 1], cur[span - have : span - have + len(h) - span + 1])
    return (cur & low).astype(np.int64)


def tiles(symbols: np.ndarray, k: int):
    """(position, uint64 symbols from there on) of tiles that share k - 1 symbols."""
    for at in range(0, max(0, len(symbols) - k + 1), TILE):
        yield at, symbols[at : at + TILE + k - 1].astype(np.uint64) + np.uint64(1)


def anchor_runs(symbols: np.ndarray, stop: np.ndarray, k: int, q: int):
    """Runs of neighbouring windows with one minimiser.

    ``symbols``: unsigned symbols of all documents of a chunk, one after another;
    ``stop``: end of each document. Returns (first window, last window + 1,
    anchor hash) of every run; windows never cross documents.
    """
    firsts, lasts, hashes = [], [], []
    for at, x in tiles(symbols, k):
        h = gram_hashes(x, q)
        pos = window_minima(h, k - q + 1)
        # ends of the windows' documents
        own = stop[np.searchsorted(stop, at, side="right") : np.searchsorted(stop, at + len(pos)) + 1]
        ends = np.repeat(own, np.diff(np.clip(np.r_[at, own], at, at + len(pos))))
        w = np.flatnonzero(ends >= np.arange(at + k, at + k + len(pos)))
        if not len(w):
            continue
        p = pos[w]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1)])
        last = np.r_[new[1:], len(w)] - 1
        firsts.append(w[new] + at)
        lasts.append(w[last] + 1 + at)
        hashes.append(h[p[new]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def bucket_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def report_anchors(hashes: np.ndarray, owners: np.ndarray, buckets: int):
    """Yield (bucket, blob): the chunk's distinct anchors, each with the number
    of its documents there (up to 255)."""
    key = bucket_keys(hashes, buckets)
    _, owners = np.unique(owners, return_inverse=True)
    bits = int(owners.max(initial=0)).bit_length()
    if 32 + buckets.bit_length() + bits <= 64:  # both in one number
        pair = np.sort(key << np.uint64(bits) | owners.astype(np.uint64))
        key = pair[np.r_[True, pair[1:] != pair[:-1]][: len(pair)]] >> np.uint64(bits)
    else:
        order = np.lexsort((owners, key))
        key, owners = key[order], owners[order]
        key = key[np.r_[True, (key[1:] != key[:-1]) | (owners[1:] != owners[:-1])][: len(key)]]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    count = np.minimum(np.diff(np.r_[start, len(key)]), 255).astype(np.uint8)
    key = key[start]
    b = (key >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(b)) + 1
    rest = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for s, e in zip(np.r_[0, cut], np.r_[cut, len(b)]):
        if e > s:
            yield int(b[s]), squeeze(rest[s:e], count[s:e])


def by_number(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Rows dealt to ``n`` tasks by a number, those of one number together."""
    return rows.repartition(n, column).sortWithinPartitions(column)


def numbers(batches):
    """(number, rows without it) of batches that ``by_number`` dealt; the rows of
    one number are in memory at a time."""
    held, last = [], None
    for b in batches:
        for number, *row in zip(*(c.to_pylist() for c in b.columns)):
            if held and number != last:
                yield last, held
                held = []
            last = number
            held.append(row)
    if held:
        yield last, held


def rows_of(batches):
    """The rows of batches; one row's chunk is in memory at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield [c[i].as_py() for c in b.columns]


def shared_anchors(reports: DataFrame, hot_docs: int, buckets: int) -> DataFrame:
    """(chunk, shared): for each chunk its anchors that occur in two documents
    or more, as keys with a mark for those in more than ``hot_docs``."""

    def run(batches):
        for bucket, rows in numbers(batches):
            parts = [expand(blob) for _, blob in rows]
            rest = np.concatenate([p[0] for p in parts])
            docs = np.concatenate([p[1] for p in parts]).astype(np.int64)
            _, group = np.unique(rest, return_inverse=True)
            total = np.bincount(group, docs)[group]
            keep = total > 1
            hot = (total > hot_docs).astype(np.uint8)
            at, chunks, blobs = 0, [], []
            for (chunk, _), p in zip(rows, parts):
                k = np.flatnonzero(keep[at : at + len(p[0])])
                if len(k):
                    key = (np.uint64(bucket) << np.uint64(32)) | p[0][k].astype(np.uint64)
                    chunks.append(chunk)
                    blobs.append(squeeze(key, hot[at : at + len(p[0])][k]))
                at += len(p[0])
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

    found = by_number(reports, "bucket", buckets).mapInArrow(run, "chunk long, blob binary")
    # a chunk's own anchors only: bounded by the chunk
    return found.groupBy("chunk").agg(F.collect_list("blob").alias("shared"))


class Shared:
    """Membership test of anchors in a chunk's shared set."""

    def __init__(self, blobs, buckets: int):
        parts = [expand(b) for b in blobs or []]
        self.buckets = buckets
        self.key = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        hot = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint8)
        order = np.argsort(self.key)
        self.key, self.hot = self.key[order], hot[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            none = np.zeros(len(hashes), bool)
            return none, none
        k = bucket_keys(hashes, self.buckets)
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        hit = self.key[at] == k
        return hit, hit & (self.hot[at] == 1)


def covered(length: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of the positions in any of the ranges [first, last)."""
    d = np.zeros(length + 1, np.int32)
    np.add.at(d, first, 1)
    np.add.at(d, last, -1)
    return np.cumsum(d[:-1], out=d[:-1]) > 0


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b, 7)


def place_segments(runs, shared, ids, stop, k: int, buckets: int, shards: int, text_of):
    """The candidate segments of a chunk.

    ``runs``: (first window, last + 1, anchor) of ``anchor_runs``; ``text_of(s,
    e)`` gives the symbols s to e as bytes. A segment spans the windows of one
    shared anchor; hot anchors are cut to single windows, each placed by its own
    content. Returns by shard the chunk's distinct segments with the smallest
    document of each and whether others have it too, and the places of all
    segments, packed, which the answers need (``removed_mask``).
    """
    first, last, h = runs
    hit, hot = Shared(shared, buckets).find(h)
    first, last, h, hot = first[hit], last[hit], h[hit], hot[hit]
    if hot.any():
        n = (last - first)[hot]
        w = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hw = np.array([hash_bytes(text_of(i, i + k)) for i in w.tolist()], np.uint64)
        first, last, h = np.r_[first[~hot], w], np.r_[last[~hot], w + 1], np.r_[h[~hot], hw]
    owner = np.searchsorted(stop, first, side="right")
    shard = (mix(h) % np.uint64(shards)).astype(np.int64)
    number = np.zeros(len(first), np.int64)
    seen: dict[tuple, int] = {}
    by: dict[int, tuple[list, list, list]] = {}
    for i, (s, e, g, d) in enumerate(zip(first.tolist(), (last + k - 1).tolist(), shard.tolist(), ids[owner].tolist())):
        text = text_of(s, e)
        texts, docs, many = by.setdefault(g, ([], [], []))
        at = number[i] = seen.setdefault((g, text), len(texts))
        if at == len(texts):
            texts.append(text)
            docs.append(d)
            many.append(0)
        elif d != docs[at]:
            docs[at] = min(d, docs[at])
            many[at] = 1
    return by, pack_places(shard, number, first)


def pack_places(shard: np.ndarray, number: np.ndarray, first: np.ndarray) -> bytes:
    """Shard, number there and first window of every segment, by shard and number."""
    order = np.lexsort((first, number, shard))
    shard, number, first = shard[order], number[order], first[order]
    step = np.diff(number, prepend=0) == 1  # numbers go up by one, from 0 in each shard
    return squeeze(shard.astype(np.int32), step.astype(np.uint8), np.diff(first, prepend=0).astype(np.int32 if not len(first) or first.max() < 1 << 31 else np.int64))


def unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shard, step, gap = expand(blob)
    shard, up = shard.astype(np.int64), np.cumsum(step, dtype=np.int64)
    head = np.r_[True, shard[1:] != shard[:-1]][: len(shard)]
    base = up[head]
    return shard, up - np.repeat(base, np.diff(np.r_[np.flatnonzero(head), len(shard)])), np.cumsum(gap, dtype=np.int64)


SENT = "shard int, chunk long, blob binary, own boolean"
ANSWERED = "chunk long, blob binary, own boolean"


def sent_rows(chunk: int, rows: list, places: bytes, shards: int) -> pa.RecordBatch:
    """What a chunk sends: (shard, blob) rows, and its places to a shard that its
    number names, so no second pass over its text finds them again."""
    rows = rows + [(chunk % shards, places)] if rows else []
    own = [i == len(rows) - 1 for i in range(len(rows))]
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(own, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "chunk", "blob", "own"])


def answer_rows(chunks: list, blobs: list, own: bool = False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary()), pa.array([own] * len(chunks), pa.bool_())], names=["chunk", "blob", "own"])


def own_places(rows: list) -> pa.RecordBatch:
    """The places among a shard's rows, on their way back."""
    back = [(chunk, blob) for chunk, blob, own in rows if own]
    return answer_rows([c for c, _ in back], [b for _, b in back], True)


def by_chunk(answered: DataFrame) -> DataFrame:
    """(chunk, answers, places)."""
    return answered.groupBy("chunk").agg(
        F.collect_list(F.when(~F.col("own"), F.col("blob"))).alias("answers"), F.first(F.when(F.col("own"), F.col("blob")), ignorenulls=True).alias("places")
    )


def answer_runs(windows: np.ndarray, doc: np.ndarray):
    """Runs of equal answers inside each segment: (runs of each segment, windows
    of each run, document of each run). ``windows``: windows of each segment;
    ``doc``: the answer of every window, segment by segment."""
    seg = np.repeat(np.arange(len(windows)), windows)
    new = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])])
    return np.bincount(seg[new], minlength=len(windows)), np.diff(np.r_[new, len(seg)]), doc[new]


def removed_mask(length: int, ids, stop, places: bytes, answers, k: int) -> np.ndarray:
    """Mask of the symbols in windows that a smaller document holds. Answers:
    blobs of (shard), runs of each segment, windows and document of each run."""
    shard, number, first = unpack_places(places)
    owner = np.searchsorted(stop, first, side="right")
    offset = np.zeros(int(shard.max()) + 1, np.int64)
    base, counts, sizes, docs = 0, [], [], []
    for blob in answers:
        g, cnt, size, doc = expand(blob)
        offset[int(g[0])] = base
        base += len(cnt)
        counts.append(cnt.astype(np.int64))
        sizes.append(size.astype(np.int64))
        docs.append(doc)
    cnt, size, doc = np.concatenate(counts), np.concatenate(sizes), np.concatenate(docs)
    run0 = np.cumsum(cnt) - cnt
    inside = np.cumsum(size) - size  # windows before a run, over all segments
    seg = offset[shard] + number
    c = cnt[seg]
    idx = np.repeat(run0[seg], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    s = np.repeat(first, c) + inside[idx] - np.repeat(inside[run0[seg]], c)
    hit = (doc[idx] >= 0) & (doc[idx] < np.repeat(ids[owner], c))
    return covered(length, s[hit], (s + size[idx] + k - 1)[hit])
